"""Golden cases of the fixture operators and of pages."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as S
from touchline.operators import bridge as B
from touchline.operators import fixtures as X
from touchline.operators import incremental as I
from touchline.operators import quality as Q
from touchline.operators import relational as R
from touchline.sources import html as H
from touchline.sources import web
from touchline.sources.tables import Store, read_spreadsheet


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    c = F.lit
    assert one(spark, S.player_id(c("https://a/joueur/1678-loic-credoz"))) == "1678"
    assert one(spark, S.player_id(c("https://a/x"))) is None
    assert one(spark, S.match_id(c("/j17/8218-toulon-paris"))) == "8218"
    assert one(spark, S.match_id(c("/x"))) == "Unknown"
    assert one(spark, S.iso_date(c("le 05/11/2022 à 9h05"))) == "2022-11-05"
    assert one(spark, S.kickoff(c("le 05/11/2022 à 9h05"))) == "09:05"
    assert [one(spark, S.digits(c(x))) for x in ("83", " 12 ", "-")] == [83, 12, None]
    assert [one(spark, S.matchday_id(c(x))) for x in ("21_22-R5", " 21_22_R5 ", "abc")] == ["21_22_R5", "21_22_R5", "abc"]
    assert [one(spark, S.squad_name(c(x))) for x in ("Name (c)*", "Name*")] == ["Name", "Name"]
    assert one(spark, S.percent(c("56,5%"))) is None and one(spark, S.percent(c(" 56.9 %"))) == 56
    for case, want in {("2022-2023", 20, 27, 2, 2): (1, 0), ("2023-2024", 20, 27, 2, 2): (0, 0), ("2023-2024", 20, 25, 2, 2): (1, 0), ("2023-2024", 30, 10, 4, 1): (1, 0), ("2021-2022", 15, 15, 5, 2): (1, 0), ("2021-2022", None, 15, 5, 2): (0, 0)}.items():
        pair = S.bonus_points(*[c(v).cast("int") if i else c(v) for i, v in enumerate(case)])
        assert tuple(one(spark, p) for p in pair) == want, case
    assert one(spark, R.shrunk_weight(c(120.0), c(2), c(60.0))) == 0.75
    assert one(spark, R.shrunk_weight(c(120.0), c(2), c(None).cast("double"))) == 0.75
    assert one(spark, R.shrunk_weight(c(0.0), c(0), c(None).cast("double"))) == 0.0
    assert one(spark, S.squads_url(c("https://w/2024_Six_Nations_Championship/"), c(" 6 Nations"))).endswith("Championship_squads")
    S.register(spark)
    assert spark.sql("select player_id('/joueur/12-a') a, digits_of('x1y2') b, home_bonus('2022-2023', 20, 27, 2, 2) c, norm_name('Éric O’Neil-Smith') d").first() == ("12", 12, 1, "eric o neil smith")


def test_names(spark):
    split = lambda x: tuple(one(spark, p) for p in N.split_name(F.lit(x)))
    assert split("Darren Anthony SWEETNAM") == ("Darren Anthony", "SWEETNAM")
    assert split("DUPONT Antoine") == ("Antoine", "DUPONT")
    assert split("DUPONT") == ("", "DUPONT") and split("Loïc CREDOZ") == ("Loïc", "CREDOZ")
    assert one(spark, N.full_name(F.lit("JEAN-BAPTISTE"), F.lit("DUPONT"))) == "Jean-Baptiste Dupont"
    assert one(spark, N.norm(F.lit("Leicester Fainga'anuku"))) == "leicester fainga anuku"
    assert one(spark, N.norm_tight(F.lit("Leicester Fainga'anuku"))) == "leicester faingaanuku"
    text = "ÀÉÎõüçñŠžŁøßœ Ặ"
    assert one(spark, N.strip_accents(F.lit(text))) == one(spark, N.nfkd_accents(F.lit(text)))


def test_bridge_tiers(spark):
    players = spark.createDataFrame(
        [(1, 1, "Julián Montoya"), (2, 2, "Michael Alaalatoa"), (3, 3, "Jiuta Naqoli Wainiqolo"), (4, 4, "Sam Smith"), (5, 5, "Sam Smïth"), (6, 6, "Tom A Jones"), (7, 7, "Tom B Jones"), (8, 8, "Rex Solo"), (9, 9, "Al Twin"), (10, 10, "Bo Twin"), (11, 11, "Mono"), (12, 12, "Sam Smith")],
        "ord long, player_id long, full_name string",
    )
    asked = ["Sam Smith", "Julian Montoya", "sam smith", "Michael Ala'alatoa", "Jiuta Wainiqolo", "Tom C Jones", "Xx Solo", "Xx Twin", "No Body", "Solo", None]
    callups = spark.createDataFrame([(x, "w1", "s", "c") for x in asked], "player_name string, int_window_id string, season string, competition string")
    got = {r["player_name"]: (r["player_id"], r["match_method"], r["candidate_player_ids"]) for r in B.build(callups, players, "ord").collect()}
    assert got == {
        "Sam Smith": (12, "exact", ""),
        "Julian Montoya": (1, "normalized", ""),
        "sam smith": (None, "ambiguous", "4;5;12"),
        "Michael Ala'alatoa": (2, "normalized", ""),
        "Jiuta Wainiqolo": (3, "normalized_extended", ""),
        "Tom C Jones": (None, "unmatched", "6;7"),
        "Xx Solo": (None, "unmatched", "8"),
        "Xx Twin": (None, "unmatched", "9;10"),
        "No Body": (None, "unmatched", ""),
        "Solo": (None, "unmatched", "8"),
    }
    bridge = B.build(callups, players, "ord").cache()
    queue = spark.createDataFrame([("Xx Solo", 8, " Y "), ("Xx Twin", 9, "n"), ("Xx Twin", 10, None)], "player_name string, candidate_player_id long, decision string")
    once = B.apply_decisions(bridge, queue)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, B.apply_decisions(once, queue).collect()))
    manual = {"No Body": 77}
    a, b = B.apply_manual(B.apply_decisions(bridge, queue), manual), B.apply_decisions(B.apply_manual(bridge, manual), queue)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for bad in ([("Xx Solo", 8, "x")], [("Xx Twin", 9, "y"), ("Xx Twin", 10, "y")], [("Gone", 1, "y")]):
        with pytest.raises(ValueError):
            B.apply_decisions(bridge, spark.createDataFrame(bad, queue.schema))
    with pytest.raises(ValueError):
        B.apply_manual(bridge, {"Gone": 1})


def test_calendar_and_congestion(spark):
    matches = spark.createDataFrame([(i, "2023-2024", i, "A ", "B", "V") for i in range(1, 8)] + [(20, "2022-2023", 5, "A", "C", "V")], "match_id long, season string, round int, home_team string, away_team string, venue string")
    days = {1: "2023-12-25", 2: "2024-01-18", 3: "2024-01-17", 4: "2024-03-30", 5: "2024-03-31", 6: "bad", 7: None, 20: "2022-10-09"}
    stats = spark.createDataFrame(list(days.items()), "match_id long, match_date string")
    windows = spark.createDataFrame([("2023-2024", "6 Nations", "2024-02-01", "2024-03-23"), ("2023-2024", "World cup", "2023-09-08", "2023-10-28"), ("2023-2024", "Pacific Cup", None, "2024-12-31"), ("2023-2024", "Other", "2023-01-01", "2024-12-31"), ("2022-2023", "World cup", "2022-10-01", "2022-10-02")], "season string, competition string, start_date string, end_date string")
    cal = {(r["season"], r["round"]): r for r in X.international_calendar(matches, stats, windows).collect()}
    assert [cal["2023-2024", i]["6nations"] for i in range(1, 8)] == [0, 1, 0, 1, 0, 0, 0]
    assert [cal["2023-2024", i]["world_cup"] for i in range(1, 8)] == [1, 1, 1, 0, 0, 0, 0]
    assert cal["2022-2023", 5]["world_cup"] == 1 and all(r["pacific_cup"] == 0 for r in cal.values()) and len(cal) == 8
    dates = spark.createDataFrame([("2023-2024", "23_24_R1", "2024-01-11"), ("2023-2024", "23_24_R2", "nope"), ("2022-2023", "22_23_R1", "2023-12-25")], "season string, id string, date string")
    teams = spark.createDataFrame([(" A", 1, 1, 1), ("B", 0, None, 0)], ["team_name", "23_24-R1", "23_24_R2", "22_23_R1"])
    con = {r["match_id"]: (r["home_euro_congestion"], r["away_euro_congestion"]) for r in X.european_congestion(matches, stats, dates, teams).collect()}
    assert con[2] == (1, 0) and con[3] == (1, 0) and con[1] == (0, 0) and con[6] == (0, 0) and len(con) == 8


def test_absence(spark):
    m = [(100 + i, "2022-2023", i, "A", "B") for i in (1, 2, 3)] + [(200 + i, "2023-2024", i, "A", "B") for i in (1, 2, 3)]
    matches = spark.createDataFrame(m, "match_id long, season string, round int, home_team string, away_team string")
    mins = [(101, 1, "A", 80), (102, 1, "A", 40), (201, 1, "A", 60), (201, 2, "B", 50), (202, 3, "A", None), (103, 4, "C", 10), (201, 5, "B", None), (202, 5, "B", 30)]
    minutes = spark.createDataFrame(mins, "match_id long, player_id long, team string, minutes_played int")
    cal = spark.createDataFrame([("2023-2024", 2, 0, 0, 1, 0, 0), ("2023-2024", 3, 0, 0, 1, 0, 0)], ["season", "round", *X.FLAGS.values()])
    callups = spark.createDataFrame([(n, "w", "2023-2024", "6 Nations") for n in ("P1", "P2", "P3", "P4", "P5", "Px")], "player_name string, int_window_id string, season string, competition string")
    bridge = spark.createDataFrame([(f"P{i}", i) for i in range(1, 6)] + [("Px", None)], "player_name string, player_id long")
    got = {(r["match_id"], r["player_id"]): (r["side"], round(r["weight"], 6), r["path"]) for r in X.absences(matches, minutes, cal, callups, bridge).collect()}
    assert got[202, 1] == ("home", round((60 + 5 * 60) / 6 / 80, 6), "shrinkage")
    assert got[202, 2] == ("away", round(50 / 80, 6), "fallback_current")
    assert (202, 3) not in got and got[203, 3] == ("home", 0.0, "fallback_zero")  # presence with unknown minutes
    assert (202, 5) not in got and got[203, 5][1] == round(30 / 80, 6)
    assert not any(k[1] == 4 for k in got)  # neither side
    lost = {(r["match_id"], r["player_id"]): r["weight"] for r in X.absences(matches, minutes, cal, callups, bridge, "propagate").collect()}
    assert lost[203, 5] != lost[203, 5]
    coeff = {r["match_id"]: r["home_absence_coefficient"] for r in X.absence_coefficients(matches, minutes, cal, callups, bridge).collect()}
    assert len(coeff) == 6 and coeff[101] == 0.0 and coeff[202] == pytest.approx(0.75 / 15)


def test_quality(spark):
    stats = spark.createDataFrame([(1, "s", 1, 5, 5, 1, 1), (2, "s", 1, 0, 0, 1, 1), (3, "s", 1, None, 0, 1, 1), (4, "s", 1, 0, 1, 1, 1), (5, "s", 1, None, None, None, 1), (6, "s", 1, None, None, 1, 1)], "match_id long, season string, round int, home_passes int, away_passes int, a int, b int")
    kept, log = Q.drop_bad_rows(stats)
    assert sorted(r["match_id"] for r in kept.collect()) == [1, 3, 4, 6]
    assert {(r["match_id"], r["reason"]) for r in log.collect()} == {(2, "all_zero_stats"), (5, "missing_data")}
    p = spark.createDataFrame([(1, "https://a/joueur/7-x", "X", "T"), (2, "https://b/joueur/7-x", "X", "T"), (3, "https://a/joueur/8-y", "Y", None), (4, "https://b/joueur/8-y", "Y", "U"), (5, "none", "Z", None), (6, "https://a/joueur/9-z", None, None), (7, "https://b/joueur/9-z", None, None)], "ord int, player_url string, full_name string, team string")
    players, clash = Q.dedup_players(p, "ord")
    assert sorted(r["ord"] for r in players.collect()) == [1, 3, 4, 5, 6] and sorted(r["ord"] for r in clash.collect()) == [3, 4]


def test_retry_and_failures(spark):
    main = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (4, "old")], "match_id long, v string")
    inc = spark.createDataFrame([(1, I.OPEN), (2, I.OPEN), (3, I.DEAD), (4, I.OPEN)], "match_id long, status string")
    results = spark.createDataFrame([(1, "new"), (2, "half")], "match_id long, v string")
    still = spark.createDataFrame([(2, I.DEAD)], "match_id long, status string")
    new_main, new_inc = I.retry_pass(main, inc, results, still)
    assert dict(map(tuple, new_main.collect())) == {1: "new", 2: "old", 3: "old", 4: "old"}
    assert dict(map(tuple, new_inc.collect())) == {2: I.DEAD, 3: I.DEAD, 4: I.OPEN}
    calls = []

    def attempt(ids):
        calls.append(sorted(r["match_id"] for r in ids.collect()))
        return results, still

    I.retry_until_done(main, inc, attempt, save=lambda df, _: spark.createDataFrame(df.collect(), df.schema))
    assert calls == [[1, 2, 4], [4], [4]]
    known = spark.createDataFrame([(1, 2), (2, 1)], "player_id long, fail_count int")
    tried = spark.createDataFrame([(1, False), (2, True), (3, False)], "player_id long, ok boolean")
    assert {tuple(r) for r in I.bump_failures(known, tried).collect()} == {(1, 3, "manual_review_needed"), (3, 1, "timeout")}
    legacy = I.backfill(spark.createDataFrame([(9922,), (5,)], "match_id long"), spark.createDataFrame([(5, "s", 1)], "match_id long, season string, round int"))
    assert {(r["match_id"], r["status"], r["season"]) for r in legacy.collect()} == {(9922, I.DEAD, None), (5, I.OPEN, "s")}


STATS = """<div class="match-statistics__cards"><div class="match-statistics__cards-team"><div class="stats-cards-fault stats-cards-fault--yellow">
<div class="stats-cards-fault__container"><div class="stats-cards-fault__card">2</div></div></div></div><div class="match-statistics__cards-team"></div></div>
<div class="stats-bar"><div class="stats-bar__title">Essais accordés (x)</div><div class="stats-bar__val stats-bar__val--left"> 3 </div><div class="stats-bar__val stats-bar__val--right">-</div></div>
<div class="stats-bar"><div class="stats-bar__title">Occupation</div><div class="stats-bar__val stats-bar__val--left">56.7%</div><div class="stats-bar__val stats-bar__val--right">43 %</div></div>
<div class="match-statistics__roster-players"><div class="switcher-buttons__container"><button class="switcher-buttons__button--home">A</button><button class="switcher-buttons__button--away">B</button></div>
<div class="match-statistics__roster"><a class="player-cell__name" href="/joueur/1-x">X</a><a class="player-cell__name" href="/joueur/2-y">Y</a><a class="player-cell__name" href="/joueur/1-x">X</a>
<div class="player-row player-row--heading"><div class="player-row__cell--tempsJeu">Min</div></div>
<div class="player-row"><div class="player-row__cell--tempsJeu">80'</div><div class="player-row__cell--lineBreak">2</div></div><div class="player-row"><div class="player-row__cell--tempsJeu">-</div><div class="player-row__cell--lineBreak">1</div></div><div class="player-row"><div class="player-row__cell--tempsJeu">80</div></div></div>
<div class="match-statistics__roster"><a class="player-cell__name" href="/joueur/3-z">Z</a><div class="player-row"><div class="player-row__cell--tempsJeu">0</div></div></div></div>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, STATS), (2, None)], "match_id long, html string")
    assert {tuple(r) for r in H.player_minutes(pages).collect()} == {(1, 1, "A", 80), (1, 2, "A", None), (1, 3, "B", None)}
    assert {tuple(r) for r in H.cards(pages, ["match_id"]).collect()} == {(1, 2, 0, 0, 0), (2, 0, 0, 0, 0)}
    assert {tuple(r) for r in H.stat_bars(pages, {"tries": "Essais accordés", "kicks": "No"}, ["match_id"]).where("match_id = 1").collect()} == {(1, "tries", 3, None), (1, "kicks", None, None)}
    assert {tuple(r)[1:] for r in H.stat_bars(pages, {"territory": "Occupation"}, ["match_id"], percent=True).where("match_id = 1").collect()} == {("territory", 56, 43)}
    assert H.roster_stats(pages, ["match_id"]).where("match_id = 1").first()["home_line_breaks"] == 3
    info = spark.createDataFrame([(1, "2023-2024", 20, 25), (2, "2023-2024", None, None)], "match_id long, season string, home_score int, away_score int")
    rows = {r["match_id"]: r for r in H.match_rows(pages, info).collect()}
    assert rows[1]["home_tries"] == 3 and rows[1]["home_territory"] == 56 and rows[1]["home_yellow_cards"] == 2 and rows[2]["away_offloads"] == 0
    rnd = '<div class="match-line"><a class="club-line__name"> A </a><a class="club-line__name">B</a><a class="match-line__score" href="https://x/j3/77-a-b"></a></div><a class="match-line__score" href="/j3/78-c"></a>'
    got = H.round_matches(spark.createDataFrame([("s", 3, rnd)], "season string, round int, html string")).collect()
    assert [(r["match_id"], r["home_team"], r["away_team"]) for r in got] == [("77", "A", "B")]
    squad = '<table class="wikitable x"><tr><th>Player<th>Position<th>Date of birth (age)</tr><tr><td><a>Al B</a> (c)</td><td>P</td></tr><tr><td>Head coach: C</td><td>x</td></tr><tr><td>Di E*</td><td>x</td></tr></table>'
    line = '<table><tr><td style="width: 50%"><table><tr><td>FB</td><td>15</td><td><a>Fo G</a></td></tr><tr><td></td><td></td><td>Coach: H</td></tr></table></td></tr></table>'
    w = spark.createDataFrame([("6 Nations", squad), ("Pacific Cup", line), ("End of Year Internationals", line)], "competition string, html string")
    assert {tuple(r) for r in H.squad_players(w, ["competition"]).collect()} == {("6 Nations", "Al B"), ("6 Nations", "Di E"), ("Pacific Cup", "Fo G"), ("End of Year Internationals", "Fo G")}
    cell = lambda *x: "".join(f'<div class="history-season-cell__content">{v}</div>' for v in x)
    left = "".join(f'<div class="history-season-line history-season-line--season-line">{cell(s)}</div>' for s in ("2023-2024", "2022-2023"))
    right = '<div class="history-season-line history-season-line--header-line"></div>' + "".join(f'<div class="history-season-line">{cell(*r)}</div>' for r in (("Top 14", "A", 3, 200), ("Top 14", "B", 4, 100), ("TOP 14", "C", 2, 150), ("Pro D2", "D", 9, 900)))
    prof = f'<h1 class="player-heading__name"> Loïc CREDOZ </h1><img class="player-infos__attribute-flag" alt=" France "><div class="history-season-list"><div class="history-season-list__season-column">{left}</div><div class="history-season-list__other-columns">{right}</div></div>'
    pp = spark.createDataFrame([("u1", prof), ("u2", '<meta property="og:title" content="Darren SWEETNAM | Club">')], "player_url string, html string")
    best = H.best_season(H.career_rows(pp, ["player_url"]), ["player_url"], X.SEASONS).first()
    assert (best["2023-2024_team"], best["2023-2024_avg_min"], best["2022-2023_team"]) == ("A", 66.7, "C")
    assert {(r["full_name"], r["nationality"]) for r in H.person(pp, ["player_url"]).collect()} == {("Loïc Credoz", "France"), ("Darren Sweetnam", "")}
    urls = H.player_urls(spark.createDataFrame([(1, '<a href="/joueur/1-a"></a><a href="/joueur/1-a"></a><a href="/x"></a>')], "k int, html string"), ["k"], "https://b").collect()
    assert [r["url"] for r in urls] == ["https://b/joueur/1-a"]


def test_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load("reference", "none") is None
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    store.save(df, "x.txt", "reference")
    assert store.load("reference", "x").collect()[0]["b"] == "é"
    store.save(store.load("reference", "x").withColumn("a", F.lit(5)), "x", "reference")  # over what it reads
    assert store.load("reference", "x").first()["a"] == 5
    assert [p.rsplit("/", 1)[1] for p in store.save_all({"k1": df, "k2": df}, "y")] == ["y_k1.csv", "y_k2.csv"]
    (tmp_path / "q.csv").write_bytes("﻿player_name ; decision\nA; Y \n".encode())
    q = read_spreadsheet(spark, str(tmp_path / "q.csv"))
    assert q.columns == ["player_name", "decision"] and q.first()["decision"] == "y"


def test_weather_and_web(spark, tmp_path):
    body = '{"hourly":{"time":["2024-01-01T20:00","2024-01-01T21:00"],"temperature_2m":[1,2],"relativehumidity_2m":[1,90],"precipitation":[0,0.5],"rain":[0,0.4],"windspeed_10m":[3,4],"cloudcover":[5,6],"is_day":[0,0]}}'
    matches = spark.createDataFrame([(1, " V "), (2, "V"), (3, "W")], "match_id long, venue string")
    stats = spark.createDataFrame([(1, "2024-01-01", "21:05"), (2, "2024-01-01", "22:05"), (3, "2024-01-01", "21:05")], "match_id long, match_date string, match_time string")
    venues = spark.createDataFrame([("V", 1.0, 2.0)], "stadium_name string, latitude double, longitude double")
    got = X.weather(matches, stats, venues, spark.createDataFrame([(i, body) for i in (1, 2, 3)], "match_id long, body string")).collect()
    assert [(r["match_id"], r["temperature"], r["humidity"], r["rain"]) for r in got] == [(1, 2.0, 90.0, 0.4)]
    page = tmp_path / "p.html"
    page.write_text("<p>hi")
    web.register(spark)
    rows = spark.read.format("touchline_web").option("urls", f"file://{page}\nfile:///no/such").option("delay", "0").load().collect()
    assert {(r["body"], r["error"] is None) for r in rows} == {("<p>hi", True), (None, False)}


def test_form_elo(spark):
    r = spark.createDataFrame([("s", i, dt.date(2024, 1, i), "A", "B", 10 * i, 20) for i in (1, 2, 3)], "season string, match_id long, day date, home_team string, away_team string, home_score int, away_score int")
    e = {x["match_id"]: x for x in X.elo(r).collect()}
    assert e[1]["home_elo"] == 1500 and e[2]["home_elo"] == 1490 and e[2]["away_elo"] == 1510
    f = X.form_and_rest(r.select(F.col("home_team").alias("team"), "season", "match_id", "day", F.col("home_score").alias("points"))).orderBy("match_id").collect()
    assert [x["form"] for x in f] == [None, 10, 15] and [x["rest_days"] for x in f] == [None, 1, 1]


@pytest.mark.parametrize("carry", [False, True])
def test_elo_waves_equal_the_fold(spark, carry):
    import random

    rnd = random.Random(6)
    teams = ["A", "B", "C", "D", "E", None]
    rows = []
    for s, season in enumerate(("s1", "s2")):
        for i in range(9):
            home, away = rnd.sample(teams, 2)
            day = None if i == 4 else dt.date(2024 + s, 1, 1 + i // 3)
            rows.append((season, 100 * s + i, day, home, away, rnd.choice((10, 20, None)), rnd.choice((10, 20))))
    rating, want = {}, {}
    for season, match, _, h, a, x, y in sorted(rows, key=lambda r: (r[2] is None, r[2] or dt.date.min, r[1])):
        of = "all" if carry else season
        p, q = rating.get((of, h), 1500.0), rating.get((of, a), 1500.0)
        want[match] = (p, q)
        if x is not None:
            gain = 20.0 * (0.5 + 0.5 * ((x > y) - (x < y)) - 1 / (1 + 10 ** ((q - p) / 400)))
            rating[of, h], rating[of, a] = p + gain, q - gain
    df = spark.createDataFrame(rows, "season string, match_id long, day date, home_team string, away_team string, home_score int, away_score int")
    got = X.elo(df, carry=carry).collect()
    assert len(got) == len(rows) and all(math.isclose(r["home_elo"], want[r["match_id"]][0]) and math.isclose(r["away_elo"], want[r["match_id"]][1]) for r in got)
    assert max(r["wave"] for r in got) < len(rows)  # matches of a wave are rated together
    assert X.elo(df.limit(0)).count() == 0


def test_weather_broadcasts_no_responses(spark):
    """Answers are long texts made from short rows: by the size of their files they would be broadcast."""
    from touchline.plans.registry import QUERIES

    df = QUERIES["weather_at_kickoff"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len([j for j in joins if "strategy=merge" in j]) == 2 and len(joins) == 3, plan  # the third meets the counted venues
