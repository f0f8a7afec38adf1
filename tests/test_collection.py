"""Operators around the collected tables: addresses, pages, requests, resumable runs, ranks and containment."""

import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import fixtures as X
from touchline.operators import incremental as I
from touchline.operators import relational as R
from touchline.sources import web


def test_pages_and_addresses(spark):
    urls = spark.createDataFrame([(1, "https://en.wikipedia.org/x"), (2, "https://x.org/y"), (3, None), (4, "")], "k int, url string")
    assert [r["k"] for r in web.wiki_urls(urls).collect()] == [1]
    pages = spark.createDataFrame([("a", "<p>", True), ("b", "<p>", False), ("c", None, False), ("d", "<p>", None)], "url string, html string, render_complete boolean")
    assert sorted(r["url"] for r in web.rendered(pages, True).collect()) == ["a"]
    assert sorted(r["url"] for r in web.rendered(pages, False).collect()) == ["a", "b", "d"]
    steps = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 11, "late"), ("b", 0, None), ("c", 0, "x")], "url string, step int, html string")
    assert {(r["url"], r["html"]) for r in web.expanded(steps).collect()} == {("a", "one\ntwo"), ("c", "x")}
    first = spark.createDataFrame([("p", "n1"), ("p", "n2")], "page string, name string")
    second = spark.createDataFrame([("p", "m"), ("q", "m1"), ("q", "m2")], "page string, name string")
    assert sorted(tuple(r) for r in web.primary_else_fallback(first, second, ["page"]).collect()) == [("p", "n1"), ("p", "n2"), ("q", "m1"), ("q", "m2")]
    row = spark.range(1).select(S.page_url(F.lit("https://x/m/7//"), "stats").alias("a"), S.before_bar(F.lit(" A Bo | C ")).alias("b"), S.shift_days(F.lit("2024-03-01").cast("date"), -1).cast("string").alias("c")).first()
    assert tuple(row) == ("https://x/m/7/stats", "A Bo", "2024-02-29")


def test_weather_requests_and_answers(spark):
    matches = spark.createDataFrame([(1, 43.5, 1.5, "2024-02-10"), (2, None, 1.5, "2024-02-10"), (3, 1.0, 2.0, "2024-02-11"), (4, 3.0, 2.0, "2024-02-11"), (5, 4.0, 2.0, "2024-02-11"), (6, 5.0, 2.0, "2024-02-11")], "match_id long, latitude double, longitude double, match_date string")
    asked = web.weather_urls(matches, "https://w/v1", ["rain", "is_day"])
    url = {r["match_id"]: r["url"] for r in asked.collect()}
    assert set(url) == {1, 3, 4, 5, 6} and url[1] == "https://w/v1?latitude=43.5&longitude=1.5&start_date=2024-02-10&end_date=2024-02-10&hourly=rain,is_day&timezone=Europe/Paris"
    body = '{"hourly": {"time": []}}'
    fetched = spark.createDataFrame([(url[1], 200, body, None), (url[3], None, None, "timeout"), (url[4], 500, None, "HTTP 500"), (url[5], 200, "no json", None)], "url string, status int, body string, error string")
    assert {tuple(r) for r in web.weather_answers(fetched, asked).collect()} == {(1, body, None), (3, None, "timeout"), (4, None, "http"), (5, None, "no hourly data"), (6, None, "no answer")}


def test_fetch_all_asks_each_address_once(spark):
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write(b"yes")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/a",), (f" {base}/a ",), (f"{base}/b",), (None,), ("",)], "url string")
    got = {(r["url"][len(base) :], r["status"], r["body"], r["error"]) for r in web.fetch_all(urls, delay=0, partitions=2).collect()}
    server.shutdown()
    assert got == {("/a", 200, "yes", None), ("/b", 404, None, "HTTP 404")} and sorted(seen) == ["/a", "/b"]


def test_incomplete_and_gaps(spark):
    cols = ", ".join(f"{c} string" for c in I.CRITICAL)
    full = ["x"] * len(I.CRITICAL)
    stats = spark.createDataFrame([(1, "s", 1, False, *full), (2, "s", 1, None, *full[:-1], None), (3, "s", 2, True, None, *full[1:])], f"match_id long, season string, round int, verified_empty boolean, {cols}")
    got = {r["match_id"]: (r["missing_fields"], r["fields_scraped"], r["status"]) for r in I.incomplete_matches(stats).collect()}
    assert got == {2: (I.CRITICAL[-1], len(full), I.OPEN), 3: (I.CRITICAL[0], len(full), I.DEAD)}
    registry = spark.createDataFrame([(10,), (9,), (9,), (2,)], "player_id long")
    assert [r["player_id"] for r in I.gap_list(registry, spark.createDataFrame([(2,)], "player_id long")).collect()] == [9, 10]
    dated = spark.createDataFrame([(3, "s1", None), (1, "s1", None), (2, "s1", "2024-01-01"), (4, "s2", "2024-01-01")], "match_id long, season string, day string")
    assert [tuple(r) for r in X.missing_dates(dated).collect()] == [("s1", [1, 3])]
    con = spark.createDataFrame([(1, 26, 1, 0), (2, 27, 0, 1), (3, 5, 1, 1)], "match_id long, round int, home_euro_congestion int, away_euro_congestion int")
    assert tuple(X.congestion_report(con).first()) == (2, 2, 1)
    assert tuple(X.congestion_report(con.where("round < 27")).first()) == (2, 1, 0)


def test_profile_runs_resume(spark):
    registry = spark.createDataFrame([(f"https://x/joueur/{i}-a",) for i in range(1, 6)], "player_url string")
    players = spark.createDataFrame([(1, "One")], "player_id long, full_name string")
    failures = spark.createDataFrame([(2, 3, "manual_review_needed"), (3, 2, "timeout")], "player_id long, fail_count int, status string")
    tried = []

    def read(todo):
        ids = sorted(r["player_id"] for r in todo.collect())
        tried.append(ids)
        return spark.createDataFrame([(i, "slow" if i == 3 else None, f"P{i}", "A") for i in ids], "player_id long, reason string, full_name string, `2021-2022_team` string")

    players, failures = I.profile_run(registry, players, failures, read)
    assert {(r["player_id"], r["full_name"], r["2021-2022_team"]) for r in players.collect()} == {(1, "One", None), (4, "P4", "A"), (5, "P5", "A")}
    assert {tuple(r) for r in failures.collect()} == {(2, 3, "manual_review_needed"), (3, 3, "manual_review_needed")}
    players, failures = I.profile_run(registry, players, failures, read)
    assert tried[0] == [3, 4, 5] and tried[-1] == [] and players.count() == 3


def test_minutes_runs_resume(spark):
    matches = spark.createDataFrame([(i,) for i in range(1, 6)], "match_id long")
    schema = "match_id long, player_id long, team string, minutes_played int"
    minutes = spark.createDataFrame([(1, 7, "A", 80)], schema)
    dropped = spark.createDataFrame([(2,)], "match_id long")
    log = spark.createDataFrame([(4, "B", "all_zero_tempsJeu", 9, False)], "match_id long, team string, reason string, n_players_affected long, previously_known boolean")
    source = spark.createDataFrame([(3, 7, "A", 60), (3, 8, "B", 0), (4, 9, "B", 0), (4, 10, "B", None)], schema)
    minutes, log = I.minutes_run(matches, minutes, dropped, log, lambda todo: source.join(todo, "match_id", "left_semi"))
    assert sorted(tuple(r) for r in minutes.collect() if r["minutes_played"]) == [(1, 7, "A", 80), (3, 7, "A", 60)] and minutes.count() == 5
    assert [tuple(r) for r in log.collect()] == [(3, "B", "all_zero_tempsJeu", 1, False), (4, "B", "all_zero_tempsJeu", 2, True), (5, None, "section_missing", 0, False)]


def test_travel(spark):
    matches = spark.createDataFrame([(1, "A", " V1 "), (2, "B", "V1"), (3, "C", "V1")], "match_id long, away_team string, venue string")
    teams = spark.createDataFrame([("A", "V2"), ("B", "V1")], "team_name string, venue string")
    venues = spark.createDataFrame([("V1", 0.0, 0.0), ("V2 ", 0.0, 1.0)], "stadium_name string, latitude double, longitude double")
    got = {r["match_id"]: r["travel_km"] for r in X.travel(matches, teams, venues).collect()}
    assert math.isclose(got[1], 2 * math.pi * 6371.0088 / 360, rel_tol=1e-9) and got[2] == 0.0 and got[3] is None


def test_contains_join_and_ranks(spark):
    texts = ["Alpha", "be", "e", "", None, "zeta", "pha b", "BETA"]
    names = [("Club Alpha Beta", 2), ("alpha", 3), ("Beta", 1), (None, 0), ("be", 9)]
    left = spark.createDataFrame([(x,) for x in texts], "word string")
    right = spark.createDataFrame([(n, o, f"v{o}") for n, o in names], "name string, o int, hit string")
    got = {r["word"]: r["hit"] for r in R.contains_join(left, "word", right, "name", "hit", "o", "none").collect()}
    want = {}
    for x in texts:
        fit = [o for n, o in names if x is not None and n is not None and x.lower() in n.lower()]
        want[x] = f"v{min(fit)}" if fit else "none"
    assert got == want
    df = spark.createDataFrame([(i, [None, 2, 1][i % 3], i % 4) for i in range(40)], "k int, a int, b int")
    out = R.ranked(df, {"_a": (F.col("a"), "asc_nulls_first")}, [F.col("b").desc(), "k"]).collect()
    order = sorted(range(40), key=lambda i: ([0, 2, 1][i % 3], -(i % 4), i))
    assert [r["k"] for r in sorted(out, key=lambda r: r["rank"])] == order and sorted(r["rank"] for r in out) == list(range(1, 41))


def test_windows_of_any_length(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    spans = [("a", 5, 5), ("a", 30, 90), ("b", -40, -3), ("b", 9, 8), ("a", None, 3)]
    windows = spark.createDataFrame([(k, None if lo is None else day(lo), day(hi)) for k, lo, hi in spans], "k string, lo date, hi date")
    rows = spark.createDataFrame([(k, day(n)) for k in "abc" for n in range(-50, 100)] + [("a", None), ("a", day(5))], "k string, day date")
    got = R.flag_in_window(rows, "day", windows, ["k"], "lo", "hi", "in").collect()
    assert len(got) == 452
    for r in got:
        covered = r["day"] is not None and any(k == r["k"] and lo is not None and day(lo) <= r["day"] <= day(hi) for k, lo, hi in spans)
        assert r["in"] == int(covered)
