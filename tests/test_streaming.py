from pyspark.sql import functions as F

from touchline.operators import incremental as I
from touchline.operators import relational as R
from touchline.plans.pipeline import build, match_list
from touchline.sources.tables import Store
from touchline.streaming import incremental as stream


def test_resume_upsert_equals_batch(spark, tmp_path):
    src, root, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    parts = [[(1, "a", 1), (2, "a", 2)], [(2, "b", 3), (3, "b", 4)]]
    schema = "k long, v string, o int"
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
        stream.resume_upsert(spark.readStream.schema(schema).parquet(src), root, ck, ["k"], "o").awaitTermination()
    got = sorted(tuple(r) for r in stream.latest(spark, root).collect())
    want = sorted(tuple(r) for r in R.keep_first(spark.createDataFrame(sum(parts, []), schema), ["k"], F.col("o")).collect())
    assert got == want
    # a batch brings its new rows only; folding changes nothing, now or for the batches after it
    assert spark.read.parquet(f"{root}/v=1").count() == 1
    for k in (7, 8):
        stream.compact(spark, root)
        assert sorted(tuple(r) for r in stream.latest(spark, root).collect()) == want
        want.append((k, "x", k))
        spark.createDataFrame([(k, "x", k), (1, "late", 0)], schema).coalesce(1).write.mode("append").parquet(src)
        stream.resume_upsert(spark.readStream.schema(schema).parquet(src), root, ck, ["k"], "o").awaitTermination()
        assert sorted(tuple(r) for r in stream.latest(spark, root).collect()) == want
    assert not (tmp_path / "out" / "v=0").exists()


def test_failure_state_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, i, i != 2) for i in range(6)] + [(2, 1, True), (2, 2, False), (3, 1, True)]
    df = spark.createDataFrame(rows, "player_id long, at long, failed boolean")
    df.coalesce(1).write.parquet(src)
    q = stream.failure_counts(spark.readStream.schema(df.schema).parquet(src), "player_id", "at", "failed").writeStream.outputMode("update").format("memory").queryName("fails").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["player_id"], r["fail_count"], r["status"]) for r in spark.table("fails").where("fail_count > 0").collect()}
    assert got == {tuple(r) for r in I.fail_counts(df, "player_id", ["at"], "failed").collect()} == {(1, 3, "manual_review_needed"), (3, 1, "timeout")}


def test_windowed_counts(spark, tmp_path):
    import datetime as dt

    src = str(tmp_path / "src")
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 0), "b")], "at timestamp, kind string").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("at timestamp, kind string").parquet(src)
    stream.windowed_counts(s, "at", "kind").writeStream.outputMode("complete").format("memory").queryName("wins").trigger(availableNow=True).start().awaitTermination()
    assert {(r["start"].hour, r["kind"], r["n"]) for r in spark.table("wins").collect()} == {(1, "a", 2), (2, "b", 1)}


def test_pipeline(spark, tmp_path):
    teams = spark.createDataFrame([("Club Alpha", "V1", 1), ("Beta", "V2", 2), ("Beta Alpha", "V9", 3)], "team_name string, venue string, ord int")
    regular = spark.createDataFrame([("1", "2023-2024", 1, "u", "Alpha", "Beta"), ("2", "2023-2024", 2, "u", "Gamma", "Beta")], "match_id string, season string, round int, url string, home_team string, away_team string")
    playoffs = spark.createDataFrame([("9", "2023-2024", 27, "u", "Alpha", "Beta", "V3")], "match_id string, season string, round int, url string, home_team string, away_team string, venue string")
    matches = match_list(regular, teams, playoffs)
    assert [(r["match_id"], r["venue"], r["is_playoff"]) for r in matches.collect()] == [(1, "V1", 0), (2, "Unknown", 0), (9, "V3", 1)]
    stat = "match_id long, match_date string, match_time string, home_passes int, away_passes int, home_possession int"
    t = {
        "matches_list": matches,
        "regular_season_stats": spark.createDataFrame([(1, "2024-02-10", "21:05", 5, 5, 50), (2, "2024-02-17", "21:05", 0, 0, 50)], stat),
        "playoff_stats": spark.createDataFrame([(9, "2024-06-01", "21:05", 7, 7, 50)], stat),
        "players": spark.createDataFrame([(1, "https://x/joueur/1-a", "Al Bo", "FR", "Alpha"), (2, "https://x/joueur/2-c", "Ce Du", "FR", "Beta")], "ord long, player_url string, full_name string, nationality string, `2023-2024_team` string"),
        "venues": spark.createDataFrame([("V1", 1.0, 1.0)], "stadium_name string, latitude double, longitude double"),
        "weather_responses": spark.createDataFrame([(1, '{"hourly":{"time":["2024-02-10T21:00"],"temperature_2m":[7]}}')], "match_id long, body string"),
        "windows": spark.createDataFrame([("2023-2024", "6 Nations", "2024-02-01", "2024-03-16")], "season string, competition string, start_date string, end_date string"),
        "player_callups": spark.createDataFrame([("Al Bo", "w", "2023-2024", "6 Nations"), ("Zz Du", "w", "2023-2024", "6 Nations")], "player_name string, int_window_id string, season string, competition string"),
        "player_minutes": spark.createDataFrame([(9, 1, "Alpha", 80)], "match_id long, player_id long, team string, minutes_played int"),
        "european_cup_dates": spark.createDataFrame([("2023-2024", "23_24_R1", "2024-02-12")], "season string, id string, date string"),
        "european_cup_teams": spark.createDataFrame([("Alpha", 1)], ["team_name", "23_24_R1"]),
    }
    decisions = spark.createDataFrame([("Zz Du", 2, "y")], "player_name string, candidate_player_id long, decision string")
    reports = {}
    out = build(Store(spark, str(tmp_path)), t, decisions, {}, reports)
    # each table's figures come from the job that stored it
    assert set(reports) == set(out) and all(reports[n]["rows"] == out[n].count() for n in out)
    assert reports["matches_stats_raw"]["n_2023-2024"] == 3 and reports["player_minutes"]["missing_pct"] == 0.0 and reports["callup_name_bridge"]["unmatched"] == 0
    assert {r["match_id"] for r in out["matches_stats_final"].collect()} == {1, 9}
    assert {(r["player_name"], r["player_id"]) for r in out["callup_name_bridge"].collect()} == {("Al Bo", 1), ("Zz Du", 2)}
    assert {(r["match_id"], r["home_euro_congestion"]) for r in out["european_congestion"].collect()} == {(1, 1), (2, 0), (9, 0)}
    away = {r["match_id"]: r["home_absence_coefficient"] for r in out["players_away"].collect()}
    assert set(away) == {1, 2, 9}
    assert {r["temperature"] for r in out["weather"].collect()} == {7.0}


def test_a_match_asks_its_state_few_times():
    """Three attempts of a match in one micro-batch: the state is read once and cleared once."""
    from types import SimpleNamespace

    from touchline.streaming import retries

    calls = []

    class State:
        def __init__(self, name, value=None):
            self.name, self.value = name, value

        def __getattr__(self, call):
            def run(*args):
                calls.append(f"{self.name}.{call}")
                if call == "get":
                    return self.value if self.name == "now" else iter(())
                if call == "exists":
                    return self.value is not None
                if call in ("update", "clear"):
                    self.value = args[0] if args else None
                return iter(()) if call == "listTimers" else None

            return run

    machine = retries.Retries()
    machine.now, machine.past, machine.handle = State("now", (retries.I.OPEN, 0, 0)), State("past"), State("timers")
    rows = [SimpleNamespace(attempt=a, got=False, status=None, at=None) for a in (1, 2, 3)]
    out = list(machine.handleInputRows((7,), iter(rows), None))
    assert [(r.attempt, r.final) for r in out] == [(1, False), (2, False), (3, True)] and out[-1].history.count(";") == 2
    assert calls == ["now.get", "now.clear", "timers.listTimers"]
