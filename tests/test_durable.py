"""Tables and runs that survive failures: the keyed table, the publishing sink, the crawl, retries as a stream."""

import http.server
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQueryException

from touchline.operators import incremental as I
from touchline.operators import relational as R
from touchline.sources import crawl, keyed, publish
from touchline.sources.tables import Store, create_only
from touchline.streaming import retries

SCHEMA = "k long, v string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- keyed table -----------------------------------------------------------------------------------
def test_merge_equals_upsert(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA, bucket_rows=40)
    want = spark.createDataFrame([], SCHEMA)
    assert rows_of(table.read()) == []
    for step, keep in enumerate(["new", "old", "new", "old", "new"]):
        new = spark.range(60).select((F.col("id") * (step + 1) % 97).alias("k"), F.lit(f"s{step}").alias("v"), F.col("id").cast("int").alias("n"))
        if step == 2:
            new = new.union(spark.createDataFrame([(None, "null key", 1), (None, "null key", 1), (None, "null key", 2)], SCHEMA))
        done = table.merge(new, keep, order="n")
        one = R.keep_first(new, ["k"], F.col("n"))
        if keep == "new":
            want = want.join(one, want["k"].eqNullSafe(one["k"]), "left_anti").union(one)
        else:
            want = want.union(one.join(want, want["k"].eqNullSafe(one["k"]), "left_anti"))
        want = spark.createDataFrame(want.collect(), SCHEMA)
        assert rows_of(table.read()) == rows_of(want)
        assert done.version == step + 1
    leaves = table._manifest()[1]
    assert len(leaves) > 2 and sum(x.rows for x in leaves) == want.count() and max(x.rows for x in leaves) <= 60
    assert rows_of(table.lookup(spark.createDataFrame([(3,), (None,), (5000,)], "k long"))) == rows_of(want.where("k = 3 or k is null"))
    # old versions can be read until they are cleared away
    assert table.read(1).count() == 60 and table.vacuum(keep=1) > 0
    assert table.versions() == [5] and rows_of(table.read()) == rows_of(want)


def test_merges_stay_flat_while_the_table_grows(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA, bucket_rows=250)
    made = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 20).alias("v"), F.lit(0).alias("n"))
    few = spark.createDataFrame([(7, "seven", 1), (-1, "new", 1), (1500, "b", 1)], SCHEMA)
    table.merge(made(0, 3000))
    small = table.merge(few)
    table.merge(made(3000, 30000))
    large = table.merge(few)
    assert table.read().count() == 30001 and large.buckets >= 8 * small.buckets
    assert max(small.buckets_read, large.buckets_read) <= 3
    assert large.rows_read <= 3 * 250 and large.bytes_read <= 2 * small.bytes_read


def test_conflicts_and_replays(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA)
    other = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA)
    row = lambda k, v: spark.createDataFrame([(k, v, 0)], SCHEMA)
    plain, raced = table._publish, []

    def late(version, leaves, batches):
        if not raced:
            raced.append(1)
            other.merge(row(1, "other"))
        plain(version, leaves, batches)

    monkeypatch.setattr(table, "_publish", late)
    assert table.merge(row(2, "mine"), batch=("s", 4)).version == 2  # merged again on what the other wrote
    assert rows_of(table.read()) == [(1, "other", 0), (2, "mine", 0)]
    assert table.merge(row(2, "again"), batch=("s", 4)) is None and table.merge(row(3, "x"), batch=("s", 3)) is None
    # a merge that fails before its manifest changes nothing
    monkeypatch.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(row(2, "lost"))
    assert rows_of(other.read()) == [(1, "other", 0), (2, "mine", 0)]
    with pytest.raises(ValueError):
        other.merge(row(1, "x").withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, "x", ["k"], "k long, _leaf string")
    assert other.merge(spark.createDataFrame([], SCHEMA)).rows_written == 0 and other.read().count() == 2


def test_merge_stream(spark, tmp_path):
    src = f"{tmp_path}/src"
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA, bucket_rows=5)
    parts = [[(i, "a", i) for i in range(12)], [(i, "b", i) for i in range(6, 20)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        keyed.merge_stream(spark.readStream.schema(SCHEMA).parquet(src), table, f"{tmp_path}/ck", "s").awaitTermination()
    assert sorted(rows_of(table.read())) == [(i, "a" if i < 12 else "b", i) for i in range(20)]
    assert table._manifest()[2] == {"s": 1}


# -- publishing ------------------------------------------------------------------------------------
def test_tables_are_published_together(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    with publish.Transaction(spark, root) as change:
        change.write(a.repartition(2), "players")
        with pytest.raises(KeyError):
            publish.published(spark, root, "players")
        change.write(a.limit(0), "minutes")
        change.write(a, "teams")
    assert rows_of(publish.published(spark, root, "players")) == rows_of(a)
    assert publish.published(spark, root, "minutes").schema == a.schema and publish.published(spark, root, "minutes").count() == 0
    # a table is replaced from what it holds; the other stays
    with publish.Transaction(spark, root) as change:
        change.write(publish.published(spark, root, "players").where("k = 1"), "players")
    assert rows_of(publish.published(spark, root, "players")) == [(1, "x")] and publish.published(spark, root, "players", 1).count() == 2
    assert publish.vacuum(spark, root, keep=1) == 0 and publish.versions(spark, root) == [2]  # the first change's teams are still named


@pytest.mark.parametrize("where", ["task", "block", "manifest"])
def test_failures_leave_the_old_tables(spark, tmp_path, monkeypatch, where):
    root = f"file://{tmp_path}/p"
    old = spark.createDataFrame([(1, "old")], "k long, v string")
    assert publish.save_all(spark, root, {"a": old, "b": old}, "t") == 1
    new = spark.range(100).select(F.col("id").alias("k"), F.lit("new").alias("v"))
    if where == "task":
        new = new.repartition(4).select("k", F.when(F.col("k") == 50, F.raise_error(F.lit("bad row"))).otherwise(F.col("v")).alias("v"))
    if where == "manifest":
        monkeypatch.setattr(publish, "create_only", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match={"task": "bad row", "block": "later", "manifest": "lost"}[where]):
        with publish.Transaction(spark, root) as change:
            change.write(old.withColumn("v", F.lit("new")), "t_a")
            change.write(new, "t_b")
            if where == "block":
                raise RuntimeError("later")
    assert rows_of(publish.published(spark, root, "t_a")) == rows_of(publish.published(spark, root, "t_b")) == [(1, "old")]
    monkeypatch.undo()
    publish.vacuum(spark, root)
    assert len(list((tmp_path / "p" / "changes").iterdir())) == 1


def test_create_only(spark, tmp_path):
    create_only(spark, f"file://{tmp_path}/x.json", "one")
    with pytest.raises(FileExistsError):
        create_only(spark, f"file://{tmp_path}/x.json", "two")
    assert (tmp_path / "x.json").read_text() == "one" and len([p for p in tmp_path.iterdir() if not p.name.endswith(".crc")]) == 1


def test_save_replaces_in_one_step(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    (tmp_path / "processed").mkdir()
    store.save(spark.createDataFrame([(1, "a")], "k long, v string"), "t")
    store.save(store.load("processed", "t").withColumn("v", F.lit("b")), "t")
    assert rows_of(store.load("processed", "t")) == [(1, "b")]


# -- crawl -----------------------------------------------------------------------------------------
@pytest.fixture
def site():
    asked = Counter()

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            self.send_response(404 if self.path.endswith("7") else 200)
            self.end_headers()
            self.wfile.write(f"page {self.path}".encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_crawl_goes_on_after_a_crash(spark, tmp_path, site):
    base, asked = site
    root = f"file://{tmp_path}/c"
    urls = spark.createDataFrame([(f" {base}/{i} ",) for i in range(23)] + [("",), (None,), (f"{base}/3",)], "url string")
    crawl.number_addresses(urls, f"{root}/addresses")

    def crash(k):
        if k == 1:
            raise RuntimeError("killed")

    q = crawl.start_crawl(spark, f"{root}/addresses", f"{root}/answers", f"{root}/checkpoint", every=5, per_task=2, delay=0, after_turn=crash)
    with pytest.raises(StreamingQueryException):
        q.processAllAvailable()
    assert sum(asked.values()) == 10 and crawl.crawled(spark, f"{root}/answers").count() == 10
    out = crawl.crawl(urls, root, every=5, per_task=2, delay=0)
    assert set(asked.values()) == {1} and len(asked) == 23
    got = out.collect()
    assert sorted(r["place"] for r in got) == list(range(23))
    assert {r["error"] for r in got} == {None, "HTTP 404"} and all(r["body"] == f"page {r['url'][len(base):]}" for r in got if r["status"] == 200)
    # new addresses follow, what was asked isn't asked again
    more = urls.union(spark.createDataFrame([(f"{base}/late",)], "url string"))
    assert crawl.crawl(more, root, every=5, per_task=2, delay=0).count() == 24 and set(asked.values()) == {1}


def test_profiles_by_crawl(spark, tmp_path, site):
    """N11 with the crawl as its reader: what is there isn't read, failures count up."""
    base, asked = site
    registry = spark.createDataFrame([(f"{base}/joueur/{i}-name",) for i in range(5)] + [(f"{base}/joueur/9-x7",)], "player_url string")
    players = spark.createDataFrame([(0, "old")], "player_id long, body string")
    failures = spark.createDataFrame([(4, 3, "manual_review_needed"), (9, 1, "timeout")], "player_id long, fail_count int, status string")

    def read(todo):
        got = crawl.crawl(todo, f"file://{tmp_path}/r", "player_url", delay=0)
        return todo.join(got, F.trim("player_url") == got["url"]).select("player_id", F.col("error").alias("reason"), "body")

    new, failed = I.profile_run(registry, players, failures, read)
    assert sorted(r["player_id"] for r in new.collect()) == [0, 1, 2, 3]
    assert rows_of(failed.where("player_id = 9")) == [(9, 2, "timeout")] and len(asked) == 4


# -- retries ---------------------------------------------------------------------------------------
EVENT = "match_id long, attempt int, got boolean, status string, at timestamp"


def answer(match, attempt):
    """What an attempt gives: it has a result or not, and a status if it is incomplete again."""
    return [(True, None), (False, I.OPEN), (False, I.DEAD), (False, None), (True, I.OPEN)][(match * 7 + attempt * 3) % 5]


@pytest.mark.parametrize("include_dead", [False, True])
def test_retry_stream_equals_passes(spark, tmp_path, include_dead):
    import datetime as dt

    ids = range(1, 25)
    start = [(i, "s", str(i), "f", 1, I.DEAD if i % 6 == 0 else I.OPEN) for i in ids]
    incomplete = spark.createDataFrame(start, "match_id long, season string, round string, missing_fields string, fields_scraped int, status string")
    main, left = spark.createDataFrame([], "match_id long, v int"), incomplete
    src, root, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    for attempt in (1, 2, 3):
        given = {i: answer(i, attempt) for i in ids}
        tried = [r[0] for r in left.where(F.col("status").isin([I.OPEN, I.DEAD] if include_dead else [I.OPEN])).select("match_id").collect()]
        results = spark.createDataFrame([(i, attempt) for i in tried if given[i][0]], "match_id long, v int")
        still = spark.createDataFrame([(i, given[i][1]) for i in tried if given[i][1]], "match_id long, status string")
        main, left = I.retry_pass(main, left, results, still, include_dead)
        left = spark.createDataFrame(left.collect(), incomplete.schema)
        at = dt.datetime(2024, 1, attempt)
        # the stream also sees attempts at matches that need none, and old ones again
        events = [(i, a, *answer(i, a), at) for i in [*ids, 99] for a in {1, attempt}]
        spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(src)
        # each pass is a run of its own that goes on from the checkpoint
        retries.run_retries(spark.readStream.schema(EVENT).parquet(src), incomplete, root, ck, include_dead=include_dead).awaitTermination()
        states = retries.latest_states(spark, root)
        assert rows_of(retries.after_passes(incomplete, states)) == rows_of(left), attempt
    final = {r["match_id"]: r for r in states.collect()}
    assert 99 not in final and all(r["final"] and r["tries"] <= 3 and r["history"].count(";") == r["tries"] - 1 for r in final.values())
    won = {i for i, r in final.items() if r["status"] == retries.DONE}
    assert won == {r["match_id"] for r in main.collect()}


def test_retries_expire(spark, tmp_path):
    import datetime as dt

    src, root, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    incomplete = spark.createDataFrame([(1, I.OPEN), (2, I.OPEN)], "match_id long, status string")
    day = lambda d: dt.datetime(2024, 1, d)
    for part in ([(1, 1, False, None, day(1)), (2, 1, False, None, day(1)), (5, 0, None, I.OPEN, day(1)), (None, None, True, None, None)], [(2, 2, False, None, day(20))], [(1, 2, True, None, day(21)), (5, 1, True, None, day(21))]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        retries.run_retries(spark.readStream.schema(EVENT).parquet(src), incomplete, root, ck, patience_days=3).awaitTermination()
    got = {r["match_id"]: (r["status"], r["tries"], r["final"], r["history"]) for r in retries.latest_states(spark, root).collect()}
    assert got[1] == (retries.EXPIRED, 1, True, f"{I.OPEN};{retries.EXPIRED}")
    assert got[5] == (retries.EXPIRED, 0, True, retries.EXPIRED) and got[2][0] == I.OPEN
