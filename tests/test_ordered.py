"""Running totals over hot keys and windows of any length, against windows and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import ordered as O
from touchline.operators import relational as R


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_running_before_equals_the_window(spark, pieces):
    rnd = random.Random(pieces)
    data = [(rnd.choice(("hot", "hot", "hot", "a", "b")), rnd.randint(0, 60), rnd.choice((1, 2, None, 5))) for _ in range(800)] + [("only nulls", 1, None), ("only nulls", 2, None)]
    df = spark.createDataFrame(data, "k string, o int, v long")
    want = R.before_in_order(df.withColumn("v", F.col("v").cast("double")), ["k"], "o", "v")
    assert rows_of(O.running_before(df.withColumn("v", F.col("v").cast("double")), ["k"], "o", "v", pieces).select(want.columns)) == rows_of(want)


def test_running_before_edges(spark):
    schema = "k string, o timestamp, v long, sum_in long"
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(None, t(1), 1, 0), (None, t(2), 2, 0), ("x", None, 4, 0), ("x", t(1), 8, 0), ("x", t(1), 8, 0), ("x", t(3), None, 0)], schema)
    got = {(r["k"], r["o"], r["sum_before"], r["n_before"]) for r in O.running_before(df, ["k"], "o", "v", 4).collect()}
    assert got == {(None, t(1), 0, 0), (None, t(2), 1, 1), ("x", None, 0, 0), ("x", t(1), 4, 1), ("x", t(3), 20, 3)}
    assert O.running_before(df.limit(0), ["k"], "o", "v").count() == 0


def test_a_hot_key_is_spread(spark):
    """One key with all rows: no piece holds more than a few times its share, and the totals are right."""
    n = 40000
    points = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).cast("long").alias("s"))
    out = O.prefix_sums(points, ["k"], "o", ["s"], 16)
    assert out.where("s_before <> o").count() == 0 and out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert sum("_piece" in line.split("], [")[1] for line in windows if "], [" in line) >= 1  # rows are summed inside pieces
    folder = next(f for f in out.inputFiles()).rsplit("/", 1)[0]
    sizes = [r["n"] for r in spark.read.parquet(folder).groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * n / 16


def test_running_lookup(spark):
    rnd = random.Random(1)
    history = spark.createDataFrame([(rnd.randint(0, 3), rnd.randint(0, 30), float(rnd.randint(1, 9))) for _ in range(400)], "k int, o int, v double")
    asked = spark.createDataFrame([(k, o, "x") for k in range(5) for o in (0, 7, 15, 31)], "k int, o int, tag string")
    want = R.before_lookup(asked, history, ["k"], "o", "v")
    assert rows_of(O.running_lookup(asked, history, ["k"], "o", "v", 5).select(want.columns)) == rows_of(want)


# -- windows ---------------------------------------------------------------------------------------
def test_dyadic_nodes(spark):
    cases = [(lo, hi, levels) for lo in range(-9, 9) for hi in range(lo - 1, lo + 19) for levels in (0, 2, 4)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "lo int, hi int").distinct()
    for levels in (0, 2, 4):
        for r in df.select("lo", "hi", R.dyadic_nodes(F.col("lo"), F.col("hi"), levels).alias("nodes")).collect():
            days = sorted(d for n in r["nodes"] for d in range(n["at"] << n["level"], (n["at"] + 1) << n["level"]))
            assert days == list(range(r["lo"], r["hi"] + 1)), r
            assert len(r["nodes"]) <= 2 * levels + (r["hi"] - r["lo"] + 1) // (1 << levels)


def test_windows_of_any_length(spark):
    rnd = random.Random(4)
    day = lambda n: dt.date(1970, 1, 1) + dt.timedelta(days=n)
    windows = [("a", day(-30000), day(20000)), ("b", day(10), day(10)), ("b", day(40), day(20)), ("c", None, day(5)), (None, day(0), day(9))]
    windows += [(rnd.choice("de"), day(s := rnd.randint(-9000, 9000)), day(s + rnd.choice((0, 1, 6, 365, 3650)))) for _ in range(30)]
    rows = [(rnd.choice(("a", "b", "c", "d", "e", None)), day(rnd.randint(-40000, 21000))) for _ in range(600)] + [("a", None), ("a", day(-30000)), ("a", day(20000)), ("a", day(20001)), ("b", day(10)), ("b", day(9)), ("b", day(30))]
    w = spark.createDataFrame(windows, "k string, lo date, hi date")
    df = spark.createDataFrame(rows, "k string, day date")
    covered = lambda k, d: int(d is not None and any(k == x and k is not None and a and b and a <= d <= b for x, a, b in windows))
    assert rows_of(R.flag_in_window(df, "day", w, ["k"], "lo", "hi", "hit")) == sorted(((k, d, covered(k, d)) for k, d in rows), key=repr)
    assert R.flag_in_window(df, "day", w.limit(0), ["k"], "lo", "hi", "hit").agg(F.sum("hit")).first()[0] == 0
    # a window of a century is a bounded number of rows
    century = spark.createDataFrame([(day(3), day(36527))], T.StructType([T.StructField("lo", T.DateType()), T.StructField("hi", T.DateType())]))
    assert century.select(F.size(R.dyadic_nodes(F.unix_date("lo"), F.unix_date("hi"), 15)).alias("n")).first()["n"] <= 31


@pytest.mark.parametrize("most", [0, 2, 32])
def test_windows_of_keys_with_few_and_many(spark, most):
    rnd = random.Random(8)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    windows = [(k, day(s := rnd.randint(0, 900)), day(s + rnd.choice((0, 3, 40, 200)))) for k, n in (("a", 40), ("b", 3), ("c", 1)) for _ in range(n)] * 2 + [(None, day(0), day(900))]
    rows = [(rnd.choice(("a", "b", "c", "d", None)), day(rnd.randint(-5, 1100)), n) for n in range(400)] + [("a", None, -1)]
    df = spark.createDataFrame(rows, "k string, day date, n int")
    covered = lambda k, d: int(d is not None and any(k == x and a <= d <= b for x, a, b in windows if x))
    got = R.flag_in_window(df, "day", spark.createDataFrame(windows, "k string, lo date, hi date"), ["k"], "lo", "hi", "hit", most=most)
    assert rows_of(got.select("k", "day", "n", "hit")) == sorted(((*r, covered(*r[:2])) for r in rows), key=repr)


def test_rows_meet_few_windows_by_one_join(spark):
    from touchline.plans import durable

    df = durable.long_windows(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and plan.count("Join ") == 1 and "Union" not in plan, plan
