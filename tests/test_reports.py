"""Reports in the same pass, checks in the plan, and CSV files that are broken."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import reports as P
from touchline.sources.rescue import load_rescued, numbered_lines


def test_one_job_gives_table_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "k long, v string")
    out, seen = P.observed(df, "r", missing=P.share_of(F.col("v").isNull()), **P.coverage_figures("v", ["a", "z"]), **P.unmatched("v"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("observed", "x")
    out.write.parquet(f"{tmp_path}/t")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen.get == {"rows": 4, "missing": 25.0, "n_a": 2, "n_z": 0, "unmatched": 1}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) - before == 1


def test_checks_end_the_job(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 6, F.col("id")).alias("v"))
    assert P.checked(df, F.col("v") > 200, "too high").count() == 100  # unknown isn't bad
    with pytest.raises(Exception, match='too high: {"k":99'):
        P.checked(df, F.col("v") > 98, "too high", "k").write.parquet(f"{tmp_path}/x")
    assert P.checked_unique(df, ["k"], "twice").count() == 100
    with pytest.raises(Exception, match="twice"):
        P.checked_unique(df.select((F.col("k") % 99).alias("k")), ["k"], "twice").collect()


def test_no_line_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,score\n1,"Ann, B",2.5\n2,Bob\n3,Cy,1.0,more\nx,Dee,1\n\n4,"say ""hi""",\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿score; id ;extra\n7.5;11;z\n8,5;12;z\n;;\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id,name,score\n", encoding="utf-8")
    rows, rejects, drift = load_rescued(spark, str(tmp_path), "id long, name string, score double")
    name = lambda f: f.rsplit("/", 1)[1]
    got = sorted((name(r["_file"]), r["_line"], r["id"], r["name"], r["score"]) for r in rows.collect())
    assert got == [("a.csv", 2, 1, "Ann, B", 2.5), ("a.csv", 7, 4, 'say "hi"', None), ("b.csv", 2, 11, None, 7.5), ("b.csv", 4, None, None, None)]
    bad = sorted((name(r["file"]), r["line"], r["reason"]) for r in rejects.collect())
    assert bad == [("a.csv", 3, "short"), ("a.csv", 4, "long"), ("a.csv", 5, "mistyped"), ("a.csv", 6, "empty"), ("b.csv", 3, "mistyped")]
    assert {(name(r["file"]), r["missing"], r["beyond"]) for r in drift.collect()} == {("a.csv", "", ""), ("b.csv", "name", "extra"), ("c.csv", "", "")}
    assert rejects.where("line = 4").first()["text"] == "3,Cy,1.0,more"


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{i}\n" for i in range(1, 5001)))
    (tmp_path / "other.txt").write_text("1\n2")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = numbered_lines(spark, [str(tmp_path)])
        assert out.where("line <> cast(text as long)").count() == 0 and out.count() == 5002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="one name"):
        load_rescued(spark, str(tmp_path), "id long")
