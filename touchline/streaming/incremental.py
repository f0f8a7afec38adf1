"""Streams that keep tables up to date: the streaming forms of T1 and T3.

A sink writes each micro-batch's new rows as a folder of its own (``<root>/v=<batch id>``) and the table is
all of them, so a batch writes what it brings; to know what is new it reads the keys of the whole table, which
``sources.keyed.merge_stream`` does not.  A batch that is replayed after a failure writes the same folder again:
exactly once by key, whatever the source does.  ``compact`` folds
folders into one (``<root>/base=<batch id>``); readers take the newest base and the folders after it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import incremental as I
from ..operators import relational as R


def _whole(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The batch ids of the folders of a kind that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(path(f"{root}/{n}/_SUCCESS")))


def latest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The table, or what it was before a batch; None if there was none."""
    known = lambda kind: [v for v in _whole(spark, root, kind) if before is None or v < before]
    base = known("base")[-1:]
    paths = [f"{root}/base={v}" for v in base] + [f"{root}/v={v}" for v in known("v") if not base or v > base[0]]
    return spark.read.parquet(*paths) if paths else None


def compact(spark: SparkSession, root: str) -> None:
    """Fold the table into a base as of its newest batch; the folders that an older base covers go."""
    versions, bases = _whole(spark, root, "v"), _whole(spark, root, "base")
    if not versions or (bases and versions[-1] <= bases[-1]):
        return
    latest(spark, root, before=versions[-1] + 1).write.mode("overwrite").parquet(f"{root}/base={versions[-1]}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [f"v={v}" for v in versions if bases and v <= bases[-1]] + [f"base={v}" for v in bases[:-1]]:
        fs.delete(path(f"{root}/{name}"), True)


def resume_upsert(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str):
    """New keys are appended, known keys are left as they are; of several new rows the first counts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        new = R.keep_first(batch, keys, F.col(order))
        old = latest(batch.sparkSession, root, before=batch_id)
        (new if old is None else R.absent(new, old, keys)).write.mode("overwrite").parquet(f"{root}/v={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_counts(stream: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """T3 with state kept for each key: failures since the last success, in order of ``at`` within a
    micro-batch; a failure at the very time of a success counts as before it.

    A key's rows come batch by batch and are folded so: what is held is the time of the last success
    and the times of the failures after it."""

    def step(k: tuple, batches, state: GroupState):
        carried, last, after = (state.get[0] if state.exists else 0), None, []
        for rows in batches:
            bad = rows[failed].astype(bool)
            good = rows.loc[~bad, at]
            if len(good) and (last is None or good.max() > last):
                last = good.max()
            times = rows.loc[bad, at]
            after = [x[x > last] if last is not None else x for x in (*after, times)]
        count = sum(len(x) for x in after) + (carried if last is None else 0)
        state.update((int(count),))
        yield pd.DataFrame({key: [k[0]], "fail_count": [int(count)], "status": ["manual_review_needed" if count >= I.REVIEW_AT else "timeout" if count else "ok"]})

    return stream.select(key, at, failed).groupBy(key).applyInPandasWithState(step, f"{key} long, fail_count int, status string", "fail_count int", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window with a watermark: late rows within ``late`` still count."""
    w = F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
