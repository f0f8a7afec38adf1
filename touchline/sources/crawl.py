"""A crawl that can be stopped and goes on (S15, S16, N11, N12): a stream over a table of addresses.

``number_addresses`` stores the addresses with their places.  The source ``touchline_turns`` hands out the places
in turns of ``every`` addresses; its offsets are the next place, so Spark's checkpoint knows how far the crawl is.
A micro-batch reads its addresses (places are sorted, so only their row groups), asks them in tasks of
``per_task``, and writes the answers to a folder of its own.  A turn whose folder is whole isn't asked again when
it is replayed: after a crash at most the pages of the turn that was under way are asked twice.

``crawled`` is the table of answers so far; ``crawl`` runs to the end of the addresses and gives that table, so it
serves as the ``read`` of ``operators.incremental.profile_run`` and ``minutes_run``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from . import web
from .scratch import staged
from .tables import exists

EVERY, PER_TASK = 10, 5
ANSWERS = f"place long, {web.SCHEMA}"


class _Turns(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.total, self.every, self.each = int(options["total"]), int(options.get("every", EVERY)), int(options.get("per_task", PER_TASK))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"next": max(start["next"], min(start["next"] + self.every, self.total))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(a, min(a + self.each, end["next"])) for a in range(start["next"], end["next"], self.each)])

    def commit(self, end: dict) -> None:
        """Nothing to do: what is behind is in Spark's checkpoint, and the answers in their folders."""


class TurnSource(DataSource):
    """Options: total (addresses), every (a turn), per_task.  Rows: the places [first, last) of a task."""

    @classmethod
    def name(cls) -> str:
        return "touchline_turns"

    def schema(self) -> str:
        return "first long, last long"

    def simpleStreamReader(self, schema):
        return _Turns(dict(self.options))


def number_addresses(urls: DataFrame, path: str, column: str = "url", pieces: int = 8) -> DataFrame:
    """Store (place, url) of the distinct addresses, trimmed and not empty, sorted by place; places go by address.

    Addresses that are there keep their places, new ones follow.  Ranges are numbered each for itself and moved by
    what is before them, so no task holds the table."""
    spark = urls.sparkSession
    asked = urls.select(F.trim(column).alias("url")).where("url <> ''").distinct()
    start = 0
    if exists(spark, path):
        held = spark.read.parquet(path)
        asked, start = asked.join(held, "url", "left_anti"), held.agg(F.max("place")).first()[0] + 1 if not held.isEmpty() else 0
    dealt = staged(asked.repartitionByRange(pieces, "url").withColumn("_piece", F.spark_partition_id()), "addresses")
    sizes = dealt.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_piece", F.coalesce(F.sum("n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a piece
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy("url")) - 1
    placed = dealt.withColumn("_in", inside).join(F.broadcast(before), "_piece").select((F.col("_before") + F.col("_in") + start).cast("long").alias("place"), "url")
    placed.repartitionByRange(pieces, "place").sortWithinPartitions("place").write.mode("append").parquet(path)
    return spark.read.schema("place long, url string").parquet(path)


def start_crawl(spark: SparkSession, addresses: str, root: str, checkpoint: str, every: int = EVERY, per_task: int = PER_TASK, delay: float = 1.0, timeout: float = 10, after_turn: Callable[[int], None] = lambda k: None):
    """Start the stream; ``addresses`` is the folder of ``number_addresses``.  ``after_turn`` is called when a
    turn's answers are written."""
    spark.dataSource.register(TurnSource)
    table = spark.read.schema("place long, url string").parquet(addresses)

    def turn(places: DataFrame, k: int) -> None:
        folder = f"{root}/turn={k}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            first, last, n = places.agg(F.min("first"), F.max("last"), F.count(F.lit(1))).first()
            mine = table.where(F.col("place").between(first, last - 1)).withColumn("_task", F.floor((F.col("place") - first) / per_task))
            dealt = mine.repartitionByRange(n, "_task").select("place", "url")
            web.fetch_rows(dealt, delay, timeout).write.mode("overwrite").parquet(folder)
        after_turn(k)

    turns = spark.readStream.format("touchline_turns").options(total=table.count(), every=every, per_task=per_task).load()
    return turns.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).start()


def crawled(spark: SparkSession, root: str) -> DataFrame:
    """(place, url, status, body, error): the answers of all turns that are whole."""
    return spark.read.option("basePath", root).schema(f"{ANSWERS}, turn long").parquet(root).drop("turn")


def crawl(urls: DataFrame, root: str, column: str = "url", **options) -> DataFrame:
    """Ask every address of the table once, going on where an earlier call for the same ``root`` stopped."""
    spark = urls.sparkSession
    number_addresses(urls, f"{root}/addresses", column)
    q = start_crawl(spark, f"{root}/addresses", f"{root}/answers", f"{root}/checkpoint", **options)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return crawled(spark, f"{root}/answers")
