"""What the operators share: durable stage tables, word and line conventions, components."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


TEXT_ROWS = 1000
_scope = threading.local()
_own: list[str] = []  # this process's folder for sessions that name none, as in tests


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='touchline-')}")
        named = _own[0]
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    made = getattr(_scope, "made", None)
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope():
    """The scratch folders that this thread makes inside the block, as a list for ``release``."""
    outer, _scope.made = getattr(_scope, "made", None), []
    try:
        yield _scope.made
    finally:
        if outer is not None:
            outer += _scope.made
        _scope.made = outer


def release(spark: SparkSession, made: list[str], keep: DataFrame) -> None:
    """Delete scratch folders, but those that ``keep`` reads: for callers whose result is written, as staged
    tables stay until someone says that no plan reads them any more."""
    place = lambda path: path.split("/touchline/")[-1].split("/")[0]
    held = {place(f) for f in keep.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        if place(path) not in held:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    made[:] = [p for p in made if place(p) in held]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and lets the planner see its true size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        done = set()
        for f in df.inputFiles():
            folder = f.rsplit("/", 1)[0]
            if folder not in done and "/touchline/" in folder:
                done.add(folder)
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def box(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``: whatever their names, they can't clash with inner ones."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unbox(columns: list[str], **new: Column) -> list[Column]:
    """The columns of a boxed row, some of them replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose whole texts go to Python: Arrow batches of its session hold at most ``TEXT_ROWS``
    rows from here on, as some texts are very long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def mask_of(keys: DataFrame, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """A bit mask of the long column ``key``: rows (word, mask), for ``in_mask``.

    About 16 bits a key, ``most_bits`` at most, so it never has more than ``most_bits`` / 64 rows and may
    be broadcast; with more keys than that it lets more rows through and loses none."""
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 as int))")).alias("__mask"))
    return words.withColumn("__bits", F.lit(bits).cast("long"))


def in_mask(rows: DataFrame, mask: DataFrame, key: str, outside: bool = False) -> DataFrame:
    """The rows whose ``key`` may be among the mask's keys, without a shuffle of ``rows``; with
    ``outside`` the others, which surely aren't, null keys among them."""
    bits = mask.select(F.max("__bits")).first()[0] or 64
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = F.broadcast(mask.select("__word", "__mask"))
    tagged = rows.withColumns({"__at": at, "__word": F.shiftright(at, 6)}).join(words, "__word", "left")
    hit = F.col(key).isNotNull() & (F.expr("shiftright(coalesce(__mask, 0L), cast(__at & 63 as int)) & 1L") == 1)
    return tagged.where(~hit if outside else hit).select(*rows.columns)


def groups_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def _summary(edges: DataFrame) -> tuple:
    """Count, sums and sum of hashes: alike for equal sets of edges, for others by a chance of 2^-64 at most."""
    wide = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("u", "v")]
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), *wide, hashed).first())


def components(links: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): rows (id, component), component the smallest
    id reachable.  Ids without a link have no row.

    Each round joins every id's smallest neighbour (large star, small star), so the links shrink to
    stars in a logarithmic number of rounds.  Minima aggregate before the shuffle and are stored, so
    the star joins are of two stored sides: small minima are broadcast, and AQE may split a hub's edges.
    """
    spark = links.sparkSession
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-e"
    )
    was = _summary(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-m")
        # large star: every larger neighbour of u goes to u's minimum
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), f"{name}-l")
        # small star: u and its smaller neighbours go to the smallest of them
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-m")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), f"{name}-s")
        now = _summary(after)
        drop_stage(large, edges, low, least)
        edges = after
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
