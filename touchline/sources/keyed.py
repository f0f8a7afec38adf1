"""A keyed table that merges in place (J22, J23, T1): reads and writes no more than the buckets that a merge meets.

Rows lie in buckets by a hash of their key.  A bucket is a leaf of a binary tree over the hash's low bits: (depth,
bits); when it grows beyond ``rows`` rows, the merge that writes it next writes its halves, so buckets stay of one
size while the table grows, and a merge costs what its keys' buckets hold.

Every merge writes new folders and then one manifest, ``manifests/<version>.json``, which lists each bucket's
folder.  A manifest is created and never replaced; who comes second reads the newer table and merges again.  A
merge that fails leaves folders that no manifest names, for ``vacuum``.  A merge may carry the number of a
micro-batch, which the manifest remembers, so a replayed batch does nothing.

Creating a file only if it isn't there must be atomic in the store: it is in HDFS and on local disks, and in
object stores that support conditional writes.

Keys: nulls are equal to each other.  Of several new rows with one key, the first by ``order`` counts, ties by all
columns.  Extra columns of the new rows are refused, missing ones are null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import _fs, create_only

BUCKET_ROWS = 1_000_000
_INNER = ("_hash", "_leaf", "_new", "_rank")


@dataclass(frozen=True)
class Leaf:
    depth: int
    bits: int
    rows: int = 0
    size: int = 0  # bytes
    path: str | None = None  # None while it holds nothing

    @property
    def name(self) -> str:
        return f"{self.depth}-{self.bits}"


@dataclass(frozen=True)
class Merged:
    """What a merge did: buckets and bytes read, rows read and written, buckets and version after it."""

    version: int
    buckets_read: int
    bytes_read: int
    rows_read: int
    rows_written: int
    buckets: int


class Conflict(Exception):
    """Another merge published the version first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType | str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.keys, self.bucket_rows = spark, root.rstrip("/"), keys, bucket_rows
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        clash = [c for c in self.schema.names if c in _INNER]
        if clash or not set(keys) <= set(self.schema.names):
            raise ValueError(f"names in use: {clash}; keys: {keys}; columns: {self.schema.names}")

    # -- manifests ---------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        fs, at = _fs(self.spark, f"{self.root}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")) if fs.exists(at) else []

    def _manifest(self, version: int | None = None) -> tuple[int, list[Leaf], dict[str, int]]:
        """(version, leaves, last batch of each stream); version 0 has one empty leaf."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, [Leaf(0, 0)], {}
        text = self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return version, [Leaf(**x) for x in held["leaves"]], held["batches"]

    def _publish(self, version: int, leaves: list[Leaf], batches: dict[str, int]) -> None:
        try:
            create_only(self.spark, f"{self.root}/manifests/{version:012d}.json", json.dumps({"leaves": [asdict(x) for x in leaves], "batches": batches}))
        except FileExistsError as e:
            raise Conflict(f"version {version} is there") from e

    # -- reading -----------------------------------------------------------------------------------
    def _read(self, leaves: list[Leaf]) -> DataFrame:
        paths = [x.path for x in leaves if x.path]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table, as of a version if one is named."""
        return self._read(self._manifest(version)[1])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows with the keys of ``wanted``; reads their buckets only."""
        _, leaves, _ = self._manifest()
        met = self._placed(wanted.select(*self.keys), leaves).select("_leaf").distinct().collect()  # buckets, at most all of them
        names = {r[0] for r in met}
        mine = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        held = self._read([x for x in leaves if x.name in names])
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & held[k].eqNullSafe(F.col(f"_k{i}"))
        return held.join(mine, same, "left_semi")

    # -- merging -----------------------------------------------------------------------------------
    def _placed(self, rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
        """``rows`` with the hash of their key and the leaf it lies in."""
        rows = rows.withColumn("_hash", F.xxhash64(*self.keys))
        depths = sorted({x.depth for x in leaves})
        here = lambda d: F.concat(F.lit(f"{d}-"), F.col("_hash").bitwiseAND(F.lit((1 << d) - 1).cast("long")).cast("string"))
        if len(depths) == 1:
            return rows.withColumn("_leaf", here(depths[0]))
        named = self.spark.createDataFrame([(x.name,) for x in leaves], "_leaf string")
        return rows.withColumn("_leaf", F.explode(F.array(*[here(d) for d in depths]))).join(named, "_leaf", "left_semi")

    def merge(self, new: DataFrame, keep: str = "new", order: str | None = None, batch: tuple[str, int] | None = None, tries: int = 5) -> Merged | None:
        """Rows of ``new`` take the place of rows with their key (``keep="new"``, J22), or only go where there is
        none (``keep="old"``, J23, T1).  ``batch``: a stream's name and the number of its micro-batch; one that
        the table has seen changes nothing and gives None."""
        if keep not in ("new", "old"):
            raise ValueError(keep)
        extra = set(new.columns) - set(self.schema.names) - {order}
        if extra:
            raise ValueError(f"columns that the table doesn't have: {sorted(extra)}")
        for _ in range(tries):
            try:
                return self._merge(new, keep, order, batch)
            except Conflict:
                continue
        raise Conflict(f"{tries} merges met newer versions")

    def _merge(self, new: DataFrame, keep: str, order: str | None, batch) -> Merged | None:
        version, leaves, batches = self._manifest()
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return None
        columns = self.schema.names
        full = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        rank = F.col(order).alias("_rank") if order else F.lit(0).alias("_rank")
        placed = self._placed(new.select(*full, rank), leaves)
        counts = {r["_leaf"]: r["n"] for r in placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
        met = [x for x in leaves if x.name in counts]
        old = self._read(met).withColumns({"_rank": F.lit(None).cast(placed.schema["_rank"].dataType), "_new": F.lit(False)})
        both = placed.select(*columns, "_rank").withColumn("_new", F.lit(True)).unionByName(old)
        # what a bucket may hold afterwards says how far it is split; equal keys only make it less
        splits = {x: max(0, (max(1, x.rows + counts[x.name]) - 1) // self.bucket_rows).bit_length() for x in met}
        after = [Leaf(x.depth + splits[x], x.bits | (k << x.depth)) for x in met for k in range(1 << splits[x])]
        first = F.desc("_new") if keep == "new" else F.asc("_new")
        by = Window.partitionBy(*self.keys).orderBy(first, F.asc_nulls_last("_rank"), *columns)
        kept = both.withColumn("_at", F.row_number().over(by)).where("_at = 1").select(*columns)
        folder = f"{self.root}/data/{version + 1:012d}-{uuid.uuid4().hex}"
        if met:
            self._placed(kept, after).drop("_hash").repartition(F.col("_leaf")).write.partitionBy("_leaf").parquet(folder)
        held = {r["_leaf"]: r["n"] for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_leaf", T.StringType())])).parquet(folder).groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()} if met else {}
        fs, at = _fs(self.spark, folder)
        sizes = {s.getPath().getName().split("=")[-1]: fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at) if s.isDirectory()} if met else {}
        after = [Leaf(x.depth, x.bits, held.get(x.name, 0), sizes.get(x.name, 0), f"{folder}/_leaf={x.name}" if x.name in held else None) for x in after]
        gone = {x.name for x in met}
        rest = [x for x in leaves if x.name not in gone]
        self._publish(version + 1, rest + after, {**batches, batch[0]: batch[1]} if batch else batches)
        return Merged(version + 1, len(met), sum(x.size for x in met), sum(x.rows for x in met), sum(held.values()), len(rest) + len(after))

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep`` and the folders that those don't name; how many folders went."""
        versions = self.versions()
        used = {x.path.rsplit("/", 1)[0].rsplit("/", 1)[-1] for v in versions[-keep:] for x in self._manifest(v)[1] if x.path}
        newest = versions[-1] if versions else 0
        for v in versions[:-keep]:
            fs, at = _fs(self.spark, f"{self.root}/manifests/{v:012d}.json")
            fs.delete(at, False)
        fs, at = _fs(self.spark, f"{self.root}/data")
        names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        # a folder of the version after the newest may belong to a merge that is under way
        old = [p for p in names if p.getName() not in used and int(p.getName().split("-")[0]) <= newest]
        for p in old:
            fs.delete(p, True)
        return len(old)


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, keep: str = "old", order: str | None = None):
    """Keep the table up to date from a stream, each micro-batch merged once."""
    return (
        stream.writeStream.foreachBatch(lambda rows, k: table.merge(rows, keep, order, (name, k)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
