"""Tables that change together: ``df.write.format("touchline_publish")`` and the transaction around it.

Two phases.  Tasks write files into the transaction's folder and tell the driver their names; when all tasks of a
table are done, its list of files is kept beside them (prepared), and when one failed for good, its files go
(abort).  ``Transaction.commit`` then publishes every prepared table in one manifest, ``manifests/<version>.json``,
created once and never replaced: readers see all of the tables or none.  Until then, and after any failure, the
tables are what the newest manifest says.  Files of attempts that failed or came twice are in no list.

    with Transaction(spark, root) as change:
        change.write(players, "players")
        change.write(minutes, "minutes")
    published(spark, root, "players")

Tables with null rows, no rows (schema kept), any types that Arrow and Parquet share.  Table names are letters,
digits, ``_`` and ``-``.  The store must create a file only if it isn't there (see ``sources.keyed``).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .tables import _fs, create_only


@dataclass
class Written(WriterCommitMessage):
    """A task's file; None where it had no rows."""

    path: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.table = f"{options['root'].rstrip('/')}/changes/{options['change']}", options["table"]

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:/*", "/", path))

    def write(self, batches) -> Written:
        import pyarrow.parquet as pq

        task = TaskContext.get()
        path = f"{self.folder}/{self.table}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"
        store, at = self._at(path)
        out, rows = None, 0
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if out is None:
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = pq.ParquetWriter(at, batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(at)
            raise
        if out is not None:
            out.close()
        return Written(path if rows else None, rows)

    def commit(self, messages) -> None:
        store, at = self._at(f"{self.folder}/{self.table}.json")
        files = [m for m in messages if m is not None]
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as out:
            out.write(json.dumps({"files": sorted(m.path for m in files if m.path), "rows": sum(m.rows for m in files)}).encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, at = self._at(f"{self.folder}/{self.table}")
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class PublishSource(DataSource):
    """Options: root, change (the transaction), table."""

    @classmethod
    def name(cls) -> str:
        return "touchline_publish"

    def schema(self) -> str:
        raise NotImplementedError("write only; read with published()")

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, dict]]:
    """(version, tables by name); version 0 has none."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return 0, {}
    return version, json.loads(spark.read.text(f"{root}/manifests/{version:012d}.json", wholetext=True).first()[0])


def published(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of the newest version, or of a named one."""
    held = manifest(spark, root.rstrip("/"), version)[1]
    if table not in held:
        raise KeyError(f"no table {table}; there are {sorted(held)}")
    schema = T.StructType.fromJson(json.loads(held[table]["schema"]))
    return spark.read.schema(schema).parquet(*held[table]["files"]) if held[table]["files"] else spark.createDataFrame([], schema)


class Transaction:
    """Tables to be published together; leaving the block in order commits, by an exception drops all of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.change = spark, root.rstrip("/"), uuid.uuid4().hex
        self.schemas: dict[str, str] = {}
        spark.dataSource.register(PublishSource)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.commit() if kind is None else self.abort()

    def write(self, df: DataFrame, table: str) -> None:
        """First phase: the table's files are written and listed, and nobody sees them yet."""
        if not re.fullmatch(r"[\w-]+", table, re.ASCII) or table in self.schemas:
            raise ValueError(f"table {table!r}")
        df.write.format("touchline_publish").mode("append").options(root=self.root, change=self.change, table=table).save()
        self.schemas[table] = df.schema.json()

    def commit(self, tries: int = 5) -> int:
        """Second phase: one manifest for all tables written, beside those that stay; its version."""
        new = {}
        for table, schema in self.schemas.items():
            held = json.loads(self.spark.read.text(f"{self.root}/changes/{self.change}/{table}.json", wholetext=True).first()[0])
            new[table] = {**held, "schema": schema}
        for _ in range(tries):
            version, tables = manifest(self.spark, self.root)
            try:
                create_only(self.spark, f"{self.root}/manifests/{version + 1:012d}.json", json.dumps({**tables, **new}))
                return version + 1
            except FileExistsError:  # another change was published meanwhile: its tables stay, ours follow
                continue
        raise FileExistsError(f"{tries} changes were published before this one")

    def abort(self) -> None:
        fs, at = _fs(self.spark, f"{self.root}/changes/{self.change}")
        fs.delete(at, True)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the newest ``keep`` and files that those don't name, of changes that are published or
    dropped; not to be run beside a transaction.  How many folders of changes went."""
    root = root.rstrip("/")
    held = versions(spark, root)
    used = {f.rsplit("/changes/", 1)[1].split("/")[0] for v in held[-keep:] for x in manifest(spark, root, v)[1].values() for f in x["files"]}
    for v in held[:-keep]:
        fs, at = _fs(spark, f"{root}/manifests/{v:012d}.json")
        fs.delete(at, False)
    fs, at = _fs(spark, f"{root}/changes")
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in used] if fs.exists(at) else []
    for p in old:
        fs.delete(p, True)
    return len(old)


def save_all(spark: SparkSession, root: str, frames: dict[str, DataFrame], name: str) -> int:
    """S3: one table for each key, ``<name>_<key>``, a single one as ``name``; all published in one version."""
    with Transaction(spark, root) as change:
        for key, df in frames.items():
            change.write(df, name if len(frames) == 1 else f"{name}_{key}")
    return versions(spark, root.rstrip("/"))[-1]
