"""Tables at the edge: CSV in and out, layers, schemas."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, made: str, path: str, replace: bool) -> None:
    """Move a file to its place in one step.  With ``replace`` what is there goes in that step, so there is always
    the old or the new one; without, FileExistsError if something is there."""
    fs, at = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_fs(spark, made)[1], at, options)
    except Exception as e:
        if not replace and fs.exists(at):
            raise FileExistsError(path) from e
        raise


def create_only(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there in full or not at all, and is never replaced (FileExistsError)."""
    folder, name = path.rsplit("/", 1)
    made = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs, at = _fs(spark, made)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        move(spark, made, path, replace=False)
    finally:
        fs.delete(at, False)


def csv_name(name: str) -> str:
    """The name with ``.csv`` in the place of any other ending."""
    return f"{PurePosixPath(name).stem}.csv"


class Store:
    """Tables under a root, in layers (folders), as CSV at the edge and Parquet inside."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{layer}/{name}"

    def load(self, layer: str, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """A CSV with header; None if it isn't there.  With a schema nothing is inferred."""
        path = self.path(layer, csv_name(name))
        if not exists(self.spark, path):
            return None
        reader = self.spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", "")
        df = reader.csv(path, schema=schema, enforceSchema=False) if schema else reader.csv(path, inferSchema=True)
        return strip_headers(df)

    def save(self, df: DataFrame, name: str, layer: str = "processed") -> str:
        """One CSV with header.  Written beside its place and moved over the old one in one step, so a table
        may replace the one it was read from, and whatever fails leaves the old or the new one."""
        path, made = self.path(layer, csv_name(name)), self.path(layer, f"_{uuid.uuid4().hex}")
        df.coalesce(1).write.option("header", True).csv(made)
        fs, at = _fs(self.spark, path)
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        part = next(s.getPath() for s in fs.listStatus(make(made)) if s.getPath().getName().startswith("part-"))
        move(self.spark, part.toString(), path, replace=True)
        fs.delete(make(made), True)
        return path

    def save_all(self, frames: dict[str, DataFrame], name: str, layer: str = "processed") -> str | list[str]:
        """S3: one file for each key, ``<stem>_<key>.csv``; a single frame keeps the plain name."""
        stem = PurePosixPath(name).stem
        if len(frames) == 1:
            return self.save(next(iter(frames.values())), stem, layer)
        return [self.save(df, f"{stem}_{key}", layer) for key, df in frames.items()]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """An immutable Parquet version of a step's result, read back."""
        path = self.path("stages", f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def strip_headers(df: DataFrame) -> DataFrame:
    """Column names without blanks and without a byte-order mark."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that a spreadsheet may have saved: byte-order mark, ``;`` if it is strictly more
    common than ``,`` in the header, padded names; ``decision`` trimmed and in lower case."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    df = strip_headers(spark.read.option("header", True).option("sep", sep).csv(path))
    return df.withColumn("decision", F.lower(F.trim("decision"))) if "decision" in df.columns else df
