"""CSV files in which lines may be broken and columns may drift, read without losing a line.

Every line of every file is either a row or a reject, with its file and its number in it.  Files may have their
columns in any order, lack some or have others: each header is read for itself, what the schema asks for is taken by
name, what is missing is null, and the names beyond the schema are in the drift table.  A line is rejected when it
has more or fewer fields than its header, or a field that isn't of its type; empty lines are rejected too.  A byte
order mark, blanks around names and ``;`` as the separator (if the header has more of them) are taken as they come.

Lines end at line breaks: a quoted field may hold separators and quotes, but no line break.  Line numbers are
counted inside each file's splits and moved by the lines before them, so a large file is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import staged

REJECT = "file string, line long, text string, reason string"


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text) of text files, lines from 1."""
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text")
    )
    text = staged(text, "lines")  # ids are as they were written
    inside = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_id"))
    sizes = text.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "_split", before.alias("_before"))  # a row a split
    return text.withColumn("_in", inside).join(starts, ["file", "_split"]).select("file", (F.col("_before") + F.col("_in")).cast("long").alias("line"), "text")


def _names(header: str) -> tuple[str, list[str]]:
    """The separator and the names of a header line."""
    header = header.lstrip("﻿")
    sep = ";" if header.count(";") > header.count(",") else ","
    return sep, [n.strip().strip('"').strip() for n in header.rstrip("\r\n").split(sep)]


def load_rescued(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, drift): the schema's columns with ``_file`` and ``_line``; the lines that don't fit, with
    the reason; and for each file the names that it lacks and those that it has beyond the schema."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = staged(numbered_lines(spark, [paths] if isinstance(paths, str) else paths), "numbered")
    heads = lines.where("line = 1").select("file", "text").collect()  # a row a file
    by_header: dict[str, list[str]] = {}
    for r in heads:
        by_header.setdefault(r["text"], []).append(r["file"])
    files = spark.createDataFrame([(f, i) for i, found in enumerate(by_header.values()) for f in found], "file string, _head int")
    body = lines.where("line > 1").join(F.broadcast(files), "file")  # a row a file
    good, bad, drift = [], [spark.createDataFrame([], REJECT)], []
    for i, (header, found) in enumerate(by_header.items()):
        sep, names = _names(header)
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"{found[0]} has columns of one name: {twice}")
        missing, beyond = [f.name for f in want if f.name not in names], [n for n in names if n not in want.names]
        drift += [(f, ",".join(missing), ",".join(beyond)) for f in found]
        kinds = {f.name: f.dataType for f in want}
        typed = T.StructType([T.StructField(f"c{k}", kinds.get(n, T.StringType())) for k, n in enumerate(names)] + [T.StructField("_bad", T.StringType())])
        options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'}
        row = F.from_csv(F.col("text"), typed.simpleString()[len("struct<") : -1].replace(":", " "), options)
        read = body.where(F.col("_head") == i).withColumn("_row", row)
        broken = F.col("_row").isNull() | F.col("_row._bad").isNotNull() | (F.trim("text") == "")
        fields = F.size(F.split(F.regexp_replace("text", '"(?:[^"]|"")*"', "q"), f"[{sep}]", -1))
        reason = F.when(F.trim("text") == "", "empty").when(fields < len(names), "short").when(fields > len(names), "long").otherwise("mistyped")
        taken = [(F.col(f"_row.c{names.index(f.name)}") if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        good.append(read.where(~broken).select(*taken, F.col("file").alias("_file"), F.col("line").alias("_line")))
        bad.append(read.where(broken).select("file", "line", "text", reason.alias("reason")))
    empty = spark.createDataFrame([], T.StructType([*want.fields, T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType())]))
    return reduce(DataFrame.unionByName, good, empty), reduce(DataFrame.unionByName, bad), spark.createDataFrame(drift, "file string, missing string, beyond string")
