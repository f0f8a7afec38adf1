"""Reports and checks in the same pass as the table.

A report rides on the job that writes or reads the table (``DataFrame.observe``), where a query of its own would
scan the table again.  A check is part of the plan: a row that breaks it stops the job that meets it, so nothing
of a bad table is published.  An observation has its figures after the first action on its table, and those are
of that action: a table that is read in part is reported in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """``df``, and its number of rows (``rows``) and the named aggregates, once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]), seen


def share_of(condition: Column) -> Column:
    """Percentage of rows for which the condition holds; unknown counts as not; null without rows."""
    return F.round(F.avg(F.when(condition, 100.0).otherwise(0.0)), 6)


def coverage_figures(status: str, values: list[str]) -> dict[str, Column]:
    """How many rows have each of the values."""
    return {f"n_{v}": F.sum((F.col(status).eqNullSafe(F.lit(v))).cast("long")) for v in values}


def unmatched(probe: str) -> dict[str, Column]:
    """How many rows of a left join found nothing."""
    return {"unmatched": F.sum(F.col(probe).isNull().cast("long"))}


def checked(df: DataFrame, bad: Column, message: str, *shown: str) -> DataFrame:
    """``df``, whose first row with ``bad`` ends the job with the message and that row's shown columns.

    Unknown isn't bad."""
    said = F.concat(F.lit(f"{message}: "), F.to_json(F.struct(*(shown or df.columns)), {"ignoreNullFields": "false"}))
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def checked_unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """``df``, which must have one row for each key; keys with nulls are keys too."""
    from pyspark.sql.window import Window

    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return checked(counted, F.col("_n") > 1, message, *keys, "_n").drop("_n")
