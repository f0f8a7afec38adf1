"""Running totals over keys of any length (W1, J16): a distributed scan, where a window would put a key in one task.

Rows are first summed by key and order, so that peers are one row; these are dealt out by ranges of (key, order),
stored, and summed inside each piece.  A key that goes on over several pieces takes over what the pieces before
it hold: the carries, of which a key has as many as pieces, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import staged

PIECE_ROWS = 2_000_000


def prefix_sums(points: DataFrame, keys: list[str], order: str, sums: list[str], pieces: int | None = None) -> DataFrame:
    """``points`` (one row for each key and order) with ``<name>_before``, for each column of ``sums`` the sum over the
    key's strictly earlier points; 0 for its first.  Null keys are a key and null orders come first, as in a window.

    ``pieces``: ranges to deal out, by default one for each ``PIECE_ROWS`` points and at least as many as the
    session's shuffle partitions."""
    if pieces is None:
        pieces = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // PIECE_ROWS))
    dealt = points.repartitionByRange(pieces, *[F.asc_nulls_first(k) for k in keys], F.asc_nulls_first(order))
    dealt = staged(dealt.withColumn("_piece", F.spark_partition_id()), "scan")
    # a piece's part of a key is no larger than the piece, so these windows are even
    inside = Window.partitionBy("_piece", *keys).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
    # a row for each key and piece: at most as many rows of a key as there are pieces
    totals = dealt.groupBy("_piece", *keys).agg(*[F.sum(s).alias(f"_all_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_piece", *keys, *[F.sum(f"_all_{s}").over(earlier).alias(f"_carry_{s}") for s in sums])
    carry = carry.where(F.coalesce(*[F.col(f"_carry_{s}").cast("double") for s in sums]).isNotNull())
    carry = carry.select(F.col("_piece").alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_carry_{s}" for s in sums])
    same = F.col("_piece") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    total = lambda s: F.coalesce(F.col(f"_carry_{s}"), F.lit(0)) + F.coalesce(F.col(f"_in_{s}"), F.lit(0))
    return local.join(carry, same, "left").select(*points.columns, *[total(s).alias(f"{s}_before") for s in sums])


def _met(rows: DataFrame, found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with what was found for their key and order; nulls meet nulls."""
    named = found.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate([*keys, order])], "sum_before", "n_before")
    same = F.lit(True)
    for i, c in enumerate([*keys, order]):
        same = same & rows[c].eqNullSafe(F.col(f"_m{i}"))
    return rows.join(named, same, "left").select(*[rows[c] for c in rows.columns], "sum_before", "n_before")


def running_before(df: DataFrame, keys: list[str], order: str, value: str, pieces: int | None = None) -> DataFrame:
    """W1 like ``relational.before_in_order``, for keys with any number of rows and orders of any type:
    sum and count of a key's values at strictly earlier orders."""
    points = df.groupBy(*keys, order).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_s"), F.count(value).alias("_n"))
    out = prefix_sums(points, keys, order, ["_s", "_n"], pieces)
    return _met(df, out.select(*keys, order, F.col("_s_before").alias("sum_before"), F.col("_n_before").alias("n_before")), keys, order)


def running_lookup(asked: DataFrame, history: DataFrame, keys: list[str], order: str, value: str, pieces: int | None = None) -> DataFrame:
    """J16 like ``relational.before_lookup``, for keys with any number of rows: the history strictly before
    each asked row, also where a key has no row of its own at that point."""
    zero = F.lit(0)
    have = history.groupBy(*keys, order).agg(F.coalesce(F.sum(value), zero).alias("_s"), F.count(value).alias("_n"))
    want = asked.select(*keys, order).distinct().select(*keys, order, zero.cast(have.schema["_s"].dataType).alias("_s"), zero.cast("long").alias("_n"))
    points = have.unionByName(want).groupBy(*keys, order).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    out = prefix_sums(points, keys, order, ["_s", "_n"], pieces)
    return _met(asked, out.select(*keys, order, F.col("_s_before").alias("sum_before"), F.col("_n_before").alias("n_before")), keys, order)
