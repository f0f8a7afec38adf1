"""What the two embedding operators share: clean vectors, classes of equal vectors, blocks for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec double array) of the vectors that take part: not null, not zero, all parts finite."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


def classes(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, cls) for each row and (cls, vec, size) for each distinct vector;
    cls is the smallest id that has it.  A vector that very many rows share is one class."""
    v = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    firsts = stage(v.groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("size")), f"{name}-firsts")
    held = v.join(firsts.withColumnRenamed("cls", "id"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    held = stage(held.select(F.col("id").alias("cls"), "vec", "size"), f"{name}-classes")
    members = stage(v.select("id", "h1", "h2").join(firsts, ["h1", "h2"]).select("id", "cls"), f"{name}-members")
    return members, held


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small parts neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought near to length one by a power of two, which changes no digit of a cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision, the same whatever else is computed beside them; very large or
    small parts neither overflow nor vanish."""
    a, b = scaled(a), scaled(b)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
