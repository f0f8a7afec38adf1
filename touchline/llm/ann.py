"""Approximate nearest neighbours (operator 5): multi-index hashing.

* Codes: the signs of a vector under learned rotations (iterative quantisation, several starts, so a
  code has ``BITS`` bits whatever the dimension).  The rotations and the radius are fitted on at most
  ``SAMPLE`` vectors; every vector is indexed.
* Index: codes are split into substrings of about log2(rows) bits, each a key (substring number, value)
  with a row of the index.  By the pigeonhole principle a code that differs from a query in fewer than
  m * (a + 1) of its bits agrees with it, in one of the m substrings, but for a bits.  So a query's keys
  within a bits of its own meet the index by an equi-join and give all codes in that radius; those pass
  the full Hamming test and are ranked by cosine of the original vectors.
* ``REACHES`` are the a, rising while a pilot of the queries left gains by it.  A query is done when the k-th best cosine found is one whose Hamming
  distance, at the sample's ``COVER`` quantile, lies within the radius that has been retrieved.
* Queries whose neighbours are farther, or whose keys hold too large a share of the table for an index
  to spare work (``LOAD``), go on with a radius that covers ``COVER`` of the sample's true neighbours.
  Balls of that size hold most keys, so they are probed in blocks: shards of the index by blocks of
  queries, each with a table of 8-bit substrings; too few found widen the radius.  Vectors without any
  structure all end here: no index prunes them, the Hamming test does.

Equal vectors are one class, so a vector that very many rows share is indexed and ranked once.

Edge cases: null vectors, zero vectors and vectors with null or non-finite parts take no part, nor do
null ids; vectors of another dimension than the query's are no candidates of it; ties go to smaller
ids; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import groups_for, stage
from .vectors import classes, cosine, matrix, unit, usable

BITS = 256
SAMPLE = 20_000
PROBES = 256
COVER = 0.98
REACHES = (0, 1, 2)
LOAD = 0.15  # of the rows; and at most
MOST = 20_000  # rows a query
PILOT = 128  # queries that try a wider reach first; all do if so large a share of them is done
WORTH = 0.1
CELL = 1 << 19  # numbers in a shard or block of vectors
STEP = 8  # the radius grows by so much

_near = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)
#: For each distance and byte, the bytes within that distance.
_BALLS = [[np.flatnonzero(_near[q] <= a) for q in range(256)] for a in range(9)]


def fit_rotations(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """(dim, bits): rotations that bring the unit vectors ``x`` near to corners of the cube."""
    dim, rng, out = x.shape[1], np.random.default_rng(seed), []
    _, basis = np.linalg.eigh(x.T @ x / len(x))
    v = x @ basis
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ wt).T
        out.append(basis @ r)
    return np.concatenate(out, axis=1)[:, :bits]


def encode(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as bytes, one column for each substring."""
    return np.packbits(x @ rotations > 0, axis=1)


def hamming(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ q).sum(axis=-1, dtype=np.int64)


class MultiIndex:
    """A table of byte -> rows for each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``q``: all of them."""
        m = self.codes.shape[1]
        if radius >= 8 * m:
            return np.arange(len(self.codes))
        a, b = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = a if j <= b else a - 1
            if reach < 0:
                continue
            order, starts = self.order[j], self.starts[j]
            for v in _BALLS[min(reach, 8)][q[j]]:
                hit[order[starts[v] : starts[v + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(q, self.codes[rows]) <= radius]


def fit_radius(x: np.ndarray, rotations: np.ndarray, k: int, cover: float = COVER, probes: int = PROBES) -> tuple[int, float]:
    """The Hamming radius that holds ``cover`` of the sample's k nearest neighbours, and by how many
    deviations their distance exceeds what their angle lets expect, at that quantile."""
    codes, far, over, bits = encode(x, rotations), [], [], rotations.shape[1]
    for i in range(0, len(x), max(1, len(x) // probes)):
        sims = x @ x[i]
        sims[i] = -2
        best = np.argpartition(-sims, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, int)
        if len(best):
            d = hamming(codes[i], codes[best])
            mean, dev = expected(sims[best], bits)
            far += d.tolist()
            over += ((d - mean) / dev).tolist()
    return (int(np.quantile(far, cover)), max(0.0, float(np.quantile(over, cover)))) if far else (bits, 3.0)


def expected(cos, bits: int):
    """Mean and deviation of the Hamming distance of codes of vectors with a cosine."""
    p = np.arccos(np.clip(cos, -1.0, 1.0)) / np.pi
    return bits * p, np.sqrt(bits * p * (1 - p)) + 1.0


def masks(bits: int, reach: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``reach`` ones."""
    return [sum(1 << i for i in ones) for r in range(reach + 1) for ones in itertools.combinations(range(bits), r)]


def substrings(codes: np.ndarray, width: int) -> np.ndarray:
    """(rows, substrings) numbers of ``width`` bits each; bits left over are in none."""
    bits = np.unpackbits(codes, axis=1)
    m = bits.shape[1] // width
    return bits[:, : m * width].reshape(len(bits), m, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def as_longs(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit numbers; what the last one lacks is zero."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view("<i8")


def as_bytes(column) -> np.ndarray:
    return np.stack(column).astype("<i8").view(np.uint8)


def coded(cls: DataFrame, models: dict, width: int) -> DataFrame:
    """(dim, cls, vec, code, sub): code in longs, sub its substrings."""

    def run(batches):
        for pdf in batches:
            for d, rows in pdf.groupby(pdf["vec"].map(len)):
                codes = encode(unit(matrix(rows["vec"])), models[d][0])
                yield pd.DataFrame({"dim": d, "cls": rows["cls"].to_numpy(), "vec": rows["vec"].to_numpy(), "code": list(as_longs(codes)), "sub": list(substrings(codes, width))})

    return cls.select("cls", "vec").mapInPandas(run, "dim int, cls long, vec array<double>, code array<long>, sub array<long>")


def probes(index: DataFrame, queries: DataFrame, width: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(keys that queries ask for, how many rows of the index each query would touch)."""
    around = F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks(width, reach)]), lambda m: F.col("v").bitwiseXOR(m))).alias("v")
    asked = queries.select("dim", F.col("cls").alias("q"), F.posexplode("sub").alias("j", "v")).select("dim", "q", "j", around)
    held = index.select("dim", F.posexplode("sub").alias("j", "v")).groupBy("dim", "j", "v").agg(F.count(F.lit(1)).alias("rows"))
    return asked, asked.join(held.hint("merge"), ["dim", "j", "v"]).groupBy("q").agg(F.sum("rows").alias("rows"))


def bearable(n: int, k: int) -> float:
    """How many rows of the index a query may touch before a scan in blocks is as good."""
    return min(max(LOAD * n, 50 * (k + 1)), MOST)


def retrieve(index: DataFrame, queries: DataFrame, n: int, width: int, reach: int, bits: int, k: int) -> DataFrame:
    """(q_cls, cls, score): of the queries whose keys hold few enough rows, the k + 1 nearest of all codes
    that differ in fewer than m * (reach + 1) bits, m the number of substrings.

    Keys are many times the rows that they come from, which the planner can't know, so they are merged."""
    asked, load = probes(index, queries, width, reach)
    cheap = stage(load.where(F.col("rows") <= bearable(n, k)).select("q"), f"mih-cheap-{reach}")
    keys = index.select("dim", "cls", F.posexplode("sub").alias("j", "v"))
    pairs = asked.join(cheap, "q", "left_semi").join(keys.hint("merge"), ["dim", "j", "v"]).select("q", "cls").distinct()
    left = queries.select(F.col("cls").alias("q"), F.col("code").alias("q_code"))
    differ = F.aggregate(F.zip_with("code", "q_code", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    coded_ = pairs.hint("merge").join(index.select("cls", "code"), "cls").join(left, "q")
    near = stage(coded_.where(differ <= (bits // width) * (reach + 1) - 1).select("q", "cls"), f"mih-near-{reach}")

    def run(batches):
        for pdf in batches:
            for _, rows in pdf.groupby(pdf["vec"].map(len)):
                yield pd.DataFrame({"q_cls": rows["q"], "cls": rows["cls"], "score": cosine(matrix(rows["vec"]), matrix(rows["q_vec"]))})

    both = near.join(index.select("cls", "vec"), "cls").join(queries.select(F.col("cls").alias("q"), F.col("vec").alias("q_vec")), "q")
    scored = both.select("q", "cls", "vec", "q_vec").mapInPandas(run, "q_cls long, cls long, score double")
    order = Window.partitionBy("q_cls").orderBy(F.col("score").desc(), "cls")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def by_keys(index: DataFrame, queries: DataFrame, n: int, width: int, reach: int, bits: int, models: dict, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, done): what the keys within a reach give to the queries that are done with it, and those.

    A query is done if k others were found and nothing as near as the last of them can lie outside the
    radius, at the sample's quantile."""
    found = stage(retrieve(index, queries, n, width, reach, bits, k), f"mih-found-{reach}")
    last = found.where("cls <> q_cls").groupBy("q_cls").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.col("c") >= k)
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.element_at("s", k)))) / np.pi
    over = F.element_at(F.create_map(*[F.lit(v) for d, m in models.items() for v in (d, m[2])]), F.col("dim"))
    safe = bits * p + over * (F.sqrt(bits * p * (1 - p)) + 1.0) <= (bits // width) * (reach + 1) - 1
    done = stage(last.join(queries.select(F.col("cls").alias("q_cls"), "dim"), "q_cls").where(safe).select("q_cls"), f"mih-done-{reach}")
    return found.join(done, "q_cls", "left_semi"), done


def in_blocks(index: DataFrame, queries: DataFrame, n: int, models: dict, k: int) -> DataFrame:
    """(q_cls, cls, score): the k + 1 nearest of all codes within the fitted radius, in each shard."""
    widest = max(models)
    shards = groups_for(n, max(256, CELL // widest))
    blocks = groups_for(queries.count(), max(256, CELL // widest))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    held = index.select("dim", F.pmod(F.xxhash64("cls"), F.lit(shards)).alias("shard"), each(blocks).alias("block"), "cls", "vec", "code")
    asked = queries.select("dim", each(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "cls"), F.lit(blocks)).alias("block"), "cls", "vec", "code")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            radius = models[int(key[0])][1]
            x, qs, ids = matrix(left["vec"]), matrix(right["vec"]), left["cls"].to_numpy()
            own, codes = as_bytes(left["code"]), as_bytes(right["code"])
            table = MultiIndex(own)
            for qid, q, code in zip(right["cls"].tolist(), qs, codes):
                r, want = radius, min(k + 1, len(x))
                rows = table.within(code, r)
                while len(rows) < want:
                    r += STEP
                    rows = table.within(code, r)
                s = cosine(x[rows], np.broadcast_to(q, (len(rows), len(q))))
                best = np.lexsort((ids[rows], -s))[: k + 1]
                out += [(qid, int(ids[rows[i]]), float(s[i])) for i in best]
        return pd.DataFrame(out, columns=["q_cls", "cls", "score"]).astype({"q_cls": "int64", "cls": "int64", "score": "float64"})

    keys = ["dim", "shard", "block"]
    hits = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "q_cls long, cls long, score double")
    order = Window.partitionBy("q_cls").orderBy(F.col("score").desc(), "cls")
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def search(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    members, cls = classes(usable(rows, id_col, vec_col), "mih")
    n = cls.count()
    models: dict[int, tuple[np.ndarray, int, float]] = {}
    for r in cls.select(F.size("vec").alias("d")).distinct().collect():  # one row for each dimension
        x = unit(matrix([v["vec"] for v in cls.where(F.size("vec") == r["d"]).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("vec").collect()]))
        rot = fit_rotations(x, bits)
        models[r["d"]] = (rot, *fit_radius(x, rot, k))
    if not models:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    width = min(30, max(8, n.bit_length() - 1))
    index = stage(coded(cls, models, width), "mih-index")
    asked = members.where(F.col("id") % every == 0)
    left = stage(index.join(asked.select("cls").distinct(), "cls", "left_semi"), "mih-queries")
    hits = None
    for reach in REACHES:
        size = left.count()
        if reach and size > 2 * PILOT:  # a wider reach costs more, so some queries show whether it is worth it
            few = left.where(F.pmod(F.xxhash64(F.lit(reach), "cls"), F.lit(size // PILOT)) == 0)
            if by_keys(index, few, n, width, reach, bits, models, k)[1].count() < WORTH * few.count():
                break
        found, done = by_keys(index, left, n, width, reach, bits, models, k)
        hits = found if hits is None else hits.union(found)
        left = stage(left.join(done, left["cls"] == done["q_cls"], "left_anti"), f"mih-left-{reach}")
    if not left.isEmpty():
        rest = in_blocks(index, left, n, models, k)
        hits = rest if hits is None else hits.union(rest)
    hits = stage(hits, "mih-hits")
    # of a class, its k + 1 smallest distinct ids are enough
    first = Window.partitionBy("cls").orderBy("id")
    few = members.join(hits.select("cls").distinct(), "cls", "left_semi").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("cls", F.col("id").alias("vec_id"))
    few = stage(few, "mih-few")
    full = asked.select(F.col("id").alias("query_id"), F.col("cls").alias("q_cls")).distinct().join(hits, "q_cls").join(few, "cls").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return full.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: list[tuple[int, np.ndarray]], every: int = 50, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    """The k nearest of each query by comparing it with everything: what recall is measured against."""
    ids, x = np.array([i for i, _ in vectors]), matrix([v for _, v in vectors])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = cosine(x, np.broadcast_to(x[i], x.shape))
        s[i] = -np.inf
        best = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out
