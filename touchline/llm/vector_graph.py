"""Embedding near-dedup (operator 10): a robust-pruned flat graph and range search.

* Shards: several clusterings (k-means on at most ``SAMPLE`` vectors each); a vector goes to its
  ``OVERLAP`` nearest clusters.  A cluster above the target size is clustered again on a sample of its
  own, so clusters grow in number with the table; what k-means can't part is cut along a random direction
  at sample quantiles, neighbouring parts overlapping, so no task holds an unbounded group.
* Graph: in each shard a vector's nearest others are pruned robustly (a neighbour goes if a closer one
  leads to it by a factor ``ALPHA``); the adjacency lists of all shards are united.
* Search: from the shard's medoid, greedily towards each vector with a beam, then outward through all
  neighbours in range until none is new.  Links that it and the lists give are checked in double
  precision; they make the components.
* Count: links lie inside components, so each vector's number of links is counted in its component,
  blocks of a large component against each other, without making pairs.
* Audit: a sample of vectors that grows with the root of the table, half of it of vectors with links, is
  compared with all rows; while a link is missing, further clusterings are added, up to ``TRIES`` times.
  If one is missing still, all pairs are compared that a bound on distances to pivots doesn't rule out.

Equal vectors are one class; a vector that very many rows share is one node.

Edge cases: null, zero and non-finite vectors link with nothing and are their own component; so are
rows with a null id (component null, kept); repeated ids with one vector count as rows; vectors of
different dimension never link; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups_for, stage
from .vectors import classes, cosine, matrix, unit, usable

LEAST = 0.95
SAMPLE = 20_000
SHARD = 1500
OVERLAP = 2
CLUSTERINGS = 3
DEGREE = 16
ALPHA = 1.2
BEAM = 8
SEARCHES = 1024  # at once
BLOCK = 2048
AUDIT = 200
REFINE = 10_000
TRIES = 3
_EPS = 1e-9


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def robust_prune(own: np.ndarray, among: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Which candidates of each vector stay: those, nearest first, that no kept one leads to.

    own: (vectors, candidates), cosines of a vector and its candidates, falling; among: (vectors,
    candidates, candidates), those of the candidates among each other."""
    far, step = np.sqrt(np.maximum(0.0, 2 - 2 * own)), np.sqrt(np.maximum(0.0, 2 - 2 * among))
    alive, kept = np.ones(own.shape, bool), np.zeros(own.shape, bool)
    for i in range(own.shape[1]):
        take = alive[:, i] & (kept.sum(axis=1) < degree)
        kept[:, i] = take
        alive &= ~take[:, None] | (alpha * step[:, i] > far)
    return kept


def shard_graph(u: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """(src, dst) of the edges of a shard's unit vectors: of each one's nearest the pruned ones, and edges
    back, at most twice ``degree`` a vector."""
    n, pool = len(u), min(2 * degree + 8, len(u) - 1)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    there = []
    for lo in range(0, n, 256):
        s = u[lo : lo + 256] @ u.T
        at = np.arange(len(s))
        s[at, lo + at] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        close = u[near]
        row, col = np.nonzero(robust_prune(np.take_along_axis(s, near, 1), close @ close.transpose(0, 2, 1), degree))
        there.append(np.stack([lo + row, near[row, col]], axis=1))
    there = np.concatenate(there)
    key = there[:, 0] * n + there[:, 1]
    back = there[:, ::-1]
    back = back[~np.isin(back[:, 0] * n + back[:, 1], key)]
    edges, late = np.concatenate([there, back]), np.repeat([0, 1], [len(there), len(back)])
    edges = edges[np.lexsort([edges[:, 1], late, edges[:, 0]])]
    starts = np.searchsorted(edges[:, 0], np.arange(n))
    return edges[np.arange(len(edges)) - starts[edges[:, 0]] < 2 * degree]


def medoid(u: np.ndarray) -> int:
    return int(np.argmax(u @ u.mean(axis=0)))


def padded(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Adjacency lists as rows of a table, -1 where a list has ended."""
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, np.arange(n))[src] if len(src) else np.zeros(0, int)
    out = np.full((n, int(place.max(initial=0)) + 1), -1, np.int64)
    out[src, place] = dst
    return out


def range_search(u: np.ndarray, adj: np.ndarray, nodes: np.ndarray, start: int, least: float = LEAST, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``nodes``, node) of what is found within range of each of ``nodes``, in many searches at once.

    Each goes greedily from ``start`` and from the node's own list, its ``beam`` nearest at hand; whatever
    is in range is opened besides, until no search finds a new node."""
    b, n, each = len(nodes), len(u), np.arange(len(nodes))
    seen = np.zeros((b, n), bool)
    seen[each, nodes] = True
    pool, sims = np.full((b, beam), -1, np.int64), np.full((b, beam), -3.0)
    shut = np.ones((b, beam), bool)  # opened, or an empty place
    found: list[tuple[np.ndarray, np.ndarray]] = []
    row, new = each, np.full(b, start)
    first = adj[nodes]
    row, new = np.concatenate([row, np.repeat(each, adj.shape[1])]), np.concatenate([new, first.ravel()])
    while True:
        ok = new >= 0
        row, new = row[ok], new[ok]
        fresh = ~seen[row, new]
        key = np.unique(row[fresh] * n + new[fresh])
        row, new = np.divmod(key, n)
        seen[row, new] = True
        s = np.einsum("ij,ij->i", u[nodes[row]], u[new])
        near = s >= least - _EPS
        if near.any():
            found.append((row[near], new[near]))
        # the others compete for the places of their search's pool
        far_row, far, far_s = row[~near], new[~near], s[~near]
        if len(far):
            at = np.unique(far_row)
            slot = np.searchsorted(at, far_row)
            place = np.arange(len(far_row)) - np.searchsorted(far_row, at)[slot]
            width = int(place.max()) + 1
            ids, val = np.full((len(at), beam + width), -1, np.int64), np.full((len(at), beam + width), -3.0)
            done = np.ones((len(at), beam + width), bool)
            ids[:, :beam], val[:, :beam], done[:, :beam] = pool[at], sims[at], shut[at]
            ids[slot, beam + place], val[slot, beam + place], done[slot, beam + place] = far, far_s, False
            best = np.argsort(-val, axis=1, kind="stable")[:, :beam]
            pool[at], sims[at], shut[at] = (np.take_along_axis(x, best, 1) for x in (ids, val, done))
        # next: all that is new in range; where nothing is, the nearest of the pool that isn't opened
        idle = ~shut.all(axis=1)
        idle[row[near]] = False
        rest = np.flatnonzero(idle)
        pick = np.argmax(~shut[rest], axis=1)
        shut[rest, pick] = True
        go_row, go = np.concatenate([row[near], rest]), np.concatenate([new[near], pool[rest, pick]])
        if not len(go):
            break
        row, new = np.repeat(go_row, adj.shape[1]), adj[go].ravel()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _centres(cls: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Centroids of samples of the vectors of each dimension; of a dimension that fits a shard, one."""
    out = {}
    for r in cls.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect():  # one row for each dimension
        own = cls.where(F.size("vec") == r["d"])
        x = unit(matrix([v["vec"] for v in own.orderBy(F.xxhash64("cls", F.lit(seed)), "cls").limit(SAMPLE if r["count"] > SHARD else 1).select("vec").collect()]))
        out[r["d"]] = k_means(x, min(groups_for(r["count"], SHARD), max(1, len(x) // 8)), seed)
    return out


def _refined(rows: DataFrame, seed: int, name: str) -> DataFrame:
    """``rows`` with each cluster above the target size clustered again; new clusters overlap alike."""
    big = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().where(F.col("count") > 2 * OVERLAP * SHARD).collect()}
    if not big:
        return rows
    each, size = REFINE, SHARD
    counted = rows.sparkSession.createDataFrame(list(big.items()), "cluster long, c long")
    sample = rows.join(F.broadcast(counted), "cluster").where(F.pmod(F.xxhash64("cls", F.lit(seed + 1)), F.col("c")) < each)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(matrix(pdf["vec"]))
        k = min(groups_for(int(pdf["c"].iloc[0]), size), max(1, len(x) // 8))
        return pd.DataFrame({"cluster": [key[0]], "centres": [k_means(x, k, seed).astype("float32").tobytes()]})

    fitted = sample.select("cluster", "c", "vec").groupBy("cluster").applyInPandas(fit, "cluster long, centres binary").collect()
    fitted = {r["cluster"]: bytes(r["centres"]) for r in fitted}  # 4 bytes a dimension for each SHARD rows

    def assign(batches):
        for pdf in batches:
            for cl, part in pdf.groupby("cluster", sort=False):
                if cl not in fitted:
                    yield part.assign(cluster=int(cl) << 12)
                    continue
                u = unit(matrix(part["vec"]))
                c = np.frombuffer(fitted[cl], "float32").reshape(-1, u.shape[1])
                top = np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :OVERLAP]
                at = np.repeat(np.arange(len(part)), top.shape[1])
                first = np.tile(np.arange(top.shape[1]) == 0, len(part))
                yield part.iloc[at].assign(cluster=(int(cl) << 12) + 1 + top.ravel(), home=part["home"].to_numpy()[at] & first)

    return stage(rows.mapInPandas(assign, rows.schema), f"{name}-refined")


def _shards(cls: DataFrame, seed: int, name: str) -> DataFrame:
    """(shard, cls, vec, size, home): overlapping cluster shards of one clustering, a dimension's own."""
    centres, first, lines = _centres(cls, seed), {}, {}
    for d, c in centres.items():
        first[d] = sum(len(centres[e]) for e in first)
        lines[d] = np.random.default_rng(seed + 1).normal(size=d)

    def assign(batches):
        for pdf in batches:
            for d, rows in pdf.groupby(pdf["vec"].map(len)):
                u = unit(matrix(rows["vec"]))
                top = np.argsort(-(u @ centres[d].T), axis=1, kind="stable")[:, :OVERLAP]
                at = np.repeat(np.arange(len(rows)), top.shape[1])
                yield pd.DataFrame({"cluster": first[d] + top.ravel(), "along": (u @ lines[d])[at], "home": np.tile(np.arange(top.shape[1]) == 0, len(rows)), "cls": rows["cls"].to_numpy()[at], "vec": rows["vec"].to_numpy()[at], "size": rows["size"].to_numpy()[at]})

    rows = stage(cls.mapInPandas(assign, "cluster long, along double, home boolean, cls long, vec array<double>, size long"), f"{name}-assign")
    rows = _refined(rows, seed, name)
    big = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.percentile_approx("along", [i / 256 for i in range(1, 256)], 2000).alias("cuts")).where(F.col("c") > 2 * OVERLAP * SHARD)
    cuts: dict[int, np.ndarray] = {}
    for r in big.collect():  # at most one row for each cluster
        parts = min(256, groups_for(r["c"], OVERLAP * SHARD))
        cuts[r["cluster"]] = np.unique([r["cuts"][max(0, int(256 * j / parts) - 1)] for j in range(1, parts)])
    if not cuts:
        return rows.select(F.col("cluster").alias("shard"), "cls", "vec", "size", "home")

    def split(batches):
        for pdf in batches:
            out = []
            for i, (cl, p) in enumerate(zip(pdf["cluster"].tolist(), pdf["along"].tolist())):
                edges = cuts.get(cl)
                if edges is None or not len(edges):
                    out.append((i, cl << 16, True))
                    continue
                b = int(np.searchsorted(edges, p, side="right"))
                lo, hi = edges[b - 1] if b else -np.inf, edges[b] if b < len(edges) else np.inf
                room = 0.15 * (hi - lo) if np.isfinite(hi - lo) else 0.15 * (edges[-1] - edges[0] + 1e-12) / len(edges)
                out.append((i, (cl << 16) + b + 1, True))
                if p - lo < room:
                    out.append((i, (cl << 16) + b, False))
                if hi - p < room:
                    out.append((i, (cl << 16) + b + 2, False))
            at = [o[0] for o in out]
            part = pdf.iloc[at]
            yield pd.DataFrame({"shard": [o[1] for o in out], "cls": part["cls"].to_numpy(), "vec": part["vec"].to_numpy(), "size": part["size"].to_numpy(), "home": part["home"].to_numpy() & np.array([o[2] for o in out])})

    return stage(rows.mapInPandas(split, "shard long, cls long, vec array<double>, size long, home boolean"), f"{name}-split")


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["cls"].to_numpy()
    edges = shard_graph(unit(matrix(pdf["vec"])))
    return pd.DataFrame({"src": ids[edges[:, 0]], "dst": ids[edges[:, 1]]})


def join_groups(v: np.ndarray, i: int, x: np.ndarray, hit: np.ndarray, label: np.ndarray) -> list[int]:
    """Of the nodes ``hit``, those confirmed to link with vector ``v`` of node ``i`` that join two groups of
    ``label``, which is updated."""
    out, new = [], hit[label[hit] != label[i]]
    if len(new):
        for j in new[cosine(x[new], np.broadcast_to(v, (len(new), x.shape[1]))) >= LEAST]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append(int(j))
    return out


def _search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the shard's home vectors: every link found joins its ends; those that join two groups
    are given out, at most one less than the shard has vectors."""
    ids, x = pdf["cls"].to_numpy(), matrix(pdf["vec"])
    u, order = unit(x), np.argsort(ids, kind="stable")
    lists = [a if a is not None else () for a in pdf["adj"]]
    src, dst = np.repeat(np.arange(len(ids)), [len(a) for a in lists]), np.concatenate([np.asarray(a, np.int64) for a in lists] + [np.zeros(0, np.int64)])
    at = order[np.minimum(np.searchsorted(ids[order], dst), len(ids) - 1)]
    here = ids[at] == dst  # a united list also names vectors of other shards
    adj = padded(src[here], at[here], len(ids))
    start, out, label = medoid(u), [], np.arange(len(u))
    home = np.flatnonzero(pdf["home"].to_numpy())
    for lo in range(0, len(home), SEARCHES):
        nodes = home[lo : lo + SEARCHES]
        row, hit = range_search(u, adj, nodes, start)
        order_ = np.argsort(row, kind="stable")
        row, hit = row[order_], hit[order_]
        for k in np.unique(row):
            i = int(nodes[k])
            out += [(int(ids[i]), int(ids[j])) for j in join_groups(x[i], i, x, hit[np.searchsorted(row, k) : np.searchsorted(row, k, side="right")], label)]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links(cls: DataFrame, seeds: range) -> DataFrame:
    shards = [_shards(cls, s, f"vg-{s}") for s in seeds]
    edges = None
    for s in shards:
        e = s.groupBy("shard").applyInPandas(_build, "src long, dst long")
        edges = e if edges is None else edges.union(e)
    lists = stage(edges.groupBy("src").agg(F.collect_set("dst").alias("adj")), "vg-lists")  # at most 2 * DEGREE for each shard
    found = None
    for s in shards:
        rows = s.join(lists.withColumnRenamed("src", "cls"), "cls", "left")
        f = rows.groupBy("shard").applyInPandas(_search, "a long, b long")
        found = f if found is None else found.union(f)
    return stage(found.distinct(), "vg-links")


def _pairs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links of all pairs of ``left`` and ``right`` that join two groups."""
    out = []
    if len(left) and len(right):
        ids = np.unique(np.concatenate([left["cls"], right["cls"]]))
        a, b = np.searchsorted(ids, left["cls"]), np.searchsorted(ids, right["cls"])
        y = matrix(right["vec"])
        x = np.zeros((len(ids), y.shape[1]))
        x[a], x[b] = matrix(left["vec"]), y
        u, label = unit(x), np.arange(len(ids))
        for lo in range(0, len(a), 256):
            close = u[a[lo : lo + 256]] @ u[b].T >= LEAST - _EPS
            for i, row in zip(a[lo : lo + 256], close):
                out += [(int(ids[i]), int(ids[j])) for j in join_groups(x[i], int(i), x, b[row], label)]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def exact_links(cls: DataFrame) -> DataFrame:
    """Links that make the true components: none is missed, whatever the vectors.

    A vector is at home in the cell of its nearest pivot.  If x, at home with p, links with y, at home with
    q, then x.(p - q) <= (x - y).(p - q) <= |x - y| |p - q|, and |x - y|^2 is at most 2 - 2 * LEAST; x is
    compared with the cells that this leaves, in blocks.  Without structure that is all of them."""
    centres = _centres(cls, 0)
    reach = {d: np.sqrt(2 - 2 * LEAST) * np.linalg.norm(c[:, None] - c[None], axis=2) + 1e-6 for d, c in centres.items()}

    def assign(batches):
        for pdf in batches:
            for d, rows in pdf.groupby(pdf["vec"].map(len)):
                for lo in range(0, len(rows), 512):
                    part = rows.iloc[lo : lo + 512]
                    s = unit(matrix(part["vec"])) @ centres[d].T
                    own = np.argmax(s, axis=1)
                    near = s[np.arange(len(s)), own][:, None] - s <= reach[d][own]
                    near &= np.arange(s.shape[1]) >= own[:, None]  # of a pair the one with the lower cell goes to the other's
                    at, cell = np.nonzero(near)
                    yield pd.DataFrame({"dim": d, "cell": cell, "home": cell == own[at], "cls": part["cls"].to_numpy()[at], "vec": part["vec"].to_numpy()[at]})

    rows = stage(cls.select("cls", "vec").mapInPandas(assign, "dim long, cell long, home boolean, cls long, vec array<double>"), "vg-exact")
    parts = lambda c: F.ceil(F.sum(c) / BLOCK).cast("int")
    sizes = rows.groupBy("dim", "cell").agg(parts(F.lit(1)).alias("m"), parts(F.col("home").cast("int")).alias("k")).where("k > 0")
    held = rows.join(stage(sizes, "vg-exact-sizes"), ["dim", "cell"])
    held = held.withColumns({"i": F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"), "j": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("k")).cast("int")})
    left = held.select("dim", "cell", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), "cls", "vec")
    same = [F.col(c).alias(c) for c in ("dim", "cell", "j", "cls", "vec")]  # new columns, as both sides have one source
    right = held.where("home").select(F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), *same)
    keys = ["dim", "cell", "i", "j"]
    return stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pairs, "a long, b long").distinct(), "vg-exact-links")


def _count_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that the ``own`` ones of each component link with among the others."""
    out = []
    for _, part in pdf.groupby("component", sort=False):
        own, other = part[part["own"]], part[~part["own"]]
        if not len(own) or not len(other):
            continue
        x, y, w = matrix(own["vec"]), matrix(other["vec"]), other["size"].to_numpy()
        s = unit(x) @ unit(y).T
        ok = s >= LEAST
        for i, j in zip(*np.nonzero(np.abs(s - LEAST) < _EPS)):
            ok[i, j] = cosine(x[i : i + 1], y[j : j + 1])[0] >= LEAST
        ok &= own["cls"].to_numpy()[:, None] != other["cls"].to_numpy()[None, :]
        out.append(pd.DataFrame({"cls": own["cls"].to_numpy(), "linked": ok @ w}))
    return pd.concat(out) if out else pd.DataFrame({"cls": np.zeros(0, "int64"), "linked": np.zeros(0, "int64")})


def count_links(cls: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, linked): rows of other classes that each class of a component links with."""
    held = cls.join(comps.select(F.col("id").alias("cls"), "component"), "cls")
    sizes = stage(comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "vg-sizes")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    held = held.join(sizes, "component").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # small components share tasks, blocks of a large one have a task each pair
    few = sizes.where(F.col("n") <= BLOCK).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    group = F.when(F.col("parts") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(groups_for(few, BLOCK))))
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    base = held.withColumn("grp", group)
    own = base.select("grp", F.col("part").alias("i"), F.explode(all_parts).alias("j"), "parts", "component", "cls", "vec", "size", F.lit(True).alias("own"))
    other = base.select("grp", F.explode(all_parts).alias("i"), F.col("part").alias("j"), "parts", "component", "cls", "vec", "size", F.lit(False).alias("own"))
    counted = own.union(other).groupBy("grp", "i", "j", F.col("parts") > 1).applyInPandas(_count_block, "cls long, linked long")
    return counted.groupBy("cls").agg(F.sum("linked").alias("linked"))


def audit(cls: DataFrame, counts: DataFrame, n: int) -> float:
    """Share of the true links of a sample of classes that ``counts`` (cls, linked) has: half of them any,
    half ones with links."""
    order, most = [F.xxhash64("cls", F.lit(99)), F.col("cls")], AUDIT + math.isqrt(n)
    linked = cls.join(counts.where("linked > 0").select("cls"), "cls", "left_semi")
    probe = {r["cls"]: r for some in (cls, linked) for r in some.orderBy(*order).limit(most).collect()}.values()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in probe:
        by_dim.setdefault(len(r["vec"]), ([], []))
        by_dim[len(r["vec"])][0].append(r["cls"])
        by_dim[len(r["vec"])][1].append(r["vec"])
    by_dim = {d: (np.array(a), matrix(b)) for d, (a, b) in by_dim.items()}

    def run(batches):
        truth = {d: np.zeros(len(ids), "int64") for d, (ids, _) in by_dim.items()}
        for pdf in batches:
            for d, part in pdf.groupby(pdf["vec"].map(len)):
                if d in by_dim:
                    ids, x = by_dim[d]
                    y, own, size = unit(matrix(part["vec"])), part["cls"].to_numpy(), part["size"].to_numpy()
                    for lo in range(0, len(ids), 512):
                        ok = (unit(x[lo : lo + 512]) @ y.T >= LEAST + _EPS) & (ids[lo : lo + 512, None] != own[None, :])
                        truth[d][lo : lo + 512] += ok @ size
        for d, (ids, _) in by_dim.items():
            yield pd.DataFrame({"cls": ids, "truth": truth[d]})

    true = cls.mapInPandas(run, "cls long, truth long").groupBy("cls").agg(F.sum("truth").alias("truth")).where("truth > 0")
    both = true.join(counts, "cls", "left").select("truth", F.least("truth", F.coalesce("linked", F.lit(0))).alias("found"))
    r = both.agg(F.sum("truth").alias("t"), F.sum("found").alias("f")).first()
    return 1.0 if not r["t"] else r["f"] / r["t"]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``rows``."""
    members, cls = classes(usable(rows, id_col, vec_col), "vg")
    n = cls.count()
    links, counts, comps = None, None, None
    for attempt in range(TRIES if n else 0):
        new = _links(cls, range(attempt * CLUSTERINGS + 1, (attempt + 1) * CLUSTERINGS + 1))
        links = new if links is None else links.union(new)
        comps = stage(components(links, "vg-cc"), "vg-comps")
        counts = stage(count_links(cls, comps), "vg-counts")
        if audit(cls, counts, n) >= 1.0:
            break
    else:
        if n:
            comps = stage(components(links.union(exact_links(cls)), "vg-cc"), "vg-comps")
            counts = stage(count_links(cls, comps), "vg-counts")
    ids = rows.select(F.col(id_col).cast("long").alias("vec_id"))
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    per = cls.select("cls", "size").join(counts, "cls", "left").join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left")
    per = stage(per.select("cls", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")), "vg-per")
    # a repeated id may have several vectors: it has the links of all, and the smallest component
    own = members.distinct().join(per, "cls").groupBy(F.col("id").alias("vec_id")).agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(own, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
