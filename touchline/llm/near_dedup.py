"""MinHash near-dedup (operator 8): a Chosen-Path set similarity join.

* A document's set is its distinct 5-word shingles, hashed to 64 bits.  Documents with equal sets are
  one class; only classes are compared.
* Each class has ``TOKENS`` minwise tokens.  Independent trees branch the classes: a node picks one or
  two of the token places by its own hash (4/3 on average, one over the similarity; two at the first
  level that only large nodes reach), and a class goes to the child of each token it has there.  Similar
  classes meet in some node of some tree; the number of trees sets the recall.  At similarity s a pair
  that goes on to a node with miss m below misses a place with 1 - s + s * m; at 0.75 a pair that is
  compared after the first branching misses a tree with probability 0.19, one that has to go down all
  ``DEPTH`` levels with 0.44, so twelve trees miss one in 10^8 and one in 20,000 of them.
* In every node each class is first compared with the node's smallest id.  That joins groups of
  copies into components without making their pairs.  Nodes that lie in one component are done.
* In a node only the classes outside its largest component are compared with all of it; a node is
  small if those are at most ``SMALL`` comparisons.  Larger nodes branch on; what is left at ``DEPTH`` is
  compared alike, so no candidate is capped.
* A node is compared in pairs of blocks, ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles each, which
  spread over tasks.  A first pass over the tokens keeps the classes that have a likely partner; a second
  one compares those on full sets and gives out only links that join two components, so a dense
  group gives out rows in proportion to its classes, never its pairs.

Edge cases: null texts and texts without words have no shingles and no links; texts under five words
are one shingle; rows that share a doc_id are one document; rows with a null doc_id follow their
class and are kept if it has no other id; extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import box, components, drop_stage, stage, text_batches, unbox

WORDS = 5
PERCENT = 75
TOKENS = 64
TREES = 12
SMALL = 1 << 20
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
DEPTH = 6
LIKELY = TOKENS // 2  # equal tokens of a candidate at least; 48 are expected at the bound
MEMO = 300_000

_MULT = np.random.default_rng(20240601).integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def minwise(s: np.ndarray) -> np.ndarray:
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _MULT).min(axis=0))
    return (_mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, tokens) of rows (doc_id, text); s1 and s2 stand for the whole set."""

    def run(batches):
        import xxhash

        for pdf in batches:
            sets = [shingle_set(t) for t in pdf["text"]]
            whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            parts = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "s1": parts[:, 0], "s2": parts[:, 1], "tokens": [minwise(s) if len(s) else None for s in sets]})

    return text_batches(docs).mapInPandas(run, "doc_id long, n long, s1 long, s2 long, tokens array<int>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of rows (doc_id, text)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shingles": [shingle_set(t).view(np.int64) for t in pdf["text"]]})

    return text_batches(docs).mapInPandas(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The links among candidate pairs (a, b): first by tokens, then on full sets."""
    t = classes.select("id", "n", "tokens")
    left = t.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = t.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    same = F.aggregate(F.zip_with("ta", "tb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    likely = stage(pairs.join(left, "a").join(right, "b").where(sizes & (same >= LIKELY)).select("a", "b"), f"{name}-likely")
    need = stage(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), f"{name}-need")
    sets = stage(shingle_sets(docs.join(need, "doc_id", "left_semi")), f"{name}-sets")
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    links = stage(likely.join(a, "a").join(b, "b").where(both * 100 >= union * PERCENT).select("a", "b").distinct(), f"{name}-links")
    drop_stage(likely, need, sets)
    return links


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """Children of (node, id, n, tokens): one token place by the node's hash, for a third of nodes, and for
    all at the first level below the roots, two."""
    one = F.pmod(F.xxhash64("node", F.lit(2 * level)), F.lit(TOKENS)).cast("int")
    two = F.pmod(F.xxhash64("node", F.lit(2 * level + 1)), F.lit(3 * TOKENS)).cast("int")
    both = F.array_distinct(F.array(one, two % TOKENS))
    places = F.explode(both if level == 1 else F.when(two < TOKENS, both).otherwise(F.array(one)))
    rows = rows.select("node", "id", "n", "tokens", places.alias("place"))
    return rows.select(F.xxhash64("node", "place", F.element_at("tokens", F.col("place") + 1)).alias("node"), "id", "n")


def _met(rows: DataFrame, name: str) -> DataFrame:
    """Rows of nodes that hold two classes or more."""
    rows = stage(rows, f"{name}-rows")
    held = stage(rows.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("node", "low"), f"{name}-nodes")
    out = stage(rows.join(held, "node"), name)  # of two stored sides, so a hot node's rows can be split
    drop_stage(rows, held)
    return out


def _open(rows: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """Rows with their component, of the nodes that hold two components or more.  ``work``: how many
    comparisons of classes outside the node's largest component (``main``) with all of it there are;
    ``ob`` and ``nb``: into how many blocks the outside and the whole are cut."""
    tagged = stage(rows.select("node", "id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), f"{name}-tagged")
    by = tagged.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = F.max(F.struct("c", "comp", "s")).alias("top")
    node = by.groupBy("node").agg(top, F.sum("c").alias("all"), F.sum("s").alias("sum"), F.count(F.lit(1)).alias("k")).where("k > 1")
    cut = lambda classes, shingles: F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    out, out_sum = F.col("all") - F.col("top.c"), F.col("sum") - F.col("top.s")
    node = node.select("node", F.col("top.comp").alias("main"), (out * F.col("all")).alias("work"), cut(out, out_sum).alias("ob"), cut(F.col("all"), F.col("sum")).alias("nb"))
    node = stage(node, f"{name}-nodes")
    out = stage(tagged.join(node, "node"), name)
    drop_stage(tagged, node)
    return out


def _groups(batches, fields: list[str]):
    """One dict of arrays for each run of equal (node, i, j) in sorted batches."""
    held: dict = {}
    for pdf in batches:
        new = {f: pdf[f].to_numpy() for f in fields}
        held = {f: np.concatenate([held[f], new[f]]) for f in fields} if held else new
        key = [held[f] for f in ("node", "i", "j")]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        for at, end in zip([0, *cuts], cuts):
            yield {f: v[at:end] for f, v in held.items()}
        last = cuts[-1] if len(cuts) else 0
        held = {f: v[last:] for f, v in held.items()}
    if held and len(held["node"]):
        yield held


def _comparable(x: dict, y: dict) -> np.ndarray:
    """Which of x and y lie in two components and are of sizes that allow the similarity."""
    a, b = x["n"][:, None], y["n"][None, :]
    return (x["comp"][:, None] != y["comp"][None, :]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * PERCENT)


def _sides(g: dict) -> tuple[dict, dict]:
    out = g["outside"].astype(bool)
    return {f: v[out] for f, v in g.items()}, {f: v[~out] for f, v in g.items()}


def _alike(tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """How many token places of each x and each y are equal."""
    if len(tx) * len(ty) <= 512:
        return (tx[:, None] == ty[None]).sum(axis=2)
    same = np.zeros((len(tx), len(ty)), np.uint8)
    columns = np.ascontiguousarray(ty.T)
    for at in range(0, len(tx), 64):  # a strip of rows at a time stays in the cache
        for place in range(TOKENS):
            same[at : at + 64] += tx[at : at + 64, place, None] == columns[place]
    return same


_CELL = "node long, i int, j int, outside boolean, id long, n long, comp long"
_CELL_FIELDS = [f.split()[0] for f in _CELL.split(", ")]


def _likely(batches):
    """Of each pair of blocks the classes that have a likely partner by their tokens."""
    out, held = [], 0
    for g in _groups(batches, [*_CELL_FIELDS, "tokens"]):
        x, y = _sides(g)
        if not len(x["id"]) or not len(y["id"]):
            continue
        tx, ty = np.stack(x.pop("tokens")), np.stack(y.pop("tokens"))
        may = _comparable(x, y)
        some = may.any(axis=1)
        if not some.any():
            continue
        may[some] &= _alike(tx[some], ty) >= LIKELY
        for side, keep in ((x, may.any(axis=1)), (y, may.any(axis=0))):
            if keep.any():
                out.append([side[f][keep] for f in _CELL_FIELDS])
                held += int(keep.sum())
        if held > 10_000:
            yield pd.DataFrame(dict(zip(_CELL_FIELDS, map(np.concatenate, zip(*out)))))
            out, held = [], 0
    if out:
        yield pd.DataFrame(dict(zip(_CELL_FIELDS, map(np.concatenate, zip(*out)))))


def forest(x: dict, y: dict) -> list[tuple[int, int]]:
    """Links between x and y, confirmed on full sets, that join their components: no cycles."""
    for side in (x, y):
        side["n"] = np.array([len(s) for s in side["shingles"]], np.int64)
    parent: dict[int, int] = {}

    def root(c):
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    may, links = _comparable(x, y), []
    ends = np.cumsum([len(s) for s in y["shingles"]])
    words, codes = np.unique(np.concatenate(y["shingles"]), return_inverse=True)
    seen = np.zeros(len(words), np.int32)
    for k, s in enumerate(x["shingles"]):
        if not may[k].any():
            continue
        at = np.searchsorted(words, s)
        at[at == len(words)] = 0
        own = at[words[at] == s]
        seen[own] = 1
        both = np.add.reduceat(seen[codes], np.concatenate([[0], ends[:-1]]))
        seen[own] = 0
        for m in np.flatnonzero(may[k] & (both * 100 >= (x["n"][k] + y["n"] - both) * PERCENT)):
            a, b = root(int(x["comp"][k])), root(int(y["comp"][m]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(x["id"][k]), int(y["id"][m])))
    return links


def _linked(batches):
    for g in _groups(batches, [*_CELL_FIELDS, "shingles"]):
        x, y = _sides(g)
        if len(x["id"]) and len(y["id"]) and (links := forest(x, y)):
            yield pd.DataFrame(links, columns=["a", "b"])


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def _likely_cells(small: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """The cells (pairs of blocks) of the nodes of ``small`` with the classes that have likely partners there."""
    block = lambda n: F.pmod(F.xxhash64("node", "id"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    whole = F.transform(upto(F.col("ob")), lambda i: F.struct(i.alias("i"), block(F.col("nb")).alias("j"), F.lit(False).alias("outside")))
    outside = F.transform(upto(F.col("nb")), lambda j: F.struct(block(F.col("ob")).alias("i"), j.alias("j"), F.lit(True).alias("outside")))
    cells = F.when(F.col("comp") == F.col("main"), whole).otherwise(F.concat(whole, outside))
    rows = small.join(classes.select("id", "tokens"), "id").select("node", "id", "n", "comp", "tokens", F.inline(cells)).select(*_CELL_FIELDS, "tokens")
    return stage(_dealt(rows).mapInPandas(_likely, _CELL), name)


def _confirmed(likely: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links (a, b) of the cells, enough to connect what is similar in each."""
    need = stage(likely.select(F.col("id").alias("doc_id")).distinct(), f"{name}-need")
    sets = shingle_sets(docs.join(need, "doc_id", "left_semi")).withColumn("h", F.xxhash64("shingles"))
    sets = stage(sets.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("id"), "shingles"), f"{name}-sets")
    links = stage(_dealt(likely.join(sets, "id").select(*_CELL_FIELDS, "shingles")).mapInPandas(_linked, "a long, b long").distinct(), f"{name}-links")
    drop_stage(need, sets)
    return links


def link_classes(classes: DataFrame, docs: DataFrame, trees: int = TREES) -> DataFrame:
    """Components (id, component) of ``classes`` (id, n, tokens), texts by (doc_id, text) in ``docs``."""
    roots = classes.where("n > 0").withColumn("node", F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(i)) for i in range(trees)])))
    met = _met(_branch(roots, 0), "cp-met")
    star = met.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(star, classes, docs, "cp-star")
    comps = stage(components(links), "cp-comps")
    rows, cells = met, []
    for level in range(1, DEPTH + 1):
        live = _open(rows, comps, f"cp-open-{level}")
        small = live if level == DEPTH else live.where(F.col("work") <= SMALL)
        cells.append(_likely_cells(small, classes, f"cp-likely-{level}"))
        large = live.where(F.col("work") > SMALL).select("node", "id")
        if level == DEPTH or large.isEmpty():
            break
        rows = _met(_branch(large.join(classes, "id"), level), f"cp-met-{level}")
    more = _confirmed(reduce(DataFrame.union, cells), docs, "cp-more")
    return stage(components(links.union(more)), "cp-all")


def near_components(docs: DataFrame, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = stage(sketches(texts), "cp-sketch")
    # one class for each set; the largest part of a group of copies meets before the shuffle
    classes = sk.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))
    classes = stage(classes, "cp-class-ids")
    held = sk.select("doc_id", "s1", "s2", "tokens").join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "s1", "s2"])
    held = stage(held.dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("id"), "n", "tokens"), "cp-classes")
    comps = link_classes(held, texts, trees)
    # rows that share a doc_id are one document, whatever their sets
    shared = sk.where("n > 0 and doc_id is not null").join(classes, ["s1", "s2"]).where("doc_id <> id").join(classes.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    extra = shared.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    if not extra.isEmpty():
        comps = stage(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(extra)), "cp-shared")
    label = classes.join(comps, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("comp"))
    label = stage(label, "cp-label")
    out = sk.join(label, ["s1", "s2"], "left")
    alone = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less near copies: of each component one row stays, that with the smallest id, null ids last.

    Where ids are null or repeated, rows take numbers of their own, so that rows of one id with unlike
    texts are documents of their own, and of exact repeats one stays.  Texts without words link with
    nothing and all stay."""
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if n == ids:
        keep = near_components(docs, id_col=id_col, text_col=text_col).where("kept").select("doc_id")
        return docs.join(keep, docs[id_col].cast("long") == keep["doc_id"], "left_semi")
    rows = stage(docs.select(box(docs), F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("id")), "cp-rows")
    texts = rows.select("no", F.col("row").getField(text_col).alias("text"))
    found = near_components(texts, id_col="no").select(F.col("doc_id").alias("no"), "component_id")
    order = F.struct(F.col("id").isNull(), "id", "no")
    keep = rows.select("no", "id").join(found, "no").groupBy("component_id").agg(F.min_by("no", order).alias("no")).select("no")
    return rows.join(keep, "no", "left_semi").select(*unbox(docs.columns))
