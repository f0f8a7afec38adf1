"""Source divergence audit (operator 11): which sources of a language use other words than the rest.

Tasks count the terms of their texts.  Each term of a language is one wide vector, its counts in an array
with a place for each source of the language.  Higher-order functions turn counts into shares and emit the
contributions of pairs of sources; sums over terms are combined on the map side, so a pair is one row for each
task and no task holds a language or a source.

All arithmetic is exact, in longs: shares are billionths of a smoothed distribution, p = 1 +
floor(10^9 (count + 2) / (N + 2 V)), and two shares differ by floor((p - q)^2 / (p + q)).  Counts up to
9 * 10^15 fit; beyond, ANSI mode raises.

Edge cases: null texts, languages and sources are empty strings; a group without terms counts as zeros
everywhere; a language without kept terms has pairs of value 0 and no term rows; repeated rows are documents
of their own; empty tables give no rows; columns other than lang, source and text are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, text_batches

#: Entries that a task counts in memory before it gives them out.
HELD = 500_000
#: A term's bytes: letters of ASCII and everything beyond it; only A-Z are lower-cased, all else is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents a kept term is in, the unit of shares, what is added to each count, listed terms.
LEAST_DOCS, UNIT, PRIOR, TOP = 10, 1000, 2, 10


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 2) / whole), by three steps of long division so that no product overflows."""
    digits, rest = F.lit(1).cast("long"), count + PRIOR
    for power in (UNIT**2, UNIT, 1):
        digits, rest = digits + _div(rest * UNIT, whole) * power, (rest * UNIT) % whole
    return digits


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): occurrences, and documents that hold the term.

    Tasks count the terms of their texts and give out what they hold whenever that is ``HELD`` entries, so the
    sums that are shuffled are few and a task's memory is bounded."""

    def run(batches):
        import pyarrow as pa

        def given():
            for (lang, source), (n, found) in held.items():
                if not n:
                    continue
                rows = len(n)
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                counts = [pa.array(list(n.values()), pa.int64()), pa.array([found[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), terms, *counts], names=["lang", "source", "term", "n", "docs"])

        held: dict[tuple, tuple[Counter, Counter]] = {}  # by group: occurrences, documents
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                words = (text.as_py() or b"").translate(_FOLD).split()
                was = len(n)
                n.update(words)
                found.update(set(words))
                size += len(n) - was
                if size >= HELD:
                    yield from given()
                    held, size = {}, 0
        yield from given()

    each = text_batches(docs.select("lang", "source", "text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_places(docs: DataFrame) -> DataFrame:
    """(lang, source, place): every occurring group and its place among the sources of its language, from 0."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # of distinct groups
    return docs.select("lang", "source").distinct().withColumn("place", place)


def term_vectors(counts: DataFrame, places: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, counts): a row for each kept term, ``counts`` by the source's place."""
    held = counts.join(places, ["lang", "source"]).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("held")
    )
    width = places.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("width"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("held", k - 1)["place"])
    filled = F.flatten(F.transform("held", lambda x, k: F.concat(zeros(x["place"] - before(k) - 1), F.array(x["n"]))))
    rest = zeros(F.col("width") - 1 - F.element_at("held", -1)["place"])
    return held.where(F.col("docs") >= least_docs).join(width, "lang").select("lang", "term", "total", F.concat(filled, rest).alias("counts"))


def wholes(vectors: DataFrame, places: DataFrame) -> DataFrame:
    """(lang, terms, whole, each): kept terms of a language, the denominator of its shares, and those of its sources by place."""
    sums = vectors.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("sum"))
    langs = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total"))
    groups = places.join(sums, ["lang", "place"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    smooth = PRIOR * F.coalesce("terms", zero)
    each = F.sort_array(F.collect_list(F.struct("place", (F.coalesce("sum", zero) + smooth).alias("whole"))))
    return groups.groupBy("lang").agg(F.first(F.coalesce("terms", zero)).alias("terms"), F.first(F.coalesce("total", zero) + smooth).alias("whole"), each.alias("each")).select(
        "lang", "terms", "whole", F.col("each.whole").alias("each")
    )


def term_shares(vectors: DataFrame, whole: DataFrame) -> DataFrame:
    """(lang, term, counts, p, q): shares by place, and that of the whole language."""
    return vectors.join(whole, "lang").select("lang", "term", "counts", F.zip_with("counts", "each", share).alias("p"), share(F.col("total"), F.col("whole")).alias("q"))


def pair_gaps(shares: DataFrame) -> DataFrame:
    """(lang, a, b, value) of places a < b: the gaps of two sources summed over all kept terms.

    A term's vector is opened source by source, so a row holds as many contributions as there are sources."""
    one = shares.select("lang", "p", F.posexplode("p").alias("a", "pa"))
    rest = F.slice("p", F.col("a") + 2, F.greatest(F.size("p") - F.col("a") - 1, F.lit(0)))
    given = F.transform(rest, lambda pb, k: F.struct((F.col("a") + 1 + k).alias("b"), gap(F.col("pa"), pb).alias("value")))
    return one.select("lang", "a", F.inline(given)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source, how far every other source of its language is
    (part ``pair``), and the ``top`` terms that it uses more than its language does (part ``term``)."""
    clean = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    places = stage(source_places(clean), "divergence-places")
    vectors = stage(term_vectors(term_counts(clean), places, least_docs), "divergence-vectors")
    shares = stage(term_shares(vectors, stage(wholes(vectors, places), "divergence-wholes")), "divergence-shares")

    summed = stage(pair_gaps(shares), "divergence-pairs")
    both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, other = places.toDF("lang", "source", "a"), places.toDF("lang", "item", "b")
    pairs = one.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")  # as many rows as the result
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))

    used = shares.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("place", "x")).where("x.counts > 0 and x.p > q")
    rows = used.select("lang", "place", F.col("term").alias("item"), gap(F.col("x.p"), F.col("q")).alias("value"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "place").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    terms = first.join(places, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
