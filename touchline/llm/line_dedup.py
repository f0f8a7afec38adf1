"""Line dedup (operator 1): exact and one-edit duplicate lines, by a deletion-neighbourhood join.

Native: DataFrame and SQL functions only.

* A line is a ``\\n``-separated piece of a text; it is compared after ``trim``.  Lines under
  ``min_chars`` characters are never touched.
* A line's place is (doc_id, text, line number), the text told apart by its hash only where an id is
  null or repeated; null doc_ids come last.  A later line goes if an earlier
  line equals it or is one edit (insert, delete or substitute one character) away from it.
* Two lines are one edit apart iff they share a deletion variant: both lose the same position
  (substitution), or one is the other less a character (insertion).  So each group of equal variants
  needs only its earliest place: no pairs are made, and a group of distinct lines around one variant
  is bounded by the alphabet times the line's length, never by the number of rows.
* Before variants are emitted, lines that can have no partner are set aside without loss: of two
  lines one edit apart the heads or the tails (of the shorter's half at most) are equal, so a line
  whose ends nobody shares has no partner.  Of those that share one, two that are one edit apart are
  equal but for one of eight parts (cut by the shorter length): variants lose characters of it only.
* Lines meet their verdict only if a mask says that they are repeated or near; the others move once,
  as hashes, to be counted.

Edge cases: null or empty texts stay as they are; exact repeats of a row (doc_id and text, a null id
too) count as the same place and get the same result; rows that share an id but not the text are
documents of their own, as are rows with null ids; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import box, drop_stage, in_mask, mask_of, stage, unbox

MIN_CHARS = 20
PARTS = 8
_LAST = 9223372036854775807


_STEP = "cast(2147483648 as decimal(10,0))"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, key): key is in order of the doc_id, null ids last, one for each doc_id and text."""
    rows = docs.select(box(docs), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    ids = stage(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "line-ids")
    # ranks of the texts of a repeated id, by hash; null ids, which may be very many, take the hash itself
    digest = F.xxhash64("text")
    if ids.isEmpty():
        ranked = rows.withColumn("rank", F.lit(0))
    else:
        mask = stage(mask_of(ids, "id"), "line-ids-mask")
        some = in_mask(rows, mask, "id").withColumn("digest", digest)
        ranks = some.join(ids, "id", "left_semi").select("id", "digest").distinct()
        ranks = stage(ranks.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("digest"))), "line-ranks")
        ranked = some.join(ranks, ["id", "digest"], "left").select(*rows.columns, "rank")
        ranked = ranked.unionByName(in_mask(rows, mask, "id", outside=True), allowMissingColumns=True)
    low = F.when(F.col("id").isNull(), F.lit(2147483648).cast("decimal(20,0)") + F.shiftrightunsigned(digest, 1)).otherwise(F.coalesce("rank", F.lit(0)).cast("decimal(20,0)"))
    key = F.coalesce("id", F.lit(_LAST)).cast("decimal(20,0)") * F.expr(_STEP) + low
    return ranked.select("row", "text", key.cast("decimal(29,0)").alias("key"))


def _place(key, line_no):
    return (key * F.expr(_STEP) + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _hashes(column: str, a: str, b: str) -> dict:
    """Two hashes of a column of which neither follows from the other."""
    return {a: F.xxhash64(column), b: F.xxhash64(F.lit(1), column)}


def _lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    """(place, line, h1, h2) of the lines that take part."""
    cut = keyed.select("key", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    line = cut.select(_place(F.col("key"), F.col("no")).alias("place"), F.trim("raw").alias("line")).where(F.length("line") >= min_chars)
    return line.withColumns(_hashes("line", "h1", "h2"))


def _ends(line, size) -> tuple:
    """(cut, head, tail): hashes of both ends of a line, half of ``size`` each at most.  The cut keeps the first four bits
    of the half only, so it is mostly alike for ``size`` and ``size - 1``."""
    half = F.shiftright(size, 1)
    cut = half - F.pmod(half, F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(half)) - 4)).cast("int"))
    return cut, F.xxhash64(cut, F.lit("head"), F.substring(line, F.lit(1), cut)), F.xxhash64(cut, F.lit("tail"), F.right(line, cut))


def _but_parts(line, n) -> Column:
    """Hashes of a line without one of its ``PARTS`` parts; first it is cut by its length, then as the longer of a pair."""
    keys = []
    for size in (n, n - 1):
        at = [F.floor(size * i / PARTS).cast("int") for i in range(PARTS + 1)]
        keys += [F.xxhash64(size, F.lit(i), F.substring(line, F.lit(1), at[i]), F.right(line, size - at[i + 1])) for i in range(PARTS)]
    return F.array(*keys)


def _part(n, which) -> tuple:
    """(start, end) of what the key ``which`` of ``_but_parts`` leaves out: in the longer of a pair a character more."""
    longer, i = F.floor(which / PARTS).cast("int"), F.pmod(which, F.lit(PARTS))
    start, end = [F.floor((n - longer) * at / PARTS).cast("int") for at in (i, i + 1)]
    return start, end + longer


def _sharing(rows: DataFrame, keys: Column, name: str) -> DataFrame:
    """(h1, h2, which): the distinct lines that share a key with another line, and its place among their ``keys``, an array.

    Keys are counted by themselves, eight bytes each; only lines that the mask of shared keys lets through meet them."""
    each = rows.select("h1", "h2", F.posexplode(keys).alias("which", "k")).where("k is not null")
    shared = stage(each.groupBy("k").count().where("count > 1").select("k"), f"{name}-keys")
    some = in_mask(each, stage(mask_of(shared, "k"), f"{name}-mask"), "k")
    return some.join(shared, "k", "left_semi").select("h1", "h2", "which")


def _among(lines: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """The lines that may be among ``hashes``, by a mask of either hash; while these aren't full, one in some hundred others gets through."""
    for h in ("h1", "h2"):
        lines = in_mask(lines, stage(mask_of(hashes, h), f"{name}-{h}"), h)
    return lines


def near_lines(keyed: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(repeated, near): the first place of each line that occurs more than once; distinct lines with an
    earlier one-edit partner, verified by edit distance, with that partner's place as ``witness``."""
    lines = _lines(keyed, min_chars)
    n = F.length("line")
    cut, head, tail = _ends(F.col("line"), n)
    less, less_head, less_tail = _ends(F.col("line"), n - 1)  # the line as the longer of a pair
    ends = {"k0": head, "k1": tail, "k2": F.when(less != cut, less_head), "k3": F.when(less != cut, less_tail)}
    own = lines.select("place", "h1", "h2", *[k.alias(name) for name, k in ends.items()])
    first = stage(own.groupBy("h1", "h2", *ends).agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times")), "line-first")
    repeated = stage(first.where("times > 1").select("h1", "h2", "place"), "line-repeated")

    may = stage(_sharing(first, F.array(*ends), "line-may").select("h1", "h2").distinct(), "line-may")
    drop_stage(first)
    few = _among(lines, may, "line-may")  # most lines end here, unshuffled
    likely = few.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("line").alias("line"))
    likely = stage(likely.join(may, ["h1", "h2"], "left_semi"), "line-likely")
    close = _sharing(likely, _but_parts(F.col("line"), n), "line-close").groupBy("h1", "h2").agg(F.collect_set("which").alias("parts"))
    close = stage(close, "line-close")
    texts = stage(_among(likely, close, "line-close").join(close, ["h1", "h2"]), "line-text")
    drop_stage(likely)

    start, end = _part(n, F.col("which"))
    gone = texts.withColumn("which", F.explode("parts")).where(start < end)
    gone = gone.select("h1", "h2", "place", "line", F.explode(F.sequence(start + 1, end)).alias("at"))
    variant = F.concat(F.substring("line", F.lit(1), F.col("at") - 1), F.substring("line", F.col("at") + 1, F.length("line")))
    gone = gone.select("h1", "h2", "place", "at", variant.alias("v"))
    gone = gone.withColumns(_hashes("v", "v1", "v2")).select("v1", "v2", "at", "h1", "h2", "place")
    whole = texts.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.lit(0).alias("at"), "h1", "h2", "place")
    group, same = Window.partitionBy("v1", "v2"), Window.partitionBy("v1", "v2", "at")
    at = F.col("at")
    seen = gone.unionByName(whole).withColumns(
        {
            "longer": F.min(F.when(at > 0, F.col("place"))).over(group),
            "shorter": F.min(F.when(at == 0, F.col("place"))).over(group),
            "alike": F.min("place").over(same),
        }
    )
    witness = F.when(at == 0, F.col("longer")).otherwise(F.least("shorter", "alike"))
    found = seen.select("h1", "h2", "place", witness.alias("witness")).where("witness < place")
    found = found.groupBy("h1", "h2").agg(F.min("witness").alias("witness"))
    other = texts.select(F.col("place").alias("witness"), F.col("line").alias("other"), F.col("h1").alias("o1"))
    near = (
        texts.join(found, ["h1", "h2"])
        .join(other, "witness")
        .where((F.col("h1") != F.col("o1")) & (F.levenshtein("line", "other", 1) >= 0))
        .groupBy("h1", "h2")
        .agg(F.min("witness").alias("witness"))
    )
    return repeated, stage(near, "line-near")


def dropped_lines(keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, line_no, reason): reason ``exact`` or ``near``, one row per document line that goes."""
    repeated, near = near_lines(keyed, min_chars)
    either = repeated.select("h1", "h2", F.col("place").alias("start"), F.lit(False).alias("is_near"))
    either = either.unionByName(near.select("h1", "h2", F.lit(True).alias("is_near")), allowMissingColumns=True)
    verdict = stage(either.groupBy("h1", "h2").agg(F.max("start").alias("start"), F.max("is_near").alias("is_near")), "line-verdict")
    own = _among(_lines(keyed, min_chars).select("place", "h1", "h2"), verdict, "line-verdict")  # the others stay
    tagged = own.join(verdict, ["h1", "h2"])
    out = tagged.where("place > start or is_near")
    return out.select(
        F.expr(f"cast(floor((place - pmod(place, {_STEP})) / {_STEP}) as decimal(29,0))").alias("key"),
        F.expr(f"cast(pmod(place, {_STEP}) as int)").alias("line_no"),
        F.when(F.col("place") > F.col("start"), "exact").otherwise("near").alias("reason"),
    ).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: tuple[str, str] | None = ("_exact", "_near")) -> DataFrame:
    """``docs`` with duplicate lines out of its text; ``counts`` names two columns that say how many went.

    Lines that stay keep their characters, order and separators; a text whose lines all go is empty."""
    keyed = _keyed(docs, id_col, text_col)
    of = lambda reason: F.sum((F.col("reason") == reason).cast("long")).alias(reason)
    gone = stage(dropped_lines(keyed, min_chars).groupBy("key").agg(F.collect_set("line_no").alias("gone"), of("exact"), of("near")), "line-gone")
    # only texts that lose lines are shuffled, unsorted, and alike at every size
    mask = stage(mask_of(gone, "key"), "line-gone-mask")
    keyed, old = keyed.drop("text"), F.col("row").getField(text_col)
    joined = in_mask(keyed, mask, "key").join(gone.hint("shuffle_hash"), "key", "left").unionByName(in_mask(keyed, mask, "key", outside=True), allowMissingColumns=True)
    kept = F.filter(F.split(old, "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(kept, "\n"))
    went = [F.coalesce(c, F.lit(0).cast("long")).alias(name) for c, name in zip(("exact", "near"), counts or ())]
    return joined.select(*unbox(docs.columns, **{text_col: text}), *went)
