"""Mixing sources to target weights (operator 6): a low-discrepancy source schedule.

Native: DataFrame and SQL functions only.

* Targets: sources by code point, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words; none is
  above 3 times its source's words, the excess goes to the others by weight (water filling, in closed
  form over the table of sources).
* Each source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks
  of equal numbers of words (``block_words``, rounded so that blocks fill the source).
* Slot t of the schedule takes the golden-ratio point frac((t + 1) * phi) through the sources'
  cumulative block weights; the k-th slot of a source takes its block k modulo its number of blocks.
  Sources whose slots came short get the missing ones at the end, surplus slots fall away, and the
  last slot is cut where the target is met.  So a pass over a source ends before the next begins, and
  no document exceeds 3 times its size.

Skew: a hot source is ranked and summed in chunks (slots by number, documents by hash), then chunk
totals are added up, so no window holds a source.  Points meet sources in equal cells of the unit
interval, an equi-join that low-discrepancy points fill evenly.

Edge cases: null texts have size 0 and take nothing; a source without words has target 0; null
doc_ids and repeated rows are documents of their own (rows that agree in id and text share their
place in the shuffle and take alike up to the words that are left), also where only an id repeats; an
empty table gives no rows; other columns, whatever their names, pass through ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, box, stage, unbox

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 512
PHI = 0.6180339887498949
CHUNK = 16384  # slots of a source that are ranked together
DOCS_EACH = 400  # documents of a source that are, or the root of their number
CELLS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    # by falling room for each unit of weight: those before a row are full when the row is
    ranked = every.orderBy(F.expr("cap / weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.withColumns(
        {
            "all_words": F.sum("source_size").over(every),
            "left_w": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero),
            "full": F.coalesce(F.sum("cap").over(before), zero),
        }
    )
    # the row fills up iff its share of what the fuller ones leave reaches its cap
    s = s.withColumn("fills", (F.col("all_words") - F.col("full")) * F.col("weight") >= F.col("cap") * F.col("left_w"))
    s = s.withColumns(
        {
            "cap_sum": F.sum(F.when(F.col("fills"), F.col("cap")).otherwise(zero)).over(every),
            "w_sum": F.sum(F.when(F.col("fills"), zero).otherwise(F.col("weight"))).over(every),
        }
    )
    share = (F.col("all_words") - F.col("cap_sum")).cast("double") * F.col("weight").cast("double") / F.col("w_sum").cast("double")
    return s.select("source", "n_docs", "source_size", F.when(F.col("fills"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _ranked(rows: DataFrame, source: str, chunk: str, order: list, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the source before this one, in chunk order then ``order``.

    Two steps, so that no task needs a whole source: inside chunks, then over the chunks' totals."""
    rows = rows.withColumn("_v", value)
    total = rows.groupBy(source, chunk).agg(F.sum("_v").alias("_t"))
    zero = F.lit(0).cast("long")
    ahead = Window.partitionBy(source).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col(source).alias("_s"), F.col(chunk).alias("_c"), F.coalesce(F.sum("_t").over(ahead), zero).alias("_before"))
    inside = Window.partitionBy(source, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), zero))
    joined = rows.join(total, rows[source].eqNullSafe(total["_s"]) & (rows[chunk] == total["_c"]))
    return joined.withColumn(out, F.col("_before") + F.col("_in")).drop("_v", "_in", "_s", "_c", "_before")


def source_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Targets with blocks: n_blocks, want (words to take), n_slots (slots that hold them)."""
    t = targets(sizes)
    n_blocks = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")
    t = t.withColumn("n_blocks", n_blocks).withColumn("want", F.round("target").cast("long"))
    # words from the start of the stream to the end of slot k: whole passes, then blocks of the last
    passes, rest = F.expr("want div greatest(source_size, 1)"), F.expr("want % greatest(source_size, 1)")
    slots = passes * F.col("n_blocks") + F.when(rest > 0, F.ceil(rest * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    return t.withColumn("n_slots", F.when(F.col("source_size") == 0, 0).otherwise(slots).cast("long"))


def schedule(spark, plan: DataFrame) -> DataFrame:
    """(slot, source_no, rank): which source each slot takes, and how many it took before."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    s = plan.where("n_slots > 0").withColumn("hi", F.sum("n_slots").over(order)).withColumn("total", F.sum("n_slots").over(every))
    s = s.select("source_no", "n_slots", "total", ((F.col("hi") - F.col("n_slots")) / F.col("total")).alias("lo_x"), (F.col("hi") / F.col("total")).alias("hi_x"))
    total = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    x = F.expr(f"(id + 1) * {PHI}D - floor((id + 1) * {PHI}D)")
    points = spark.range(total).select(F.col("id").alias("slot"), x.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo_x") * CELLS), F.least(F.floor(F.col("hi_x") * CELLS), F.lit(CELLS - 1).cast("long")))))
    hit = points.join(cells, "cell").where("x >= lo_x and x < hi_x").select("slot", "source_no", "n_slots", F.expr(f"slot div {CHUNK}").alias("chunk"))
    hit = _ranked(hit, "source_no", "chunk", ["slot"], F.lit(1).cast("long"), "rank").where("rank < n_slots").select("slot", "source_no", "rank")
    got = hit.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    short = plan.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < n_slots")
    late = short.select(F.col("source_no"), F.explode(F.sequence(F.col("got"), F.col("n_slots") - 1)).alias("rank"))
    return hit.unionByName(late.select((F.lit(total) + F.col("rank")).alias("slot"), "source_no", "rank"))


def _shuffle_key(id_col: str, text_col: str, seed: int) -> Column:
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.md5(F.concat(ident, F.lit(f"/{seed}")))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(documents with what the mix takes of them, the schedule (source_no, rank, slot))."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _shuffle_key(id_col, text_col, seed).alias("key"), words_in(F.col(text_col)).alias("size"))
    sized = stage(sized, "mix-sizes")
    numbered = source_plan(sized, block_words).withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())).cast("long"))
    plan = stage(numbered, "mix-plan")

    # a source has many chunks if it is hot, and neither they nor their totals grow beyond a task's reach
    chunks = f"(n_docs div greatest({DOCS_EACH}, cast(sqrt(n_docs) as bigint)) + 1)"
    doc = sized.join(plan.select(F.col("source").alias("_src"), "source_no", "source_size", "n_docs", "n_blocks", "want", "target"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    doc = _ranked(doc.withColumn("chunk", F.expr(f"(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {chunks}) div 4294967296")), "source_no", "chunk", ["key", "size"], F.col("size"), "start")

    slots = stage(schedule(spark, plan), "mix-slots")
    turns = slots.join(plan.select("source_no", "source_size", "n_blocks", "want"), "source_no")
    # block b holds the words [b * size div n, (b + 1) * size div n) of the stream
    turns = turns.select(
        "source_no",
        "slot",
        F.expr("rank % n_blocks").alias("block"),
        F.expr("(rank div n_blocks) * source_size").alias("passed"),
        "want",
        F.expr("((rank % n_blocks) * source_size) div n_blocks").alias("b_lo"),
        F.expr("((rank % n_blocks + 1) * source_size) div n_blocks").alias("b_hi"),
    )
    cut = F.least(F.col("b_hi"), F.col("want") - F.col("passed"))
    blocks = turns.where(cut > F.col("b_lo")).groupBy("source_no", "block").agg(
        F.sum((cut == F.col("b_hi")).cast("long")).alias("whole"),
        F.max(F.when(cut < F.col("b_hi"), cut)).alias("to"),
        F.min("b_lo").alias("b_lo"),
        F.min("b_hi").alias("b_hi"),
        F.min("slot").alias("slot"),
    )
    first, last = F.expr("((start + 1) * n_blocks - 1) div source_size"), F.expr("((start + size) * n_blocks - 1) div source_size")
    parts = doc.where("size > 0").select("doc_id", "key", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    parts = parts.join(blocks, ["source_no", "block"])
    lo, hi = F.greatest("start", "b_lo"), F.least(F.col("start") + F.col("size"), F.col("b_hi"))
    words = F.col("whole") * (hi - lo) + F.greatest(F.least(hi, F.coalesce("to", lo)) - lo, F.lit(0).cast("long"))
    taken = parts.withColumn("_words", words).groupBy("source_no", "key", "start").agg(F.sum("_words").alias("_taken"), F.min(F.when(F.col("_words") > 0, F.col("slot"))).alias("_slot"))
    # rows without words share their start with the next row and take nothing
    out = doc.join(taken, ["source_no", "key", "start"], "left").withColumns({"taken": F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long"), "first_block": F.when(F.col("size") > 0, first)})
    out = out.withColumn("first_slot", F.when(F.col("taken") > 0, F.col("_slot")))
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "taken", "start", "first_slot", "source_no", "n_blocks", "first_block"), slots


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken, start, first_slot).

    ``taken`` is the words the mix takes of the document, repeats counted; ``first_slot`` the slot of the
    schedule where it first takes some, null if it takes none."""
    out, _ = _mix(docs, id_col, text_col, source_col, seed, block_words)
    return out.drop("source_no", "n_blocks", "first_block")


def mixed_documents(docs: DataFrame, seed: int = 0, order: str | None = None) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as it is taken whole, and
    once more with its first words only where the mix takes part of it.

    Words of a part are joined by single spaces.  ``order`` names one more column: the slot of the
    schedule where a copy begins; the rows sorted by it are the mix in its order."""
    plan, slots = _mix(docs, "doc_id", "text", "source", seed, BLOCK_WORDS)
    # rows that agree in id, source and size are one kind; each gets the kind's takings in turn
    take = F.struct("taken", "n_blocks", "first_block", "source_no")
    kind = plan.where("taken > 0").groupBy("key", F.col("source").alias("src"), "size").agg(F.sort_array(F.collect_list(take), asc=False).alias("takes"))
    rows = docs.select(box(docs), _shuffle_key("doc_id", "text", seed).alias("k"), F.col("source").alias("s"), words_in(F.col("text")).alias("n"))
    turn = F.row_number().over(Window.partitionBy("k", "s", "n").orderBy(F.col("row").getField("text")))
    full = rows.withColumn("turn", turn).join(kind, (F.col("k") == F.col("key")) & F.col("s").eqNullSafe(F.col("src")) & (F.col("n") == F.col("size")))
    full = full.withColumn("take", F.try_element_at("takes", F.col("turn"))).where("take.taken > 0")
    copies = full.select("row", "take", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(take.taken - 1) div size"))).alias("copy"))
    left = F.least(F.col("size"), F.col("take.taken") - F.col("copy") * F.col("size"))
    own = F.col("row").getField("text")
    part = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), left.cast("int")), " ")
    text = F.when(left == F.col("size"), own).otherwise(part)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    if order is None:
        return copies.select(*unbox(docs.columns, **new))
    turns = slots.select(F.col("source_no").alias("no"), "rank", F.col("slot").alias("at"))
    begins = F.col("copy") * F.col("take.n_blocks") + F.col("take.first_block")
    return copies.join(turns, (F.col("take.source_no") == F.col("no")) & (begins == F.col("rank")), "left").select(*unbox(docs.columns, **new), F.col("at").alias(order))
