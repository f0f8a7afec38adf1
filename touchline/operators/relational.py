"""Relational operators that Spark has no single call for, used by plans and queries alike.

Each docstring names the inventory ids it covers.  Where row order matters ("first wins"), callers
pass an ordinal; nothing relies on the order in which Spark meets rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Broadcast hints are given only to sides that were counted and have at most so many rows.
SMALL_ROWS = 100_000
#: Windows of one key that a row may meet.
FEW_WINDOWS = 32


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; as it is, if not.

    The count stops after ``rows + 1`` rows, so it stays cheap on large tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# -- projections -----------------------------------------------------------------------------------
def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def columns_where(df: DataFrame, test) -> list[str]:
    """P5: names that pass a test."""
    return [c for c in df.columns if test(c)]


def set_where(df: DataFrame, mask: Column, **values: Column) -> DataFrame:
    """New values where the mask is true; false and unknown keep the old."""
    return df.withColumns({c: F.when(mask, v).otherwise(F.col(c)) for c, v in values.items()})


def non_null_count(columns: list[str]) -> Column:
    """A8."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))


def missing_list(columns: list[str], sep: str = ", ") -> Column:
    """The names of the columns that are null."""
    return F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull()), sep)


def sure(condition: Column) -> Column:
    """A condition that is false where it is unknown (NaN rules, SURVEY 1.4.1)."""
    return F.coalesce(condition, F.lit(False))


# -- keys and joins --------------------------------------------------------------------------------
def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def absent(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def present(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def left_with_count(left: DataFrame, right: DataFrame, keys: list[str], probe: str) -> tuple[DataFrame, DataFrame]:
    """The left join, and how many of its rows found nothing."""
    out = left.join(right, keys, "left")
    return out, out.agg(F.sum(F.col(probe).isNull().cast("long")).alias("unmatched"), F.count(F.lit(1)).alias("rows"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of rows with their key."""
    return absent(base, new, keys).unionByName(new, allowMissingColumns=True)


def map_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """A looked-up value, or the default."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def registry_merge(existing: DataFrame, new: DataFrame, key: str, order: str, keep_last: bool = False) -> DataFrame:
    """Union keyed by id; what exists wins, and of several that exist the first or the last."""
    tagged = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rank = F.when(F.col("_p") == 0, -F.col(order) if keep_last else F.col(order)).otherwise(F.col(order))
    return keep_first(tagged, [key], F.col("_p"), rank).drop("_p")


def contains_join(left: DataFrame, text: str, right: DataFrame, name: str, value: str, order: str, default: str) -> DataFrame:
    """The value of the first row (by ``order``) whose lower-case name contains the text.

    A name that contains a text has all its trigrams, so texts meet names by an equi-join on the rarest
    one they have and are compared then.  Texts under three characters, of which there can't be many
    different ones, are compared with each name as they are; null texts find nothing."""
    words = left.select(F.lower(text).alias("_word")).where("_word is not null").distinct()
    names = right.select(F.lower(name).alias("_name"), F.col(value).alias("_value"), F.col(order).alias("_ord"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, 3))))
    held = names.where(F.length("_name") >= 3).select("*", grams("_name").alias("_gram"))
    asked = words.where(F.length("_word") >= 3).select("_word", grams("_word").alias("_gram"))
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rare = asked.join(often, "_gram", "left").groupBy("_word").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    long = rare.join(held, "_gram").where(F.contains("_name", F.col("_word"))).select("_word", "_value", "_ord")
    short = small(words.where(F.length("_word") < 3))
    both = long.unionByName(names.join(short, F.contains(F.col("_name"), F.col("_word"))).select("_word", "_value", "_ord"))
    hit = both.groupBy("_word").agg(F.min_by("_value", "_ord").alias(value))
    return left.withColumn("_word", F.lower(text)).join(hit, "_word", "left").drop("_word").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def zip_by_position(left: DataFrame, right: DataFrame, keys: list[str], order_l: list, order_r: list) -> DataFrame:
    """The k-th left row of a key with its k-th right row, up to the shorter side."""
    number = lambda df, order: df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, order_l).join(number(right, order_r), [*keys, "pos"])


def pair_surplus_last(labels: DataFrame, rows: DataFrame, keys: list[str], order_l: list, order_r: list) -> DataFrame:
    """Like ``zip_by_position``, but surplus rows go to the last label."""
    w = Window.partitionBy(*keys)
    lab = labels.withColumns({"pos": F.row_number().over(w.orderBy(*order_l))})
    last = lab.groupBy(*keys).agg(F.max("pos").alias("_last"))
    num = rows.withColumn("_n", F.row_number().over(w.orderBy(*order_r))).join(last, keys)
    return num.withColumn("pos", F.least("_n", "_last")).drop("_n", "_last").join(lab, [*keys, "pos"])


# -- aggregates ------------------------------------------------------------------------------------
def mode_smallest(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """A4: the most frequent value, the smallest of several; nulls don't count."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(out))


def text_list(df: DataFrame, keys: list[str], value: str, out: str, sep: str = ";") -> DataFrame:
    """A5: distinct values, sorted and joined, with the number of rows."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(out), F.count(F.lit(1)).alias("n_rows"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and share of the total."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_all"))
    return c.join(F.broadcast(total), how="cross").select(key, "n", F.round(F.col("n") * 100.0 / F.col("_all"), 6).alias("pct"))  # one row


def before_in_order(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sum and count over strictly earlier values of ``order``; peers don't count.  A key is one task's, as
    a team's season or a player's; ``ordered.running_before`` is for keys of any length."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"sum_before": F.coalesce(F.sum(value).over(w), F.lit(0.0)), "n_before": F.count(value).over(w)})


def before_lookup(asked: DataFrame, history: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sum and count over the history strictly before each asked row, also for keys that have
    no row at that point.  Both are put on one line and summed in order, so a key with a long history
    is not multiplied by the rows that ask.  ``ordered.running_lookup`` is for keys of any length."""
    both = (
        history.groupBy(*keys, order)
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
        .withColumn("_ask", F.lit(False))
        .unionByName(asked.select(*keys, order).distinct().withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    )
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({"sum_before": F.coalesce(F.sum("_s").over(w), F.lit(0.0)), "n_before": F.coalesce(F.sum("_n").over(w), F.lit(0))})
    return asked.join(out.where("_ask").select(*keys, order, "sum_before", "n_before"), [*keys, order])


def shrunk_weight(total: Column, n: Column, prior: Column, k: int = 5, full: int = 80) -> Column:
    """The mean pulled towards the prior mean as if by k matches, as a share of a full match."""
    return F.when(prior.isNotNull(), (total + k * prior) / (n + k) / full).when(n > 0, total / n / full).otherwise(0.0)


# -- intervals and shapes --------------------------------------------------------------------------
def dyadic_nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The fewest dyadic stretches (level, at) that make up the whole numbers from ``lo`` to ``hi``, both included.

    A stretch of level l is 2^l numbers from at * 2^l on.  There are two at most for each level below ``levels``,
    and as many as are needed of that one, the longest that are used.  None if ``lo`` is above ``hi``."""
    both = []
    for level in range(levels + 1):
        # in stretches of this level: those inside the bounds, and those inside the next level's stretches
        first, last = F.ceil(lo / (1 << level)), F.floor((hi + 1) / (1 << level)) - 1
        node = lambda at: F.struct(F.lit(level).alias("level"), at.cast("long").alias("at"))  # noqa: B023, E731
        if level == levels:
            some = F.sequence(first, F.greatest(first, last))
            both.append(F.when(first <= last, F.transform(some, node)))
            continue
        odd, even = F.pmod(first, F.lit(2)) == 1, F.pmod(last, F.lit(2)) == 0
        both.append(F.when((first <= last) & odd, F.array(node(first))))
        both.append(F.when((first <= last) & even & ~(odd & (first == last)), F.array(node(last))))
    none = F.array().cast("array<struct<level:int,at:bigint>>")
    return F.concat(*[F.coalesce(x, none) for x in both])


def flag_in_window(rows: DataFrame, day: str, windows: DataFrame, keys: list[str], lo: str, hi: str, out: str, width: int = 16, most: int = FEW_WINDOWS) -> DataFrame:
    """1 if a window of the same keys covers the row's day, both ends included, else 0.

    Windows of a key that has ``most`` at most travel together: rows meet them by their keys, once, and days are
    compared there.  Days of keys with more windows go by stretches (``_covered_days``), so no row meets more than
    ``most`` windows.  Null bounds, null days and null keys cover nothing."""
    spans = windows.select(*keys, F.unix_date(lo).alias("_lo"), F.unix_date(hi).alias("_hi")).where("_lo <= _hi").distinct()
    counts = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    many = counts.where(F.col("_n") > most)
    if many.isEmpty():
        few = spans
    else:
        many = many.select(*keys)
        few = spans.join(many, keys, "left_anti")
    packed = few.groupBy(*keys).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_w"))
    at = F.unix_date(day)
    inside = sure(F.exists("_w", lambda w: at.between(w["_lo"], w["_hi"])))
    flagged = rows.join(packed, keys, "left").withColumn(out, inside.cast("int")).drop("_w")
    if few is spans:
        return flagged
    hot = _covered_days(rows.join(many, keys, "left_semi"), day, spans.join(many, keys, "left_semi"), keys, width)
    hit = hot.select(*keys, F.col("_day").alias(day), F.lit(1).alias("_hit"))
    return flagged.join(hit, [*keys, day], "left").withColumn(out, F.coalesce("_hit", out)).drop("_hit")


def _covered_days(rows: DataFrame, day: str, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The different (keys, _day) of rows that a span (keys, _lo, _hi) covers.

    Days fall into stretches of ``width``.  A window's first and last stretch meet their days by key and stretch,
    and days are compared there; the whole stretches between are cut into dyadic ones, two for each doubling of
    the window's length, and a day belongs to one of each level.  So every join is an equi-join, a short window is
    two rows, and a window of any length a bounded number.  Levels go as far as the longest window, up to 2^15
    stretches."""
    longest = spans.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    stretch = lambda c: F.floor(c / width).cast("long")
    spans = spans.withColumns({"_a": stretch(F.col("_lo")), "_b": stretch(F.col("_hi"))})
    asked = rows.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day")).distinct().withColumn("_at", stretch(F.unix_date("_day")))
    ends = spans.select(*keys, "_lo", "_hi", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_at"))
    met = asked.join(ends, [*keys, "_at"]).where(F.unix_date("_day").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_day")
    if longest >= width + 2:  # else no window holds a whole stretch between its ends
        levels = min(15, max(0, int(longest // width).bit_length() - 1))
        inner = spans.where("_b - _a > 1").select(*keys, F.inline(dyadic_nodes(F.col("_a") + 1, F.col("_b") - 1, levels))).distinct()
        above = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("_at"), k).alias("at")) for k in range(levels + 1)])
        met = met.unionByName(asked.select(*keys, "_day", F.inline(above)).join(inner, [*keys, "level", "at"], "left_semi").select(*keys, "_day"))
    return met.distinct()


def ranked(df: DataFrame, lead: dict[str, tuple[Column, str]], order: list, out: str = "rank") -> DataFrame:
    """Each row's place in a total order, without a task that holds the table: by the columns of ``lead``
    (name: value and its direction, a ``Column`` method), then by ``order`` among rows that agree there.

    Places are the rows of earlier leads, counted over the few leads, and the place inside the lead."""
    names = list(lead)
    tagged = df.withColumns({n: v for n, (v, _) in lead.items()})
    by = [getattr(F.col(n), how)() for n, (_, how) in lead.items()]
    before = Window.partitionBy(F.lit(0)).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))
    start = small(counts.select(*[F.col(n).alias(f"{n}_") for n in names], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")))
    inside = tagged.withColumn("_in", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
    return inside.join(start, same).withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).select(*df.columns, out)


def unpivot_flags(df: DataFrame, ids: list[str], flags: list[str], name: str) -> DataFrame:
    """One row for each flag that is 1."""
    return df.unpivot(ids, flags, name, "_on").where(F.col("_on").cast("int") == 1).drop("_on")


def pivot_flags(df: DataFrame, keys: list[str], name: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each value."""
    one = df.withColumn("_one", F.lit(1))
    return one.groupBy(*keys).pivot(name, values).agg(F.max("_one")).fillna(0, subset=[str(v) for v in values])


def sides(df: DataFrame, keep: list[str], home: str, away: str, name: str = "team") -> DataFrame:
    """A row for each side of a match."""
    both = F.inline(F.array(F.struct(F.lit("home").alias("side"), F.col(home).alias(name)), F.struct(F.lit("away").alias("side"), F.col(away).alias(name))))
    return df.select(*keep, both)


def split_list(df: DataFrame, column: str, out: str, sep: str = ";") -> DataFrame:
    """A row for each item of a joined list; empty items go."""
    return df.withColumn(out, F.explode(F.filter(F.split(F.col(column), sep), lambda x: x != "")))


def conflicts(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """``df`` with ``_n`` (rows of its key) and ``_clash`` (some row differs from the key's first)."""
    w = Window.partitionBy(key)
    first = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.first(c).over(first)) for c in values], F.lit(False))
    marked = df.withColumn("_d", differs.cast("int"))
    return marked.withColumns({"_n": F.count(F.lit(1)).over(w), "_clash": F.max("_d").over(w) == 1}).drop("_d")


def require(bad: DataFrame, message: str) -> None:
    """Raise with a few of the offending rows if there are any."""
    rows = bad.limit(10).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")
