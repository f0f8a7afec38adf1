"""The name bridge and its review loop (N1-N4): call-up names to player ids, by tiers in strict order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.scratch import staged
from . import relational as R

COLUMNS = ["player_name", "player_id", "match_method", "candidate_player_ids", "likely_cause", "callup_rows"]
#: Causes, methods, entries made by hand.
AMBIGUOUS = "normalized name maps to >=2 player_ids"
FIRST_LAST_MANY = "first+last match, multiple candidates"
SURNAME_ONE = "surname match, forename differs (single candidate; nickname/initial/spelling)"
SURNAME_MANY = "surname match, multiple namesakes"
NO_SURNAME = "no surname overlap in players.csv (likely never contracted to a Top 14 club)"
REVIEWED = [SURNAME_ONE, SURNAME_MANY]
MANUAL = {"Lopeti Timani": 11434, "Sonatane Takulua": 86}
MANUAL_METHOD = "manual_entry_profile_removed"
MANUAL_NOTE = "LNR profile page 302-removed; matched directly from player_minutes.csv (Top 14 apps) + player_callups.csv (call-ups)"
METHODS = ["exact", "normalized", "normalized_extended", "manual_review", MANUAL_METHOD, "ambiguous", "unmatched"]
MATCHED = METHODS[:5]


def _held(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Key columns with the number of ids that have them, and the only one if there is one."""
    rows = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n_{kind}"), F.min("player_id").alias(f"_id_{kind}"))


def build(callups: DataFrame, players: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each distinct non-null call-up name.  ``order``: the players' ordinal; without
    one, ids order them.  Players without an id are no candidates.

    Tiers are decided by counts, which are combined on the map side; lists of candidates are made only for those
    keys whose names report them, so a common surname costs its list once and not its square."""
    p = players.where("player_id is not null").withColumn("player_id", F.col("player_id").cast("long")).withColumn("_ord", F.col(order) if order else F.col("player_id"))
    forms = {"_n": N.norm_of(F.col("_plain")), "_t": N.norm_of(F.col("_plain"), "")}
    p = p.withColumn("_plain", N.plain(F.col("full_name"))).withColumns(forms)
    first, last = N.first_last(F.col("_n"))
    p = staged(p.select("full_name", "player_id", "_ord", "_n", "_t", first.alias("_f"), last.alias("_l"), last.alias("_s")), "bridge-players")  # read six times
    exact = p.where("full_name is not null").groupBy(F.col("full_name").alias("player_name")).agg(F.max_by("player_id", "_ord").alias("_exact"))
    keys = {"norm": ["_n"], "tight": ["_t"], "pair": ["_f", "_l"], "sur": ["_s"]}

    names = callups.where("player_name is not null").groupBy("player_name").agg(F.count(F.lit(1)).cast("int").alias("callup_rows"))
    names = names.withColumn("_plain", N.plain(F.col("player_name"))).withColumns(forms).drop("_plain")
    f, l = N.first_last(F.col("_n"))
    names = names.withColumns({"_f": f, "_l": l, "_s": F.try_element_at(N.tokens(F.col("_n")), F.lit(-1))})
    j = names.join(exact, "player_name", "left")
    for kind, by in keys.items():
        j = j.join(_held(p, by, kind), by, "left")
    n = {kind: F.coalesce(F.col(f"_n_{kind}"), F.lit(0)) for kind in keys}
    only = lambda kind: F.col(f"_id_{kind}")
    none_id = F.lit(None).cast("long")
    tiers = [  # test, id, method, whose candidates are listed, cause
        (F.col("_exact").isNotNull(), F.col("_exact"), "exact", None, ""),
        (n["norm"] == 1, only("norm"), "normalized", None, ""),
        (n["norm"] > 1, none_id, "ambiguous", "norm", AMBIGUOUS),
        (n["tight"] == 1, only("tight"), "normalized", None, ""),
        (n["pair"] == 1, only("pair"), "normalized_extended", None, ""),
        (n["pair"] > 1, none_id, "unmatched", "pair", FIRST_LAST_MANY),
        (n["sur"] == 1, none_id, "unmatched", "sur", SURNAME_ONE),
        (n["sur"] > 1, none_id, "unmatched", "sur", SURNAME_MANY),
        (F.lit(True), none_id, "unmatched", None, NO_SURNAME),
    ]
    key = {kind: F.array(*by) for kind, by in keys.items()}
    verdict = None
    for test, pid, method, listed, cause in tiers:
        of = F.struct(F.lit(listed).alias("kind"), key[listed].alias("key")) if listed else F.lit(None).cast("struct<kind:string,key:array<string>>")
        s = F.struct(pid.alias("player_id"), F.lit(method).alias("match_method"), of.alias("_of"), F.lit(cause).alias("likely_cause"))
        verdict = F.when(test, s) if verdict is None else verdict.when(test, s)
    decided = j.select("player_name", "callup_rows", verdict.alias("_v")).select("player_name", "_v.*", "callup_rows")
    decided = decided.withColumns({"_kind": F.col("_of.kind"), "_key": F.col("_of.key")}).drop("_of")
    decided = staged(decided, "bridge-decided")  # read twice
    wanted = decided.where("_kind is not null").select("_kind", "_key").distinct()
    has = F.array(*[F.struct(F.lit(kind).alias("_kind"), key[kind].alias("_key")) for kind in ("norm", "pair", "sur")])
    rows = p.select("player_id", "_ord", F.inline(has)).where(~F.exists("_key", lambda x: x.isNull())).join(wanted, ["_kind", "_key"], "left_semi")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "player_id"))), lambda x: x["player_id"].cast("string"))
    lists = rows.groupBy("_kind", "_key").agg(F.array_join(ids, ";").alias("_list"))
    out = decided.join(lists, ["_kind", "_key"], "left").withColumn("candidate_player_ids", F.coalesce("_list", F.lit("")))
    return out.select(*COLUMNS)


def apply_manual(bridge: DataFrame, entries: dict[str, int] | None = None) -> DataFrame:
    """Assertions by hand; raises if a name is not in the bridge; twice is the same as once."""
    entries = MANUAL if entries is None else entries
    spark = bridge.sparkSession
    table = spark.createDataFrame(list(entries.items()), "player_name string, _id long")
    R.require(table.join(bridge, "player_name", "left_anti").select("player_name"), "names absent from the bridge")
    hit = F.col("_id").isNotNull()
    new = {"player_id": F.col("_id"), "match_method": F.lit(MANUAL_METHOD), "candidate_player_ids": F.col("_id").cast("string"), "likely_cause": F.lit(MANUAL_NOTE)}
    return R.set_where(bridge.join(F.broadcast(table), "player_name", "left"), hit, **new).select(*COLUMNS)  # a table made by hand


def review_queue(bridge: DataFrame, callups: DataFrame, players: DataFrame) -> DataFrame:
    """A row for each candidate of the names that only share a surname, with what a reviewer needs."""
    lists = {"int_window_ids": "int_window_id", "seasons": "season", "competitions": "competition"}
    about = callups.groupBy("player_name").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(a) for a, c in lists.items()], F.count(F.lit(1)).cast("int").alias("n_callup_rows"))
    queue = bridge.where(F.col("likely_cause").isin(REVIEWED))
    queue = R.split_list(queue.withColumn("n_candidates", F.size(F.filter(F.split("candidate_player_ids", ";"), lambda x: x != ""))), "candidate_player_ids", "_c").withColumn("candidate_player_id", F.col("_c").cast("long"))
    teams = R.columns_where(players, lambda c: c.endswith("_team"))
    clubs = F.concat_ws("; ", *[F.when(F.col(c).isNotNull(), F.concat(F.col(c), F.lit(f" ({c.removesuffix('_team')})"))) for c in teams])
    info = players.where("player_id is not null").select(F.col("player_id").cast("long").alias("candidate_player_id"), F.col("full_name").alias("candidate_full_name"), F.col("nationality").alias("candidate_nationality"), F.when(clubs == "", "(no Top 14 club in players.csv)").otherwise(clubs).alias("candidate_clubs"))
    info = R.keep_first(info, ["candidate_player_id"], F.col("candidate_full_name").asc_nulls_last())
    out = queue.join(about, "player_name").join(info, "candidate_player_id", "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("candidate_full_name", "candidate_nationality", "candidate_clubs")}
    out = out.withColumns(blank).withColumn("decision", F.lit(""))
    columns = ["player_name", *lists, "n_callup_rows", "likely_cause", "n_candidates", "candidate_player_id", *blank, "decision"]
    return out.select(*columns).orderBy(F.col("n_callup_rows").desc(), "player_name", "candidate_player_id")


def apply_decisions(bridge: DataFrame, queue: DataFrame) -> DataFrame:
    """``y`` gives the id; other names of the queue that are still unmatched are marked as
    rejected, once.  Raises on unknown tokens, two ``y`` for a name, and names the bridge lacks."""
    q = queue.withColumn("_d", F.lower(F.trim(F.coalesce("decision", F.lit("")))))
    R.require(q.where(~F.col("_d").isin("y", "n", "?", "")).select("_d").distinct(), "unexpected decisions")
    yes = q.where("_d = 'y'")
    R.require(yes.groupBy("player_name").count().where("count > 1"), "more than one y for a name")
    R.require(q.join(bridge, "player_name", "left_anti").select("player_name").distinct(), "names absent from the bridge")
    chosen = yes.select("player_name", F.col("candidate_player_id").cast("long").alias("_id"))
    seen = q.select("player_name").distinct().withColumn("_seen", F.lit(True))
    b = bridge.join(chosen, "player_name", "left").join(seen, "player_name", "left")
    cause = F.coalesce("likely_cause", F.lit(""))
    rejected = F.col("_seen").isNotNull() & F.col("_id").isNull() & (F.col("match_method") == "unmatched") & ~F.startswith(cause, F.lit("manual review:"))
    hit = F.col("_id").isNotNull()
    return b.select(
        "player_name",
        F.when(hit, F.col("_id")).otherwise(F.col("player_id")).alias("player_id"),
        F.when(hit, "manual_review").otherwise(F.col("match_method")).alias("match_method"),
        F.when(hit, F.col("_id").cast("string")).otherwise(F.col("candidate_player_ids")).alias("candidate_player_ids"),
        F.when(hit, "").when(rejected, F.concat(F.lit("manual review: rejected (was: "), cause, F.lit(")"))).otherwise(F.col("likely_cause")).alias("likely_cause"),
        "callup_rows",
    )


def coverage(bridge: DataFrame) -> DataFrame:
    """Names and rows of each method, with shares, in the fixed order of methods."""
    spark = bridge.sparkSession
    order = spark.createDataFrame([(i, m) for i, m in enumerate(METHODS)], "_o int, match_method string")
    per = bridge.groupBy("match_method").agg(F.count(F.lit(1)).alias("names"), F.sum("callup_rows").alias("rows"))
    total = per.agg(F.sum("names").alias("_n"), F.sum("rows").alias("_r"))
    out = per.join(F.broadcast(order), "match_method").join(F.broadcast(total), how="cross")  # seven rows, one row
    return out.select("match_method", "names", F.round(F.col("names") / F.col("_n"), 6).alias("name_share"), "rows", F.round(F.col("rows") / F.col("_r"), 6).alias("row_share"), "_o").orderBy("_o").drop("_o")
