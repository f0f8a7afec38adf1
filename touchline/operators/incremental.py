"""Batch forms of what is kept up to date: retries, failure counts, logs, registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import quality as Q
from . import relational as R

#: Statuses, the matches known to have no statistics, when a person has to look.
DEAD, OPEN = "confirmed_no_data", "timeout_unverified"
DEAD_MATCHES = [9922, 11057, 11795, 11796, 11797, 11798, 11800]
REVIEW_AT = 3
CRITICAL = ["match_date", "match_time", "home_score", "away_score", "home_tries", "away_tries", "home_possession", "away_possession"]


def incomplete_matches(stats: DataFrame, verified_empty: str = "verified_empty") -> DataFrame:
    """Matches that lack a critical field, with the fields, how many came, and the status."""
    t = stats.withColumn("missing_fields", R.missing_list(CRITICAL)).where("missing_fields <> ''")
    fields = [c for c in stats.columns if c not in ("season", "round", verified_empty)]
    status = F.when(R.sure(F.col(verified_empty)), DEAD).otherwise(OPEN)
    return t.select("match_id", "season", "round", "missing_fields", R.non_null_count(fields).alias("fields_scraped"), status.alias("status"))


def backfill(incomplete: DataFrame, matches: DataFrame) -> DataFrame:
    """Season, round and status for rows from before those columns were kept."""
    if "season" not in incomplete.columns or "round" not in incomplete.columns:
        incomplete = incomplete.drop("season", "round").join(matches.select("match_id", "season", "round"), "match_id", "left")
    if "status" not in incomplete.columns:
        incomplete = incomplete.withColumn("status", F.lit(None).cast("string"))
    guess = F.when(S.is_known(F.col("match_id").cast("string"), DEAD_MATCHES), DEAD).otherwise(OPEN)
    return incomplete.withColumn("status", F.coalesce("status", guess))


def retry_pass(main: DataFrame, incomplete: DataFrame, results: DataFrame, still: DataFrame, include_dead: bool = False) -> tuple[DataFrame, DataFrame]:
    """(main, incomplete) after one attempt.  ``results`` and ``still`` are what it gave.

    Only open matches are tried, unless dead ones are asked for.  A match succeeds if it has a result
    and is not incomplete again; one that gave neither keeps its old row.  Those tried and not done
    take this attempt's status; the others keep theirs."""
    tried = incomplete.where(F.col("status").isin([OPEN, DEAD] if include_dead else [OPEN])).select("match_id").distinct()
    won = R.absent(R.present(results, tried, ["match_id"]).select("match_id").distinct(), still, ["match_id"])
    new_main = R.upsert(main, R.present(results, won, ["match_id"]), ["match_id"])
    left = R.absent(incomplete, won, ["match_id"]).join(tried.withColumn("_tried", F.lit(True)), "match_id", "left").join(still.select("match_id", F.col("status").alias("_now")), "match_id", "left")
    status = F.when(F.col("_tried"), F.coalesce("_now", F.lit(OPEN))).otherwise(F.col("status"))
    return new_main, left.withColumn("status", status).select(*incomplete.columns)


def retry_until_done(main: DataFrame, incomplete: DataFrame, attempt: Callable, passes: int = 3, include_dead: bool = False, save: Callable = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """Up to ``passes`` attempts, fewer when nothing is left to try.  ``attempt(ids)`` gives
    (results, still incomplete); ``save(df, name)`` stores a pass's tables and reads them back."""
    for k in range(passes):
        todo = incomplete.where(F.col("status").isin([OPEN, DEAD] if include_dead else [OPEN]))
        if todo.isEmpty():
            break
        main, incomplete = retry_pass(main, incomplete, *attempt(todo.select("match_id").distinct()), include_dead)
        main, incomplete = save(main, f"main-{k}"), save(incomplete, f"incomplete-{k}")
    return main, incomplete


def fail_counts(attempts: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """Failures since the last success; ids whose last attempt succeeded have no row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = attempts.withColumn("_run", F.sum((~F.col(failed)).cast("int")).over(w))
    per = runs.groupBy(key).agg(F.max("_run").alias("_last")).join(runs, key).where("_run = _last")
    out = per.groupBy(key).agg(F.sum(F.col(failed).cast("int")).cast("int").alias("fail_count")).where("fail_count > 0")
    return out.withColumn("status", review_status(F.col("fail_count")))


def review_status(count):
    return F.when(count >= REVIEW_AT, "manual_review_needed").otherwise("timeout")


def bump_failures(known: DataFrame, attempts: DataFrame, key: str = "player_id") -> DataFrame:
    """T3, incrementally: counts so far and one round of attempts (key, ok) to the counts after it."""
    both = known.select(key, "fail_count").join(attempts.select(key, "ok"), key, "full_outer")
    count = F.when(F.col("ok").isNull(), F.col("fail_count")).when(F.col("ok"), None).otherwise(F.coalesce("fail_count", F.lit(0)) + 1)
    return both.select(key, count.cast("int").alias("fail_count")).where("fail_count is not null").withColumn("status", review_status(F.col("fail_count")))


def carry_log(old: DataFrame, new: DataFrame, keys: list[str], first_by: str) -> DataFrame:
    """T4: the old log and the new findings, the last of equal keys; what is new comes first."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    return R.keep_first(both, keys, F.col("_g").desc()).drop("_g").orderBy(F.col(first_by).asc_nulls_first(), *keys)


def pending_profiles(registry: DataFrame, done: DataFrame, failures: DataFrame) -> DataFrame:
    """Addresses still to read: not done, and not waiting for a person."""
    todo = R.absent(registry.withColumn("player_id", S.player_id(F.col("player_url")).cast("long")), done, ["player_id"])
    return R.absent(todo, failures.where("status = 'manual_review_needed'"), ["player_id"])


def pending_minutes(matches: DataFrame, done: DataFrame, dropped: DataFrame) -> DataFrame:
    """Matches whose minutes are still to read: neither dropped nor there."""
    return R.absent(R.absent(matches, dropped, ["match_id"]), done, ["match_id"])


def gap_list(registry: DataFrame, players: DataFrame) -> DataFrame:
    """Ids that the registry has and the players table lacks, by number."""
    return R.absent(registry, players, ["player_id"]).select("player_id").distinct().orderBy(F.col("player_id").cast("long"))


def profile_run(registry: DataFrame, players: DataFrame, failures: DataFrame, read: Callable) -> tuple[DataFrame, DataFrame]:
    """(players, failures) after one run over the addresses that are still to read.

    ``read(todo)`` gives a row for each address tried: player_id, reason (null if it was read) and the
    profile's columns.  New profiles are appended with the table's columns, missing ones null; a profile
    that is there stays as it is.  A failure counts one up and a success takes the player off the list."""
    tried = read(pending_profiles(registry, players, failures))
    got = R.keep_first(tried.where("reason is null"), ["player_id"], F.col("player_id"))
    # columns that only the new profiles have are kept too
    wide = R.absent(got, players, ["player_id"]).drop("reason")
    attempts = tried.groupBy("player_id").agg(F.max(F.col("reason").isNull()).alias("ok"))
    return players.unionByName(wide, allowMissingColumns=True), bump_failures(failures, attempts)


def minutes_run(matches: DataFrame, minutes: DataFrame, dropped: DataFrame, log: DataFrame, read: Callable) -> tuple[DataFrame, DataFrame]:
    """(minutes, log) after one run over the matches whose minutes are still to read.

    ``read(todo)`` gives rows (match_id, player_id, team, minutes_played).  Teams whose minutes are all 0
    or unknown are unknown; they and matches without a row go to the log (match_id, team, reason,
    n_players_affected, previously_known), where what is new takes the place of what was known."""
    todo = pending_minutes(matches, minutes, dropped)
    rows = Q.null_out_silent(read(todo))
    found = Q.incomplete_rosters(rows, todo, log)
    return minutes.unionByName(rows), carry_log(log, found, ["match_id", "team"], "match_id")
