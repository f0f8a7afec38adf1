"""Quality rules and deduplication with quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import relational as R

META = ["match_id", "match_date", "match_time", "season", "round"]


def tag_bad_rows(df: DataFrame, meta: list[str] | None = None, zero_pair: tuple[str, str] = ("home_passes", "away_passes")) -> DataFrame:
    """``reason``: missing_data if under half of the statistics are there; else all_zero_stats if both
    of the pair are 0; else null.  An unknown pair is no zero pair."""
    stats = R.columns_where(df, lambda c: c not in (META if meta is None else meta))
    thin = R.non_null_count(stats) < len(stats) * 0.5
    zero = R.sure((F.col(zero_pair[0]) == 0) & (F.col(zero_pair[1]) == 0))
    return df.withColumn("reason", F.when(thin, "missing_data").when(zero, "all_zero_stats"))


def drop_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, log of match_id, season, round, reason)."""
    tagged = tag_bad_rows(df)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null").select("match_id", "season", "round", "reason")


def drop_possession(df: DataFrame) -> DataFrame:
    """P2."""
    return df.drop(*R.columns_where(df, lambda c: "possession" in c))


def merge_matches(regular: DataFrame, playoff: DataFrame, matches: DataFrame, seasons: list[str]) -> DataFrame:
    """Both statistics tables with season and round, the known seasons only."""
    both = regular.unionByName(playoff, allowMissingColumns=True)
    return both.join(matches.select("match_id", "season", "round"), "match_id", "left").where(F.col("season").isin(seasons))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids with more than one row, and how many rows are too many."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def dedup_players(players: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(players, conflicts).  Rows of one id that agree in all but their address fold into the
    first; rows that disagree all stay and are also reported.  Rows without an id pass through."""
    p = players.withColumn("player_id", S.player_id(F.col("player_url")).cast("long"))
    values = R.columns_where(p, lambda c: c not in ("player_url", "player_id", order))
    known = R.conflicts(p.where("player_id is not null"), "player_id", order, values)
    clash = known.where("_clash").drop("_n", "_clash")
    safe = R.keep_first(known.where("not _clash").drop("_n", "_clash"), ["player_id"], F.col(order))
    return safe.unionByName(clash).unionByName(p.where("player_id is null")), clash


def null_out_silent(minutes: DataFrame) -> DataFrame:
    """Where all minutes of a team in a match are 0 or unknown, they are unknown."""
    w = Window.partitionBy("match_id", "team")
    return minutes.withColumn("minutes_played", F.when(F.max(F.coalesce("minutes_played", F.lit(0))).over(w) == 0, None).otherwise(F.col("minutes_played")))


def incomplete_rosters(minutes: DataFrame, matches: DataFrame, known: DataFrame) -> DataFrame:
    """Teams whose minutes are all unknown, and matches without any row; null teams are a group."""
    silent = minutes.groupBy("match_id", "team").agg(F.count("minutes_played").alias("_k"), F.count(F.lit(1)).alias("n_players_affected")).where("_k = 0").select("match_id", "team", F.lit("all_zero_tempsJeu").alias("reason"), "n_players_affected")
    gone = R.absent(matches.select("match_id").distinct(), minutes, ["match_id"]).select("match_id", F.lit(None).cast("string").alias("team"), F.lit("section_missing").alias("reason"), F.lit(0).cast("long").alias("n_players_affected"))
    seen = known.select("match_id").distinct().withColumn("previously_known", F.lit(True))
    return silent.unionByName(gone).join(seen, "match_id", "left").withColumn("previously_known", F.coalesce("previously_known", F.lit(False)))
