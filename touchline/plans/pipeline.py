"""The data set from tables of collected pages, in eight stages, each stored before the next reads it.

Collection itself (browsers, requests) is outside; its results enter as tables.  ``build`` gives the
final tables by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bridge as B
from ..operators import fixtures as X
from ..operators import incremental as I
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import reports as P
from ..sources.tables import Store


def match_list(round_pages_matches: DataFrame, teams: DataFrame, playoffs: DataFrame) -> DataFrame:
    """Regular matches with the venue of the home team, then play-offs, in order.

    teams: (team_name, venue, ord); of several teams that fit, the one with the smallest ``ord`` counts."""
    regular = R.contains_join(round_pages_matches, "home_team", teams, "team_name", "venue", "ord", "Unknown")
    both = regular.withColumn("is_playoff", F.lit(0)).unionByName(playoffs.withColumn("is_playoff", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("match_id", F.col("match_id").cast("long")).orderBy("season", "round", "match_id")


def build(store: Store, t: dict[str, DataFrame], decisions: DataFrame | None = None, manual: dict[str, int] | None = None, reports: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """t: matches_list, regular_season_stats, playoff_stats, players (with ``ord``), venues, windows,
    player_callups, player_minutes, european_cup_dates, european_cup_teams, weather_responses.

    ``reports`` takes the figures of each table, by the jobs that store them; what must hold of a table is
    checked by the same job, which then fails."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, **figures) -> DataFrame:
        seen, report = P.observed(df, name, **figures)
        out[name] = store.stage(seen, name)
        if reports is not None:
            reports[name] = report.get
        return out[name]

    matches = t["matches_list"]
    players, conflicts = Q.dedup_players(t["players"], "ord")
    players = keep("players", players)
    keep("players_dedup_conflicts", conflicts)
    raw = keep("matches_stats_raw", P.checked(Q.merge_matches(t["regular_season_stats"], t["playoff_stats"], matches, X.SEASONS), F.col("season").isNull(), "a match without a season", "match_id"), **{f"n_{s}": F.sum((F.col("season") == s).cast("long")) for s in X.SEASONS})
    final, dropped = Q.drop_bad_rows(Q.drop_possession(raw))
    final, dropped = keep("matches_stats_final", final), keep("dropped_matches_log", dropped)
    keep("weather", X.weather(matches, final, t["venues"], t["weather_responses"]))
    calendar = keep("international_calendar", X.international_calendar(matches, final, t["windows"]))
    bridge = keep("bridge_built", B.build(t["player_callups"], players, "ord"))
    bridge = keep("bridge_manual", B.apply_manual(bridge, manual))
    keep("callup_review_queue", B.review_queue(bridge, t["player_callups"], players))
    if decisions is not None:
        bridge = B.apply_decisions(bridge, decisions)
    bridge = keep("callup_name_bridge", bridge, **P.unmatched("player_id"))
    keep("bridge_coverage", B.coverage(bridge))
    minutes = Q.null_out_silent(R.absent(t["player_minutes"], dropped, ["match_id"]))
    minutes = keep("player_minutes", minutes, missing_pct=P.share_of(F.col("minutes_played").isNull()))
    keep("player_minutes_incomplete_log", Q.incomplete_rosters(minutes, I.pending_minutes(matches, minutes.limit(0), dropped), minutes.select("match_id").limit(0)))
    keep("players_away", X.absence_coefficients(matches, minutes, calendar, t["player_callups"], bridge))
    keep("european_congestion", X.european_congestion(matches, final, t["european_cup_dates"], t["european_cup_teams"]))
    return out
