"""Fixture features: international calendar, European congestion, absence coefficients, weather, form.

(N5-N7, N10, W6, F26.)  Every function takes DataFrames and returns one row for each round or match;
the rules it has to share with other data sets stand as fixed values at the top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.scratch import new_folder, staged
from . import relational as R

#: Seasons in order; competitions and their flag columns; days around a window; the
#: rounds that a world cup takes whatever its dates; days around a European match.
SEASONS = ["2021-2022", "2022-2023", "2023-2024", "2024-2025", "2025-2026"]
FLAGS = {
    "Rugby Championship": "rugby_championship",
    "End of Year Internationals": "autumn_matches",
    "6 Nations": "6nations",
    "Pacific Cup": "pacific_cup",
    "World cup": "world_cup",
}
DAYS_BEFORE, DAYS_AFTER = 14, 7
FIXED_ROUNDS = {("2023-2024", "world_cup"): [1, 2, 3]}
EUROPE_DAYS = 7
FULL_SIDE = 15


def season_table(spark) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SEASONS)], "season string, season_idx int")


def with_dates(matches: DataFrame, stats: DataFrame) -> DataFrame:
    """Matches with ``day``, null where the date is missing or can't be read."""
    dates = R.keep_first(stats.select("match_id", "match_date"), ["match_id"], F.col("match_date").asc_nulls_last())
    return matches.join(dates, "match_id", "left").withColumn("day", S.safe_date(F.col("match_date")))


def missing_dates(dated: DataFrame) -> DataFrame:
    """Per season the sorted ids without a date."""
    return dated.where("day is null").groupBy("season").agg(F.sort_array(F.collect_list("match_id")).alias("match_ids"))


def international_calendar(matches: DataFrame, stats: DataFrame, windows: DataFrame) -> DataFrame:
    """(season, round, five 0/1 flags): does a match day of the round fall into the days around a
    window of the season?  Unknown competitions and windows without both dates count for nothing; the
    fixed rounds replace the dates of their season and competition where it has a window."""
    flags = list(FLAGS.values())
    name = F.create_map(*[F.lit(x) for kv in FLAGS.items() for x in kv])
    w = windows.withColumns({"flag": F.try_element_at(name, F.col("competition")), "lo": F.date_sub(S.safe_date(F.col("start_date").cast("string")), DAYS_BEFORE), "hi": F.date_add(S.safe_date(F.col("end_date").cast("string")), DAYS_AFTER)}).where("flag is not null")
    fixed = F.lit(False)
    for season, flag in FIXED_ROUNDS:
        fixed = fixed | ((F.col("season") == season) & (F.col("flag") == flag))
    rounds = matches.select("season", F.col("round").cast("int").alias("round")).distinct()
    days = with_dates(matches, stats).where("day is not null").select("season", F.col("round").cast("int").alias("round"), "day").distinct()
    span = w.where(~fixed & (F.col("lo") <= F.col("hi"))).select("season", "flag", F.explode(F.sequence("lo", "hi")).alias("day")).distinct()
    by_date = days.join(span, ["season", "day"]).select("season", "round", "flag")
    table = [(s, f, r) for (s, f), rs in FIXED_ROUNDS.items() for r in rs]
    rule = matches.sparkSession.createDataFrame(table, "season string, flag string, round int")
    by_rule = rule.join(w.where(fixed).select("season", "flag").distinct(), ["season", "flag"]).select("season", "round", "flag")
    hit = by_date.unionByName(by_rule).distinct()
    wide = R.pivot_flags(hit, ["season", "round"], "flag", flags)
    return rounds.join(wide, ["season", "round"], "left").fillna(0, subset=flags).select("season", "round", *flags)


def european_days(dates: DataFrame, teams: DataFrame) -> DataFrame:
    """(team, season, day) of the matchdays that a team plays; ids in either spelling."""
    teams = teams.toDF(*[c.strip() for c in teams.columns]).withColumn("team_name", F.trim("team_name"))
    ids = R.columns_where(teams, lambda c: c != "team_name")
    long = R.unpivot_flags(teams, ["team_name"], ids, "id").withColumn("id", S.matchday_id(F.col("id")))
    when = dates.select(S.matchday_id(F.col("id")).alias("id"), "season", S.safe_date(F.col("date").cast("string")).alias("day"))
    return long.join(when, "id").where("day is not null").select(F.col("team_name").alias("team"), "season", "day").distinct()


def european_congestion(matches: DataFrame, stats: DataFrame, dates: DataFrame, teams: DataFrame) -> DataFrame:
    """Per match and side 1 if the side plays in Europe within seven days; 0 without dates."""
    base = with_dates(matches, stats)
    europe = european_days(dates, teams).withColumns({"lo": S.shift_days(F.col("day"), -EUROPE_DAYS), "hi": S.shift_days(F.col("day"), EUROPE_DAYS)}).drop("day")
    two = R.sides(base, ["match_id", "season", "day"], "home_team", "away_team").withColumn("team", F.trim("team"))
    flagged = R.flag_in_window(two, "day", europe, ["team", "season"], "lo", "hi", "busy")
    wide = flagged.groupBy("match_id").agg(F.max(F.when(F.col("side") == "home", F.col("busy"))).alias("home_euro_congestion"), F.max(F.when(F.col("side") == "away", F.col("busy"))).alias("away_euro_congestion"))
    out = matches.join(wide, "match_id", "left").fillna(0, subset=["home_euro_congestion", "away_euro_congestion"])
    return out.select("match_id", "season", "round", "home_team", "away_team", "home_euro_congestion", "away_euro_congestion")


def congestion_report(congestion: DataFrame) -> DataFrame:
    """A10: flagged sides, and whether a play-off match is among them."""
    both = F.col("home_euro_congestion") + F.col("away_euro_congestion")
    return congestion.agg(F.sum("home_euro_congestion").alias("home"), F.sum("away_euro_congestion").alias("away"), F.max(((F.col("round") > 26) & (both > 0)).cast("int")).alias("any_playoff"))


def absences(matches: DataFrame, minutes: DataFrame, calendar: DataFrame, callups: DataFrame, bridge: DataFrame, null_minutes: str = "skip") -> DataFrame:
    """One row (match_id, player_id, side, weight, path) for each called-up player who misses a match.

    J4-J8, J16-J19, A3, A4, A11.  ``null_minutes``: ``skip`` leaves unknown minutes out of sums and
    counts; ``propagate`` lets one unknown make the player's weight unknown, and counts its row."""
    matches = matches.withColumns({c: F.trim(c) for c in ("home_team", "away_team")})
    minutes = minutes.withColumn("team", F.trim("team"))
    flags = list(FLAGS.values())
    back = F.create_map(*[F.lit(x) for k, v in FLAGS.items() for x in (v, k)])
    live = R.unpivot_flags(calendar, ["season", "round"], flags, "flag").withColumn("competition", F.element_at(back, F.col("flag")))
    called = callups.join(bridge.where("player_id is not null").select("player_name", F.col("player_id").cast("long").alias("player_id")), "player_name")
    called = called.select("player_id", "season", "competition").distinct()
    here = matches.select("match_id", "season", F.col("round").cast("int").alias("round"), "home_team", "away_team")
    cand = here.join(live.select("season", F.col("round").cast("int").alias("round"), "competition"), ["season", "round"]).join(called, ["season", "competition"]).drop("competition").distinct()
    cand = R.absent(cand, minutes, ["player_id", "match_id"])

    played = minutes.join(here.select("match_id", "season", "round"), "match_id", "left").where("season is not null")
    in_season = R.mode_smallest(played, ["player_id", "season"], "team", "team_s")
    overall = R.mode_smallest(minutes, ["player_id"], "team", "team_o")
    cand = cand.join(in_season, ["player_id", "season"], "left").join(overall, "player_id", "left").withColumn("team", F.coalesce("team_s", "team_o"))
    side = F.when(F.col("team") == F.col("home_team"), "home").when(F.col("team") == F.col("away_team"), "away")
    cand = cand.withColumn("side", side).where("side is not null").select("match_id", "player_id", "season", "round", "side")

    value = F.col("minutes_played").cast("double")
    if null_minutes == "propagate":
        value = F.coalesce(value, F.lit(float("nan")))
    history = played.withColumn("m", value)
    seen = R.before_lookup(cand, history, ["player_id", "season"], "round", "m")
    index = R.small(season_table(matches.sparkSession))
    mean = F.avg(F.when(~F.isnan("m"), F.col("m")))
    prior = history.groupBy("player_id", "season").agg(mean.alias("prior")).join(index, "season").select("player_id", (F.col("season_idx") + 1).alias("season_idx"), "prior")
    known = seen.join(index, "season", "left").join(prior, ["player_id", "season_idx"], "left")
    weight = R.shrunk_weight(F.col("sum_before"), F.col("n_before"), F.col("prior"))
    path = F.when(F.col("prior").isNotNull(), "shrinkage").when(F.col("n_before") > 0, "fallback_current").otherwise("fallback_zero")
    return known.select("match_id", "player_id", "side", weight.alias("weight"), path.alias("path"))


def absence_coefficients(matches: DataFrame, minutes: DataFrame, calendar: DataFrame, callups: DataFrame, bridge: DataFrame, null_minutes: str = "skip") -> DataFrame:
    """The weights of a side's absentees over a full side, 0.0 without any."""
    a = absences(matches, minutes, calendar, callups, bridge, null_minutes)
    per = a.groupBy("match_id").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("weight"))), F.lit(0.0)).alias(f"_{s}") for s in ("home", "away")])
    out = matches.join(per, "match_id", "left")
    return out.select("match_id", "season", "round", "home_team", "away_team", *[(F.coalesce(f"_{s}", F.lit(0.0)) / FULL_SIDE).alias(f"{s}_absence_coefficient") for s in ("home", "away")])


HOURLY = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("temperature_2m", "relativehumidity_2m", "precipitation", "rain", "windspeed_10m", "cloudcover", "is_day")]
            ),
        )
    ]
)
WEATHER = {"temperature_2m": "temperature", "relativehumidity_2m": "humidity", "precipitation": "precipitation", "rain": "rain", "windspeed_10m": "wind_speed", "cloudcover": "cloud_cover", "is_day": "is_day"}


def with_venue(matches: DataFrame, venues: DataFrame) -> DataFrame:
    """Coordinates by the trimmed venue; the venues' names are taken as they are."""
    v = R.small(venues.select(F.col("stadium_name").alias("_venue"), "latitude", "longitude"))
    return matches.join(v, F.trim(matches["venue"]) == F.col("_venue"), "left").drop("_venue")


def weather(matches: DataFrame, stats: DataFrame, venues: DataFrame, responses: DataFrame) -> DataFrame:
    """The hour of kick-off from each match's JSON response (match_id, body); matches
    without coordinates, response or that hour have no row.

    Both joins are merged: the planner judges responses by the files that they come from, and they may be many times longer."""
    at = with_venue(matches, venues).where("latitude is not null and longitude is not null").join(stats.select("match_id", "match_date", "match_time").hint("merge"), "match_id")
    both = at.select("match_id", S.hour_key(F.col("match_date"), F.col("match_time")).alias("_key")).join(responses.select("match_id", "body").hint("merge"), "match_id")
    both = both.withColumn("_h", F.from_json("body", HOURLY)["hourly"]).withColumn("_i", F.array_position(F.col("_h.time"), F.col("_key")).cast("int"))
    return both.where("_i > 0").select("match_id", *[F.try_element_at(F.col(f"_h.{k}"), F.col("_i")).alias(v) for k, v in WEATHER.items()])


def form_and_rest(results: DataFrame, n: int = 3) -> DataFrame:
    """Per team and match the mean points of the last n matches and the days since the last one.

    results: (team, season, day, match_id, points)."""
    w = Window.partitionBy("team", "season").orderBy("day", "match_id")
    return results.select("team", "season", "match_id", "day", F.avg("points").over(w.rowsBetween(-n, -1)).alias("form"), F.datediff("day", F.lag("day").over(w)).alias("rest_days"))


def league_position(results: DataFrame) -> DataFrame:
    """Rank by points won strictly before each round.  results: (team, season, round, points)."""
    before = R.before_in_order(results, ["team", "season"], "round", "points")
    w = Window.partitionBy("season", "round").orderBy(F.col("sum_before").desc(), "team")
    return before.withColumn("position", F.row_number().over(w)).drop("n_before")


def elo(matches: DataFrame, k: float = 20.0, start: float = 1500.0, carry: bool = False) -> DataFrame:
    """(season, match_id, home_elo, away_elo, wave), ratings before each match; with ``carry`` they go on from
    season to season.  matches: (season, match_id, day, home_team, away_team, home_score, away_score).

    Matches are rated in waves: one may be rated when it is the next of both its teams, so a wave is all matches
    that wait for none of each other, however many seasons and leagues there are, and there are as many waves as
    matches of the busiest team, or more where teams wait for each other.  A wave joins its matches to the ratings
    of their teams and stores both.  Unknown scores change nothing; matches of one day go by number; unknown days
    come last, unknown teams are one team; a team that meets itself has the away side's rating afterwards."""
    spark = matches.sparkSession
    within = F.lit("all") if carry else F.col("season")
    m = matches.select(within.alias("_of"), "season", "match_id", "day", "home_team", "away_team", "home_score", "away_score").withColumn("_sides", F.array("home_team", "away_team"))
    turn = Window.partitionBy("_of", "_team").orderBy(F.asc_nulls_last("day"), "match_id")
    sides = m.select("*", F.posexplode("_sides").alias("_side", "_team")).withColumn("_turn", F.dense_rank().over(turn))
    own = ["_of", "season", "match_id", "day", "home_team", "away_team", "home_score", "away_score"]
    m = staged(sides.groupBy(*own).agg(F.max(F.when(F.col("_side") == 0, F.col("_turn"))).alias("_h"), F.max(F.when(F.col("_side") == 1, F.col("_turn"))).alias("_a")), "elo-matches")
    won = 0.5 + 0.5 * (F.signum((F.col("home_score") - F.col("away_score")).cast("double")))
    gain = F.coalesce(k * (won - 1 / (1 + F.pow(F.lit(10.0), (F.col("away_elo") - F.col("home_elo")) / 400))), F.lit(0.0))
    ratings = spark.createDataFrame([], f"_of {m.schema['_of'].dataType.simpleString()}, _team {m.schema['home_team'].dataType.simpleString()}, _elo double, _played int")
    root, left, wave = new_folder(spark, "elo"), m.count(), 0
    while left:
        wave += 1
        out = m.where(F.greatest("_h", "_a") <= wave)
        for team, rating, played in (("home_team", "home_elo", "_hp"), ("away_team", "away_elo", "_ap")):
            now = ratings.select(F.col("_of").alias("_o"), F.col("_team").alias("_t"), F.col("_elo").alias(rating), F.col("_played").alias(played))
            out = out.join(now, out["_of"].eqNullSafe(F.col("_o")) & out[team].eqNullSafe(F.col("_t")), "left").drop("_o", "_t")
        out = out.where((F.col("_h") == F.coalesce("_hp", F.lit(0)) + 1) & (F.col("_a") == F.coalesce("_ap", F.lit(0)) + 1))
        out = out.withColumns({r: F.coalesce(r, F.lit(start)) for r in ("home_elo", "away_elo")}).withColumn("_gain", gain)
        out.select("_of", "season", "match_id", "home_team", "away_team", "home_elo", "away_elo", "_gain", "_h", "_a").write.parquet(f"{root}/wave={wave}")
        done = spark.read.parquet(f"{root}/wave={wave}")
        rated = done.count()
        if not rated:
            raise RuntimeError(f"{left} matches wait for each other")
        left -= rated
        after = F.inline(F.array(F.struct(F.lit(1).alias("_s"), F.col("home_team").alias("_team"), (F.col("home_elo") + F.col("_gain")).alias("_elo"), F.col("_h").alias("_played")), F.struct(F.lit(0).alias("_s"), F.col("away_team").alias("_team"), (F.col("away_elo") - F.col("_gain")).alias("_elo"), F.col("_a").alias("_played"))))
        new = done.select("_of", after).withColumn("_old", F.lit(0)).unionByName(ratings.withColumns({"_old": F.lit(1), "_s": F.lit(0)}))
        ratings = staged(R.keep_first(new, ["_of", "_team"], F.col("_old"), F.col("_s")).select("_of", "_team", "_elo", "_played"), "elo-ratings")
    if not wave:
        return m.select("season", "match_id", F.lit(start).alias("home_elo"), F.lit(start).alias("away_elo"), F.lit(0).alias("wave"))
    return spark.read.option("basePath", root).parquet(root).select("season", "match_id", "home_elo", "away_elo", "wave")


def travel(matches: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """kilometres from the away team's ground to the venue."""
    ground = R.small(teams.select(F.col("team_name").alias("away_team"), F.col("venue").alias("_own")))
    v = venues.select(F.trim("stadium_name").alias("_name"), "latitude", "longitude")
    to = R.small(v.select(F.col("_name").alias("_to"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2")))
    home = R.small(v.select(F.col("_name").alias("_own"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1")))
    out = matches.join(ground, "away_team", "left").join(home, "_own", "left").join(to, F.trim("venue") == F.col("_to"), "left")
    return out.select("match_id", S.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("travel_km"))
