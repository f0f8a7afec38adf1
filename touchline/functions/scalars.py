"""Scalar functions as Column expressions: ids, dates, numbers, bonus points.

All null-safe: a null or unparsable input gives null unless said otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NULL_TEXT = ""


def first_group(text: Column, regex: str, group: int = 1) -> Column:
    """The group's text at the first match; null, not '', without one."""
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(NULL_TEXT))


def player_id(url: Column) -> Column:
    """the number in ``/joueur/<id>-``."""
    return first_group(url, r"/joueur/(\d+)-")


def match_id(url: Column) -> Column:
    """the number in ``/j<round>/<id>-``, else ``Unknown``."""
    return F.coalesce(first_group(url, r"/j\d+/(\d+)-"), F.lit("Unknown"))


def iso_date(text: Column) -> Column:
    """the first dd/mm/yyyy as yyyy-mm-dd."""
    part = lambda g: first_group(text, r"(\d{2})/(\d{2})/(\d{4})", g)
    return F.when(part(1).isNotNull(), F.concat_ws("-", part(3), part(2), part(1)))


def kickoff(text: Column) -> Column:
    """the first 9h05 or 19h05 as HH:MM."""
    hour, minute = (first_group(text, r"(\d{1,2})h(\d{2})", g) for g in (1, 2))
    return F.when(hour.isNotNull(), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def score(text: Column) -> tuple[Column, Column]:
    """the first two whole numbers; both null if there are fewer."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    ok = F.size(found) >= 2
    return tuple(F.when(ok, F.try_element_at(found, F.lit(i)).try_cast("int")) for i in (1, 2))


def percent(text: Column) -> Column:
    """``56,x %`` style text, cut to a whole number towards zero."""
    return F.trim(F.regexp_replace(text, "%", "")).try_cast("double").cast("int")


def digits(text: Column) -> Column:
    """the digits of a text as a number; null without any."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(NULL_TEXT)).try_cast("int")


def season_start(season: Column) -> Column:
    return F.element_at(F.split(season, "-"), 1).try_cast("int")


def bonus_points(season: Column, home: Column, away: Column, home_tries: Column, away_tries: Column) -> tuple[Column, Column]:
    """one point for three tries more than the other side; one for losing by little (5 points from
    2023 on, 7 before).  0, 0 where a number is missing."""
    known = home.isNotNull() & away.isNotNull() & home_tries.isNotNull() & away_tries.isNotNull()
    close = F.abs(home - away) <= F.when(season_start(season) >= 2023, 5).otherwise(7)

    def side(own: Column, other: Column, tries: Column, others: Column) -> Column:
        points = (tries >= others + 3).cast("int") + (close & (own < other)).cast("int")
        return F.coalesce(F.when(known, points), F.lit(0))

    return side(home, away, home_tries, away_tries), side(away, home, away_tries, home_tries)


def matchday_id(text: Column) -> Column:
    """``21_22-R5`` and ``21_22_R5`` alike as ``21_22_R5``; anything else trimmed."""
    return F.regexp_replace(F.trim(text), r"^(\d{2}_\d{2})[-_]R(\d+)$", "$1_R$2")


def plain(text: Column) -> Column:
    """trimmed, lower case."""
    return F.lower(F.trim(text.cast("string")))


def squad_name(text: Column) -> Column:
    """F16: a name without what follows a bracket and without closing stars."""
    return F.trim(F.regexp_replace(F.trim(F.element_at(F.split(text, r"\("), 1)), r"\*+$", ""))


def safe_date(text: Column) -> Column:
    """a date, null where it can't be read."""
    return text.try_cast("date")


def shift_days(day: Column, days: int) -> Column:
    """F17."""
    return F.date_add(day, days)


def hour_key(day: Column, time: Column) -> Column:
    """``yyyy-mm-ddTHH:00``, the hour in which a match starts."""
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(F.element_at(F.split(time, ":"), 1), 2, "0"), F.lit(":00"))


def absolute_url(url: Column, base: str) -> Column:
    """F21."""
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def page_url(url: Column, page: str) -> Column:
    """A page below a match's address."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"), F.lit(page))


def squads_url(url: Column, competition: Column) -> Column:
    """The squads page of a 6 Nations overview page."""
    bare = F.regexp_replace(url, "/+$", "")
    six = plain(competition).isin("6 nations", "six nations") & F.contains(url, F.lit("Six_Nations_Championship")) & ~F.endswith(url, F.lit("_squads"))
    return F.when(F.coalesce(six, F.lit(False)), F.concat(bare, F.lit("_squads"))).otherwise(url)


def before_bar(text: Column) -> Column:
    """what stands before the first ``|``."""
    return F.trim(F.element_at(F.split(text, r"\|"), 1))


def average(total: Column, n: Column) -> Column:
    """total / n to one decimal; null for n = 0."""
    return F.round(F.try_divide(total, n), 1)


def python_round(value: Column, places: int = 1) -> Column:
    """Rounding of the binary value, ties to even, where that last digit matters."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), places))

    return run(value)


def failure_reason(requested: Column, landed: Column, title: Column, note: Column, has_page: Column, has_heading: Column, has_name: Column, has_career: Column) -> Column:
    """why a profile gave no row, first matching reason; null where it did."""
    want, land = player_id(requested), F.regexp_replace(F.coalesce(landed, F.lit("")), "/+$", "")
    moved = want.isNotNull() & (land != "") & ~F.contains(land, F.lit("/joueur/"))
    gone = F.coalesce(F.lower(title).rlike("404|not found|introuvable|erreur"), F.lit(False))
    blank = F.when(note.isNotNull(), F.concat(F.lit("page_not_rendered ("), note, F.lit(")"))).otherwise(F.lit("page_not_rendered"))
    return (
        F.when(moved, F.concat(F.lit("profile_removed_redirect_to["), land, F.lit("]")))
        .when(~has_page, F.coalesce(note, F.lit("browser_error_no_page_source")))
        .when(~has_heading & gone, F.lit("404_or_missing_profile"))
        .when(~has_heading, blank)
        .when(~has_name, F.lit("identity_not_extracted"))
        .when(~has_career, F.lit("missing_career_section"))
    )


def zero_default(*names: str) -> dict[str, Column]:
    """counters that are always there."""
    return {n: F.coalesce(F.col(n), F.lit(0)) for n in names}


def is_known(ids: Column, known: list[int]) -> Column:
    """Membership in a list of numbers; False where the id is no number."""
    return F.coalesce(ids.try_cast("double").cast("long").isin(known), F.lit(False))


def literature_tier(core: Column, side: Column) -> tuple[Column, Column]:
    """core matches count twice; five tiers of the sum."""
    s = core * 2 + side
    tier = F.when(s >= 8, "must read").when(s >= 6, "high").when(s >= 4, "medium").when(s >= 2, "low").otherwise("skip")
    return s, tier


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance; null where a coordinate is."""
    d = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.when(d > 1, 1.0).otherwise(d)))


def register(spark: SparkSession) -> None:
    """SQL names for the functions that queries ask for most; bodies stay Catalyst expressions."""
    run = spark.sql
    run("create or replace temporary function player_id(url string) returns string return nullif(regexp_extract(url, '/joueur/(\\\\d+)-', 1), '')")
    run("create or replace temporary function digits_of(t string) returns int return try_cast(nullif(regexp_replace(t, '\\\\D', ''), '') as int)")
    run(
        "create or replace temporary function home_bonus(season string, h int, a int, ht int, at int) returns int return coalesce("
        "if(ht >= at + 3, 1, 0) + if(h < a and a - h <= if(try_cast(split(season, '-')[0] as int) >= 2023, 5, 7), 1, 0), 0)"
    )
    from .names import SQL_NORM

    run(f"create or replace temporary function norm_name(x string) returns string return {SQL_NORM}")
