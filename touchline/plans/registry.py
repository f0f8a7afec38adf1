"""All registered queries of the library itself, each with the SQL it is held against.

A query applies an operator to the star-schema, event and page tables.  ``@query(sql)`` registers a
function under its own name; columns are named alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import scalars as S
from ..operators import bridge as B
from ..operators import fixtures as X
from ..operators import incremental as I
from ..operators import quality as Q
from ..operators import relational as R
from ..sources import html as H
from ..sources.scratch import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def sql_rows(values: list[tuple], alias: str, *columns: str) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in values)}) {alias}({', '.join(columns)})"


# -- absence coefficients: events as matches (user = player, week = season, day = round, type = club) ----
_ABSENCE = """
with pm as (select user_id pid, cast(floor((day(ts)-1)/7) as int) wk, day(ts) rnd, event_type team, value m from events),
cnt as (select pid, wk, team, count(*) n from pm group by 1, 2, 3),
bs as (select pid, wk, team from (select *, row_number() over (partition by pid, wk order by n desc, team) rn from cnt) x where rn = 1),
cnt2 as (select pid, team, count(*) n from pm group by 1, 2),
ov as (select pid, team from (select *, row_number() over (partition by pid order by n desc, team) rn from cnt2) x where rn = 1),
fx as (select distinct rnd, wk, 'purchase' home, 'view' away from pm),
called as (select distinct pid, wk from pm where team = 'error'),
cand as (select f.rnd, f.wk, f.home, f.away, c.pid from fx f join called c on f.wk = c.wk
         where not exists (select 1 from pm p where p.pid = c.pid and p.rnd = f.rnd)),
tm as (select k.*, coalesce(b.team, o.team) team from cand k left join bs b on b.pid = k.pid and b.wk = k.wk left join ov o on o.pid = k.pid),
sd as (select *, case when team = home then 'h' when team = away then 'a' end side from tm),
pre as (select s.rnd, s.pid, s.wk, s.side, coalesce(sum(p.m), 0.0) sb, count(p.m) nb
        from sd s left join pm p on p.pid = s.pid and p.wk = s.wk and p.rnd < s.rnd where s.side is not null group by 1, 2, 3, 4),
av as (select pid, wk, avg(m) a from pm group by 1, 2),
w as (select pre.*, case when a is not null then (sb + 5 * a) / (nb + 5) / 80 when nb > 0 then sb / nb / 80 else 0.0 end w,
        case when a is not null then 'shrinkage' when nb > 0 then 'fallback_current' else 'fallback_zero' end path
      from pre left join av on av.pid = pre.pid and av.wk = pre.wk - 1)
"""


def _absence_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """(matches, minutes, calendar, callups, bridge) of events: a day is a match and its round, weeks are seasons in order."""
    day = F.dayofmonth("ts")
    season = F.element_at(F.array(*[F.lit(x) for x in X.SEASONS]), (F.floor((day - 1) / 7) + 1).cast("int"))
    e = t(spark, sf, "events").select(F.col("user_id").alias("player_id"), day.cast("long").alias("match_id"), season.alias("season"), F.col("event_type").alias("team"), F.col("value").alias("minutes_played"))
    matches = e.select("match_id", "season").distinct().select("match_id", "season", F.col("match_id").cast("int").alias("round"), F.lit(" purchase").alias("home_team"), F.lit("view ").alias("away_team"))
    calendar = matches.select("season", "round", *[F.lit(int(f == "6nations")).alias(f) for f in X.FLAGS.values()])
    name = F.concat(F.lit("p"), F.col("player_id").cast("string")).alias("player_name")
    callups = e.where("team = 'error'").select("player_id", name, "season", F.lit("6 Nations").alias("competition")).distinct()
    return matches, e.select("player_id", "match_id", "team", "minutes_played"), calendar, callups.drop("player_id"), callups.select("player_name", "player_id").distinct()


@query(_ABSENCE + "select f.rnd, round(coalesce(sum(case when side = 'h' then w end), 0.0) / 15, 6) home_c, round(coalesce(sum(case when side = 'a' then w end), 0.0) / 15, 6) away_c from fx f left join w on w.rnd = f.rnd group by 1")
def absence_coefficient(spark, sf):
    out = X.absence_coefficients(*_absence_tables(spark, sf))
    return out.select(F.col("round").alias("rnd"), F.round("home_absence_coefficient", 6).alias("home_c"), F.round("away_absence_coefficient", 6).alias("away_c"))


@query(_ABSENCE + "select path, count(*) n from w group by 1")
def absence_paths(spark, sf):
    return X.absences(*_absence_tables(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with a as (select user_id, cast(floor((day(ts)-1)/7) as int) wk, avg(value) v from events group by 1, 2) "
    "select a.user_id, a.wk, round(a.v, 6) avg_now, round(p.v, 6) avg_prior from a left join a p on p.user_id = a.user_id and p.wk = a.wk - 1"
)
def prior_period_avg(spark, sf):
    wk = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    a = t(spark, sf, "events").groupBy("user_id", wk.alias("wk")).agg(F.avg("value").alias("v"))
    prior = a.select("user_id", (F.col("wk") + 1).alias("wk"), F.col("v").alias("p"))
    return a.join(prior, ["user_id", "wk"], "left").select("user_id", "wk", F.round("v", 6).alias("avg_now"), F.round("p", 6).alias("avg_prior"))


@query(
    "select event_id, round(coalesce(sum(value) over w, 0), 4) sum_before, count(value) over w n_before from events "
    "window w as (partition by user_id order by day(ts) range between unbounded preceding and 1 preceding)"
)
def cumulative_before(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.dayofmonth("ts"))
    return R.before_in_order(e, ["user_id"], "d", "value").select("event_id", F.round("sum_before", 4).alias("sum_before"), "n_before")


@query(
    "with a as (select user_id, event_type, day(ts) d, value from events), k as (select distinct user_id, event_type from a), "
    "asked as (select k.*, d.d from k cross join (values (5), (12), (20)) d(d)) "
    "select q.user_id, q.event_type, q.d::int d, round(coalesce(sum(a.value), 0), 4) sum_before, count(a.value) n_before from asked q "
    "left join a on a.user_id = q.user_id and a.event_type = q.event_type and a.d < q.d group by 1, 2, 3"
)
def asof_before_lookup(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.dayofmonth("ts"))
    asked = e.select("user_id", "event_type").distinct().select("*", F.explode(F.array(F.lit(5), F.lit(12), F.lit(20))).alias("d"))
    out = R.before_lookup(asked, e, ["user_id", "event_type"], "d", "value")
    return out.select("user_id", "event_type", "d", F.round("sum_before", 4).alias("sum_before"), "n_before")


@query("with c as (select user_id, event_type, count(*) n from events group by 1, 2) select user_id, event_type as mode_type from (select *, row_number() over (partition by user_id order by n desc, event_type) rn from c) where rn = 1")
def mode_type_per_user(spark, sf):
    return R.mode_smallest(t(spark, sf, "events"), ["user_id"], "event_type", "mode_type")


# -- intervals and shapes --------------------------------------------------------------------------------
_SIDE = "exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = '{f}' and l.l_shipdate between o.o_orderdate + interval 60 day - interval 7 day and o.o_orderdate + interval 60 day + interval 7 day)::int"


@query(f"select o_orderkey, {_SIDE.format(f='A')} a_busy, {_SIDE.format(f='R')} r_busy from orders o")
def interval_congestion(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 60).alias("day"))
    li = t(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("team"), F.date_sub(F.to_date("l_shipdate"), 7).alias("lo"), F.date_add(F.to_date("l_shipdate"), 7).alias("hi"))
    two = R.sides(o.withColumns({"h": F.lit("A"), "a": F.lit("R")}), ["k", "day"], "h", "a")
    flagged = R.flag_in_window(two, "day", li, ["k", "team"], "lo", "hi", "busy")
    return flagged.groupBy(F.col("k").alias("o_orderkey")).agg(F.max(F.when(F.col("side") == "home", F.col("busy"))).alias("a_busy"), F.max(F.when(F.col("side") == "away", F.col("busy"))).alias("r_busy"))


_WINDOWS = [("1996", "Rugby Championship", "1996-03-01", "1996-04-01"), ("1996", "6 Nations", "1996-03-20", "1996-05-01"), ("1997", "Pacific Cup", "1997-01-10", "1997-01-11"), ("1997", "World cup", None, "1997-05-01"), ("1998", "No such cup", "1998-01-01", "1998-12-31"), ("1998", "World cup", "1998-06-01", "1998-07-01"), ("1999", "End of Year Internationals", "1999-11-01", "1999-11-30")]


@query(
    "with d as (select distinct strftime(o_orderdate, '%Y') season, week(o_orderdate)::int rnd, o_orderdate::date dt from orders), w as (select season, comp, lo::date lo, hi::date hi from "
    + sql_rows(_WINDOWS, "x", "season", "comp", "lo", "hi")
    + ") select d.season, d.rnd, "
    + ", ".join(f"coalesce(max(case when w.comp = '{c}' and d.dt between w.lo - interval 14 day and w.hi + interval 7 day then 1 end), 0) \"{f}\"" for c, f in X.FLAGS.items())
    + " from d left join w on w.season = d.season group by 1, 2"
)
def window_calendar(spark, sf):
    o = t(spark, sf, "orders")
    matches = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy").alias("season"), F.weekofyear("o_orderdate").alias("round"))
    stats = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"))
    windows = rows(spark, _WINDOWS, "season string, competition string, start_date string, end_date string")
    return X.international_calendar(matches, stats, windows).withColumnRenamed("round", "rnd")


@query(
    "with m as (select distinct case when year(o_orderdate) = 1995 then '2023-2024' else year(o_orderdate)::varchar end season, month(o_orderdate)::int rnd, o_orderdate::date dt from orders) "
    "select season, rnd, max((case when season = '2023-2024' then rnd in (1, 2, 3) else season = '1996' and dt between date '1996-06-01' - interval 14 day and date '1996-07-01' + interval 7 day end)::int) world_cup from m group by 1, 2"
)
def world_cup_rounds(spark, sf):
    """The fixed rounds replace the window's dates in their season, and only there."""
    o = t(spark, sf, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    matches = o.select(F.col("o_orderkey").alias("match_id"), F.when(year == "1995", "2023-2024").otherwise(year).alias("season"), F.month("o_orderdate").alias("round"))
    stats = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"))
    windows = rows(spark, [("2023-2024", "World cup", "1995-06-01", "1995-07-01"), ("1996", "World cup", "1996-06-01", "1996-07-01")], "season string, competition string, start_date string, end_date string")
    return X.international_calendar(matches, stats, windows).select("season", F.col("round").alias("rnd"), "world_cup")


_CUP_YEARS = range(1992, 1999)
_CUP = "exists (select 1 from days where y = year(o_orderdate) and ({k} + m + y) % 3 = 0 and abs(date_diff('day', d, o_orderdate::date)) <= 7)::int"


@query(
    "with days as (select y, m, make_date(y, m, 15) d from range(1992, 1999) a(y) cross join range(1, 13) b(m)) "
    f"select o_orderkey match_id, {_CUP.format(k='o_custkey % 25')} home_euro_congestion, {_CUP.format(k='(o_custkey + 7) % 25')} away_euro_congestion from orders"
)
def european_congestion(spark, sf):
    """Clubs by customer; a wide table says which club plays on which matchday, in either spelling of the ids."""
    o, k = t(spark, sf, "orders"), F.col("o_custkey")
    club = lambda n: F.concat(F.lit(" T"), (n % 25).cast("string"))
    matches = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy").alias("season"), F.lit(1).alias("round"), club(k).alias("home_team"), club(k + 7).alias("away_team"))
    stats = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"))
    cups = [(y, m, f"{y % 100:02d}_{(y + 1) % 100:02d}", f"{y}-{m:02d}-15") for y in _CUP_YEARS for m in range(1, 13)]
    dates = rows(spark, [(str(y), f"{span}-R{m}", day) for y, m, span, day in cups], "season string, id string, date string")
    teams = spark.range(25).select(F.concat(F.lit("T"), F.col("id").cast("string"), F.lit(" ")).alias("team_name"), *[((F.col("id") + m + y) % 3 == 0).cast("int").alias(f"{span}_R{m}") for y, m, span, _ in cups])
    return X.european_congestion(matches, stats, dates, teams).select("match_id", "home_euro_congestion", "away_euro_congestion")


@query("select o_orderkey match_id, (o_orderkey % 10 + o_orderkey % 24)::double temperature from orders where o_orderkey % 4 < 3 and (o_orderkey % 7 <> 0 or o_orderkey % 24 < 12)")
def weather_at_kickoff(spark, sf):
    """Venues by trimmed name, some of them unknown; each match has an answer, some of half a day."""
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    matches = o.select(k.alias("match_id"), F.concat(F.lit(" V"), (k % 4).cast("string"), F.lit(" ")).alias("venue"))
    stats = o.select(k.alias("match_id"), day.alias("match_date"), F.concat((k % 24).cast("string"), F.lit(":30")).alias("match_time"))
    hours = F.sequence(F.lit(0), F.when(k % 7 == 0, 11).otherwise(23))
    time = F.transform(hours, lambda h: F.concat(day, F.lit("T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00")))
    hourly = F.struct(time.alias("time"), F.transform(hours, lambda h: (h + k % 10).cast("double")).alias("temperature_2m"))
    answers = o.select(k.alias("match_id"), F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))
    venues = rows(spark, [(f"V{i}", 45.0 + i, 2.0) for i in range(3)], "stadium_name string, latitude double, longitude double")
    return X.weather(matches, stats, venues, answers).select("match_id", "temperature")


@query(
    "with s as (select o_orderkey match_id, o_totalprice a, case when o_orderstatus = 'O' then o_custkey end b, year(o_orderdate)::varchar season, month(o_orderdate)::int as round from orders) "
    "select * from s where season in ('1994', '1995', '1996')"
)
def merged_matches(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey").alias("match_id")
    regular = o.where("o_orderstatus <> 'O'").select(k, F.col("o_totalprice").alias("a"))
    playoff = o.where("o_orderstatus = 'O'").select(k, F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    matches = o.select(k, F.date_format("o_orderdate", "yyyy").alias("season"), F.month("o_orderdate").alias("round"))
    return Q.merge_matches(regular, playoff, matches, ["1994", "1995", "1996"])


@query(
    "with m as (select o_custkey, strftime(o_orderdate, '%y_') || strftime(o_orderdate, '%y_R') || month(o_orderdate) id from orders) "
    "select o_custkey, id, 1 played from m group by 1, 2"
)
def unpivot_matchdays(spark, sf):
    o = t(spark, sf, "orders")
    o = o.select("o_custkey", F.date_format("o_orderdate", "yy").alias("y"), F.month("o_orderdate").alias("m"))
    wide = R.pivot_flags(o, ["o_custkey", "y"], "m", list(range(1, 13)))
    months = [str(i) for i in range(1, 13)]
    long = R.unpivot_flags(wide, ["o_custkey", "y"], months, "m")
    raw = F.concat(F.lit(" "), F.col("y"), F.lit("_"), F.col("y"), F.lit("-R"), F.col("m"))
    return long.select("o_custkey", S.matchday_id(raw).alias("id"), F.lit(1).alias("played"))


@query("select l_returnflag, count(*) filter (where l_linestatus = 'F') f_rows, count(*) filter (where l_linestatus = 'O') o_rows from lineitem group by 1")
def pivot_flags(spark, sf):
    p = t(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0, ["F", "O"])
    return p.select("l_returnflag", F.col("F").alias("f_rows"), F.col("O").alias("o_rows"))


@query("select o_custkey, season || ': ' || n seasons_text from (select o_custkey, string_agg(y || ' (' || n || ')', '; ' order by y) season, count(*) n from (select o_custkey, strftime(o_orderdate, '%Y') y, count(*) n from orders group by 1, 2) group by 1)")
def wide_to_text(spark, sf):
    c = t(spark, sf, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    item = F.concat(F.col("y"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    per = c.groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return per.select("o_custkey", F.concat(F.array_join("items", "; "), F.lit(": "), F.size("items").cast("string")).alias("seasons_text"))


# -- joins -----------------------------------------------------------------------------------------------
@query("select count(*) total_rows, count(*) filter (where o_orderkey is null) unmatched, (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) duplicated_keys from customer left join orders on c_custkey = o_custkey")
def left_join_unmatched(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined, report = R.left_with_count(t(spark, sf, "customer"), o.select("c_custkey", "o_orderkey"), ["c_custkey"], "o_orderkey")
    dup = Q.duplicate_ids(o, "c_custkey").agg(F.count(F.lit(1)).alias("duplicated_keys"))
    return report.join(F.broadcast(dup), how="cross").select(F.col("rows").alias("total_rows"), "unmatched", "duplicated_keys")  # one row each


_TYPES = [("  economy ", 1.5), ("small", 2.5), (" large", 3.5)]


@query("select p_partkey, v.factor from part left join " + sql_rows([(a.strip(), b) for a, b in _TYPES], "v", "name", "factor") + " on lower(trim(p_type)) = v.name")
def trimmed_join(spark, sf):
    v = F.broadcast(rows(spark, _TYPES, "name string, factor double").withColumn("name", F.trim("name")))  # three rows
    p = t(spark, sf, "part")
    return p.join(v, S.plain(p["p_type"]) == v["name"], "left").select("p_partkey", "factor")


@query(
    "with s as (select 'nation_' || k short from (select unnest(range(0, 30)) k)) "
    "select short, coalesce((select min_by(n_nationkey, n_nationkey) from nation where contains(lower(n_name), short))::varchar, 'Unknown') hit from s"
)
def containment_join(spark, sf):
    shorts = spark.range(30).select(F.concat(F.lit("nation_"), F.col("id").cast("string")).alias("short"))
    n = t(spark, sf, "nation").withColumn("hit", F.col("n_nationkey").cast("string"))
    return R.contains_join(shorts, "short", n, "n_name", "hit", "n_nationkey", "Unknown").select("short", "hit")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_presence(spark, sf):
    return R.absent(t(spark, sf, "customer"), t(spark, sf, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_presence(spark, sf):
    return R.present(t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("select a.l_orderkey, a.l_linenumber from lineitem a where l_returnflag = 'N' and not exists (select 1 from lineitem b where b.l_returnflag = 'R' and b.l_partkey = a.l_partkey and b.l_suppkey = a.l_suppkey)")
def anti_two_keys(spark, sf):
    li = t(spark, sf, "lineitem")
    return R.absent(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("select season || '/j' || r url from (select distinct year(o_orderdate) || '-' || (year(o_orderdate) + 1) season from orders) cross join (select unnest(range(1, 27)) r)")
def season_round_urls(spark, sf):
    """The calendar addresses of all seasons in which there were orders."""
    from ..sources.web import season_urls

    year = F.year("o_orderdate")
    seasons = t(spark, sf, "orders").select(F.concat(year.cast("string"), F.lit("-"), (year + 1).cast("string")).alias("season")).distinct()
    return season_urls(seasons, "x").select(F.substring("url", 3, 100).alias("url"))


_CONV = "with u as (select *, row_number() over (partition by conv_id order by turn, text) pos from conversations where role = 'user'), a as (select *, row_number() over (partition by conv_id order by turn, text) pos from conversations where role = 'assistant')"


@query(_CONV + " select u.conv_id, u.pos, md5(u.text) user_md5, md5(a.text) assistant_md5 from u join a using (conv_id, pos)")
def positional_zip(spark, sf):
    c = t(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ut"))
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("tt"))
    z = R.zip_by_position(u, a, ["conv_id"], ["turn", "ut"], ["at", "tt"])
    return z.select("conv_id", F.col("pos").cast("long").alias("pos"), F.md5("ut").alias("user_md5"), F.md5("tt").alias("assistant_md5"))


@query(_CONV + ", n as (select conv_id, max(pos) last from u group by 1) select a.conv_id, a.turn, u.turn label_turn from a join n using (conv_id) join u on u.conv_id = a.conv_id and u.pos = least(a.pos, n.last)")
def positional_pair(spark, sf):
    c = t(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("label_turn"), F.col("text").alias("ut"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    return R.pair_surplus_last(u, a, ["conv_id"], ["label_turn", "ut"], ["turn", "text"]).select("conv_id", "turn", "label_turn")


# -- dedup, quality --------------------------------------------------------------------------------------
@query("select min(doc_id) doc_id, count(*) copies from documents group by text")
def dedup_keep_first(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return d.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("with g as (select md5(text) m, count(distinct lang || '/' || source) k from documents group by 1) select doc_id, k > 1 quarantined from documents join g on g.m = md5(text)")
def dedup_conflicts(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"), "lang", "source")
    return R.conflicts(d, "m", "doc_id", ["lang", "source"]).select("doc_id", F.col("_clash").alias("quarantined"))


_WIDE = "select c.c_custkey match_id, o.o_orderkey a, o.o_totalprice b, o.o_orderstatus c, l.toxic d, l.quality e from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P' left join labels l on l.doc_id = c.c_custkey"


@query(
    f"with w as ({_WIDE}), n as (select *, (a is not null)::int + (b is not null)::int + (c is not null)::int + (d is not null)::int + (e is not null)::int k from w) "
    "select match_id, a, case when k < 2.5 then 'missing_data' when d = 0 and e = 0 then 'all_zero_stats' end reason from n where k < 2.5 or (d = 0 and e = 0)"
)
def null_quality_rule(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b"), F.col("o_orderstatus").alias("c"))
    lab = t(spark, sf, "labels").select(F.col("doc_id").alias("match_id"), F.col("toxic").alias("d"), F.col("quality").alias("e"))
    w = t(spark, sf, "customer").select(F.col("c_custkey").alias("match_id")).join(o, "match_id", "left").join(lab, "match_id", "left")
    return Q.tag_bad_rows(w, ["match_id"], ("d", "e")).where("reason is not null").select("match_id", "a", "reason")


@query(
    "select doc_id, concat_ws(', ', case when lang is null then 'lang' end, case when toxic is null then 'toxic' end, case when quality is null then 'quality' end) missing, "
    "(lang is not null)::int + (toxic is not null)::int + (quality is not null)::int present_n from documents full join labels using (doc_id)"
)
def missing_fields_list(spark, sf):
    j = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "full")
    cols = ["lang", "toxic", "quality"]
    return j.select("doc_id", R.missing_list(cols).alias("missing"), R.non_null_count(cols).alias("present_n"))


@query("with g as (select *, max(coalesce(l_tax, 0)) over (partition by l_orderkey, l_returnflag) m from lineitem) select l_orderkey, l_linenumber, case when m = 0 then null else l_tax end tax from g")
def roster_nullout(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("team"), "l_linenumber", F.col("l_tax").alias("minutes_played"))
    return Q.null_out_silent(li).select(F.col("match_id").alias("l_orderkey"), "l_linenumber", F.col("minutes_played").alias("tax"))


@query(
    "with g as (select l_orderkey k, l_returnflag team, count(nullif(l_tax, 0)) c, count(*) n from lineitem group by 1, 2) "
    "select k match_id, team, 'all_zero_tempsJeu' reason, n n_players_affected, false previously_known from g where c = 0 "
    "union all select o_orderkey, null, 'section_missing', 0, false from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"
)
def incomplete_rosters(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("team"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("minutes_played"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"))
    return Q.incomplete_rosters(li, o, o.limit(0))


@query("select o_custkey, count(*) n, count(*) - 1 extra from orders group by 1 having count(*) > 1")
def duplicate_report(spark, sf):
    return Q.duplicate_ids(t(spark, sf, "orders"), "o_custkey")


# -- sets ------------------------------------------------------------------------------------------------
@query("select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderstatus = 'F' union all select o_orderkey, null, o_orderpriority from orders where o_orderstatus = 'O'")
def union_by_name(spark, sf):
    o = t(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return a.unionByName(o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority"), allowMissingColumns=True)


def _users(spark, sf, kind):
    return t(spark, sf, "events").where(F.col("event_type") == kind).select("user_id")


@query("select user_id from events where event_type = 'purchase' and value > 10 except select user_id from events where event_type = 'error' and value > 150")
def set_except(spark, sf):
    e = t(spark, sf, "events")
    return e.where("event_type = 'purchase' and value > 10").select("user_id").subtract(e.where("event_type = 'error' and value > 150").select("user_id"))


@query("select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error'")
def set_intersect(spark, sf):
    return _users(spark, sf, "purchase").intersect(_users(spark, sf, "error"))


@query("select user_id from events where event_type = 'purchase' union select user_id from events where event_type = 'error'")
def set_union(spark, sf):
    return _users(spark, sf, "purchase").union(_users(spark, sf, "error")).distinct()


# -- aggregates ------------------------------------------------------------------------------------------
@query("select o_custkey, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) priorities, count(*) n_rows from orders group by 1")
def listagg_distinct(spark, sf):
    return R.text_list(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "priorities")


@query("select o_orderpriority, count(*) n, round(count(*) * 100.0 / (select count(*) from orders), 6) pct from orders group by 1")
def counts_and_shares(spark, sf):
    return R.shares(t(spark, sf, "orders"), "o_orderpriority")


@query("select event_type, n, row_number() over (order by n desc, event_type) rank from (select event_type, count(*) n from events group by 1)")
def most_common(spark, sf):
    c = t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "event_type")).cast("long"))


@query("select o_custkey, o_orderkey, round(o_totalprice, 2) best from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1")
def argmax_row(spark, sf):
    best = R.keep_first(t(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return best.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("best"))


@query("select l_returnflag, count(distinct l_partkey) parts, count(distinct l_suppkey) suppliers from lineitem group by 1")
def distinct_counts(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("select user_id, sum((event_type = 'error')::int)::bigint errors, sum((event_type = 'view')::int)::bigint views, max((event_type = 'purchase')::int) any_purchase from events group by 1")
def conditional_counters(spark, sf):
    on = lambda k: (F.col("event_type") == k).cast("int")
    return t(spark, sf, "events").groupBy("user_id").agg(F.sum(on("error")).alias("errors"), F.sum(on("view")).alias("views"), F.max(on("purchase")).alias("any_purchase"))


@query("select o_orderstatus, o_orderkey // 4096 as stretch, list_aggregate(list_sort(list(o_orderkey)), 'string_agg', ',') ids from orders group by 1, 2")
def sorted_id_lists(spark, sf):
    """In stretches of ids, so that no list grows with the table."""
    o = t(spark, sf, "orders").groupBy("o_orderstatus", F.floor(F.col("o_orderkey") / 4096).alias("stretch")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return o.select("o_orderstatus", "stretch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# -- sorts (order shown as a rank) -----------------------------------------------------------------------
@query("select p_partkey, row_number() over (order by p_size desc, p_brand asc, p_partkey asc) rank from part")
def sorted_mixed(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return R.ranked(p, {"_size": (F.col("p_size"), "desc"), "_brand": (F.col("p_brand"), "asc")}, ["p_partkey"]).select("p_partkey", "rank")


@query("select doc_id, row_number() over (order by toxic nulls first, doc_id) rank from (select doc_id, toxic from documents left join labels using (doc_id))")
def nulls_first(spark, sf):
    j = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return R.ranked(j, {"_toxic": (F.col("toxic"), "asc_nulls_first"), "_stretch": (F.floor(F.col("doc_id") / 65536), "asc_nulls_first")}, ["doc_id"]).select("doc_id", "rank")


@query("select distinct l_shipdate::date::varchar shipped from lineitem")
def sorted_distinct(spark, sf):
    return t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")).distinct().orderBy("shipped")


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10")
def top_ten(spark, sf):
    return t(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey")


# -- names -----------------------------------------------------------------------------------------------
_ASCII = "replace(lower(strip_accents({x})), 'ß', 'ss')"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(" + _ASCII + ", '[''’-]', '{d}', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TEXT = "coalesce(text, '')"


@query(f"select doc_id, md5({_NORM.format(x=_TEXT, d=' ')}) normal_md5 from documents")
def name_normalize(spark, sf):
    """The normal form of whole texts."""
    return t(spark, sf, "documents").select("doc_id", F.md5(N.norm(F.coalesce("text", F.lit("")))).alias("normal_md5"))


@query(f"select doc_id, md5({_NORM.format(x=_TEXT, d='')}) tight_md5 from documents")
def name_tight(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(N.norm_tight(F.coalesce("text", F.lit("")))).alias("tight_md5"))


_PART_NAME = "'jean-' || split_part(p_name, ' ', 1) || ' ' || upper(split_part(p_name, ' ', 2))"


def _part_name():
    s = F.split("p_name", " ")
    return F.concat(F.lit("jean-"), s[0], F.lit(" "), F.upper(s[1]))


@query(f"select p_partkey, 'Jean-' || upper(split_part(p_name, ' ', 1)[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) titled from part")
def name_title_case(spark, sf):
    return t(spark, sf, "part").select("p_partkey", N.title_case(_part_name()).alias("titled"))


@query("select p_partkey, 'jean-' || split_part(p_name, ' ', 1) first_name, upper(split_part(p_name, ' ', 2)) last_name from part")
def name_split(spark, sf):
    first, last = N.split_name(_part_name())
    return t(spark, sf, "part").select("p_partkey", first.alias("first_name"), last.alias("last_name"))


# players: all parts, named by two words and the key's residues; call-ups spell them otherwise
_KIND = {0: "x.full_name", 1: "upper(x.full_name)", 2: "replace(x.full_name, '-', '')", 3: "split_part(x.full_name, ' ', 1) || ' de ' || split_part(x.full_name, ' ', 2)", 4: "'Zed ' || split_part(x.full_name, ' ', 2)", 5: "'Nobody Atall'"}
_PLAYERS = "select p_partkey player_id, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || '-' || chr((97 + p_partkey % 26)::int) || chr((97 + (p_partkey // 26) % 26)::int) full_name from part"
_CALLUPS = f"select case (x.player_id // 3) % 6 {' '.join(f'when {k} then {v}' for k, v in _KIND.items())} end player_name from ({_PLAYERS}) x"
_BRIDGE = f"""
with p as (select *, {_NORM.format(x='full_name', d=' ')} n, {_NORM.format(x='full_name', d='')} t from ({_PLAYERS})),
c as (select player_name, count(*)::int callup_rows, {_NORM.format(x='player_name', d=' ')} n, {_NORM.format(x='player_name', d='')} t from ({_CALLUPS}) group by player_name),
ex as (select full_name, max_by(player_id, player_id) id from p group by 1),
bn as (select n, count(*) k, min(player_id) id, string_agg(player_id::varchar, ';' order by player_id) ids from p group by 1),
bt as (select t, count(*) k, min(player_id) id from p group by 1),
bp as (select split_part(n, ' ', 1) f, split_part(n, ' ', -1) l, count(*) k, min(player_id) id, string_agg(player_id::varchar, ';' order by player_id) ids from p where contains(n, ' ') group by 1, 2),
bl as (select split_part(n, ' ', -1) l, count(*) k, string_agg(player_id::varchar, ';' order by player_id) ids from p where contains(n, ' ') group by 1),
j as (select c.player_name, c.callup_rows, ex.id ei, coalesce(bn.k, 0) nk, bn.id ni, bn.ids ns, coalesce(bt.k, 0) tk, bt.id ti, coalesce(bp.k, 0) pk, bp.id pi, bp.ids ps, coalesce(bl.k, 0) lk, bl.ids ls
  from c left join ex on ex.full_name = c.player_name left join bn on bn.n = c.n left join bt on bt.t = c.t
  left join bp on contains(c.n, ' ') and bp.f = split_part(c.n, ' ', 1) and bp.l = split_part(c.n, ' ', -1)
  left join bl on bl.l = split_part(c.n, ' ', -1)),
bridge as (select player_name,
  case when ei is not null then ei when nk = 1 then ni when nk > 1 then null when tk = 1 then ti when pk = 1 then pi end player_id,
  case when ei is not null then 'exact' when nk = 1 then 'normalized' when nk > 1 then 'ambiguous' when tk = 1 then 'normalized' when pk = 1 then 'normalized_extended' else 'unmatched' end match_method,
  case when ei is not null or nk = 1 then '' when nk > 1 then ns when tk = 1 or pk = 1 then '' when pk > 1 then ps when lk >= 1 then ls else '' end candidate_player_ids,
  case when ei is not null or nk = 1 then '' when nk > 1 then '{B.AMBIGUOUS}' when tk = 1 or pk = 1 then '' when pk > 1 then '{B.FIRST_LAST_MANY}' when lk = 1 then '{B.SURNAME_ONE}' when lk > 1 then '{B.SURNAME_MANY}' else '{B.NO_SURNAME}' end likely_cause,
  callup_rows from j)
"""


def _bridge_tables(spark, sf):
    s, k = F.split("p_name", " "), F.col("p_partkey")
    letter = lambda c: F.chr((F.lit(97) + c % 26).cast("long"))
    full = F.concat(s[0], F.lit(" "), s[1], F.lit("-"), letter(k), letter(F.floor(k / 26)))
    players = t(spark, sf, "part").select(k.alias("player_id"), full.alias("full_name"), F.lit("FR").alias("nationality"), F.when(k % 2 == 0, "A").alias("2021-2022_team"), F.when(k % 5 == 0, "B").alias("2022-2023_team"))
    kind, name = F.floor(F.col("player_id") / 3) % 6, F.col("full_name")
    two = F.split(name, " ")
    spelled = [name, F.upper(name), F.replace(name, F.lit("-"), F.lit("")), F.concat(two[0], F.lit(" de "), two[1]), F.concat(F.lit("Zed "), two[1]), F.lit("Nobody Atall")]
    said = F.element_at(F.array(*spelled), (kind + 1).cast("int"))
    callups = players.select(said.alias("player_name"), F.concat(F.lit("int_"), (F.col("player_id") % 4).cast("string")).alias("int_window_id"), F.lit("2021-2022").alias("season"), F.lit("6 Nations").alias("competition"))
    return callups, players


@query(_BRIDGE + "select * from bridge")
def name_bridge(spark, sf):
    return B.build(*_bridge_tables(spark, sf))


@query(_BRIDGE + "select match_method, count(*) names, round(count(*) / (select count(*) from bridge), 6) name_share, sum(callup_rows)::bigint \"rows\", round(sum(callup_rows) / (select sum(callup_rows) from bridge), 6) row_share from bridge group by 1")
def bridge_coverage(spark, sf):
    return B.coverage(B.build(*_bridge_tables(spark, sf)))


@query(
    _BRIDGE
    + f", q as (select player_name, candidate_player_ids, unnest(string_split(candidate_player_ids, ';')) id, callup_rows from bridge where likely_cause in ('{B.SURNAME_ONE}', '{B.SURNAME_MANY}')) "
    "select player_name, id::bigint candidate_player_id, len(string_split(candidate_player_ids, ';'))::int n_candidates, callup_rows n_callup_rows, "
    "case when id::bigint % 2 = 0 and id::bigint % 5 = 0 then 'A (2021-2022); B (2022-2023)' when id::bigint % 2 = 0 then 'A (2021-2022)' when id::bigint % 5 = 0 then 'B (2022-2023)' else '(no Top 14 club in players.csv)' end candidate_clubs from q"
)
def review_queue(spark, sf):
    callups, players = _bridge_tables(spark, sf)
    return B.review_queue(staged(B.build(callups, players), "bridge"), callups, players).select("player_name", "candidate_player_id", "n_candidates", "n_callup_rows", "candidate_clubs")


@query(
    _BRIDGE
    + f", q as (select player_name, min(c::bigint) id from (select player_name, unnest(string_split(candidate_player_ids, ';')) c from bridge where likely_cause in ('{B.SURNAME_ONE}', '{B.SURNAME_MANY}')) group by 1) "
    "select b.player_name, case when q.id % 2 = 0 then q.id else b.player_id end player_id, case when q.id % 2 = 0 then 'manual_review' else match_method end match_method, "
    "case when q.id % 2 = 0 then '' when q.id is not null and match_method = 'unmatched' then 'manual review: rejected (was: ' || likely_cause || ')' else likely_cause end likely_cause from bridge b left join q using (player_name)"
)
def apply_decisions(spark, sf):
    callups, players = _bridge_tables(spark, sf)
    bridge = staged(B.build(callups, players), "bridge")
    queue = R.split_list(bridge.where(F.col("likely_cause").isin(B.REVIEWED)), "candidate_player_ids", "c").groupBy("player_name").agg(F.min(F.col("c").cast("long")).alias("candidate_player_id"))
    decided = queue.withColumn("decision", F.when(F.col("candidate_player_id") % 2 == 0, " Y ").otherwise("n"))
    decided = staged(decided, "decided")
    once = staged(B.apply_decisions(bridge, decided), "decided-once")
    return B.apply_decisions(once, decided).select("player_name", "player_id", "match_method", "likely_cause")


@query("with g as (select split_part(p_name, ' ', -1) w, string_agg(p_partkey::varchar, ';' order by p_partkey) ids from part group by 1) select w, unnest(string_split(ids, ';'))::bigint id from g")
def explode_candidates(spark, sf):
    # lists in stretches of ids, so that none grows with the table
    g = t(spark, sf, "part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("w"), F.floor(F.col("p_partkey") / 4096).alias("stretch")).agg(F.array_join(F.collect_list(F.col("p_partkey").cast("string")), ";").alias("ids"))
    return R.split_list(g, "ids", "id").select("w", F.col("id").cast("long").alias("id"))


# -- scalars ---------------------------------------------------------------------------------------------
@query(
    "with o as (select o_orderkey k, (2020 + o_orderkey % 5)::varchar || '-x' season, (floor(o_totalprice)::bigint % 40)::int hs, ((floor(o_totalprice)::bigint // 40) % 40)::int aws, (o_orderkey % 7)::int ht, case when o_orderkey % 11 = 0 then null else (o_custkey % 5)::int end att from orders) "
    "select k, case when att is null then 0 else (ht >= att + 3)::int + (hs < aws and aws - hs <= case when left(season, 4)::int >= 2023 then 5 else 7 end)::int end home_b, "
    "case when att is null then 0 else (att >= ht + 3)::int + (aws < hs and hs - aws <= case when left(season, 4)::int >= 2023 then 5 else 7 end)::int end away_b from o"
)
def bonus_points(spark, sf):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    o = t(spark, sf, "orders").select(k.alias("k"), F.concat((F.lit(2020) + k % 5).cast("string"), F.lit("-x")).alias("s"), (price % 40).cast("int").alias("hs"), (F.floor(price / 40) % 40).cast("int").alias("aws"), (k % 7).cast("int").alias("ht"), F.when(k % 11 != 0, (F.col("o_custkey") % 5).cast("int")).alias("att"))
    home, away = S.bonus_points(F.col("s"), F.col("hs"), F.col("aws"), F.col("ht"), F.col("att"))
    return o.select("k", home.alias("home_b"), away.alias("away_b"))


@query("select page_id, nullif(regexp_extract(url, '/joueur/(\\d+)-', 1), '') pid, coalesce(nullif(regexp_extract(url, '/j\\d+/(\\d+)-', 1), ''), 'Unknown') mid, nullif(regexp_extract(url, '//([^/]+)', 1), '') host from (select page_id, url from pages union all select -1, 'https://x/joueur/1678-loic' union all select -2, 'https://x/j17/8218-a-b')")
def url_id(spark, sf):
    p = t(spark, sf, "pages").select("page_id", "url").union(rows(spark, [(-1, "https://x/joueur/1678-loic"), (-2, "https://x/j17/8218-a-b")], "page_id long, url string"))
    return p.select("page_id", S.player_id(F.col("url")).alias("pid"), S.match_id(F.col("url")).alias("mid"), S.first_group(F.col("url"), "//([^/]+)").alias("host"))


@query(
    "with x as (select p_partkey k, p_partkey || ' - ' || p_size s, (p_retailprice / 10)::varchar || ' %' pc, 'n' || p_size || 'x' || p_size d from part) "
    "select k, regexp_extract_all(s, '(\\d+)', 1)[1]::int a, regexp_extract_all(s, '(\\d+)', 1)[2]::int b, trunc(trim(replace(pc, '%', ''))::double)::int pct, nullif(regexp_replace(d, '\\D', '', 'g'), '')::int dig from x"
)
def parse_score_pct(spark, sf):
    x = t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.col("p_partkey").cast("string"), F.lit(" - "), F.col("p_size").cast("string")).alias("s"), F.concat((F.col("p_retailprice") / 10).cast("string"), F.lit(" %")).alias("pc"), F.concat(F.lit("n"), F.col("p_size").cast("string"), F.lit("x"), F.col("p_size").cast("string")).alias("d"))
    a, b = S.score(F.col("s"))
    return x.select("k", a.alias("a"), b.alias("b"), S.percent(F.col("pc")).alias("pct"), S.digits(F.col("d")).alias("dig"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, lpad((o_orderkey % 24)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') hhmm, strftime(o_orderdate, '%Y-%m-%dT') || lpad((o_orderkey % 24)::varchar, 2, '0') || ':00' hour_key from orders")
def french_date_time(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("le "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" à "), (k % 24).cast("string"), F.lit("h"), F.lpad((k % 60).cast("string"), 2, "0"))
    x = t(spark, sf, "orders").select("o_orderkey", text.alias("x")).select("o_orderkey", S.iso_date(F.col("x")).alias("iso"), S.kickoff(F.col("x")).alias("hhmm"))
    return x.withColumn("hour_key", S.hour_key(F.col("iso"), F.col("hhmm")))


@query(
    "select o_orderkey, try_cast(case o_orderstatus when 'F' then strftime(o_orderdate, '%Y-%m-%d') when 'O' then strftime(o_orderdate, '%Y-%m-31') end as date)::varchar as day, o_orderkey in (9922, 11057, 11795, 11796, 11797, 11798, 11800) as known from orders"
)
def safe_date_parse(spark, sf):
    """Dates as text: whole ones, the 31st of every month, and none."""
    status = F.col("o_orderstatus")
    text = F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(status == "O", F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31"))).otherwise(F.lit("nope"))
    return t(spark, sf, "orders").select("o_orderkey", S.safe_date(text).cast("string").alias("day"), S.is_known(F.col("o_orderkey").cast("string"), I.DEAD_MATCHES).alias("known"))


@query("with h as (select event_id, json_extract(props, '$.k')::int k, hour(ts) hr, day(ts) d from events) select d, hr, count(*) n, sum(k)::bigint total from h group by 1, 2")
def json_hourly(spark, sf):
    e = t(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"), F.hour("ts").alias("hr"), F.dayofmonth("ts").alias("d"))
    return e.groupBy("d", "hr").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("with a as (select *, 2 * toxic * 3 + quality * 3 s from labels) select doc_id, s, case when s >= 8 then 'must read' when s >= 6 then 'high' when s >= 4 then 'medium' when s >= 2 then 'low' else 'skip' end tier from a")
def literature_score(spark, sf):
    s, tier = S.literature_tier(F.col("toxic") * 3, F.col("quality") * 3)
    return t(spark, sf, "labels").select("doc_id", s.alias("s"), tier.alias("tier"))


@query(
    "with g as (select n_nationkey k, n_nationkey * 6.5 - 80 lat, n_nationkey * 14.0 - 170 lon from nation where n_nationkey <> 7) "
    "select o_orderkey match_id, case when a.k is not null and b.k is not null then round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) end travel_km "
    "from orders left join customer on c_custkey = o_custkey left join g a on a.k = c_nationkey left join g b on b.k = (o_orderkey + c_nationkey) % 25"
)
def haversine_travel(spark, sf):
    """Away teams by customer with a ground in their nation, one of which nobody knows where it is."""
    n, c = t(spark, sf, "nation"), t(spark, sf, "customer")
    ground = F.concat(F.lit("V"), F.col("n_nationkey").cast("string"))
    venues = n.where("n_nationkey <> 7").select(ground.alias("stadium_name"), (F.col("n_nationkey") * 6.5 - 80).alias("latitude"), (F.col("n_nationkey") * 14.0 - 170).alias("longitude"))
    teams = n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team_name"), ground.alias("venue"))
    o = t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    venue = F.concat(F.lit(" V"), ((F.col("o_orderkey") + F.col("c_nationkey")) % 25).cast("string"))
    matches = o.select(F.col("o_orderkey").alias("match_id"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("away_team"), venue.alias("venue"))
    return X.travel(matches, teams, venues).select("match_id", F.round("travel_km", 6).alias("travel_km"))


_FORM = "from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"


@query("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 5 preceding and 1 preceding), 4) form from orders")
def form_last_n(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("team"), F.lit("s").alias("season"), F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("points"))
    return X.form_and_rest(o, 5).select(F.col("match_id").alias("o_orderkey"), F.round("form", 4).alias("form"))


@query(f"select o_orderkey, date_diff('day', lag(o_orderdate) over w, o_orderdate)::int rest_days {_FORM}")
def rest_days(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("team"), F.lit("s").alias("season"), F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("points"))
    return X.form_and_rest(o).select(F.col("match_id").alias("o_orderkey"), "rest_days")


@query(
    "with r as (select user_id team, day(ts) rnd, sum(floor(value))::bigint p from events group by 1, 2), b as (select *, coalesce(sum(p) over (partition by team order by rnd range between unbounded preceding and 1 preceding), 0) s from r) "
    "select team, rnd, row_number() over (partition by rnd order by s desc, team)::int \"position\" from b"
)
def league_position(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("team"), F.lit("s").alias("season"), F.dayofmonth("ts").alias("round")).agg(F.sum(F.floor("value").cast("long")).alias("points"))
    return X.league_position(e).select("team", F.col("round").alias("rnd"), "position")


@query(
    "select event_id, case when event_type = 'error' then 'profile_removed_redirect_to[https://x/joueurs]' when event_type = 'click' then 'slow' when hour(ts) < 4 and user_id % 2 = 0 then '404_or_missing_profile' "
    "when hour(ts) < 4 then 'page_not_rendered' when hour(ts) < 8 then 'identity_not_extracted' when hour(ts) < 12 then 'missing_career_section' end reason from events"
)
def failure_reasons(spark, sf):
    """Events as attempts to read a profile; what went wrong comes from their kind and hour."""
    kind, hour = F.col("event_type"), F.hour("ts")
    asked = F.concat(F.lit("https://x/joueur/"), F.col("user_id").cast("string"), F.lit("-a"))
    landed = F.when(kind == "error", "https://x/joueurs/").otherwise(asked)
    title = F.when(F.col("user_id") % 2 == 0, "Erreur 404").otherwise("Page")
    note = F.when(kind == "click", "slow")
    reason = S.failure_reason(asked, landed, title, note, kind != "click", hour >= 4, hour >= 8, hour >= 12)
    return t(spark, sf, "events").select("event_id", reason.alias("reason"))


# -- pages -----------------------------------------------------------------------------------------------
@query("with l as (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href from pages) select page_id, href, count(*) n from l group by 1, 2")
def html_links(spark, sf):
    return H.links(t(spark, sf, "pages"), ["page_id"]).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


_HEADING = "<h([1-6])[^>]*>(.*?)</h[1-6]>"
_PLAIN = "replace(replace(replace(replace(replace(regexp_replace(h[2], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"


@query(f"with h as (select page_id, unnest(list_zip(regexp_extract_all(html, '{_HEADING}', 1, 's'), regexp_extract_all(html, '{_HEADING}', 2, 's'))) h from pages) select page_id, h[1]::int as level, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) heading from h")
def html_headings(spark, sf):
    return H.headings(t(spark, sf, "pages"), ["page_id"])


@query("select l_orderkey k, 0 table_no, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) - 1)::int row_no, l_partkey || '|' || l_suppkey || '|' || l_linenumber cells from lineitem")
def html_table_rows(spark, sf):
    """A page for each order, its lines in a table."""
    cells = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td> ", *cells), F.lit("</td></tr>"))
    li = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", row.alias("x")))).alias("x"))
    pages = li.select("k", F.concat(F.lit("<p><table>"), F.array_join("x.x", ""), F.lit("</table>")).alias("html"))
    return H.table_rows(pages, ["k"]).withColumn("cells", F.array_join("cells", "|"))


# -- incremental -----------------------------------------------------------------------------------------
@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def resume_antijoin(spark, sf):
    li = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.absent(t(spark, sf, "orders"), li, ["o_orderkey"]).select("o_orderkey")


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'returned' else o_orderstatus end status from orders")
def upsert_merge(spark, sf):
    """Orders of which something came back take a new status."""
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    back = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return R.upsert(o, R.present(o, back, ["o_orderkey"]).withColumn("status", F.lit("returned")), ["o_orderkey"])


@query("select o_orderkey, coalesce(toxic, -1) toxic from orders left join labels on doc_id = o_orderkey")
def map_default(spark, sf):
    lab = t(spark, sf, "labels").select(F.col("doc_id").alias("o_orderkey"), "toxic")
    return R.map_default(t(spark, sf, "orders").select("o_orderkey"), lab, "o_orderkey", "toxic", -1)


@query(
    "with i as (select o_orderkey match_id, case when o_orderkey % 4 = 0 then 'confirmed_no_data' else 'timeout_unverified' end status from orders) "
    "select match_id, case when match_id % 4 = 0 then status when match_id % 5 = 0 then 'confirmed_no_data' else 'timeout_unverified' end status from i where match_id % 4 = 0 or match_id % 5 < 2"
)
def retry_state(spark, sf):
    ids = t(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"))
    inc = ids.withColumn("status", F.when(F.col("match_id") % 4 == 0, I.DEAD).otherwise(I.OPEN))
    # of the tried ones: 0 of 5 verified empty, 1 of 5 gave nothing at all, the others came
    results = inc.where("match_id % 4 <> 0 and match_id % 5 >= 2").select("match_id", F.lit(1).alias("v"))
    still = inc.where("match_id % 4 <> 0 and match_id % 5 = 0").select("match_id", F.lit(I.DEAD).alias("status"))
    return I.retry_pass(ids.withColumn("v", F.lit(0)), inc, results, still)[1]


_FAIL = "with a as (select user_id, ts, event_id, event_type in ('error', 'click', 'view') bad from events), r as (select *, sum((not bad)::int) over (partition by user_id order by ts, event_id) run from a), l as (select user_id, max(run) last from r group by 1), c as (select r.user_id, sum(bad::int)::int fail_count from r join l on l.user_id = r.user_id and r.run = l.last group by 1)"


@query(_FAIL + " select user_id, fail_count, case when fail_count >= 3 then 'manual_review_needed' else 'timeout' end status from c where fail_count > 0")
def fail_counter(spark, sf):
    e = t(spark, sf, "events").withColumn("bad", F.col("event_type").isin("error", "click", "view"))
    return I.fail_counts(e, "user_id", ["ts", "event_id"], "bad")


@query(
    "with u as (select length(url) id, url, 0 p, page_id o from pages union all select (length(html) // 10)::int, 'new-' || page_id, 1, page_id from pages) "
    "select id, url from (select *, row_number() over (partition by id order by p, o) rn from u) where rn = 1"
)
def registry_merge(spark, sf):
    """Addresses by their length, and pages by theirs: what is known stays, what is new fills the gaps."""
    p = t(spark, sf, "pages")
    old = p.select(F.length("url").alias("id"), "url", F.col("page_id").alias("o"))
    new = p.select(F.floor(F.length("html") / 10).cast("int").alias("id"), F.concat(F.lit("new-"), F.col("page_id").cast("string")).alias("url"), F.col("page_id").alias("o"))
    return R.registry_merge(old, new, "id", "o").select("id", "url")


@query("with u as (select l_orderkey k, l_returnflag f, 0 g, l_linenumber o from lineitem where l_linenumber < 3 union all select l_orderkey, l_returnflag, 1, l_linenumber from lineitem where l_linenumber >= 3) select k, f, max(g) newest from u group by 1, 2")
def carry_forward_log(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), "l_linenumber")
    old = li.where("l_linenumber < 3").select("k", "f", F.lit(0).alias("newest")).distinct()
    return I.carry_log(old, li.where("l_linenumber >= 3").select("k", "f", F.lit(1).alias("newest")).distinct(), ["k", "f"], "newest")


@query("select k, a, null::double b, 'x' c from (select o_orderkey k, o_custkey a from orders)")
def fixed_schema(spark, sf):
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), F.lit("x").alias("c"), F.lit(1).alias("extra"))
    return R.ensure_columns(o, want)


@query("select o_orderkey, case when o_totalprice > 400000 then 'HIGH' else o_orderstatus end o_orderstatus from orders")
def set_where(spark, sf):
    return R.set_where(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_totalprice") > 400000, o_orderstatus=F.lit("HIGH")).drop("o_totalprice")
