"""Registered queries of tables and runs that survive failures, of hot keys and of long windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import ordered as O
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import reports as P
from ..sources import keyed, publish
from ..sources.rescue import load_rescued
from ..sources.scratch import new_folder, staged
from ..streaming import retries
from .registry import query, t


@query(
    "with s as (select l_shipdate::date d, sum(l_quantity) q, count(*) n from lineitem group by 1) "
    "select d ship_day, coalesce(sum(q) over w, 0)::double shipped_before, coalesce(sum(n) over w, 0)::bigint lines_before from s window w as (order by d rows between unbounded preceding and 1 preceding)"
)
def running_totals(spark, sf):
    """What was shipped before each day, over all lines as one key: a scan over ranges, no window over the table."""
    li = t(spark, sf, "lineitem").select(F.lit("all").alias("k"), F.to_date("l_shipdate").alias("ship_day"), "l_quantity")
    out = O.running_before(li, ["k"], "ship_day", "l_quantity")
    return out.select("ship_day", F.col("sum_before").cast("double").alias("shipped_before"), F.col("n_before").alias("lines_before")).distinct()


@query(
    "select o_orderkey, coalesce(sum(l_quantity), 0)::double shipped_before, count(l_quantity) lines_before from orders "
    "left join (select l_partkey % 5 region, l_shipdate::date d, l_quantity from lineitem) l on l.region = o_custkey % 5 and l.d < o_orderdate::date group by 1"
)
def running_lookup(spark, sf):
    """What was shipped in the customer's region before the day of each order; five keys hold all lines."""
    li = t(spark, sf, "lineitem").select((F.col("l_partkey") % 5).alias("region"), F.to_date("l_shipdate").alias("d"), "l_quantity")
    asked = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("region"), F.to_date("o_orderdate").alias("d"))
    out = O.running_lookup(asked, li, ["region"], "d", "l_quantity")
    return out.select("o_orderkey", F.col("sum_before").cast("double").alias("shipped_before"), F.col("n_before").alias("lines_before"))


_ACTIVE = "select o_custkey, min(o_orderdate)::date lo, max(o_orderdate)::date hi from orders group by 1"


@query(f"with w as ({_ACTIVE}) select l_orderkey, l_linenumber, l_shipdate::date ship_day, (w.o_custkey is not null)::int active from lineitem left join w on w.o_custkey = l_partkey and l_shipdate::date between lo and hi")
def long_windows(spark, sf):
    """Lines shipped while a customer of the part's number was active: a window of years for each customer."""
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_day"), F.col("l_partkey").alias("k"))
    return R.flag_in_window(li, "ship_day", o, ["k"], "lo", "hi", "active").drop("k")


@query(
    "with l as (select l_orderkey k, count(*) n from lineitem group by 1) "
    "select o_orderkey k, case when l.k is null then o_orderstatus else 'shipped' end status, case when l.k is null then 0 else n end n, o_totalprice price from orders left join l on l.k = o_orderkey "
    "union all select l.k, 'shipped', n, null from l where not exists (select 1 from orders where o_orderkey = l.k)"
)
def keyed_merge(spark, sf):
    """Orders as a keyed table; what their lines say is merged in, then orders that come again are left alone."""
    o = t(spark, sf, "orders")
    base = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("n"), F.col("o_totalprice").alias("price"))
    table = keyed.KeyedTable(spark, new_folder(spark, "keyed"), ["k"], "k long, status string, n long, price double")
    table.merge(base)
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table.merge(lines.join(base.select("k", "price"), "k", "left").withColumn("status", F.lit("shipped")))
    table.merge(base.withColumn("status", F.lit("late")), keep="old")
    return table.read()


@query("select n_name, count(c_custkey) customers, (select count(*) from supplier where s_nationkey = n_nationkey) suppliers from nation left join customer on c_nationkey = n_nationkey group by n_name, n_nationkey")
def published_tables(spark, sf):
    """Customers and suppliers published in one version, counted from there; a change that fails leaves them."""
    root = new_folder(spark, "published")
    customers, suppliers = t(spark, sf, "customer").select("c_custkey", "c_nationkey"), t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    with publish.Transaction(spark, root) as change:
        change.write(customers, "customer")
        change.write(suppliers, "supplier")
    dropped = publish.Transaction(spark, root)
    dropped.write(customers.limit(0), "customer")
    dropped.abort()
    count = lambda table, key, out: publish.published(spark, root, table).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(out))
    both = t(spark, sf, "nation").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    return both.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


_TRIES = f"""
with a as (
  select user_id match_id, day(ts)::int attempt, bool_or(event_type in ('purchase', 'view')) got,
    min(case event_type when 'error' then '{I.OPEN}' when 'click' then case when hour(ts) < 3 then '{I.DEAD}' end end) status from events group by 1, 2
), r as (
  select *, case when got and status is null then 'done' else coalesce(status, '{I.OPEN}') end now, row_number() over (partition by match_id order by attempt) k from a
), e as (
  select match_id, least(coalesce(min(k) filter (where now <> '{I.OPEN}'), 3), 3, max(k)) last from r group by 1
)
select r.match_id, min(attempt) filter (where k = last) attempt, min(now) filter (where k = last) status, max(last)::int tries, max(last) = 3 or min(now) filter (where k = last) <> '{I.OPEN}' final,
  string_agg(now, ';' order by k) filter (where k <= last) history from r join e on e.match_id = r.match_id group by 1
"""


@query(_TRIES)
def retry_stream(spark, sf):
    """Users as matches and their days as attempts, read as a stream: what each is after three tries at most."""
    e = t(spark, sf, "events")
    root = new_folder(spark, "retries")
    e.write.parquet(f"{root}/events")
    events = spark.readStream.schema(e.schema).parquet(f"{root}/events")
    kind = F.col("event_type")
    status = F.when(kind == "error", I.OPEN).when((kind == "click") & (F.hour("ts") < 3), I.DEAD)
    events = events.select(F.col("user_id").alias("match_id"), F.dayofmonth("ts").alias("attempt"), kind.isin("purchase", "view").alias("got"), status.alias("status"), F.col("ts").alias("at"))
    known = e.select(F.col("user_id").alias("match_id"), F.lit(I.OPEN).alias("status")).distinct()
    retries.run_retries(events, known, f"{root}/out", f"{root}/checkpoint", patience_days=10_000).awaitTermination()
    return retries.latest_states(spark, f"{root}/out")


@query(
    "select c_custkey, case when c_mktsegment = 'FURNITURE' then 'short' when c_mktsegment = 'MACHINERY' then 'mistyped' when c_mktsegment = 'BUILDING' then 'long' end reason, "
    "case when c_mktsegment not in ('FURNITURE', 'MACHINERY', 'BUILDING') then round(c_acctbal, 2) end balance from customer"
)
def rescued_lines(spark, sf):
    """Customers as CSV lines, of some segments broken, in files with two orders of columns: rows and rejects."""
    c = t(spark, sf, "customer")
    kind = F.col("c_mktsegment")
    key, balance = F.col("c_custkey").cast("string"), F.format_string("%.2f", F.round("c_acctbal", 2))
    balance = F.when(kind == "MACHINERY", "much").otherwise(balance)
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""the"" customer"'))
    root = new_folder(spark, "broken")
    for n, parts, head, sep in ((0, [key, name, balance], "c_custkey,name,balance", ","), (1, [balance, key, name], "balance; c_custkey ;name", ";")):
        line = F.when(kind == "FURNITURE", F.concat_ws(sep, *parts[:-1])).when(kind == "BUILDING", F.concat_ws(sep, *parts, F.lit("more"))).otherwise(F.concat_ws(sep, *parts))
        mine = c.where(F.pmod(F.coalesce("c_nationkey", F.lit(0)), F.lit(2)) == n).select(line.alias(head))
        # a file of lines under one name: the writer puts the header into each file and leaves the lines as they are
        mine.write.option("header", True).option("sep", "\x01").option("quote", "\x00").option("escapeQuotes", False).csv(f"{root}/{n}")
    found, rejects, _ = load_rescued(spark, [f"{root}/0", f"{root}/1"], "c_custkey long, name string, balance double")
    good = found.select("c_custkey", F.lit(None).cast("string").alias("reason"), "balance")
    ids = F.coalesce(F.regexp_extract("text", r"Customer#0*(\d+)", 1).try_cast("long"), F.element_at(F.split("text", "[,;]"), F.when(F.contains("text", F.lit(";")), 2).otherwise(1)).try_cast("long"))
    return good.unionByName(rejects.select(ids.alias("c_custkey"), "reason", F.lit(None).cast("double").alias("balance")))


@query(
    "with c as (select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then c_custkey // 2 end id, c_mktsegment seg from customer), "
    "p as (select *, (select count(distinct seg) from c x where x.id = c.id) > 1 clash, row_number() over (partition by id order by c_custkey) rn from c) "
    "select c_custkey, 'players' part from p where id is null or clash or rn = 1 union all select c_custkey, 'conflicts' from p where clash and id is not null"
)
def players_dedup(spark, sf):
    """N8 as a whole: customers two to an id, those of one segment without an id: what stays, and what is reported."""
    url = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.concat(F.lit("https://x/joueur/"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("-a"))).otherwise(F.lit("https://x/club"))
    players = t(spark, sf, "customer").select(url.alias("player_url"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    kept, conflicts = Q.dedup_players(players, "c_custkey")
    return kept.select("c_custkey", F.lit("players").alias("part")).unionByName(conflicts.select("c_custkey", F.lit("conflicts").alias("part")))


_STATS = "select o_orderkey match_id, year(o_orderdate)::varchar season, month(o_orderdate)::int rnd, case when o_orderstatus <> 'P' then o_totalprice end a, case when o_orderpriority <> '5-LOW' then o_custkey end b, toxic hp, quality ap from orders left join labels on doc_id = o_orderkey"


@query(
    f"with s as ({_STATS}), r as (select *, case when (a is not null)::int + (b is not null)::int + (hp is not null)::int + (ap is not null)::int < 2 then 'missing_data' when hp = 0 and ap = 0 then 'all_zero_stats' end reason from s) "
    "select match_id, season, rnd, reason, case when reason is null then 'kept' else 'dropped' end part from r"
)
def bad_rows_split(spark, sf):
    """P9-P11 as a whole: the kept statistics and the log of those that were dropped."""
    lab = t(spark, sf, "labels").select(F.col("doc_id").alias("o_orderkey"), F.col("toxic").alias("home_passes"), F.col("quality").alias("away_passes"))
    o = t(spark, sf, "orders").join(lab, "o_orderkey", "left")
    a, b = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    stats = o.select(F.col("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy").alias("season"), F.month("o_orderdate").alias("round"), a.alias("a"), b.alias("b"), "home_passes", "away_passes")
    kept, log = Q.drop_bad_rows(stats)
    kept = kept.select("match_id", "season", "round", F.lit(None).cast("string").alias("reason"), F.lit("kept").alias("part"))
    return kept.unionByName(log.withColumn("part", F.lit("dropped"))).withColumnRenamed("round", "rnd")


@query(
    "select name, figure from (select count(*)::double as \"rows\", count(*) filter (where o_orderkey is null)::double unmatched, round(100.0 * count(*) filter (where l_returnflag = 'R') / count(*), 6) returned, "
    "count(*) filter (where o_orderstatus = 'F')::double \"n_F\" from lineitem left join orders on o_orderkey = l_orderkey) unpivot (figure for name in (\"rows\", unmatched, returned, \"n_F\"))"
)
def stage_report(spark, sf):
    """A join that is checked and reported by the very job that stores it."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    joined = t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    sound = P.checked(joined, F.col("l_quantity") < 0, "negative quantity", "l_orderkey", "l_quantity")
    out, seen = P.observed(sound, "lines", returned=P.share_of(F.col("l_returnflag") == "R"), **P.unmatched("o_orderkey"), **P.coverage_figures("o_orderstatus", ["F"]))
    staged(out, "reported")
    return spark.createDataFrame([(k, float(v)) for k, v in seen.get.items()], "name string, figure double")
