"""Registered queries of the page functions (H1-H14): rows of the tables are rendered as the pages that the
functions read, and what comes back is held against the rows.  A page is of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import udtf
from .registry import query, t


def div(cls: str, *inside) -> Column:
    return F.concat(F.lit(f'<div class="{cls}">'), *inside, F.lit("</div>"))


def said(x) -> Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def joined(order: list[str], part: Column, out: str, only: Column | None = None) -> Column:
    """Aggregate: the parts of a page in order, as one text; only those rows where ``only`` is true."""
    item = F.struct(*order, part.alias("x"))
    item = item if only is None else F.when(only, item)
    return F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda p: p["x"]), "").alias(out)


def tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@query("select concat('S', o_orderkey // 16 % 5) season, o_orderkey // 16 rnd, concat('/feuille/j', o_orderkey // 16, '/', o_orderkey, '-a-b') url, concat('Club ', o_custkey) home_team, concat('Stade ', o_orderpriority) away_team, o_orderkey::varchar match_id from orders")
def html_rounds(spark, sf):
    """H1: a page for each sixteen matches."""
    k = F.col("o_orderkey")
    page = F.floor(k / 16)
    link = F.concat(F.lit('<a class="match-line__score" href="/feuille/j'), said(page), F.lit("/"), said(k), F.lit('-a-b">20 - 3</a>'))
    club = lambda text: F.concat(F.lit('<a class="club-line__name"> '), text, F.lit("\n</a>"))
    line = div("match-line other", club(F.concat(F.lit("Club "), said("o_custkey"))), link, club(F.concat(F.lit("Stade "), F.col("o_orderpriority"))))
    o = t(spark, sf, "orders").withColumns({"round": page, "season": F.concat(F.lit("S"), said(page % 5))})
    pages = o.groupBy("season", "round").agg(joined(["o_orderkey"], line, "html"))
    return H.round_matches(pages).select("season", F.col("round").alias("rnd"), "url", "home_team", "away_team", "match_id")


_BARS = {"tries": "o_orderkey % 7", "passes": "o_custkey % 300", "tackles_made": "o_orderkey % 150"}


def _bar(label: str, home: Column, away: Column) -> Column:
    val = lambda side, x: div(f"stats-bar__val stats-bar__val--{side}", F.lit(" "), x, F.lit(" "))
    return div("stats-bar", div("stats-bar__title", F.lit(f" {label} ")), val("left", home), val("right", away))


@query(
    "select o_orderkey match_id, "
    + ", ".join(f"({e})::int home_{s}, ({e} + 1)::int away_{s}" for s, e in _BARS.items())
    + ", (o_orderkey % 101)::int home_possession, null::int away_possession, (o_orderkey % 3)::int home_yellow_cards, (o_custkey % 2)::int away_red_cards, "
    "(o_orderkey % 5 + o_orderkey % 3)::int home_offloads, (o_orderkey % 4)::int away_turnovers from orders"
)
def html_match_pages(spark, sf):
    """A statistics page for each match, read in SQL by one table function."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bars = [_bar(H.BARS[s], said(F.expr(e)), said(F.expr(e) + 1)) for s, e in _BARS.items()]
    share = _bar(H.PERCENTS["possession"], F.concat(said(k % 101), F.lit(".9 %")), F.lit("unknown"))
    card = lambda color, n: div(f"stats-cards-fault stats-cards-fault--{color}", div("stats-cards-fault__container", div("stats-cards-fault__card", said(n))))
    side = lambda yellow, red: div("match-statistics__cards-team", card("yellow", yellow), card("red", red))
    cell = lambda part, n: div(f"player-row__cell player-row__cell--{part}", said(n), F.lit(" x"))
    home = div("match-statistics__roster", cell("offload", k % 5), cell("offload", k % 3))
    away = div("match-statistics__roster", cell("breakdownSteals", k % 4))
    page = F.concat(*bars, share, div("match-statistics__cards", side(k % 3, F.lit(0)), side(F.lit(1), c % 2)), home, away)
    udtf.register(spark)
    # pages are made after the rows are dealt, as the table may be one small file and reading a page is long work
    dealt = t(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(tasks(spark), "o_orderkey")
    dealt.select(k.alias("match_id"), page.alias("html")).createOrReplaceTempView("touchline_match_pages")
    names = [*(f"{s}_{b}" for b in _BARS for s in ("home", "away")), "home_possession", "away_possession", "home_yellow_cards", "away_red_cards", "home_offloads", "away_turnovers"]
    return spark.sql(f"SELECT p.match_id, {', '.join(f'm.{n}' for n in names)} FROM touchline_match_pages p, LATERAL html_matches(p.html) m")


@query(
    "with u as (select l_orderkey, l_partkey, min(l_linenumber) first from lineitem group by all) "
    "select l_orderkey match_id, (row_number() over (partition by l_orderkey order by first, l_partkey) - 1)::int pos, concat('https://rugby.example/joueur/', l_partkey, '-x') url from u"
)
def html_player_urls(spark, sf):
    """H6: the players that a page links, each once."""
    li = t(spark, sf, "lineitem")
    link = F.concat(F.lit('<p><a href="/joueur/'), said("l_partkey"), F.lit('-x">p</a><a href="/club/1">c</a>'))
    pages = li.groupBy(F.col("l_orderkey").alias("match_id")).agg(joined(["l_linenumber", "l_partkey"], link, "html"))
    return H.player_urls(pages, ["match_id"], "https://rugby.example")


@query(
    "with l as (select l_orderkey k, 1992 + l_linenumber % 3 season, 'C' || l_suppkey club, l_suppkey club_no, l_returnflag <> 'R' top, l_linenumber n, l_quantity::int mins from lineitem), "
    "b as (select *, row_number() over (partition by k, season order by mins desc, n, club_no) rn from l where top and (n <> 0 or mins <> 0)) "
    "select k, season::varchar season, club, round(mins / n, 1) avg_min from b where rn = 1"
)
def html_careers(spark, sf):
    """A player's career page for each order, a line for each of its lines, and the best club of a season."""
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (1992 + F.col("l_linenumber") % 3).alias("year"), "l_suppkey", "l_returnflag", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("mins"))
    cell = lambda x: div("history-season-cell__content", F.lit(" "), x)
    label = div("history-season-line history-season-line--season-line", cell(said("year")))
    division = F.when(F.col("l_returnflag") == "R", "Pro D2").otherwise("Top 14")
    line = div("history-season-line", cell(division), cell(F.concat(F.lit("C"), said("l_suppkey"))), cell(said("n")), cell(said("mins")))
    head = F.lit('<div class="history-season-line history-season-line--header-line"></div>')
    order = ["n", "l_suppkey", "mins", "l_returnflag"]
    both = li.groupBy("k").agg(joined(order, label, "left"), joined(order, line, "right"))
    pages = both.select("k", F.concat(div("history-season-list__season-column", head, F.col("left")), div("history-season-list__other-columns", head, F.col("right"))).alias("html"))
    seasons = ["1992", "1993", "1994"]
    wide = H.best_season(H.career_rows(pages, ["k"]), ["k"], seasons)
    long = F.inline(F.array(*[F.struct(F.lit(s).alias("season"), F.col(f"{s}_team").alias("club"), F.col(f"{s}_avg_min").alias("avg_min")) for s in seasons]))
    return wide.select("k", long).where("club is not null")


@query("select c_custkey k, c_mktsegment[1] || lower(c_mktsegment[2:]) first_name, n_name last_name, c_mktsegment[1] || lower(c_mktsegment[2:]) || ' ' || n_name[1] || lower(n_name[2:]) full_name, n_name nationality from customer join nation on c_nationkey = n_nationkey")
def html_people(spark, sf):
    """A profile for each customer; of every third the name is in the page's shared title only."""
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" "), F.col("n_name"))
    title = F.concat(F.lit('<meta property="og:title" content="'), name, F.lit(' | site">'))
    heading = F.concat(F.lit('<h1 class="title player-heading__name">\n '), name, F.lit(" </h1>"))
    flag = F.concat(F.lit('<img class="player-infos__attribute-flag" alt=" '), F.col("n_name"), F.lit('">'))
    pages = c.select(F.col("c_custkey").alias("k"), F.concat(F.when(F.col("c_custkey") % 3 == 0, title).otherwise(heading), flag).alias("html"))
    return H.person(pages, ["k"])


@query(
    "with l as (select l_orderkey match_id, l_partkey player_id, case l_linestatus when 'O' then 'Home' else 'Away' end team, l_linenumber n, case when l_discount >= 0.05 then l_quantity::int else 0 end m from lineitem), "
    "one as (select * from (select *, row_number() over (partition by match_id, team, player_id order by n, m) rn from l) where rn = 1) "
    "select match_id, player_id, team, case when max(m) over (partition by match_id, team) > 0 then m end minutes_played from one"
)
def html_minutes(spark, sf):
    """The minutes of both sides of each match; a side of zeros is unknown."""
    li = t(spark, sf, "lineitem")
    name = F.concat(F.lit('<a class="player-cell__name" href="/joueur/'), said("l_partkey"), F.lit('-x">x</a>'))
    minutes = F.when(F.round("l_discount", 4) >= 0.05, F.col("l_quantity").cast("int")).otherwise(0)
    li, order = li.withColumn("m", minutes), ["l_linenumber", "l_partkey", "m"]
    row = div("player-row", name, div("player-row__cell player-row__cell--tempsJeu", said("m"), F.lit("'")))
    home = F.col("l_linestatus") == "O"
    both = li.groupBy(F.col("l_orderkey").alias("match_id")).agg(joined(order, row, "h", home), joined(order, row, "a", ~home))
    button = lambda s, x: F.lit(f'<button class="switcher-buttons__button switcher-buttons__button--{s}"> {x} </button>')
    switch = div("switcher-buttons__container", button("home", "Home"), button("away", "Away"))
    page = div("match-statistics__roster-players", switch, div("match-statistics__roster", F.col("h")), div("match-statistics__roster", F.col("a")))
    return H.player_minutes(both.select("match_id", page.alias("html")))


@query("select distinct p_partkey // 8 page, case when p_partkey // 8 % 2 = 0 then '6 Nations' else 'End of Year Internationals' end competition, p_name player_name from part")
def html_squads(spark, sf):
    """Squads as a table or as a line-up, by the competition's layout; a page for eight players."""
    p = t(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / 8))
    row = F.concat(F.lit("<tr><td><a>"), F.col("p_name"), F.lit("</a> (c)</td><td>Prop</td><td>1</td></tr>"))
    slot = F.concat(F.lit("<tr><td>1</td><td>PR</td><td>"), F.col("p_name"), F.lit(" (c)</td></tr>"))
    both = p.groupBy("page").agg(joined(["p_partkey"], row, "rows"), joined(["p_partkey"], slot, "slots"))
    squad = F.concat(F.lit('<table class="wikitable"><tr><th>Player</th><th>Position</th><th>Date of birth (age)</th></tr>'), F.col("rows"), F.lit("<tr><td>Head coach</td><td>x</td></tr></table>"))
    lineup = F.concat(F.lit('<table><tr><td style="width: 50%"><table>'), F.col("slots"), F.lit("</table></td></tr></table>"))
    even = F.col("page") % 2 == 0
    pages = both.select("page", F.when(even, "6 Nations").otherwise("End of Year Internationals").alias("competition"), F.when(even, squad).otherwise(lineup).alias("html"))
    return H.squad_players(pages, ["page", "competition"])


@query("select n_regionkey k, 0 table_no, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int row_no, concat(n_nationkey, '|', n_name) cells from nation")
def html_region_tables(spark, sf):
    """The cells of tables, by a table function over partitions of a table of pages."""
    n = t(spark, sf, "nation")
    row = F.concat(F.lit("<tr><td>"), said("n_nationkey"), F.lit("<th> "), F.col("n_name"), F.lit("</tr>"))
    pages = n.groupBy(F.col("n_regionkey").alias("k")).agg(joined(["n_nationkey"], row, "rows")).select("k", F.concat(F.lit("<table>"), F.col("rows"), F.lit("</table>")).alias("html"))
    udtf.register(spark)
    pages.createOrReplaceTempView("touchline_region_pages")
    return spark.sql("SELECT k, table_no, row_no, array_join(cells, '|') AS cells FROM html_pages(TABLE(touchline_region_pages) PARTITION BY (k), 'tables')")
