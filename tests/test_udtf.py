"""The page functions in SQL, equal to their DataFrame forms."""

import gc
import random

import pytest
from pyspark.sql import functions as F

from touchline.plans import pages as P
from touchline.sources import html as H
from touchline.sources import udtf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    udtf.register(spark)
    df = spark.read.parquet(f"{SF}/pages.parquet").union(spark.createDataFrame([(-1, "x", None), (-2, "x", "")], "page_id long, url string, html string"))
    df.createOrReplaceTempView("some_pages")
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("layout, plain", [("links", H.links), ("headings", H.headings), ("tables", H.table_rows)])
def test_sql_equals_the_dataframe_form(spark, pages, layout, plain):
    want = plain(pages, ["page_id"])
    names = ", ".join(want.columns[1:])
    assert rows_of(spark.sql(f"SELECT p.page_id, {names} FROM some_pages p, LATERAL html_rows(p.html, '{layout}')")) == rows_of(want)
    assert rows_of(spark.sql(f"SELECT page_id, {names} FROM html_pages(TABLE(SELECT page_id, html FROM some_pages) PARTITION BY (page_id), '{layout}')")) == rows_of(want)
    assert rows_of(udtf.page_rows(pages, ["page_id"], layout).select(want.columns)) == rows_of(want)


def made(spark, inside):
    spark.createDataFrame([(1, inside), (2, None)], "k long, html string").createOrReplaceTempView("one_page")
    return spark.table("one_page")


def test_every_layout_has_its_columns(spark, pages):
    for layout, (columns, _) in udtf.LAYOUTS.items():
        df = spark.sql(f"SELECT r.* FROM VALUES ('<p>x</p>') p(html), LATERAL html_rows(p.html, '{layout}', 'x') r")
        assert df.schema.names == list(columns), layout
        df.collect()


def test_squads_take_the_competition(spark, pages):
    page = '<table><tr><td style="width:50%"><table><tr><td>1</td><td>PR</td><td>Ann Lee (c)</td></tr></table></td></tr></table>'
    made(spark, page)
    assert spark.sql("SELECT player_name FROM one_page p, LATERAL html_rows(p.html, 'squads', 'End of Year Internationals')").collect()[0][0] == "Ann Lee"
    spark.sql("SELECT k, html, 'End of Year Internationals' AS competition, 'x' AS player_name FROM one_page").createOrReplaceTempView("squad_pages")
    out = spark.sql("SELECT * FROM html_pages(TABLE(squad_pages) PARTITION BY (k), 'squads')")
    assert out.columns == ["k", "competition", "player_name", "player_name_found"] and out.first()["player_name_found"] == "Ann Lee"


def test_match_pages(spark, pages):
    bar = '<div class="stats-bar"><div class="stats-bar__title">Essais accordés</div><div class="stats-bar__val stats-bar__val--left">3</div><div class="stats-bar__val stats-bar__val--right">-</div></div>'
    df = made(spark, bar)
    info = spark.createDataFrame([(1, "2023-2024", "d", "t", 1, 1), (2, "2023-2024", "d", "t", 1, 1)], "match_id long, season string, match_date string, match_time string, home_score int, away_score int")
    want = H.match_rows(df.withColumnRenamed("k", "match_id"), info)
    got = spark.sql("SELECT p.k AS match_id, m.* FROM one_page p, LATERAL html_matches(p.html) m")
    assert set(got.columns) <= set(want.columns) and rows_of(got) == rows_of(want.select(got.columns))
    assert got.where("match_id = 1").first()["home_tries"] == 3


@pytest.mark.parametrize("call", ["html_rows('x', 'nothing')", "html_rows('x', html)", "html_rows(1, 'links')", "html_pages(TABLE(SELECT 1 AS a), 'links')"])
def test_wrong_calls_are_refused_at_analysis(spark, pages, call):
    with pytest.raises(Exception, match="layout|html"):
        spark.sql(f"SELECT * FROM some_pages p, LATERAL {call}").collect()


def test_a_page_is_of_few_rows(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    assert o.groupBy(F.floor(F.col("o_orderkey") / 16)).count().agg(F.max("count")).first()[0] <= 16 and P.html_rounds


def test_plain_pages_and_parsed_ones_are_one_tree():
    """A page is cut at its tags or goes through the parser: the same nodes, texts and answers."""
    bits = ['<div class="a b">', "</div>", "<p>", "</p>", '<a href="/x?a=1&amp;b=2&copy=3">', "</a>", " x &amp; y ", "&amp", "<br/>", "<td>", "<tr>", "<table>", "</table>", "<!-- a > b -->", '<script>a<b "</div>"</script>', "<title>t &lt;</title>", "<title>", "a < b", "<a href=x>", "<A HREF='q\"q' disabled>", '<div class="x>y">', "<!DOCTYPE html>", "</br>", "<style>", "</style>"]
    see = lambda tree: [(n.tag, n.attrs, n.text(), n.stripped(), len(n.all())) for n in (H.Node(tree, 0), *H.Node(tree, 0).all()) if n.tag not in ("script", "style")]
    draw, plain = random.Random(3), 0
    for _ in range(4000):
        page = "".join(draw.choices(bits, k=draw.randrange(12)))
        quick = H._plain(page)
        if quick is not None:
            plain += 1
            assert see(quick) == see(H._parsed(page)), page
    assert plain > 500


def test_a_page_leaves_no_cycles():
    gc.collect()
    gc.disable()
    try:
        for page in ('<div class="a"><p>x</p></div>' * 50, "<div class=a><p>x</p></div>" * 50):
            H.parse(page).all("p")
        assert gc.collect() < 100  # a cyclic tree left some hundreds of objects
    finally:
        gc.enable()


def test_match_pages_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = P.html_match_pages(spark, str(tmp_path))
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 and df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_headings_keep_references_without_their_end(spark, pages):
    """A title that is cut inside a reference, and one with tags inside, as the query's SQL reads them."""
    df = made(spark, "<h1>The &amp; ox &amp</h1><h2>one <b>two</b>\n three &lt;</h2><h3>a & b &amp;lt;</h3>")
    want = [(1, 1, "The & ox &amp"), (1, 2, "one two three <"), (1, 3, "a & b &lt;")]
    assert rows_of(H.headings(df, ["k"])) == want
    assert rows_of(spark.sql("SELECT k, level, heading FROM one_page p, LATERAL html_rows(p.html, 'headings')")) == want


def test_long_batches_of_pages_are_handed_on_in_parts(spark):
    """Arrow batches of pages are bounded, and each different tag is read once."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("<table>" + "<tr><td>x</td></tr>" * 16 + "</table>").alias("html")).coalesce(1)
    assert H.table_rows(df, ["k"]).count() == 48_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= H.PAGES
    H._mark.cache_clear()
    H.parse("<p class='a'>x</p>" * 100)
    assert H._mark.cache_info().misses == 2
