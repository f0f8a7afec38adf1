"""The table functions of HTML pages in SQL (H1-H14), after ``register(spark)``:

    SELECT p.page_id, l.* FROM pages p, LATERAL html_rows(p.html, 'links') l
    SELECT * FROM html_pages(TABLE(pages) PARTITION BY (page_id), 'headings')

``html_rows`` gives the rows of one page, ``html_pages`` those of a table's pages with their key columns.  What
the rows are is the constant ``layout``; ``analyze`` tells Spark their columns before a row is read.  ``squads``
also takes the page's competition, as a third argument or as a column of the table.  A null page has the rows of
an empty one.  ``html_matches`` reads whole statistics pages, a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from . import html as H

_INT, _TEXT = T.IntegerType(), T.StringType()
_BARS = {"stat": _TEXT, "home": _INT, "away": _INT}
#: Columns and rows of each layout.
LAYOUTS: dict[str, tuple[dict[str, T.DataType], Callable]] = {
    "links": ({"href": _TEXT, "label": _TEXT}, H._links),
    "headings": ({"level": _INT, "heading": _TEXT}, H._headings),
    "tables": ({"table_no": _INT, "row_no": _INT, "cells": T.ArrayType(_TEXT)}, H._table_rows),
    "round": ({"url": _TEXT, "home_team": _TEXT, "away_team": _TEXT}, H._round),
    "bars": (_BARS, H._bars(H.BARS)),
    "percents": (_BARS, H._bars(H.PERCENTS, True)),
    "cards": ({f"{s}_{c}_cards": _INT for c in ("yellow", "red") for s in ("home", "away")}, lambda t, _: [H._cards(t)]),
    "rosters": ({f"{s}_{n}": _INT for s in ("home", "away") for n in H.ROSTER_STATS.values()}, H._roster_stats),
    "players": ({"pos": _INT, "url": _TEXT}, H._players(False)),
    "roster_players": ({"pos": _INT, "url": _TEXT}, H._players(True)),
    "career": ({"season": _TEXT, "pos": _INT, "division": _TEXT, "club": _TEXT, "matches_text": _TEXT, "minutes_text": _TEXT}, lambda t, _: H._career(t)),
    "person": ({"raw_name": _TEXT, "nationality": _TEXT}, lambda t, _: [H._person(t)]),
    "minutes": ({"player_id": T.LongType(), "team": _TEXT, "minutes_played": _INT}, lambda t, _: H._minutes(t)),
    "squads": ({"player_name": _TEXT}, H._named),
}


def _columns(layout: AnalyzeArgument) -> T.StructType:
    if not layout.isConstantExpression or layout.value not in LAYOUTS:
        raise ValueError(f"the layout must be a constant, one of {', '.join(LAYOUTS)}")
    return T.StructType([T.StructField(n, kind) for n, kind in LAYOUTS[layout.value][0].items()])


class PageRows:
    """The rows of a page."""

    @staticmethod
    def analyze(html: AnalyzeArgument, layout: AnalyzeArgument, competition: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(html.dataType, (T.StringType, T.NullType)):
            raise ValueError("html must be a string")
        return AnalyzeResult(_columns(layout))

    def eval(self, html: str | None, layout: str, competition: str | None = None) -> Iterator[tuple]:
        yield from H.page_rows(LAYOUTS[layout][1], html, {"competition": competition})


class TablePages:
    """The rows of the pages of a table, after the table's other columns."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, layout: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or "html" not in pages.dataType.names:
            raise ValueError("the first argument must be a table with a column html")
        own = [f for f in pages.dataType if f.name != "html"]
        new = _columns(layout).fields
        clash = {f.name.lower() for f in own} & {f.name.lower() for f in new}
        return AnalyzeResult(T.StructType([*own, *(T.StructField(f"{f.name}_found" if f.name.lower() in clash else f.name, f.dataType) for f in new)]))

    def eval(self, page, layout: str) -> Iterator[tuple]:
        own = page.asDict()
        html = own.pop("html")
        for row in H.page_rows(LAYOUTS[layout][1], html, {"competition": own.get("competition")}):
            yield (*own.values(), *row)


class MatchPage:
    """H14 of one statistics page, in one pass over its tree: a row of bars, percentages, cards and rosters."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        bars = [f"{side}_{stat}" for stat in (*H.BARS, *H.PERCENTS) for side in ("home", "away")]
        return AnalyzeResult(T.StructType([T.StructField(n, _INT) for n in (*bars, *LAYOUTS["cards"][0], *LAYOUTS["rosters"][0])]))

    def eval(self, html: str | None) -> Iterator[tuple]:
        tree = H.parse(html)
        out: list = []
        for layout in ("bars", "percents"):
            for _, home, away in LAYOUTS[layout][1](tree, {}):
                out += [home, away]
        yield (*out, *H._cards(tree), *H._roster_stats(tree, {})[0])


def register(spark: SparkSession) -> None:
    for name, made in (("html_rows", PageRows), ("html_pages", TablePages), ("html_matches", MatchPage)):
        spark.udtf.register(name, udtf(made))


def page_rows(pages: DataFrame, keys: list[str], layout: str) -> DataFrame:
    """``html_rows`` beside the key columns, from the DataFrame API."""
    from pyspark.sql import functions as F

    made = udtf(PageRows)
    left = pages.select(*keys, "html")
    return left.lateralJoin(made(F.col("html").outer(), F.lit(layout))).drop("html")
