"""Web pages and JSON as a Spark data source (S6-S13): ``spark.read.format("touchline_web")``.

Options: ``urls`` (newline-separated), ``delay`` seconds between requests of a partition, ``timeout``
seconds, ``per_partition`` addresses for each partition, ``agent``.  ``fetch_all`` takes addresses from any
table instead.  Rows: url, status, body, error.  A failed request gives a row with its error, never an
exception, so one bad address doesn't end a crawl.  Scripted pages have to be
rendered by something else; their HTML then enters as a table (url, html, render_complete): ``strict``
keeps what was rendered in full, ``lenient`` keeps all.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, body string, error string"


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)
        self.urls = urls


def fetch(url: str, timeout: float, agent: str) -> tuple:
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return url, getattr(r, "status", None) or 200, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return url, e.code, None, f"HTTP {e.code}"
    except TimeoutError:
        return url, None, None, "timeout"
    except Exception as e:  # noqa: BLE001  whatever fails is the row's error
        return url, None, None, f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        urls = [u.strip() for u in self.options["urls"].split("\n") if u.strip()]
        each = int(self.options.get("per_partition", 50))
        return [_Part(urls[i : i + each]) for i in range(0, len(urls), each)] or [_Part([])]

    def read(self, partition):
        delay, timeout = float(self.options.get("delay", 1.0)), float(self.options.get("timeout", 10))
        for i, url in enumerate(partition.urls):
            if i and delay:
                time.sleep(delay)
            yield fetch(url, timeout, self.options.get("agent", "touchline"))


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "touchline_web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)


def fetch_rows(asked: DataFrame, delay: float = 1.0, timeout: float = 10, agent: str = "touchline") -> DataFrame:
    """What the addresses of rows (..., url) answer, beside the other columns; a partition waits between its requests."""
    others = [c for c in asked.columns if c != "url"]
    schema = ", ".join([*[f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in others], SCHEMA])

    def run(batches):
        first = True
        for pdf in batches:
            for i, url in enumerate(pdf["url"]):
                if not first and delay:
                    time.sleep(delay)
                first = False
                answer = pd.DataFrame([fetch(url, timeout, agent)], columns=["url", "status", "body", "error"]).astype({"status": "Int32"})
                yield pd.concat([pdf[others].iloc[i : i + 1].reset_index(drop=True), answer], axis=1)

    return asked.mapInPandas(run, schema)


def fetch_all(urls: DataFrame, column: str = "url", delay: float = 1.0, timeout: float = 10, agent: str = "touchline", partitions: int | None = None) -> DataFrame:
    """What the addresses of a table answer, each asked once; a partition waits between its requests."""
    asked = urls.select(F.trim(column).alias("url")).where("url <> ''").distinct()
    return fetch_rows(asked.repartition(partitions, "url") if partitions else asked, delay, timeout, agent)


def wiki_urls(windows: DataFrame, url: str = "url") -> DataFrame:
    """Rows with a wiki address; null addresses and others are left out."""
    return windows.where(F.col(url).isNotNull() & F.contains(F.col(url), F.lit("wiki")))


def season_urls(seasons: DataFrame, base: str, rounds: int = 26) -> DataFrame:
    """The calendar address of every round of the seasons in a table (season)."""
    every = seasons.select("season", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return every.select("season", "round", F.format_string(f"{base.rstrip('/')}/%s/j%d", "season", "round").alias("url"))


def round_urls(spark: SparkSession, seasons: list[str], base: str, rounds: int = 26) -> DataFrame:
    """The calendar address of every season and round."""
    return season_urls(spark.createDataFrame([(x,) for x in seasons], "season string"), base, rounds)


def rendered(pages: DataFrame, strict: bool) -> DataFrame:
    """Pages that scripts have rendered.  Strict: only those rendered to the end; lenient: whatever
    HTML there was when the wait ended.  Pages without HTML gave nothing and have no row."""
    some = pages.where("html is not null")
    return some.where(F.coalesce("render_complete", F.lit(False))) if strict else some


def expanded(steps: DataFrame, clicks: int = 10) -> DataFrame:
    """(url, html), the HTML of a page and of what up to ``clicks`` clicks added, in order.

    steps: (url, step, html), step 0 the page itself."""
    held = steps.where((F.col("step") <= clicks) & F.col("html").isNotNull()).groupBy("url")
    return held.agg(F.sort_array(F.collect_list(F.struct("step", "html"))).alias("_parts")).select("url", F.array_join("_parts.html", "\n").alias("html"))


def weather_urls(matches: DataFrame, api: str, variables: list[str], zone: str = "Europe/Paris") -> DataFrame:
    """The request of each match with coordinates."""
    q = F.format_string(f"{api}?latitude=%s&longitude=%s&start_date=%s&end_date=%s&hourly={','.join(variables)}&timezone={zone}", F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.col("match_date").cast("string"), F.col("match_date").cast("string"))
    return matches.where("latitude is not null and longitude is not null").select("match_id", q.alias("url"))


def weather_answers(fetched: DataFrame, requests: DataFrame) -> DataFrame:
    """(match_id, body, problem): each request's JSON, or null and the kind of what went wrong."""
    bad = F.when(F.col("error") == "timeout", "timeout").when(F.startswith(F.col("error"), F.lit("HTTP ")), "http").when(F.col("error").isNotNull(), "connection")
    ok = F.try_variant_get(F.try_parse_json("body"), "$.hourly", "variant").isNotNull()
    problem = F.coalesce(bad, F.when(F.col("body").isNull(), "no answer").when(~ok, "no hourly data"))
    answered = requests.join(fetched, "url", "left").withColumn("problem", problem)
    return answered.select("match_id", F.when(F.col("problem").isNull(), F.col("body")).alias("body"), "problem")


def primary_else_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The first parser's rows, and the second's for pages where the first found none."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))
