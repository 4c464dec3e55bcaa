"""The crawl as a loop of batches: draw, fetch, store, extract links, admit.

Fetching is a function from a DataFrame of URLs to a DataFrame of pages, so that it can be a data source, a table of pages fetched
before (as in tests) or anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import canonical_links
from webloom.operators import frontier
from webloom.sources.tables import reliable

Fetch = Callable[[DataFrame], DataFrame]


def from_pages(store: DataFrame) -> Fetch:
    """Fetches by looking pages up in a page_store."""
    return lambda urls: urls.select("url_key").join(store.withColumnRenamed("page_key", "url_key"), "url_key").select("url_key", "url", "html")


def crawl(seeds: DataFrame, fetch: Fetch, rounds: int, batch: int = frontier.BATCH, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """seeds(url) -> (pages(url_key, url, html, round), frontier that is left (url_key, url, host, part, arrival)).

    A URL is tried once, found or not. Each round ends in a checkpoint, so that the plan doesn't grow with the rounds.
    """
    spark = seeds.sparkSession
    none = spark.createDataFrame([], "url_key string")
    waiting = frontier.admit(seeds.withColumn("arrival", F.lit(0)), none)
    tried, pages = none, None
    for k in range(1, rounds + 1):
        drawn = reliable(frontier.draw(waiting, batch, seed + k))
        got = reliable(fetch(drawn).withColumn("round", F.lit(k)))
        tried = reliable(tried.union(drawn.select("url_key")))
        pages = got if pages is None else pages.unionByName(got)
        links = got.select(F.explode_outer(canonical_links(F.col("html"), F.col("url"))).alias("url"), F.lit(k).alias("arrival")).where("url is not null")
        known = tried.union(waiting.select("url_key"))
        left = waiting.join(drawn.select("url_key"), "url_key", "left_anti")
        waiting = reliable(left.unionByName(frontier.admit(links, known)))
    return pages, waiting
