"""Crawl frontier in batch form: admission, host limits, politeness, back-off, draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.urls import MAX_URLS_PER_HOST, canonical_url, host_partition, host_suffix, is_crawlable, url_host, url_key

PARTITIONS, BATCH = 2000, 200
DELAY_S = 15
MAX_FAILURES = 10
TOP_HOSTS, LEAST_DOWNLOADS = 100, 20


def prepared(urls: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """urls(url, ...) -> canonical and crawlable ones with key, host and frontier partition; other columns stay."""
    u = urls.withColumn("url", canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    u = u.where(is_crawlable(F.col("url"))).withColumn("host", url_host(F.col("url")))
    return u.withColumn("url_key", url_key(F.col("url"))).withColumn("part", host_partition(F.col("host"), partitions))


def within_host_limit(urls: DataFrame, order: str = "arrival", limit: int = MAX_URLS_PER_HOST) -> DataFrame:
    """The first so many rows of each host, repeats of a URL counted as well. Only hosts over the limit are sorted."""
    over = urls.groupBy("host").count().where(F.col("count") > limit).select("host")
    k = F.row_number().over(Window.partitionBy("host").orderBy(order, "url_key"))
    first = urls.join(over, "host", "left_semi").withColumn("k", k).where(F.col("k") <= limit).drop("k")
    return urls.join(over, "host", "left_anti").unionByName(first)


def admit(urls: DataFrame, known: DataFrame, order: str = "arrival", partitions: int = PARTITIONS, limit: int = MAX_URLS_PER_HOST) -> DataFrame:
    """New URLs for the frontier: canonical, crawlable, within their host's limit, not among known(url_key), each once (the earliest)."""
    u = within_host_limit(prepared(urls, partitions), order, limit)
    first = u.groupBy("url_key").agg(F.min(F.struct(order, "url", "host", "part")).alias("u"))
    return first.join(known.select("url_key").distinct(), "url_key", "left_anti").select("url_key", "u.url", "u.host", "u.part", f"u.{order}")


def draw(frontier: DataFrame, n: int = BATCH, seed: int = 0) -> DataFrame:
    """A batch of random URLs of the frontier."""
    return frontier.orderBy(F.xxhash64(F.lit(seed), "url_key"), "url_key").limit(n)


def polite_schedule(visits: DataFrame, delay: int = DELAY_S) -> DataFrame:
    """visits(host, at seconds, seq) -> start: the earliest time from `at` on that is `delay` after the host's visit before.

    With visits in order, start(i) = max over j <= i of at(j) + delay * (i - j): a running maximum, not a loop.
    """
    w = Window.partitionBy("host").orderBy("at", "seq")
    v = visits.withColumn("i", F.row_number().over(w))
    top = F.max(F.col("at") - delay * F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return v.withColumn("start", top + delay * F.col("i")).drop("i")


def failure_streaks(visits: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """visits(host, at, seq, failed) -> failures in a row before each visit, and whether the host is backed off from then."""
    w = Window.partitionBy("host").orderBy("at", "seq")
    v = visits.withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    v = v.withColumn("run", F.coalesce("run", F.lit(0)))
    in_run = Window.partitionBy("host", "run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("failures", F.coalesce(F.sum(F.col("failed").cast("int")).over(in_run), F.lit(0)))
    return v.withColumn("backed_off", F.col("failures") > most).drop("run")


def top_hosts(urls: DataFrame, least: int = LEAST_DOWNLOADS, most: int = TOP_HOSTS) -> DataFrame:
    """Hosts by number of downloads, of those with at least so many."""
    return urls.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "host").limit(most)


def host_groups(urls: DataFrame) -> DataFrame:
    """Number of URLs and hosts by the suffix that owns them."""
    return urls.groupBy(host_suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))
