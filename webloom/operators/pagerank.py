"""PageRank over resolved links, with a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import canonical_links
from webloom.functions.urls import url_key
from webloom.sources.tables import reliable

DAMPING, CAP = 0.85, 100.0


def resolved_links(store: DataFrame) -> DataFrame:
    """page_store -> links (src, dst) between stored pages: distinct, links of a page to itself kept.

    Pages whose key isn't that of their URL give no links.
    """
    sound = store.where(F.col("page_key") == url_key(F.col("url")))
    found = sound.select(F.col("page_key").alias("src"), F.explode_outer(F.array_distinct(canonical_links(F.col("html"), F.col("url")))).alias("target"))
    keyed = found.where("target is not null").select("src", url_key(F.col("target")).alias("dst"))
    return keyed.join(store.select(F.col("page_key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def pagerank(nodes: DataFrame, links: DataFrame, rounds: int = 5, checkpoint_every: int = 5) -> DataFrame:
    """nodes(node), links(src, dst) -> (node, rank).

    Each round a node hands on (0.85 r + 0.15) in equal parts along its links, starting from r = 1; one that gets nothing
    has 0. At the end rank = min(100, 0.85 r + 0.15). No rounds: 1. The links are hashed by src once and that is used again each round.
    """
    if rounds == 0:
        return nodes.select("node", F.lit(1.0).alias("rank"))
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    edges = links.join(out, "src").select("src", "dst", "n")
    ranks = None
    for k in range(1, rounds + 1):
        r = F.lit(1.0) if ranks is None else F.coalesce("r", F.lit(0.0))
        told = edges if ranks is None else edges.join(ranks, "src", "left")
        ranks = told.groupBy("dst").agg(F.sum((DAMPING * r + (1 - DAMPING)) / F.col("n")).alias("r")).withColumnRenamed("dst", "src")
        if k % checkpoint_every == 0 and k < rounds:
            ranks = reliable(ranks)
    final = nodes.join(ranks.withColumnRenamed("src", "node"), "node", "left")
    return final.select("node", F.least(F.lit(CAP), DAMPING * F.coalesce("r", F.lit(0.0)) + (1 - DAMPING)).alias("rank"))
