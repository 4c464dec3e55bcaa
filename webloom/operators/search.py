"""Multi-keyword AND search over the dictionaries, ranked by term weight and proximity."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import page_title
from webloom.functions.tokens import SMALL_BYTES, TERM_BYTES
from webloom.functions.urls import host_suffix, url_host

MAX_TERMS = 8
FAR, LEAST_FACTOR, CLOSENESS = 65535, 1e-6, 0.9


@dataclass(frozen=True)
class SearchOptions:
    """merge_hosts: one result for each host. max_show: results. max_search: postings read for a term, the best of its range (None: all)."""

    merge_hosts: bool = True
    max_show: int = 200
    max_search: int | None = None

    def __post_init__(self):
        if self.max_show < 1 or (self.max_search is not None and self.max_search < 1):
            raise ValueError("max_show and max_search must be positive")


def command(line: str, options: SearchOptions) -> SearchOptions | int | None:
    """A line that starts with #: changed options, the index of a page to get, or None for help or an unknown command."""
    name, *args = line.split()
    if name in ("#merge", "#unmerge"):
        return replace(options, merge_hosts=name == "#merge")
    if len(args) >= 1 and args[0].isdigit():
        if name == "#maxShow":
            return replace(options, max_show=int(args[0]))
        if name == "#maxSearch":
            return replace(options, max_search=int(args[0]))
        if name == "#get":
            return int(args[0])
    return None


def split_query(line: str) -> list[str]:
    """Terms of a query: words, and phrases in double quotes; eight at most. Users write lower case."""
    found = re.findall(r'"([^"]*)"?|([^\x00-\x20"]+)', line)
    return [" ".join((a or b).split()) for a, b in found if (a or b).strip()][:MAX_TERMS]


def _clip(term: str) -> str:
    return term.encode()[:TERM_BYTES].decode(errors="ignore")


def in_main(term: str) -> Column:
    """Whether a posting's term answers a query's: a prefix, after which no letter comes if the query is ASCII; whole 24 bytes must be equal."""
    q = _clip(term)
    if len(q.encode()) >= TERM_BYTES:
        return F.col("term") == q
    hit = F.col("term").startswith(q)
    return hit & ~F.substr("term", F.lit(len(q) + 1), F.lit(1)).rlike("[A-Za-z]") if q.isascii() else hit


def matches(main: DataFrame, small: DataFrame | None, terms: list[str], max_search: int | None = None) -> DataFrame:
    """(term_idx, term, page_index, position, rank): a term of 8 bytes or fewer is looked up among the short words, others and those not found there in the main dictionary.

    small None: the main dictionary alone, which is read once then."""
    parts = []
    for i, t in enumerate(terms):
        if small is not None and len(t.encode()) <= SMALL_BYTES:
            parts.append(small.where(F.col("term") == t).select(F.lit(i).alias("term_idx"), F.lit(0).alias("way"), "term", "page_index", "position", "rank"))
        parts.append(main.where(in_main(t)).select(F.lit(i).alias("term_idx"), F.lit(1).alias("way"), "term", "page_index", "position", "rank"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    if small is not None and any(len(t.encode()) <= SMALL_BYTES for t in terms):
        first = F.broadcast(found.groupBy("term_idx").agg(F.min("way").alias("way")))  # at most eight rows
        found = found.join(first, ["term_idx", "way"])
    if max_search is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("term_idx").orderBy(F.desc("term"), F.desc("rank"), F.desc("page_index"))
        found = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_search).drop("k")
    return found.drop("way")


def scored(found: DataFrame, n_terms: int) -> DataFrame:
    """(page_index, score, positions) of the pages that have all terms.

    The two best postings of a term count. score: their ranks' sum, times 0.9 ** (distance - 1) for each pair of neighbouring terms, each
    factor a millionth at least.
    """
    tops = found.groupBy("page_index", "term_idx").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", (-F.col("position")).alias("p"))), asc=False), 1, 2).alias("top"))
    pages = tops.groupBy("page_index").agg(F.sort_array(F.collect_list(F.struct("term_idx", "top"))).alias("ts")).where(F.size("ts") == n_terms)
    total = lambda t: F.aggregate(t["top"], F.lit(0.0), lambda a, x: a + x["rank"])
    pages = pages.where(F.forall("ts", lambda t: total(t) > 0))
    pairs = lambda a, b: F.flatten(F.transform(a["top"], lambda x: F.transform(b["top"], lambda y: F.abs(x["p"] - y["p"]))))
    near = lambda a, b: F.greatest(F.lit(LEAST_FACTOR), F.pow(F.lit(CLOSENESS), F.array_min(pairs(a, b)) - 1))
    sums = F.aggregate("ts", F.lit(0.0), lambda a, t: a + total(t))
    factor = F.lit(1.0)
    for i in range(1, n_terms):
        factor = factor * near(F.get("ts", F.lit(i - 1)), F.get("ts", F.lit(i)))
    where = F.transform("ts", lambda t: F.transform(t["top"], lambda x: -x["p"]))
    return pages.select("page_index", (sums * factor).alias("score"), where.alias("positions"))


def search(store: DataFrame, main: DataFrame, small: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The best pages for a query: (page_index, score, positions, url, title, host, host_pages), best first, ties by page.

    A query without terms gives no rows. Page texts are read for the results alone.
    """
    terms = split_query(query)
    hits = scored(matches(main, small, terms, options.max_search), len(terms)) if terms else scored(matches(main, small, ["x"]).limit(0), 1)
    best = [F.desc("score"), F.asc("page_index")]
    hosts = store.select("page_index", host_suffix(url_host(F.col("url"))).alias("host"))
    if options.merge_hosts:
        row = F.struct("score", (-F.col("page_index")).alias("p"), "positions")
        hits = hits.join(hosts, "page_index").groupBy("host").agg(F.max(row).alias("r"), F.count("*").alias("host_pages"))
        hits = hits.select((-F.col("r.p")).alias("page_index"), "r.score", "r.positions", "host", "host_pages").orderBy(*best).limit(options.max_show)
    else:
        hits = hits.orderBy(*best).limit(options.max_show).join(hosts, "page_index").withColumn("host_pages", F.lit(1).cast("long"))
    shown = F.broadcast(hits) if options.max_show <= 10_000 else hits
    out = shown.join(store.select("page_index", "url", page_title(F.col("html")).alias("title")), "page_index")
    return out.select("page_index", "score", "positions", "url", "title", "host", "host_pages").orderBy(*best)


def formatted(results: DataFrame) -> DataFrame:
    """Display lines, best last."""
    line = F.format_string("%d [%.2e] %s | %s | %s", "page_index", "score", F.to_json("positions"), "title", "url")
    more = F.when(F.col("host_pages") > 1, F.format_string(" (+%d pages for %s)", F.col("host_pages") - 1, "host")).otherwise("")
    return results.orderBy(F.asc("score"), F.desc("page_index")).select(F.concat(line, more).alias("line"))
