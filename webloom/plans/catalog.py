"""The queries of the engine proper: name -> function(spark, sf_dir), name -> SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import tokens as T
from webloom.functions import urls as U
from webloom.operators import frontier, index, kvlog, pagerank, sorting
from webloom.operators import search as S
from webloom.plans import oracle as O
from webloom.sources.tables import document_store, page_store, read

QUERIES: dict = {}
ORACLES: dict = {}

#: The reference's limits of a page (operators 46 and 48), which are part of the SQL of the index and search queries.
LIMITS = {"max_words": T.MAX_WORDS, "last_position": T.LAST_POSITION}


def query(sql: str | None, whole: bool = False):
    """Registers a function under its name, with its SQL. whole: one with LIMITS also as name_whole, without any."""

    def put(f):
        if whole:
            QUERIES[f"{f.__name__}_whole"] = lambda spark, d: f(spark, d, {})
            ORACLES[f"{f.__name__}_whole"] = sql.replace(O.TOKENS, O.WHOLE_TOKENS)
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _pages(spark, d) -> DataFrame:
    return read(spark, d, "pages")


def _store(spark, d) -> DataFrame:
    return page_store(_pages(spark, d))


# --- URLs ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {O.canonical('url')} AS canonical, {O.key(O.canonical('url'))} AS url_key, {O.host('url')} AS host, CASE WHEN starts_with(url, 'https://') THEN 443 ELSE 80 END AS port, regexp_extract(url, '^(?:https?://)?[^/]*(.*)$', 1) AS path FROM pages")
def url_canonical(spark, d):
    """Canonical form, key, host, port and path of every page's URL."""
    c = U.canonical_url(F.col("url"))
    return _pages(spark, d).select("page_id", c.alias("canonical"), U.url_key(c).alias("url_key"), U.url_host(F.col("url")).alias("host"), U.url_port(F.col("url")).alias("port"), U.url_path(F.col("url")).alias("path"))


@query(f"SELECT page_id, url, {O.crawlable('url')} AS crawlable FROM (SELECT page_id, {O.canonical('url')} AS url FROM pages) WHERE url IS NOT NULL")
def url_filter(spark, d):
    """Whether a page's URL may be crawled."""
    return _pages(spark, d).select("page_id", U.canonical_url(F.col("url")).alias("url")).where("url is not null").select("page_id", "url", U.is_crawlable(F.col("url")).alias("crawlable"))


@query(f"SELECT page_id, {O.suffix(O.host('url'))} AS suffix, {O.partition(O.host('url'), frontier.PARTITIONS)} AS part FROM pages")
def host_bucket(spark, d):
    """The suffix that owns a page's host, and its frontier partition."""
    h = U.url_host(F.col("url"))
    return _pages(spark, d).select("page_id", U.host_suffix(h).alias("suffix"), U.host_partition(h, frontier.PARTITIONS).alias("part"))


@query(f"SELECT host, count(*) AS n FROM (SELECT {O.host('url')} AS host FROM pages) GROUP BY host")
def host_counts(spark, d):
    return _pages(spark, d).groupBy(U.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT host, count(*) AS n FROM (SELECT {O.host('url')} AS host FROM pages) GROUP BY host HAVING count(*) >= 4 ORDER BY n DESC, host LIMIT 100")
def top_hosts(spark, d):
    """The hundred hosts with most pages, of those with four or more (the tables are small)."""
    return frontier.top_hosts(_pages(spark, d).select(U.url_host(F.col("url")).alias("host")), least=4)


@query(f"SELECT suffix, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT {O.host('url')} AS host, {O.suffix(O.host('url'))} AS suffix FROM pages) GROUP BY suffix")
def host_groups(spark, d):
    return frontier.host_groups(_pages(spark, d).select(U.url_host(F.col("url")).alias("host")))


# --- HTML ---------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, rtrim(t[1:coalesce(list_max(list_filter(range(0, least(length(t), 255) + 1), lambda n: strlen(t[1:n]) <= 255)), 0)]) AS title FROM (
  SELECT page_id, regexp_replace(ltrim(regexp_extract(html, '(?s)<title[^>]*>(.*?)(?:</title|\\z)', 1), ' '), '[\\x00-\\x1f]', '', 'g') AS t FROM pages)""")
def page_title(spark, d):
    return _pages(spark, d).select("page_id", H.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, regexp_replace(html, {O.q(H.COMMENT)}, '', 'g') AS html FROM pages")
def strip_comments(spark, d):
    return _pages(spark, d).select("page_id", H.strip_comments(F.col("html")).alias("html"))


@query(f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all({O.clean('html')}, {O.q(H.PIECE)}), lambda p:
  CASE WHEN NOT starts_with(p, '<') OR starts_with(p, '<meta') OR starts_with(p, '<img') THEN p ELSE regexp_replace(p, {O.q(H.ATTRIBUTE)}, '\\1\\2\\3', 'g') END), '') AS html FROM pages""")
def shorten_html(spark, d):
    return _pages(spark, d).select("page_id", H.shorten(F.col("html")).alias("html"))


@query("SELECT page_id, url, html FROM pages WHERE page_id = 7")
def page_get(spark, d):
    """One page by its index."""
    return _pages(spark, d).where("page_id = 7").select("page_id", "url", "html")


# --- links and PageRank ---------------------------------------------------------------------------------------------------


@query(f"WITH {O.STORE}, {O.LINKS} SELECT DISTINCT page_index, target FROM targets WHERE target IS NOT NULL")
def extract_links(spark, d):
    """Distinct link targets of every page."""
    s = _store(spark, d).select("page_index", F.explode_outer(F.array_distinct(H.canonical_links(F.col("html"), F.col("url")))).alias("target"))
    return s.where("target is not null")


@query(f"WITH {O.STORE}, {O.LINKS} SELECT target, count(DISTINCT page_index) AS pages FROM targets WHERE target IS NOT NULL GROUP BY target")
def link_targets(spark, d):
    """How many pages link to each target."""
    return extract_links(spark, d).groupBy("target").agg(F.count("*").alias("pages"))


_RESOLVED = f"SELECT DISTINCT {O.key('url')} AS src, {O.key('target')} AS dst, target FROM targets WHERE target IS NOT NULL AND {O.key('target')} IN (SELECT {O.key('url')} FROM store)"


@query(f"WITH {O.STORE}, {O.LINKS} SELECT src, dst FROM ({_RESOLVED})")
def link_resolution(spark, d):
    """Links between stored pages."""
    return pagerank.resolved_links(_store(spark, d))


@query(f"WITH {O.STORE}, {O.LINKS}, {O.pagerank(f'SELECT DISTINCT {O.key("url")} AS node FROM store', f'SELECT src, dst FROM ({_RESOLVED})')} SELECT node, round(rank, 9) AS rank FROM ranks")
def pagerank_pages(spark, d):
    s = _store(spark, d)
    return pagerank.pagerank(s.select(F.col("page_key").alias("node")).distinct(), pagerank.resolved_links(s)).select("node", F.round("rank", 9).alias("rank"))


def _part_links(spark, d) -> DataFrame:
    """A graph with cycles and hubs: the parts of an order in the order of its lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return li.where("dst is not null").distinct()


_PART_LINKS = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND dst IN (SELECT p_partkey FROM part)"
_PARTS = "SELECT p_partkey AS node FROM part"


def _part_ranks(spark, d, rounds: int = 5, below: int | None = None) -> DataFrame:
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"))
    nodes = nodes if below is None else nodes.where(F.col("node") < below)
    links = _part_links(spark, d).join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    if below is not None:
        links = links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    return pagerank.pagerank(nodes, links.select("src", "dst"), rounds)


@query(f"WITH {O.pagerank(_PARTS, _PART_LINKS)} SELECT node, round(rank, 9) AS rank FROM ranks")
def pagerank_parts(spark, d):
    return _part_ranks(spark, d).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH {O.pagerank(_PARTS + ' WHERE p_partkey < 100', f'SELECT * FROM ({_PART_LINKS}) WHERE src < 100 AND dst < 100', 3)} SELECT node, round(rank, 9) AS rank FROM ranks")
def pagerank_prefix(spark, d):
    """The option to rank only the first pages by index."""
    return _part_ranks(spark, d, 3, 100).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH {O.pagerank(_PARTS, _PART_LINKS)} SELECT round(max(rank), 9) AS most, round(min(rank), 9) AS least, round(avg(rank), 9) AS mean FROM ranks")
def rank_stats(spark, d):
    return _part_ranks(spark, d).agg(F.round(F.max("rank"), 9).alias("most"), F.round(F.min("rank"), 9).alias("least"), F.round(F.avg("rank"), 9).alias("mean"))


# --- tokens and index -------------------------------------------------------------------------------------------------------


@query(f"WITH {O.STORE}, {O.TOKENS} SELECT page_index, position, term, round(weight, 9) AS weight FROM tokens", whole=True)
def page_token_weights(spark, d, limits=LIMITS):
    """The tokens of every page within the reference's limits; page_token_weights_whole has all of them."""
    return index.tokens_by_page(_store(spark, d), **limits).select("page_index", "position", "term", F.round("weight", 9).alias("weight"))


@query(f"WITH {O.STORE}, {O.TOKENS}, {O.terms()} SELECT page_index, term, round(weight, 9) AS weight, position, round(total, 6) AS total FROM terms", whole=True)
def phrase_weights(spark, d, limits=LIMITS):
    """Every term of every page (within the limits, if any) with its stored weight and position, and the page's normaliser."""
    return index.page_terms(index.tokens_by_page(_store(spark, d), **limits)).select("page_index", "term", F.round("weight", 9).alias("weight"), "position", F.round("total", 6).alias("total"))


@query(f"WITH {O.STORE}, {O.TOKENS}, {O.terms()}, {O.MAIN} SELECT term, round(rank, 9) AS rank, page_index, position FROM main_dict", whole=True)
def posting_normalised(spark, d, limits=LIMITS):
    return index.main_dictionary(_store(spark, d), **limits).withColumn("rank", F.round("rank", 9))


@query(f"WITH {O.STORE}, {O.TOKENS}, {O.terms('sum')}, {O.MAIN} SELECT term, round(rank, 9) AS rank, page_index, position FROM main_dict", whole=True)
def posting_sum(spark, d, limits=LIMITS):
    """With the plain sum as normaliser."""
    return index.main_dictionary(_store(spark, d), normalizer="sum", **limits).withColumn("rank", F.round("rank", 9))


@query(f"WITH {O.STORE}, {O.INDEX} SELECT term, round(rank, 9) AS rank, page_index, position FROM small_dict", whole=True)
def dict_small(spark, d, limits=LIMITS):
    return index.small_dictionary(index.main_dictionary(_store(spark, d), **limits)).withColumn("rank", F.round("rank", 9))


@query(f"""WITH {O.STORE}, {O.INDEX}, per AS (SELECT page_index, count(*) AS n, count(*) FILTER (WHERE ord(term) > 127) AS other FROM main_dict GROUP BY page_index)
SELECT sum(n)::BIGINT AS words, sum(other)::BIGINT AS other_words, count(*) AS pages, max(n) AS most_words, (SELECT count(*) FROM small_dict) AS small_words FROM per""", whole=True)
def dict_stats(spark, d, limits=LIMITS):
    return index.statistics(index.main_dictionary(_store(spark, d), **limits))


@query(f"WITH {O.STORE}, {O.INDEX} SELECT term, page_index, position, round(rank, 9) AS rank FROM small_dict WHERE term = 'that'", whole=True)
def term_exact(spark, d, limits=LIMITS):
    m = index.main_dictionary(_store(spark, d), **limits)
    return index.small_dictionary(m).where("term = 'that'").select("term", "page_index", "position", F.round("rank", 9).alias("rank"))


@query(f"WITH {O.STORE}, {O.INDEX} SELECT term, page_index, position, round(rank, 9) AS rank FROM main_dict WHERE starts_with(term, 'in the') AND NOT regexp_matches(substr(term, 7, 1), '[A-Za-z]')", whole=True)
def term_prefix(spark, d, limits=LIMITS):
    return index.main_dictionary(_store(spark, d), **limits).where(S.in_main("in the")).select("term", "page_index", "position", F.round("rank", 9).alias("rank"))


@query(f"""WITH {O.STORE}, {O.INDEX} SELECT term, page_index, position, round(rank, 9) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY term DESC, rank DESC, page_index DESC) AS k FROM main_dict WHERE starts_with(term, 'in the') AND NOT regexp_matches(substr(term, 7, 1), '[A-Za-z]')) WHERE k <= 3""", whole=True)
def term_tail(spark, d, limits=LIMITS):
    """The best three postings of a term's range (the option to read no more)."""
    m = index.main_dictionary(_store(spark, d), **limits)
    found = S.matches(m, None, ["in the"], 3)
    return found.select("term", "page_index", "position", F.round("rank", 9).alias("rank"))


# --- search -------------------------------------------------------------------------------------------------------------------


def _search(spark, d, text: str, limits: dict, options: S.SearchOptions = S.SearchOptions(), store=None, ranks=None) -> DataFrame:
    """Searches the written dictionaries; they are made first where they aren't there for these tables."""
    store = _store(spark, d) if store is None else store
    of = f"{'limits' if limits else 'whole'}{'-ranked-by-page' if ranks is not None else ''}"
    m, s = index.dictionaries(store, of, ranks, **limits)
    out = S.search(store, m, s, text, options)
    return out.select("page_index", F.round("score", 9).alias("score"), "url", "host", "host_pages")


@query(O.search(["that"]), whole=True)
def search_and_1(spark, d, limits=LIMITS):
    return _search(spark, d, "that", limits)


@query(O.search(["that", "with"]), whole=True)
def search_and_2(spark, d, limits=LIMITS):
    return _search(spark, d, "that with", limits)


@query(O.search(["the", "and", "that"]), whole=True)
def search_and_3(spark, d, limits=LIMITS):
    return _search(spark, d, "the and that", limits)


@query(O.search(["in the", "and"]), whole=True)
def search_phrase(spark, d, limits=LIMITS):
    """A phrase in quotes and a word."""
    return _search(spark, d, '"in the" and', limits)


@query(O.search(["the", "that"], merge=False, show=20), whole=True)
def search_no_merge(spark, d, limits=LIMITS):
    return _search(spark, d, "the that", limits, S.SearchOptions(merge_hosts=False, max_show=20))


@query(O.search(["the", "from"], store=O.DOCUMENTS), whole=True)
def search_documents(spark, d, limits=LIMITS):
    return _search(spark, d, "the from", limits, store=document_store(read(spark, d, "documents")))


def _page_ranks(spark, d) -> tuple[DataFrame, DataFrame]:
    """The pages, and their PageRank (page_index, rank) on a graph that resolves: a page links as the part of its number does, to parts that are pages."""
    store = _store(spark, d)
    node = store.select(F.col("page_index").alias("node"))
    links = _part_links(spark, d).join(node.toDF("src"), "src", "left_semi").join(node.toDF("dst"), "dst", "left_semi").select("src", "dst")
    return store, pagerank.pagerank(node, links).withColumnRenamed("node", "page_index")


_RANKS = O.pagerank("SELECT page_index AS node FROM store", f"SELECT src, dst FROM ({_PART_LINKS}) WHERE src IN (SELECT page_index FROM store) AND dst IN (SELECT page_index FROM store)")
_RANKED_INDEX = f"{O.TOKENS}, {O.terms()}, {_RANKS}, {O.RANKED}"


@query(f"WITH {O.STORE}, {_RANKED_INDEX} SELECT term, round(rank, 9) AS rank, page_index, position FROM main_dict")
def posting_ranked(spark, d):
    """Postings scaled by their page's PageRank."""
    store, ranks = _page_ranks(spark, d)
    return index.main_dictionary(store, ranks, **LIMITS).withColumn("rank", F.round("rank", 9))


@query(O.search(["the", "that"], index=f"{_RANKED_INDEX}, {O.SMALL}"))
def search_ranked(spark, d):
    """A search in which pages of higher PageRank come first."""
    store, ranks = _page_ranks(spark, d)
    return _search(spark, d, "the that", LIMITS, store=store, ranks=ranks)


@query(f"WITH {O.STORE}, {O.INDEX} SELECT term, round(rank, 9) AS rank, page_index, position, row_number() OVER (ORDER BY term, rank, page_index) AS place FROM main_dict")
def dict_sorted(spark, d):
    """The main dictionary in its order, each posting with its place."""
    return sorting.placed(index.main_in_order(_store(spark, d), "limits", **LIMITS), name="place").withColumn("rank", F.round("rank", 9))


# --- frontier, log, visits ------------------------------------------------------------------------------------------------------


@query(f"""WITH {O.STORE}, {O.LINKS}, u AS (
  SELECT {O.canonical('target')} AS url, page_index AS arrival FROM targets WHERE target IS NOT NULL),
ok AS (SELECT *, {O.key('url')} AS url_key, {O.host('url')} AS host FROM u WHERE url IS NOT NULL AND {O.crawlable('url')}),
one AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY arrival, url) AS k FROM ok WHERE url_key NOT IN (SELECT {O.key('url')} FROM store))
SELECT url_key, url, host, {O.partition('host', frontier.PARTITIONS)} AS part, arrival FROM one WHERE k = 1""")
def frontier_admit(spark, d):
    """All links of all pages, admitted against the stored pages."""
    s = _store(spark, d)
    links = s.select(F.col("page_index").alias("arrival"), F.explode_outer(H.canonical_links(F.col("html"), F.col("url"))).alias("url")).where("url is not null")
    return frontier.admit(links, s.select(F.col("page_key").alias("url_key"))).select("url_key", "url", "host", "part", "arrival")


@query(f"""WITH u AS (SELECT event_id AS arrival, 'h' || (user_id % 7) || '.example.com/' || user_id AS url FROM events), k AS (
  SELECT *, {O.key('url')} AS url_key, {O.host('url')} AS host FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, url_key) AS n FROM k)
SELECT host, count(*) AS n, max(arrival) AS last FROM r WHERE n <= 100 GROUP BY host""")
def host_limit(spark, d):
    """The first hundred URLs of each host."""
    e = read(spark, d, "events").select(F.col("event_id").alias("arrival"), F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/"), F.col("user_id").cast("string")).alias("url"))
    return frontier.within_host_limit(frontier.prepared(e), "arrival", 100).groupBy("host").agg(F.count("*").alias("n"), F.max("arrival").alias("last"))


def _log(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), F.col("value"))


_LOG = "log AS (SELECT user_id AS key, event_id AS seq, event_type = 'error' AS deleted, value FROM events), live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM log) WHERE k = 1 AND NOT deleted)"


@query(f"WITH {_LOG} SELECT key, seq, value FROM live")
def kv_compaction(spark, d):
    return kvlog.compacted(_log(spark, d))


@query(f"WITH {_LOG} SELECT key, seq, value FROM live WHERE key IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def kv_lookup(spark, d):
    keys = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    return kvlog.lookup(kvlog.compacted(_log(spark, d)), keys)


@query(f"WITH {_LOG} SELECT count(*) AS entries, count(*) FILTER (WHERE deleted) AS deletions, max(seq) + 1 AS next_seq, (SELECT count(*) FROM live) AS live FROM log")
def kv_stats(spark, d):
    return kvlog.statistics(_log(spark, d))


def _visits(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("host"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))


_VISITS = "visits AS (SELECT user_id AS host, epoch(date_trunc('second', ts))::BIGINT AS at_s, event_id AS seq, event_type = 'error' AS failed FROM events)"


@query(f"""WITH RECURSIVE {_VISITS}, n AS (SELECT host, at_s, seq, row_number() OVER (PARTITION BY host ORDER BY at_s, seq) AS i FROM visits),
s AS (SELECT host, at_s, seq, i, at_s AS start FROM n WHERE i = 1
  UNION ALL SELECT n.host, n.at_s, n.seq, n.i, greatest(n.at_s, s.start + {frontier.DELAY_S}) FROM s JOIN n ON n.host = s.host AND n.i = s.i + 1)
SELECT host, at_s, seq, start FROM s""")
def politeness_gate(spark, d):
    """The earliest start of every visit that keeps a host's visits 15 seconds apart."""
    return frontier.polite_schedule(_visits(spark, d).drop("failed")).withColumnRenamed("at", "at_s")


@query(f"""WITH {_VISITS}, g AS (SELECT *, coalesce(sum((NOT failed)::INT) OVER (PARTITION BY host ORDER BY at_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM visits),
f AS (SELECT *, row_number() OVER (PARTITION BY host, run ORDER BY at_s, seq) AS k FROM g)
SELECT host, at_s, seq, failed, (k - 1)::BIGINT AS failures, (k - 1) > 2 AS backed_off FROM f""")
def badhost_backoff(spark, d):
    """Failures in a row before each visit; backed off after more than two (hosts here rarely fail eleven times)."""
    return frontier.failure_streaks(_visits(spark, d), 2).select("host", F.col("at").alias("at_s"), "seq", "failed", F.col("failures").cast("long").alias("failures"), "backed_off")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(sum(value), 1) AS total FROM events GROUP BY event_type")
def crawl_metrics(spark, d):
    """Counts, means and sums by kind of fetch."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 1).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem")
def external_sort(spark, d):
    """All lines in order of price, each with its place."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return sorting.with_position(li, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- set operations -------------------------------------------------------------------------------------------------------------


@query("SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value > 50")
def set_difference(spark, d):
    e = read(spark, d, "events")
    seen = e.where("event_type = 'click' and value > 50").select("user_id")
    return e.where("event_type = 'error'").select("user_id").distinct().join(seen, "user_id", "left_anti")


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'click'")
def set_intersection(spark, d):
    e = read(spark, d, "events").where("event_type in ('error', 'click')")
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n = 2").select("user_id")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def append_union(spark, d):
    n = read(spark, d, "nation").selectExpr("n_nationkey as k", "n_name as name")
    return n.unionByName(read(spark, d, "region").selectExpr("r_regionkey as k", "r_name as name"))
