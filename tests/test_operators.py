"""Operators against plain Python on random and hand-made tables."""

import random
import struct
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.operators import frontier, index, kvlog, pagerank, sorting
from webloom.operators import search as S
from webloom.plans import crawling
from webloom.sources import tables
from webloom.streaming import crawl


def trunc(x):
    return struct.unpack("<f", struct.pack("<I", struct.unpack("<I", struct.pack("<f", x))[0] & 0xFFFF0000))[0]


@pytest.mark.parametrize("normalizer", ["reset", "sum"])
def test_page_terms_against_a_fold(spark, normalizer):
    rnd, rows = random.Random(3), []
    for page in range(40):
        for pos in range(1, rnd.randrange(2, 60)):
            rows.append((page, pos, rnd.choice("abcdef"), rnd.choice([1.0, 2.0, 4.0, 100.0]) * 0.999**pos))
    want, totals = {}, defaultdict(float)
    for page, pos, term, w in rows:
        if (page, term) not in want:
            totals[page] += w
            want[page, term] = (trunc(w), pos)
        elif w > want[page, term][0]:
            if normalizer == "reset":
                totals[page] = w - want[page, term][0]
            want[page, term] = (trunc(w), pos)
    df = spark.createDataFrame(rows, "page_index long, position int, term string, weight double")
    got = index.page_terms(df, normalizer).collect()
    assert {(r.page_index, r.term): (r.weight, r.position) for r in got} == want
    assert all(abs(r.total - totals[r.page_index]) < 1e-9 for r in got)


def ranks_by_hand(nodes, links, rounds):
    out = defaultdict(int)
    for s, _ in links:
        out[s] += 1
    r = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.0)
        for s, d in links:
            new[d] += (0.85 * r[s] + 0.15) / out[s]
        r = new
    return {n: min(100, 0.85 * x + 0.15) if rounds else 1.0 for n, x in r.items()}


@pytest.mark.parametrize("rounds", [0, 1, 5, 12])
def test_pagerank(spark, rounds):
    rnd = random.Random(rounds)
    nodes = list(range(30))
    links = sorted({(rnd.randrange(25), rnd.choice([0, 0, rnd.randrange(30)])) for _ in range(80)} | {(3, 3)})
    got = pagerank.pagerank(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "src long, dst long"), rounds)
    got = {r.node: r["rank"] for r in got.collect()}
    want = ranks_by_hand(nodes, links, rounds)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in nodes)


def test_rank_is_capped(spark):
    nodes, links = range(400), [(i, 0) for i in range(1, 400)]
    got = pagerank.pagerank(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "src long, dst long"), 1)
    assert {round(r["rank"], 9) for r in got.collect()} == {100.0, 0.15}


def store(spark, *bodies, host="h{}.com"):
    rows = [(i, f"http://{host.format(i)}/p{i}", f"<title>t {i}</title><body>{b}</body>") for i, b in enumerate(bodies)]
    return tables.page_store(spark.createDataFrame(rows, "page_id long, url string, html string"))


def find(s, text, **options):
    m = index.main_dictionary(s)
    return S.search(s, m, index.small_dictionary(m), text, S.SearchOptions(**options)).collect()


def test_search_wants_all_terms_and_likes_them_close(spark):
    s = store(spark, "red fox", "red " + "".join(f"w{i}, " for i in range(30)) + "fox", "red only", "fox red", "category cat5 catfood")
    assert [r.page_index for r in find(s, "red fox", merge_hosts=False)][-1] == 1
    assert {r.page_index for r in find(s, "red fox")} == {0, 1, 3}
    assert [r.page_index for r in find(s, '"red fox"')] == [0]
    assert [r.page_index for r in find(s, "cat")] == [4] and find(s, "catf") == []  # cat5 answers cat, catfood does not answer catf
    assert find(s, "") == [] and find(s, "nothing") == []


def test_adjacent_words_score_their_plain_sum(spark):
    s = store(spark, "alpha, beta")
    post = {r.term: r["rank"] for r in index.main_dictionary(s).collect()}
    assert abs(find(s, "alpha beta")[0].score - post["alpha"] - post["beta"]) < 1e-12


def test_main_dictionary_prefix(spark):
    df = spark.createDataFrame([(t,) for t in ["cat", "category", "cat food", "cat5", "cat.x", "ca", "香港人"]], "term string")
    assert {r.term for r in df.where(S.in_main("cat")).collect()} == {"cat", "cat food", "cat5", "cat.x"}
    assert {r.term for r in df.where(S.in_main("香港")).collect()} == {"香港人"}


def test_hosts_are_merged(spark):
    s = store(spark, "fox one", "fox two", "fox three", host="same.com")
    assert [(r.host, r.host_pages) for r in find(s, "fox")] == [("same.com", 3)]
    assert len(find(s, "fox", merge_hosts=False)) == 3 and len(find(s, "fox", merge_hosts=False, max_show=2)) == 2
    assert "(+2 pages for same.com)" in S.formatted(spark.createDataFrame(find(s, "fox"))).first().line


def test_query_language():
    assert S.split_query('a  "b  c" d"e f" "') == ["a", "b c", "d", "e f"]
    assert len(S.split_query(" ".join("abcdefghij"))) == 8
    o = S.SearchOptions()
    assert S.command("#unmerge", o).merge_hosts is False and S.command("#maxShow 5", o).max_show == 5 and S.command("#get 7", o) == 7 and S.command("#help", o) is None
    with pytest.raises(ValueError):
        S.SearchOptions(max_show=0)


def test_dictionary_on_disk(spark, tmp_path, sf):
    m = index.main_dictionary(tables.page_store(tables.read(spark, sf, "pages")))
    index.write_dictionary(m, f"{tmp_path}/main", 4)
    back = spark.read.parquet(f"{tmp_path}/main")
    assert back.count() == m.count()
    rows = [r.term.encode() for r in back.withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).select("term").collect()]
    assert rows == sorted(rows)
    plan = back.where(S.in_main("in the"))._jdf.queryExecution().toString()
    assert "StringStartsWith(term,in the)" in plan


def test_link_resolution(spark):
    rows = [(1, "http://a.com/x", '<a href="/y"><a href="/x"><a href="/y"><a href="http://b.com/"><a href="/gone">'), (2, "http://a.com/y", '<a href="//www.a.com/x">'), (3, "http://b.com/", "")]
    s = tables.page_store(spark.createDataFrame(rows, "page_id long, url string, html string"))
    name = {r.page_key: r.page_index for r in s.collect()}
    assert sorted((name[r.src], name[r.dst]) for r in pagerank.resolved_links(s).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_log_against_a_dict(spark):
    rnd, state, rows = random.Random(5), {}, []
    for seq in range(500):
        k, gone = rnd.choice("abcdefgh"), rnd.random() < 0.3
        rows.append((k, seq, gone, seq * 2))
        state.pop(k, None) if gone else state.__setitem__(k, (seq, seq * 2))
    log = spark.createDataFrame(rows, "key string, seq long, deleted boolean, value long")
    assert {r.key: (r.seq, r.value) for r in kvlog.compacted(log).collect()} == state
    s = kvlog.statistics(log).first()
    assert (s.entries, s.next_seq, s.live) == (500, 500, len(state))
    assert kvlog.random_entry(kvlog.compacted(log), 3).count() == 1


def test_polite_schedule_and_streaks_against_loops(spark):
    rnd, visits = random.Random(6), []
    for seq in range(300):
        visits.append((rnd.choice("abc"), rnd.randrange(2000), seq, rnd.random() < 0.7))
    df = spark.createDataFrame(visits, "host string, at long, seq long, failed boolean")
    free, want, streak, fails = {}, {}, defaultdict(int), {}
    for h, at, seq, failed in sorted(visits, key=lambda v: (v[1], v[2])):
        want[seq] = max(at, free.get(h, at))
        free[h] = want[seq] + 15
        fails[seq] = streak[h]
        streak[h] = streak[h] + 1 if failed else 0
    assert {r.seq: r.start for r in frontier.polite_schedule(df).collect()} == want
    assert {r.seq: (r.failures, r.backed_off) for r in frontier.failure_streaks(df, 2).collect()} == {s: (n, n > 2) for s, n in fails.items()}


def test_admission(spark):
    rows = [(1, "http://a.com/x"), (2, "http://a.com/x/"), (3, "http://www.a.com/x"), (4, "http://b.com/y.css"), (5, "http://known.com/"), (6, "http://c.com/z"), (7, "zz")]
    u = spark.createDataFrame(rows, "arrival long, url string")
    known = frontier.prepared(spark.createDataFrame([("http://known.com",)], "url string"))
    got = frontier.admit(u, known)
    assert sorted((r.arrival, r.url) for r in got.collect()) == [(1, "a.com/x"), (6, "c.com/z")]
    limited = frontier.within_host_limit(frontier.prepared(u), limit=2)
    assert sorted(r.arrival for r in limited.collect()) == [1, 2, 3, 5, 6]
    assert frontier.draw(got, 1).count() == 1


def test_sort_positions(spark):
    rnd = random.Random(8)
    v = [rnd.randrange(-(2**63), 2**63) for _ in range(5000)] + [7] * 50
    got = sorting.with_position(spark.createDataFrame([(x,) for x in v], "v long"), "v").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.position)] == sorted(v) and sorted(r.position for r in got) == list(range(1, len(v) + 1))


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_remember(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("urls", "out", "state"))
    for batch in (["http://a.com/x", "http://a.com/x/"], ["http://www.a.com/x", "http://b.com/q", "bb.js"]):
        spark.createDataFrame([(u,) for u in batch], "url string").coalesce(1).write.mode("append").parquet(src)
        run(crawl.admitted(spark.readStream.schema("url string").parquet(src)), out, state)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a.com/x", "b.com/q"]


def test_polite_stream_equals_the_batch_form(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("visits", "out", "state"))
    schema, rows = "host string, at long, seq long", [(h, at, i) for i, (h, at) in enumerate([("a", 0), ("a", 1), ("b", 3), ("a", 40), ("a", 41), ("b", 90)])]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run(crawl.polite(spark.readStream.schema(schema).parquet(src)), out, state)
    want = {r.seq: r.start for r in frontier.polite_schedule(spark.createDataFrame(rows, schema)).collect()}
    assert {r.seq: r.start for r in spark.read.parquet(out).collect()} == want


def test_url_lists(spark, tmp_path):
    tables.append_url_list(spark.createDataFrame([("a.com",), ("b.com",)], "url string"), f"{tmp_path}/urls")
    tables.append_url_list(spark.createDataFrame([("c.com",)], "url string"), f"{tmp_path}/urls")
    assert sorted(r.url for r in tables.url_list(spark, f"{tmp_path}/urls").collect()) == ["a.com", "b.com", "c.com"]


def test_crawl_follows_links_from_seeds(spark):
    link = lambda *us: "".join(f'<a href="http://{u}/">' for u in us)
    rows = [(1, "http://aa.com/", link("bb.com", "cc.com", "gone.com")), (2, "http://bb.com", link("aa.com", "dd.com")), (3, "http://cc.com", link("cc.com")), (4, "http://dd.com", ""), (5, "http://island.com", "")]
    s = tables.page_store(spark.createDataFrame(rows, "page_id long, url string, html string"))
    pages, left = crawling.crawl(spark.createDataFrame([("http://aa.com",)], "url string"), crawling.from_pages(s), 4)
    assert {r.url: r.round for r in pages.collect()} == {"aa.com": 1, "bb.com": 2, "cc.com": 2, "dd.com": 3}
    assert left.count() == 0


def test_monitor_sees_a_stream(spark, tmp_path):
    m = crawl.Monitor()
    spark.streams.addListener(m)
    spark.createDataFrame([("http://a.com/x",)], "url string").write.parquet(f"{tmp_path}/u")
    run(crawl.admitted(spark.readStream.schema("url string").parquet(f"{tmp_path}/u")), f"{tmp_path}/o", f"{tmp_path}/s")
    for _ in range(50):
        if any(x.get("state_rows") == 1 for x in m.last.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(m)
    assert any(x.get("state_rows") == 1 for x in m.last.values())


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip"])
def test_stored_pages_come_back_whole(spark, sf, tmp_path, codec):
    p = tables.read(spark, sf, "pages")
    p.write.option("compression", codec).parquet(f"{tmp_path}/p")
    assert sorted(spark.read.parquet(f"{tmp_path}/p").collect()) == sorted(p.collect())


def test_sort_of_nothing_and_of_ties(spark):
    from webloom.operators.sorting import with_position

    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "a long, b long")
    got = with_position(df, "a", "b").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 201))
    assert [(r.a, r.b) for r in got] == sorted(((r.a, r.b) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert with_position(df.limit(0), "a").count() == 0


def test_dictionaries_are_written_once_and_pruned(spark, sf):
    from webloom.operators import index, search
    from webloom.sources.tables import page_store

    store = page_store(spark.read.parquet(f"{sf}/pages.parquet"))
    main, small = index.dictionaries(store, "test")
    files = main.inputFiles()
    again, _ = index.dictionaries(store, "test")
    assert files and set(again.inputFiles()) == set(files)
    assert main.count() == index.main_dictionary(store).count() and small.count() == index.small_dictionary(main).count()
    plan = main.where(search.in_main("in the"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,in the)" in plan
    terms = [r.term for r in main.select("term").limit(10_000).collect()]
    assert terms == sorted(terms, key=lambda t: t.encode())


@pytest.mark.parametrize("name", ["posting_ranked", "search_ranked"])
def test_pages_of_one_url_keep_their_own_ranks(spark, sf, tmp_path, name):
    import duckdb

    from webloom.plans import catalog

    rows = [(i, f"http://h{i // 3}.com/p", f"<title>t</title><body>the one that stays {i}</body>") for i in range(1, 13)]  # three pages of each URL
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    links = [(o, n, p) for o in range(40) for n, p in enumerate([1 + o % 12, 1 + o * 5 % 12, 1 + o * o % 12])]
    spark.createDataFrame(links, "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 13)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("pages", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    c = con.execute(catalog.ORACLES[name])
    at = [df.columns.index(d[0]) for d in c.description]
    assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(c.fetchall())


def test_dictionaries_make_the_postings_once(spark, sf, tmp_path):
    s = tables.page_store(tables.read(spark, sf, "pages"))

    def noted(batches):
        for b in batches:
            with open(f"{tmp_path}/read", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    main, small = index.dictionaries(s.mapInArrow(noted, s.schema), "once")
    assert len((tmp_path / "read").read_text()) == s.count()
    want = index.main_dictionary(s)
    assert sorted(main.collect()) == sorted(want.collect()) and sorted(small.collect()) == sorted(index.small_dictionary(want).collect())


@pytest.mark.parametrize("name", ["dict_stats", "term_tail", "dict_small"])
def test_pages_are_tokenised_and_sorted_once(spark, sf, name):
    from webloom.plans import catalog

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 1
    plan = index.page_terms(index.tokens_by_page(tables.page_store(tables.read(spark, sf, "pages"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [") + plan.count(":- Sort [") == 1


def test_a_sorted_dictionary_is_not_sorted_again(spark, sf, monkeypatch):
    from webloom.plans import catalog

    catalog.dict_sorted(spark, sf)
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda *a: 1 / 0)
    got = [(r.term.encode(), r.page_index) for r in catalog.dict_sorted(spark, sf).orderBy("place").collect()]
    assert [t for t, _ in got] == sorted(t for t, _ in got) and len(set(got)) == len(got)
