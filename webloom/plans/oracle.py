"""DuckDB SQL that the queries are checked against, put together from the same definitions in other words.

Where the engine works inside a page's row with array functions, this explodes rows and uses windows, and the other way round.
"""

from __future__ import annotations

from webloom.functions import tokens as T
from webloom.functions import urls as U
from webloom.functions.html import COMMENT, HIDDEN, LINK, PIECE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bare(x: str) -> str:
    return f"CASE WHEN strlen(rtrim(ltrim({x}, '/'), '/')) >= 3 THEN rtrim(ltrim({x}, '/'), '/') END"


def canonical(u: str) -> str:
    return f"""(CASE WHEN strlen({u}) < 3 THEN NULL
      WHEN strlen({u}) >= 7 AND starts_with({u}, 'https') THEN CASE WHEN substr({u}, 6, 1) = ':' THEN rtrim({u}, '/') END
      WHEN strlen({u}) >= 7 AND starts_with({u}, 'http') THEN CASE WHEN substr({u}, 5, 1) = ':' THEN {bare(f"substr({u}, 6)")} END
      ELSE {bare(u)} END)"""


def key(u: str) -> str:
    w = f"ltrim(CASE WHEN strlen({u}) > 4 AND starts_with({u}, 'www.') THEN substr({u}, 5) ELSE {u} END, '/')"
    return f"(CASE WHEN {w} = '' THEN '{'0' * 32}' ELSE md5({w}) END)"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^(?:https?://)?([^/]*)', 1)"


def suffix(h: str) -> str:
    """By labels from the right, not by a pattern: the first label from the second on that doesn't start with com or org."""
    ls = f"list_reverse(string_split({h}, '.'))"
    k = f"coalesce(list_min(list_filter(range(2, len({ls}) + 1), lambda k: NOT regexp_matches({ls}[k], '^(?i:com|org)'))), len({ls}))"
    return f"array_to_string(list_reverse({ls}[1:{k}]), '.')"


def half(k: str, first: int) -> str:
    return "('0x' || " + " || ".join(f"substr({k}, {first + 2 * i}, 2)" for i in range(7, -1, -1)) + ")::UBIGINT"


def partition(h: str, n: int) -> str:
    k = key(suffix(h))
    return f"(xor({half(k, 1)}, {half(k, 17)}) % {n})::INTEGER"


def crawlable(u: str) -> str:
    ends = " OR ".join(f"suffix({u}, {q(e)})" for e in U.SKIPPED_ENDINGS)
    hosts = " OR ".join(f"suffix({host(u)}, {q(e)})" for e in U.SKIPPED_HOSTS)
    return f"(strlen({u}) BETWEEN 4 AND {U.MAX_URL_BYTES} AND NOT (strlen({u}) > 4 AND ({ends})) AND strlen({host(u)}) > 2 AND NOT (strlen({host(u)}) > 3 AND ({hosts})))"


def clean(h: str, mark: str = "") -> str:
    return f"regexp_replace(regexp_replace({h}, {q(COMMENT)}, '', 'g'), {q(HIDDEN)}, {q(mark)}, 'g')"


STORE = f"""store AS (
  SELECT page_id AS page_index, {canonical('url')} AS url, html FROM pages WHERE {canonical('url')} IS NOT NULL)"""
DOCUMENTS = """store AS (
  SELECT doc_id AS page_index, 'https://' || coalesce(source, 'none') || '.example/' || doc_id AS url,
    '<body>' || replace(replace(coalesce(text, ''), '<', ' '), '>', ' ') || '</body>' AS html FROM documents)"""

LINKS = f"""found AS (
  SELECT page_index, url, {host('url')} AS own, starts_with(url, 'https://') AS secure,
    unnest(regexp_extract_all(html, {q(LINK)}, 1)) AS v FROM store),
rested AS (
  SELECT *, starts_with(v, '/') AND NOT starts_with(v, '//') AS is_local,
    CASE WHEN starts_with(v, '/') AND NOT starts_with(v, '//') THEN own || v ELSE regexp_replace(v, '^(?:https?:)?//', '') END AS rest FROM found),
aimed AS (
  SELECT *, is_local OR rest = own OR (starts_with(rest, own) AND substr(rest, length(own) + 1, 1) IN ('/', ':', '?')) AS same FROM rested),
targets AS (
  SELECT page_index, url, {canonical("CASE WHEN (same AND secure) OR (NOT same AND starts_with(v, 'https://')) THEN 'https://' || rest ELSE rest END")} AS target
  FROM aimed WHERE rest <> '')"""


def bf16(x: str) -> str:
    e = f"floor(log2({x}))"
    e = f"(CASE WHEN pow(2.0, {e}) > {x} THEN {e} - 1 WHEN pow(2.0, {e} + 1) <= {x} THEN {e} + 1 ELSE {e} END)"
    return f"(CASE WHEN {x} > 0 THEN floor({x} / pow(2.0, {e} - 7)) * pow(2.0, {e} - 7) ELSE {x} END)"


_A = "[A-Za-z0-9]"
_WIDE = r"^[^\x00-/:-@\[-`{-\x7F]+"
_HEAD = "CASE " + " ".join(f"WHEN s = '<h{i}>' THEN {m}" for i, m in enumerate(T.HEADINGS, 1)) + " WHEN regexp_matches(s, '^</h[1-6]>$') THEN 1.0 END"
_STOP = f"term IN ({', '.join(map(q, T.STOP_WORDS))}) OR " + " OR ".join(f"starts_with(term, {q(s)})" for s in T.STOP_STARTS)

#: From store(page_index, url, html): tokens(page_index, position, term, weight).
TOKENS = f"""parts AS (
  SELECT page_index, regexp_extract_all(regexp_replace({clean("coalesce(html, '')", "<>")}, '(?s)</body.*', ''), {q(PIECE)}) AS l FROM store),
segments AS (SELECT page_index, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM parts),
stated AS (
  SELECT page_index, i, s,
    max(CASE WHEN starts_with(s, '<title') THEN 3 WHEN starts_with(s, '</title') THEN 4 WHEN starts_with(s, '<body') THEN 5 ELSE 2 END) OVER w AS sec,
    last_value(CASE WHEN s = '<b>' THEN {T.BOLD} WHEN s = '</b>' THEN 1.0 END IGNORE NULLS) OVER w AS bold,
    last_value({_HEAD} IGNORE NULLS) OVER w AS head
  FROM segments WINDOW w AS (PARTITION BY page_index ORDER BY i ROWS UNBOUNDED PRECEDING)),
texts AS (
  SELECT page_index, 0 AS i, url AS s, {T.URL_WEIGHT}::DOUBLE AS base FROM store
  UNION ALL
  SELECT page_index, i, s, (CASE WHEN sec = 3 THEN {T.TITLE_WEIGHT} ELSE {T.BODY_WEIGHT} END)::DOUBLE * coalesce(bold, 1.0)::DOUBLE * coalesce(head, 1.0)::DOUBLE
  FROM stated WHERE sec IN (3, 5) AND NOT starts_with(s, '<')),
flat AS (
  SELECT page_index, i, base, regexp_replace(regexp_replace(s, '[ .]*([ .])', '\\1', 'g'), '({_A}{{{T.TERM_BYTES}}})', '\\1' || chr(1), 'g') AS t FROM texts),
starts AS (
  SELECT *, unnest(list_filter(range(1, length(t) + 1), lambda k: ord(t[k]) > 127 OR (regexp_matches(t[k], '{_A}') AND (k = 1 OR NOT regexp_matches(t[k - 1], '{_A}'))))) AS k
  FROM flat),
cut AS (
  SELECT page_index, i, k, base, CASE WHEN ord(t[k]) <= 127
      THEN regexp_replace(regexp_extract(substr(t, k, {T.TERM_BYTES}), '^[A-Za-z0-9 .]+'), '[ .]+$', '')
      ELSE regexp_extract(substr(t, k, {T.GRAM_BYTES}), {q(_WIDE)}) END AS p FROM starts),
fitted AS (
  SELECT page_index, i, k, base, CASE WHEN strlen(p) <= {T.TERM_BYTES} AND ord(p) <= 127 THEN p
      ELSE p[1:list_max(list_filter(range(1, length(p) + 1), lambda n: strlen(p[1:n]) <= {T.GRAM_BYTES}))] END AS p FROM cut),
placed AS (
  SELECT page_index, row_number() OVER (PARTITION BY page_index ORDER BY i, k) AS position, translate(p, '{U.UPPER}', '{U.LOWER}') AS term,
    base * CASE WHEN regexp_matches(p, '[A-Z]') THEN {T.CAPITAL} ELSE 1.0 END::DOUBLE AS w FROM fitted),
passed AS (
  SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY position) - 1 AS n,
    row_number() OVER (PARTITION BY page_index, term ORDER BY position) AS occurrence
  FROM placed WHERE position <= {T.LAST_POSITION} AND NOT ({_STOP})),
counted AS (
  SELECT *, sum((occurrence = 1)::INT) OVER (PARTITION BY page_index ORDER BY position) AS distinct_so_far FROM passed),
tokens AS (
  SELECT page_index, position::INTEGER AS position, term, w * pow({T.DECAY}::DOUBLE, n) AS weight FROM counted c
  WHERE distinct_so_far < {T.MAX_WORDS} OR (distinct_so_far = {T.MAX_WORDS} AND occurrence = 1))"""

#: The same without limits: all of every text.
WHOLE_TOKENS = f"""{TOKENS.partition("passed AS (")[0]}passed AS (
  SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY position) - 1 AS n FROM placed WHERE NOT ({_STOP})),
tokens AS (SELECT page_index, position::INTEGER AS position, term, w * pow({T.DECAY}::DOUBLE, n) AS weight FROM passed)"""


def terms(normalizer: str = "reset") -> str:
    """From tokens: terms(page_index, term, weight, position, total)."""
    last = "max(CASE WHEN was IS NOT NULL AND weight > kept THEN position END) OVER (PARTITION BY page_index)" if normalizer == "reset" else "NULL"
    return f"""seen AS (
  SELECT *, max(weight) OVER (PARTITION BY page_index, term ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
    max(weight) OVER (PARTITION BY page_index, term) AS most FROM tokens),
truncated AS (SELECT *, {bf16('was')} AS kept, {bf16('most')} AS stored FROM seen),
reset AS (SELECT *, {last} AS last FROM truncated),
totals AS (
  SELECT page_index, sum(CASE WHEN was IS NULL AND (last IS NULL OR position > last) THEN weight ELSE 0 END)
    + coalesce(sum(CASE WHEN position = last THEN weight - kept END), 0) AS total FROM reset GROUP BY page_index),
terms AS (
  SELECT page_index, term, any_value(stored) AS weight, coalesce(max(CASE WHEN weight > stored THEN position END), min(CASE WHEN weight = stored THEN position END)) AS position,
    any_value(total) AS total FROM reset JOIN totals USING (page_index) GROUP BY page_index, term)"""


MAIN = f"""main_dict AS (
  SELECT term, CASE WHEN total > 0 THEN {bf16('(weight * 1.0 / total)')} ELSE weight END AS rank, page_index, position FROM terms)"""

#: The same with each posting scaled by its page's rank, from ranks(node, rank).
RANKED = f"""main_dict AS (
  SELECT term, CASE WHEN total > 0 THEN {bf16('(weight * rank / total)')} ELSE weight END AS rank, page_index, position FROM terms JOIN ranks ON node = page_index)"""

_W = "string_split(term, ' ')[1]"
SMALL = f"""words AS (SELECT *, {_W} AS w, strlen({_W}) AS n FROM main_dict),
ended AS (
  SELECT *, list_transform(range(1, least(9, length(w)) + 1), lambda j: struct_pack(j := j, at := strlen(w[1:j - 1]), n := strlen(w[j]), c := w[j])) AS cs FROM words),
ends AS (
  SELECT *, list_transform(list_filter(cs, lambda x: x.at <= 8 AND (x.n > 1 OR x.c = '.' OR NOT regexp_matches(x.c, '{_A}'))),
    lambda x: CASE WHEN x.n > 1 AND x.at + x.n <= 8 THEN x.j ELSE x.j - 1 END) AS js FROM ended),
short AS (SELECT page_index, CASE WHEN n <= 8 THEN w ELSE w[1:coalesce(js[-1], 0)] END AS term, rank, position FROM ends),
small_dict AS (
  SELECT term, rank, page_index, position FROM (
    SELECT *, row_number() OVER (PARTITION BY page_index, term ORDER BY rank DESC, position) AS k FROM short WHERE term <> '') WHERE k = 1)"""

INDEX = f"{TOKENS}, {terms()}, {MAIN}, {SMALL}"


def search(query_terms: list[str], merge: bool = True, show: int = 200, store: str = STORE, index: str | None = None) -> str:
    """The search for terms (each of 24 bytes or fewer)."""
    looked = []
    for i, t in enumerate(query_terms):
        n = len(t)
        prefix = f"starts_with(term, {q(t)}) AND NOT regexp_matches(substr(term, {n + 1}, 1), '[A-Za-z]')"
        if len(t.encode()) <= 8:
            looked.append(f"SELECT {i} AS idx, * FROM small_dict WHERE term = {q(t)}")
            looked.append(f"SELECT {i} AS idx, * FROM main_dict WHERE {prefix} AND NOT EXISTS (SELECT 1 FROM small_dict WHERE term = {q(t)})")
        else:
            looked.append(f"SELECT {i} AS idx, * FROM main_dict WHERE {prefix}")
    n = len(query_terms)
    near = " * ".join(["1.0", *(f"greatest(1e-6, pow(0.9, (SELECT min(abs(a.position - b.position)) FROM top a, top b WHERE a.page_index = p.page_index AND b.page_index = p.page_index AND a.idx = {i - 1} AND b.idx = {i}) - 1))" for i in range(1, n))])
    best = "row_number() OVER (PARTITION BY host ORDER BY score DESC, page_index) = 1" if merge else "TRUE"
    pages_of = "count(*) OVER (PARTITION BY host)" if merge else "1"
    return f"""WITH {store}, {index or INDEX},
hits AS ({' UNION ALL '.join(looked)}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx, page_index ORDER BY rank DESC, position) AS k FROM hits) WHERE k <= 2),
p AS (SELECT page_index, sum(rank) AS total FROM top GROUP BY page_index HAVING count(DISTINCT idx) = {n}),
rated AS (SELECT p.page_index, total * {near} AS score, url, {suffix(host('url'))} AS host FROM p JOIN store USING (page_index)),
merged AS (SELECT * FROM (SELECT *, ({pages_of})::BIGINT AS host_pages, {best} AS is_best FROM rated) WHERE is_best)
SELECT page_index, round(score, 9) AS score, url, host, host_pages FROM merged ORDER BY score DESC, page_index LIMIT {show}"""


def pagerank(nodes: str, links: str, rounds: int = 5) -> str:
    """nodes and links are queries giving node, and src and dst."""
    steps = []
    for k in range(1, rounds + 1):
        r = "1.0" if k == 1 else "coalesce(r, 0.0)"
        join = "" if k == 1 else f" LEFT JOIN r{k - 1} ON r{k - 1}.node = e.src"
        steps.append(f"r{k} AS (SELECT e.dst AS node, sum((0.85 * {r} + 0.15) / n) AS r FROM e{join} GROUP BY e.dst)")
    return f"""nodes AS ({nodes}), links AS ({links}),
e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM links), {', '.join(steps)},
ranks AS (SELECT node, least(100, 0.85 * coalesce(r, 0.0) + 0.15) AS rank FROM nodes LEFT JOIN r{rounds} USING (node))"""
