"""Tokenizer: a page's weighted words and overlapping phrases, in one row-local expression.

A page is a URL, a title and a body. A phrase starts at every word and runs on over single separators (space or dot)
for at most 24 bytes; where a script has no such words every character starts one of at most 23 bytes. Nothing here needs
a shuffle: a page becomes an array of tokens in its own row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import pieces, strip_comments, strip_hidden
from webloom.functions.urls import ascii_lower

# Fixed values of the index.
TERM_BYTES, GRAM_BYTES, SMALL_BYTES = 24, 23, 8
LAST_POSITION = 65534
URL_WEIGHT, TITLE_WEIGHT, BODY_WEIGHT = 40.0, 100.0, 1.0
BOLD, HEADINGS, CAPITAL, DECAY = 2.0, (4.0, 1.5, 1.4, 1.3, 1.0, 0.8), 4.0, 0.999
STOP_WORDS = ("www", "com", "a", "of", "the", "for")
STOP_STARTS = ("，", "。", "？", "：", "“", "”", "！")
MAX_WORDS = 2000

# Sections of a page, in the order they are gone through.
HEAD, TITLE, AFTER_TITLE, BODY = 2, 3, 4, 5

#: Letters and digits one by one: Java tests a set of single characters with one look at a bit table, ranges one after another.
_ALNUM = string.ascii_letters + string.digits
#: Where a tag may change the section or the emphasis.
_EVENTS = r"(?=<title|</title|<body|</?b>|</?h[1-6]>)"
#: At the start of a word the phrase, at a character of another script the gram (group 1); the search goes on after the word or character.
_START = rf"(?s)(?=([{_ALNUM}][{_ALNUM} .]{{0,{TERM_BYTES - 1}}}|[^\x00-\x7F][^\x00-/:-@\[-`{{-\x7F]{{0,{GRAM_BYTES - 1}}}))(?:[{_ALNUM}]+|.)"
_LONG = rf"(?<![{_ALNUM}])[{_ALNUM}]{{{TERM_BYTES + 1}}}"


def _plain(p: Column) -> Column:
    """Whether a string is ASCII: as a phrase is, while a gram begins with a character that isn't."""
    return F.octet_length(p) == F.char_length(p)


def _cut(p: Column) -> Column:
    """A phrase without separators at its end, or the longest start of a gram that fits."""
    fits = lambda n: F.octet_length(F.substr(p, F.lit(1), n)) <= GRAM_BYTES
    gram = F.substr(p, F.lit(1), F.array_max(F.filter(F.sequence(F.lit(1), F.char_length(p)), fits)))
    return F.when(_plain(p), F.rtrim(p, F.lit(" ."))).when(F.octet_length(p) <= GRAM_BYTES, p).otherwise(gram)


def phrases(text: Column) -> Column:
    """All phrases and grams of a text without tags, in order, not yet lower-cased.

    A run of separators counts as its last character. Words of over 24 letters and digits go in parts of 24.
    """
    t = F.regexp_replace(text, r"[ .]+([ .])", "$1")
    t = F.when(text.rlike(_LONG), F.regexp_replace(t, rf"([{_ALNUM}]{{{TERM_BYTES}}})", "$1\u0001")).otherwise(t)
    return F.transform(F.regexp_extract_all(t, F.lit(_START), F.lit(1)), _cut)


def _stopped(term: Column) -> Column:
    wide = F.lit(False)
    for s in STOP_STARTS:
        wide = wide | term.startswith(s)
    return F.when(_plain(term), (F.octet_length(term) <= max(map(len, STOP_WORDS))) & term.isin(*STOP_WORDS)).otherwise(wide)


def _weighted(text: Column, base: Column) -> Column:
    """(term, weight without decay) of every token of a text."""
    lower = lambda p: F.when(_plain(p), F.lower(p)).otherwise(ascii_lower(p))
    return F.transform(phrases(text), lambda p: F.struct(lower(p).alias("term"), F.when(p == lower(p), base).otherwise(base * CAPITAL).alias("w")))


def tokens(url: Column, html: Column, last: int | None = None) -> Column:
    """Array of (position, term, w) of the tokens that aren't stopped, up to position last if given; w is the weight without decay."""
    doc = strip_hidden(strip_comments(html), "<>")  # a script ends a phrase, a comment doesn't
    doc = F.regexp_replace(doc, r"(?s)</body.*", "")
    chunks = F.split(doc, _EVENTS)
    start = F.struct(F.array().cast("array<struct<text:string,base:double>>").alias("out"), F.lit(HEAD).alias("sec"), F.lit(1.0).alias("bold"), F.lit(1.0).alias("head"))

    def step(s, c):
        sec = F.when(c.startswith("<title") & (s["sec"] < TITLE), TITLE).when(c.startswith("</title") & (s["sec"] < AFTER_TITLE), AFTER_TITLE).when(c.startswith("<body") & (s["sec"] < BODY), BODY).otherwise(s["sec"])
        bold = F.when(c.startswith("<b>"), BOLD).when(c.startswith("</b>"), 1.0).otherwise(s["bold"])
        head = s["head"]
        for i, m in enumerate(HEADINGS, 1):
            head = F.when(c.startswith(f"<h{i}>"), m).otherwise(head)
        head = F.when(c.rlike("^</h[1-6]>"), 1.0).otherwise(head)
        base = F.when(sec == TITLE, TITLE_WEIGHT).when(sec == BODY, BODY_WEIGHT).otherwise(0.0) * bold * head
        return F.struct(F.array_append(s["out"], F.struct(c.alias("text"), base.alias("base"))).alias("out"), sec.alias("sec"), bold.alias("bold"), head.alias("head"))

    said = F.filter(F.aggregate(chunks, start, step, lambda s: s["out"]), lambda x: x["base"] > 0)
    of_chunk = lambda x: F.flatten(F.transform(F.filter(pieces(x["text"]), lambda p: ~p.startswith("<")), lambda p: _weighted(p, x["base"])))
    all_ = F.concat(_weighted(url, F.lit(URL_WEIGHT)), F.flatten(F.transform(said, of_chunk)))
    placed = F.transform(all_ if last is None else F.slice(all_, 1, last), lambda t, i: F.struct((i + 1).alias("position"), t["term"].alias("term"), t["w"].alias("w")))
    return F.filter(placed, lambda t: ~_stopped(t["term"]))


def within_max_words(found: Column, most: int = MAX_WORDS) -> Column:
    """The tokens up to the one that brings in the last distinct term allowed."""
    terms = F.transform(found, lambda t: t["term"])
    distinct = F.array_distinct(terms)
    end = F.array_position(terms, F.get(distinct, F.lit(most - 1))).cast("int")
    return F.when((F.size(found) < most) | (F.size(distinct) < most), found).otherwise(F.slice(found, F.lit(1), end))


def page_tokens(pages: DataFrame, most: int | None = None, last: int | None = None) -> DataFrame:
    """pages(page_index, url, html) -> (page_index, position, term, weight), the weight falling by a thousandth with each token. Null url or html counts as empty.

    Whole texts, but for the options most (distinct terms of a page) and last (position)."""
    found = pages.select("page_index", tokens(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), last).alias("found"))
    kept = found.select("page_index", (F.col("found") if most is None else within_max_words(F.col("found"), most)).alias("kept"))  # steps of their own: each array is made once
    # outer: else Spark infers a filter on the array's size and pushes copies of the whole expression down to the scan
    rows = kept.select("page_index", F.posexplode_outer("kept").alias("i", "t")).where("t is not null")
    return rows.select("page_index", "t.position", "t.term", (F.col("t.w") * F.pow(F.lit(DECAY), F.col("i"))).alias("weight"))


def small_word(term: Column) -> Column:
    """A term's entry in the dictionary of short words, or the empty string: up to its first space if that has 8 bytes or fewer,
    else up to a dot or the end of a character of another script among the first 8."""

    def end(w: Column, j: Column) -> Column:
        c, at = F.substr(w, j, F.lit(1)), F.octet_length(F.substr(w, F.lit(1), j - 1))
        wide = F.octet_length(c) > 1
        n = F.when(wide, F.when(at + F.octet_length(c) <= SMALL_BYTES, j).otherwise(j - 1)).when(~c.rlike(rf"[{_ALNUM}]"), j - 1)
        return F.when(at <= SMALL_BYTES, n)

    def cut(w: Column) -> Column:
        ends = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(SMALL_BYTES + 1), F.char_length(w))), lambda j: end(w, j)), lambda n: n.isNotNull())
        return F.when(F.octet_length(w) <= SMALL_BYTES, w).otherwise(F.substr(w, F.lit(1), F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))))

    return F.get(F.transform(F.array(F.substring_index(term, " ", 1)), cut), F.lit(0))
