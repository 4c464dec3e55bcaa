"""HTML functions: comment removal, shortening, title, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url, url_host

# Patterns that Java's and RE2's regular expressions read alike.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
HIDDEN = r"(?s)<![^>]*(?:>|\z)|<script.*?(?:</script[^>]*(?:>|\z)|\z)|<style.*?(?:</style[^>]*(?:>|\z)|\z)"
PIECE = r"<[^>]*(?:>|\z)|[^<]+"
#: An attribute after white space: href with its value (kept), or any other (dropped; the space stays).
ATTRIBUTE = r"""([ \t\r\n])(href[ \t\r\n]*=[ \t\r\n]*(?:"[^"]*"|[^ \t\r\n"/>]*))|([ \t\r\n])[A-Za-z][-A-Za-z0-9_:]*(?:[ \t\r\n]*=[ \t\r\n]*(?:"[^"]*"|[^ \t\r\n"/>]*))?"""
LINK = r'href="((?://|https?://|/)[^"]*)'
TITLE_BYTES = 255


def strip_comments(h: Column) -> Column:
    """Without <!-- ... -->; one that isn't closed goes on to the end."""
    return F.regexp_replace(h, COMMENT, "")


def strip_hidden(h: Column, mark: str = "") -> Column:
    """With declarations, scripts and styles replaced by a mark (comments have gone before)."""
    return F.regexp_replace(h, HIDDEN, mark)


def pieces(h: Column) -> Column:
    """Tags and the text between them, in order."""
    return F.regexp_extract_all(h, F.lit(PIECE), F.lit(0))


def shorten(h: Column) -> Column:
    """Without comments, declarations, scripts, styles and attributes other than href; meta and img tags and text stay as they are."""
    kept = lambda p: ~p.startswith("<") | p.startswith("<meta") | p.startswith("<img")
    return F.array_join(F.transform(pieces(strip_hidden(strip_comments(h))), lambda p: F.when(kept(p), p).otherwise(F.regexp_replace(p, ATTRIBUTE, "$1$2$3"))), "")


def clip_bytes(c: Column, most: int) -> Column:
    """The longest start of a string that has so many bytes or fewer and ends between characters."""
    fits = lambda n: F.octet_length(F.substr(c, F.lit(1), n)) <= most
    short = F.substr(c, F.lit(1), F.lit(most))
    fewest = F.greatest(F.lit(0), F.least(F.char_length(short), F.lit(most // 4)))
    longest = F.array_max(F.filter(F.sequence(fewest, F.char_length(short)), fits))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substr(c, F.lit(1), longest))


def page_title(h: Column) -> Column:
    """The text of the first title tag: spaces and control characters before it and spaces after it cut off, 255 bytes at most."""
    raw = F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)(?:</title|\z)", 1)
    return F.rtrim(clip_bytes(F.regexp_replace(F.ltrim(raw, F.lit(" ")), r"[\x00-\x1f]", ""), TITLE_BYTES))


def page_links(h: Column, page_url: Column) -> Column:
    """Canonical link targets in the order they stand in the page, as an array; refused ones are null.

    Only href="/...", "//...", "http://..." and "https://..." count. A link to the page's own host takes the page's scheme.
    """
    own, secure = url_host(page_url), page_url.startswith("https://")

    def target(v: Column) -> Column:
        local = v.startswith("/") & ~v.startswith("//")
        rest = F.when(local, F.concat(own, v)).otherwise(F.regexp_replace(v, "^(?:https?:)?//", ""))
        after = F.substr(rest, F.char_length(own) + 1, F.lit(1))
        same = local | (rest == own) | (rest.startswith(own) & after.isin("/", ":", "?"))
        https = (same & secure) | (~same & v.startswith("https://"))
        return F.when(rest != "", F.when(https, F.concat(F.lit("https://"), rest)).otherwise(rest))

    return F.transform(F.regexp_extract_all(h, F.lit(LINK), F.lit(1)), target)


def canonical_links(h: Column, page_url: Column) -> Column:
    return F.transform(page_links(h, page_url), canonical_url)
