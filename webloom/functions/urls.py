"""URL functions: canonical form, key, host, registered suffix, frontier partition, admission rules.

All are Column expressions of built-in functions. Lengths are in bytes. A null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the crawl rules.
MAX_URL_BYTES = 2048
MAX_URLS_PER_HOST = 1_000_000
SKIPPED_ENDINGS = (".js", ".ico", ".css", ".jpg", ".png", ".zip", ".gif", ".pdf", ".exe", ".rar")
SKIPPED_HOSTS = (".jp",)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone; letters of other scripts stay as they are."""
    return F.translate(c, UPPER, LOWER)


def _strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit("/"))


def canonical_url(u: Column) -> Column:
    """The URL as it is stored, or null where it is refused.

    An https URL keeps its scheme, an http one loses it; other text that starts like a scheme without its colon is refused, as is
    what is shorter than three bytes.
    """
    n = F.octet_length(u)
    bare = lambda c: F.when(F.octet_length(_strip_right(F.ltrim(c, F.lit("/")))) >= 3, _strip_right(F.ltrim(c, F.lit("/"))))
    secure = F.when(F.substr(u, F.lit(6), F.lit(1)) == ":", _strip_right(u))
    plain = F.when(F.substr(u, F.lit(5), F.lit(1)) == ":", bare(F.substr(u, F.lit(6))))
    return F.when(n < 3, None).when((n >= 7) & u.startswith("https"), secure).when((n >= 7) & u.startswith("http"), plain).otherwise(bare(u))


def url_key(u: Column) -> Column:
    """32 hexadecimal digits that stand for a URL or host: MD5 without a leading www. and slashes; all zero for nothing."""
    rest = F.ltrim(F.when((F.octet_length(u) > 4) & u.startswith("www."), F.substr(u, F.lit(5))).otherwise(u), F.lit("/"))
    return F.when(rest == "", F.lit("0" * 32)).otherwise(F.md5(rest.cast("binary")))


def url_host(u: Column) -> Column:
    """All between the scheme and the first slash: a port, query or fragment without a slash before it stays in."""
    return F.regexp_extract(u, "^(?:https?://)?([^/]*)", 1)


def url_port(u: Column) -> Column:
    return F.when(u.startswith("https://"), 443).when(u.isNotNull(), 80)


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, "^(?:https?://)?[^/]*(.*)$", 1)


def host_suffix(host: Column) -> Column:
    """The part of a host that owns it: its last two labels, and more to the left for as long as the leftmost one starts with com or org."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"(?i)([^.]*(?:\.(?:com|org)[^.]*)*\.[^.]*)$", 1), F.lit("")), host)


def _little_endian(key: Column, first: int) -> Column:
    """Eight bytes of a key from a hexadecimal digit on, as a signed number, low byte first."""
    digits = F.concat(*(F.substr(key, F.lit(first + 2 * i), F.lit(2)) for i in range(7, -1, -1)))
    return F.conv(digits, 16, -10).cast("long")


def host_partition(host: Column, parts: int) -> Column:
    """The frontier partition of a host's suffix: both halves of its key, as unsigned numbers, xor-ed, modulo parts."""
    key = url_key(host_suffix(host))
    x = _little_endian(key, 1).bitwiseXOR(_little_endian(key, 17))
    return F.pmod(F.pmod(x, F.lit(parts)) + F.when(x < 0, F.lit((1 << 64) % parts)).otherwise(0), F.lit(parts)).cast("int")


def is_crawlable(u: Column) -> Column:
    """Whether a canonical URL passes the rules on length, ending and host (not the count by host; see frontier.within_host_limit)."""
    n, host = F.octet_length(u), url_host(u)
    bad_end = F.lit(False)
    for e in SKIPPED_ENDINGS:
        bad_end = bad_end | u.endswith(e)
    bad_host = F.lit(False)
    for e in SKIPPED_HOSTS:
        bad_host = bad_host | host.endswith(e)
    return n.between(4, MAX_URL_BYTES) & ~((n > 4) & bad_end) & (F.octet_length(host) > 2) & ~((F.octet_length(host) > 3) & bad_host)
