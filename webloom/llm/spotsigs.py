"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text's fingerprint is the set of its signatures. An anchor is a common word of one of four languages; its
signature is the chain of the next few content words (not common ones) after it. Where no anchor comes for a number of
words, the next word stands in for one, so texts of any language or kind get signatures and an edit stays local.
Two fingerprints compare by the Jaccard similarity of their sets. For near-duplicates, sets are partitioned by length, so
that only neighbouring partitions can hold a partner, and meet there on the rarest of their signatures (webloom.llm.lines.prefix), which
prunes all pairs that can't be alike, as do parity sketches of the sets (webloom.llm.sketches); the Jaccard similarity of those left is computed, and union-find joins
what is alike.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, sliced, spread, table, written
from webloom.llm.lines import identified, line_id, links, rarest
from webloom.llm.sketches import sketch

CHAIN, GAP, SIMILARITY = 2, 8, 0.8
#: Rows by partition of the query's ordered pass.
ROWS_A_PART = 200_000
MOST_PARTS = 100_000
#: Broadcast the components of sets up to this number, else join them through a shuffle.
MOST_SETS = 1_000_000

#: Common words.
ANCHORS = frozenset(
    (
        "the of and to in a is was for on are with as be by at or from this that it an which "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
        "le la les de des et un une du que qui en dans pour par sur au est pas plus ce se il "
        "el los las del y una por con para su al lo como más o no son"
    ).split()
)
#: A word: letters and digits; each ideograph, kana or hangul syllable is one of its own.
WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")


def signatures(text: str | None, chain: int = CHAIN, gap: int = GAP) -> np.ndarray:
    """The distinct signatures of a text, sorted, as unsigned 32-bit hashes.

    Case and punctuation don't count. Fewer content words than a chain after an anchor: the chain is shorter; a text without
    content words has one signature of all its words; a text without words (null, empty, blank) one of its characters
    other than white space, or none.
    """
    words = WORD.findall((text or "").lower())
    if not words:
        rest = "".join((text or "").split())
        return np.array([xxhash.xxh32_intdigest(rest.encode("utf-8", "surrogatepass"))] if rest else [], np.uint32)
    content = [w for w in words if w not in ANCHORS]
    if not content:
        return np.array([xxhash.xxh32_intdigest(" ".join(words))], np.uint32)
    starts, k, since = set(), 0, gap  # k: content words so far; the start of a text counts as an anchor's place
    for w in words:
        if w in ANCHORS:
            starts.add(k)
            since = 0
        else:
            if since >= gap:
                starts.add(k)
                since = 0
            k += 1
            since += 1
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(" ".join(content[i : i + chain])) for i in starts if i < k], np.uint32))


def encoded(sigs: np.ndarray) -> str:
    """A fingerprint as a string: 8 hexadecimal digits for each signature."""
    return sigs.astype(">u4").tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spliced(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as much (or all) of the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fingerprint string) of every row; see signatures() for odd texts. Empty table: no rows."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoded(signatures(t)) for t in b.column(1).to_pylist()], pa.string())], [id, "fingerprint"])

    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, fingerprint string")


# --- near-duplicates ----------------------------------------------------------------------------------------------------


def _known(df: DataFrame, text: str, id: str) -> DataFrame:
    """(id, line, check, fingerprint, size, sketch) of every row: the fingerprint, the two numbers that stand for it, how many signatures it has and their sketch."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            sets = [signatures(t) for t in b.column(1).to_pylist()]
            fps = [encoded(x) for x in sets]
            both = [line_id(f) for f in fps]
            told = [pa.array([i for i, _ in both], pa.int64()), pa.array([c for _, c in both], pa.int64()), pa.array(fps, pa.string()), pa.array(map(len, sets), pa.int32()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *told], [id, "line", "check", "fingerprint", "size", "sketch"])

    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, line long, check long, fingerprint string, size int, sketch binary")


def _sets(fingerprints: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(f, ">u4").astype(np.uint64) for f in fingerprints]


def _as_hashed(fingerprints: list[bytes], k: int):
    """The sets in the form that webloom.llm.lines takes them in."""
    for at, s in enumerate(_sets(fingerprints)):
        yield at, s, np.zeros(len(s), np.int64), np.array([len(s)])


def _components(rows: DataFrame, id: str, least: float) -> DataFrame:
    """_known() rows, written -> the rows with component, the least id that links reach."""
    seen, per_set, told = identified(rows.select("line", "check", id), "spotsigs", F.min(id).alias("least_id"))
    sets = told(rows.select("line", "check", "fingerprint")).select("line", F.unhex("fingerprint").alias("text"))  # bytes: half of what is shuffled
    sketches = written(told(rows.select("line", "check", "size", "sketch")).select("line", "size", "sketch").dropDuplicates(["line"]), "spotsigs-sketches")
    roots = links(rarest(sets, _sets, least), sets, least, 0, _as_hashed, "spotsigs", sketches)
    named = per_set.join(roots, per_set.line == roots.node, "left").select("line", "n", "least_id", F.coalesce("root", "line").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least_id").alias("component"))
    named = written(named.join(of_root, "root").select("line", "component", "n"), "spotsigs-named")
    dropped(per_set, sketches, roots)
    return spread(told(rows.drop("size", "sketch").withColumn("own", F.col("line"))), named, "line", id, MOST_SETS, many="n")


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """Every row's (id, fingerprint, component): component is the least id that links of likeness least or more reach.

    Rows with the same fingerprint are one, so copies cost nothing. Sets are partitioned by length and meet in a partition, or from the next
    one, on their rarest signatures; in a large meeting each is paired with the first and its neighbour, and only what is
    then still apart with more (see webloom.llm.lines.links). No link between different texts is lost.
    Null ids never are a component's id unless it has no other. Empty fingerprints are one group. Empty table: no rows.
    """
    return _components(written(_known(df, text, id), "spotsigs"), id, least).select(id, "fingerprint", "component")


# --- the query's ordered pass -------------------------------------------------------------------------------------------


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]


def _passed(batches):
    """Rows (part, k, id, text, head, component, what) in order of part, k and what -> each document with its fingerprint and those of the edited text and
    the next document. The last row of a part is a copy of the next part's first one (head). what: 1 a document, 0 the component of
    those documents of this k whose fingerprint text stands for (see _key); others are their own."""
    held = None  # (part, id, text, signatures, component)
    told, of = {}, None  # components of documents of the k that of says
    for b in sliced(batches):
        out = []
        columns = [b.column(i).to_pylist() for i in (0, 1, 3, 4, 6)]
        for part, k, text, head, what, id_, component in zip(*columns, b.column(2), b.column(5), strict=True):
            if not head and of != (part, k):
                told, of = {}, (part, k)
            if not what:
                told[text] = component.as_py()
                continue
            sigs = None
            if held is not None and held[0] == part:
                sigs = signatures(text)
                edited = spliced(held[2], text)
                es = signatures(edited)
                out.append((held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(held[3]), encoded(es), likeness(held[3], es), likeness(held[3], sigs), held[4]))
            if head:
                held = None
                continue
            sigs = signatures(text) if sigs is None else sigs
            held = (part, id_.as_py(), text, sigs, told.get(_key(*line_id(encoded(sigs))), id_.as_py()) if told else id_.as_py())
        kind = b.schema.field(2).type
        if out:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)


def _key(line: int, check: int) -> str:
    return f"{line}:{check}"


def _number_below(cuts: list[int], k):
    """How many of the ascending cuts are less than k, in about 2 * sqrt(len(cuts)) steps."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    array = lambda x: F.lit(np.array(x, np.int64))  # noqa: E731  one literal
    i = F.size(F.filter(array([c[-1] for c in chunks]), lambda c: c < k))
    return F.least(i * m, F.lit(len(cuts))) + F.size(F.filter(F.coalesce(F.get(F.array(*map(array, chunks)), i), array([])), lambda c: c < k))


def compared_to_next(df: DataFrame, text: str = "text", id: str = "doc_id", least: float | None = None) -> DataFrame:
    """Every row with its fingerprint, that of its edited text (see spliced), and its likeness to that and to the next row's.

    least: also component_id, as near_duplicates() finds it for that likeness; it comes to its rows in the same exchange.
    Rows are in ascending order of id (a number), null first, then of a hash of the text and the text; after the last comes the first. The rows
    are dealt out once by ranges of id; each range gets a copy of the next one's first row, found from the ids alone,
    so nothing needs all rows in one task. A range is of about ROWS_A_PART ids; all rows of one id are in one.
    Null text is empty. A single row is its own next. Empty table: no rows.
    """
    kind = df.schema[id].dataType.simpleString()
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("k", number("id"))
    n = rows.count()
    schema = f"`id` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id {kind}"
    done = lambda out: (out if least is not None else out.drop("component_id")).withColumnRenamed("id", id)
    parts = int(min(MOST_PARTS, max(1, n // ROWS_A_PART, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    cuts = sorted(set(rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] or [])) if parts > 1 and n else []
    part = _number_below(cuts, F.col("k"))
    firsts = sorted(tuple(r) for r in rows.select("k", part.alias("part")).groupBy("part").agg(F.min("k")).collect())  # a row for each range
    if not firsts:
        return done(df.sparkSession.createDataFrame([], schema))
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    order = F.xxhash64("text")
    edge = F.broadcast(df.sparkSession.createDataFrame(before, "k long, part int"))  # MOST_PARTS rows at most
    none, document = F.lit(None).cast(kind).alias("component"), F.lit(1).cast("byte").alias("what")
    heads = rows.join(edge, "k").select("part", "k", "id", "text", F.lit(True).alias("head"), none, document)
    all_ = rows.select(part.cast("int").alias("part"), "k", "id", "text", F.lit(False).alias("head"), none, document).union(heads)
    if least is not None:
        known = written(_known(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "id"), "spotsigs")
        told = _components(known, "id", least).where(~F.col("id").eqNullSafe(F.col("component")))
        told = written(told.select("id", F.concat_ws(":", "own", "check").alias("text"), "component").distinct(), "spotsigs-components").withColumn("k", number("id"))
        dropped(known)
        all_ = all_.union(told.select(part.cast("int").alias("part"), "k", "id", "text", F.lit(False).alias("head"), "component", F.lit(0).cast("byte").alias("what")))
    dealt = all_.repartitionById(parts, "part").sortWithinPartitions("part", "head", "k", "what", order, "text")
    return done(dealt.mapInArrow(_passed, schema))


def op2_spotsigs(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, the likenesses, and the component of near-duplicates it is in."""
    return compared_to_next(table(spark, sf_dir, "documents"), least=SIMILARITY)
