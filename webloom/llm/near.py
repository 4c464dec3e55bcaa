"""Near copies of whole documents: Jaccard similarity of their five-word shingles, by the links of webloom.llm.lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, sliced, small, written
from webloom.llm.lines import MOST_ROWS, SIMILARITY, banded, identified, line_id, links, texts_of

WORDS, SEED = 5, 42


def whole(text: str | None):
    """A text as one unit; blank texts have none."""
    return [(0, text)] if text and text.strip() else []


def hashed_words(texts: list[str], k: int = WORDS):
    """As lines._hashed, for shingles of k words (A-Z lower-cased, between ASCII white space); fewer words are one shingle."""
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for at, t in enumerate(texts):
        w = t.encode("utf-8", "surrogatepass").lower().split()
        n = max(1, len(w) - k + 1)
        shingles = map(join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) > k else iter([join(w)])
        yield at, np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n), np.zeros(n, np.int64), np.array([n])


def _ids(batches):
    for b in sliced(batches):
        texts = b.column(2).to_pylist()
        at = pa.array([i for i, t in enumerate(texts) if whole(t)], pa.int64())
        both = [line_id(t) for t in texts if whole(t)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in both], pa.int64()), pa.array([c for _, c in both], pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["line", "check", "id", "dk"])


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns: one for each component of the links of similarity least or more, the one with the least id, then the least hash of its text.

    docs is read several times. Rows that are like no other stay as they are; so do blank texts and exact copies without another like them.
    Pairs are found as in lines.links and verified by the exact similarity. A null id is the least. Empty table: no rows.
    """
    kind = docs.schema[id].dataType.simpleString()
    seen = written(docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("dk"), F.col(text).alias("text")).mapInArrow(_ids, f"line long, check long, id {kind}, dk long"), "near-seen")
    rows, per_line, told = identified(seen, "near")
    found = links(banded(docs, text, whole, WORDS, hashed_words, line_id, told, per_line.count()), texts_of(docs, text, whole, line_id, told), least, WORDS, hashed_words, "near")
    roots = found.toDF("line", "root")
    members = written(rows.join(roots.union(roots.select("root", "root").distinct()), "line").select("root", F.struct("id", "dk").alias("key")), "near-members")
    dropped(seen, per_line, found)
    stays = members.groupBy("root").agg(F.min("key").alias("stays"))
    gone = written(members.join(stays, "root").where(~F.col("key").eqNullSafe(F.col("stays"))).select("key").distinct(), "near-gone")
    dropped(members)
    gone = small(gone, MOST_ROWS)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("of", F.struct(F.col(f"row.`{id}`").alias("id"), F.xxhash64(f"row.`{text}`").alias("dk")))
    kept = rows.join(gone, rows.of.eqNullSafe(gone.key), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
