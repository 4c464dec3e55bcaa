"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs; all
but the last return the columns of documents. An empty docs gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import lines, mix, near, pack, quality, simhash
from webloom.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(_documents(docs), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what is left of their lines, which may be nothing."""
    out = lines.dedup_lines(_documents(docs))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("lines_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (as op3), then one of each component of five-word similarity 0.8 or more: the one with the least id."""
    return near.one_of_each(written(simhash.one_of_each(_documents(docs)), "near-first"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in random order."""
    return mix.mix(_documents(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack.pack(_documents(docs), pack.default_tokenizer())


STAGES = [("quality", classify), ("lines", dedup_lines), ("near", dedup_near), ("mix", mix_sources), ("pack", pack_sequences)]

#: The classifier, fuzzy lines and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if (name, stage) == STAGES[-1] else written(out, f"pipeline-{name}")
    return docs
