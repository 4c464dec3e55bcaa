"""The inverted index: weighted terms of each page, normalised, in two dictionaries sorted by term."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import bf16
from webloom.functions.tokens import page_tokens, small_word
from webloom.sources.tables import exists, removed, shared_dir, stored, version


def tokens_by_page(store: DataFrame, max_words: int | None = None, last_position: int | None = None) -> DataFrame:
    """All tokens, or those within the limits given (see page_tokens), partitioned by page. It is the pages that are shuffled, not their tokens, which have ten times the size;
    windows and groups by page that follow need no other exchange. The number of partitions is given, as adaptive execution
    would merge small ones, while tokens take far more time than their pages' size tells."""
    n = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return page_tokens(store.select("page_index", "url", "html").repartition(n, "page_index"), max_words, last_position)


def page_terms(tokens: DataFrame, normalizer: str = "reset") -> DataFrame:
    """(page_index, position, term, weight) -> (page_index, term, weight, position, total) for each term of a page.

    weight: the largest, truncated. position: the last at which the weight exceeds that, else the first with it. total, by which a
    page is normalised: normalizer "sum" adds up the weights of first occurrences; "reset" starts again from the gain whenever a
    repeated term outweighs what is stored for it. Give it tokens_by_page(): then nothing is shuffled here.
    """
    of_term = Window.partitionBy("page_index", "term").orderBy("position")  # one order for both frames: the tokens are sorted once
    every, earlier = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), of_term.rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.select("*", F.max("weight").over(every).alias("most"), F.max("weight").over(earlier).alias("was"))
    t = t.select("*", bf16.truncate(F.col("most")).alias("stored"), bf16.truncate(F.col("was")).alias("kept"))
    gain = F.when(F.col("weight") > F.col("kept"), F.struct("position", (F.col("weight") - F.col("kept")).alias("gain")))
    if normalizer == "reset":
        t = t.withColumn("last", F.max(gain).over(Window.partitionBy("page_index")))
    elif normalizer == "sum":
        t = t.withColumn("last", F.lit(None).cast("struct<position:int,gain:double>"))
    else:
        raise ValueError(f"normalizer is reset or sum, not {normalizer}")
    fresh = F.when(F.col("was").isNull() & (F.col("last").isNull() | (F.col("position") > F.col("last.position"))), F.col("weight")).otherwise(0.0)
    t = t.withColumn("total", F.sum(fresh).over(Window.partitionBy("page_index")) + F.coalesce("last.gain", F.lit(0.0)))
    g = t.groupBy("page_index", "term", "stored", "total").agg(F.max(F.when(F.col("weight") > F.col("stored"), F.col("position"))).alias("above"), F.min(F.when(F.col("weight") == F.col("stored"), F.col("position"))).alias("at"))
    return g.select("page_index", "term", F.col("stored").alias("weight"), F.coalesce("above", "at").alias("position"), "total")


def main_dictionary(store: DataFrame, ranks: DataFrame | None = None, max_words: int | None = None, normalizer: str = "reset", last_position: int | None = None) -> DataFrame:
    """page_store [, ranks(node = page_key, rank), or ranks(page_index, rank)] -> postings (term, rank, page_index, position); pages without a rank have 1.

    Several pages may have one key; where each has a rank of its own, ranks go by page_index."""
    terms = page_terms(tokens_by_page(store, max_words, last_position), normalizer)
    if ranks is None:
        terms = terms.withColumn("page_rank", F.lit(1.0))
    else:
        key = "page_index" if "page_index" in ranks.columns else "page_key"
        known = store.select("page_index", "page_key").join(ranks.withColumnRenamed("node", key), key, "left")
        terms = terms.join(known.select("page_index", F.coalesce("rank", F.lit(1.0)).alias("page_rank")), "page_index")
    scaled = F.when(F.col("total") > 0, bf16.truncate(F.col("weight") * F.col("page_rank") / F.col("total"))).otherwise(F.col("weight"))
    return terms.select("term", scaled.alias("rank"), "page_index", "position")


def small_dictionary(main: DataFrame) -> DataFrame:
    """Postings of short words: of each page and word the one with the largest rank, then the least position."""
    s = main.withColumn("term", small_word(F.col("term"))).where("term <> ''")
    best = s.groupBy("page_index", "term").agg(F.max(F.struct("rank", (-F.col("position")).alias("p"))).alias("b"))
    return best.select("term", F.col("b.rank").alias("rank"), "page_index", (-F.col("b.p")).alias("position"))


def sorted_postings(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings in the dictionary's order: ranges of terms, each sorted by term, rank and page.

    Terms are ranged together with the page, so that one very common term spreads over several partitions.
    """
    keys = ["term", "rank", "page_index"]
    ranged = postings.repartitionByRange(partitions, *keys) if partitions else postings.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_dictionary(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """As Parquet in order of term: a lookup reads the row groups whose range holds it. _id tells a posting's place (see sorting.placed).

    postings are read twice, as their ranges are told from a sample: give it a table, not what is dear to make."""
    ordered = sorted_postings(postings, partitions).withColumn("_id", F.monotonically_increasing_id())
    ordered.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


SCHEMA = "term string, rank double, page_index long, position int"


def _written(store: DataFrame, of: str, ranks: DataFrame | None, options: dict) -> str:
    """Where the dictionaries are; they are made where they aren't there. The postings are made once, stored by page, and sorted from there."""
    spark = store.sparkSession
    base = f"{shared_dir(spark)}/webloom/dictionary-placed-{version(store)}-{of}"
    if not exists(spark, f"{base}/small/_SUCCESS"):
        own = f"{shared_dir(spark)}/webloom/postings-{uuid.uuid4().hex}"
        postings = stored(main_dictionary(store, ranks, **options), f"{own}/main")
        write_dictionary(postings, f"{base}/main")
        write_dictionary(stored(small_dictionary(postings), f"{own}/small"), f"{base}/small")
        removed(spark, own)
    return base


def dictionaries(store: DataFrame, of: str, ranks: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The main and the small dictionary of a store, read from where they are written: in the shared folder, once for what the store's files are and of says.

    of: a name for the ranks and options, which tells dictionaries of one store apart. A lookup in them reads the row groups whose range of terms
    holds it. A dictionary counts as there when both parts were written whole.
    """
    base = _written(store, of, ranks, options)
    return tuple(store.sparkSession.read.schema(SCHEMA).parquet(f"{base}/{part}") for part in ("main", "small"))


def main_in_order(store: DataFrame, of: str, ranks: DataFrame | None = None, **options) -> DataFrame:
    """The main dictionary of dictionaries() with _id, for sorting.placed: it is sorted already."""
    return store.sparkSession.read.schema(f"{SCHEMA}, _id long").parquet(f"{_written(store, of, ranks, options)}/main")


def statistics(main: DataFrame) -> DataFrame:
    """One row: words, words of other scripts, pages, most words of a page, short words. main is made once, and nothing is shuffled where it comes by page."""
    of_word = main.groupBy("page_index", small_word(F.col("term")).alias("word")).agg(F.count("*").alias("n"), F.count_if(F.expr("term rlike '^[^\\\\x00-\\\\x7F]'")).alias("other"))
    per_page = of_word.groupBy("page_index").agg(F.sum("n").alias("n"), F.sum("other").alias("other"), F.count_if(F.col("word") != "").alias("small"))
    return per_page.agg(F.sum("n").alias("words"), F.sum("other").alias("other_words"), F.count("*").alias("pages"), F.max("n").alias("most_words"), F.coalesce(F.sum("small"), F.lit(0).cast("long")).alias("small_words"))
