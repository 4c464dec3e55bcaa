"""Mixing sources to target weights by Poisson replication.

A source whose share of the characters should become w is to be repeated at the mean rate w * total / size. Each
document draws its number of copies from the Poisson distribution with that mean, by inversion at a uniform
number hashed from a seed and its id, so a rerun (of a task or of everything) draws alike. A large rate is split in equal parts
of at most LARGEST, a number drawn for each, as a sum of Poisson numbers is one. The copies are
dealt out by a hash of seed, id and copy and sorted by it: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, spread, table, written

ALPHA, EPOCHS, SEED = 0.7, 1.0, 42
#: The largest rate that is inverted at once.
LARGEST = 64
#: Broadcast the sources' distributions up to so many numbers, else join them through a shuffle.
MOST_NUMBERS = 2_000_000


def rates(df: DataFrame, weights: dict | None, alpha: float, epochs: float, source: str, text: str) -> DataFrame:
    """(source, parts, cdf): in how many equal parts each source's rate is split, and the Poisson distribution function at 0, 1, 2 ... of a part."""
    sizes = written(df.groupBy(F.col(source).alias("source")).agg(F.sum(F.char_length(F.coalesce(text, F.lit("")))).cast("double").alias("size")), "mix-sizes")
    if weights is None:
        w = F.pow("size", F.lit(alpha))
    else:
        w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    sized = sizes.withColumn("w", F.when(F.col("size") > 0, w.cast("double")).otherwise(0.0))
    total, all_w = sized.agg(F.sum("size"), F.sum("w")).first()
    rate = F.when(F.col("size") > 0, F.col("w") / F.lit(all_w or 1.0) * F.lit(epochs * (total or 0.0)) / F.col("size")).otherwise(F.lit(float(epochs)))
    sized = sized.select("source", rate.alias("all")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("all") / LARGEST)).cast("long")).withColumn("rate", F.col("all") / F.col("parts"))
    # log of each probability by adding up; ends where 1 is reached, at 190 at most
    most = (F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    zero = F.struct(F.array().cast("array<double>").alias("cdf"), F.lit(0.0).alias("sum"), (-F.col("rate")).alias("ln"))
    step = lambda s, k: F.struct(F.array_append(s["cdf"], s["sum"] + F.exp(s["ln"])).alias("cdf"), (s["sum"] + F.exp(s["ln"])).alias("sum"), (s["ln"] + F.log("rate") - F.log(k + 1)).alias("ln"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), most), zero, step, lambda s: s["cdf"])).otherwise(F.array().cast("array<double>"))
    out = written(sized.select("source", "parts", cdf.alias("cdf")), "mix-rates")
    dropped(sizes)
    return out


def mix(df: DataFrame, weights: dict | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED, source: str = "source", text: str = "text", id: str = "doc_id") -> DataFrame:
    """All rows, each as often as it was drawn, in a random order: the columns of df, then copy (from 1) and shuffle_key.

    weights: target share of the characters by source, scaled to sum to 1; a source not named gets none. None: a
    source's share is its size ** alpha, scaled. epochs: expected size of the result over the input's. Null source: a
    source of its own (of weight 0 where weights are given). A source without any characters: rate epochs. Rows with the same
    id (null is an id) draw alike. At most 2^31 - 1 copies of a row. Columns named copy and shuffle_key are replaced. Empty table: no rows.
    """
    cdfs = rates(df, weights, alpha, epochs, source, text)
    large = (cdfs.agg(F.max("parts")).first()[0] or 1) > 1
    name = F.coalesce(F.col(f"row.`{id}`").cast("string"), F.lit("null"))
    of = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = rows.withColumn("name", name).withColumn("of", of(F.col(f"row.`{source}`")))
    rows = spread(rows, cdfs.select(of(F.col("source")).alias("of"), "parts", "cdf"), "of", "name", MOST_NUMBERS // (3 * LARGEST))
    uniform = lambda said: (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    below = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    first = F.concat(F.lit(f"{seed}:"), F.col("name"))
    rows = rows.withColumn("u", uniform(first)).withColumn("copies", below(F.col("u")))
    if large:  # a number for each part; then the copies in two steps, a million at a time
        more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1), F.col("copies").cast("long"), lambda n, k: n + below(uniform(F.concat(first, F.lit(":"), k.cast("string")))))
        rows = rows.withColumn("copies", F.when(F.col("parts") > 1, more).otherwise(F.col("copies"))).where("copies > 0")
        rows = rows.select("row", "name", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000000"))).alias("step"))
        rows = rows.select("row", "name", F.explode(F.sequence(F.col("step") * 1_000_000 + 1, F.least(F.col("copies"), (F.col("step") + 1) * 1_000_000))).alias("copy")).withColumn("copy", F.col("copy").cast("int"))
    else:
        rows = rows.where("copies > 0").select("row", "name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    name = F.col("name")
    rows = rows.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}#"), name, F.lit("#"), F.col("copy").cast("string"))))
    rows = rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ("copy", "shuffle_key")), "copy", "shuffle_key")


def op1_mix(spark, sf_dir):
    """All documents, replicated to the target weights and shuffled."""
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH sized AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
shares AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {ALPHA}) ELSE 0 END AS w FROM sized),
rated AS (
  SELECT source, CASE WHEN size > 0 THEN w / sum(w) OVER () * {EPOCHS} * sum(size) OVER () / size ELSE {EPOCHS} END AS rate FROM shares),
terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rated, unnest(generate_series(0::BIGINT, (rate + 12 * sqrt(rate) + 30)::BIGINT)) AS s(k)),
cdfs AS (SELECT source, list(c ORDER BY k) AS cdf FROM (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cdf, lambda c: c <= (('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS copies
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('{SEED}#' || coalesce(doc_id::VARCHAR, 'null') || '#' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1::BIGINT, copies::BIGINT)) AS copy FROM drawn WHERE copies > 0)
"""
