"""Exact deduplication with a stateful stream.

The rows arrive as a stream of files. Keyed state on disk (RocksDB, checkpointed to the shared folder, never expired)
retains for each digest how often it came, the stable identifier of the row that stays, and a locator of its
content: file and row in it. Copies are combined before they reach the state, so a text that makes up much of the
input costs a task no more than another one. What is returned is read from the state. A digest that came more than once is a hit: the
content that its locator points at is compared with the full bytes of all its rows, and texts that only share their
digest part company. With a home of its own the state lives on, and a later call takes in only what has arrived since.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import drop_path, dropped, fresh_path, spread, string_of, written

#: Bytes of files that a micro-batch takes, and hits up to which a join with them is broadcast.
BATCH_BYTES, MOST_HITS = 1 << 40, 1_000_000
#: Small write buffers and no disk space set aside in advance: one store for each shuffle partition is open at a time.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _set(spark: SparkSession, conf: dict):
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text):
    return F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame, id: str, text: str, digest) -> DataFrame:
    return rows.select(F.col(id).alias("id"), string_of(text).alias("text"), F.struct(F.col(id).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")).withColumn("digest", digest(F.col("text")))


def arriving(spark: SparkSession, path: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The Parquet file or folder at path as a stream of its files, and of nothing that lies beside it: a stream's path may not be a
    single file, so it is a pattern that this one name alone fits."""
    name = path.rstrip("/")
    plain = "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name[:-1])
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{plain}[{name[-1]}]")


def digest_state(stream: DataFrame, id: str, text: str, digest, hits: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what has arrived since the last time and returns the state: digest, n, at (id, file, row of the row that stays).

    stream: of a file source. hits: a folder for what each micro-batch finds to be copies; a batch that is run again after a
    failure overwrites its own part.
    """
    spark = stream.sparkSession
    state = _located(stream, id, text, digest).groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("at"))

    def put(batch: DataFrame, k: int) -> None:
        batch.where("n > 1").select("digest").write.mode("overwrite").parquet(f"{hits}/batch={k}")

    with _set(spark, STORE):
        q = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
    n, at = kept.schema["value"].dataType.names
    return kept.select("key.digest", F.col(f"value.{n}").alias("n"), F.col(f"value.{at}").alias("at"))


def parted(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Of digests (hits: digest, n, at) that stand for several texts, every text: (digest, sha, n, at).

    All rows of a hit are grouped by their whole text, copies combined where they are read; the group that holds the row that the
    locator points at is the content that the state means, any other group is a text that only shares the digest.
    """
    rows = spread(docs, hits.select("digest", F.col("at").alias("stays")), "digest", "text", MOST_HITS)
    classes = rows.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max(F.col("at") == F.col("stays")).alias("located"))
    classes = written(classes.select("digest", F.sha2("text", 256).alias("sha"), "n", "at", "located"), "dedup-classes")
    mixed = classes.where("not located").select("digest").distinct()
    return classes.join(mixed, "digest", "left_semi").drop("located")


def deduplicate(spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", digest=sha256, home: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The Parquet table at path -> one row for each of its rows: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty. The row with the largest id stays (null is least; of repeated
    rows with that id, the last one in the last file). digest: a function of the text column; whatever it is,
    the result is the same. home: a folder in which the state lives on for later calls on the same, grown table (with the same digest);
    None: one that goes again. Files must not be taken away from the table or changed. Other columns are left out. Empty table: no rows.
    """
    rows = spark.read.parquet(path)
    kind = rows.schema[id].dataType.simpleString()
    none = spark.createDataFrame([], f"`{id}` {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string")
    if not rows.take(1):
        return none
    own = home or fresh_path(spark, "dedup")
    state = digest_state(arriving(spark, path, rows.schema, batch_bytes), id, text, digest, f"{own}/hits", f"{own}/state")
    hits = written(state.where("n > 1"), "dedup-hits")
    if home is None:
        drop_path(spark, own)
    docs = _located(rows, id, text, digest)
    several = written(parted(docs, hits), "dedup-parted")
    groups = hits.select("digest", F.lit(None).cast("string").alias("sha"), "n", "at")
    if several.take(1):  # these go by the text's own SHA-256 as well
        groups = groups.join(several.select("digest").distinct(), "digest", "left_anti").union(several.select("digest", "sha", "n", "at"))
    groups = groups.select("digest", F.col("sha").alias("only"), "n", F.col("at").alias("stays"))
    narrow = docs.select("id", "at", "digest", F.sha2("text", 256).alias("sha"))
    found = spread(narrow, groups, "digest", "at", MOST_HITS, "left", F.col("only").isNull() | (F.col("only") == F.col("sha")))
    stays = F.coalesce("stays", "at")
    return found.select(F.col("id").alias(id), stays["id"].alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("at").eqNullSafe(stays).alias("kept"), F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir):
    """Every document with the row of its text that stays."""
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
