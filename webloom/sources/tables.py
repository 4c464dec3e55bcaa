"""Tables the engine works on, as DataFrames with explicit columns."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url, url_key


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_store(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_index, page_key, url, html): the URL canonical, pages with a refused URL left out."""
    p = pages.select(F.col("page_id").alias("page_index"), canonical_url(F.col("url")).alias("url"), "html").where("url is not null")
    return p.select("page_index", url_key(F.col("url")).alias("page_key"), "url", "html")


def document_store(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, source) -> page records whose body is the text and whose host is the source."""
    url = F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/"), F.col("doc_id").cast("string"))
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    d = documents.select(F.col("doc_id").alias("page_index"), url.alias("url"), F.concat(F.lit("<body>"), body, F.lit("</body>")).alias("html"))
    return d.select("page_index", url_key(F.col("url")).alias("page_key"), "url", "html")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of URLs, one on a line, 4095 characters of each at most; empty lines are left out."""
    return spark.read.text(path).select(F.substring("value", 1, 4095).alias("url")).where("url <> ''")


def append_url_list(urls: DataFrame, path: str) -> None:
    urls.select("url").write.mode("append").text(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; in local mode one of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read from there: what follows, even if it reads it several times, doesn't make it again. removed() deletes it."""
    df.write.mode("overwrite").option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def version(df: DataFrame) -> str:
    """What df's files are now: their names, sizes and times, as a digest."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        st = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name} {st.getLen()} {st.getModificationTime()}")
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
