"""Token counts through a digest cache.

A count is stored under the digest of the content and the digest of the tokenizer's file. A run joins the digests
of its documents to the cache, encodes one text for each digest that is missing, appends those counts, and answers
from the cache. Content is normalised only where no count can change (null is the empty text).

A text whose digest no other row has is encoded where it is scanned. Rows that share a missing digest are written once with
a row number, and the least number of each digest is encoded; so nothing is encoded twice in a run, whatever repeats.

Defined cases: null and empty texts have 0 bytes and the library's count of the empty text; very long texts are encoded whole,
in blocks of words; repeated rows are encoded once and counted for each row; null doc_ids stay; an empty table gives no rows
and leaves the cache as it is; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.rows import few, join_unique, map_batches, need
from recordloom.llm.tokenizer import encoder, version_digest
from recordloom.session import Workspace

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return need(documents, "doc_id", "text").select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))


def stored(spark, cache: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer in the cache, one row a digest (two runs may have appended the same miss)."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version_digest(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _encode(texts: DataFrame, tokenizer: str) -> DataFrame:
    def batch(b):
        return {"digest": b.column("digest"), "n_tokens": encoder(tokenizer).counts(b.column("text").to_pylist())}

    return map_batches(texts, batch, T.StructType(CACHE_SCHEMA.fields[:2]))


def _missing(texts: DataFrame, slim: DataFrame, misses: DataFrame, ws: Workspace) -> DataFrame:
    """digest and text, one row for each digest of ``misses`` (digest, n: the rows that have it)."""
    once, shared = misses.where("n = 1").select("digest"), misses.where("n > 1").select("digest")
    n_once = once.count()
    others = ws.keep(slim.select("digest").distinct().join(once, "digest", "left_anti"), "others")
    n_others = others.count()
    lone = texts.join(few(once, n_once), "digest", "left_semi") if n_once <= n_others else texts.join(few(others, n_others), "digest", "left_anti")
    numbered = texts.join(few(shared), "digest", "left_semi").select("digest", "text", F.monotonically_increasing_id().alias("row"))
    numbered = ws.keep(numbered, "repeated")  # the numbers hold from here on
    chosen = numbered.join(few(numbered.groupBy("digest").agg(F.min("row").alias("row"))), ["digest", "row"], "left_semi")
    return lone.select("digest", "text").unionByName(chosen.select("digest", "text"))


def count(documents: DataFrame, tokenizer: str, cache: str, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, n_tokens of every row; the cache at ``cache`` gains what it missed.

    The rows' digests are written once. Texts are joined to the shorter of two lists, that of the digests to encode where
    they stand and that of all others; while that list is short it is sent to the texts.
    """
    spark = documents.sparkSession
    ws = workspace or Workspace(spark, "token-counts")
    texts = keyed(documents)
    slim = ws.keep(texts.drop("text"), "digests")
    copies = slim.groupBy("digest").agg(F.count("*").alias("n"))
    misses = ws.keep(copies.join(stored(spark, cache, tokenizer), "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        found = _encode(_missing(texts, slim, misses, ws), tokenizer)
        found.withColumn("tokenizer", F.lit(version_digest(tokenizer))).write.mode("append").parquet(cache)
        ws.drop("others")
        ws.drop("repeated")
    ws.drop("misses")
    return join_unique(slim, stored(spark, cache, tokenizer), "digest").select("doc_id", "n_bytes", "digest", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: token counts of every document. The labelled ones are counted first, by a run of their own, so that the run over
    all documents finds a part of its digests in the cache."""
    import public_tokenizers

    ws, tokenizer = Workspace(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    count(documents.join(few(labels), "doc_id", "left_semi"), tokenizer, ws.path("cache"))
    counts = count(documents, tokenizer, ws.path("cache"), ws)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
