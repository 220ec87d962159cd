"""Vectors: normalising, exact top-k in blocks, nearest-label classification, an index keyed by document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one block holds; a longer set of queries takes several passes over the rows.
QUERY_BLOCK = 2_000


def normalized(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, place: the k rows with the greatest dot product for each query; ties go to the lesser key.

    Queries are a stated set; they are taken in blocks of bounded size, each sent to the tasks, which keep their own best k of
    every query, so that only k rows a query and task are shuffled.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    best = None
    asked = [(r[0], np.array(r[1], np.float64)) for r in queries.select(key, vector).toLocalIterator() if r[1] is not None]
    for at in range(0, len(asked), QUERY_BLOCK):
        block = asked[at : at + QUERY_BLOCK]
        held = spark.sparkContext.broadcast(([q for q, _ in block], np.stack([v for _, v in block])))

        def scan(batches, held=held):
            ids, matrix = held.value
            keys, scores = [], []
            for batch in batches:
                batch = batch[batch[vector].notna()]
                if len(batch):
                    got = np.stack(batch[vector].to_numpy()).astype(np.float64) @ matrix.T
                    keys.append(batch[key].to_numpy())
                    scores.append(got)
                    if sum(map(len, keys)) > 8 * k + 4096:
                        keys, scores = _best(keys, scores, k)
            if keys:
                keys, scores = _best(keys, scores, k)
                for j, q in enumerate(ids):
                    order = np.lexsort((keys[0], -scores[0][:, j]))[:k]
                    yield pd.DataFrame({"query_id": q, key: keys[0][order], "score": scores[0][order, j]})

        part = rows.select(key, vector).mapInPandas(scan, f"query_id {kind}, {key} {kind}, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], f"query_id {kind}, {key} {kind}, score double, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return best.withColumn("place", place).where(F.col("place") <= k)


def _best(keys: list, scores: list, k: int) -> tuple[list, list]:
    """The rows that are among the best k of any query."""
    keys, scores = np.concatenate(keys), np.concatenate(scores)
    wanted = set()
    for j in range(scores.shape[1]):
        wanted.update(np.lexsort((keys, -scores[:, j]))[:k].tolist())
    at = np.array(sorted(wanted))
    return [keys[at]], [scores[at]]


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, vector: normalised mean of each label's vectors."""
    each = rows.select(label, F.posexplode(vector).alias("at", "x"))
    mean = each.groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    made = mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return made.select(F.col(label).alias("label"), normalized(F.col("mean")).alias("vector"))


def classify(pages: DataFrame, labels: DataFrame, threshold: float = 0.65, first_pages: int = 10, key: str = "key", block: int = 10_000) -> DataFrame:
    """key, label, score: the label with the greatest cosine over a document's first pages (key, page, vector), null below
    the threshold; ties go to the first label. Labels (label, vector) are taken in blocks, which each task holds; a page
    leaves its task with its best label of a block alone."""
    kind, of = pages.schema[key].dataType.simpleString(), labels.schema["label"].dataType.simpleString()
    rows, each = pages.where(F.col("page") <= first_pages).select(key, "vector"), None
    for names, matrix in _label_blocks(labels, block):
        held = pages.sparkSession.sparkContext.broadcast((names, matrix))

        def best(batches, held=held):
            names, matrix = held.value
            for batch in batches:
                batch = batch[batch["vector"].notna()]
                if len(batch):
                    scores = np.stack(batch["vector"].to_numpy()).astype(np.float64) @ matrix.T
                    top = scores.argmax(axis=1)
                    yield pd.DataFrame({key: batch[key].to_numpy(), "label": [names[t] for t in top], "score": scores[np.arange(len(top)), top]})

        part = rows.mapInPandas(best, f"{key} {kind}, label {of}, score double")
        each = part if each is None else each.unionByName(part)
    if each is None:
        return pages.select(key).distinct().select(key, F.lit(None).cast(of).alias("label"), F.lit(None).cast("double").alias("score"))
    top = each.groupBy(key).agg(F.max("score").alias("best"), F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("label"))
    return top.select(key, F.when(F.col("best") >= threshold, F.col("label")).alias("label"), F.col("best").alias("score"))


def _label_blocks(labels: DataFrame, block: int):
    """(labels, their vectors as a matrix) for each ``block`` labels, in the labels' order."""
    held: list = []
    for r in labels.select("label", "vector").where("vector IS NOT NULL").orderBy("label").toLocalIterator():
        held.append((r["label"], r["vector"]))
        if len(held) == block:
            yield [n for n, _ in held], np.array([v for _, v in held], np.float64)
            held = []
    if held:
        yield [n for n, _ in held], np.array([v for _, v in held], np.float64)


def embed(rows: DataFrame, embedder, key: str = "key", text: str = "text", model: str = "", cache: DataFrame | None = None) -> DataFrame:
    """key, digest, vector of every text through ``embedder(list of texts) -> array``, normalised. Vectors are kept under the digest
    of model and text: those of ``cache`` (digest, vector) are taken from it, and equal texts are embedded once."""
    digest = F.sha2(F.concat(F.lit(model), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256)
    named = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("digest"))
    missing = named.dropDuplicates(["digest"]) if cache is None else named.dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")

    def run(batches):
        for batch in batches:
            made = np.asarray(embedder(batch["text"].tolist()), np.float64).reshape(len(batch), -1)
            made = made / np.where((norm := np.linalg.norm(made, axis=1, keepdims=True)) == 0, 1, norm)
            yield pd.DataFrame({"digest": batch["digest"], "vector": list(made)})

    found = missing.select("digest", "text").mapInPandas(run, "digest string, vector array<double>")
    found = found if cache is None else found.unionByName(cache.select("digest", F.col("vector").cast("array<double>").alias("vector")))
    return named.select("key", "digest").join(found, "digest").select("key", "digest", "vector")


def upsert_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with all rows of the given keys replaced."""
    return index.join(rows.select("kind", "key").distinct(), ["kind", "key"], "left_anti").unionByName(rows)


def index_stats(index: DataFrame) -> DataFrame:
    """kind, n; rows without a kind are pages."""
    return index.groupBy(F.coalesce("kind", F.lit("page")).alias("kind")).agg(F.count("*").alias("n"))
