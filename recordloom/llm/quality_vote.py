"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

A text becomes a vector of term weights: pairs of neighbouring byte classes (letters, capitals, digits, blanks, line
breaks, each ASCII sign, other bytes), hashed words, and pairs of words by how often they come again (twice, three times or more, five or more, ...), each in proportion to the number of
words, on a log scale, times an inverse document frequency. A truncated singular value decomposition of the labelled sample gives
the latent space. Every document is then multiplied, in blocks, with all labelled vectors; the nearest ones vote
with their label, weighted by a power of the cosine.

The sample is at most ``SAMPLE`` labelled rows (those with the least hash of doc_id among the rows not held out), so what
is fitted on the driver and what is sent to each task are of a fixed size: ``SAMPLE`` x ``RANK`` and terms x ``RANK`` floats.
No label, language, source or id enters a vector.

Defined cases: very long texts are scored whole; a null or empty text, or one that is like no labelled document, has score 0; without any label every score is 0;
a document with several labels counts with the greatest; null labels are none; repeated rows give repeated rows; ties
between neighbours fall to the earlier one of the sample, which is ordered by doc_id; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.rows import as_bytes, map_batches, need
from recordloom.session import spread

#: Labelled rows to fit on, at most.
SAMPLE = 4000
RANK = 64
NEIGHBOURS = 9
POWER = 8
WORD_TERMS, AGAIN_TERMS = 1024, 8
BLOCK = 512


def _byte_classes() -> tuple[np.ndarray, int]:
    classes, signs = np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            classes[b] = 6
        elif c.isalpha():
            classes[b] = 1 if c.islower() else 2
        elif c.isdigit():
            classes[b] = 3
        elif c in " \t":
            classes[b] = 4
        elif c in "\r\n":
            classes[b] = 5
        elif c.isprintable():
            classes[b], signs = signs, signs + 1
    return classes, signs


_CLASS, _CLASSES = _byte_classes()
TERMS = _CLASSES * _CLASSES + WORD_TERMS + AGAIN_TERMS


def terms(text: bytes | None) -> np.ndarray:
    """Term counts in proportion to the words of the whole text, on a log scale."""
    out = np.zeros(TERMS, np.float32)
    words = (text or b"").lower().split()
    if not words:
        return out
    n = len(words)
    classes = _CLASS[np.frombuffer(text, np.uint8)]
    pairs = _CLASSES * _CLASSES
    if len(classes) > 1:
        out[:pairs] = np.bincount(classes[:-1] * _CLASSES + classes[1:], minlength=pairs) / n
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    out[pairs : pairs + WORD_TERMS] = np.bincount(hashes % WORD_TERMS, minlength=WORD_TERMS) / n
    follow = hashes[:-1] * 0x9E3779B1 + hashes[1:]
    _, counts = np.unique(follow, return_counts=True)
    often = np.minimum(np.log2(2 * counts - 1).astype(np.int64), AGAIN_TERMS - 1)
    out[pairs + WORD_TERMS :] = np.bincount(often, weights=counts, minlength=AGAIN_TERMS) / n
    return np.log1p(20 * out)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.weights = (np.log((1 + len(sample)) / (1 + (sample > 0).sum(axis=0))) + 1).astype(np.float32)
        rows = _unit(sample * self.weights)
        self.axes = _right_vectors(rows, min(RANK, *rows.shape))
        self.vectors = _unit(rows @ self.axes)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        k = min(NEIGHBOURS, len(self.labels))
        out = []
        for at in range(0, len(rows), BLOCK):
            cosine = _unit(_unit(rows[at : at + BLOCK] * self.weights) @ self.axes) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** POWER
            out.append((weight * self.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9))
        return np.clip(np.concatenate(out), 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row; of equals at the border the earliest."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    border = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    for r in np.flatnonzero((cosine >= border).sum(axis=1) > k):
        above = np.flatnonzero(cosine[r] > border[r])
        near[r] = np.concatenate([above, np.flatnonzero(cosine[r] == border[r])[: k - len(above)]])
    return near


def _right_vectors(rows: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed random start."""
    span = np.random.default_rng(11).standard_normal((rows.shape[1], min(rank + 16, *rows.shape))).astype(np.float32)
    for _ in range(rounds):
        span = np.linalg.qr(rows.T @ (rows @ span))[0]
    _, _, vt = np.linalg.svd(rows @ span, full_matrices=False)
    return np.ascontiguousarray((span @ vt.T)[:, :rank], np.float32)


def held_out() -> Column:
    """Whether a document is never learnt from; one without an id is not held out, but has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model from at most ``SAMPLE`` labelled documents that are not held out; None without any."""
    known = need(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = need(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def batch(b):
        return {"doc_id": b.column("doc_id"), "quality": b.column("quality"), "terms": [terms(t).tobytes() for t in as_bytes(b, "text")]}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("terms", T.BinaryType())])
    vectors = map_batches(texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), batch, schema)
    rows = vectors.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("quality").alias("quality")).orderBy("doc_id").collect()
    if not rows:
        return None
    return Model(np.stack([np.frombuffer(r["terms"], np.float32) for r in rows]), np.array([r["quality"] for r in rows]))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every whole text; a narrow pass over the documents."""
    if model is None:
        return need(documents, "doc_id").select("doc_id", F.lit(0.0).alias("score"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def batch(b):
        texts, out = as_bytes(b, "text"), []
        for at in range(0, len(texts), BLOCK):
            out += held.value.scores(np.stack([terms(t) for t in texts[at : at + BLOCK]])).tolist()
        return {"doc_id": b.column("doc_id"), "score": out}

    return map_batches(need(documents, "doc_id", "text"), batch, SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: scores of every document."""
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
