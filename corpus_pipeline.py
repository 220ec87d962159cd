"""Corpus preparation: five stages over documents, each one operator of the training-data package.

Each stage works on all that the one before kept and is written to the shared folder before the next one reads it, so a
lost executor costs the running stage at most.

Defined cases of all stages: a null or empty text is a document without words (the first stage rejects it); very long texts are
taken whole; null and repeated doc_ids are judged row by row, by their texts; an empty table stays empty; further columns are
kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.llm import bpe, decontamination, minhash_dedup, quality_rules, secret_scan
from recordloom.session import Workspace

#: A file of ``public_tokenizers``.
TOKENIZER = "byte_bpe_50k.json"


def quality(spark, docs, sf_dir):
    """Rejects the documents that fail a rule of the strict policy (its first version, that of operator 1's query), by the stored
    ledger."""
    return quality_rules.keep(docs, quality_rules.policy("strict", 1))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays: the one with the least doc_id. Shingles of five words, similarity 0.8 or more."""
    return minhash_dedup.keep(docs, width=5, percent=80)


def decontaminate(spark, docs, sf_dir):
    """Rejects the documents that hold a benchmark item."""
    return decontamination.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts; n_chars follows."""
    found = secret_scan.redact(docs, secret_scan.default_model(spark))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("encoding", encode)]

#: No SQL gives near-duplicate components, edit distances, a forest or token ids; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents."""
    workspace = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = workspace.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            workspace.drop(f"stage-{k - 1}")
    return docs
