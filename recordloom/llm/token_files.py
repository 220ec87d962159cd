"""Token ids in flat binary files.

Format of a folder: ``index.json`` (item type, end id, and for each shard its documents, how many of these have no id, ids and
base), and for each shard ``NNNNN.ids`` (little-endian unsigned 16- or 32-bit ids, nothing else), ``NNNNN.off`` (signed 64-bit offsets
of the documents within the shard, one more than documents) and ``NNNNN.doc`` (signed 64-bit doc_ids). Shards follow
doc_id order; a document's place among all ids is the shard's base, a prefix sum over the shards, plus its offset.

A shard has at most about ``SHARD_BYTES`` of text; smaller tables are dealt to ``SHARDS_A_CORE`` shards a core.

Defined cases: a null or empty text is the end id alone; null doc_ids sort first, and the index tells how many there are, so
that every 64-bit integer is an id; repeated doc_ids stay and are ordered by text; very long texts are encoded whole; an empty
table gives an index without shards; further columns of the table are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm import files
from recordloom.llm.chunks import blocks
from recordloom.llm.rows import need, slices
from recordloom.llm.tokenizer import encoder
from recordloom.session import Workspace

SHARD_BYTES, SHARDS_A_CORE, LEAST_BYTES = 256 << 20, 4, 1 << 20
#: Ids that a reader holds at a time where the folder is not mounted.
READ_IDS = 4 << 20
_SHARD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("nulls", T.LongType()), T.StructField("ids", T.LongType())])
READ_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write(documents: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None) -> dict:
    """Encodes every whole text and writes the folder; returns the index. Text is shuffled once, by ranges of
    doc_id; each task streams its documents to its own shard. The driver sees one row for each shard."""
    n = shards or shards_for(documents)
    files.make_dir(folder)

    def shard(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        part, offsets, ids, nulls = TaskContext.get().partitionId(), array("q", [0]), array("q"), 0
        name = f"{folder}/{part:05d}"
        with files.whole_file(f"{name}.ids") as out:
            for b in slices(batches):
                texts = [t or "" for t in b.column("text").to_pylist()]
                nulls += b.column("doc_id").null_count
                ids.extend(0 if i is None else i for i in b.column("doc_id").to_pylist())
                for lo, hi in blocks(texts):
                    for packed in enc.packed(texts[lo:hi]):
                        out.write(packed + end)
                        offsets.append(offsets[-1] + len(packed) // enc.dtype.itemsize + 1)
        for suffix, values in ((".off", offsets), (".doc", ids)):
            with files.whole_file(name + suffix) as out:
                out.write(np.frombuffer(values, np.int64).astype("<i8", copy=False).tobytes() if values else b"")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "docs": [len(ids)], "nulls": [nulls], "ids": [offsets[-1]]})

    placed = need(documents, "doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(tuple(r) for r in placed.mapInArrow(shard, _SHARD).collect())
    bases = [0, *accumulate(ids for *_, ids in done)]
    index = {
        "dtype": encoder(tokenizer).dtype.str,
        "end_id": end_id,
        "ids": bases[-1],
        "shards": [{"shard": s, "docs": d, "nulls": z, "ids": i, "base": b} for (s, d, z, i), b in zip(done, bases, strict=False) if d],
    }
    with files.whole_file(f"{folder}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def shards_for(documents: DataFrame) -> int:
    """The number of shards, from the bytes of the texts and the cores."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // SHARD_BYTES), min(SHARDS_A_CORE * cores, size // LEAST_BYTES))


def load_index(folder: str) -> dict:
    fs, path = files.resolve(f"{folder}/index.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def documents_of(folder: str, shard: dict, dtype: str):
    """(doc_id, place among all ids, ids) of each document of a shard, from the mapped files."""
    name = f"{folder}/{shard['shard']:05d}"
    offsets, docs = files.mapped(f"{name}.off", np.dtype("<i8")), files.mapped(f"{name}.doc", np.dtype("<i8"))
    size = np.dtype(dtype).itemsize
    if len(docs) != shard["docs"] or len(offsets) != shard["docs"] + 1 or files.size(f"{name}.ids") != shard["ids"] * size or offsets[-1] != shard["ids"]:
        raise ValueError(f"{name}: its files disagree with the index")
    lo = 0
    while lo < len(docs):
        # so many documents as hold ``READ_IDS`` ids, one at least; where the folder is mounted they are only mapped
        hi = len(docs) if files.mounted(folder) else max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_IDS, side="right")) - 1)
        first = int(offsets[lo])
        ids = files.mapped(f"{name}.ids", np.dtype(dtype)) if files.mounted(folder) else np.frombuffer(files.read_range(f"{name}.ids", first * size, (int(offsets[hi]) - first) * size), dtype)
        begin = 0 if files.mounted(folder) else first
        for k in range(lo, hi):
            at = int(offsets[k])
            yield (None if k < shard["nulls"] else int(docs[k])), shard["base"] + at, ids[at - begin : int(offsets[k + 1]) - begin]
        lo = hi


def read(spark: SparkSession, folder: str, batch: int = 5000) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, crc32 of its ids as 32-bit integers."""
    index = load_index(folder)
    shards, dtype = index["shards"], index["dtype"]

    def rows(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                held: list[tuple] = []
                for doc, start, ids in documents_of(folder, shards[k], dtype):
                    held.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == batch:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(rows, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=READ_SCHEMA.fieldNames())


def query(spark, sf_dir: str) -> DataFrame:
    """op3: writes every document's ids with the end id 2 and reads the files back."""
    import public_tokenizers

    folder = Workspace(spark, "token-files").path("ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder, 2)
    return read(spark, folder)
