"""WARC files of pages, written with revisits and read back by boundary chains.

Writing: of pages with equal payloads of at least ``REVISIT_BYTES``, the one with the largest page_id is stored, the others
refer to it. Tasks write the rows that they scan; the list of revisits alone is joined to them, broadcast while it has at most
``BROADCAST_ROWS`` rows and by a shuffle beyond. A file begins with a warcinfo record and is closed at ``FILE_BYTES``.

Reading: a file is cut into blocks, whatever they cut through. Each task reports every place of its block that looks like a
record, and where that record would end. A page may hold such a place in its text, so a place counts only if the chain of
ends leads to it from the start of the file; pointer jumping finds these in as many rounds as the number of records has
binary digits. A chain that misses the end of its file is an error, as is a payload that misses its digest. The places that
count are written as a table and dealt to tasks by the bytes of their records, at most ``TASK_BYTES`` to a task.

Files are plain (``.warc``) or one gzip member a record (``.warc.gz``), whose extra field ``sl`` tells the lengths.

Defined cases: a null html is an empty payload; a null url is written as ``about:blank`` and one with blanks or control
characters in its escaped form, each with the url as it was beside it, so that it is read back as it was; very long urls and
payloads are written and read whole; a null page_id is kept and never
referred to; rows that repeat a page_id and its payload are equal records, all stored or all revisits; an empty table gives no
file and no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordloom.llm import files
from recordloom.llm.rows import few, join_unique, need
from recordloom.session import Workspace

REVISIT_BYTES = 1000
BROADCAST_ROWS = 500_000
FILE_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20
#: A larger file's places are chained by joins over the cluster, others within one task for a file.
CHAIN_BYTES = 4 << 30
#: Read beyond a block for the head that begins in it; a longer one is read on.
HEAD_BYTES = 64 << 10
#: Bytes of files that a reading task takes, at most; small archives are dealt to ``TASKS_A_CORE`` tasks a core.
TASK_BYTES, TASKS_A_CORE = 256 << 20, 4

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An extension field: the url as JSON where its escaped form differs.
AS_WAS = "X-Page-URL"
_PLAIN = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,18})\r\n", re.IGNORECASE)


def _record(kind: str, record_id: str, date: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url or "about:blank")
    fields = [("WARC-Target-URI", uri), *([] if uri == url else [(AS_WAS, json.dumps(url))]), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", f"urn:page:{page_id}", date, http + payload, fields)
    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record("revisit", f"urn:page:{page_id}", date, http, fields)


def member(record: bytes) -> bytes:
    """A gzip member whose ``sl`` field holds its own and the record's length."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


# ---- writing


def _revisits(pages: DataFrame, ws: Workspace) -> DataFrame:
    slim = ws.keep(pages.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest"), "digests")
    stored = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    pairs = join_unique(slim, stored, "digest").where("refers_to IS NOT NULL").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return ws.keep(pairs.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")


def write(pages: DataFrame, folder: str, workspace: Workspace, date: str = "2024-01-01T00:00:00Z", compress: bool = False) -> list[tuple[str, int]]:
    """Writes a record for each row; returns the files' names and sizes, one row a file."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = need(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    revisits = _revisits(rows, workspace)
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    placed = rows.join(side, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "refers_to")
    files.make_dir(folder)
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        waiting = _records(batches, date)
        record = next(waiting, None)
        while record is not None:
            name, size = f"part-{part:05d}-{number:04d}{suffix}", 0
            with files.whole_file(f"{folder}/{name}") as out:
                info = _record("warcinfo", f"urn:file:{name}", date, b"format: WARC File Format 1.1\r\n", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")])
                while record is not None and size < FILE_BYTES:
                    for r in (info, record) if not size else (record,):
                        r = member(r) if compress else r
                        out.write(r)
                        size += len(r)
                    record = next(waiting, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})

    return sorted((r["name"], r["size"]) for r in placed.mapInArrow(run, "name string, size long").collect())


def _records(batches, date: str):
    for b in batches:
        html = b.column("html").cast(pa.large_binary()).to_pylist()
        rest = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
        for payload, page_id, url, digest, refers_to in zip(html, *rest, strict=True):
            yield page_record(page_id, url, payload, digest, refers_to, date)


# ---- reading


def _ends_plain(data: bytes, at: int) -> int | None:
    """Where the record that seems to begin at ``at`` ends; None if it has no whole head."""
    end = data.find(b"\r\n\r\n", at)
    found = _LENGTH.search(data, at, end + 2) if end >= 0 else None
    return end + 4 + int(found[1]) + 4 if found else None


def _ends_member(data: bytes, at: int) -> int | None:
    size = struct.unpack_from("<H", data, at + 10)[0] if len(data) >= at + 12 else 0
    extra = data[at + 12 : at + 12 + size]
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and n == 8 and len(extra) >= 12:
            return at + struct.unpack_from("<I", extra, 4)[0]
        extra = extra[4 + n :]
    return None


def places(uri: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(place, its end) of all that looks like a record beginning in the block."""
    data = files.read_range(uri, start, stop - start + HEAD_BYTES)
    gz = uri.endswith(".gz")
    looks, ends = (re.compile(rb"\x1f\x8b\x08\x04"), _ends_member) if gz else (_PLAIN, _ends_plain)
    begun = None if gz else max((m.start() for m in looks.finditer(data) if m.start() < stop - start), default=None)
    more = HEAD_BYTES
    while begun is not None and data.find(b"\r\n\r\n", begun) < 0:
        # the last head goes on beyond what was read
        further = files.read_range(uri, start + len(data), more)
        if not further:
            break
        data, more = data + further, 2 * more
    found = []
    for m in looks.finditer(data):
        if start + m.start() >= stop:
            break
        end = ends(data, m.start())
        if end is not None:
            found.append((start + m.start(), start + end))
    return found


def reachable(at: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Pointer jumping over the places of one file (sorted): which of them the chain from 0 meets."""
    n = len(at)
    if not n or at[0] != 0:
        raise ValueError("no record at the start of the file")
    jump = np.append(np.searchsorted(at, end), n)  # n stands for the end of the file
    hit = jump[:n] < n
    astray = np.zeros(n, bool)
    astray[hit] = at[jump[:n][hit]] != end[hit]
    astray[~hit] = end[~hit] != size
    lost = np.append(astray, False)
    jump[:n][astray] = n
    met = np.zeros(n + 1, bool)
    met[0] = True
    while True:
        before = met.sum()
        met[jump[met]] = True
        jump = jump[jump]
        if met.sum() == before:
            break
    if (met & lost).any():
        raise ValueError(f"the chain breaks at {int(end[np.flatnonzero(met & lost)[0]])}")
    return met[:n]


def reachable_wide(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """The same by joins, for files of any size: file, at of the places met, from edges (file, at, end)."""
    known = edges.select("file", F.col("at").alias("end"))
    jump = workspace.keep(edges.join(known, ["file", "end"], "left_semi").select("file", "at", "end"), "jump-0")
    met = workspace.keep(edges.where("at = 0").select("file", "at"), "met-0")
    step, seen = 0, -1
    while (now := met.count()) != seen:
        seen, step = now, step + 1
        met = workspace.keep(met.unionByName(met.join(jump, ["file", "at"]).select("file", F.col("end").alias("at"))).distinct(), f"met-{step}")
        onward = jump.select("file", F.col("at").alias("end"), F.col("end").alias("further"))
        jump = workspace.keep(jump.join(onward, ["file", "end"]).select("file", "at", F.col("further").alias("end")), f"jump-{step}")
    return met


def _tasks(spark: SparkSession, total: int, least: int = 1 << 20) -> int:
    """Tasks for so many bytes."""
    return max(1, -(-total // TASK_BYTES), min(TASKS_A_CORE * spark.sparkContext.defaultParallelism, total // least))


def boundaries(spark: SparkSession, folder: str, listed: list[tuple[str, int]], workspace: Workspace) -> DataFrame:
    """file (its number in ``listed``), at, end of every record of the files."""
    first = np.concatenate([[0], np.cumsum([-(-size // BLOCK_BYTES) for _, size in listed])]).astype(np.int64)
    held, block = spark.sparkContext.broadcast((listed, first)), BLOCK_BYTES

    def scan(batches):
        listed, first = held.value
        for b in batches:
            for i in b.column("id").to_pylist():
                k = int(np.searchsorted(first, i, side="right")) - 1
                start = (i - int(first[k])) * block
                found = places(f"{folder}/{listed[k][0]}", start, min(start + block, listed[k][1]))
                if start == 0 and (not found or found[0][0] != 0):
                    found.insert(0, (-1, -1))  # so that the file is chained, and refused
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array([a for a, _ in found], pa.int64()), pa.array([e for _, e in found], pa.int64())], names=["file", "at", "end"])

    schema = "file int, at long, end long"
    edges = spark.range(0, int(first[-1]), 1, _tasks(spark, sum(size for _, size in listed), block)).mapInArrow(scan, schema)
    wide = [k for k, (_, size) in enumerate(listed) if size > CHAIN_BYTES]

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        return group[reachable(group["at"].to_numpy(), group["end"].to_numpy(), held.value[0][int(group["file"][0])][1])]

    if not wide:
        return edges.groupBy("file").applyInPandas(chain, schema)
    edges = workspace.keep(edges, "places")
    near = edges.where(~F.col("file").isin(wide)).groupBy("file").applyInPandas(chain, schema)
    far = edges.where(F.col("file").isin(wide))
    met = far.join(reachable_wide(far, workspace), ["file", "at"], "left_semi").select("file", "at", "end")
    last = {r["file"]: r["last"] for r in met.groupBy("file").agg(F.max("end").alias("last")).collect()}
    for k in wide:
        if last.get(k) != listed[k][1]:
            raise ValueError(f"{listed[k][0]}: the chain breaks at {last.get(k, 0)}")
    return near.unionByName(met)


READ_SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())]
)


def parse(record: bytes) -> tuple | None:
    """A page's record as a row of ``READ_SCHEMA``; None for records that are not pages."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload misses its digest")
    number = lambda s: None if s is None or s.endswith(":None>") else int(s[1:-1].rpartition(":")[2])
    url = json.loads(fields[AS_WAS.lower()]) if AS_WAS.lower() in fields else fields["warc-target-uri"]
    return number(fields["warc-record-id"]), url, kind, digest, number(fields.get("warc-refers-to")), payload


def read(spark: SparkSession, folder: str, listed: list[tuple[str, int]], workspace: Workspace, with_payload: bool = True, batch: int = 500) -> DataFrame:
    """Every page's record: page_id, url, record_type, payload_digest, refers_to, and the payload or else its bytes.
    A revisit's payload is null; it is that of the record it refers to."""
    last = T.StructField("payload", T.BinaryType()) if with_payload else T.StructField("payload_bytes", T.LongType())
    schema = T.StructType([*READ_SCHEMA.fields[:-1], last])
    names = schema.fieldNames()

    arrow = to_arrow_schema(schema)
    files_held = spark.sparkContext.broadcast(listed)

    def runs(batches):
        """(file, start, end, records) of records that lie one after another, about a block at a time."""
        file, start, stop, held = None, 0, 0, []
        for b in batches:
            for k, at, end in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("end").to_pylist(), strict=True):
                if held and (k != file or at != stop or end - start > BLOCK_BYTES):
                    yield file, start, stop, held
                    held = []
                if not held:
                    file, start = k, at
                held.append((at, end))
                stop = end
        if held:
            yield file, start, stop, held

    def rows(batches):
        held = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], names=names)
        for k, start, stop, records in runs(batches):
            name = files_held.value[k][0]
            data = memoryview(files.read_range(f"{folder}/{name}", start, stop - start))
            for at, end in records:
                raw = bytes(data[at - start : end - start])
                row = parse(zlib.decompress(raw, 31) if name.endswith(".gz") else raw)
                if row is not None:
                    held.append(row if with_payload else (*row[:-1], None if row[-1] is None else len(row[-1])))
                if len(held) == batch:
                    yield flush()
                    held = []
        if held:
            yield flush()

    sizes = [size for _, size in listed]
    total = sum(sizes)
    tasks = _tasks(spark, total)
    found = workspace.keep(boundaries(spark, folder, listed, workspace), "boundaries")
    bases = spark.createDataFrame([(k, b) for k, b in enumerate(accumulate(sizes, initial=0)) if k < len(sizes)], "file int, base long")
    place = F.least(F.floor((F.col("base") + F.col("at")) / F.lit(max(1, total)) * tasks), F.lit(tasks - 1)).cast("int")
    dealt = found.join(few(bases, len(sizes)), "file").repartitionById(tasks, place).sortWithinPartitions("file", "at").select("file", "at", "end")
    return dealt.mapInArrow(rows, schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, where a revisit has the bytes of what it refers to."""
    stored = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.struct(F.col("page_id").alias("i"), F.col("payload_digest").alias("d")).alias("key")).agg(F.max("payload_bytes").alias("b"))
    back = join_unique(records.where("record_type = 'revisit'").withColumn("key", F.struct(F.col("refers_to").alias("i"), F.col("payload_digest").alias("d"))), stored, "key")
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*order).unionByName(back.withColumn("payload_bytes", F.col("b")).select(*order))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: writes every page and reads the archives back."""
    ws = Workspace(spark, "warc")
    folder = ws.path("archives")
    listed = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, ws)
    records = ws.keep(read(spark, folder, listed, ws, with_payload=False), "records")
    return resolved(records)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""
