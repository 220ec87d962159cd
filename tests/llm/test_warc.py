import hashlib

import numpy as np
import pytest

from recordloom.llm import warc as W
from recordloom.session import Workspace

TRAP = W._record("response", "urn:page:99", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\nfake", [("WARC-Target-URI", "x"), ("WARC-Payload-Digest", "sha1:AA")])


def table(spark):
    long = "same " * 400
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", TRAP.decode() * 3 + "é"), (7, "u", TRAP.decode() * 3 + "é"), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("block", [64 << 20, 333])
def test_round_trip(spark, compress, block, monkeypatch):
    rows, pages = table(spark)
    monkeypatch.setattr(W, "BLOCK_BYTES", block)
    ws = Workspace(spark, "warc-test")
    listed = W.write(pages, ws.path("w"), ws, compress=compress)
    got = W.read(spark, ws.path("w"), listed, ws).collect()
    top = 3
    want = sorted((str(i), "revisit" if h and len(h) > 1500 and h.startswith("same") and i != top else "response", hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r.page_id), r.record_type, r.payload_digest) for r in got) == want
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {3}
    assert all(bytes(r.payload) in {(h or "").encode() for _, _, h in rows} for r in got if r.payload is not None)


def test_wide_chains_are_the_same(spark, monkeypatch):
    _, pages = table(spark)
    ws = Workspace(spark, "warc-wide")
    listed = W.write(pages, ws.path("w"), ws)
    near = sorted(map(tuple, W.boundaries(spark, ws.path("w"), listed, ws).collect()))
    monkeypatch.setattr(W, "CHAIN_BYTES", 0)
    assert sorted(map(tuple, W.boundaries(spark, ws.path("w"), listed, ws).collect())) == near


def test_long_heads_are_read(spark, monkeypatch):
    url = "data:" + "x" * 200_000
    pages = spark.createDataFrame([(1, url, "a"), (2, "http://b", "b")], "page_id long, url string, html string").repartition(1)
    for block in (64 << 20, 50_000):
        monkeypatch.setattr(W, "BLOCK_BYTES", block)
        ws = Workspace(spark, "warc-head")
        got = W.read(spark, ws.path("w"), W.write(pages, ws.path("w"), ws), ws).collect()
        assert sorted((r.page_id, r.url) for r in got) == [(1, url), (2, "http://b")]


def test_broken_and_strange_files_are_refused_on_both_paths(spark, monkeypatch, tmp_path):
    import gzip

    record = W.page_record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None, "d")
    files = {"a.warc": record + b"junk" + record, "b.warc.gz": gzip.compress(record)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for most in (4 << 30, 0):
        monkeypatch.setattr(W, "CHAIN_BYTES", most)
        for name, data in files.items():
            with pytest.raises(Exception, match="the chain breaks|no record at the start"):
                W.boundaries(spark, str(tmp_path), [(name, len(data))], Workspace(spark, "warc-bad")).collect()


def test_pointer_jumping():
    at, end = np.array([0, 4, 10, 12, 20]), np.array([10, 9, 20, 99, 30])
    assert W.reachable(at, end, 30).tolist() == [True, False, True, False, True]
    with pytest.raises(ValueError):
        W.reachable(at, end, 31)
    with pytest.raises(ValueError):
        W.reachable(at[1:], end[1:], 30)


def test_damage_is_noticed():
    record = W.page_record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None, "d")
    assert W.parse(record)[5] == b"payload"
    with pytest.raises(ValueError):
        W.parse(record.replace(b"payload\r\n", b"Payload\r\n"))


def test_empty(spark):
    ws = Workspace(spark, "warc-none")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    listed = W.write(pages, ws.path("w"), ws)
    assert listed == [] and W.read(spark, ws.path("w"), listed, ws).count() == 0


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/ b", " \u00a0http://x\u2028", "http://b\tc\r\nEvil: 1", None, "", "about:blank", "http://plain/é", "x" * 200_000 + " y"]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(2)
    ws = Workspace(spark, "warc-urls")
    got = {r.page_id: r.url for r in W.read(spark, ws.path("w"), W.write(pages, ws.path("w"), ws), ws).collect()}
    assert got == dict(enumerate(urls))


def test_records_are_dealt_by_bytes(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"{k} " * 20_000) for k in range(60)], "page_id long, url string, html string").repartition(2)
    ws = Workspace(spark, "warc-dealt")
    listed = W.write(pages, ws.path("w"), ws)
    for task, most in ((256 << 20, 4 * spark.sparkContext.defaultParallelism), (200_000, -(-sum(n for _, n in listed) // 200_000))):
        monkeypatch.setattr(W, "TASK_BYTES", task)
        df = W.read(spark, ws.path("w"), listed, ws)
        assert df.count() == 60
        assert 1 < df.rdd.getNumPartitions() <= most
