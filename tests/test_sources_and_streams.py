import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators.lifecycle import merge_chunks
from recordloom.sources import files, pdf
from recordloom.sources.store import Store, write_timeline
from recordloom.streaming import watch


@pytest.fixture
def folder(tmp_path):
    for name, content in {
        "a.txt": "plain", "sub/b.html": "<p>web &amp; page</p>", "sub/c.yml": "source: x", "b.TXT": "upper", ".DS_Store": "x", "_FAILED/d.txt": "x", "_Skipped/e.txt": "x", "bin.pdf": "%PDF",
    }.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    (tmp_path / "in" / "latin.txt").write_bytes(b"caf\xe9")
    return str(tmp_path / "in")


def test_incoming_files(spark, folder):
    got = {r.path.rpartition("/in/")[2] for r in files.find(spark, folder).collect()}
    assert got == {"a.txt", "sub/b.html", "b.TXT", "bin.pdf", "latin.txt"}
    pages = {r.path.rpartition("/")[2]: r.pages for r in files.documents(spark, folder).collect()}
    assert pages["b.html"][0].markdown == "web & page" and pages["a.txt"][0].markdown == "plain" and pages["bin.pdf"] is None and pages["latin.txt"][0].markdown == "caf\ufffd"


def test_converter_failures_are_rows(spark, folder):
    def converter(content, kind):
        if kind == "pdf":
            raise ValueError("no engine")
        return [content.decode("latin-1"), "  "]

    got = {r.error: r.pages for r in files.convert(files.documents(spark, folder), converter).collect()}
    assert got["no engine"] is None and len(got[None]) == 1


def test_json_readers(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text(json.dumps({"sha256": "s", "page_count": 0, "pages": [{"page": 1, "markdown": "12345678"}]}))
    (tmp_path / "q" / "2.json").write_text("{broken")
    from recordloom.operators.lifecycle import queue_view

    assert [(r.sha256, r.page_count, r.est_tokens) for r in queue_view(files.queue(spark, str(tmp_path / "q"))).collect()] == [("s", 1, 2)]
    (tmp_path / "r.json").write_text(json.dumps({"a": {"name": "A"}, "b": {"name": "B"}}))
    assert sorted((r.key, r.entry.name) for r in files.registry(spark, str(tmp_path / "r.json"), "struct<name:string>").collect()) == [("a", "A"), ("b", "B")]
    (tmp_path / "bad.json").write_text("nope")
    assert files.registry(spark, str(tmp_path / "bad.json"), "struct<name:string>").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "2020_abcdef1.ndjson").write_text('{"a":1}\n\n{"a":2}\n')
    (tmp_path / "t" / "2020-01.ndjson").write_text('{"a":3}\n')
    assert sorted((r.date, r.staged) for r in files.timeline(spark, str(tmp_path / "t")).collect()) == [("2020", True), ("2020", True), ("2020-01", False)]
    (tmp_path / "log.jsonl").write_text('{"agent":"x","message":{"role":"assistant","model":"m","usage":{"input_tokens":3,"output_tokens":5}}}\n\nbroken\n{"message":{"role":"user"}}\n')
    usage = files.session_log(spark, str(tmp_path / "log.jsonl")).where("tokens > 0").collect()
    assert sorted((r.agent, r.kind, r.tokens) for r in usage) == [("x", "input", 3), ("x", "output", 5)]


def test_section_files_and_skills(spark, tmp_path):
    (tmp_path / "section_ex_s_002.json").write_text(json.dumps({"document": {"sha256": "s"}, "entities": []}))
    assert files.extractions(spark, str(tmp_path / "section_ex_*.json")).first().section == 2
    for n in ("b.md", "a.md", "_template.md"):
        (tmp_path / n).write_text(n)
    rows = files.skills(spark, str(tmp_path))
    assert sorted(r.name for r in rows.collect()) == ["a", "b"]
    assert len(files.skills_digest(rows).first().digest) == 16


def test_store_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ddl = "id long, v string"
    assert store.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], ddl), "id") == 1
    assert store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], ddl), "id") == 2
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.append("log", spark.createDataFrame([(1, "x")], ddl))
    store.append("log", spark.createDataFrame([(2, "y")], ddl))
    assert spark.read.parquet(f"{store.root}/log").count() == 2


def test_a_table_that_changes_leaves_the_others(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(9, "z")], "id long, v string")
    store.commit(a=a, b=b)
    assert store.upsert("a", spark.createDataFrame([(1, "new")], "id long, v string"), "id") == 2
    assert store.read("b").first().v == "z" and store.read("a").first().v == "new" and store.has("b") and not store.has("c")
    store.commit(b=a)
    assert store.read("a").first().v == "new" and store.read("b").first().v == "a"


def test_older_rows_do_not_replace_newer_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sink = watch.upsert_sink(store, "t", "id", ["at"])
    ddl = "id long, at long, v string"
    for number, rows in enumerate(([(1, 5, "five")], [(1, 3, "three"), (2, 1, "one")], [(1, 5, "five")])):
        sink(spark.createDataFrame(rows, ddl), number)
    assert sorted((r.id, r.v) for r in store.read("t").collect()) == [(1, "five"), (2, "one")]


def test_timeline_files_are_of_a_date_and_a_document(spark, tmp_path):
    out, ddl = str(tmp_path / "t"), "sha256 string, date string, event string"
    for rows in ([("s1", "2020", "a"), ("s1", "2021", "b")], [("s2", "2020", "c")], [("s1", "2020", "d")]):
        write_timeline(spark.createDataFrame(rows, ddl), out)
    assert sorted(r.event for r in spark.read.json(out).collect()) == ["b", "c", "d"]


def test_watching_takes_each_file_once(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seen = []

    def sink(batch, number):
        seen.append(batch.count())
        watch.upsert_sink(store, "queue", "sha256", ["path"])(batch, number)

    run = lambda: watch.watch(spark, folder, str(tmp_path / "cp"), sink, every=None).awaitTermination()
    run()
    first = sum(seen)
    with open(f"{folder}/new.txt", "w") as f:
        f.write("   ")
    run()
    assert sum(seen) == first + 1
    queue = {r.path.rpartition("/in/")[2]: (r.state, r.error) for r in store.read("queue").collect()}
    assert set(queue) == {"a.txt", "sub/b.html", "b.TXT", "bin.pdf", "latin.txt", "new.txt"}
    assert queue["new.txt"] == ("SKIPPED", None) and queue["bin.pdf"] == ("FAILED", "needs a converter")


def test_windows_with_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 4.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = watch.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


class Engine:
    """Texts whose pages are parted by form feeds; a first byte of X needs a repair."""

    def page_count(self, content):
        if content[:1] in (b"X", b"Y"):
            raise ValueError("damaged")
        return content.count(b"\x0c") + 1

    def text(self, content, first, last):
        return "\n".join(content.decode().split("\x0c")[first - 1 : last])

    def repair(self, content):
        return content[1:] if content[:1] == b"X" else content


def test_pdf_files_by_an_engine(spark):
    content = {"a": b"\x0c".join(b"page %d" % k for k in range(1, 91)), "b": b"Xone", "c": b"Yone"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "sha256 string, content binary")
    seen = {r.sha256: (r.page_count, r.sample, r.repaired, r.error) for r in pdf.inspect(df, Engine()).collect()}
    assert seen == {"a": (90, "page 1\npage 2\npage 3", False, None), "b": (1, "one", True, None), "c": (None, None, True, "damaged")}
    merged = merge_chunks(pdf.chunks(df.where("sha256 = 'a'"), pdf.inspect(df, Engine()), Engine())).first()
    assert [(p.page, p.markdown) for p in merged.pages] == [(k, f"page {k}") for k in range(1, 91)] and not merged.failed_chunks
