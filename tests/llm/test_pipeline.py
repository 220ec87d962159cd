import re

import corpus_pipeline as C
import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import quality_rules as Q
from tests.llm.test_minhash_dedup import brute

SF = "/root/testdata/sf0.001"


def normal(text):
    return " " + " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", text.lower()).split()) + " "


def plain(documents, benchmark):
    """The five stages in plain Python."""
    names = ", ".join(Q.MEASURES)
    measured = ", ".join(str((d, *Q._measure(t.encode(), len(t)))) for d, t in documents)
    bad = {d for (d,) in duckdb.sql(f"SELECT d FROM (VALUES {measured}) t(d, {names}) WHERE {' OR '.join(c for _, c in Q.RULES)}").fetchall()}
    rows = [(d, t) for d, t in documents if d not in bad]
    stays = {d for d, _, least in brute(rows, 5) if d == least}
    items = [normal(t) for t in benchmark if len(normal(t).split()) >= 8]
    rows = [(d, t) for d, t in rows if d in stays and not any(i in normal(t) for i in items)]
    rows = [(d, re.sub(r'((?i:token) = ")[0-9a-fA-F]{40}(?=")', r"\1[SECRET]", t)) for d, t in rows]
    library = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}


def test_pipeline_against_plain_python(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = C.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == plain(documents, benchmark)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_take_odd_and_empty_tables(spark, odd, nothing):
    assert [name for name, _ in C.STAGES] == ["quality rules", "near duplicates", "decontamination", "secrets", "encoding"]
    for table in (odd, nothing):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            assert out.count() <= table.count()
        assert C.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_clean_documents_pass_all_filters(spark, docs):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(80))) for k in range(20)]
    table = docs(rows)
    for _, stage in C.STAGES[:3]:
        table = stage(spark, table, SF)
    assert sorted(r.doc_id for r in table.select(F.col("doc_id")).collect()) == list(range(20))


def test_the_whole_run_on_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_the_whole_run_on_odd_rows(spark, odd, docs, tmp_path):
    good = " ".join(f"word{k}" for k in range(70))
    odd.unionByName(docs([(50, good), (51, good), (None, good + " more words")])).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in C.run(spark, str(tmp_path)).collect()] == [50]
