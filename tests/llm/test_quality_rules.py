import random
import re

import duckdb
import pytest

from recordloom.llm import quality_rules as Q
from recordloom.session import Workspace


def flat(table):
    return [(r.doc_id, *r[Q.LEDGER]) for r in table.collect()]


def model(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts(n):
    rng = random.Random(4)
    parts = ["a", "b", "é", "日", "A", "<x>", "#", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "the cat sat "]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(120)))) for k in range(n)]


def test_measures_agree_with_a_plain_model(spark, docs):
    rows = texts(80)
    got = {r.doc_id: r[Q.LEDGER] for r in Q.ledger(docs(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == model(t), t


def test_bits_are_those_of_the_rules_by_another_engine(docs):
    rows = [tuple(r) for r in Q.ledger(docs(texts(80))).select("__ledger.*").collect()]
    names = ", ".join([*Q.MEASURES, "fail_bits"])
    fails = " + ".join(f"(CASE WHEN {c} THEN {1 << Q.BIT[r]} ELSE 0 END)" for r, c in Q.RULES)
    values = ", ".join(map(str, rows))
    assert duckdb.sql(f"SELECT count(*) FILTER (WHERE fail_bits <> {fails}), max(fail_bits) > 0 FROM (VALUES {values}) t({names})").fetchall() == [(0, True)]


def test_odd_rows(spark, odd, nothing):
    rows = Q.ledger(odd).collect()
    assert len(rows) == odd.count()
    assert [r[Q.LEDGER].fail_bits for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert Q.ledger(nothing).count() == 0 and Q.keep(nothing).count() == 0
    assert Q.keep(odd).columns == odd.columns
    clash = odd.withColumnRenamed("n", "n_words").withColumnRenamed("cls", "fail_bits")
    assert Q.keep(clash, Q.policy("strict", 2)).columns == clash.columns
    assert sorted(str(r.doc_id) for r in Q.keep(clash, Q.policy("base")).collect()) == sorted(str(r.doc_id) for r in Q.keep(odd, Q.BASE).collect())
    zero = Q.stored(nothing, Workspace(spark, "none"))
    assert sorted(map(tuple, Q.ablation(zero, Q.STRICT).collect())) == sorted((r, 0, 0, 0) for r in Q.BIT)
    assert {tuple(r) for r in Q.report(zero).collect()} == {(p.name, p.version, 0, 0) for p in Q.POLICIES}


def test_keep_is_the_policy(docs):
    rows = texts(40) + [(100, " ".join(f"word{k}" for k in range(80)))]
    table = docs(rows)
    kept = {r.doc_id for r in Q.keep(table).collect()}
    assert kept == {r.doc_id for r in Q.ledger(table).where(Q.passes(Q.STRICT)).collect()} and 100 in kept


def test_policies_by_version():
    assert Q.policy("strict", 1) is Q.STRICT and Q.policy("strict").version == 2 and Q.policy("base") is Q.BASE
    with pytest.raises(KeyError):
        Q.policy("strict", 9)


def test_ablation_and_report_read_the_stored_bits_alone(spark, docs):
    table = Q.stored(docs(texts(60)), Workspace(spark, "ablation"))
    rows = [r[Q.LEDGER].fail_bits for r in table.collect()]
    for r in Q.ablation(table, Q.STRICT).collect():
        bit = 1 << Q.BIT[r.rule]
        assert r.fails == sum(bool(b & bit) for b in rows)
        assert r.fails_alone == sum(b == bit for b in rows)
        assert r.rejected_without == sum(bool(b & ~bit) for b in rows)
    for r in Q.report(table).collect():
        assert r.kept == sum(not b & Q.policy(r.policy, r.version).mask for b in rows) and r.kept + r.rejected == len(rows)
    plan = Q.report(table)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "n_words" not in plan
