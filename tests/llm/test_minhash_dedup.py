import random
import re
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import minhash_dedup as M
from recordloom.operators.components import components
from recordloom.llm.shingles import shingle_set
from recordloom.session import Workspace

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    k = min(width, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, width, percent=80):
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(rng, n):
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 60
    rows, passage = [], [rng.choice(vocab) for _ in range(30)]
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 200]))]
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w) if rng.random() < 0.8 else "\n".join(w).upper()))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_are_those_of_all_pairs(docs, width):
    rows = corpus(random.Random(width), 160)
    got = M.members(docs(rows), width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pivot_rounds_give_the_same(docs, spark, monkeypatch):
    rng = random.Random(8)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 4, 9, 12])):
            w[rng.randrange(100)] = f"x{rng.randrange(9999)}"
        rows.append((k, " ".join(w)))
    steps = []
    real = M.confirmed
    monkeypatch.setattr(M, "confirmed", lambda p, *a: steps.append(1) or real(p, *a))
    monkeypatch.setattr(M, "FLOOR", 0)
    monkeypatch.setattr(M, "PER_POSTING", 0)
    got = M.members(docs(rows), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert len(steps) > 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        s = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = int(4000 * 2 * share / (1 + share))
        a, b = s[:n], s[:n]
        rest = (4000 - n) // 2
        a, b = np.concatenate([a, s[n : n + rest]]), np.concatenate([b, s[n + rest :]])
        true = n / (n + 2 * rest)
        assert abs((M.signature(a) == M.signature(b)).mean() - true) < 0.25


def test_shingles():
    assert len(shingle_set(b"", 2)) == 0 and len(shingle_set(b" \n", 2)) == 0
    assert len(shingle_set(b"one", 2)) == 1 and (shingle_set(b"ONE", 2) == shingle_set(b"one ", 2)).all()
    assert len(shingle_set(b"a b a b a", 2)) == 2
    assert shingle_set(b"a b", 2)[0] != shingle_set(b"b a", 2)[0]


def test_odd_rows(docs, odd, nothing):
    got = M.members(odd, 2).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[5] == [(1, 4, False)] * 2 and by[4] == [(1, 4, True)]
    assert by[None][0][1:] == (None, True) and by[7] == [(1, 7, True)]
    assert M.members(nothing).count() == 0
    kept = M.keep(odd, 2)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]


def test_rows_of_no_id_and_of_one_id_are_judged_by_their_texts(docs):
    words = [f"u{k}" for k in range(240)]
    first, second, third, alone, lone = (" ".join(words[k : k + 40]) for k in range(0, 200, 40))
    near = lambda t: t + " more"
    rows = [(None, first), (None, near(first)), (None, second), (3, near(second)), (None, alone), (7, third), (8, near(third)), (8, lone)]
    got = {(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.members(docs(rows), 2).collect() if r.doc_id is None or r.doc_id == 3}
    assert {(c, k) for d, _, c, k in got if d == "3"} == {("3", True)}
    kept = sorted((str(r.doc_id), r.text) for r in M.keep(docs(rows), 2).collect())
    one = [t for d, t in kept if t in (first, near(first))]
    assert len(one) == 1
    assert kept == sorted([("None", one[0]), ("3", near(second)), ("None", alone), ("7", third), ("8", lone)])


def test_repeated_rows_give_their_set_once(docs):
    words = " ".join(f"u{k}" for k in range(40))
    rows = [(1, words)] * 5 + [(None, words + " more")] * 4
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in M.members(docs(rows), 2).collect())
    assert got == [("1", 1, True)] * 5 + [("None", 1, False)] * 4


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(table, Workspace(spark, "cc")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(table.limit(0), Workspace(spark, "cc")).count() == 0


def test_every_integer_is_an_id(docs):
    most = (1 << 63) - 1
    rows = [(most, "a b c d"), (None, "a b c d"), (None, "e f g h"), (-most, "i j k l"), (most, None), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.members(docs(rows), 2).collect())
    assert got == sorted([(str(most), 3, str(most), True), ("None", 3, str(most), False), ("None", 3, "None", True), (str(-most), 3, str(-most), True), (str(most), 0, str(most), True), ("None", 0, "None", True)])
    kept = sorted((str(r.doc_id), str(r.text)) for r in M.keep(docs(rows), 2).collect())
    assert kept == sorted((str(i), str(t)) for k, (i, t) in enumerate(rows) if k != 1)


def test_recall_near_the_threshold_against_brute_force(docs):
    """Pairs whose similarity lies just about 0.80: the links that the operator finds, of those that all pairs give."""
    rng = random.Random(80)
    rows = []
    for k in range(220):
        base = [f"p{k}x{j}" for j in range(rng.choice([40, 90, 200]))]
        near = list(base)
        for at in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.05, 0.062)))):
            near[at] = f"q{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    want = {d: least for d, _, least in brute(rows, 2)}
    got = {r.doc_id: r.component_id for r in M.members(docs(rows), 2).collect()}
    linked = [d for d in want if want[d] != d]
    found = [d for d in linked if got[d] == want[d]]
    print(f"links of similarity about 0.80: {len(linked)} of 220 pairs, found {len(found)}")
    assert 40 < len(linked) < 200 and len(found) >= 0.99 * len(linked)
    assert all(got[d] == d for d in want if want[d] == d)


def test_texts_around_one_template_in_blocks(docs, monkeypatch):
    """Many unlike texts share a template, others vary it: long lists of coordinates and of shingles."""
    rng = random.Random(81)
    template = [f"t{k}" for k in range(80)]
    rows = [(k, " ".join(template + [f"o{rng.randrange(60)}" for _ in range(rng.choice([4, 8, 12, 18]))])) for k in range(120)]
    for name, value in (("FLOOR", 0), ("PER_POSTING", 0), ("BLOCK", 7)):
        monkeypatch.setattr(M, name, value)
    got = M.members(docs(rows), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
