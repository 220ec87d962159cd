import random
import time

import numpy as np

from recordloom.llm import decontamination as D


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_stretch_against_all_stretches():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 7))]
        text = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        assert D.best_stretch(np.array(item, np.uint64), np.array(text, np.uint64)) == nearest(item, text)


def nearest(item, text):
    """The fewest edits; of those the first end, of those the last begin."""
    cost, j, i = min((edit_distance(item, text[i:j]), j, -i) for j in range(len(text) + 1) for i in range(j + 1))
    return cost, -i, j


def test_long_items_are_settled_in_little_time():
    rng = random.Random(9)
    item = [rng.randrange(1 << 40) for _ in range(4000)]
    doc = [rng.randrange(1 << 40) for _ in range(500)] + edited(rng, item, 700) + [rng.randrange(1 << 40) for _ in range(500)]
    began = time.perf_counter()
    edits, first, end = D.best_stretch(np.array(item, np.uint64), np.array([hash(w) for w in doc], np.uint64))
    assert 0 < edits <= 700 and abs(first - 500) < 20 and time.perf_counter() - began < 1


def world(rng, items=40):
    vocab = [f"w{k}" for k in range(500)] + ["the", "of", "a"] * 50
    bench = [[rng.choice(vocab) for _ in range(rng.randrange(14, 70))] for _ in range(items)]
    return vocab, bench


def test_exact_copies_are_all_found_wherever_they_lie(spark, docs):
    rng = random.Random(2)
    vocab, bench = world(rng)
    rows, want = [], set()
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        for k in rng.sample(range(len(bench)), rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = bench[k]
            want.add((d, k))
        rows.append((d, (", ".join(w) if d % 2 else " ".join(w).upper())))
    # a later passage may have been set into an earlier one; only whole ones count
    texts = {d: f" {t.lower().replace(',', '')} " for d, t in rows}
    want = {(d, k) for d, k in want if f" {' '.join(bench[k])} " in texts[d]}
    table = spark.createDataFrame([(k, " ".join(b), 1) for k, b in enumerate(bench)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs(rows), table).where("edits = 0").collect()}
    assert got == want


def test_recall_of_edited_passages():
    rng = random.Random(3)
    vocab, bench = world(rng, 120)
    index = D.Index([(k, " ".join(b).encode()) for k, b in enumerate(bench)], 20)
    texts = []
    for b in bench:
        w = list(b)
        for _ in range(max(1, len(w) // 20)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
        texts.append(D.word_hashes(" ".join([rng.choice(vocab) for _ in range(rng.randrange(40))] + w).encode()))
    found = D.search(index, texts)
    assert sum(any(f[0] == k for f in fs) for k, fs in enumerate(found)) >= 0.95 * len(bench)


def test_clean_texts_and_parts_of_items_stay_clean(docs, spark):
    rng = random.Random(4)
    vocab, bench = world(rng)
    rows = [(d, " ".join(rng.choice(vocab) for _ in range(300))) for d in range(60)] + [(1000 + k, " ".join(b[: len(b) // 2])) for k, b in enumerate(bench)]
    table = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(bench)], "item_id long, text string")
    assert D.leaks(docs(rows), table).count() == 0


def test_odd_rows(spark, docs, odd, nothing, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, words), (5, words)], "item_id long, text string")
    assert D.leaks(odd, bench).count() == 0 and D.leaks(nothing, bench).count() == 0
    assert D.leaks(odd, bench.limit(0)).count() == 0
    rows = docs([(1, words), (1, words), (2, f"x {words} y {words}"), (None, words), (3, "clean")])
    monkeypatch.setattr(D, "BLOCK_BYTES", 10)  # a block for each item
    got = D.leaks(rows, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted((d, i) for d in ("1", "1", "2", "None") for i in (4, 5))
    assert [r.first_word for r in got if r.doc_id == 2] == [1, 1]
    kept = D.keep(rows, bench)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [3]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], ["new"]])
    return w


def evenly(rng, words, edits):
    w = list(words)
    for k in range(edits):
        w[int((k + 0.5) * len(w) / edits)] = "new"
    return w


def test_recall_by_length_reaches_its_target():
    """At the full 20 %, and below it; every single length, edits at random and evenly dealt."""
    rng = random.Random(5)
    vocab, _ = world(rng, 0)
    found = {}
    for n in (8, 10, 14, 19, 20, 24, 30, 31, 32, 36, 45, 67, 70, 80, 130, 200):
        bench = [[rng.choice(vocab) for _ in range(n)] for _ in range(100)]
        index = D.Index([(k, " ".join(b).encode()) for k, b in enumerate(bench)], 20)
        for percent in (0, 10, 15, 20):
            for way in (edited, evenly):
                texts = [[rng.choice(vocab) for _ in range(rng.randrange(40))] + way(rng, b, n * percent // 100) + ["end"] * rng.choice([0, 9]) for b in bench]
                got = D.search(index, [D.word_hashes(" ".join(t).encode()) for t in texts])
                found[n, percent, way.__name__] = sum(any(f[0] == k for f in fs) for k, fs in enumerate(got)) / len(bench)
    print({k: v for k, v in found.items() if v < 1})
    assert all(v == 1 for (_, percent, _), v in found.items() if not percent)
    assert min(found.values()) >= 0.95 and sum(found.values()) / len(found) >= D.TARGET
    hardest = [v for (_, percent, _), v in found.items() if percent == 20]
    assert sum(hardest) / len(hardest) >= D.TARGET


def test_search_against_all_stretches():
    """What is found is what the nearest of all stretches says; what is missed is within the target."""
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(12)]
    bench = [[rng.choice(vocab) for _ in range(n)] for n in (1, 2, 5, 8, 9, 10, 13, 15, 20, 21)]
    for percent in (0, 20):
        index = D.Index([(k, " ".join(b).encode()) for k, b in enumerate(bench)], percent)
        texts = [[rng.choice(vocab) for _ in range(rng.randrange(30))] + edited(rng, b := rng.choice(bench), rng.randrange(min(6, len(b)))) + [rng.choice(vocab) for _ in range(rng.randrange(30))] for _ in range(150)]
        docs = [D.word_hashes(" ".join(t).encode()) for t in texts]
        want = lost = 0
        for doc, got in zip(docs, D.search(index, docs), strict=True):
            best = [(k, *D.best_stretch(h, doc)) for k, (_, h) in enumerate(index.items)]
            full = [(k, a, b - a, e) for k, e, a, b in best if e <= index.allowed[k]]
            assert set(got) <= set(full)
            want, lost = want + len(full), lost + len(full) - len(got)
            assert {f for f in full if not f[3]} <= set(got), "unedited passages are found with certainty"
        assert lost <= (1 - D.TARGET) * want


def test_edited_passages_against_brute_force_through_spark(spark, docs):
    rng = random.Random(11)
    vocab, bench = world(rng, 12)
    rows = [(d, " ".join([rng.choice(vocab) for _ in range(rng.randrange(60))] + edited(rng, bench[d % 12], rng.randrange(9)) + [rng.choice(vocab) for _ in range(rng.randrange(30))])) for d in range(60)]
    want = set()
    for d, t in rows:
        doc = D.word_hashes(t.encode())
        for k, b in enumerate(bench):
            edits, first, end = D.best_stretch(D.word_hashes(" ".join(b).encode()), doc)
            if edits <= len(b) * 20 // 100:
                want.add((d, k, first, end - first, edits))
    table = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(bench)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word, r.n_words, r.edits) for r in D.leaks(docs(rows), table).collect()}
    assert got <= want and len(got) >= D.TARGET * len(want)
    assert {r.doc_id for r in D.keep(docs(rows), table).collect()} == set(range(60)) - {d for d, *_ in got}


def test_short_items_and_texts_without_blanks():
    items = ["to be or not to be", "forty two", "今日はいい天気ですねえ"]
    index = D.Index([(k, t.encode()) for k, t in enumerate(items)], 20)
    texts = ["He said: To be, or NOT to be!", "to be or not to see", "it is forty-two.", "forty and two", "彼は「今日はいい天気ですねえ」と言った", "今日はいい天気"]
    assert [[f[0] for f in fs] for fs in D.search(index, [D.word_hashes(t.encode()) for t in texts])] == [[0], [], [1], [], [2], []]
