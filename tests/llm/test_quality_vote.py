import random
import zlib

import numpy as np

from recordloom.llm import quality_vote as V


def labelled(rng, n):
    vocab = [f"{a}{b}" for a in ("ti", "the", "on", "re", "ment", "au") for b in ("a", "es", "tion", "le", "x", "or")]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40, 200))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + " |" for w in words] if kind == 1 else [words[0]] * len(words)
        rows.append((d, " ".join(words)))
        labels.append((d, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = labelled(random.Random(1), 600)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    documents = docs(rows)
    model = V.fit(documents, table)
    used = [d for d, *_ in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    assert len(model.labels) == len(used)
    scores = {r.doc_id: r.score for r in V.score(documents, model).collect()}
    held = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([(scores[d] >= 0.7) == bool(q) for d, q in held]) >= 0.97


def test_scores_are_votes_over_all_labelled_vectors():
    rng = np.random.default_rng(3)
    sample = np.abs(rng.standard_normal((50, V.TERMS))).astype(np.float32)
    model = V.Model(sample, rng.integers(0, 2, 50))
    rows = np.abs(rng.standard_normal((20, V.TERMS))).astype(np.float32)
    for row, got in zip(rows, model.scores(rows), strict=True):
        x = row * model.weights
        x = x / np.linalg.norm(x) @ model.axes
        cosine = model.vectors @ (x / np.linalg.norm(x))
        near = np.argsort(-cosine)[: V.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** V.POWER
        assert abs((weight * model.labels[near]).sum() / weight.sum() - got) < 1e-4


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 0), (8, None, 0), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = V.fit(odd, labels)
    got = V.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert V.fit(odd, labels.limit(0)) is None and {r.score for r in V.score(odd, None).collect()} == {0.0}
    assert V.score(nothing, model).count() == 0 and V.fit(nothing, labels) is None


def test_ties_fall_to_the_earlier(spark):
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1, 0.5], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.5] * 6], np.float32)
    assert [sorted(r) for r in V.nearest(cosine, 3).tolist()] == [[0, 1, 2], [3, 4, 5], [0, 1, 2]]


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = {r.doc_id: r for r in V.query(spark, folder).collect()}
    held = [(judged[r.doc_id].predicted, r.quality) for r in labels.collect() if judged[r.doc_id].held_out]
    right = np.mean([p == q for p, q in held])
    print(f"held-out accuracy {right:.4f} of {len(held)}")
    assert right >= 0.97 and len(judged) == documents.count()
