import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from recordloom.llm import bpe, token_counts, token_files, tokenizer
from recordloom.llm.chunks import WordTable
from recordloom.session import Workspace
from tests.llm.conftest import ODD

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def samples(n=400):
    rng = random.Random(9)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\t", "é", "½", "1", "12", "!", "'s", "<|endoftext|>", "日", "\u3000", "\x1c", "\x85", "Q", "ß", "–"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_own_encoder_gives_the_library_ids():
    own = bpe.load(PATH)
    for t in samples():
        assert own.encode(t) == ids_of(t), repr(t)


def test_every_token_encodes_to_itself():
    own = bpe.load(PATH)
    assert all(own.live)
    rng = random.Random(1)
    for k in rng.sample(range(len(own.size)), 500):
        raw = bytes(own.blob[own.offsets[own.id_of[k]] : own.offsets[own.id_of[k] + 1]])
        assert own.encode_word(raw.decode("latin-1")) == [k]


def test_backtracking_against_merging():
    own = bpe.load(PATH)
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.randrange(97, 105) for _ in range(rng.randrange(1, 14)))
        parts = [own.encode_word(chr(b))[0] for b in word]
        while True:
            ranked = [(own.merged[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.merged]
            if not ranked:
                break
            rank, i = min(ranked)
            parts[i : i + 2] = [rank]
        assert own.encode_word(word.decode()) == parts


def test_decoding_any_ids():
    own = bpe.load(PATH)
    rng = random.Random(5)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(30))]
        assert own.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_library_encoder_by_words():
    enc = tokenizer.Encoder(PATH)
    for t in samples():
        assert np.frombuffer(enc.packed([t])[0], enc.dtype).tolist() == ids_of(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    enc = tokenizer.Encoder(P.path(name))
    texts = samples(40)
    if name.endswith(".json"):
        lib = Tokenizer.from_file(P.path(name))
        want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = list(map(len, sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)))
    assert enc.counts(texts) == want


def test_word_table_stays_bounded():
    calls = []
    table = WordTable(lambda ws: (calls.append(w) or w for w in ws), entries=50)
    for k in range(40):
        assert table.values([f"hot x{k}a y{k}b"])[0][0] == "hot"
        assert len(table._young) + len(table._old) < 250
    assert calls.count("hot") == 1


def test_token_files(spark, docs, odd, nothing, tmp_path):
    rows = token_files.query
    folder = str(tmp_path / "ids")
    index = token_files.write(odd, PATH, folder, 2, shards=3)
    got = token_files.read(spark, folder).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), order, strict=True):
        ids = [*ids_of(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert index["ids"] == start and rows
    token_files.write(nothing, PATH, str(tmp_path / "none"), 2)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_round_trip_digests(odd, nothing):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(ids_of(t)), sha(",".join(map(str, ids_of(t))).encode()), sha((t or "").encode())) for i, t in ODD)
    encoded = bpe.encode(odd, PATH)
    assert all(r.round_trip for r in encoded.collect())
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded, PATH).collect()) == sorted((str(i), t or "") for i, t in ODD)
    assert bpe.digests(nothing, PATH).count() == 0


def test_counts_and_cache(spark, odd, nothing, docs, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    want = sorted((str(i), len((t or "").encode()), len(ids_of(t))) for i, t in ODD)
    run = lambda d: sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count(d, PATH, cache, Workspace(spark, "t")).collect())
    assert run(odd) == want
    stored = token_counts.stored(spark, cache, PATH).count()
    assert stored == len({t or "" for _, t in ODD})
    asked = []
    real = token_counts._encode
    monkeypatch.setattr(token_counts, "_encode", lambda texts, p: asked.append(texts.count()) or real(texts, p))
    assert run(odd) == want and not asked, "a warm cache encodes nothing"
    assert len(run(docs([(1, "one"), (2, "brand new text")]))) == 2 and asked == [1]
    assert run(nothing) == []


def test_changed_tokenizer_is_another(tmp_path):
    other = tmp_path / "t.json"
    other.write_bytes(open(PATH, "rb").read() + b"\n")
    assert tokenizer.version_digest(str(other)) != tokenizer.version_digest(PATH)


def test_each_missing_text_is_encoded_once(spark, docs, tmp_path, monkeypatch):
    seen = []
    real = token_counts._encode
    monkeypatch.setattr(token_counts, "_encode", lambda texts, p: seen.append(sorted(r.text for r in texts.collect())) or real(texts, p))
    table = docs([(1, "same row")] * 50 + [(2, "alone"), (3, "two ids"), (4, "two ids"), (None, None), (None, "")]).repartition(7)
    got = token_counts.count(table, PATH, str(tmp_path / "c"), Workspace(spark, "once")).collect()
    assert seen == [["", "alone", "same row", "two ids"]] and len(got) == 55
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, len(ids_of("same row"))), (2, len(ids_of("alone"))), (3, len(ids_of("two ids"))), (4, len(ids_of("two ids"))), (None, 0)}


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    from recordloom.llm import rows

    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 5}") for k in range(200)] + [(900, None), (901, "lost")], "a int, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3), ("k2", 4), ("k3", 5), ("k4", 6), ("unused", 7)], "key string, v int")
    want = sorted(map(str, left.join(right, "key", "left").select("a", "key", "v").collect()))
    for share in (10_000, 2, 1):
        monkeypatch.setattr(rows, "HOT_SHARE", share)
        assert sorted(map(str, rows.join_unique(left, right, "key").select("a", "key", "v").collect())) == want


def test_every_integer_is_an_id_and_ranges_read_the_same(spark, docs, tmp_path, monkeypatch):
    folder = str(tmp_path / "least")
    least = -(1 << 63)
    token_files.write(docs([(least, "a b c"), (None, "no id"), (None, None), (5, "five " * 50), (6, "")]), PATH, folder, 2, shards=2)
    read = lambda: sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, folder).collect())
    mapped = read()
    assert sorted(d for d, *_ in mapped) == sorted(["None", "None", str(least), "5", "6"])
    whole = [d for s in token_files.load_index(folder)["shards"] for d in token_files.documents_of(folder, s, "<u2")]
    monkeypatch.setattr(token_files.files, "mounted", lambda uri: False)
    monkeypatch.setattr(token_files, "READ_IDS", 20)
    parts = [d for s in token_files.load_index(folder)["shards"] for d in token_files.documents_of(folder, s, "<u2")]
    assert [(d, at, i.tolist()) for d, at, i in parts] == [(d, at, i.tolist()) for d, at, i in whole]
