"""Byte-pair encoding and decoding without merging.

Encoding backtracks over longest matches: an Aho-Corasick automaton over the vocabulary gives, in one pass, the
longest token that starts at each byte; a token is accepted after its predecessor only if the two are compatible, that
is, if merging their joined bytes by rank would leave exactly this pair; else the next shorter token is tried, and
where none is left the predecessor is taken back. A position found to lead nowhere is never entered again, so the
work is linear in the word. Compatible pairs make the sequence the one that merging gives.

Decoding is a gather: token bytes lie in one blob, an offset table says where.

Defined cases: null and empty texts have no ids and decode to the empty text; very long texts are encoded whole; special strings inside a text are the
tokens of their own that the library makes of them; repeated rows give repeated rows; an empty table gives none; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.llm.chunks import WordTable, blocks, byte_of_char, cuts_into_words
from recordloom.llm.rows import held, map_batches, need
from recordloom.session import spread

#: Words in each generation of a worker's table (about 300 bytes each), and compatibility answers that it remembers.
WORD_ENTRIES, PAIR_ENTRIES = 200_000, 500_000


class Bpe:
    """Tables of one byte-level BPE file. Tokens are numbered by rank here: single bytes first, then merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not cuts_into_words(spec):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        to_byte, vocab = byte_of_char(), spec["model"]["vocab"]
        raw = lambda s: bytes(to_byte[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        singles = sorted((t for t in vocab if len(t) == 1), key=vocab.get)
        rank = {t: k for k, t in enumerate(singles)}
        self.parts: list[tuple[int, int] | None] = [None] * len(singles)
        self.merged: dict[tuple[int, int], int] = {}
        texts = list(singles)
        for a, b in merges:
            pair = rank[a], rank[b]
            if pair in self.merged:
                continue
            if a + b not in rank:
                rank[a + b] = len(texts)
                texts.append(a + b)
                self.parts.append(pair)
            self.merged[pair] = rank[a + b]
        self.size = [len(t) for t in texts]
        self.id_of = [vocab[t] for t in texts]
        self._fits: dict[int, bool] = {}
        by_bytes = {raw(t): k for k, t in enumerate(texts)}
        # a token takes part only if merging its own bytes ends in it
        self.live = [p is None or self._compatible(*p, below=k) for k, p in enumerate(self.parts)]
        self.shorter: list[int] = [-1] * len(texts)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, k in by_bytes.items():
            if self.live[k]:
                self.automaton.add_word(t.decode("latin-1"), k)
                for n in range(len(t) - 1, 0, -1):
                    s = by_bytes.get(t[:n])
                    if s is not None and self.live[s]:
                        self.shorter[k] = s
                        break
        self.automaton.make_automaton()
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        known = {vocab[t]: raw(t) for t in vocab} | {i: s.encode() for s, i in self.special.items()}
        self.vocab = max(known) + 1
        self.blob = np.frombuffer(b"".join(known.get(i, b"") for i in range(self.vocab)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(known.get(i, b"")) for i in range(self.vocab)])]).astype(np.int64)
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self._back = [n - 1 for n in self.size]
        self._packed = [np.array([i], self.dtype).tobytes() for i in self.id_of]
        self._decimal = [str(i).encode() for i in self.id_of]
        self.table = WordTable(self._words, self.special, WORD_ENTRIES)

    def _compatible(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of a rank under ``below`` joins anything across the border of two tokens while the
        merges inside each are undone from the last one backwards."""
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < below:
                return False
            # undo the later of the two merges; the border is then between its near half and the other token
            if left > right:
                below = left
                if self.parts[left] is not None:
                    left = self.parts[left][1]
                    continue
                below = right + 1
                if self.parts[right] is None:
                    return True
                right = self.parts[right][0]
            else:
                below = right + 1
                if self.parts[right] is not None:
                    right = self.parts[right][0]
                    continue
                below = left
                if self.parts[left] is None:
                    return True
                left = self.parts[left][1]

    def fits(self, left: int, right: int) -> bool:
        known = self._compatible(left, right, below=1 << 62)
        if len(self._fits) > PAIR_ENTRIES:
            self._fits.clear()
        self._fits[left << 32 | right] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ranks of one pre-token, given as one character for each byte."""
        n, back = len(word), self._back
        longest = [-1] * n
        for last, k in self.automaton.iter(word):
            longest[last - back[k]] = k  # ends only grow, so the last token to start here is the longest
        token = longest[0]
        size, shorter, known = self.size, self.shorter, self._fits.get
        if size[token] == n:
            return [token]
        out: list[int] = []
        dead: set[int] = set()
        at, before = 0, -1
        while True:
            end = at + size[token]
            ok = end not in dead
            if ok and before >= 0:
                ok = known(before << 32 | token)
                if ok is None:
                    ok = self.fits(before, token)
            if ok:
                out.append(token)
                if end == n:
                    return out
                at, before, token = end, token, longest[end]
            else:
                token = shorter[token]
                while token < 0:
                    dead.add(at)
                    token = out.pop()
                    at -= size[token]
                    token = shorter[token]
                before = out[-1] if out else -1

    def _words(self, words: list[str]):
        """(packed ids, decimal ids joined by commas) of each word."""
        for w in words:
            if w in self.special:
                i = self.special[w]
                yield np.array([i], self.dtype).tobytes(), str(i).encode()
            else:
                ranks = self.encode_word(w.encode().decode("latin-1"))
                yield b"".join([self._packed[k] for k in ranks]), b",".join([self._decimal[k] for k in ranks])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(v[0] for v in self.table.values([text])[0]), self.dtype).tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        ids = ids.astype(np.int64)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(start - (ends - size), size)]

    def round_trip(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text: number of ids, decimal ids joined by commas, and the UTF-8 of the decoded text."""
        values = self.table.values(texts)
        packed = [b"".join(v[0] for v in vs) for vs in values]
        ids = np.frombuffer(b"".join(packed), self.dtype)
        out = self.decode(ids)
        sizes = (self.offsets[1:] - self.offsets[:-1])[ids.astype(np.int64)]
        places = np.concatenate([[0], np.cumsum(sizes)])
        rows, at = [], 0
        for vs, p in zip(values, packed, strict=True):
            n = len(p) // self.dtype.itemsize
            got = out[places[at] : places[at + n]].tobytes()
            at += n
            rows.append((n, b",".join([v[1] for v in vs]), got.decode("utf-8", "replace").encode()))
        return rows


def load(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


ENCODED = T.StructType([_SCHEMA["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text again, for every whole text."""

    def batch(b):
        texts, rows, bpe = [t or "" for t in b.column("text").to_pylist()], [], load(path)
        for lo, hi in blocks(texts):
            for text, values in zip(texts[lo:hi], bpe.table.values(texts[lo:hi]), strict=True):
                ids = np.frombuffer(b"".join([v[0] for v in values]), bpe.dtype).astype(np.int32)
                rows.append((len(ids), ids, bpe.decode(ids).tobytes() == text.encode()))
        return {"doc_id": b.column("doc_id")} | dict(zip(("n_tokens", "ids", "round_trip"), zip(*rows, strict=True), strict=True))

    return map_batches(need(documents, "doc_id", "text"), batch, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row of ids."""

    def batch(b):
        bpe = load(path)
        texts = [bpe.decode(np.array(i or [], np.int64)).tobytes().decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
        return {"doc_id": b.column("doc_id"), "text": texts}

    return map_batches(need(encoded, "doc_id", "ids"), batch, T.StructType([_SCHEMA["doc_id"], T.StructField("text", T.StringType())]))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to, for every whole text.
    One narrow pass: nothing is shuffled."""

    def batch(b):
        texts, rows, bpe = [t or "" for t in b.column("text").to_pylist()], [], load(path)
        for lo, hi in blocks(texts):
            rows += [(n, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for n, i, d in bpe.round_trip(texts[lo:hi])]
        return {"doc_id": b.column("doc_id")} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows, strict=True), strict=True))

    return map_batches(need(documents, "doc_id", "text"), batch, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: encodes and decodes every document."""
    import public_tokenizers

    return digests(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"))
