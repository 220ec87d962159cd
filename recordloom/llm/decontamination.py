"""Benchmark passages in documents, with edits.

An item of n words may have n * ``percent`` // 100 of them edited. Windows of words are embedded by a random walk (CGK): a step
gives the word under the pointer, and a random bit of the step and that word decides whether the pointer moves on. Two windows
that differ by a few edits walk apart at an edit and soon together again, so their edit distance becomes a Hamming distance
of the embeddings, and equal bits sampled from these are likely. A walk from a word is the same for a window of any size, so every
word of a document begins a window of the size of any item. ``WALKS`` walks with ``SAMPLES`` bit samples each, of ``BITS`` places
among the first ``STEPS`` steps, are looked up among those of the items' windows at all their words (a walk is short, as an
edited item has no long part unedited, and an item has many windows). A sample counts where its places fall on different words.

What ``WALKS`` x ``SAMPLES`` reach: recall ``TARGET`` or more of items of 8 to 200 words with 20 % of the words edited, at random or
evenly; tests measure it by length. The first ``MIN_WORDS`` words of each item are looked up as a run besides, so that unedited
passages are found with certainty; shorter items are matched unedited, by runs of their own length.

Symbols are words (lower case, without ASCII signs); of scripts without blanks, characters. A candidate is settled by the edit
distance of the whole item to the best stretch of the document around it, at most ``percent`` of the item's words.

Each scan task holds only the items (collected in blocks of at most ``BLOCK_BYTES``; a larger benchmark takes a scan for
each block) and a block of texts; nothing is shuffled.

Defined cases: null and empty texts and items match nothing; very long texts are searched whole; an item that occurs more than
once in a document gives one row, for the place with the fewest edits, the first to end of equals, and of the stretches that
end there the shortest; repeated rows and repeated items give a row each; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.llm.rows import as_bytes, held, map_batches, need, slices
from recordloom.session import spread

MIN_WORDS = 8
#: Repetitions, and the places of a sample among the steps of a walk (about two steps to a word).
WALKS, SAMPLES, BITS, STEPS = 4, 2, 3, 13
TARGET = 0.99
#: Windows of items of so many words or more begin at every second word.
SPARSE_WORDS = 32
BLOCK_BYTES = 4 << 20
BLOCK_WORDS = 200_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SIGNS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_PUNCT = [c.encode() for c in "‘’“”–—… «»。、，！？"]
#: Scripts without blanks between words: Thai to Myanmar, kana, Chinese characters.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def _samples() -> list[tuple[np.uint64, list[tuple[int, ...]]]]:
    """(odd multiplier, samples) of each walk, from a fixed random start. A sample begins at the first step."""
    rng = np.random.default_rng(40961)
    out = []
    for _ in range(WALKS):
        factor = np.uint64(int(rng.integers(0, 1 << 63)) * 2 + 1)
        picks: list[tuple[int, ...]] = []
        while len(picks) < SAMPLES:
            pick = (0, *sorted(rng.choice(np.arange(2, STEPS), BITS - 1, replace=False).tolist()))
            if min(np.diff(pick)) >= 3 and pick not in picks:
                picks.append(pick)
        out.append((factor, picks))
    return out


WALK = _samples()

FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("item_words", T.LongType())]
)


def word_hashes(text: bytes | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint64)
    if text.isascii():
        text = text.lower()
    else:
        text = _UNSPACED.sub(r" \1 ", text.decode("utf-8", "replace").lower()).encode()
        for p in _PUNCT:
            text = text.replace(p, b" ")
    words = text.translate(_SIGNS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sampled(symbols: np.ndarray):
    """For each repetition the sampled bits of the embedded window at every word, as one key, and whether its places fall
    on different words. Pointers stand at the last word where the words end, so windows there are cut short."""
    n = len(symbols)
    last = max(n - 1, 0)
    for w, (factor, picks) in enumerate(WALK):
        coins = symbols * factor
        coins ^= coins >> np.uint64(32)
        coins *= _MIX
        pointer = np.arange(n)
        wanted = {j for p in picks for j in p}
        seen, where = {}, {}
        for j in range(max(wanted) + 1):
            if j in wanted:
                where[j] = np.minimum(pointer, last)
                seen[j] = symbols.take(where[j])
            coin = coins.take(pointer, mode="clip")
            coin >>= np.uint64(j + 8)
            coin &= np.uint64(1)
            pointer += coin.view(np.int64)
        for k, pick in enumerate(picks):
            key = seen[pick[0]] + np.uint64(w * SAMPLES + k + 1)
            apart = np.ones(n, bool)
            for a, b in zip(pick, pick[1:], strict=False):
                key = key * _STEP + seen[b]
                apart &= where[b] > where[a]
            key ^= key >> np.uint64(29)
            yield key * _MIX, apart


class Index:
    """Samples of all windows of a block of items, under keys; the short items by runs of their length."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int):
        self.items = [(i, h) for i, t in items if len(h := word_hashes(t))]
        self.allowed = [min(len(h) * percent // 100, len(h) - 1) if len(h) >= MIN_WORDS else 0 for _, h in self.items]
        self.empty = not self.items
        if self.empty:
            return
        self.widths = {min(len(h), MIN_WORDS) for _, h in self.items}
        keys, owner, offset = [], [], []
        for k, (_, h) in enumerate(self.items):
            width = min(len(h), MIN_WORDS)
            found = [(run, np.zeros(1, np.int64)) for _, run in grams(h[:width], {width})]
            if len(h) >= MIN_WORDS:
                starts = np.arange(len(h)) % (2 if len(h) >= SPARSE_WORDS else 1) == 0
                found += [(key[apart & starts], np.flatnonzero(apart & starts)) for key, apart in sampled(h)]
            for key, at in found:
                keys.append(key)
                owner.append(np.full(len(at), k, np.int32))
                offset.append(at.astype(np.int32))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.owner, self.offset = key[order], np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.known, self.first = np.unique(self.keys, return_index=True)
        self.first = np.append(self.first, len(self.keys))
        self.mask = np.zeros(1 << max(16, (len(self.known) * 32).bit_length()), bool)
        self.mask[self.known & np.uint64(len(self.mask) - 1)] = True

    def candidates(self, symbols: np.ndarray):
        """(words that a key spans, places, places of the keys in ``known``) in the words."""
        low = np.uint64(len(self.mask) - 1)
        wide = sampled(symbols) if len(symbols) and max(self.widths) == MIN_WORDS else ()
        for span, key, apart in chain(((1, k, a) for k, a in wide), ((w, k, None) for w, k in grams(symbols, self.widths))):
            hit = self.mask[key & low]
            at = np.flatnonzero(hit if apart is None else hit & apart)
            found = key[at]
            place = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            held = self.known[place] == found
            yield span, at[held], place[held]

    @lru_cache(maxsize=4096)  # noqa: B019
    def bits(self, k: int) -> dict[int, int]:
        return places_of(self.items[k][1].tolist())


def grams(symbols: np.ndarray, widths: set[int]):
    """(width, hashes of all runs of so many words) for each of the widths."""
    acc = symbols
    for width in range(1, min(max(widths), len(symbols)) + 1):
        if width > 1:
            acc = acc[:-1] * _STEP
            acc += symbols[width - 1 :]
        if width in widths:
            keys = acc + np.uint64(width)
            keys ^= keys >> np.uint64(29)
            yield width, keys


def fewest(bits: dict[int, int], n: int, words: list[int], anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the stretch of ``words`` nearest to an item of ``n`` words, the first of equals; ``anchored`` ones begin
    with the words. A column of the table of edit distances is two numbers, of the places where it rises and where it falls."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, best = full, 0, n, (n, 0)
    for j, w in enumerate(words, 1):
        eq = bits.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(x | up)), up & x
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
            if edits < best[0]:
                best = (edits, j)
        rise, eq = (rise << 1 | anchored) & full, eq | down
        up, down = ((fall << 1) & full) | (full & ~(eq | rise)), rise & eq
    return best


def places_of(words: list[int]) -> dict[int, int]:
    """For each word, the bits of the places where it stands."""
    out: dict[int, int] = defaultdict(int)
    for j, w in enumerate(words):
        out[w] |= 1 << j
    return dict(out)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the stretch of ``text`` nearest to the whole item: the first to end, and of those that end
    there the shortest."""
    words, n = item.tolist(), len(item)
    edits, end = fewest(places_of(words), n, text.tolist())
    back, size = fewest(places_of(words[::-1]), n, text[:end][::-1].tolist(), anchored=True)
    assert back == edits
    return edits, end - size, end


def _settle(index: Index, doc: np.ndarray, places: dict[int, set[int]]) -> list[tuple[int, int, int, int]]:
    """(item, first, words, edits) for the items that the document holds."""
    found = []
    for k, begins in places.items():
        item, allowed, bits = index.items[k][1], index.allowed[k], index.bits(k)
        n = len(item)
        whole = next((b for b in sorted(begins) if b >= 0 and np.array_equal(doc[b : b + n], item)), None)
        if whole is not None:
            found.append((k, whole, n, 0))
            continue
        spans: list[list[int]] = []
        for b in sorted(begins):
            # the walks may have met some words away from where the item's own would be
            lo, hi = max(0, b - allowed - (STEPS if allowed else 0)), min(len(doc), b + n + allowed + (STEPS if allowed else 0))
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        best = (allowed + 1, 0)
        for lo, hi in spans:
            words = doc[lo:hi].tolist()
            # so many words of the stretch are the item's own
            if sum(map(bits.__contains__, words)) >= n - allowed:
                edits, end = fewest(bits, n, words)
                if edits < best[0]:
                    best = (edits, lo + end)
        if best[0] <= allowed:
            lo = max(0, best[1] - n - allowed)
            edits, first, end = best_stretch(item, doc[lo : best[1]])
            found.append((k, lo + first, end - first, edits))
    return found


def search(index: Index, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
    """What each document holds; the words of several documents are looked up together."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    lo = 0
    while lo < len(docs):
        hi, words = lo + 1, len(docs[lo])
        while hi < len(docs) and words + len(docs[hi]) <= BLOCK_WORDS:
            words += len(docs[hi])
            hi += 1
        block = docs[lo:hi]
        ends = np.cumsum([len(d) for d in block])
        by_doc: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for span, at, keys in index.candidates(np.concatenate(block)):
            of = np.searchsorted(ends, at, side="right")
            inside = at + span <= ends[of]
            for d, place, key in zip(of[inside].tolist(), at[inside].tolist(), keys[inside].tolist(), strict=True):
                begin = place - int(ends[d]) + len(block[d])
                for e in range(index.first[key], index.first[key + 1]):
                    by_doc[d][int(index.owner[e])].add(begin - int(index.offset[e]))
        for d, items in by_doc.items():
            found[lo + d] = sorted(_settle(index, block[d], items))
        lo = hi
    return found


def _index(sent, name: str, percent: int) -> Index:
    return held(("benchmark", name), lambda: Index(list(sent.value), percent))


def item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, in the order of their ids."""
    held, size = [], 0
    for r in need(benchmark, "item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        if held and size + len(text) > BLOCK_BYTES:
            yield tuple(held)
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    if held:
        yield tuple(held)


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 20) -> DataFrame:
    """A row for each document and each item of which it holds the whole with at most ``percent`` of its words edited."""
    spark = documents.sparkSession
    out = None
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def batch(b, sent=sent, name=uuid.uuid4().hex):
            index = _index(sent, name, percent)
            if index.empty:
                return None
            found = search(index, [word_hashes(t) for t in as_bytes(b, "text")])
            rows = [(i, index.items[k][0], first, n, edits, len(index.items[k][1])) for i, got in zip(b.column("doc_id").to_pylist(), found, strict=True) for k, first, n, edits in got]
            return dict(zip(FOUND.fieldNames(), zip(*rows, strict=True), strict=True)) if rows else None

        part = map_batches(need(documents, "doc_id", "text"), batch, FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def keep(documents: DataFrame, benchmark: DataFrame, percent: int = 20) -> DataFrame:
    """The documents without those that hold a benchmark item, with all columns. Each row is judged where it is scanned, by
    its own text, so null and repeated doc_ids are safe and nothing is shuffled."""
    spark = documents.sparkSession
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            index = _index(sent, name, percent)
            for b in slices(batches):
                if not index.empty:
                    found = search(index, [word_hashes(t) for t in as_bytes(b, "text")])
                    b = b.filter(pa.array([not f for f in found], type=pa.bool_()))
                if b.num_rows:
                    yield b

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def query(spark, sf_dir: str) -> DataFrame:
    """op4: benchmark items in documents."""
    return leaks(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
