"""Encoding by pre-token: byte-level BPE never merges across the words that its pre-tokenizer's pattern makes, so a
text's ids are those of its words, one after another. Each distinct word is encoded once for as long as a worker's
bounded table holds it. Special strings are cut out first and stand as words of their own; the pattern can never make
one, as it parts letters from signs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import regex

#: The pre-tokenizer pattern of byte-level BPE files; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts in Latin-1, with each class spelt out, for which the standard library's engine is faster.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Entries in each of the two generations of a worker's table, about 200 MB in all.
TABLE_ENTRIES = 500_000
#: Characters of text that are encoded together.
BLOCK_CHARS = 1 << 20


def cuts_into_words(spec: dict) -> bool:
    """Whether a tokenizer's file describes plain byte-level BPE, for which the above holds."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    added = [a["content"] for a in spec.get("added_tokens") or []]
    return bool(
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec.get("added_tokens") or [])
        and all(len(regex.findall(PATTERN, a)) > 1 for a in added)
    )


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable Latin-1 stands for itself,
    the other bytes for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class WordTable:
    """Maps texts to the values of their words through ``encode``, which gets a list of distinct words.

    The table has two generations: when the young one is full it becomes the old one, and what is asked for again
    moves back, so frequent words stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], specials: Iterable[str] = (), entries: int = TABLE_ENTRIES):
        self._encode, self._entries = encode, entries
        self._young, self._old = {}, {}
        self._specials = sorted(specials, key=len, reverse=True)
        self._parts = regex.compile("(" + "|".join(map(regex.escape, self._specials)) + ")") if self._specials else None
        self._any, self._latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall

    def _find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def words(self, text: str) -> list[str]:
        if any(s in text for s in self._specials):
            cut = self._parts.split(text)
            return list(chain.from_iterable([p] if k % 2 else self._find(p) for k, p in enumerate(cut)))
        return self._find(text)

    def values(self, texts: list[str]) -> list[list]:
        """For each text, the values of its words in order."""
        cut = [self.words(t) for t in texts]
        if len(self._young) > self._entries:
            self._old, self._young = self._young, {}
        young, new = self._young, []
        for w in set(chain.from_iterable(cut)).difference(young):
            v = self._old.get(w)
            if v is None:
                new.append(w)
            else:
                young[w] = v
        young.update(zip(new, self._encode(new), strict=True))
        get = young.__getitem__
        return [list(map(get, ws)) for ws in cut]


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about ``size`` characters; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
