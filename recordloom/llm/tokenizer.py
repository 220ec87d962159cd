"""Library tokenizers (tokenizers, sentencepiece) held once per Python worker."""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np

from recordloom.llm.chunks import WordTable, blocks, byte_of_char, cuts_into_words
from recordloom.llm.rows import held


def version_digest(path: str) -> str:
    """Names a tokenizer by its file's bytes; a changed file is another tokenizer."""
    with open(path, "rb") as f:
        return hashlib.sha256(os.path.splitext(path)[1].encode() + b"\0" + f.read()).hexdigest()


class Encoder:
    """``ids(texts)`` gives one array of ids for each text, as the library does without special tokens."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab = model.get_piece_size()
            self._whole = lambda texts: model.encode(texts, num_threads=1)
            self._table = None
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.vocab = tok.get_vocab_size(with_added_tokens=True)
            self._whole = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self._table = self._words(tok, spec) if cuts_into_words(spec) else None
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")

    def _words(self, tok, spec: dict) -> WordTable:
        """The library's model on words in its byte alphabet; special strings have their own ids."""
        stand_in = {b: c for c, b in byte_of_char().items()}
        special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        model = tok.model

        def encode(words: list[str]):
            for w in words:
                if w in special:
                    yield np.array([special[w]], self.dtype).tobytes()
                else:
                    kind = "H" if self.dtype.itemsize == 2 else "I"
                    yield array(kind, [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(stand_in))]).tobytes()

        return WordTable(encode, special)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        if self._table is None:
            return [np.array(i, self.dtype).tobytes() for i in self._whole(texts)]
        return [b"".join(v) for v in self._table.values(texts)]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in blocks(texts):
            out += [len(p) // self.dtype.itemsize for p in self.packed(texts[a:b])]
        return out


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))
