"""Token ids of whole texts with a public tokenizer, through a bounded cache of words.

The tokenizer drops white space and never joins what it divides, so a text's ids are those of its words in turn. Words
recur; each worker keeps the ids of words and of the pieces between letters, digits and signs, and asks the
``tokenizers`` library for new pieces only. A full cache becomes the old generation, from which what recurs is taken
over, and the generation before is dropped: caches change speed, never ids.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Entries of a generation of each cache of a worker, two generations each; about 200 bytes an entry.
WORDS, PIECES = 300_000, 450_000
#: The tokenizer's own division of lower-case ASCII words (fixed value of the vocabulary file).
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordTokenizer:
    """``ids(texts)``: each text's ids as little-endian unsigned 16-bit bytes (the vocabulary has under 65,536)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        t = self.tokenizer
        if "<|" in word:  # may hold a special token
            return np.array(t.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        if word.isascii() and word.isprintable():  # control characters need the byte-level step
            parts = PIECE.findall(word.lower())
        else:
            parts = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))]
        out = []
        for part in parts:
            got = self.pieces.get(part)
            if got is None:
                got = self.old_pieces.get(part)
                if got is None:
                    ids = [x.id for x in t.model.tokenize(part)]
                    got = struct.pack(f"<{len(ids)}H", *ids)
                self.pieces[part] = got
            out.append(got)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > WORDS:
            self.old_words, known = known, {"": b""}
            self.words = known
        if len(self.pieces) > PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        old = self.old_words
        for w in set(words).difference(known):
            known[w] = old[w] if w in old else self._new(w)
        return b"".join([known[w] for w in words])


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for this vocabulary file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
