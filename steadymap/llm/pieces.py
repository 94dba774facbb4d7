"""Whole-text encoding with the tokenizers library, one call per distinct piece.

A tokenizer that splits a text before it merges gives a text the ids of its pieces, one after the other. Pieces
are what single spaces separate; each distinct piece is encoded by the library once while the cache holds it.
Texts where white space could be cut wrongly are encoded whole. The cache only saves time; its size has no
effect on results.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import islice

CACHE = 600_000
SEPARATORS = re.compile("[\x1c-\x1f]")


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 16-bit integers (both vocabularies are below 65,536)."""

    before = ""  # what stands before every piece in the text

    def __init__(self, path: str):
        # a task has one core; the library would start a thread for each core of the machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def add(self, pieces: list[str]) -> None:
        self.make_room(len(pieces))
        for at in range(0, len(pieces), 20_000):
            cut = pieces[at : at + 20_000]
            got = self.tokenizer.encode_batch_fast([self.before + p for p in cut], add_special_tokens=False)
            self.cache.update((p, _packed(e.ids)) for p, e in zip(cut, got))

    def make_room(self, more: int) -> None:
        """A full cache keeps its older half: frequent pieces are met early."""
        if len(self.cache) + more > CACHE:
            self.cache = dict(islice(self.cache.items(), CACHE // 2))

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it has to be encoded whole."""
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        pieces = self.pieces(text)
        if pieces is None:
            return self.whole(text)
        got = list(map(self.cache.get, pieces))
        missing = [n for n, ids in enumerate(got) if ids is None]
        if missing:
            self.add(list(dict.fromkeys([pieces[n] for n in missing])))
            # what was found stays valid if the cache was cut meanwhile
            get = self.cache.get
            for n in missing:
                ids = get(pieces[n])
                got[n] = self.whole(self.before + pieces[n]) if ids is None else ids
        return b"".join(got)


class WordEncoder(Encoder):
    """For the vocabulary with word ends: white space is dropped."""

    def pieces(self, text: str) -> list[str] | None:
        return None if SEPARATORS.search(text) else text.split()
