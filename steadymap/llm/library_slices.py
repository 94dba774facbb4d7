"""Whole-text encoding with the tokenizers library for byte-level vocabularies: each distinct slice is encoded once.

The slices are those of ``byte_bpe``'s scan, which equal the library's own; a test holds them against the library for
every code point. Texts with a special token's string are encoded whole by the library.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np

from steadymap.llm.byte_bpe import Coder, Settings
from steadymap.llm.pieces import _packed

CALL = 20_000  # slices per call of the library
JOINED = 1000  # slices that begin with a space and are encoded as one text
#: Fixed value: the byte-level vocabulary's letter for a space.
SPACE = "\u0120"


class LibraryMerger:
    """Ids of slices from the library, as ``byte_bpe.Merger`` has them from ranks."""

    def __init__(self, path: str, settings: Settings = Settings()):
        # a task has one core; the library would start a thread for each core of the machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.settings, self.tokenizer = settings, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        words = self.tokenizer.get_vocab()
        if max(words.values()) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        # a letter of a byte-level token is a byte
        self.length = np.zeros(max(words.values()) + 1, np.int64)
        for word, k in words.items():
            self.length[k] = len(word)
        self.spaced = np.zeros(1 << 16, bool)  # ids that stand for a text with a space in front
        self.spaced[[k for word, k in words.items() if word.startswith(SPACE)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merge(self, slices: list[bytes]) -> list[bytes]:
        missing = [s for s in slices if s not in self.store]
        if len(self.store) + len(missing) > self.settings.store:
            # a full store keeps its older half, as frequent slices are met early, and what this batch needs of the rest
            kept = dict(islice(self.store.items(), self.settings.store // 2))
            self.store = kept | {s: self.store[s] for s in slices if s in self.store}
        # a space and then no white space: end to end, such slices are the library's matches again
        words = [s for s in missing if len(s) > 1 and s[0] == 32 and s[1] > 32 and (s[1] < 128 or not s[1:].decode()[0].isspace())]
        for at in range(0, len(words), JOINED):
            self._joined(words[at : at + JOINED])
        self._apart([s for s in missing if s not in self.store])
        return [self.store[s] for s in slices]


    def _apart(self, slices: list[bytes]) -> None:
        for at in range(0, len(slices), CALL):
            cut = slices[at : at + CALL]
            got = self.tokenizer.encode_batch_fast([s.decode() for s in cut], add_special_tokens=False)
            self.store.update((s, _packed(e.ids)) for s, e in zip(cut, got))

    def _joined(self, slices: list[bytes]) -> None:
        """Encode slices with a space in front as one text, in which only they have one; calls that do not add up go apart."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(slices).decode()], add_special_tokens=False)[0].ids, "<u2")
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) == len(slices) and not begins[0]:
            raw, ends = ids.tobytes(), (2 * begins).tolist() + [2 * len(ids)]
            self.store.update(zip(slices, [raw[a:b] for a, b in zip(ends, ends[1:])]))


class LibraryCoder(Coder):
    def __init__(self, path: str, table: np.ndarray, settings: Settings = Settings()):
        self.merger, self.table, self.settings = LibraryMerger(path, settings), table, settings

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 16-bit integers."""
        special = self.merger.special
        apart = {n: self.merger.whole(t) for n, t in enumerate(texts) if any(s in t for s in special)}
        out = [b"".join(i.tobytes() for i, _ in coded) for _, coded in self.encode([None if n in apart else t for n, t in enumerate(texts)])]
        return [apart.get(n, ids) for n, ids in enumerate(out)]


@lru_cache(maxsize=1)
def shared_coder(path: str, settings: Settings, table: bytes) -> LibraryCoder:
    """The coder of a worker process, so that its later tasks find the slices of the earlier ones."""
    return LibraryCoder(path, np.frombuffer(table, np.uint8), settings)
