"""Word-cached encoding with a public tokenizer.

Both tokenizer files split a text at white space before any merge, so a text's
ids are the joined ids of its words (for the byte-level file, with the one
space before them).  Words repeat: each worker encodes a word once with the
tokenizers library and keeps its ids in a bounded table keyed by a 64-bit hash.
Texts with unusual white space or control characters, with the string of a special token, or with anything
but one space or line feed between words, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siteline.llm import text as T

#: Words kept by a worker (about 20 bytes each) before it starts anew.
CACHE_WORDS = 4_000_000
_UNUSUAL = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
_SALT = np.uint64(0x5851F42D4C957F2D)


class Encoder:
    """Ids of whole texts, word by word where that is proven to be the same."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        self.unusual = re.compile("|".join([_UNUSUAL.pattern, *map(re.escape, special)]))
        self.bytewise = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        #: A separator that always makes one id of its own, and that no word holds.
        self.mark = "\n" if self.bytewise else " \x01 "
        (self.mark_id,) = self.whole(self.mark)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.low, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Encodes new words (sorted by key), many in one call of the library."""
        odd = {k for k, x in enumerate(new) if self.unusual.search(x)}  # could run into the marks beside them
        plain = [x for k, x in enumerate(new) if k not in odd]
        joined = [self.mark.join(plain[k : k + 32]) + self.mark for k in range(0, len(plain), 32)]
        made = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.array([x for m in made for x in m.ids], np.uint32)
        ends = np.flatnonzero(flat == self.mark_id)
        if len(ends) != len(plain):
            raise ValueError("the tokenizer doesn't keep words apart")
        if odd:  # words of texts that are encoded whole: no ids are kept for them
            ends = np.insert(ends, [k - n for n, k in enumerate(sorted(odd))], -1)
            ends = np.maximum.accumulate(ends)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        lows = np.minimum(np.concatenate([[0], ends[:-1] + 1]), np.maximum(ends, 0))
        to = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, to, np.arange(len(self.low), len(self.low) + len(new)))
        self.keys = np.insert(self.keys, to, keys)
        self.low = np.concatenate([self.low, self.used + lows])
        self.length = np.concatenate([self.length, np.maximum(ends - lows, 0).astype(np.int32)])
        self.used += len(flat)

    def _slice(self, w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice's documents, their bounds, and which documents this doesn't hold for."""
        n = len(w.starts)
        gap = np.zeros(n, np.int64)
        gap[1:] = w.starts[1:] - w.ends[:-1]
        opens = w.bounds[:-1][w.counts > 0]
        gap[opens] = w.starts[opens] - w.doc_bytes[:-1][w.counts > 0]
        odd = np.add.reduceat(np.append(gap > 1, False), np.minimum(w.bounds[:-1], n)) > 0
        odd &= w.counts > 0
        odd[w.counts == 0] = np.diff(w.doc_bytes)[w.counts == 0] > 0
        closes = w.bounds[1:][w.counts > 0] - 1
        full = np.flatnonzero(w.counts > 0)
        odd[full] |= (w.ends[closes] != w.doc_bytes[1:][full]) | (gap[opens] > 0)
        before = w.data[np.maximum(w.starts - 1, 0)] if n else w.data[:0]
        spaced = (before == 32) & (gap > 0) & self.bytewise
        lined = (before == 10) & (gap > 0)
        keys = np.where(spaced, T.mix(w.hashes ^ _SALT), w.hashes)
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHE_WORDS:
            self.forget()
        found = np.searchsorted(self.keys, uniq)
        if len(self.keys):
            found[found == len(self.keys)] = 0
            new = self.keys[found] != uniq
        else:
            new = np.ones(len(uniq), bool)
        if new.any():
            some = first[new]
            raw = w.data.tobytes()
            lows = (w.starts[some] - spaced[some]).tolist()
            self.learn(uniq[new], [raw[a:b].decode() for a, b in zip(lows, w.ends[some].tolist(), strict=True)])
            found = np.searchsorted(self.keys, uniq)
        which = self.at[found]
        low, length = self.low[which][back], self.length[which][back].astype(np.int64)
        lines = lined.astype(np.int64) if self.bytewise else np.zeros(n, np.int64)
        size = np.concatenate([[0], np.cumsum(length + lines)])
        total = int(size[-1])
        out = np.full(total, self.mark_id, np.uint32)
        to = size[:-1] + lines
        step = np.repeat(low - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        put = np.repeat(to - (np.cumsum(length) - length), length) + np.arange(len(step))
        out[put] = self.pool[step]
        return out, size[w.bounds], odd

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each whole text of an Arrow column; null is empty."""
        column = T.large(column)
        for w in T.words(column, slice_bytes=2 << 20):
            usual = self.unusual.search(w.data.tobytes().decode()) is None
            out, bounds, odd = self._slice(w)
            for d in range(w.n_docs):
                if odd[d] or not usual and self.unusual.search(t := column[w.first + d].as_py()):
                    t = column[w.first + d].as_py()
                    yield self.whole(t) if t else np.empty(0, np.uint32)
                else:
                    yield out[bounds[d] : bounds[d + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer file (a name of the public set, or a path)."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(name)
    return _encoders[name]


def release() -> None:
    """Drops the worker's encoder and its words: a worker outlives its stage, and the next may need the memory."""
    _encoders.clear()
