"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Every routine
works on the UTF-8 buffer of an Arrow batch with numpy, so that no Python
object is made per word.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word pattern, for Python ``re`` and Spark SQL alike.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Bytes of text handled at once; a longer single document makes its own slice.
SLICE_BYTES = 1 << 18
_SEGMENT = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For ``words(space=...)``: everything in ASCII but letters and digits parts words.
MARKS = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_FACTORS = 1 << 16
_factors: list[np.ndarray] = [np.empty(0, np.uint64)] * 2
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, mod 2**64, of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def factors(place: np.ndarray, which: int) -> np.ndarray:
    """A fixed pseudo-random odd factor for each place in a string, of one of two sequences."""
    if not len(_factors[which]):
        k = np.arange(1, _FACTORS + 1, dtype=np.uint64) * np.uint64(_BASE)
        _factors[which] = mix(k + np.uint64(0xD1B54A32D192ED03 * (which + 1) & (1 << 64) - 1)) | np.uint64(1)
    own = _factors[which]
    if place.max(initial=0) < _FACTORS:
        return own[place]
    return own[place % _FACTORS] * (mix((place // _FACTORS).astype(np.uint64) * np.uint64(_BASE | 2)) | np.uint64(1))


@dataclass
class Words:
    """The words of consecutive documents ``first .. first + len(bounds) - 2`` of a batch."""

    first: int
    data: np.ndarray  #: the documents' bytes (A-Z lowered if asked)
    doc_bytes: np.ndarray  #: byte bounds of the documents in ``data``
    starts: np.ndarray  #: byte start of each word
    ends: np.ndarray  #: byte end of each word
    hashes: np.ndarray  #: uint64 of each word
    bounds: np.ndarray  #: word bounds of the documents

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """The document, from 0 within the slice, of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def gram_starts(self, k: int) -> np.ndarray:
        """Word positions at which ``k`` words of one document begin."""
        ends = np.repeat(self.bounds[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.hashes)) + k <= ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; the spans are in order and don't overlap.

    Multilinear: every byte is multiplied by the factor of its place in the span.  Unlike powers of
    one base, the factors are unrelated, so that no pair of strings is known to collide.  Two sequences
    (``which``) make 128 bits.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _SEGMENT)))
        top = int(ends[to - 1])
        s, e = starts[at:to] - base, ends[at:to] - base
        reach = np.diff(np.append(s, top - base))
        place = np.arange(top - base) - np.repeat(s, reach)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * factors(place, which), out=sums[1:])
        out[at:to] = sums[e] - sums[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)
        at = to
    return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive word hashes (document ends not regarded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(_BASE | 2)
    if k <= 6:
        for j in range(k):
            out = out * base + hashes[j : j + n]
        return mix(out)
    for lo in range(0, n, _SEGMENT):
        part = hashes[lo : min(n, lo + _SEGMENT) + k - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        m = len(part) - k + 1
        out[lo : lo + m] = (sums[k : k + m] - sums[:m]) * down[:m]
    return mix(out)


def large(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_string())


def words(column: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a string column, some documents at a time."""
    column = large(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        to = min(to, n)
        cut = offsets[at : to + 1] - offsets[at]
        data = raw[offsets[at] : offsets[to]]
        if lower:
            data = _FOLD[data]
        full = ~space[data]
        first, last = full.copy(), full.copy()
        if len(data):
            first[1:] &= ~full[:-1]
            last[:-1] &= ~full[1:]
            inner = cut[(cut > 0) & (cut < len(data))]
            first[inner] |= full[inner]
            last[inner - 1] |= full[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Words(at, data, cut, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, cut))
        at = to


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; empty spans sum to 0."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = ufunc(out[:-have], out[have:])
        have *= 2
    return ufunc(out[:n], out[width - have : width - have + n]) if have < width else out[:n]
