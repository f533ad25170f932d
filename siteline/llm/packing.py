"""Vector bin packing of token sequences.

Every piece is a vector (tokens, segments, loss-bearing tokens) and every open
sequence holds what is left of its limits.  A piece goes to the open sequence
that it fits whole with the largest dot product of demand and remaining room,
each measured in parts of the limit.  Where none has room, the sequence with
the largest product takes what it can, and the rest of the piece goes on;
documents longer than a sequence fill whole sequences first.  When a task's
documents end, each open sequence is cut into lengths that are powers of two.

Each task packs its own documents, so nothing is shuffled and a task holds
``OPEN`` sequences at most; sequence ids carry the task's number in their
upper bits.  A null text is empty: it has its end id only.  Repeated rows are packed
each on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm.encode import encoder

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
#: Tokens of a sequence that may bear loss.  A document's first token bears none, so a sequence of one
#: document's middle reaches this limit first, others the tokens or the segments.
MAX_LOSS = 2040
#: Sequences that a task keeps open.
OPEN = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


class Packer:
    """Packs pieces one by one; ``emit(piece, sequence, offset)`` gets each when its sequence is closed."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, open_: int = OPEN, cut: bool = True):
        self.limit = np.array([max_tokens, max_segments, max_loss], np.int64)
        self.left = np.zeros((open_, 3), np.int64)
        self.held: list[list[tuple]] = [[] for _ in range(open_)]
        self.live = np.zeros(open_, bool)
        self.cut, self.done, self.sequences = cut, [], 0

    def _close(self, b: int) -> None:
        self.done.append(self.held[b])
        self.held[b], self.live[b] = [], False

    def _open(self) -> int:
        if self.live.all():  # the fullest makes room
            self._close(int(np.argmin(self.left[:, 0])))
        b = int(np.argmin(self.live))
        self.live[b], self.left[b] = True, self.limit
        return b

    def _put(self, b: int, piece: tuple, n: int, loss: int) -> None:
        self.held[b].append(piece)
        self.left[b] -= (n, 1, loss)
        if (self.left[b] == 0).any():
            self._close(b)

    def add(self, doc: object, n: int, unscored: int, payload: object = None) -> None:
        """A document of ``n`` tokens whose first ``unscored`` bear no loss."""
        at = 0
        while at < n:
            rest = n - at
            loss = rest - min(max(unscored - at, 0), rest)
            if not self.cut and (rest > self.limit[0] or loss > self.limit[2]):
                raise ValueError("the document is longer than a sequence and cutting is off")
            if rest >= self.limit[0] and not self.live.all():
                b = -1
            else:
                need = np.minimum([rest, 1, loss], self.limit)
                score = np.where(self.live, ((self.left / self.limit) * (need / self.limit)).sum(1), -1.0)
                fits = (self.left >= need).all(1) & self.live
                b = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else -1
                if b < 0 and self.cut and self.live.all():
                    room = self.live & (self.left[:, 2] > 0)
                    b = int(np.argmax(np.where(room, score, -1.0))) if room.any() else -1
            if b < 0:
                b = self._open()
            take = int(min(rest, self.left[b, 0]))
            free = min(max(unscored - at, 0), take)
            if take - free > self.left[b, 2]:
                take = int(free + self.left[b, 2])
            if take <= 0:
                self._close(b)
                continue
            self._put(b, (doc, at, take, payload), take, take - min(free, take))
            at += take

    def finish(self) -> None:
        """Cuts what is open into sequences of powers of two."""
        for b in np.flatnonzero(self.live):
            pieces, self.held[b] = self.held[b], []
            self.live[b] = False
            n = sum(p[2] for p in pieces)
            if not self.cut or n == self.limit[0]:
                self.done.append(pieces)
                continue
            k = 0
            for bit in range(n.bit_length() - 1, -1, -1):
                room, own = n & 1 << bit, []
                while room:
                    doc, at, length, payload = pieces[k]
                    take = min(room, length)
                    own.append((doc, at, take, payload))
                    room -= take
                    if take == length:
                        k += 1
                    else:
                        pieces[k] = (doc, at + take, length - take, payload)
                if own:
                    self.done.append(own)

    def closed(self) -> Iterator[tuple[int, int, tuple]]:
        """(sequence, offset, piece) of the sequences closed since the last call."""
        for pieces in self.done:
            offset = 0
            for p in pieces:
                yield self.sequences, offset, p
                offset += p[2]
            self.sequences += 1
        self.done = []


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, with_ids: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) cut into pieces and placed; a row a piece, with its ids if asked."""
    store.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(max_tokens, max_segments, max_loss), TaskContext.get().partitionId() << 40
        own = encoder(tokenizer)

        def rows() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for sequence, offset, ((doc, ids), at, n, _) in packer.closed():
                raw = ids[at : at + n].astype("<u4", copy=False).tobytes()
                for c, x in zip(cols, (doc, at, n, zlib.crc32(raw), len(ids), base | sequence, offset, n - (at == 0), raw if with_ids else None), strict=True):
                    c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.batch(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                packer.add((doc, ids), len(ids), 1)
            if packer.done:
                yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store.trimmed(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(store.documents(spark, sf_dir), "word_bpe_49k.json", 1, with_ids=False).drop("ids")


QUERIES = {"op9_packing": query}
