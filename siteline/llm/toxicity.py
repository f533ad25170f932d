"""Convolutional toxicity classifier, trained in numpy.

A lower-cased word (a run of letters and digits) is the sum of rows of hashed embedding tables: of the
word and of its beginnings of ``STEMS`` code points, so that an inflected form nobody has labelled is known by
its stem.  Filters of several widths run over the words of a text, each keeps its largest response
(max pooling, after a rectifier), and a logistic layer scores them.  Training reads
every labelled document: they are dealt into shards by a hash of their id, a task trains on a shard from the
model that all share, and what the shards changed is averaged by Spark, ``ROUNDS`` times (once where all is one
run).  A row of the tables is averaged over the runs that changed it, so that a word of one shard is learned in full.
A shard is held in runs of ``TRAIN_WORDS`` words at most; where its words are more than the bound, the longest documents of either
kind wait for the next run, and one over the bound makes its own.  Changes are added up as integers, so
that the model depends on no order or number of tasks; it has a fixed size, and no document reaches the driver.
A word or stem that ``n`` training documents hold counts ``n / (n + PRIOR)`` of its vector: less the fewer they are, as
a word of one document tells little of another, and nothing where none holds it.
While it trains, each document leaves out a share ``DROPOUT`` of its words, so that no single word carries it.
A fifth of the labelled documents, by a hash of their id, is left out of training, and all of it calibrates a threshold for each language.

Scores depend on the text alone.  A null or empty text has the score of no
words.  Rows that share a doc_id are learned from once, with one of their texts, the same each time.  Without labelled rows of both kinds every score is 0.  A language, cast to a string, with fewer than
``MIN_CALIBRATION`` labelled documents of either kind has the threshold 0.5.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from siteline.llm import blocks, encode, store
from siteline.llm import text as T
from siteline.llm.quality import add_vectors

#: Documents of a shard on average, and words that a task holds at once.
TRAIN_ROWS = 6000
TRAIN_WORDS = 3_000_000
#: Times that the shards' models are averaged.
ROUNDS = 3
MIN_CALIBRATION = 20
#: Documents that a word's evidence is weighed against.
PRIOR = 2
STEMS = (4, 6)
DROPOUT = 0.2
KNOWN = 1 << 20
ROWS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Batches trained on, in whole passes over a run: 5 to 40 in all rounds.
STEPS = 800
BATCH = 32
RATE = 0.05
#: Changes are added up in units of 1 / _UNIT.
_UNIT = float(1 << 30)
_CHUNK = 1 << 16
#: Bits, at most, by which documents without a label are left where they are.
_MARKS = 1 << 26
#: Bytes of an Arrow batch of changes.
_BATCH_BYTES = 8 << 20


@dataclass
class Model:
    tables: np.ndarray  #: 2 x ROWS x DIM
    filters: list[np.ndarray]  #: by width: (width * DIM) x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    known: np.ndarray  #: the share of its vector that each of KNOWN hashed words counts
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, features: np.ndarray) -> np.ndarray:
        """The vectors of words, given by their ``features``."""
        out = np.zeros((len(features), DIM), np.float32)
        for j in range(features.shape[1]):
            own = features[:, j]
            share = self.known[slots(own)]
            some = np.flatnonzero(share)
            a, b = rows(own[some])
            out[some] += (self.tables[0][a] + self.tables[1][b]) * share[some, None]
        return out

    def pooled(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each document."""
        n_docs, x = len(bounds) - 1, self.embed(words)
        out = np.zeros((n_docs, FILTERS * len(WIDTHS)), np.float32)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for k, width in enumerate(WIDTHS):
            n = len(words) - width + 1
            if n <= 0:
                continue
            y = sum(x[j : j + n] @ self.filters[k][j * DIM : (j + 1) * DIM] for j in range(width))
            if width > 1:
                y[np.arange(n) + width > ends[:n]] = -1e9
            full = np.flatnonzero((np.diff(bounds) > 0) & (bounds[:-1] < n))
            if len(full):
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, bounds[:-1][full]) + self.biases[k], 0)
        return out

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.pooled(words, bounds) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def features(w: T.Words) -> np.ndarray:
    """Hashes, of 32 bits, of each word and its beginnings."""
    first = np.flatnonzero((w.data & 0xC0) != 0x80)  # code points
    rank = np.searchsorted(first, w.starts)
    at = np.append(first, len(w.data))
    out = [w.hashes]
    for n in STEMS:
        end = np.minimum(at[np.minimum(rank + n, len(first))], w.ends)
        out.append(T.mix(T.span_hashes(w.data, w.starts, end) + np.uint64(n)))
    return np.stack(out, 1).astype(np.uint32)


def slots(own: np.ndarray) -> np.ndarray:
    """Which of ``KNOWN`` places has the share of a feature."""
    return (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def rows(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature's row in either table."""
    return (own & np.uint32(ROWS - 1)).astype(np.int64), (own >> np.uint32(16)).astype(np.int64)


def fresh(seed: int = 11) -> Model:
    r = np.random.default_rng(seed)
    filters = [(r.normal(size=(w * DIM, FILTERS)) * (2 / (w * DIM)) ** 0.5).astype(np.float32) for w in WIDTHS]
    tables = (r.normal(size=(2, ROWS, DIM)) * 0.02).astype(np.float32)
    return Model(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (r.normal(size=FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0, np.ones(KNOWN, np.float32))


def sums_before(m: Model) -> Model:
    """The sums of squared gradients that a model starts with, in its shape."""
    full = lambda x, v: np.full(x.shape, v, np.float32)
    return Model(full(m.tables, 1e-2), [full(f, 1e-1) for f in m.filters], [full(b, 1e-1) for b in m.biases], full(m.out, 1e-1), 1e-1, m.known[:0])


def begun(n_docs: np.ndarray, share: float, seed: int = 11) -> Model:
    """A model before training: by the documents that hold each of ``KNOWN`` words, and the share of toxic ones."""
    m = fresh(seed)
    m.known = (n_docs / (n_docs + PRIOR)).astype(np.float32)
    prior = float(np.clip(share, 0.01, 0.99))
    m.bias = float(np.log(prior / (1 - prior)))
    return m


def passes(n_docs: int) -> int:
    return int(np.clip(-(-STEPS * BATCH // n_docs), 5, 40))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """A model of documents that one task holds."""
    held = [np.unique(slots(t.ravel())) for t in texts]
    m = begun(np.bincount(np.concatenate(held), minlength=KNOWN), labels.mean(), seed)
    descend(m, sums_before(m), *numbered(list(texts)), labels, passes(len(texts)), np.random.default_rng(seed))
    return m


def distinct(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words among ``features``, and which of them each is."""
    _, one, word = np.unique(own[:, 0].astype(np.uint64) << np.uint64(32) | own[:, -1], return_index=True, return_inverse=True)
    return own[one], word.astype(np.int32)


def numbered(texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vocabulary of documents, and each as numbers of its words.  About ``_CHUNK`` words are sorted at once, then what they have in common.

    Takes the documents out of ``texts``, so that they aren't held twice.
    """
    parts, words, ends = [], [], []
    texts.reverse()
    while texts:
        some, size = [], 0
        while texts and (not some or size + len(texts[-1]) <= _CHUNK):
            some.append(texts.pop())
            size += len(some[-1])
        ends.append(np.cumsum([len(t) for t in some]))
        for kept, x in zip((parts, words), distinct(np.concatenate(some)), strict=True):
            kept.append(x)
    vocabulary, place = distinct(np.concatenate(parts))
    places = np.split(place, np.cumsum([len(x) for x in parts])[:-1])
    return vocabulary, [x for p, w, e in zip(places, words, ends, strict=True) for x in np.split(p[w], e[:-1])]


def descend(m: Model, seen: Model, vocabulary: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, n_passes: int, r: np.random.Generator) -> None:
    """Adagrad over batches of ``numbered`` documents; a filter's gradient goes to the window that won the pooling.  Changes ``m`` and ``seen``."""
    share = m.known[slots(vocabulary)][..., None]
    places = np.stack(rows(vocabulary))
    part = [(k, j) for k, width in enumerate(WIDTHS) for j in range(width)]
    for _ in range(n_passes):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            own = [texts[i][r.random(len(texts[i])) >= DROPOUT] for i in pick]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            here = np.zeros(len(vocabulary), bool)
            here[np.concatenate(own)] = True
            words = np.flatnonzero(here)
            local = np.empty(len(vocabulary), np.int32)
            local[words] = np.arange(len(words))
            at_word = local[np.concatenate(own)]
            # a word's vector and its response to each row of the filters, once a batch
            x = ((m.tables[0][places[0, words]] + m.tables[1][places[1, words]]) * share[words]).sum(1)
            y_word = {(k, j): x @ m.filters[k][j * DIM : (j + 1) * DIM] for k, j in part}
            pooled = np.zeros((len(pick), FILTERS * len(WIDTHS)), np.float32)
            where = np.full(pooled.shape, -1)
            for k, width in enumerate(WIDTHS):
                n, span = len(at_word) - width + 1, slice(k * FILTERS, (k + 1) * FILTERS)
                if n <= 0:
                    continue
                y = y_word[k, 0][at_word[:n]]
                for j in range(1, width):
                    y += y_word[k, j][at_word[j : j + n]]
                for d, (first, end) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - width + 1).tolist(), strict=True)):
                    if first < end:
                        best = y[first:end].argmax(0) + first
                        pooled[d, span] = np.maximum(y[best, np.arange(FILTERS)] + m.biases[k], 0)
                        where[d, span] = best
            z = pooled @ m.out + m.bias
            gap = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
            back = np.where((pooled > 0) & (where >= 0), gap[:, None] * m.out[None, :], 0)
            g_out, g_bias = pooled.T @ gap, float(gap.sum())
            hits: list[np.ndarray] = []
            hit_grads: list[np.ndarray] = []
            for k, width in enumerate(WIDTHS):
                d, f = np.nonzero(back[:, k * FILTERS : (k + 1) * FILTERS])
                if not len(d):
                    continue
                g, at = back[d, k * FILTERS + f], where[d, k * FILTERS + f]
                g_filter = np.zeros_like(m.filters[k])
                to = (f[None, :] == np.arange(FILTERS)[:, None]) * g
                for j in range(width):
                    hit = at_word[at + j]
                    g_filter[j * DIM : (j + 1) * DIM] = (to @ x[hit]).T
                    hits.append(words[hit])
                    hit_grads.append(g[:, None] * m.filters[k][j * DIM : (j + 1) * DIM].T[f])
                seen.filters[k] += g_filter**2
                m.filters[k] -= RATE * g_filter / np.sqrt(seen.filters[k])
                g_b = np.bincount(f, g, FILTERS).astype(np.float32)
                seen.biases[k] += g_b**2
                m.biases[k] -= RATE * g_b / np.sqrt(seen.biases[k])
            if hits:
                hit = np.concatenate(hits)
                grads = (np.concatenate(hit_grads)[:, None, :] * share[hit]).reshape(-1, DIM)
                for t in range(2):
                    uniq, back_ = np.unique(places[t, hit].ravel(), return_inverse=True)
                    total = np.zeros((len(uniq), DIM), np.float32)
                    np.add.at(total, back_, grads)
                    seen.tables[t][uniq] += total**2
                    m.tables[t][uniq] -= RATE * total / np.sqrt(seen.tables[t][uniq])
            seen.out += g_out**2
            m.out -= RATE * g_out / np.sqrt(seen.out)
            seen.bias += g_bias**2
            m.bias -= RATE * g_bias / seen.bias**0.5


def dense(m: Model) -> np.ndarray:
    """All of a model but its tables."""
    return np.concatenate([*(f.ravel() for f in m.filters), *m.biases, m.out, [m.bias]]).astype(np.float64)


def set_dense(m: Model, values: np.ndarray) -> None:
    at = 0
    for x in [*m.filters, *m.biases, m.out]:
        x[...] = values[at : at + x.size].reshape(x.shape)
        at += x.size
    m.bias = float(values[at])


def _lang(docs: DataFrame):
    """The language as a string; null without such a column, or where it isn't a plain value."""
    plain = "lang" in docs.columns and isinstance(docs.schema["lang"].dataType, AtomicType)
    return F.col("lang").cast("string").alias("lang") if plain else F.lit(None).cast("string").alias("lang")


def fitting(words: np.ndarray, toxic: np.ndarray, most: int) -> np.ndarray:
    """Which documents make the next run, by their number of words: all if they fit, else the shortest of each kind."""
    keep = np.zeros(len(words), bool)
    kinds = sorted((np.flatnonzero(toxic == k) for k in (0, 1)), key=lambda own: words[own].sum())
    for own, room in zip(kinds, (most // 2, most), strict=True):  # the kind with fewer words first
        own = own[np.argsort(words[own], kind="stable")]
        keep[own] = np.cumsum(words[own]) <= room - words[keep].sum()
    return keep


def _bit(n: int):
    """Which of ``n`` bits a document's id has."""
    return F.pmod(F.xxhash64(F.lit("labelled"), F.col("doc_id").cast("long")), F.lit(n))


def marks(own: DataFrame, n_rows: int) -> np.ndarray:
    """Bytes of bits, set where ``own`` has a document: at least 16 a row while ``_MARKS`` allow it, a fixed size beyond."""
    n = 1 << int(np.clip((16 * n_rows).bit_length(), 15, _MARKS.bit_length() - 1))
    at = own.select(_bit(n).alias("at"))
    out = np.zeros((n >> 15, 1 << 12), np.uint8)
    for r in at.groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("bits")).collect():
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def packed(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """doc_id, lang and the text, compressed before it moves, of the documents that ``marked`` covers, and of a few others with their bits."""
    store.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, marked = pa.Codec("zstd"), sent.value
        for batch in batches:
            at = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((marked[at >> 3] >> (at & 7) & 1).astype(bool)))
            texts = (x.as_buffer() or b"" for x in batch.column(1).cast(pa.large_binary()))
            out = [len(x).to_bytes(8, "big") + codec.compress(x, asbytes=True) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "lang", "packed"])

    return docs.select(F.col("doc_id").cast("long"), "text", _lang(docs), _bit(8 * len(marked)).alias("at")).mapInArrow(store.trimmed(run), "doc_id long, lang string, packed binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """shard, toxic, lang and the words' features of each row of ``dealt``, in workers that keep no tokenizer of an earlier stage."""
    encode.release()
    codec = pa.Codec("zstd")
    for batch in batches:
        rows_ = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        raw = (x.as_py() for x in batch.column(3))
        texts = pa.array([codec.decompress(x[8:], int.from_bytes(x[:8], "big"), asbytes=True) for x in raw], pa.large_binary()).cast(pa.large_string())
        for w in T.words(texts, lower=True, space=T.MARKS):
            own = features(w)
            for d in range(w.n_docs):
                yield *rows_[w.first + d], own[w.bounds[d] : w.bounds[d + 1]]


def runs(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """shard, texts and labels of each run: all documents of a shard, ``max_words`` words at a time unless one alone has more."""
    shard, texts, toxic, words = None, [], [], 0

    def cut() -> tuple[int, list[np.ndarray], np.ndarray]:
        nonlocal texts, toxic, words
        size, own = np.array([len(t) for t in texts]), np.array(toxic)
        keep = fitting(size, own, max_words)
        if not keep.any():
            keep[size.argmax()] = True
        run = shard, [t for t, k in zip(texts, keep, strict=True) if k], own[keep]
        texts, toxic = [t for t, k in zip(texts, keep, strict=True) if not k], own[~keep].tolist()
        words = int(size[~keep].sum())
        return run

    for s, y, _, own in opened(batches):
        while texts and (s != shard or words > max_words):
            yield cut()
        shard = s
        texts.append(own.copy())
        toxic.append(y)
        words += len(own)
    while texts:
        yield cut()


def dealt(docs: DataFrame, labels: DataFrame, max_rows: int, max_words: int) -> DataFrame:
    """shard, toxic, lang, packed and held of every document that ``labels`` covers; a shard is the rows of one partition, in order.

    The labelled texts are exchanged once: they meet their labels in the shards.  Kept on the executors'
    disks until ``unpersist``: each round reads it in the same parts.
    """
    some = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), "toxic")
    toxic = lambda df, *keys: df.groupBy(*keys).agg(F.max("toxic").cast("int").alias("toxic"))
    size = docs.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    each = int(np.clip(5 * max_words * (size[0] or 1) // (size[1] or 1), min(512, max_rows), max_rows))  # a shard of texts of common length is one run
    n_rows = toxic(some, "doc_id").count()
    n = store.parts(n_rows, each)
    hashed = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(n)).cast("int")
    shards = lambda df: df.withColumn("shard", hashed("toxicity", n)).repartitionById(n, "shard")
    keys = "shard", "doc_id"
    texts = shards(packed(docs, marks(toxic(some, "doc_id"), n_rows)))
    one = texts.join(toxic(shards(some), *keys), [*keys]).groupBy(*keys, "toxic").agg(F.min("packed").alias("packed"), F.min("lang").alias("lang"))
    named = one.select("shard", "toxic", "lang", "packed", (hashed("held", 5) == 4).alias("held"), "doc_id")
    return named.sortWithinPartitions("shard", "doc_id").drop("doc_id").persist(StorageLevel.DISK_ONLY)


def _chunks(values: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows for ``add_vectors``, from key ``first``; chunks of zeros are left out."""
    for k, lo in enumerate(range(0, len(values), _CHUNK)):
        if values[lo : lo + _CHUNK].any():
            yield first + k, values[lo : lo + _CHUNK]


def _emitted(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([v.tobytes() for _, v in parts], pa.binary())], ["key", "counts"])


def _whole(got: dict[int, np.ndarray], first: int, size: int) -> np.ndarray:
    """What ``_chunks`` took apart, added up."""
    out = np.zeros(size, np.int64)
    for k, lo in enumerate(range(0, size, _CHUNK)):
        if first + k in got:
            out[lo : lo + _CHUNK] = got[first + k]
    return out


def counted(rows_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by ``KNOWN`` words; documents of either kind and words in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, all_ = np.zeros(KNOWN, np.int64), np.zeros(3, np.int64)
        for _, y, _, own in opened(batches):
            docs[np.unique(slots(own.ravel()))] += 1
            all_[y] += 1
            all_[2] += len(own)
        yield _emitted([*_chunks(docs, 0), *_chunks(all_, KNOWN)])

    got = add_vectors(rows_.mapInArrow(store.trimmed(count), "key int, counts binary"))
    return _whole(got, 0, KNOWN), _whole(got, KNOWN, 3)


def weighed(n: int, values: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """``_chunks`` of what a run of ``n`` documents changed, with half the digits that their sum has."""
    for key, part in _chunks(values.astype(np.float32), first):
        yield key, np.concatenate([np.array([n], np.float32), part])


def weighted(raw: bytes) -> np.ndarray:
    """A chunk of ``weighed`` times its run's documents, in units of 1 / _UNIT."""
    v = np.frombuffer(raw, np.float32).astype(np.float64)
    return np.rint(v[1:] * (v[0] * _UNIT)).astype(np.int64)


def advanced(rows_: DataFrame, m: Model, seen: Model, k: int, n_rounds: int, max_words: int) -> None:
    """Round ``k``: every run is trained on from ``m``, which then moves by their mean change, weighed by documents.

    4 MB of tables and 4 MB of sums are sent out and come back, whatever the input.
    """
    sent = rows_.sparkSession.sparkContext.broadcast(pickle.dumps((m, seen)))
    size, flat = m.tables.size, len(dense(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = pickle.loads(sent.value)
        last, nth = None, 0
        for shard, texts, toxic in runs(batches, max_words):
            last, nth = shard, nth + 1 if shard == last else 0
            own, n = copy.deepcopy(start), len(texts)
            descend(*own, *numbered(texts), toxic, passes(n) * (k + 1) // n_rounds - passes(n) * k // n_rounds, np.random.default_rng([11, k, shard, nth]))
            touched = np.any([(x.tables != was.tables).any(-1) for x, was in zip(own, start, strict=True)], 0)  # a change can be too small for its square to show
            for x, was in zip(own, start, strict=True):
                x.tables -= was.tables
            rest = np.concatenate([dense(x) - dense(was) for x, was in zip(own, start, strict=True)])
            for j, x in enumerate([own[0].tables, own[1].tables, rest, touched, np.ones(1)]):
                for part in weighed(n, x.ravel(), 1000 * j):
                    yield _emitted([part])

    got = add_vectors(rows_.mapInArrow(store.trimmed(run), "key int, counts binary"), weighted)
    sent.destroy()
    touched, n_docs = np.maximum(_whole(got, 3000, 2 * ROWS), 1), max(1, int(_whole(got, 4000, 1)[0]))
    for j, (x, rest) in enumerate(zip((m, seen), _whole(got, 2000, 2 * flat).reshape(2, flat), strict=True)):
        tables = _whole(got, 1000 * j, size).reshape(2 * ROWS, DIM)
        x.tables += (tables / touched[:, None]).astype(np.float32).reshape(x.tables.shape)
        set_dense(x, dense(x) + rest / n_docs)


def calibrated(rows_: DataFrame, m: Model) -> dict[str, float]:
    """By language, the edge of the highest accuracy over all rows, the nearest to 0.5 among equals."""
    edges = np.round(np.arange(0.05, 0.96, 0.05), 2)
    edges = edges[np.argsort(np.abs(edges - 0.5), kind="stable")].tolist()
    sent = rows_.sparkSession.sparkContext.broadcast(pickle.dumps(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            got = [(lang, y, own.scores(x, np.array([0, len(x)]))[0]) for _, y, lang, x in opened(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "toxic", "score"])

    scores = rows_.filter("lang is not null").mapInArrow(store.trimmed(run), "lang string, toxic int, score double")
    right = [F.count_if((F.col("score") >= e) == (F.col("toxic") == 1)).alias(f"e{k}") for k, e in enumerate(edges)]
    out = scores.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"), *right).filter(F.least("pos", "neg") >= MIN_CALIBRATION).collect()
    sent.destroy()
    return {r["lang"]: edges[int(np.argmax([r[f"e{k}"] for k in range(len(edges))]))] for r in out}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_words: int = TRAIN_WORDS) -> Model | None:
    """Trains on all documents that ``labels`` (doc_id, toxic) covers; None without labels of both kinds.

    ``max_rows`` documents make a shard, and a task holds ``max_words`` words at once: neither leaves anything out.
    """
    spark, size = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    all_, usual = dealt(docs, labels, max_rows, max_words), spark.conf.get(size)
    spark.conf.set(size, str(_BATCH_BYTES))
    try:
        rest, own = all_.filter("held"), all_.filter("not held")
        n_docs, (clean, toxic, words) = counted(own.drop("held"))
        if not clean or not toxic:
            rest, own = None, all_
            n_docs, (clean, toxic, words) = counted(own.drop("held"))
        if not clean or not toxic:
            return None
        m = begun(n_docs, toxic / (clean + toxic))
        seen = sums_before(m)
        n_rounds = 1 if clean + toxic <= max_rows and words <= max_words else ROUNDS
        for k in range(n_rounds):
            blocks.free(spark)  # what the last round exchanged
            advanced(own.drop("held"), m, seen, k, n_rounds, max_words)
        if rest is not None:
            m.thresholds = calibrated(rest.drop("held"), m)
        return m
    finally:
        spark.conf.set(size, usual)
        all_.unpersist()
        blocks.free(spark)  # what the last round exchanged, before all texts are scored
        store.trim()


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang and score of every whole text, and whether its language's threshold rejects it.

    The model has a fixed size (4 MB), whatever the input.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    thresholds = model.thresholds if model else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            if own is None:
                out = [np.zeros(batch.num_rows)]
            else:
                out = [own.scores(features(w), w.bounds) for w in T.words(batch.column(2), lower=True, space=T.MARKS)]
            score = np.concatenate(out) if out else np.empty(0)
            edge = np.array([thresholds.get(x, 0.5) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(score >= edge)], ["doc_id", "lang", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), _lang(docs), "text").mapInArrow(store.trimmed(run), "doc_id long, lang string, score double, rejected boolean")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns; rows are filtered where they are read."""
    store.small_batches(docs.sparkSession)
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    thresholds = model.thresholds if model else {}
    named = docs.withColumn(store.unused(docs.columns, "lang"), _lang(docs))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            if own is not None and batch.num_rows:
                score = np.concatenate([own.scores(features(w), w.bounds) for w in T.words(batch.column(text), lower=True, space=T.MARKS)])
                batch = batch.filter(pa.array(score < np.array([thresholds.get(x, 0.5) for x in batch.column(batch.num_columns - 1).to_pylist()])))
            yield batch.select(range(batch.num_columns - 1))

    return store.mapped(named, run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The rows that the query learns from."""
    return labels.filter(store.fold() != 0).select("doc_id", "toxic")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir, "doc_id", "lang", "text")
    model = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs, model).select(
        "doc_id", (store.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected"
    )


QUERIES = {"op3_toxicity": query}
