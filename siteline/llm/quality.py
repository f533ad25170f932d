"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Lower-cased words and word pairs are hashed into ``BUCKETS`` counts, once over
every document (raw) and once over the documents labelled good (target).  A
document's score is the mean, over its words and pairs, of the smoothed
log-ratio of the two multinomials.  The threshold is set from the scores of all
labelled documents, as the bin edge that best parts good from bad ones (the
lowest such edge), so that equal input gives equal verdicts.

A null or empty text has no words: score 0, base_failed true.  Documents without a label
count as raw text only; a document with several labels counts as good if one
says so.  Without any bad label the threshold lets every document pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T

BUCKETS = 1 << 17
_CHUNK = 1 << 13
SMOOTHING = 0.5
#: Edges that a threshold is chosen from.
EDGES = np.round(np.arange(-4, 4.0001, 0.01), 2)
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 5
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80


def features(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a slice's words and pairs, and the document of each."""
    doc = w.doc
    pairs = w.gram_starts(2)
    both = T.grams(w.hashes, 2)[pairs] if len(pairs) else w.hashes[:0]
    hashes = np.concatenate([w.hashes, both])
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([doc, doc[pairs]])


def repeated(w: T.Words, width: int = REPEAT_WIDTH) -> np.ndarray:
    """Which words lie in a window of ``width`` words found twice or more in their text."""
    n = len(w.hashes)
    covered = np.zeros(n + 1, np.int64)
    at = w.gram_starts(width)
    if len(at):
        keys = T.grams(w.hashes, width)[at] ^ T.mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return np.cumsum(covered[:n]) > 0


def duplicate_lines(w: T.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, counted by document."""
    out = np.zeros(w.n_docs, np.int64)
    if not len(w.hashes):
        return out
    breaks = np.flatnonzero(w.data == 10)
    starts = np.union1d(breaks + 1, w.doc_bytes[:-1])
    starts = starts[starts < len(w.data)]
    line = np.unique(np.searchsorted(starts, w.starts, "right") - 1)  # with a word
    ends = np.minimum(np.append(starts[1:], len(w.data))[line], _next_break(breaks, starts[line], len(w.data)))
    doc = np.searchsorted(w.doc_bytes, starts[line], "right") - 1
    keys = T.span_hashes(w.data, starts[line], ends) ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    np.add.at(out, doc[again], 1)
    return out


def _next_break(breaks: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    return np.append(breaks, end)[np.searchsorted(breaks, at)]


def counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def add_vectors(parts: DataFrame, read: Callable[[bytes], np.ndarray] = counts) -> dict[int, np.ndarray]:
    """Rows (key, counts), added up by key: tasks add what they ``read`` as it streams; one row a key comes back.

    The tasks compress and pickle their sums, so that the driver's JVM only passes them on: as a DataFrame's rows it would copy and pickle all of them itself.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = read(raw)
                sums[key] = sums[key] + v if key in sums else v
        packed = [pa.Codec("zstd").compress(v.tobytes(), asbytes=True) for v in sums.values()]
        sizes = [v.nbytes for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["key", "size", "packed"])

    rows = parts.repartition(8, "key").mapInArrow(add, "key int, size long, packed binary").rdd.collect()
    return {r["key"]: np.frombuffer(pa.Codec("zstd").decompress(r["packed"], r["size"]), np.int64) for r in rows}


@dataclass
class Model:
    """Log-ratio by bucket; what lies under the threshold is dropped."""

    ratio: np.ndarray
    threshold: float = float("-inf")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all of ``docs`` (doc_id, text); the good ones by ``labels`` (doc_id, quality) are the target."""
    store.small_batches(docs.sparkSession)
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long")).dropna().distinct().withColumn("good", F.lit(True))
    chunks = BUCKETS // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for w in T.words(batch.column(0), lower=True):
                buckets, doc = features(w)
                np.add(sums[0], np.bincount(buckets, minlength=BUCKETS), out=sums[0])
                some = good[w.first : w.first + w.n_docs][doc]
                if some.any():
                    np.add(sums[1], np.bincount(buckets[some], minlength=BUCKETS), out=sums[1])
        rows = [(side * chunks + k, sums[side, k * _CHUNK : (k + 1) * _CHUNK]) for side in (0, 1) for k in range(chunks)]
        rows = [(k, v.tobytes()) for k, v in rows if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["key", "counts"])

    # the labels grow with the documents: merge at every size, rather than broadcast at small ones
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = add_vectors(joined.mapInArrow(count, "key int, counts binary"))
    sums = np.zeros((2, BUCKETS))
    for k, v in found.items():
        sums[k // chunks, k % chunks * _CHUNK : (k % chunks + 1) * _CHUNK] = v
    raw, target = (np.log(s + SMOOTHING) - np.log(s.sum() + SMOOTHING * BUCKETS) for s in sums)
    return Model(target - raw if sums[1].any() else np.zeros(BUCKETS))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counts of the base rules, and the length-normalised log-likelihood ratio."""
    store.small_batches(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)  # BUCKETS doubles: 1 MB at any size
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ratio.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for w in T.words(batch.column(1)):
                low = T.Words(w.first, T._FOLD[w.data], w.doc_bytes, w.starts, w.ends, w.hashes, w.bounds)
                low.hashes = T.span_hashes(low.data, w.starts, w.ends)
                buckets, doc = features(low)
                total = np.bincount(doc, own[buckets], w.n_docs)
                n = np.bincount(doc, minlength=w.n_docs)
                cols[0].append(w.counts)
                cols[1].append(T.per_doc(_STARTS[w.data] & ~T._SPACE[w.data], w.doc_bytes))
                cols[2].append(T.per_doc(_IS_SYMBOL[w.data], w.doc_bytes))
                cols[3].append(duplicate_lines(w))
                cols[4].append(T.per_doc(repeated(w), w.bounds))
                cols[5].append(total / np.maximum(n, 1))
            arrays = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.float64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def choose_threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The lowest edge with the largest (share of bad below - share of good below), over all labelled documents."""
    own = labels.select(F.col("doc_id").cast("long"), "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    slot = F.least(F.greatest(F.floor((F.col("llr") - float(EDGES[0])) / 0.01), F.lit(-1)), F.lit(len(EDGES) - 1))
    rows = scores.join(own, "doc_id").groupBy(slot.cast("int").alias("slot"), "quality").count().collect()
    below = np.zeros((2, len(EDGES) + 1))
    for r in rows:
        below[int(r["quality"] == 1), r["slot"] + 1] += r["count"]
    totals = below.sum(1)
    if not totals.all():
        return float("-inf")
    shares = np.cumsum(below, 1)[:, :-1] / totals[:, None]
    return float(EDGES[int(np.argmax(shares[0] - shares[1]))])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its counts, score, threshold and verdict."""
    model = fit(docs, labels)
    scores = store.written(scored(docs, model), "quality")
    model.threshold = choose_threshold(scores, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scores.select("*", F.lit(model.threshold).alias("threshold"), failed.alias("base_failed"), (~failed & (F.col("llr") >= model.threshold)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


QUERIES = {"op8_quality_llr": query}
