"""Benchmark decontamination: BM25 with block-max WAND over the test items.

The test items are the indexed documents, every passage of the corpus is a
query.  Term weights are BM25 impacts divided by the item's score for itself, so
that a passage's score is the share of an item's weight that it holds, and one
threshold serves items of any length.  As the threshold is fixed, the pivots of
WAND are known beforehand: an item can reach the threshold only in a passage with one of
its essential terms, those left when its lightest terms, together lighter
than the threshold, are set aside.  Postings of essential terms give the pivots and the
essential part of their score.  What the other, light terms may add is bounded once for a passage and a
block of items: the block's maxima of light weights, heaviest first, are taken off where the passage hasn't
the term, and the block is left as soon as what remains can't lift its best pivot to the threshold.  Pivots that their
block's bound lifts are scored in full, and every pair above the threshold is verified by the overlap of
five-word shingles with the item, or with its question: a question is indexed beside its item, weighted
by itself, so that a passage with the question alone is found however long the answer is.  A question
shorter than a shingle doesn't tell by itself and counts only together with the answer.
The score is the share of the item's weight, or of the question's where only that reaches the threshold.

Words are runs of letters and digits, A-Z lowered.  The answer is what follows an
item's last line break, else its last sentence end, else there is none and its
overlap is the question's.  A part with fewer words than a shingle is one shingle.
Items without words, or null, are never found; null or empty documents hold nothing.
An item id that repeats is indexed row by row, and a document has one result row for it; items without an id are
found under a null one.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T

#: Share of an item's BM25 weight that a passage must hold, and of its shingles.
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items in an index block that is sent to the tasks at once; more items make more blocks, scanned one by one.
SHARD_ITEMS = 2048
#: Items that share block maxima, each with its question.
BLOCK_ITEMS = 1
#: A block's terms that are looked for first; each further step takes twice as many.
FIRST_TERMS = 2
LEAST_STRIDE = 64
RESULT = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


@dataclass
class Index:
    terms: np.ndarray  #: sorted word hashes
    items: np.ndarray  #: item id of each unit: first the whole items, then those questions that are less than their item
    nameless: np.ndarray  #: units whose item id is null
    row: np.ndarray  #: the whole item's unit of each unit
    keys: np.ndarray  #: sorted term * units + unit
    weights: np.ndarray  #: by key
    block: np.ndarray  #: of each unit; a question is in its item's
    opens: np.ndarray  #: where each block's terms begin, and the end
    inside: np.ndarray  #: the terms that have a weight in a block that is not essential, heaviest first
    maxima: np.ndarray  #: the greatest such weight of each
    mass: np.ndarray  #: the sum of each block's maxima
    essential: np.ndarray  #: term of each essential posting, sorted
    essential_item: np.ndarray
    essential_weight: np.ndarray
    light: np.ndarray  #: by unit: the weight of all its terms that are not essential
    stride: int
    parts: list[list[tuple[int, np.ndarray]]]  #: by item: (width, sorted shingles) of the whole, question and answer
    tells: np.ndarray  #: by item: whether the question has a full shingle


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> tuple[int, np.ndarray]:
    width = max(1, min(width, len(hashes)))
    return width, np.unique(T.grams(hashes, width))


def _words(texts: list[str]) -> list[np.ndarray]:
    return [w.hashes[w.bounds[d] : w.bounds[d + 1]] for w in T.words(pa.array(texts, pa.string()), True, space=T.MARKS) for d in range(w.n_docs)]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    text = text.strip()
    cut = text.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", text)]
        cut = ends[-1] if ends else len(text)
    return text[:cut], text[cut:]


@dataclass
class Stats:
    """Of all items, whatever block they are in."""

    n: int
    mean: float  #: words of an item that has any
    terms: np.ndarray  #: sorted word hashes
    df: np.ndarray  #: items that hold each


def build(ids: list[int], texts: list[str | None], threshold: float = THRESHOLD, stats: Stats | None = None) -> Index:
    """The index of some items; ``stats`` are those of all items, else these are all."""
    texts = [t or "" for t in texts]
    whole, n_items = _words(texts), len(texts)
    qa = [split_item(t) for t in texts]
    questions, answers = _words([q for q, _ in qa]), _words([a for _, a in qa])
    row = np.array([*range(n_items), *(i for i, (w, q) in enumerate(zip(whole, questions, strict=True)) if 0 < len(q) < len(w))], np.int64)
    words = [*whole, *(questions[i] for i in row[n_items:])]
    n = len(words)
    item = np.repeat(np.arange(n), [len(w) for w in words])
    terms, term = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]), return_inverse=True)
    keys, tf = np.unique(term.astype(np.int64) * n + item, return_counts=True)
    own_term, own_item = keys // max(n, 1), keys % max(n, 1)
    length = np.array([len(w) for w in words], float)
    if stats is None:
        full = length[:n_items][length[:n_items] > 0]
        stats = Stats(n_items, full.mean() if len(full) else 1.0, terms, np.bincount(own_term[own_item < n_items], minlength=len(terms)))
    df, mean = stats.df[np.searchsorted(stats.terms, terms)], stats.mean
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
    weights = idf[own_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[own_item] / mean))
    weights /= np.bincount(own_item, weights, n)[own_item] if len(keys) else 1
    order = np.lexsort((weights, own_item))  # light terms first, item by item
    sums = np.cumsum(weights[order])
    first = np.searchsorted(own_item[order], np.arange(n))
    before = np.concatenate([[0], sums])[first]
    heavy = sums - before[own_item[order]] >= threshold - 1e-9
    ess = order[heavy][np.argsort(own_term[order][heavy], kind="stable")]
    rest = np.ones(len(keys), bool)
    rest[ess] = False
    block = row // BLOCK_ITEMS
    n_blocks = -(-n_items // BLOCK_ITEMS)
    held, of = np.unique(block[own_item[rest]] * max(len(terms), 1) + own_term[rest], return_inverse=True)
    maxima = np.zeros(len(held))
    np.maximum.at(maxima, of, weights[rest])
    inside, at = held % max(len(terms), 1), held // max(len(terms), 1)
    by_weight = np.lexsort((-maxima, at))
    opens, mass = np.searchsorted(at, np.arange(n_blocks + 1)), np.bincount(at, maxima, n_blocks)
    light = np.bincount(own_item[rest], weights[rest], n)
    parts = [[shingles(w), shingles(q if len(q) else w), shingles(a if len(a) else (q if len(q) else w))] for w, q, a in zip(whole, questions, answers, strict=True)]
    tells = np.array([len(q) >= SHINGLE for q in questions], bool)
    named = np.array([0 if i is None else i for i in ids], np.int64)[row]
    return Index(terms, named, np.array([i is None for i in ids], bool)[row], row, keys, weights, block, opens, inside[by_weight], maxima[by_weight], mass, own_term[ess], own_item[ess], weights[ess], light, int(max(LEAST_STRIDE, length.max(initial=0))), parts, tells)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of some runs, one after the other: ``n`` from ``first`` on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _spans(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, the places of its run in ``sorted_``: (which value, place)."""
    low, high = np.searchsorted(sorted_, values), np.searchsorted(sorted_, values, "right")
    n = high - low
    return np.repeat(np.arange(len(values)), n), _runs(low, n)


def lifted(ix: Index, pairs: np.ndarray, p: np.ndarray, unit: np.ndarray, has: np.ndarray, threshold: float, spent: dict[str, int]) -> np.ndarray:
    """Which pivots (passage ``p``, ``unit``, their essential score ``has``) their block's bound lifts to the threshold.

    ``pairs`` are the passages' distinct terms, sorted: passage * terms + term.  A block stands for its best pivot until it is left.
    """
    n_terms, n_blocks, least = len(ix.terms), len(ix.mass), threshold - 1e-6
    cells, cell = np.unique(p * n_blocks + ix.block[unit], return_inverse=True)
    at_p, at_b = cells // n_blocks, cells % n_blocks
    best = np.zeros(len(cells))
    np.maximum.at(best, cell, has)
    bound, done, end = ix.mass[at_b], ix.opens[at_b], ix.opens[at_b + 1]
    live, step = np.arange(len(cells)), FIRST_TERMS
    while True:
        live = live[(best[live] + bound[live] >= least) & (done[live] < end[live])]
        if not len(live):
            break
        n = np.minimum(step, end[live] - done[live])
        which, place = np.repeat(np.arange(len(live)), n), _runs(done[live], n)
        key = at_p[live][which] * n_terms + ix.inside[place]
        missing = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] != key
        bound[live] -= np.bincount(which[missing], ix.maxima[place[missing]], len(live))
        done[live] += n
        spent["bounds"] += len(place)
        step *= 2
    return has + bound[cell] >= least


def search(ix: Index, w: T.Words, threshold: float = THRESHOLD, spent: dict[str, int] | None = None) -> list[tuple[int, int, float, int, int]]:
    """(document of the slice, item, score, first word, end word) of every passage and item at or above the threshold.

    Passages are 2 * stride words, one each stride; no item is longer than a stride.  ``spent`` adds up the
    products of a term and a block (``bounds``), of a term and a pivot (``scores``), the ``pivots`` and those ``scored``.
    """
    spent = dict.fromkeys(("bounds", "scores", "pivots", "scored"), 0) if spent is None else spent
    n_terms, n_items = len(ix.terms), len(ix.items)
    if not n_terms or not len(w.hashes):
        return []
    term = np.searchsorted(ix.terms, w.hashes)
    term[term == n_terms] = 0
    at = np.flatnonzero(ix.terms[term] == w.hashes)
    term, doc = term[at], w.doc[at]
    n_passages = np.maximum(1, -(-w.counts // ix.stride))
    base = np.cumsum(n_passages) - n_passages
    step = (at - w.bounds[doc]) // ix.stride
    passage = base[doc] + step
    passage = np.concatenate([passage, passage[step > 0] - 1])
    term = np.concatenate([term, term[step > 0]])
    is_essential = np.zeros(n_terms, bool)
    is_essential[ix.essential] = True
    live = np.zeros(int(n_passages.sum()), bool)
    live[passage[is_essential[term]]] = True
    some = live[passage]
    pairs = np.unique(passage[some] * n_terms + term[some])
    passage, term = pairs // n_terms, pairs % n_terms
    heavy = is_essential[term]
    which, place = _spans(ix.essential, term[heavy])
    pivots, pivot = np.unique(passage[heavy][which] * n_items + ix.essential_item[place], return_inverse=True)
    has = np.bincount(pivot, ix.essential_weight[place], len(pivots))
    p, item = pivots // n_items, pivots % n_items
    good = has + ix.light[item] >= threshold - 1e-6
    p, item, has = p[good], item[good], has[good]
    good = lifted(ix, pairs, p, item, has, threshold, spent)
    p, item = p[good], item[good]
    which, place = _spans(passage, p)
    key = term[place] * n_items + item[which]
    found = np.searchsorted(ix.keys, key)
    found[found == len(ix.keys)] = 0
    score = np.bincount(which, np.where(ix.keys[found] == key, ix.weights[found], 0), len(p))
    spent["pivots"] += len(pivots)
    spent["scored"] += len(p)
    spent["scores"] += len(place)
    out = []
    for k in np.flatnonzero(score >= threshold):
        d = int(np.searchsorted(base, p[k], "right")) - 1
        low = int(w.bounds[d] + (p[k] - base[d]) * ix.stride)
        out.append((d, int(item[k]), float(score[k]), low, int(min(low + 2 * ix.stride, w.bounds[d + 1]))))
    return out


def overlaps(ix: Index, item: int, words: np.ndarray) -> list[float]:
    """Shares of the item's, question's and answer's shingles found in a passage."""
    out, made = [], {}
    for width, own in ix.parts[item]:
        if width not in made:
            made[width] = np.unique(T.grams(words, width))
        out.append(len(np.intersect1d(own, made[width], assume_unique=True)) / max(1, len(own)))
    return out


def verified(ix: Index, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, list[float]]]:
    """(row, item, score, overlaps) of the passages that pass both tests, once for an item found whole and by its question."""
    for w in T.words(texts, lower=True, space=T.MARKS):
        done = set()
        for d, unit, score, low, high in sorted(search(ix, w, threshold), key=lambda x: x[1]):  # whole items first
            item = int(ix.row[unit])
            if (d, item, low) in done:
                continue
            done.add((d, item, low))
            got = overlaps(ix, item, w.hashes[low:high])
            if got[0] >= overlap or got[1] >= overlap and (ix.tells[item] or got[2] >= overlap):
                yield w.first + d, item, score, got


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of shard, item_id, text: for each shard and term the items that hold it; a row without a term has items and words."""
    for batch in batches:
        words = _words(batch.column(2).to_pylist())
        shards = np.array(batch.column(0).to_pylist(), np.int64)
        terms = [np.unique(w) for w in words]
        shard, term = np.repeat(shards, [len(t) for t in terms]), np.concatenate([*terms, np.empty(0, np.uint64)])
        full = np.array([len(w) for w in words if len(w)], np.int64)
        cols = [pa.array([*shard.tolist(), None], pa.int32()), pa.array([*term.view(np.int64).tolist(), None], pa.int64()), pa.array([*[1] * len(term), len(full)], pa.int64()), pa.array([*[0] * len(term), int(full.sum())], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "term", "n", "words"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """The index, in blocks of about ``SHARD_ITEMS`` items, built by the executors; one is on the driver at a time.

    Weights don't depend on the blocks: document frequencies, number and mean length are those of all items.
    """
    total = items.count()
    n = store.parts(total, SHARD_ITEMS)
    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int").alias("shard"), F.col("item_id").cast("long"), "text")
    counts = store.written(dealt.mapInArrow(counted, "shard int, term long, n long, words long").groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "bm25df")
    full, length = counts.filter("term is null").agg(F.sum("n"), F.sum("words")).first()
    mean = length / full if full else 1.0
    terms = counts.filter("term is not null")
    own = terms.select("shard", "term").join(terms.groupBy("term").agg(F.sum("n").alias("df")), "term")

    def make(table: pa.Table, held: pa.Table) -> pa.Table:
        term, df = (held.column(c).to_numpy().astype(np.int64) for c in ("term", "df"))
        order = np.argsort(term.view(np.uint64))
        ix = build(table.column("item_id").to_pylist(), table.column("text").to_pylist(), stats=Stats(total, mean, term.view(np.uint64)[order], df[order]))
        return pa.table({"blob": pa.array([pickle.dumps(ix)] if table.num_rows else [], pa.binary())})

    made = store.written(dealt.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(make, "blob binary"), "bm25")
    for row in made.toLocalIterator():
        yield pickle.loads(row["blob"])


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row for each document and test item found in it, with its best passage's score and the overlaps."""
    spark = docs.sparkSession
    store.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    kinds = [pa.int64()] * 2 + [pa.float64()] * 4
    found = None
    for ix in indexes(items):
        sent = spark.sparkContext.broadcast(pickle.dumps(ix))  # SHARD_ITEMS items at most, about

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(sent.value)
            for batch in batches:
                out: list[tuple] = []
                for row, item, score, got in verified(own, batch.column(1), threshold, overlap):
                    out.append((batch.column(0)[row].as_py(), None if own.nameless[item] else int(own.items[item]), score, *got))
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

        part = texts.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    best = F.max_by(F.struct("score", "overlap", "question_overlap", "answer_overlap"), F.struct("overlap", "score"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").alias("n_passages")).select("doc_id", "item_id", "best.*", "n_passages")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents without any test item, with all their columns; rows are filtered where they are read."""
    spark, out = docs.sparkSession, docs
    store.small_batches(spark)
    text = docs.columns.index("text")
    for ix in indexes(items):
        sent = spark.sparkContext.broadcast(pickle.dumps(ix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in verified(own, batch.column(text), threshold, overlap)]] = False
                yield batch.filter(pa.array(keep))

        out = store.mapped(out, run, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES = {"op7_decontamination": query}
