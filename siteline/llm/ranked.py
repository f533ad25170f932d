"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of the documents.

A shard's postings are one sequence: term after term, each term's documents by impact, highest first.  A wavelet tree over the
document numbers of that sequence keeps both orders: a node stands for a range of documents, a term's postings in it are an
interval that still runs by impact, so the first of them is the most that the term can add to any document of the range.  A search starts with the
terms' intervals at the root and opens nodes by the sum of those firsts, the largest first; a leaf's sum is its document's score.  Nodes that
can't enter the best ``k`` any more are closed unopened, so the result is exact.

Documents are packed into shards where they are read, and never move; the trees are written once and serve any number
of blocks of items.  Items come in blocks of bounded size that are broadcast.  A task keeps the best of all its shards and
gives ``k`` rows an item.  Impacts are whole numbers (see ``impact``), weights come from document counts over all shards.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lowered.  Null and empty texts have none and are not
counted as documents.  Of equal scores the smaller doc_id is first, a null one last; rows that repeat are documents of their own.
An item without terms, or with none that a document holds, has no rows; items that repeat an id have rows of their own each, under one id.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Items, and bytes of their texts, that are broadcast at once.
ITEM_ROWS, ITEM_BYTES = 2048, 8 << 20
#: Nodes that a search opens side by side.
OPENED = 64
#: First merging step: a task's rows meet those of others with the same number modulo this.
SALTS = 32
_NONE = np.iinfo(np.int64).max
# Fixed values of the ranking rule: scale, and what a document's length adds.
SCALE, TF, LENGTH, MEAN, SHARE = 1_000_000_000, 1000, 12, 100, 25
_IMPACT_BITS = 20  # an impact is below SCALE / TF


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``length`` terms are worth, of ``n`` documents with ``total`` terms."""
    m = MEAN - SHARE + SHARE * length.astype(np.int64) * n // max(total, 1)
    return SCALE * tf.astype(np.int64) // (TF * tf.astype(np.int64) + LENGTH * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(column: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    column = T.large(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    full = ~T.MARKS[raw[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    first = full.copy()
    first[1:] &= ~full[:-1]
    heads = bounds[:-1][bounds[:-1] < len(full)]
    first[heads] = full[heads]
    return T.per_doc(first, bounds)


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            own = lengths(batch.column("text").slice(low, 256))
            n, total = n + int((own > 0).sum()), total + int(own.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])


def tree(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The bits of a wavelet tree, ``depth`` rows of 64-bit words; each row is stably parted by the bit of the row before."""
    rows = []
    for level in range(depth):
        bit = ((sequence >> (depth - 1 - level)) & 1).astype(bool)
        words = np.zeros((len(sequence) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bit, bitorder="little")
        words[: len(packed)] = packed
        rows.append(words.view(np.uint64))
        sequence = np.concatenate([sequence[~bit], sequence[bit]])
    return np.stack(rows) if rows else np.zeros((0, len(sequence) // 64 + 1), np.uint64)


_SHARD = "ids binary, named binary, terms binary, counts binary, impacts binary, bits binary"


def _built(batches: list[pa.RecordBatch], n: int, total: int) -> pa.RecordBatch:
    """One shard's row."""
    table = pa.Table.from_batches(batches)
    ids = table.column("doc_id").combine_chunks()
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(_NONE).to_numpy()
    hashes, docs, at = [], [], 0
    for batch in batches:
        for w in T.words(batch.column("text"), True, space=T.MARKS):
            hashes.append(w.hashes)
            docs.append((at + w.first + w.doc).astype(np.int64))
        at += batch.num_rows
    terms, term = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]), return_inverse=True)
    doc = np.concatenate([*docs, np.empty(0, np.int64)])
    del hashes, docs
    length = np.bincount(doc, minlength=len(ids))
    order = np.lexsort((~named, ids))
    order = order[length[order] > 0]  # texts without terms hold no place
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    d = max(len(order), 1)
    keys, tf = np.unique(term.astype(np.int64) * d + place[doc], return_counts=True)
    term, doc = keys // d, keys % d
    worth = impact(tf, length[order][doc], n, total)
    by = np.argsort((term << _IMPACT_BITS) | ((1 << _IMPACT_BITS) - 1 - worth), kind="stable")
    bits = tree(doc[by], (d - 1).bit_length())
    cells = [ids[order].astype("<i8"), named[order], terms.astype("<u8"), np.bincount(term, minlength=len(terms)).astype("<i4"), worth[by].astype("<i4"), bits.astype("<u8")]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], [c.split()[0] for c in _SHARD.split(", ")])


def _builder(n: int, total: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own = part.nbytes
                if held and size + own > shard_bytes:
                    yield _built(held, n, total)
                    held, size = [], 0
                held.append(part)
                size += own
        if held:
            yield _built(held, n, total)

    return store.trimmed(run)


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written trees of ``docs`` (doc_id, text), a row a shard, with the number of documents and terms as ``n`` and ``total``."""
    store.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, total = own.select("text").mapInArrow(_size, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    out = store.written(own.mapInArrow(_builder(n, total, shard_bytes), _SHARD), "trees")
    out.n, out.total = n, total
    return out


class Shard:
    """A shard's tree in memory, with the number of set bits before each word and the impacts in each level's order."""

    def __init__(self, row: dict):
        self.ids, self.named = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], bool)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<i4"), dtype=np.int64)])
        worth = np.frombuffer(row["impacts"], "<i4")
        self.depth = (max(len(self.ids), 1) - 1).bit_length()
        n = len(worth)
        self.bits = np.frombuffer(row["bits"], "<u8").reshape(self.depth, n // 64 + 1)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        self.zeros = n - ones.sum(axis=1)
        self.worth = np.zeros((self.depth + 1, n + 1), np.int32)  # an empty interval at the end reads 0
        self.worth[0, :n] = worth
        for level in range(self.depth):
            bit = np.unpackbits(self.bits[level].view(np.uint8), bitorder="little")[:n].astype(bool)
            now, zeros = self.worth[level, :n], int(self.zeros[level])
            self.worth[level + 1, :zeros], self.worth[level + 1, zeros:n] = now[~bit], now[bit]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before a place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.bits[level, word] & mask)

    def find(self, terms: np.ndarray, factors: np.ndarray, k: int, best: np.ndarray, opened: int = OPENED) -> np.ndarray:
        """The best ``k`` (score, doc_id, named) of ``best`` and this shard, for distinct terms with their factors."""
        if not len(self.terms):
            return best
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (factors > 0)
        at, factors = at[here], factors[here]
        if not len(at):
            return best
        low, high = self.starts[at][None, :], self.starts[at + 1][None, :]
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.worth[0][low] * factors).sum(axis=1)
        while len(bound):
            if len(best) == k:  # what can't come before the last of the best is closed
                last = best[-1]
                alive = (bound > last[0]) | ((bound == last[0]) & (self.ids[first] < last[1]))
                level, first, low, high, bound = level[alive], first[alive], low[alive], high[alive], bound[alive]
                if not len(bound):
                    break
            pick = np.argpartition(-bound, opened)[:opened] if len(bound) > opened else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            leaf = level[pick] == self.depth
            done, inner = pick[leaf], pick[~leaf]
            if len(done):
                doc = first[done]
                best = top(np.concatenate([best, np.stack([bound[done], self.ids[doc], self.named[doc].astype(np.int64)], axis=1)]), k)
            v = level[inner][:, None]
            ones_low, ones_high = self.ones(v, low[inner]), self.ones(v, high[inner])
            sides = []
            for bit in (0, 1):
                a, b = (self.zeros[v] + ones_low, self.zeros[v] + ones_high) if bit else (low[inner] - ones_low, high[inner] - ones_high)
                heads = np.where(a < b, self.worth[v + 1, a], 0)
                sides.append((level[inner] + 1, first[inner] + (bit << (self.depth - 1 - level[inner])), a, b, (heads * factors).sum(axis=1)))
            level, first, low, high, bound = (np.concatenate([x[rest], y, z]) for x, y, z in zip((level, first, low, high, bound), *sides, strict=True))
            some = bound > 0
            if not some.all():
                level, first, low, high, bound = level[some], first[some], low[some], high[some], bound[some]
        return best


def top(rows: np.ndarray, k: int) -> np.ndarray:
    """The best ``k`` of (score, doc_id, named), best first."""
    return rows[np.lexsort((1 - rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]


def _counter(asked: np.ndarray):
    """term, df: in how many documents of a partition's shards each asked term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, df = asked.value, np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[row].as_buffer(), "<u8")
                counts = np.frombuffer(batch.column("counts")[row].as_buffer(), "<i4")
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
                    df += np.where(terms[at] == want, counts[at], 0)
        held = df > 0
        yield pa.RecordBatch.from_arrays([pa.array(want[held].view(np.int64)), pa.array(df[held])], ["term", "df"])

    return run


_FOUND = "item long, doc_id long, score long, salt int"


def _searcher(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        best = {item: np.empty((0, 3), np.int64) for item, _, _ in asked}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].as_buffer() for c in batch.schema.names})
                for item, terms, factors in asked:
                    best[item] = shard.find(terms, factors, k, best[item])
                del shard
        own = TaskContext.get()
        salt = (own.partitionId() if own else 0) % SALTS
        for item, rows in best.items():
            if len(rows):
                ids = pa.array(rows[:, 1], mask=rows[:, 2] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), item)), ids, pa.array(rows[:, 0]), pa.array(np.full(len(rows), salt), pa.int32())], ["item", "doc_id", "score", "salt"])

    return store.trimmed(run)


def _terms(texts: list[str | None]) -> list[Counter]:
    return [Counter(w.hashes[w.bounds[d] : w.bounds[d + 1]].tolist()) for w in T.words(pa.array([t or "" for t in texts], pa.string()), True, space=T.MARKS) for d in range(w.n_docs)]


def search(trees: DataFrame, items: DataFrame, k: int = 20, item_rows: int = ITEM_ROWS) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``k`` documents of each of ``items`` (item_id, text)."""
    spark = trees.sparkSession
    own = store.written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "items")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(store.parts(n, item_rows), store.parts(size, ITEM_BYTES))
    to = store.new_path(spark, "ranked")
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()  # a block of items
        counted = [(r["item"], c) for r, c in zip(rows, _terms([r["text"] for r in rows]), strict=True)]
        vocabulary = np.array(sorted({t for _, c in counted for t in c}), np.uint64)
        asked = spark.sparkContext.broadcast(vocabulary)
        found = trees.select("terms", "counts").mapInArrow(_counter(asked), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the block's terms at most
        weights = {r["term"] & (1 << 64) - 1: weight(trees.n, r["df"]) for r in found}
        ready = []
        for item, c in counted:
            some = [(t, times * weights[t]) for t, times in c.items() if t in weights]
            ready.append((item, np.array([t for t, _ in some], np.uint64), np.array([f for _, f in some], np.int64)))
        block = spark.sparkContext.broadcast(ready)
        trees.mapInArrow(_searcher(block, k), _FOUND).write.mode("append").parquet(to)
        asked.unpersist()
        block.unpersist()
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)
    best = ranked(ranked(spark.read.schema(_FOUND).parquet(to), "item", "salt").drop("rank"), "item")
    return best.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(index(store.documents(spark, sf_dir)), items)


QUERIES = {"op13_ranked_search": op13_ranked_search}

ORACLE_SQL = {
    "op13_ranked_search": r"""
with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
 d as (select doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from low),
 s as (select count(*) as big_n, sum(len(words)) as big_l from d where len(words) > 0),
 p as (select doc_id, len(words) as n, unnest(words) as term from d),
 tf as (select doc_id, any_value(n) as n, term, count(*) as tf from p group by doc_id, term),
 it as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
 q as (select item_id, term, count(*) as times from it group by 1, 2),
 df as (select term, count(*) as df from tf where term in (select term from q) group by 1),
 w as (select term, cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double)) as bigint) as w from df, s),
 sc as (select q.item_id, tf.doc_id, cast(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * tf.n * cast(s.big_n as bigint)) // cast(s.big_l as bigint))))) as bigint) as score
   from q join w using (term) join tf using (term), s group by 1, 2),
 r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 20"""
}
