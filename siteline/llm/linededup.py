"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered; lines
whose key has fewer than ``LEAST`` code points are never dropped.  The store keeps, in the
shared folder and a generation for each change:

    postings   shard, key, key2, doc_id        which document holds which key
    refs       shard, key, key2, refs, first   exact reference count and smallest document
    filters    shard, blob                     cuckoo filter with a mark for every key in ``refs``

``insert`` probes the filters: a key they don't know is new and is appended with no
look-up, the others are merged with the exact table, and those that it doesn't hold (known by
mistake) get a mark as well.  ``delete`` takes documents out: counts fall,
keys at zero leave table and filter, and a key whose first document went gets its next one from the
postings.  A filter that grows full is built anew, larger, from the exact table.
``decide`` drops the lines of keys with two references or more in all but their first document.
``deduplicated`` inserts a corpus in ``BATCHES`` parts, each probing what the ones before it left.

Keys are 128-bit hashes.  A null text is one empty line.  Rows
that share a doc_id are one document; a null doc_id counts as larger than any other.
A document that is inserted again adds nothing.  Columns of the documents that are named like a
column of the result give way to it; others keep their names, whatever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T

LEAST = 10
#: Keys in a shard, on average.
SHARD_KEYS = 1 << 16
#: Parts that a whole corpus is inserted in.
BATCHES = 2
_KEY = ["shard", "key", "key2"]
SLOTS = 4
_LAST = np.iinfo(np.int64).max
_STARTS = (np.arange(256) & 0xC0) != 0x80


class Full(Exception):
    """The filter has no room left."""


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, worked on by arrays of keys."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
            table = np.zeros((n, SLOTS), np.uint16)
        self.table = table

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = T.mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (T.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bucket, mark = self._places(keys)
        return (self.table[bucket] == mark[:, None]).any(1) | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; which found one."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        free = self.table[own] == 0
        good = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(own)), np.minimum(rank, SLOTS - 1)]
        self.table[own[good], slot[good]] = mark[order][good]
        done = np.zeros(len(bucket), bool)
        done[order[good]] = True
        return done

    def insert(self, keys: np.ndarray) -> None:
        """Adds keys; raises ``Full``, with the filter unusable, where they don't fit."""
        bucket, mark = self._places(keys)
        for turn in range(1000):
            done = self._settle(bucket, mark)
            bucket, mark = bucket[~done], mark[~done]
            if not len(bucket):
                return
            if turn == 0:
                bucket = self._other(bucket, mark)
                continue
            # every bucket left is full: its first mark takes the place of another, which moves to its other bucket
            _, first = np.unique(bucket, return_index=True)
            place, slot = bucket[first], ((mark[first].astype(np.int64) * 31 + turn * 7) >> 2) % SLOTS
            out = self.table[place, slot].copy()
            self.table[place, slot] = mark[first]
            mark[first], bucket[first] = out, self._other(place, out)
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one mark for each key; only keys that were inserted may be given."""
        bucket, mark = self._places(keys)
        while len(bucket):
            here = (self.table[bucket] == mark[:, None]).any(1)
            at = np.where(here, bucket, self._other(bucket, mark))
            match = self.table[at] == mark[:, None]
            slot = match.argmax(1)
            _, first = np.unique(at * SLOTS + slot, return_index=True)
            self.table[at[first], slot[first]] = np.where(match.any(1)[first], 0, self.table[at[first], slot[first]])
            rest = np.ones(len(bucket), bool)
            rest[first] = False
            bucket, mark = bucket[rest], mark[rest]


def line_keys(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's lines: document, byte start and end, the two halves of the key, and whether the key is long enough."""
    breaks = np.flatnonzero(w.data == 10)
    doc_starts, doc_ends = w.doc_bytes[:-1], w.doc_bytes[1:]
    doc = np.concatenate([np.arange(w.n_docs), np.searchsorted(w.doc_bytes, breaks, "right") - 1])
    start = np.concatenate([doc_starts, breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = doc_ends[doc[last]]
    low, high = np.searchsorted(w.starts, start), np.searchsorted(w.starts, end)  # words of the line
    some = np.flatnonzero(high > low)
    a, b = w.starts[low[some]], w.ends[high[some] - 1]
    points = np.concatenate([[0], np.cumsum(_STARTS[w.data])])
    fits = points[b] - points[a] >= LEAST
    some, a, b = some[fits], a[fits], b[fits]
    keys, long, folded = np.zeros((2, len(start)), np.uint64), np.zeros(len(start), bool), T._FOLD[w.data]
    for k in range(2):
        keys[k, some] = T.span_hashes(folded, a, b, k)
    long[some] = True
    return doc, start, end, keys[0].view(np.int64), keys[1].view(np.int64), long


def postings(docs: DataFrame, n_shards: int) -> DataFrame:
    """shard, key, key2, doc_id: each key once for each document and batch of rows."""
    store.small_batches(docs.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            for w in T.words(batch.column(1)):
                doc, _, _, key, key2, long = line_keys(w)
                doc, key, key2 = ids[w.first + doc[long]], key[long], key2[long]
                order = np.lexsort((key2, key, doc))
                doc, key, key2 = doc[order], key[order], key2[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]))[: len(doc)]
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(key2[new]), pa.array(doc[new])], schema=schema)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store.trimmed(run), "key long, key2 long, doc_id long")
    return made.withColumn("shard", F.pmod("key", F.lit(n_shards)).cast("int"))


@dataclass
class LineStore:
    """One generation of the store; changes return the next one."""

    spark: SparkSession
    n_shards: int
    postings: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, expected_keys: int) -> LineStore:
        return cls(spark, store.parts(expected_keys, SHARD_KEYS))

    def insert(self, docs: DataFrame) -> LineStore:
        new = postings(docs, self.n_shards).distinct()
        if self.postings is not None:
            new = new.join(self.postings, [*_KEY, "doc_id"], "left_anti")
        new = store.written(new, "postings")
        delta = new.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("first"))
        probed = store.written(self._probe(delta), "probed")
        keys, filters = probed.filter("blob is null"), probed.filter("blob is not null").select("shard", "blob")
        if self.refs is None:
            return LineStore(self.spark, self.n_shards, new, keys.select(*_KEY, "refs", "first"), filters)
        known = keys.filter("known").select(*_KEY, F.col("refs").alias("more"), F.col("first").alias("other"))
        merged = self.refs.join(known, _KEY, "full").select(
            *_KEY, (F.coalesce("refs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("refs"), F.least("first", "other").alias("first"), F.col("first").isNull().alias("missed")
        )
        made = store.written(merged.unionByName(keys.filter("not known").select(*_KEY, "refs", "first", F.lit(False).alias("missed"))), "refs")
        refs = made.drop("missed")
        return LineStore(self.spark, self.n_shards, self.postings.unionByName(new), refs, self._topped(refs, filters, made.filter("missed").select("shard", "key")))

    def _probe(self, delta: DataFrame) -> DataFrame:
        """The batch's keys with whether a filter knows them, and each shard's filter with the new ones (empty where full)."""
        schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("key2", pa.int64()), ("refs", pa.int64()), ("first", pa.int64()), ("known", pa.bool_()), ("blob", pa.binary())])
        text = "shard int, key long, key2 long, refs long, first long, known boolean, blob binary"

        def run(keys: pa.Table, filters: pa.Table | None = None) -> pa.Table:
            shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
            own = keys.column("key").to_numpy().view(np.uint64)
            old = filters is not None and filters.num_rows > 0
            f = Cuckoo.load(filters.column("blob")[0].as_py()) if old else Cuckoo(2 * len(own))
            known = f.holds(own) if old else np.zeros(len(own), bool)
            while True:
                try:
                    f.insert(own[~known])
                    blob = f.dump()
                    break
                except Full:
                    if old:
                        blob = b""  # built anew from the exact table
                        break
                    f = Cuckoo(SLOTS * len(f.table) * 2)
            rows = keys.select([*_KEY, "refs", "first"]).append_column("known", pa.array(known)).append_column("blob", pa.nulls(len(own), pa.binary())).cast(schema)
            last = pa.table([pa.array([x], k.type) for x, k in zip([shard, 0, 0, 0, 0, True, blob], schema, strict=True)], schema=schema)
            store.trim()
            return pa.concat_tables([rows, last])

        if self.filters is None:
            return delta.groupBy("shard").applyInArrow(lambda t: run(t), text)
        return delta.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(lambda a, b: run(a, b), text)

    def _topped(self, refs: DataFrame, filters: DataFrame, missed: DataFrame) -> DataFrame:
        """Filters with marks for the keys that they knew by mistake; those that are full are built anew from the exact table."""

        def add(keys: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not keys.num_rows or not (blob := filters.column("blob")[0].as_py()):
                return filters.select(["shard", "blob"])
            f = Cuckoo.load(blob)
            try:
                f.insert(keys.column("key").to_numpy().view(np.uint64))
                blob = f.dump()
            except Full:
                blob = b""
            return pa.table([filters.column("shard"), pa.array([blob], pa.binary())], ["shard", "blob"])

        def build(keys: pa.Table) -> pa.Table:
            own, size = keys.column("key").to_numpy().view(np.uint64), 2 * keys.num_rows
            while True:
                try:
                    f = Cuckoo(size)
                    f.insert(own)
                    break
                except Full:
                    size *= 2
            return pa.table([pa.array([keys.column("shard")[0].as_py()], pa.int32()), pa.array([f.dump()], pa.binary())], ["shard", "blob"])

        added = store.written(missed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(add, "shard int, blob binary"), "filters")
        full = added.filter(F.length("blob") == 0).select("shard")
        made = refs.join(full, "shard", "left_semi").groupBy("shard").applyInArrow(build, "shard int, blob binary")
        return store.written(added.filter(F.length("blob") > 0).unionByName(made), "filters")

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Takes the documents of ``doc_ids`` (doc_id) out again."""
        ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("doc_id")).distinct()
        gone = store.written(self.postings.join(ids, "doc_id", "left_semi"), "gone")
        rest = store.written(self.postings.join(ids, "doc_id", "left_anti"), "postings")
        delta = gone.groupBy(*_KEY).agg(F.count("*").alias("less"), F.min("doc_id").alias("lost"))
        hit = store.written(self.refs.join(delta, _KEY), "hit")
        orphans = hit.filter("refs > less and lost = first").select(*_KEY)
        heirs = rest.join(orphans, _KEY, "left_semi").groupBy(*_KEY).agg(F.min("doc_id").alias("heir"))
        changed = hit.filter("refs > less").join(heirs, _KEY, "left").select(*_KEY, (F.col("refs") - F.col("less")).alias("refs"), F.coalesce("heir", "first").alias("first"))
        refs = store.written(self.refs.join(hit.select(*_KEY), _KEY, "left_anti").unionByName(changed), "refs")

        def forget(keys: pa.Table, filters: pa.Table) -> pa.Table:
            if not keys.num_rows or not filters.num_rows:
                return filters.select(["shard", "blob"])
            f = Cuckoo.load(filters.column("blob")[0].as_py())
            f.delete(keys.column("key").to_numpy().view(np.uint64))
            return pa.table([filters.column("shard"), pa.array([f.dump()], pa.binary())], ["shard", "blob"])

        zero = hit.filter("refs = less").select("shard", "key")
        filters = store.written(zero.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(forget, "shard int, blob binary"), "filters")
        return LineStore(self.spark, self.n_shards, rest, refs, filters)

    def drops(self) -> DataFrame:
        """doc_id and the keys of the lines that each document loses."""
        repeated = self.refs.filter("refs >= 2").select(*_KEY, "first")
        lost = self.postings.join(repeated.hint("merge"), _KEY).filter("doc_id <> first")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("key", "key2")).alias("keys"))

    def decide(self, docs: DataFrame) -> DataFrame:
        """``docs`` with n_lines, n_dropped, kept_sha256 and the kept text, beside all their other columns."""
        store.small_batches(docs.sparkSession)
        extra = [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())]
        names = [c for c in docs.columns if c.lower() not in {x for x, _ in extra}]
        id_, keys_ = store.unused(docs.columns, "id"), store.unused(docs.columns, "keys")
        lost = self.drops().select(F.col("doc_id").alias(id_), F.col("keys").alias(keys_))
        own = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text"))
        joined = own.join(lost.hint("merge"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))) == F.col(id_), "left").drop(id_)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(len(names) + 1).to_pylist()
                out: list[list] = [[] for _ in extra]
                for w in T.words(batch.column(len(names))):
                    doc, start, end, key, key2, _ = line_keys(w)
                    edges = np.searchsorted(doc, np.arange(w.n_docs + 1))
                    for d in range(w.n_docs):
                        at, raw = slice(edges[d], edges[d + 1]), w.data[w.doc_bytes[d] : w.doc_bytes[d + 1]].tobytes()
                        lost, n = keys[w.first + d], 0
                        if lost:
                            gone = {(x["key"], x["key2"]) for x in lost}
                            drop = [x in gone for x in zip(key[at].tolist(), key2[at].tolist(), strict=True)]
                            n, base = sum(drop), w.doc_bytes[d]
                            raw = b"\n".join(raw[a - base : b - base] for a, b, x in zip(start[at], end[at], drop, strict=True) if not x)
                        for c, x in zip(out, (edges[d + 1] - edges[d], n, hashlib.sha256(raw).hexdigest(), raw.decode()), strict=True):
                            c.append(x)
                cols = [batch.column(k) for k in range(len(names))] + [pa.array(c, k) for c, (_, k) in zip(out, extra, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names + [x for x, _ in extra])

        result = own.select(*(F.col(f"`{c}`") for c in names), *(F.lit(0 if k == pa.int64() else "").cast("long" if k == pa.int64() else "string").alias(x) for x, k in extra))
        return store.mapped(joined, cut, result.schema)


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All of ``docs`` inserted into an empty store, batch by batch, then decided."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = LineStore.empty(docs.sparkSession, store.text_bytes(docs) // 64)
    for k in range(batches):
        made = made.insert(own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else own)
    return made.decide(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(store.documents(spark, sf_dir)).drop("text")


SQL = r"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from parts),
keyed as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (select key, min(doc_id) as keeper from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
decided as (select k.*, r.keeper is not null and r.keeper <> k.doc_id as gone from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from decided group by doc_id
"""

QUERIES = {"op2_line_dedup": query}
ORACLE_SQL = {"op2_line_dedup": SQL}
