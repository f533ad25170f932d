"""Token-ID shards with a minimal perfect hash index.

Documents are dealt by ranges of ``doc_id`` and written in ascending order as
shard files into the shared folder.  A shard file holds, little-endian:

    header    9 x uint64: magic, keys, null-key rows, rows, ids, pilots, seed, first byte of the ids, bytes an id
    pilots    uint32 per bucket: the hash displacement of its keys
    slots     per key: fingerprint uint32, first row uint32, rows uint32
    keys      int64 per key, ascending
    bounds    uint64 per row and one more: where its ids begin
    payload   uint16 or uint32 per id

``lookup`` reads a key in constant time: bucket -> pilot -> slot -> fingerprint
-> rows -> ids, each a read of its few bytes at a known place of the file (``Keyed``);
only ``read``, which wants every document, takes files whole.  Keys that repeat keep all
their rows, in order of text; a null key is kept in the payload (first) but has no slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store
from siteline.llm import text as T
from siteline.llm.encode import encoder
from siteline.operators import prefix

MAGIC = 0x31304B4F54444944
HEAD = 9
#: Text in a shard, on average, and ids beyond which a shard is closed at the next key.
SHARD_BYTES = 8 << 20
SHARD_IDS = 8_000_000
KEYS_A_BUCKET = 3
#: Shards whose key ranges a lookup sends to the tasks at once.
LOOKUP_SHARDS = 100_000
#: Tasks that read shards whole, at most; those of a task are read one after another.
READ_TASKS = 20_000
_DIRECT = np.uint32(1 << 31)
MANIFEST = "part int, seq int, path string, first_key long, last_key long, n_docs long, n_ids long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return T.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def _places(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(h ^ T.mix(pilots.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pilots, the slot of each (distinct) key, and the seed of a minimal perfect hash.

    Buckets are placed largest first, each trying pilots until its keys fall
    on free slots; buckets of one key get the free slot itself as a pilot.
    """
    n = len(keys)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64), 0
    n_buckets = -(-n // KEYS_A_BUCKET)
    for seed in range(64):
        h = _hash(keys, seed)
        if len(np.unique(h)) < n:
            continue
        bucket = (T.mix(h) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        lows = np.cumsum(sizes) - sizes
        pilots, slots, taken = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            k = sizes[b]
            if k < 2:
                break
            own = order[lows[b] : lows[b] + k]
            for round_ in range(1 << 14):
                at = _places(h[own][None, :], (tries + np.uint64(256 * round_))[:, None], n)
                good = ~taken[at].any(1)
                if k > 1:
                    ranked = np.sort(at, 1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if good.any():
                    p = int(np.argmax(good))
                    pilots[b], slots[own] = 256 * round_ + p, at[p]
                    taken[at[p]] = True
                    break
            else:
                break
        else:
            b = -1
        if b >= 0 and sizes[b] >= 2:
            continue
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        pilots[single] = free.astype(np.uint32) | _DIRECT
        slots[order[lows[single]]] = free
        return pilots, slots, seed
    raise RuntimeError("no perfect hash found")


class Shard:
    """A shard file, open for reading."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        with fs.open_input_file(path) as f:
            self.buffer = f.read_buffer()
        head = np.frombuffer(self.buffer, "<u8", HEAD)
        if head[0] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.n_keys, self.n_null, self.n_rows, self.n_ids, n_pilots, self.seed, start, width = (int(x) for x in head[1:])
        at = 8 * HEAD
        self.pilots = np.frombuffer(self.buffer, "<u4", n_pilots, at)
        at += 4 * n_pilots
        self.slots = np.frombuffer(self.buffer, "<u4", 3 * self.n_keys, at).reshape(-1, 3)
        at += 12 * self.n_keys
        self.keys = np.frombuffer(self.buffer, "<i8", self.n_keys, at)
        at += 8 * self.n_keys
        self.bounds = np.frombuffer(self.buffer, "<u8", self.n_rows + 1, at).astype(np.int64)
        self.payload = np.frombuffer(self.buffer, f"<u{width}", self.n_ids, start)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where its fingerprint isn't there."""
        if not self.n_keys or not len(keys):
            return np.full(len(keys), -1)
        h = _hash(keys, self.seed)
        pilot = self.pilots[(T.mix(h) % np.uint64(len(self.pilots))).astype(np.int64)]
        direct = (pilot & _DIRECT) > 0
        at = np.where(direct, (pilot & ~_DIRECT).astype(np.int64), _places(h, pilot, self.n_keys))
        return np.where(self.slots[at, 0] == (h >> np.uint64(32)).astype(np.uint32), at, -1)

    def rows_of(self, keys: np.ndarray) -> list[range]:
        return [range(0) if s < 0 else range(int(self.slots[s, 1]), int(self.slots[s, 1] + self.slots[s, 2])) for s in self.slot_of(keys)]

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.bounds[row] : self.bounds[row + 1]].astype("<u4")


class Keyed:
    """A shard file of which only what a key needs is read: a header once, then four short reads a key, whatever the shard's size."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.file = fs.open_input_file(path)
        head = np.frombuffer(self.file.read_at(8 * HEAD, 0), "<u8")
        if len(head) != HEAD or head[0] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.n_keys, _, n_rows, _, self.n_pilots, self.seed, self.start, self.width = (int(x) for x in head[1:])
        self.slots = 8 * HEAD + 4 * self.n_pilots
        self.bounds = self.slots + 20 * self.n_keys

    def _at(self, kind: str, n: int, offset: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(np.dtype(kind).itemsize * n, offset), kind)

    def ids_of(self, key: int) -> list[np.ndarray]:
        """The ids of each row of a key, in their order; none where the fingerprint isn't its own."""
        if not self.n_keys:
            return []
        h = _hash(np.array([key], np.int64), self.seed)
        pilot = self._at("<u4", 1, 8 * HEAD + 4 * int(T.mix(h)[0] % np.uint64(self.n_pilots)))
        slot = int(pilot[0] & ~_DIRECT) if pilot[0] & _DIRECT else int(_places(h, pilot, self.n_keys)[0])
        mark, first, n = (int(x) for x in self._at("<u4", 3, self.slots + 12 * slot))
        if mark != int(h[0] >> np.uint64(32)):
            return []
        bounds = self._at("<u8", n + 1, self.bounds + 8 * first).astype(np.int64)
        ids = self._at(f"<u{self.width}", int(bounds[-1] - bounds[0]), self.start + self.width * int(bounds[0])).astype("<u4")
        return np.split(ids, bounds[1:-1] - bounds[0])


def write_shard(uri: str, keys: list[int | None], rows: list[np.ndarray]) -> None:
    n_null = sum(k is None for k in keys)
    own = np.array(keys[n_null:], np.int64)
    uniq, first, count = np.unique(own, return_index=True, return_counts=True)
    pilots, slots, seed = build_index(uniq)
    table = np.zeros((len(uniq), 3), "<u4")
    table[slots, 0] = (_hash(uniq, seed) >> np.uint64(32)).astype(np.uint32)
    table[slots, 1], table[slots, 2] = first + n_null, count
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("<u8")
    parts = [pilots.astype("<u4"), table, uniq.astype("<i8"), bounds]
    width = 2 if all(r.max(initial=0) < 1 << 16 for r in rows) else 4
    start = 8 * HEAD + sum(p.nbytes for p in parts)
    head = np.array([MAGIC, len(uniq), n_null, len(rows), bounds[-1], len(pilots), seed, start, width], "<u8")
    fs, path = _fs(uri)
    with fs.open_output_stream(path) as f:
        for part in (head, *parts):
            f.write(part.tobytes())
        for r in rows:
            f.write(r.astype(f"<u{width}", copy=False).tobytes())


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as shards below ``path``; returns the manifest, a row a shard.

    A task that runs again writes files under new names; only the files of
    the attempt whose rows reached the manifest belong to the store.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    fs, local = _fs(path)
    fs.create_dir(local)
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        rows: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            uri = f"{path}/{part:05d}-{seq:05d}-{uuid.uuid4().hex}.ids"
            write_shard(uri, keys, rows)
            known = [k for k in keys if k is not None]
            out = [part, seq, uri, min(known, default=None), max(known, default=None), len(rows), held]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, fields, strict=True)], schema=fields)

        own = encoder(tokenizer)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), own.batch(batch.column(1)), strict=True):
                if held >= SHARD_IDS and key != keys[-1]:
                    yield flush()
                    seq, held, keys, rows = seq + 1, 0, [], []
                keys.append(key)
                rows.append(np.append(ids, np.uint32(end_id)))
                held += len(rows[-1])
        if rows:
            yield flush()

    n = store.parts(store.text_bytes(docs), SHARD_BYTES)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = store.written(dealt.mapInArrow(put, MANIFEST), "manifest")
    placed = prefix.placed(manifest, [], ["part", "seq"])
    return prefix.bare(prefix.running(placed, [], "sum", F.col("n_ids"), "start", before=True))


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the shard files, each found by its key: doc_id, start, n_tokens, ids_crc32."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                rows = [*range(shard.n_null), *(r for found in shard.rows_of(shard.keys) for r in found)]
                if sorted(rows) != list(range(shard.n_rows)):
                    raise ValueError(f"the index doesn't cover {uri}")
                counts = (shard.slots[shard.slot_of(shard.keys), 2]).astype(np.int64) if shard.n_keys else np.empty(0, np.int64)
                ids = pa.array([None] * shard.n_null + np.repeat(shard.keys, counts).tolist(), pa.int64())
                lens = np.diff(shard.bounds)[rows]
                crc = np.array([zlib.crc32(shard.ids(r)) for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shard.bounds[rows] + base), pa.array(lens), pa.array(crc)], schema=fields)

    n = min(max(1, manifest.count()), READ_TASKS)  # a task reads its shards one after another
    return manifest.select("path", "start").repartition(n).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of each key of ``keys`` (doc_id): doc_id, ids; a key that isn't stored gives no row.

    Shards have disjoint key ranges: a key's shard is found by bisection, in blocks of at most
    ``LOOKUP_SHARDS`` shards, and each shard file is opened once a task.
    """
    shards = manifest.filter("first_key is not null").select("first_key", "last_key", "path").orderBy("first_key")
    wanted = keys.select(F.col("doc_id").cast("long")).dropna().distinct()
    routed, rows = None, shards.toLocalIterator()
    while block := list(islice(rows, LOOKUP_SHARDS)):
        first, last, paths = np.array([r[0] for r in block]), np.array([r[1] for r in block]), [r[2] for r in block]

        def route(batches: Iterator[pa.RecordBatch], first=first, last=last, paths=paths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                at = np.searchsorted(first, own, "right") - 1
                good = (at >= 0) & (own <= last[at])
                yield pa.RecordBatch.from_arrays([pa.array([paths[k] for k in at[good]], pa.string()), pa.array(own[good])], ["path", "doc_id"])

        part = wanted.filter(F.col("doc_id").between(int(first[0]), int(last[-1]))).mapInArrow(route, "path string, doc_id long")
        routed = part if routed is None else routed.unionByName(part)
    if routed is None:
        return keys.sparkSession.createDataFrame([], "doc_id long, ids array<long>")
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != uri:
                    uri, shard = path, Keyed(path)
                for ids in shard.ids_of(key):
                    out[0].append(key)
                    out[1].append(ids.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], fields[1].type)], schema=fields)

    return routed.select("path", "doc_id").repartition("path").sortWithinPartitions("path").mapInArrow(get, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    return read(write(docs, store.new_path(spark, "tokens"), "byte_bpe_50k.json", 0))


QUERIES = {"op4_token_store": query}
