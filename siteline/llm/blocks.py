"""Exact look-ups of hashed keys between blocks of documents and shards of keys.

Documents are dealt into blocks by a hash.  A block sends each key it holds
once, with what it knows of it, packed by shard; a shard joins what all blocks
sent and answers each block in the order of its keys.  So a key that a third of all
documents hold is one entry a block, and neither side holds more than its share:
blocks are bounded by ``store.BLOCK_BYTES`` of text on average, shards by ``SHARD_KEYS``
entries.  Where blocks are many, a chunk shrinks towards one key a row, no worse
than a plain shuffle by key.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import store

SHARD_KEYS = 1 << 20
#: Rows that a task compresses together.
PACK_BYTES = 16 << 20


def blocked(docs: DataFrame, n_blocks: int) -> DataFrame:
    """block, payload: the rows of ``docs`` (doc_id, text and more) dealt into blocks, compressed before they move.

    Rows that are equal in doc_id and text share a block.
    """
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1))
            table = table.take(pa.array(order)).drop_columns("block").combine_chunks()
            payload = []
            for low, high in zip(edges, [*edges[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(low, high - low))
                payload.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(block[order][edges], pa.int32()), pa.array(payload, pa.binary())], ["block", "payload"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    return dealt.mapInArrow(run, "block int, payload binary")


def opened(table: pa.Table) -> pa.Table:
    """The rows of a block by doc_id and text: the same order each time it is read, though its parts arrive in any."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("payload")]).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte position, so that the high zeros compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each key; ascending keys have ascending shards."""
    return ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, slice]]:
    """The shards that ascending keys fall into, and where."""
    if not len(keys):
        return
    shard = shard_of(keys, n_shards)
    edges = np.flatnonzero(np.diff(shard, prepend=-1))
    for low, high in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(shard[low]), slice(int(low), int(high))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return values.astype(f"<u{width}").tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work, which stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
