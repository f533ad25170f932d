"""Records of four lines, formed where their split is read.

A first scan keeps of each split its number of lines and the three at either end: all of a record that crosses
an edge is among those.  With the lines before each split known, a second scan forms the records that lie
inside a split as a stream, and the few others are put together from the edges.  So no
text is exchanged but that of edges.  A compressed file is one split and is read as a stream alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline import session

LINES = 4
#: Splits whose places are broadcast, a row of about 40 bytes and a path each.
BROADCAST_SPLITS = 1 << 18


def raw(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the split's first byte) and line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _changes(*keys: np.ndarray) -> list[tuple[int, int]]:
    """The runs of rows that are equal in all keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), n]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def edges(rows: DataFrame) -> DataFrame:
    """file, block, split (a number), n, and the first and last three lines of each split of ``rows``."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["file", "block", "n", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, head, tail = None, 0, [], []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, n, head, tail), kinds, strict=True)], names)
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            for a, b in _changes(file.indices.to_numpy(), block):
                own = file[a].as_py(), int(block[a])
                if own != key:
                    if key is not None:
                        yield done()
                    key, n, head, tail = own, 0, [], []
                lines = batch.column(2).slice(a, b - a)
                head = head + lines.slice(0, LINES - 1 - len(head)).to_pylist()
                tail = (tail + lines.slice(max(0, len(lines) - LINES + 1)).to_pylist())[1 - LINES :]
                n += len(lines)
        if key is not None:
            yield done()

    found = rows.mapInArrow(run, "file string, block long, n long, head array<string>, tail array<string>")
    return session.written(found.withColumn("split", F.monotonically_increasing_id()), "splits")


def placed(splits: DataFrame) -> DataFrame:
    """``splits`` with the number of lines before each in its file; a row a split."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("split", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return splits.join(before, "split")


def inside(rows: DataFrame, places: DataFrame) -> DataFrame:
    """split, ordinal, name, seq and qual of the records that lie inside a split of ``rows``."""
    schema = pa.schema([("split", pa.int64()), ("ordinal", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, rest = None, 0, pa.array([], pa.string())
        for batch in batches:
            if batch.column(0).null_count:
                raise ValueError("a split was cut otherwise when its lines were counted")
            ids = batch.column(0).to_numpy()
            for a, b in _changes(ids):
                if ids[a] != split:
                    split, at, rest = ids[a], batch.column(1)[a].as_py(), pa.array([], pa.string())
                lines = batch.column(2).slice(a, b - a).cast(pa.string())
                if not len(rest):  # what goes before the first record's start is of a record of the split before
                    skip = min(-at % LINES, len(lines))
                    lines, at = lines.slice(skip), at + skip
                own = pa.concat_arrays([rest, lines])
                n = len(own) // LINES
                first = (at - len(rest)) // LINES
                at, rest = at + len(lines), own.slice(n * LINES)
                if n:
                    of = [own.take(pa.array(np.arange(n) * LINES + k)) for k in (0, 1, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, split, np.int64)), pa.array(np.arange(first, first + n)), pc.utf8_slice_codeunits(of[0], 1), *of[1:]], schema=schema)

    known = F.broadcast(places.select("file", "block", "split", "before"))  # BROADCAST_SPLITS rows at most
    return rows.join(known, ["file", "block"], "left").select("split", "before", "line").mapInArrow(run, "split long, ordinal long, name string, seq string, qual string")


def crossing(places: DataFrame) -> DataFrame:
    """file, ordinal and line of the lines of records that cross a split's edge, or that their file ends within."""
    ahead = F.pmod(-F.col("before"), F.lit(LINES))
    head = F.slice("head", F.lit(1), F.least(ahead, F.col("n")).cast("int"))
    over = F.when(ahead >= F.col("n"), 0).otherwise(F.pmod(F.col("before") + F.col("n"), F.lit(LINES))).cast("int")
    tail = F.slice("tail", F.size("tail") - over + 1, over)
    numbered = lambda lines, first: F.transform(lines, lambda x, i: F.struct((first + i).alias("ordinal"), x.alias("line")))
    each = F.concat(numbered(head, F.col("before")), numbered(tail, F.col("before") + F.col("n") - over))
    return places.filter("n > 0").select("file", F.explode(each).alias("l")).select("file", "l.*")
