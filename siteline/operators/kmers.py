"""K-mers of both strands as numbers: counted, and looked up between reads and references, without a row for each.

A k-mer and its reverse complement have one key, the smaller of their numbers in base five (A, C, G, T, N), scattered by an
odd factor.  Tasks cut sequences in spans, sort their keys and send them as differences, packed by bucket: a bucket is
a range of keys, so that a k-mer found everywhere is one entry a chunk and no bucket holds more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from siteline import session

#: Bases worked on at once, keys sorted and sent together, and keys of a bucket on average.
SPAN, CHUNK, BUCKET = 1 << 17, 1 << 22, 1 << 20
#: Bases of a block of reads, places of a read looked up first, and bits of the filter of wanted keys (16 MB).
BLOCK, FIRST, FILTER_BITS = 1 << 20, 4, 27
#: How many times more places each further round of look-ups takes.
FURTHER = 64

_FACTOR = 0x9E3779B97F4A7C15
_CODES = np.full(256, 5, np.uint8)
for _code, _base in enumerate(b"ACGTN"):
    _CODES[_base] = _code
_DIGIT = np.array([0, 1, 2, 3, 4, 0], np.uint64)
_PAIRED = np.array([3, 2, 1, 0, 4, 0], np.uint64)


def key_bits(k: int) -> int:
    """Bits of the key of a k-mer."""
    if not 0 < k <= 27:
        raise ValueError("a k-mer has 1 to 27 bases")
    return (5**k - 1).bit_length()


def _numbers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each window and of its reverse complement."""
    n = len(codes) - k + 1
    one, two = _DIGIT[codes], _PAIRED[codes]
    ahead, back, have, width = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0, 1
    while have < k:  # windows of 1, 2, 4 ... bases, put together by the bits of k
        scale = np.uint64(5**width)
        if k & width:
            ahead = ahead * scale + one[have : have + n]
            back += two[have : have + n] * np.uint64(5**have)
            have += width
        if have < k:
            one, two = one[:-width] * scale + one[width:], two[:-width] + two[width:] * scale
            width *= 2
    return ahead, back


def spans(column: pa.Array, k: int, places: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """The keys of a string column's k-mers, with the row and the place in it of each where wanted, so many bases at a time; in order.

    A window with a letter other than A, C, G, T and N is none.
    """
    factor, mask = np.uint64(_FACTOR), np.uint64((1 << key_bits(k)) - 1)
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    for low in range(int(bounds[0]), int(bounds[-1]) - k + 1, SPAN):
        codes = _CODES[raw[low : min(low + SPAN + k - 1, int(bounds[-1]))]]
        n = len(codes) - k + 1
        ahead, back = _numbers(codes, k)
        keys = (np.minimum(ahead, back) * factor) & mask
        first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, low + n, "left")
        edges = np.clip(bounds[first : last + 1], low, low + n)
        good = np.ones(n, bool)
        for x in np.clip(bounds[first + 1 : last + 1] - low, 0, n + k - 1).tolist():
            good[max(0, x - k + 1) : x] = False  # these windows run past the end of their row
        if (codes == 5).any():
            strange = np.concatenate([[0], np.cumsum(codes == 5)])
            good &= strange[k:] == strange[:n]
        if places:
            row = np.repeat(np.arange(first, last), np.diff(edges))[good]
            yield keys[good], row, np.arange(low, low + n)[good] - bounds[row]
        else:
            yield keys[good], None, None


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest, byte by byte position, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(pa.decompress(raw[1:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_keys(keys: np.ndarray, base: int) -> bytes:
    """Ascending keys of the bucket that begins at ``base``."""
    return pack(np.diff(keys, prepend=np.uint64(base)))


def unpack_keys(raw: bytes, n: int, base: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n), dtype=np.uint64) + np.uint64(base)


def bucket_bits(n: float, k: int) -> int:
    """Buckets for ``n`` keys, as a power of two; 16 at least, and each of eight keys and eight bits of the filter at least."""
    return min(key_bits(k) - 3, FILTER_BITS - 3, max(4, int(n / BUCKET).bit_length()))


def cuts(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, slice]]:
    """The buckets that ascending keys fall into, where each begins, and its keys' places."""
    if len(keys):
        bucket = (keys >> np.uint64(shift)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
            yield int(bucket[low]), int(bucket[low]) << shift, slice(low, high)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Ascending and once each; ``np.unique`` takes many times as long."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]


def windows(df: DataFrame, k: int) -> int:
    """How many k-mers the sequences of ``df`` (seq) have."""
    return df.agg(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0)).cast("long"))).first()[0] or 0


def _tables(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Letters of each number of five bases and of ``k % 5`` bases, and of its reverse complement."""
    out = []
    for digits in (5, k % 5):
        codes = np.arange(5**digits)[:, None] // 5 ** np.arange(digits)[::-1] % 5
        out.append(tuple(np.ascontiguousarray(np.frombuffer(b, np.uint8)[c]).view(f"S{digits}").ravel() if digits else None for b, c in ((b"ACGTN", codes), (b"TGCAN", codes[:, ::-1]))))
    return out


def _texts(numbers: np.ndarray, k: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """K-mers and their reverse complements as texts."""
    one, two = np.empty((len(numbers), k), np.uint8), np.empty((len(numbers), k), np.uint8)
    left = numbers.astype(np.int64)
    for low in range(0, k, 5):
        table, width = (tables[0], 5) if k - low >= 5 else (tables[1], k % 5)
        rest = left // 5**width
        part, left = left - rest * 5**width, rest
        for out, at, letters in ((one, k - low - width, table[0]), (two, low, table[1])):
            out[:, at : at + width] = letters[part].view(np.uint8).reshape(-1, width)
    return one.view(f"S{k}").ravel(), two.view(f"S{k}").ravel()


def count_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """kmer and n: how often each k-mer of A, C, G, T and N is in ``sequences`` (seq) and their reverse complements."""
    bits = key_bits(k)
    shift = bits - bucket_bits(windows(sequences, k), k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            keys, n = keys[first], np.diff(first, append=len(keys))
            own = [(b, s.stop - s.start, pack_keys(keys[s], base), pack(n[s])) for b, base, s in cuts(keys, shift)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "size", "keys", "counts"])

        held, size = [], 0
        for batch in batches:
            for keys, _, _ in spans(batch.column("seq"), k, places=False):
                if len(keys):
                    held.append(keys)
                    size += len(keys)
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(raw, n, b << shift) for b, n, raw in zip(*(table.column(c).to_pylist() for c in ("bucket", "size", "keys")), strict=True)])
        n = np.concatenate([unpack(raw, m) for m, raw in zip(*(table.column(c).to_pylist() for c in ("size", "counts")), strict=True)]).astype(np.int64)
        if n.sum() <= 2 * len(n):  # few are found again in their chunk: the keys alone are sorted in a third of the time
            keys = np.sort(np.repeat(keys, n))
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            n = np.diff(first, append=len(keys))
        else:
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            n = np.add.reduceat(n[order], first)
        numbers = keys[first] * np.uint64(pow(_FACTOR, -1, 1 << 64)) & np.uint64((1 << bits) - 1)
        tables, out = _tables(k), []
        for low in range(0, len(n), 1 << 16):
            one, two = _texts(numbers[low : low + (1 << 16)], k, tables)
            same, own = one == two, n[low : low + (1 << 16)]  # its own reverse complement is found once on each strand
            letters = np.concatenate([one, two[~same]])
            ends = pa.py_buffer(np.arange(0, k * len(letters) + 1, k, dtype=np.int32))
            out.append(pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(letters), ends, pa.py_buffer(letters)), pa.array(np.concatenate([np.where(same, 2 * own, own), own[~same]]))], ["kmer", "n"]))
        return pa.Table.from_batches(out)

    sent = sequences.select("seq").mapInArrow(send, "bucket int, size int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "kmer string, n long")


def reference_keys(references: DataFrame, k: int) -> DataFrame:
    """index, key and priority: the keys of ``references`` (index, seq, priority), each with its lowest priority."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, row, _ in spans(batch.column("seq"), k):
                at = pa.array(row)
                found = pa.table([batch.column("index").take(at), pa.array(keys.view(np.int64)), batch.column("priority").take(at)], ["index", "key", "priority"])
                yield from found.group_by(["index", "key"]).aggregate([("priority", "min")]).rename_columns(["index", "key", "priority"]).to_batches()

    return references.select("index", "seq", "priority").mapInArrow(run, "index string, key long, priority int").groupBy("index", "key").agg(F.min("priority").alias("priority"))


def held_hits(reads: DataFrame, references: DataFrame, k: int, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``reads`` (seq, index) and __priority: that of a read's first k-mer that ``references`` hold, which every task gets whole."""
    known, held = reference_keys(references, k).toArrow(), {}
    for name in pc.unique(known.column("index")).to_pylist():
        part = known.filter(pc.equal(known.column("index"), name))
        keys = part.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        held[name] = (keys[order], part.column("priority").to_numpy()[order])
    sent = reads.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = first_hits(batch.column("seq"), batch.column("index"), k, sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _priorities(found)], [*kept, "__priority"])

    return reads.mapInArrow(run, StructType([*(reads.schema[c] for c in kept), StructField("__priority", IntegerType())]))


def _priorities(found: np.ndarray) -> pa.Array:
    return pa.array(found.astype(np.int32), pa.int32(), mask=found < 0)


def first_hits(seq: pa.Array, index: pa.Array, k: int, held: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The priority of each sequence's first k-mer among those of its index in ``held`` (ascending keys, priorities); -1 where none is."""
    best = np.full(len(seq), -1, np.int64)
    names = np.array(index.to_pylist(), object)
    rows_of = {name: names == name for name in held.keys() & set(names.tolist()) if len(held[name][0])}
    for keys, row, place in spans(seq, k):
        open_ = best[row] < 0
        keys, row, place = keys[open_], row[open_], place[open_]
        low, width = 0, 64
        while len(keys):  # a first hit tends to come early: only sequences without one go on, further each time
            near = place < low + width
            for name, rows in rows_of.items():
                known, priority = held[name]
                own = np.flatnonzero(near & rows[row])
                where = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                hit = known[where] == keys[own]
                at = row[own[hit]]
                first = np.flatnonzero(np.diff(at, prepend=-1))  # keys are in order of row and place
                best[at[first]] = priority[where[hit][first]]
            left = ~near & (best[row] < 0)
            keys, row, place = keys[left], row[left], place[left]
            low, width = low + width, width * 2
    return best


def _groups(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.Array]]:
    """The sequences of each group of a batch."""
    table = pa.Table.from_batches([batch]).append_column("__at", pa.array(np.arange(batch.num_rows)))
    for own in table.group_by(list(names)).aggregate([("__at", "list")]).to_pylist():
        yield tuple(own[c] for c in names), batch.column("seq").take(pa.array(own["__at_list"]))


def _rows(own: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*own, strict=True) if own else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names)


_ASKS = (["index", "bucket", "block", "size", "keys"], [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()])
_KNOWN = (["index", "bucket", "priority", "size", "keys"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])
_ANSWERS = (["block", "index", "bucket", "priority", "size", "keys"], [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block: so many bases that follow each other."""
    block, size = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16) + size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block + ends // BLOCK)], [*batch.schema.names, "__block"])
        size = int(ends[-1]) if len(ends) else size


def _wanted(asks: DataFrame, bits: int, shift: int) -> np.ndarray:
    """A bit for each range of keys, set where one is asked for: each bucket makes its own part."""
    spare = max(0, bits - FILTER_BITS)
    size = 1 << (shift - spare - 3)

    def part(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        seen = np.zeros(size << 3, bool)
        for n, raw in zip(table.column("size").to_pylist(), table.column("keys").to_pylist(), strict=True):
            seen[(unpack_keys(raw, n, 0) >> np.uint64(spare)).astype(np.int64)] = True
        return pa.table([pa.array([b], pa.int32()), pa.array([pa.compress(np.packbits(seen, bitorder="little").tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["bucket", "part"])

    out = np.zeros(size << (bits - shift), np.uint8)
    for row in asks.select("bucket", "size", "keys").groupBy("bucket").applyInArrow(part, "bucket int, part binary").collect():
        out[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(pa.decompress(bytes(row.part), size, codec="zstd", asbytes=True), np.uint8)
    return out


def exchanged_hits(reads: DataFrame, references: DataFrame, k: int, kept: list[str], n_references: int) -> DataFrame:
    """As ``held_hits``, for references too many to be held: blocks of reads ask buckets of keys.

    A round asks for a read's next places and goes on with the reads that found nothing.  References send the keys that
    a filter of all that is asked lets through, unless so much is asked that all are sent; the answers to a block are the keys that are known, by priority.
    """
    spark, bits = reads.sparkSession, key_bits(k)
    columns = [*kept, "index", "seq", "__block"]
    shape = StructType([*(reads.schema[c] for c in (*kept, "index", "seq")), StructField("__block", LongType())])
    left = session.written(reads.select(*kept, "index", "seq").mapInArrow(_blocks, shape), "reads")
    shape = StructType([*shape.fields, StructField("__priority", IntegerType())])
    done, low, width = [], 0, FIRST
    while True:
        asked = left.withColumn("__part", F.substring("seq", low + 1, width + k - 1))
        n_asked = windows(asked.select(F.col("__part").alias("seq")), k)
        passed = 1 - math.exp(-n_asked / (1 << FILTER_BITS))
        thin = n_asked < n_references * (1 - passed)  # else the filter, for which all that is asked moves once more, costs more than it saves
        shift = bits - bucket_bits(n_asked + n_references * (passed if thin else 1), k)
        asks = asked.select("index", "__block", F.col("__part").alias("seq")).mapInArrow(_asking(k, shift), "index string, bucket int, block long, size int, keys binary")
        sent = spark.sparkContext.broadcast(_wanted(asks, bits, shift) if thin else None)
        known = references.mapInArrow(_telling(k, bits, shift, sent), "index string, bucket int, priority int, size int, keys binary")
        answers = asks.groupBy("index", "bucket").cogroup(known.groupBy("index", "bucket")).applyInArrow(_answer, "block long, index string, bucket int, priority int, size int, keys binary")
        found = asked.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(_taking(k, shift, columns, low + width), shape)
        found = session.written(found, "hits")
        sent.destroy()
        done.append(found.filter("seq is null").select(*kept, "__priority"))
        left = found.filter("seq is not null").select(*columns)
        if left.isEmpty():
            break
        low, width = low + width, width * FURTHER
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _asking(k: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for (name, block), seq in _groups(batch, "index", "__block"):
                if found := [keys for keys, _, _ in spans(seq, k, places=False)]:
                    keys = distinct(np.concatenate(found))
                    own += [(name, b, block, s.stop - s.start, pack_keys(keys[s] - np.uint64(base), 0)) for b, base, s in cuts(keys, shift)]
            yield _rows(own, *_ASKS)

    return run


def _telling(k: int, bits: int, shift: int, sent):
    spare = np.uint64(max(0, bits - FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            own = []
            for (name, priority), parts in held.items():
                keys = distinct(np.concatenate(parts))
                own += [(name, b, priority, s.stop - s.start, pack_keys(keys[s] - np.uint64(base), 0)) for b, base, s in cuts(keys, shift)]
            return _rows(own, *_KNOWN)

        wanted, held, size = sent.value, {}, 0
        for batch in batches:
            for group, seq in _groups(batch, "index", "priority"):
                for keys, _, _ in spans(seq, k, places=False):
                    if wanted is not None:
                        slot = keys >> spare
                        keys = keys[(wanted[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    if len(keys):
                        held.setdefault(group, []).append(keys)
                        size += len(keys)
                    if size >= CHUNK:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return run


def _answer(asks: pa.Table, known: pa.Table) -> pa.Table:
    """The keys of each block's asks that are known, by their lowest priority."""
    own = []
    if asks.num_rows and known.num_rows:
        name, bucket = asks.column("index")[0].as_py(), asks.column("bucket")[0].as_py()
        each = [(block, unpack_keys(raw, n, 0)) for block, n, raw in zip(*(asks.column(c).to_pylist() for c in ("block", "size", "keys")), strict=True)]
        want = distinct(np.concatenate([keys for _, keys in each]))
        best = np.full(len(want), np.iinfo(np.int64).max)
        for priority, n, raw in zip(*(known.column(c).to_pylist() for c in ("priority", "size", "keys")), strict=True):
            keys = unpack_keys(raw, n, 0)
            at = np.minimum(np.searchsorted(want, keys), len(want) - 1)
            at = at[want[at] == keys]
            best[at] = np.minimum(best[at], priority)
        hit = best < np.iinfo(np.int64).max
        priorities = np.sort(pc.unique(known.column("priority")).to_numpy())
        for block, keys in each:
            at = np.searchsorted(want, keys)
            at = at[hit[at]]
            for priority in priorities if len(at) else ():
                some = want[at[best[at] == priority]]
                if len(some):
                    own.append((block, name, bucket, int(priority), len(some), pack_keys(some, 0)))
    return pa.Table.from_batches([_rows(own, *_ANSWERS)])


def _taking(k: int, shift: int, columns: list[str], beyond: int):
    """``beyond``: places before it have been asked for; the sequence of a read that is settled is null."""

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name in pc.unique(answers.column("index")).to_pylist():
            some = answers.filter(pc.equal(answers.column("index"), name))
            parts = [(unpack_keys(raw, n, b << shift), p) for b, n, p, raw in zip(*(some.column(c).to_pylist() for c in ("bucket", "size", "priority", "keys")), strict=True)]
            keys, priority = np.concatenate([x for x, _ in parts]), np.concatenate([np.full(len(x), p) for x, p in parts])
            order = np.argsort(keys)
            held[name] = (keys[order], priority[order])
        asked = asked.combine_chunks()
        seq = asked.column("seq")
        part = pa.concat_arrays(asked.column("__part").chunks) if asked.num_rows else pa.array([], pa.string())
        index = pa.concat_arrays(asked.column("index").chunks) if asked.num_rows else pa.array([], pa.string())
        best = first_hits(part, index, k, held)
        settled = (best >= 0) | (pc.fill_null(pc.binary_length(seq), 0).to_numpy() < beyond + k)
        seq = pc.if_else(pa.array(settled), pa.scalar(None, seq.type), seq)
        return pa.table([*(seq if c == "seq" else asked.column(c) for c in columns), _priorities(best)], [*columns, "__priority"])

    return run
