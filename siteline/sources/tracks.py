"""Signal tracks in bigWig: a data source that reads only the blocks a filter touches, and a sink that writes in parts.

A bigWig file holds a header, a tree of chromosomes, compressed blocks of intervals sorted by place, and an index tree over
the blocks' places.  ``read`` plans from the index: the driver reads each file's header and the index's root, a task descends
from its share of the root's slots, and filters on chrom, start_pos and end_pos leave out slots, nodes and blocks.  A track of
this sink is a folder of such files, each a range of the order, named in a manifest with their first and last place, so that
files without a wanted place aren't opened.  Single files and folders of files written elsewhere are read too.

Values are stored as 32-bit floats.  Chromosomes that no file holds give no rows, as does an empty track.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from siteline import session

FORMAT = "siteline_track"
MANIFEST = "_tracks.json"
SCHEMA = "chrom string, start_pos long, end_pos long, value double"
# fixed values of the format
FILE_MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER, CHROM_HEADER, INDEX_HEADER, SUMMARY, SECTION = "IHHQQQHHQQIQ", "IIIIQQ", "IIQIIIIQII", "Qdddd", "IIIIIBBH"
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
#: Slots of a tree's node, and intervals of a block.
FANOUT, BLOCK = 256, 1024
#: Intervals of a file: its compressed blocks are held in a task's memory until it is written.
FILE_ITEMS = 8_000_000
#: Compressed bytes that a task reads, about.
TASK_BYTES = 32 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _bytes(order: str, fields: str, *values: object) -> bytes:
    return struct.pack(order + fields, *values)


@dataclass(frozen=True)
class Wanted:
    """What a scan's filters leave: chromosomes (all where None) and intervals with start_pos < high and end_pos > low."""

    chroms: frozenset[str] | None = None
    low: float = -np.inf
    high: float = np.inf

    def narrowed(self, f: Filter) -> Wanted:
        """Fewer places by one filter; those that say nothing of places change nothing."""
        name = getattr(f, "attribute", ("",))[0]
        value = getattr(f, "value", None)
        if name == "chrom" and isinstance(f, EqualTo | In):
            own = frozenset([value] if isinstance(f, EqualTo) else value)
            return replace(self, chroms=own if self.chroms is None else self.chroms & own)
        if name not in ("start_pos", "end_pos") or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or value is None:
            return self
        starts, low, high = name == "start_pos", self.low, self.high
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):  # an interval ends after its start
            low = max(low, value if starts else value - (not isinstance(f, GreaterThan)))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            high = min(high, value + (not isinstance(f, LessThan)) if starts else value)
        return replace(self, low=low, high=high)


class Track:
    """A bigWig file, open for reading; counts the blocks that it has read."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.file = fs.open_input_file(path)
        raw = self.file.read_at(64, 0)
        self.order = next((o for o in "<>" if len(raw) == 64 and struct.unpack_from(o + "I", raw)[0] == FILE_MAGIC), "")
        if not self.order:
            raise ValueError(f"not a bigWig file: {uri}")
        head = struct.unpack(self.order + HEADER, raw)
        self.compressed, self.data, self.index, self.blocks_read = head[10] > 0, head[4], head[5], 0
        magic, _, self.key_size, *_ = self._unpack(CHROM_HEADER, head[3])
        if magic != CHROM_MAGIC or self._unpack(INDEX_HEADER, self.index)[0] != INDEX_MAGIC:
            raise ValueError(f"a broken bigWig file: {uri}")
        self.chroms: dict[int, str] = dict(self._chroms(head[3] + struct.calcsize("<" + CHROM_HEADER)))

    def _unpack(self, fields: str, at: int) -> tuple:
        return struct.unpack(self.order + fields, self.file.read_at(struct.calcsize("<" + fields), at))

    def _chroms(self, at: int) -> Iterator[tuple[int, str]]:
        leaf, _, n = self._unpack("BBH", at)
        raw = self.file.read_at(n * (self.key_size + 8), at + 4)
        for k in range(n):
            slot = raw[k * (self.key_size + 8) :]
            if leaf:
                yield struct.unpack_from(self.order + "I", slot, self.key_size)[0], slot[: self.key_size].rstrip(b"\0").decode()
            else:
                yield from self._chroms(struct.unpack_from(self.order + "Q", slot, self.key_size)[0])

    @property
    def root(self) -> int:
        return self.index + struct.calcsize("<" + INDEX_HEADER)

    def ids(self, wanted: Wanted) -> np.ndarray:
        return np.array(sorted(k for k, name in self.chroms.items() if wanted.chroms is None or name in wanted.chroms), np.int64)

    def slots(self, at: int, ids: np.ndarray, wanted: Wanted) -> tuple[bool, list[tuple[int, int]]]:
        """Whether the node is a leaf, and (offset, size) of its slots that may hold a wanted place; size is 0 of a node."""
        leaf, _, n = self._unpack("BBH", at)
        kind = np.dtype([(x, self.order + "u4") for x in ("c0", "b0", "c1", "b1")] + [("at", self.order + "u8")] + ([("size", self.order + "u8")] if leaf else []))
        own = np.frombuffer(self.file.read_at(n * kind.itemsize, at + 4), kind)
        keep = np.searchsorted(ids, own["c1"], "right") > np.searchsorted(ids, own["c0"], "left")
        keep &= (own["c0"] != own["c1"]) | ((own["b0"] < wanted.high) & (own["b1"] > wanted.low))
        return bool(leaf), [(int(s["at"]), int(s["size"]) if leaf else 0) for s in own[keep]]

    def blocks(self, at: int, ids: np.ndarray, wanted: Wanted) -> Iterator[tuple[int, int]]:
        """Offsets and sizes of the blocks below a node that may hold a wanted place, in order."""
        leaf, own = self.slots(at, ids, wanted)
        for offset, size in own:
            if leaf:
                yield offset, size
            else:
                yield from self.blocks(offset, ids, wanted)

    def intervals(self, offset: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """A block's chromosome id, starts, ends and values."""
        self.blocks_read += 1
        raw = self.file.read_at(size, offset)
        raw = zlib.decompress(raw) if self.compressed else raw
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(self.order + SECTION, raw)
        fields = {BED_GRAPH: ["start", "end"], VARIABLE_STEP: ["start"], FIXED_STEP: []}[kind]
        own = np.frombuffer(raw, np.dtype([(x, self.order + "u4") for x in fields] + [("value", self.order + "f4")]), n, 24)
        starts = own["start"].astype(np.int64) if "start" in fields else start + step * np.arange(n, dtype=np.int64)
        return chrom, starts, own["end"].astype(np.int64) if "end" in fields else starts + span, own["value"].astype(float)


@dataclass
class Share(InputPartition):
    """What one task reads: files with the index nodes and blocks to start from."""

    pieces: list[tuple[str, list[tuple[int, int]]]]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters narrow the places; Spark tests them all again on the intervals, as a block holds others too."""
        for f in filters:
            self.wanted = self.wanted.narrowed(f)
            yield f

    def _files(self) -> Iterator[str]:
        """The files that may hold a wanted place."""
        fs, path = _fs(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            yield self.path
            return
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_file(f"{path}/{MANIFEST}") as f:
                held = json.loads(f.read())
            low, high, wanted = self.wanted.low, self.wanted.high, self.wanted.chroms
            for own in held:
                (c0, b0), (c1, b1) = own["first"], own["last"]
                near = wanted is None or any(c0.encode() <= c.encode() <= c1.encode() for c in wanted if c is not None)
                if near and (c0 != c1 or (b0 < high and b1 > low)):
                    yield f"{self.path}/{own['name']}"
            return
        for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda i: i.path):
            if info.is_file and info.base_name.lower().endswith((".bw", ".bigwig")):
                yield f"{self.path}/{info.base_name}"

    def partitions(self) -> list[Share]:
        out, held, pieces = [], 0, []
        for uri in self._files():
            track = Track(uri)
            ids = track.ids(self.wanted)
            leaf, own = track.slots(track.root, ids, self.wanted) if len(ids) else (True, [])
            n_slots = max(1, track._unpack("BBH", track.root)[2])
            for offset, size in own:
                if not pieces or pieces[-1][0] != uri:
                    pieces.append((uri, []))
                pieces[-1][1].append((offset, size))
                held += size if leaf else (track.index - track.data) // n_slots
                if held >= TASK_BYTES:
                    out.append(Share(pieces))
                    held, pieces = 0, []
        if pieces:
            out.append(Share(pieces))
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("chrom", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("value", pa.float64())])
        for uri, own in getattr(partition, "pieces", []):
            track = Track(uri)
            ids = track.ids(self.wanted)
            for offset, size in own:
                for block in [(offset, size)] if size else track.blocks(offset, ids, self.wanted):
                    chrom, start, end, value = track.intervals(*block)
                    keep = (start < self.wanted.high) & (end > self.wanted.low)
                    n = int(keep.sum())
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(track.chroms[chrom]), n), pa.array(start[keep]), pa.array(end[keep]), pa.array(value[keep])], schema=fields)


@dataclass
class Put(WriterCommitMessage):
    """The files that a task has written."""

    files: list[dict]


class _File:
    """A bigWig file in the making."""

    def __init__(self) -> None:
        self.items, self.body, self.blocks, self.names, self.sizes = 0, bytearray(), [], [], []
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.widest = 0, 0
        self.lows, self.highs, self.sums = [], [], np.zeros(3)

    def add(self, chrom: str, size: int, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
        if not self.names or self.names[-1] != chrom:
            self.emit(1)
            self.names.append(chrom)
            self.sizes.append(size)
        self.pending.append((start, end, value))
        self.items += len(start)
        self.waiting += len(start)
        if self.waiting >= BLOCK:
            self.emit(BLOCK)

    def emit(self, least: int) -> None:
        """Compresses blocks while ``least`` intervals wait."""
        if not self.pending:
            return
        start, end, value = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        done = 0
        while len(start) - done >= least:
            s, e, v = (x[done : done + BLOCK] for x in (start, end, value))
            done += len(s)
            span = int(e[0] - s[0])
            even = bool((e - s == span).all())
            own = np.empty(len(s), [("start", "<u4"), ("value", "<f4")] if even else [("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
            own["start"], own["value"] = s, v
            if not even:
                own["end"] = e
            chrom = len(self.names) - 1
            raw = _bytes("<", SECTION, chrom, s[0], e[-1], 0, span if even else 0, VARIABLE_STEP if even else BED_GRAPH, 0, len(s)) + own.tobytes()
            packed = zlib.compress(raw)
            self.widest = max(self.widest, len(raw))
            self.blocks.append((chrom, int(s[0]), int(e[-1]), len(self.body), len(packed)))
            self.body += packed
            self.lows.append(float(v.min()))
            self.highs.append(float(v.max()))
            self.sums += ((e - s).sum(), ((e - s) * v).sum(), ((e - s) * v * v).sum())
        self.pending = [(start[done:], end[done:], value[done:])] if done < len(start) else []
        self.waiting = len(start) - done

    def put(self, uri: str) -> None:
        self.emit(1)
        order, width = "<", max(len(c.encode()) for c in self.names)
        chroms_at = 64 + struct.calcsize("<" + SUMMARY)
        keys = [c.encode().ljust(width, b"\0") for c in self.names]
        slots = [k + _bytes(order, "II", j, size) for j, (k, size) in enumerate(zip(keys, self.sizes, strict=True))]
        tree = _bytes(order, CHROM_HEADER, CHROM_MAGIC, FANOUT, width, 8, len(keys), 0)
        tree += _nodes(slots, keys, lambda own: own[0], lambda key: key, chroms_at + len(tree))
        data_at = chroms_at + len(tree)
        spans = [(c, s, c, e) for c, s, e, _, _ in self.blocks]
        leaves = [_bytes(order, "IIIIQQ", *span, data_at + 8 + at, size) for span, (_, _, _, at, size) in zip(spans, self.blocks, strict=True)]
        index_at = data_at + 8 + len(self.body)
        index = _bytes(order, INDEX_HEADER, INDEX_MAGIC, FANOUT, len(leaves), *spans[0][:2], *spans[-1][2:], index_at, BLOCK, 0)
        index += _nodes(leaves, spans, lambda own: (*own[0][:2], *own[-1][2:]), lambda span: _bytes(order, "IIII", *span), index_at + len(index))
        head = _bytes(order, HEADER, FILE_MAGIC, 4, 0, chroms_at, data_at, index_at, 0, 0, 0, 64, self.widest, 0)
        summary = _bytes(order, SUMMARY, int(self.sums[0]), min(self.lows), max(self.highs), self.sums[1], self.sums[2])
        fs, path = _fs(uri)
        with fs.open_output_stream(path) as f:
            for part in (head, summary, tree, _bytes(order, "Q", len(self.blocks)), self.body, index):
                f.write(part)


def _nodes(slots: Sequence[bytes], spans: Sequence, joined, head, at: int) -> bytes:
    """A tree's nodes from the root down, placed from ``at`` on; an inner slot is its node's span and offset."""
    levels = [[(slots[k : k + FANOUT], joined(spans[k : k + FANOUT])) for k in range(0, len(slots), FANOUT)]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([(below[k : k + FANOUT], joined([span for _, span in below[k : k + FANOUT]])) for k in range(0, len(below), FANOUT)])
    inner = len(head(levels[-1][0][1])) + 8
    wide = [len(slots[0])] + [inner] * (len(levels) - 1)
    out = bytearray()
    for depth in reversed(range(len(levels))):
        child = at + sum(4 + len(own) * wide[depth] for own, _ in levels[depth])
        at = child
        for own, _ in levels[depth]:
            out += _bytes("<", "BBH", depth == 0, 0, len(own))
            for slot in own:
                out += slot if depth == 0 else head(slot[1]) + _bytes("<", "Q", child)
                child += 0 if depth == 0 else 4 + len(slot[0]) * wide[depth - 1]
    return bytes(out)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Put:
        files: list[dict] = []
        own, first, last = _File(), None, None

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}.bw"  # of this attempt: only the files of committed ones come to the manifest
            own.put(f"{self.path}/{name}")
            files.append({"name": name, "items": own.items, "first": first, "last": last})

        for batch in iterator:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            chroms, sizes = (cols[c].to_numpy(zero_copy_only=False) for c in ("chrom", "size"))
            start, end, value = (cols[c].to_numpy(zero_copy_only=False) for c in ("start_pos", "end_pos", "value"))
            cuts = np.flatnonzero(chroms[1:] != chroms[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(chroms)], strict=True):
                if a == b:
                    continue
                chrom, s, e = chroms[a], start[a:b], end[a:b]
                if not np.isfinite(sizes[a]) or s[0] < 0 or (s >= e).any() or e[-1] > sizes[a]:
                    raise ValueError(f"an interval of {chrom} is empty or outside its bounds")
                if (s[1:] < e[:-1]).any() or (last is not None and last[0] == chrom and s[0] < last[1]):
                    raise ValueError(f"intervals of {chrom} overlap")
                for k in range(0, b - a, BLOCK):
                    if own.items >= FILE_ITEMS:
                        close()
                        own, first = _File(), None
                    first = first or [chrom, int(s[k])]
                    last = [chrom, int(e[k : k + BLOCK][-1])]
                    own.add(chrom, int(sizes[a]), s[k : k + BLOCK], e[k : k + BLOCK], value[a:b][k : k + BLOCK])
        if own.items:
            close()
        return Put(files)

    def commit(self, messages: list[Put | None]) -> None:
        """The manifest, put there last: a track without one isn't whole."""
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["first"][0].encode(), f["first"][1]))
        for a, b in zip(files, files[1:], strict=False):
            if a["last"][0] == b["first"][0] and a["last"][1] > b["first"][1]:
                raise ValueError(f"intervals of {a['last'][0]} overlap")
        fs, path = _fs(self.path)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Put | None]) -> None:
        fs, path = _fs(self.path)
        for own in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{path}/{own['name']}")


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos and value of a track, a bigWig file or a folder of them; filters on places reach the index."""
    spark.dataSource.register(Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).load(session.qualified(spark, path))


def write(track: DataFrame, sizes: DataFrame, path: str) -> None:
    """Writes ``track`` (chrom, start_pos, end_pos, value) as a new folder of bigWig files, in ranges of the order.

    ``sizes`` (chrom, size) bounds the chromosomes.  Rows with a null, and values that aren't numbers, hold no signal and
    are left out.  Intervals that overlap, are empty or lie outside their chromosome, or whose chromosome has no size, raise.
    """
    spark = track.sparkSession
    spark.dataSource.register(Source)
    full = session.qualified(spark, path)
    fs, local = _fs(full)
    if fs.get_file_info(local).type != pafs.FileType.NotFound:
        raise ValueError(f"there is something already: {full}")
    fs.create_dir(local)
    held = track.select("chrom", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"), F.col("value").cast("double")).dropna().filter(~F.isnan("value"))
    bounded = held.join(sizes.select("chrom", F.col("size").cast("double").alias("size")), "chrom", "left")
    dealt = bounded.withColumn("size", F.coalesce("size", F.lit(float("nan")))).repartitionByRange("chrom", "start_pos").sortWithinPartitions("chrom", "start_pos")
    dealt.write.format(FORMAT).mode("append").save(full)


def values(track: DataFrame, windows: DataFrame, key: str = "peak_idx", absolute: bool = False, width: int = 256) -> DataFrame:
    """The value at each base of each window (``key``, chrom, start_pos, end_pos): ``key``, pos, value; 0 where the track has none.

    Windows and intervals meet in bins of ``width`` bases, and only there; an interval's bases outside the windows are never made.
    """
    grid = windows.filter("start_pos < end_pos").select(key, "chrom", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("bin")
    own = track.select("chrom", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), (F.abs("value") if absolute else F.col("value")).alias("value"), bins("start_pos", "end_pos"))
    wide = windows.filter("start_pos < end_pos").select("chrom", "start_pos", "end_pos").distinct()  # repeated windows meet once
    near = wide.select("chrom", "start_pos", "end_pos", bins("start_pos", "end_pos"))
    low, high = F.greatest("s", "start_pos", F.col("bin") * width), F.least("e", "end_pos", (F.col("bin") + 1) * width)
    met = near.join(own, ["chrom", "bin"]).filter((F.col("s") < F.col("end_pos")) & (F.col("e") > F.col("start_pos"))).filter(low < high)
    bases = met.select("chrom", F.explode(F.sequence(low, high - 1)).alias("pos"), "value").groupBy("chrom", "pos").agg(F.max("value").alias("value"))  # a base of several windows, once
    return grid.join(bases, ["chrom", "pos"], "left").select(key, "pos", F.coalesce("value", F.lit(0.0)).alias("value"))
