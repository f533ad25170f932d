"""Signal tracks: files against plain Python, what a region reads, files of another byte order and step."""

import random
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from siteline import session
from siteline.sources import tracks as T

SIZES = {f"c{k:03d}": 50_000 for k in range(40)}


def intervals(seed=1, each=300, chroms=None):
    rng, out = random.Random(seed), []
    for c in chroms or SIZES:
        at = 0
        for _ in range(each):
            at += rng.choice([0, 0, 1, 7, 40])
            wide = rng.choice([1, 1, 1, 5, 60])
            out.append((c, at, at + wide, float(rng.randrange(-4, 9))))
            at += wide
    return out


def one_file(path, rows, monkeypatch=None, block=None, fanout=None):
    if block:
        monkeypatch.setattr(T, "BLOCK", block)
        monkeypatch.setattr(T, "FANOUT", fanout)
    f = T._File()
    for c in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == c]
        f.add(c, SIZES[c], *(np.array([r[k] for r in own]) for k in (1, 2, 3)))
    f.put(f"file://{path}")
    return f"file://{path}"


def scanned(uri, *filters):
    """Rows of a reader after its filters, and the blocks that it read."""
    reader = T.Reader(uri)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    rows, opened, real = [], [], T.Track.intervals
    try:
        T.Track.intervals = lambda self, offset, size: (opened.append(offset), real(self, offset, size))[1]
        for p in reader.partitions():
            for b in reader.read(p):
                rows += [tuple(r.values()) for r in b.to_pylist()]
    finally:
        T.Track.intervals = real
    return rows, len(opened)


@pytest.mark.parametrize(("block", "fanout"), [(1024, 256), (16, 3), (1, 2)])
def test_a_region_reads_its_blocks_only(tmp_path, monkeypatch, block, fanout):
    rows = intervals()
    uri = one_file(tmp_path / "a.bw", rows, monkeypatch, block, fanout)
    every, n_all = scanned(uri)
    assert every == rows and n_all == len(SIZES) * -(-300 // block)
    for c, low, high in [("c003", 100, 900), ("c039", 0, 10), ("c020", 4000, 4001), ("c020", 49_000, 50_000)]:
        got, n = scanned(uri, EqualTo(("chrom",), c), GreaterThan(("end_pos",), low), LessThan(("start_pos",), high))
        want = [r for r in rows if r[0] == c and r[2] > low and r[1] < high]
        assert got == want
        own = [r for r in rows if r[0] == c]
        holding = [own[k : k + block] for k in range(0, len(own), block)]
        assert n == sum(h[0][1] < high and h[-1][2] > low for h in holding)
    assert scanned(uri, EqualTo(("chrom",), "none")) == ([], 0)
    assert scanned(uri, In(("chrom",), ("c001", "c002")), EqualTo(("chrom",), "c003")) == ([], 0)


def test_filters_leave_no_row_out(tmp_path):
    rows = intervals(5, 60, list(SIZES)[:3])
    uri = one_file(tmp_path / "a.bw", rows)
    rng = random.Random(3)
    kinds = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
    for _ in range(300):
        some = rng.choice(rows)
        fs = [(rng.choice(list(kinds)), rng.choice([("start_pos", 1), ("end_pos", 2)]), some[rng.choice([1, 2])] + rng.choice([-1, 0, 1])) for _ in range(rng.choice([1, 2, 3]))]
        want = [r for r in rows if all(kinds[k](r[at], v) for k, (_, at), v in fs)]
        got = set(scanned(uri, *(k((name,), v) for k, (name, _), v in fs))[0])
        assert got.issuperset(want)


@pytest.mark.parametrize("order", "<>")
def test_files_of_other_writers(tmp_path, order):
    """Steps, both byte orders and bare blocks, written out by hand."""
    p = lambda fields, *v: struct.pack(order + fields, *v)
    blocks = [
        p("IIIIIBBH", 0, 10, 40, 10, 5, 3, 0, 3) + p("fff", 1, 2, 3),
        p("IIIIIBBH", 0, 100, 152, 0, 2, 2, 0, 2) + p("IfIf", 100, 4, 150, 5),
        p("IIIIIBBH", 1, 7, 9, 0, 0, 1, 0, 1) + p("IIf", 7, 9, -6),
    ]
    want = [("a", 10, 15, 1.0), ("a", 20, 25, 2.0), ("a", 30, 35, 3.0), ("a", 100, 102, 4.0), ("a", 150, 152, 5.0), ("bb", 7, 9, -6.0)]
    for packed in (False, True):
        body = [zlib.compress(b) if packed else b for b in blocks]
        tree = p("IIIIQQ", 0x78CA8C91, 2, 2, 8, 2, 0) + p("BBH", 1, 0, 2) + b"a\0" + p("II", 0, 500) + b"bb" + p("II", 1, 90)
        data = 64 + len(tree)
        at = [data + 8 + sum(map(len, body[:k])) for k in range(4)]
        places = [(0, 10, 0, 40), (0, 100, 0, 152), (1, 7, 1, 9)]
        index = p("IIQIIIIQII", 0x2468ACE0, 3, 3, 0, 10, 1, 9, at[3], 3, 0) + p("BBH", 1, 0, 3) + b"".join(p("IIIIQQ", *x, at[k], len(body[k])) for k, x in enumerate(places))
        head = p("IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, data, at[3], 0, 0, 0, 0, 4096 if packed else 0, 0)
        path = tmp_path / f"{packed}.bw"
        path.write_bytes(head + tree + p("Q", 3) + b"".join(body) + index)
        assert scanned(f"file://{path}") == (want, 3)
        assert scanned(f"file://{path}", EqualTo(("chrom",), "a"), GreaterThanOrEqual(("start_pos",), 60)) == (want[3:5], 1)
    assert scanned(f"file://{tmp_path}") == (want * 2, 6)


def test_a_written_track_reads_back(spark, monkeypatch):
    rows = intervals(2, 100)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 1, 2, 1.0), ("c000", 1, 2, None), ("c000", 1, 2, float("nan"))], "chrom string, start_pos long, end_pos long, value double")
    sizes = spark.createDataFrame(list(SIZES.items()), "chrom string, size long")
    path = session.scratch(spark, "track")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    try:
        T.write(df.repartition(5), sizes, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = T.read(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    some = back.filter("chrom = 'c007' and start_pos >= 50 and end_pos < 400")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] == "c007" and r[1] >= 50 and r[2] < 400)
    assert back.filter("chrom = 'x'").count() == 0 and back.filter("chrom is null").count() == 0
    with pytest.raises(ValueError, match="already"):
        T.write(df, sizes, path)
    # files without a wanted place aren't opened, and what a failed attempt left isn't in the manifest
    fs, local = T._fs(path)
    with fs.open_output_stream(f"{local}/part-left.bw") as f:
        f.write(b"half")
    opened, real = [], T.Track.__init__
    monkeypatch.setattr(T.Track, "__init__", lambda self, uri: (opened.append(uri), real(self, uri))[1])
    got, _ = scanned(path, EqualTo(("chrom",), "c000"))
    files = [i for i in fs.get_file_info(pafs.FileSelector(local)) if i.base_name.endswith(".bw")]
    assert sorted(got) == sorted(r for r in rows if r[0] == "c000") and len(set(opened)) < len(files) - 1


def test_an_empty_track(spark):
    df = spark.createDataFrame([], "chrom string, start_pos long, end_pos long, value double")
    path = session.scratch(spark, "track")
    T.write(df, spark.createDataFrame([("a", 9)], "chrom string, size long"), path)
    assert T.read(spark, path).collect() == []


@pytest.mark.parametrize("rows", [[("a", 1, 5, 1.0), ("a", 4, 6, 1.0)], [("a", 3, 3, 1.0)], [("a", 5, 11, 1.0)], [("a", -1, 2, 1.0)], [("b", 1, 2, 1.0)]])
def test_what_a_track_cannot_hold_raises(spark, rows):
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, value double")
    with pytest.raises(Exception, match="overlap|bounds"):
        T.write(df, spark.createDataFrame([("a", 10)], "chrom string, size long"), session.scratch(spark, "track"))


def test_files_of_bounded_size(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "FILE_ITEMS", 2048)
    own = T.Writer(f"file://{tmp_path}")
    rows = [("c000", k, k + 1, float(k % 7)) for k in range(10_000)]
    cols = [pa.array([r[k] for r in rows]) for k in range(4)] + [pa.array([50_000.0] * len(rows))]
    batch = pa.RecordBatch.from_arrays(cols, ["chrom", "start_pos", "end_pos", "value", "size"])
    put = own.write(iter([batch.slice(0, 3), batch.slice(3)]))
    own.commit([put, None])
    assert len(put.files) == 5 and scanned(f"file://{tmp_path}")[0] == rows
    got, n = scanned(f"file://{tmp_path}", GreaterThanOrEqual(("start_pos",), 9_000), LessThan(("start_pos",), 9_010))
    assert set(got).issuperset(rows[9_000:9_010]) and n <= 2


def test_values_of_windows(spark):
    rows = intervals(4, 200, list(SIZES)[:2])
    track = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, value double")
    rng = random.Random(9)
    windows = [(k, c, a, a + rng.choice([0, 1, 30, 700])) for k, (c, a) in enumerate((rng.choice(["c000", "c001", "zz"]), rng.randrange(3000)) for _ in range(60))]
    windows += [(100, *windows[0][1:])]
    got = T.values(track, spark.createDataFrame(windows, "peak_idx long, chrom string, start_pos long, end_pos long"), absolute=True)
    at = {(c, x): abs(v) for c, s, e, v in rows for x in range(s, e)}
    assert sorted(map(tuple, got.collect())) == sorted((k, x, at.get((c, x), 0.0)) for k, c, a, b in windows for x in range(a, b))
