"""Scans along an order, barcode clustering, trimming and k-mer look-ups, against plain Python."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siteline import session
from siteline.functions import trim
from siteline.operators import barcodes, compare, folds, intervals, prefix, qc, relational, signal
from siteline.plans import proxies


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def crowded(spark):
    """Intervals of which one chromosome has nine tenths."""
    r = random.Random(4)
    data = [("a" if r.random() < 0.9 else r.choice(["b", "c", None]), s, s + r.randrange(60), k) for k, s in enumerate(r.randrange(40000) for _ in range(4000))]
    return data, spark.createDataFrame(data, "chrom string, start_pos long, end_pos long, peak_idx long")


def test_running_values_equal_a_walk(crowded):
    data, df = crowded
    got = {r.peak_idx: (r.total, r.top) for r in prefix.running(prefix.running(prefix.placed(df, ["chrom"], ["start_pos", "peak_idx"]), ["chrom"], "sum", F.col("end_pos"), "total"), ["chrom"], "max", F.col("end_pos"), "top", before=True).collect()}
    seen = collections.defaultdict(lambda: [0, None])
    for chrom, _, end, k in sorted(data, key=lambda x: (str(x[0]), x[1], x[3])):
        held = seen[chrom]
        assert got[k] == (held[0] + end, held[1])
        seen[chrom] = [held[0] + end, end if held[1] is None else max(held[1], end)]


def test_parts_are_even_whatever_the_keys(spark, crowded):
    _, df = crowded
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r["n"] for r in prefix.placed(df, ["chrom"], ["start_pos", "peak_idx"]).groupBy(prefix.PART).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(sizes) >= 12 and max(sizes) <= 2 * statistics.median(sizes)


def test_interval_scans_equal_a_walk(crowded):
    data, df = crowded
    by = collections.defaultdict(list)
    for chrom, s, e, k in data:
        by[chrom].append((s, e, k))
    merged, groups, tops, depth = [], {}, {}, []
    for chrom, own in by.items():
        out, top = [], None
        for s, e, k in sorted(own):
            top = e if top is None else max(top, e)
            tops[k] = top
            if out and s - out[-1][1] <= 7:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + 1)
            else:
                out.append((s, e, 1))
        merged += [(chrom, *x) for x in out]
        grp, last = 0, None
        for c, k in sorted(((s + e) // 2, k) for s, e, k in own):
            grp += last is None or c - last > 5
            groups[k], last = grp, c
        events = collections.Counter()
        for s, e, _ in own:
            events[s] += 1
            events[e] -= 1
        level = 0
        for pos in sorted(events):
            level += events[pos]
            depth.append((chrom, pos, level))
    assert rows(intervals.merge_gap(df, 7).select("chrom", "start_pos", "end_pos", "n")) == sorted(merged, key=str)
    assert {r.peak_idx: r.max_end for r in intervals.running_max_end(df).collect()} == tops
    centred = df.select("chrom", "peak_idx", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("center"))
    assert {r.peak_idx: r.grp for r in intervals.gap_groups(centred, 5).collect()} == groups
    assert [x for x in rows(intervals.depths(df)) if x[0] == "a"] == sorted((x for x in depth if x[0] == "a"), key=str)


@pytest.mark.parametrize("width", [100, 10_000])
def test_window_totals_equal_sums(spark, crowded, width):
    data, df = crowded
    r = random.Random(1)
    bases = [(r.choice("ab"), r.randrange(41000), r.choice("+-"), float(r.randrange(1, 9))) for _ in range(1500)]
    got = {x.peak_idx: x.total for x in signal.window_totals(df.filter("peak_idx < 300"), spark.createDataFrame(bases, "chrom string, pos long, strand string, value double"), width).collect()}
    for chrom, s, e, k in data:
        if k < 300:
            low, high = max(0, (s + e) // 2 - width // 2), (s + e) // 2 + (width + 1) // 2
            assert got[k] == sum(v for c, p, _, v in bases if c == chrom and low <= p < high)


def test_window_totals_cost_the_same_at_any_width(spark, crowded):
    """The rows that are scanned are two for a window and one for a base."""
    _, df = crowded
    bases = spark.createDataFrame([("a", k, "+", 1.0) for k in range(0, 40000, 7)], "chrom string, pos long, strand string, value double")
    plans = [signal.window_totals(df, bases, w)._jdf.queryExecution().optimizedPlan().toString() for w in (100, 10_000)]
    assert all("sequence(" not in p for p in plans)


def test_order_statistics_and_ranks(spark):
    r = random.Random(2)
    data = [(r.choice(["x", "y", None]), r.choice([None, 0.0, 0.0, 0.0, r.random()]), float(r.randrange(5))) for _ in range(900)] + [("alone", 3.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double, w double")
    by = collections.defaultdict(list)
    for k, v, _ in data:
        if v is not None:
            by[k].append(v)
    got = {x.k: (x.low, x["mid"], x["__count"]) for x in prefix.quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    for k, own in by.items():
        own.sort()
        h = 0.1 * (len(own) - 1)
        low = own[math.floor(h)] + (h - math.floor(h)) * (own[math.ceil(h)] - own[math.floor(h)])
        assert got[k] == (pytest.approx(low), pytest.approx(statistics.median(own)), len(own))
    assert got["none"] == (None, None, 0)
    empty = prefix.quantiles(df.limit(0), [], "v", {"q": 0.5}).collect()
    assert [tuple(x) for x in empty] == [(0, None)]
    rank = {(x.k, x.v): x.r for x in prefix.average_ranks(df, ["k"], "v", "r").collect()}
    for k, own in by.items():
        for v in set(own):
            assert rank[k, v] == statistics.mean(j + 1 for j, u in enumerate(own) if u == v)
    rho = {x.k: (x.rho, x.n) for x in compare.spearman(df, "v", "w", ["k"]).collect()}
    assert rho["alone"] == (None, 1)
    own = [(v, w) for k, v, w in data if k == "x" and v is not None]
    place = lambda xs: {v: statistics.mean(j + 1 for j, u in enumerate(sorted(xs)) if u == v) for v in set(xs)}
    a, b = place([v for v, _ in own]), place([w for _, w in own])
    assert rho["x"] == (pytest.approx(statistics.correlation([a[v] for v, _ in own], [b[w] for _, w in own])), len(own))


def test_peer_median(spark):
    data = [(k, k % 3 if k < 40 else None, float((k * 7) % 11)) for k in range(43)] + [(99, 7, 1.0)]
    got = {x.i: x.m for x in compare.peer_median(spark.createDataFrame(data, "i long, g long, v double"), ["g"], "v", "i", "m").collect()}
    for i, g, _ in data:
        rest = [v for j, h, v in data if h == g and j != i]
        assert got[i] == (statistics.median(rest) if rest else None)


def test_quota_matching_prunes_and_breaks_ties(spark):
    tiles = [(f"c{k % 5}", k, k % 4, (k * 37) % 64) for k in range(800)]
    peaks = [(b,) for b, n in ((0, 3), (1, 50), (2, 500), (9, 4)) for _ in range(n)]
    t = spark.createDataFrame(tiles, "chrom string, start_pos long, bin long, o long")
    got = folds.gc_match(t, spark.createDataFrame(peaks, "bin long"), F.col("o"), ["chrom", "start_pos"], span=64, cells=8)
    want = []
    for b, n in ((0, 3), (1, 50), (2, 500)):
        want += sorted((x for x in tiles if x[2] == b), key=lambda x: (x[3], x[0], x[1]))[:n]
    assert rows(got.select("chrom", "start_pos", "bin", "o")) == sorted(want, key=str)


def cluster(counts):
    """Roots by the plain procedure: from the most read barcode on, everything that links reach."""
    order = sorted(counts, key=lambda u: (-counts[u], u))
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    takes = {a: [b for b in counts if near(a, b) and counts[a] >= 2 * counts[b] - 1] for a in counts}
    root = {}
    for u in order:
        if u in root:
            continue
        todo, seen = [u], {u}
        while todo:
            for b in takes[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        for x in seen:
            root.setdefault(x, u)
    return root


def test_directional_clusters_equal_the_plain_procedure(spark):
    r = random.Random(6)
    reads = []
    for place, size, length in ((0, 900, 5), (1, 2500, 6), (2, 40, 3), (None, 60, 4)):
        seeds = ["".join(r.choice("ACGTN") for _ in range(length)) for _ in range(size // 6)]
        for _ in range(size):
            u = r.choice(seeds)
            if r.random() < 0.5:
                k = r.randrange(length)
                u = u[:k] + r.choice("ACGT") + u[k + 1 :]
            reads.append((place, u))
    reads += [(3, "A" * k + "C" * (60 - k)) for k in range(61)] + [(4, ""), (4, "A"), (4, None), (4, "AC")]  # a chain, of which each link is read once
    got = collections.defaultdict(dict)
    for x in barcodes.directional(spark.createDataFrame(reads, "place long, umi string"), ["place"]).collect():
        got[x.place][x.umi] = (x.root, x.n)
    for place in {p for p, _ in reads}:
        counts = collections.Counter(u for p, u in reads if p == place and u is not None)
        root = cluster(counts)
        assert got[place] == {u: (root[u], n) for u, n in counts.items()}


def plain_start(s, adapter, least=4, per=8, ahead=0):
    for p in range(-ahead, len(s) - least + 1):
        at, skip = max(p, 0), max(-p, 0)
        both = min(len(adapter) - skip, len(s) - at)
        if both >= least and sum(x != y for x, y in zip(s[at : at + both], adapter[skip : skip + both], strict=True)) <= both // per:
            return p
    return None


def plain_tail(s, base, least, most=5, per=8):
    fits = [n for n in range(1, len(s) + 1) if n >= least and s[-n] == base and sum(c != base for c in s[-n:]) <= min(most, n // per)]
    return max(fits, default=0)


def test_trimming_equals_plain_python(spark):
    r = random.Random(9)
    adapters = ["TGGAATTCTCGGGTGCCAAGG", "AGATCGGAAGAGC"]
    reads = ["", "A", "ACGT", None, "G" * 40, adapters[0], adapters[1][3:]]
    for _ in range(400):
        insert = "".join(r.choice("ACGTN") for _ in range(r.randrange(30)))
        tail = list(r.choice(adapters)[r.randrange(4) :])
        for _ in range(r.randrange(4)):  # up to three wrong bases
            tail[r.randrange(len(tail))] = r.choice("ACGT")
        reads.append((insert + "".join(tail) + r.choice(["", "G" * r.randrange(30), "GGGGGGGTGGGGGGGGGAGG"]))[: r.randrange(5, 70)])
    df = spark.createDataFrame([(k, s) for k, s in enumerate(reads)], "i long, s string")
    s = F.col("s")
    out = df.select("i", "s", *(trim.adapter_start(s, a, ahead=h).alias(f"p{j}{h}") for j, a in enumerate(adapters) for h in (0, 4)), trim.trim_adapters(s, adapters).alias("cut"), trim.tail_length(s, "G").alias("g"), trim.tail_length(s, "GA", least=3).alias("ga"), trim.trim_tail(s, "G").alias("ct")).collect()
    for x in out:
        if x.s is None:
            assert x.p00 is None and x.cut is None and x.g is None and x.ct is None
            continue
        starts = [plain_start(x.s, a) for a in adapters]
        assert [x.p00, x.p10] == starts and [x.p04, x.p14] == [plain_start(x.s, a, ahead=4) for a in adapters]
        found = [p for p in starts if p is not None]
        assert x.cut == (x.s[: min(found)] if found else x.s)
        assert x.g == plain_tail(x.s, "G", 10) and x.ga == max(plain_tail(x.s, "G", 3), plain_tail(x.s, "A", 3))
        assert x.ct == x.s[: len(x.s) - x.g]


def test_insert_length_of_mates(spark):
    r = random.Random(3)
    back = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    pairs = [("", ""), (None, "A"), ("A" * 40, "T" * 40)]
    for n in range(20, 80):
        insert = "".join(r.choice("ACGT") for _ in range(n))
        one = list((insert + "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA")[:60])
        for _ in range(r.randrange(7)):
            one[r.randrange(len(one))] = r.choice("ACGT")
        pairs.append(("".join(one), (back(insert) + "TGGAATTCTCGGGTGCCAAGGAACTCC")[:50]))
    got = [x[0] for x in spark.createDataFrame(pairs, "a string, b string").select(trim.insert_length(F.col("a"), F.col("b"))).collect()]
    for (one, two), n in zip(pairs, got, strict=True):
        if one is None:
            assert n is None
            continue
        rc = back(two)
        fits = [i for i in range(30, min(len(one), len(two)) + 1) if sum(x != y for x, y in zip(one[:i], rc[len(rc) - i :], strict=True)) <= min(5, i * 20 // 100)]
        assert n == max(fits, default=None)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_reads_are_classed_by_their_first_kmer(spark, block):
    r = random.Random(5)
    base = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    refs = [(ix, base(60) + "x" * (k % 2) + base(30), c, p) for ix in ("one", "two", None) for k, (c, p) in enumerate((("a", 0), ("b", 1), ("c", 2)))] + [("one", None, "a", 0), ("two", "ACG", "b", 1)]
    back = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    k, known = 7, {}
    for ix, s, c, p in refs:
        for t in (s, back(s)) if s else ():
            for i in range(len(t) - k + 1):
                if "x" not in t[i : i + k]:
                    key = (ix or "", t[i : i + k])
                    known[key] = min(known.get(key, (9, "")), (p, c))
    reads = [(j, r.choice(["one", "two", None, "three"]), r.choice([None, "", "ACGTA", base(200), base(150) + (t := r.choice(refs)[1] or "ACG")[5:40], back((r.choice(refs)[1] or "ACGTACGT")[3:60])])) for j in range(300)]
    df = spark.createDataFrame(reads, "read long, index string, seq string").withColumn("more", F.lit("m"))
    got = {x.read: x["class"] for x in qc.classify_reads(df, spark.createDataFrame(refs, "index string, seq string, class string, priority int"), k, block).collect()}
    for j, ix, s in reads:
        hits = [known.get((ix or "", (s or "")[i : i + k])) for i in range(len(s or "") - k + 1)]
        assert got[j] == next((h[1] for h in hits if h), None), (j, ix, s)


def test_rrna_content_tells_unmeasured_from_nothing(spark):
    ref = "ACGTTGCAAGCTTGCATGCC"
    refs = spark.createDataFrame([("s", ref, "rrna_5s", 1), ("o", ref, "organellar", 2)], "index string, seq string, class string, priority int")
    ex = spark.createDataFrame([("e1", "s"), ("e2", "o"), ("e3", "none"), ("e4", "s")], "experiment string, index string")
    ins = spark.createDataFrame([("e1", 1, ref), ("e1", 2, "T" * 20), ("e1", 3, "ACG"), ("e1", 4, ref), ("e2", 5, ref), ("e3", 6, ref)], "experiment string, read long, seq string")
    got = {x.experiment: tuple(x)[1:] for x in qc.rrna_content(ex, ins, refs, 10).collect()}
    assert got == {"e1": (3, "yes", 0.0, 66.67, 0.0, 66.67), "e2": (1, "no", 0.0, 0.0, 100.0, 100.0), "e3": (0, None, None, None, None, None), "e4": (0, None, None, None, None, None)}
    assert {x.experiment: x.n_scored for x in qc.rrna_content(ex, ins, refs, 10, per=2).collect()}["e1"] == 2


def test_views_follow_their_tables(spark, tmp_path):
    """A file replaced inside a table's folder is seen by the next query."""
    from siteline.plans import catalogue

    write = lambda text, mate: spark.createDataFrame([(1, text, mate, "r", 1), (2, text, None, "r", 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet/day=1")
    q = catalogue.queries()["ext_merge_run_fastqs"]
    write("ACGT", "en")
    assert rows(q(spark, str(tmp_path))) == [("r", 2, 8)]  # a read without a mate counts too
    write("ACGTACGTACGT", "xx")
    assert rows(q(spark, str(tmp_path))) == [("r", 2, 24)]
    assert proxies.view(spark, str(tmp_path), "seqs").count() == 2


def test_frames_of_any_fold_are_kept(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, a string"), spark.createDataFrame([("y", None)], "a string, k long")
    assert rows(relational.concat_frames([a, b, spark.createDataFrame([(7,)], "k long")])) == sorted([(1, "x"), (None, "y"), (7, None)], key=str)


def test_shared_folder_without_a_scheme(spark, tmp_path):
    assert session.qualified(spark, str(tmp_path / "shared")) == f"file://{tmp_path}/shared"
    assert session.qualified(spark, f"file:{tmp_path}/shared/") == f"file://{tmp_path}/shared"
    assert session.shared_dir(spark).startswith("file:///")
    assert session.written(spark.range(3), "t").count() == 3
