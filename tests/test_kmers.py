"""Reads against references too many for a task or the driver, and counts of k-mers, against plain Python."""

import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from siteline.operators import kmers, qc
from siteline.plans import q_scores


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


@pytest.fixture
def none_collected(spark, monkeypatch):
    """References' k-mers that the driver would fetch to hand them out."""

    def fetched(self):
        raise AssertionError("a table was fetched by the driver")

    monkeypatch.setattr(type(spark.range(0)), "toArrow", fetched)


def test_reads_meet_many_references_without_the_driver(spark, none_collected):
    """First hits at the edges of the rounds, late, in several classes, on either strand, in another index only, in copies and nowhere."""
    r, k = random.Random(11), 20
    seq = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    kinds = [("a", 0), ("b", 1), ("c", 2)]
    refs = [(ix, seq(1500), *kinds[j % 3]) for ix in ("one", "two") for j in range(6)]
    refs += [("one", refs[1][1], "c", 2), ("two", refs[6][1][:400] + "x" + refs[6][1][400:], "b", 1), ("one", "ACG", "a", 0), ("one", None, "a", 0)]
    known = {}
    for ix, s, c, p in refs:
        for t in (s, revcomp(s)) if s else ():
            for i in range(len(t) - k + 1):
                known[ix, t[i : i + k]] = min(known.get((ix, t[i : i + k]), (9, "")), (p, c))
    reads = [("one", seq(at) + piece + seq(30)) for at in (0, 3, 4, 5, 259, 260, 261, 16_643, 16_644) for piece in (refs[at % 6][1][700:720], revcomp(refs[1][1])[90:130])]
    reads += [("two", refs[0][1][:60]), ("two", seq(18_000)), ("one", "ACGT"), ("one", ""), ("one", None), (None, seq(50)), ("three", refs[0][1])]
    reads += [("one", refs[2][1][:200])] * 40 + [("two", seq(7) + refs[7][1][:20] + refs[8][1])] * 3
    rows = [(j, f"more {j}", *x) for j, x in enumerate(reads)]
    got = qc.classify_reads(spark.createDataFrame(rows, "read long, more string, index string, seq string"), spark.createDataFrame(refs, "index string, seq string, class string, priority int"), k, 1000)
    assert got.columns == ["read", "more", "class"]
    want = {}
    for j, more, ix, s in rows:
        hits = (known.get((ix, (s or "")[i : i + k])) for i in range(len(s or "") - k + 1))
        want[j, more] = next((h[1] for h in hits if h), None)
    found = [((x["read"], x["more"]), x["class"]) for x in got.collect()]
    assert len(found) == len(want) and dict(found) == want and set(want.values()) == {"a", "b", "c", None}


def test_inserts_meet_many_references_without_the_driver(spark, none_collected):
    """Contents of two species, one without rRNA, whose references have more k-mers than a task is to hold."""
    r = random.Random(12)
    chunks = ["".join(r.choices("ACGT", k=60_000)) for _ in range(20)]
    refs = [("s", c, *(("rrna_35s", 0), ("rrna_5s", 1), ("organellar", 2))[j % 3]) for j, c in enumerate(chunks[:19])] + [("o", chunks[19], "organellar", 2)]
    assert sum(len(c) - 19 for c in chunks) > qc.BLOCK_KMERS
    other = "".join(r.choices("ACGT", k=400))
    at = lambda j, place, n: chunks[j][place : place + n]
    inserts = [("e1", s) for s in (at(0, 59_970, 30), revcomp(at(1, 7, 44)), other[:90] + at(2, 300, 25), other, at(19, 5, 50), other[:3] + at(4, 9, 20) + at(0, 9, 20), "ACGT", None, at(3, 0, 20), at(3, 0, 19))]
    inserts += [("e2", s) for s in (at(19, 5, 50), at(0, 5, 50), other[:300] + revcomp(at(19, 59_900, 40)))] + [("e3", at(0, 5, 50))]
    ex = spark.createDataFrame([("e1", "s"), ("e2", "o"), ("e3", "none")], "experiment string, index string")
    ins = spark.createDataFrame([(e, j, s) for j, (e, s) in enumerate(inserts)], "experiment string, read long, seq string")
    got = {x.experiment: tuple(x)[1:] for x in qc.rrna_content(ex, ins, spark.createDataFrame(refs, "index string, seq string, class string, priority int"), 20).collect()}
    assert got == {"e1": (7, "yes", 28.57, 28.57, 14.29, 71.43), "e2": (3, "no", 0.0, 0.0, 66.67, 66.67), "e3": (0, None, None, None, None, None)}


def test_long_sequences_are_worked_on_in_spans():
    """A batch of eight million bases takes memory for a span of them; the keys are those of each window, and of its reverse complement."""
    r = random.Random(13)
    long = "".join(r.choices("ACGTN", k=1 << 20)) * 8
    batch = pa.array([None, "ACG", long, "", long[:50] + "x" + long[:30]])
    tracemalloc.start()
    n, most = 0, 0
    for keys, row, place in kmers.spans(batch, 20):
        n, most = n + len(keys), max(most, len(keys))
        assert (np.diff(row) >= 0).all() and (np.diff(place)[np.diff(row) == 0] > 0).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(long) - 19 + 31 + 11 and most <= kmers.SPAN and peak < 200 << 20
    some = [long[:300], revcomp(long[:300])]
    one, two = (np.concatenate([x for x, _, _ in kmers.spans(pa.array([s]), 20)]) for s in some)
    assert (one == two[::-1]).all() and len(set(one.tolist())) == len({min(s, revcomp(s)) for s in (long[i : i + 20] for i in range(281))})


@pytest.mark.parametrize("k", [20, 7, 4])
def test_kmers_of_both_strands_are_counted(spark, k):
    """With those that are their own reverse complements, with copies, and with what is too short."""
    r = random.Random(14)
    half = "".join(r.choices("ACGTN", k=30))
    own = [half + revcomp(half), half + "N" + revcomp(half), "".join(r.choices("ACGT", k=500)), None, "", "ACG", "A" * 60, "ACGT" * 30, *["".join(r.choices("AC", k=90))] * 30]
    want = Counter(t[i : i + k] for s in own if s for t in (s, revcomp(s)) for i in range(len(t) - k + 1))
    got = kmers.count_kmers(spark.createDataFrame([(s,) for s in own], "seq string"), k).collect()
    assert len(got) == len(want) and {x.kmer: x.n for x in got} == dict(want) and any(x == revcomp(x) for x in want)


def test_counting_exchanges_few_bytes_a_base(spark, monkeypatch):
    """Random bases, of which no k-mer is found twice, so that nothing but their packing makes them small."""
    r, n = random.Random(15), 400_000
    seqs = spark.createDataFrame([("".join(r.choices("ACGT", k=n // 100)),) for _ in range(100)], "seq string")
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = held()
    monkeypatch.setattr(q_scores, "seqs", lambda *_: seqs)
    assert q_scores.R.queries["fn_kmers"](spark, "").agg({"n": "sum"}).first()[0] == 2 * (n - 100 * 19)
    assert sum(b for p, b in held().items() if p not in before) < 8 * n
