"""Comparison of tracks, alignment through a mask, experiments, folds and adapters: against plain Python, and what raises."""

import math
import random

import numpy as np
import pytest

from siteline import session
from siteline.operators import compare as C
from siteline.operators import jobs as J
from siteline.operators import qc
from siteline.sources import readers as S

LOCI, SIGNAL = "locus long, chrom string, start_pos long, end_pos long", "chrom string, strand string, pos long, value double"


def plain(loci, a, b):
    """Scores from dense profiles."""
    out = {}
    for k, c, s, e in loci:
        pa, pb = (np.array([abs(t.get((c, x, p), 0.0)) for x in "+-" for p in range(s, e)]) for t in (a, b))
        r = None if not len(pa) or pa.std() == 0 or pb.std() == 0 else float(np.corrcoef(pa, pb)[0, 1])
        jsd = None
        if pa.sum() > 0:
            q, p = pa / pa.sum(), np.exp(pb - pb.max()) / np.exp(pb - pb.max()).sum()
            m = (p + q) / 2
            terms = [x * math.log(x / y) for u in (p, q) for x, y in zip(u, m, strict=True) if x > 0]
            jsd = math.sqrt(max(0.0, sum(terms) / 2))
        out[k] = (float(pa.sum()), float(pb.sum()), r, jsd)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_scores_of_two_tracks(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: {(rng.choice("xy"), rng.choice("+-"), rng.randrange(900)): float(rng.choice([-300, -2, 1, 1, 2, 40])) for _ in range(n)}
    a, b = draw(250), draw(250)
    b |= {k: v for k, v in a.items() if rng.random() < 0.6}
    loci = [(k, rng.choice("xyz"), s := rng.randrange(900), s + rng.choice([1, 20, 120])) for k in range(60)] + [(90, "x", 10, 10), (91, "x", 5000, 5100)]
    frame = lambda t: spark.createDataFrame([(*k, v) for k, v in t.items()], SIGNAL)
    got = {r[0]: tuple(r)[1:] for r in C.locus_scores(spark.createDataFrame(loci, LOCI), frame(a), frame(b)).collect()}
    want = plain(loci, a, b)
    assert got.keys() == want.keys() and any(v[2] is None for v in want.values()) and any(v[3] is None for v in want.values())
    for k, own in want.items():
        assert [x is None for x in got[k]] == [x is None for x in own], k
        assert all(x is None or abs(x - y) < 1e-7 for x, y in zip(got[k], own, strict=True)), k
    table = {r["metric"]: (r["value"], r["n"]) for r in C.compare_tracks(spark.createDataFrame(loci, LOCI), frame(a), frame(b)).collect()}
    for at, name in ((2, "profile_pearson"), (3, "profile_jsd")):
        own = sorted(v[at] for v in want.values() if v[at] is not None)
        assert table[name][1] == len(own) and abs(table[name][0] - own[(len(own) - 1) // 2]) < 1e-7
    counts = np.array([v[:2] for v in want.values()])
    assert abs(table["counts_pearson"][0] - np.corrcoef(counts.T)[0, 1]) < 1e-9 and table["counts_pearson"][1] == len(loci)
    assert abs(table["log_counts_pearson"][0] - np.corrcoef(np.log1p(counts).T)[0, 1]) < 1e-9


def test_tracks_without_loci(spark):
    none = spark.createDataFrame([], SIGNAL)
    assert C.locus_scores(spark.createDataFrame([], LOCI), none, none).collect() == []
    got = C.compare_tracks(spark.createDataFrame([(1, "x", 0, 9)], LOCI), none, none).collect()
    assert {r["metric"]: (r["value"], r["n"]) for r in got} == {"profile_pearson": (None, 0), "profile_jsd": (None, 0), "counts_pearson": (None, 1), "log_counts_pearson": (None, 1), "counts_spearman": (None, 1)}


def test_predictions_find_their_loci(spark):
    rng = random.Random(2)
    kept = [rng.random() < 0.4 for _ in range(500)]
    loci = spark.createDataFrame([(k, f"c{k}") for k in range(500)], "place long, name string").repartition(5)
    mask = spark.createDataFrame([(k, x or (None if k % 2 else False)) for k, x in enumerate(kept)], "place long, kept boolean").repartition(3)
    names = [f"c{k}" for k, x in enumerate(kept) if x]
    pred = lambda n: spark.createDataFrame([(k, f"p{k}") for k in range(n)], "row int, p string")
    got = C.align_masked(loci, mask, pred(len(names))).select("row", "name", "p").collect()
    assert sorted(map(tuple, got)) == [(k, n, f"p{k}") for k, n in enumerate(names)]
    for n in (len(names) - 1, len(names) + 1):
        with pytest.raises(ValueError, match="another number"):
            C.align_masked(loci, mask, pred(n))
    with pytest.raises(ValueError, match="other loci"):
        C.align_masked(loci, mask.filter("place < 499"), pred(len(names)))


def test_experiments_load(spark):
    full = {"peaks": "p", "pl_bigwig": "a", "mn_bigwig": "b", "pl_control": "c", "mn_control": "d", "blacklist": "l"}
    rows = [("e1", "s", full), ("e2", "s", {k: v for k, v in full.items() if k not in ("peaks", "mn_control", "blacklist")}), ("e3", "s", {"pl_bigwig": "a"})]
    df = spark.createDataFrame(rows, "experiment string, species string, processed map<string, string>")
    got = {r["experiment"]: r for r in J.load_experiments(df, wanted=["e1", "e2"]).collect()}
    assert (got["e1"]["signals"], got["e1"]["controls"], got["e1"]["blacklist"]) == (["a", "b"], None, ["l"])
    assert (got["e2"]["peaks"], got["e2"]["negatives"], got["e2"]["blacklist"]) == (None, None, None)
    assert J.load_experiments(df, True, ["e1"]).first()["controls"] == ["c", "d"]
    for use, wanted, said in [(True, ["e1", "e2"], "mn_control of e2"), (False, None, "mn_bigwig of e3"), (False, ["e1", "no"], "unknown experiments: no")]:
        with pytest.raises(KeyError, match=said):
            J.load_experiments(df, use, wanted)


def test_fold_mechanisms(spark):
    frame = lambda rows: spark.createDataFrame(rows, "species string, fold long")
    own = spark.createDataFrame([("a",), ("b",), ("a",)], "species string")
    got = J.fold_mechanism(own, frame([("a", 0), ("a", 4), ("a", 4), ("a", None)]), frame([("a", 1), ("b", 1), ("b", 2), ("b", 3)]))
    assert sorted(map(tuple, got.collect())) == [("a", True, 2), ("b", False, 3)]
    with pytest.raises(KeyError, match="no fold assignment for b"):
        J.fold_mechanism(own, frame([("a", 0)]), frame([("c", 1)]))


def test_conflicts_of_adapters(spark):
    runs = [("e1", "R1", 9, "x", 60.0), ("e1", "R1", 9, "x", 49.9), ("e1", "R1", 9, "y", 90.0), ("e1", "R1", 9, "y ", 90.0), ("e1", "R1", 9, "z", 90.0), ("e1", "R2", 9, "z", 90.0), ("e1", "R1", 0, "z", 90.0), ("e1", "R1", 9, "none", 90.0), ("e1", "R1", 9, None, None), ("e2", "R1", 9, "y", 90.0), ("e3", "R1", 9, "y", 90.0), ("e9", "R1", 9, "y", 90.0)]
    survey = spark.createDataFrame(runs, "experiment string, mate string, n_sampled int, best_adapter string, pct_adapter double")
    got = qc.adapter_conflicts(survey, spark.createDataFrame([("e1", "x"), ("e2", ""), ("e3", None), ("e4", "x")], "experiment string, adapter string"))
    assert sorted(map(tuple, got.collect())) == [("e1", "x", 7, 3, "y"), ("e2", "", 1, 0, None), ("e3", "", 1, 0, None), ("e4", "x", 0, 0, None)]


def test_sides_without_values_let_nothing_through(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", -1.0), ("b", -9.0), ("c", 0.0), ("c", None), (None, float("nan"))]
    got = C.one_signed_thresholds(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.5).collect()
    inf = math.inf
    assert {r["k"]: (r["lower"], r["upper"]) for r in got} == {"a": (-inf, 3.0), "b": (-9.0, inf), "c": (-inf, inf), None: (-inf, inf)}


def test_a_budget_of_reads(spark):
    paths = [session.scratch(spark, "fastq") for _ in range(3)]
    for p, n in zip(paths[:2], (50, 4), strict=True):
        spark.createDataFrame([(f"@r{k}\nACGT\n+\nIIII",) for k in range(n)], "value string").coalesce(1).write.text(p)
    got = S.fastq_budget(spark, paths, 30).collect()
    assert sorted(r["name"] for r in got) == sorted([f"r{k}" for k in range(10)] + [f"r{k}" for k in range(4)])
    with pytest.raises(ValueError, match="none of the files"):
        S.fastq_budget(spark, paths[2:], 30)
