"""The small-world graphs against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteline.llm import neighbours

DIR = "/root/testdata/sf0.01"


def brute(rows, k=5, every=50):
    """(query, candidate) scores by plain loops over whole vectors."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every:
            continue
        for j, w in good:
            if j != i and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                s = float(a @ b / np.sqrt((a @ a) * (b @ b)))
                out.setdefault(i, {})[j] = max(s, out.get(i, {}).get(j, -2))
    return {i: sorted(x.items(), key=lambda y: (-y[1], y[0]))[:k] for i, x in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    return out


@pytest.mark.parametrize("shard_rows", [60, 1 << 14])
def test_recall_and_scores_on_the_table(spark, shard_rows):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in v.collect()])
    got = found(neighbours.search(neighbours.index(v, shard_rows=shard_rows), v.filter("vec_id % 50 = 0"), query_rows=7))
    assert got.keys() == want.keys()
    hits = sum(len({x for x, *_ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(len(x) for x in want.values())
    scores = {(q, j): s for q, x in brute([(r.vec_id, r.embedding) for r in v.collect()], 10**6).items() for j, s in x}
    for q, x in got.items():
        assert [r for *_, r in x] == list(range(1, len(x) + 1))
        assert all(abs(s - scores[q, j]) < 1e-12 for j, s, _ in x)


def test_awkward_rows_equal_brute_force(spark):
    """Few enough vectors that a search meets all: nulls, zeros, copies beyond k, multiples, other lengths, repeated ids, huge and tiny numbers."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1e308, 1e308]), (8, [1e-300, 2e-300]), (9, [0.0, -1.0]), (10, [1.0, 0.0, 0.0]), (100, [0.5, 0.5, 0.1]), (7, [1e308, 1e308]), (11, [2.0, 0.1]), (11, [0.0, 3.0]), (150, [2.0]), (-50, [-1.0, 0.2])]
    rows += [(20 + k, [1.0, 0.0]) for k in range(12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("dim", "shard", "rank", "score", "label")}).repartition(3)
    want, got = brute(rows), found(neighbours.search(neighbours.index(v, shard_rows=9), v.filter("vec_id % 50 = 0")))
    assert got.keys() == want.keys()
    for q, x in want.items():
        assert [j for j, *_ in got[q]] == [j for j, _ in x] or np.allclose([s for _, s, _ in got[q]], [s for _, s in x], atol=1e-12)
    assert [j for j, *_ in got[0]] == [20, 21, 22, 23, 24] and 150 not in got


def test_empty_table(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(neighbours.index(v), v).collect() == []


def test_graph_keeps_clusters_of_near_copies_within_reach():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 32))
    points = neighbours.unit(np.concatenate([c + 1e-3 * r.normal(size=(60, 32)) for c in centres])).astype(np.float32)
    top = neighbours.levels(r.integers(0, 2**63, len(points)).astype(np.uint64) << np.uint64(1))
    points, top = points[np.argsort(-top, kind="stable")], -np.sort(-top)
    layers = neighbours.build(points, top)
    for neighbour in layers:
        assert all(len(set(x[x >= 0])) == (x >= 0).sum() for x in neighbour)
    q = np.arange(0, len(points), 17)
    ids, _ = neighbours.beam(points, layers[0], points[q], neighbours.descend(points, layers, points[q], 1), 128)
    want = np.argsort(-(points[q] @ points.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, want, strict=True)]) > 0.95
