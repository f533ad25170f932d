"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteline.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def cases():
    r = random.Random(8)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x1", "don't", "a-b", "The", "the"]
    texts = [" ".join(r.choice(words[: r.randrange(1, 11)]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += [None, "", " ,.;", "the " * 900 + "rare", "copy of the alpha text"] + ["copy of the alpha text"] * 60
    docs = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, "alpha beta"), (None, "rare rare"), (7, "alpha"), (7, "alpha"), (7, "gamma the")]
    items = [(0, "alpha copy"), (1, "the the THE rare"), (2, None), (3, "nothing known"), (4, "été 日本 x1 alpha"), (5, "a b don t"), (6, "beta"), (6, "gamma"), (None, "rare")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [300, 16 << 20])
def test_rows_equal_plain_python(spark, shard_bytes):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "score", "term", "n")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "doc_id", "rank")})
    trees = ranked.index(d, shard_bytes)
    assert got(ranked.search(trees, i, item_rows=2)) == plain(docs, items)
    assert got(ranked.search(trees, i, k=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(ranked.index(none), items).collect() == []
    assert ranked.search(ranked.index(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), items.limit(0)).collect() == []
    assert ranked.search(ranked.index(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")), items).collect() == []


def test_tree_finds_every_interval():
    """Each node's interval of a term holds its documents of the node's range, in the order of the sequence."""
    r = np.random.default_rng(4)
    for n_docs in (1, 2, 5, 64, 100):
        seq = r.integers(0, n_docs, 300)
        depth = (n_docs - 1).bit_length()
        bits = ranked.tree(seq, depth)
        row = {"ids": np.arange(n_docs, dtype="<i8").tobytes(), "named": np.ones(n_docs, bool).tobytes(), "terms": np.array([1, 2], "<u8").tobytes(), "counts": np.array([120, 180], "<i4").tobytes(), "impacts": np.arange(300, 0, -1, dtype="<i4").tobytes(), "bits": bits.tobytes()}
        shard = ranked.Shard(row)
        for doc in range(n_docs):
            low, high = 120, 300
            for level in range(depth):
                one_low, one_high = (int(shard.ones(np.array([level]), np.array([x]))[0]) for x in (low, high))
                bit = doc >> (depth - 1 - level) & 1
                low, high = (shard.zeros[level] + one_low, shard.zeros[level] + one_high) if bit else (low - one_low, high - one_high)
            assert shard.worth[depth, low:high].tolist() == [300 - p for p in range(120, 300) if seq[p] == doc]
