"""Scores and verdicts against plain Python, and the pipeline on awkward tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteline.llm import decontam, lm, packing, quality, store, token_store, toxicity
from siteline.llm import text as T
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


def test_language_model_score_equals_brute_force(spark, docs):
    """Exact counts in dictionaries; the weights from a grid of all held-out tokens; every text's sum of logarithms."""
    tokens = {i: [*brute.words(t, True), None] for i, t in docs}
    kept, total, kept2, total2, first_kept, first_total = Counter(), Counter(), Counter(), Counter(), 0, 0
    for i, w in tokens.items():
        fold = brute.fold(i)
        if fold == 1:
            continue
        pairs = list(zip(["start", *w[:-1]], w, strict=True))
        total.update(w)
        total2.update(pairs)
        first_total += 1
        if fold != 0:
            kept.update(w)
            kept2.update(pairs)
            first_kept += 1
    n, v, nk, vk = sum(total.values()), len(total), sum(kept.values()), len(kept)
    grid = defaultdict(lambda: [0, 0.0, 0.0])
    for i, w in tokens.items():
        if brute.fold(i) == 0:
            for a, b in zip(["start", *w[:-1]], w, strict=True):
                cv = first_kept if a == "start" else kept[a]
                f2, f1 = kept2[a, b] / max(cv, 1), kept[b] / nk
                cell = (int(lm.bucket_of(np.array([cv]))[0]) * lm.LEVELS + int(lm._level(np.array([f2]))[0])) * lm.LEVELS + int(lm._level(np.array([f1]))[0])
                own = grid[cell]
                own[0], own[1], own[2] = own[0] + 1, own[1] + (np.log(f2) if f2 else 0), own[2] + (np.log(f1) if f1 else 0)
    weights = lm.learn_weights([(c, *x) for c, x in grid.items()], vk)
    want = {}
    for i, w in tokens.items():
        s = 0.0
        for a, b in zip(["start", *w[:-1]], w, strict=True):
            cv = first_total if a == "start" else total[a]
            l2, l1, l0 = weights[int(lm.bucket_of(np.array([cv]))[0])]
            s += np.log10(l2 * total2[a, b] / max(cv, 1) + l1 * total[b] / n + l0 / (v + 1))
        want[i] = s
    got = {r["doc_id"]: r["score"] for r in lm.query(spark, DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) / abs(want[i]) for i in want) < 1e-6


def test_quality_ratio_threshold_and_verdict_equal_brute_force(spark, docs):
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    good = set(labels.doc_id[labels.quality == 1])
    grams = {}
    for (i, t), w in zip(docs, (x for x in T.words(pa.array([t for _, t in docs], pa.string()), lower=True, slice_bytes=1)), strict=True):
        h = w.hashes
        grams[i] = [int(x) % quality.BUCKETS for x in [*h.tolist(), *T.grams(h, 2).tolist()]] if len(h) else []
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in grams.items():
        for x in g:
            raw[x] += 1
            target[x] += i in good
    log = lambda s: np.log(s + quality.SMOOTHING) - np.log(s.sum() + quality.SMOOTHING * quality.BUCKETS)
    ratio = log(target) - log(raw)
    llr = {i: float(np.mean(ratio[g])) if g else 0.0 for i, g in grams.items()}
    parts = [[llr[i] for i in labels.doc_id[labels.quality == q] if i in llr] for q in (0, 1)]
    gain = [sum(x < e for x in parts[0]) / len(parts[0]) - sum(x < e for x in parts[1]) / len(parts[1]) for e in quality.EDGES]
    out = quality.query(spark, DIR).collect()
    assert max(abs(r["llr"] - llr[r["doc_id"]]) for r in out) < 1e-9
    edge = out[0]["threshold"]
    assert max(gain) - gain[int(np.argmin(np.abs(quality.EDGES - edge)))] < 0.02
    for r in out:
        n, _, _, _, repeat = brute.base_quality(dict(docs)[r["doc_id"]])
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n) and r["kept"] == (not r["base_failed"] and r["llr"] >= edge)


def test_toxicity_finds_held_out_rows_in_all_languages(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").toxic
    out = [r for r in toxicity.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels.index]
    toxic = sorted(r["score"] for r in out if labels[r["doc_id"]] == 1)
    clean = sorted(r["score"] for r in out if labels[r["doc_id"]] == 0)
    edge = clean[int(0.9 * len(clean))]
    assert len(toxic) >= 5 and sum(s > edge for s in toxic) >= 0.7 * len(toxic)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_toxicity_knows_new_forms_of_a_stem_and_takes_long_texts(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join([*(word() for _ in range(20)), *([f"réeux{word()}", f"réeux{word()}"] if k % 3 == 0 else [])])) for k in range(400)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    long = "word " * 300_000
    some = spark.createDataFrame([*rows[300:], (900, long), (901, long + "réeuxzzz réeuxyyy"), (902, None), (903, "")], DOC).withColumns({c: F.lit(1) for c in ("words", "place", "toxic", "score", "rejected")})
    out = {x["doc_id"]: x["score"] for x in toxicity.scored(some, toxicity.fit(docs, labels)).collect()}
    assert sum((out[k] >= 0.5) == (k % 3 == 0) for k in range(300, 400)) >= 95 and out[901] > out[900] and out[902] == out[903]


def test_packing_keeps_all_limits_and_loss_binds(spark, docs):
    out = packing.pack(spark.createDataFrame(docs, DOC), "word_bpe_49k.json", 1, max_tokens=256, max_segments=6, max_loss=250).toPandas()
    by = out.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"), low=("offset", "min"))
    assert by.n.max() <= 256 and by.k.max() <= 6 and by.loss.max() == 250 and (by.low == 0).all()
    assert ((by.loss == 250) & (by.n < 256)).any()
    for _, own in out.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert own.length.sum() == own.doc_tokens.iloc[0] and (own.start.to_numpy() == np.concatenate([[0], own.length.cumsum()[:-1]])).all()
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.concatenate([[0], own.length.cumsum()[:-1]])).all()
    whole = packing.query(spark, DIR).toPandas().groupby("sequence_id").length.sum()
    padded = whole[~whole.map(lambda n: n & (n - 1) == 0)]
    assert (2048 - padded).sum() <= 0.005 * whole.sum()


NAMES = ["n_lines", "n_dropped", "kept_sha256", "__keys", "__id", "__other", "other_id", "component_id", "rep", "shard", "score", "rejected", "item_id", "overlap", "block", "sequence_id", "a.b"]


def tables(spark, path, rows, labels, items, names=NAMES):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    rows = [
        (1, " ".join(words[:60]), "en", None, None), (2, " ".join(words[:59]), None, "s", 3), (2, " ".join(words[:59]), None, "s", 3), (3, None, "de", None, None), (4, "", None, None, 0), (5, long, "en", None, None),
        (6, "a line that is repeated\nown six", "fr", None, None), (7, "A line that is repeated \nown seven", "fr", None, None), (None, "text without an id", None, None, None), (8, "q0 q1 q2 q3 q4 q5 q6 q7", None, None, None), (9, long + " more", "en", None, None),
    ]
    items = [(1, "q0 q1 q2 q3 q4 q5 q6 q7"), (2, None), (3, ""), (None, "never found in any text at all")]
    tables(spark, tmp_path, rows, [(1, 1, 0), (None, None, None), (2, 0, None)], items)
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = df.columns
        df = store.written(stage(spark, df, str(tmp_path)), "edge")
        if k < 4:
            assert df.columns == columns
            kept.append(sorted(str(r["doc_id"]) for r in df.collect()))
    assert kept[0] == kept[1] == sorted(str(r[0]) for r in rows)  # nothing to learn toxicity from
    assert kept[2] == sorted(["1", "3", "4", "5", "6", "7", "8", "None"]) and kept[3] == sorted(["1", "3", "4", "5", "6", "7", "None"])
    out = df.collect()
    assert sorted({str(r["doc_id"]) for r in out}) == kept[3] and all(r["length"] > 0 for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)


def test_other_operators_take_clashing_names(spark):
    docs = spark.createDataFrame([(1, "q0 q1 q2 q3 q4 q5 q6 q7"), (2, None), (None, "")], DOC).withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    items = spark.createDataFrame([(1, "q0 q1 q2 q3 q4 q5 q6 q7")], "item_id long, text string").withColumns({"doc_id": F.lit(1), "shard": F.lit(2), "term": F.lit(3)})
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items.select("item_id", "text", "doc_id", "shard", "term")).collect()] == [(1, 1)]
    manifest = token_store.write(docs, store.new_path(spark, "t"), "byte_bpe_50k.json", 0)
    assert sorted(str(r["doc_id"]) for r in token_store.read(manifest).collect()) == ["1", "2", "None"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == 3
