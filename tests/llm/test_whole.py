"""Operators do the whole job: nothing is lost to a cut by share, size or order."""

import re

import numpy as np
import pyarrow as pa

from siteline.llm import decontam, encode, jaccard, toxicity
from siteline.llm import text as T


def word(k):
    return np.uint64(int(k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def test_toxicity_learns_a_rare_languages_words():
    """Marker words in 16 of 3,096 training documents, the only toxic ones of their language."""
    r = np.random.default_rng(4)
    texts = [np.array([word(x) for x in r.integers(1, 400, 40)]) for _ in range(3000)]
    labels = np.zeros(3000, int)
    for d in range(0, 3000, 10):  # the large language's
        texts[d][5], labels[d] = word(1001), 1
    own = [np.array([word(x) for x in r.integers(2000, 2100, 40)]) for _ in range(192)]
    toxic = np.arange(192) % 6 == 0
    for t in np.flatnonzero(toxic):
        own[t][9:12] = [word(5001), word(5002), word(5003)]
    train, test = slice(0, 96), slice(96, 192)
    stems = lambda t: np.stack([t, t * np.uint64(3), t * np.uint64(5)], 1).astype(np.uint32)
    texts, own = [stems(t) for t in texts], [stems(t) for t in own]
    m = toxicity.train(texts + own[train], np.concatenate([labels, toxic[train].astype(int)]))
    bounds = np.arange(0, 40 * 97, 40)
    found = m.scores(np.concatenate(own[test]), bounds) >= 0.5
    assert found[toxic[test]].mean() > 0.7 and found[~toxic[test]].mean() < 0.2


def test_decontamination_scores_dont_depend_on_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in r.zipf(1.4, 30 + i % 40) % 300)) for i in range(60)] + [(60, None), (61, "")]
    docs = [(i, "before it " + t + " after it") for i, t in items if t]
    d, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1000, 7):
        monkeypatch.setattr(decontam, "SHARD_ITEMS", size)
        found.append({(x["doc_id"], x["item_id"]): (round(x["score"], 9), x["n_passages"]) for x in decontam.leaks(d, own).collect()})
    assert found[0] == found[1] and len(found[0]) >= 60
    ix = decontam.build(*map(list, zip(*items, strict=True)))
    held = {(i, int(ix.items[k])): round(s, 9) for (i, t) in docs for w in T.words(pa.array([t]), lower=True, space=T.MARKS) for _, k, s, *_ in decontam.search(ix, w)}
    assert all(held[pair] == s for pair, (s, _) in found[1].items())


def test_block_bounds_prune_and_lose_nothing(monkeypatch):
    r = np.random.default_rng(16)
    some = lambda n: " ".join(f"w{x}" for x in r.zipf(1.3, n) % 900)
    items = [some(10 + i % 30) + "?\n" + some(5 + i % 9) for i in range(120)] + ["", None, "w1", "w1 w1"]
    docs = [some(200) for _ in range(200)] + [some(20) + " " + t + " " + some(20) for t in items if t] + ["", "w2", None]
    w = [*T.words(pa.array(docs, pa.string()), lower=True, space=T.MARKS)]
    found, products = [], []
    for size in (1, 3, 1000):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        ix, spent = decontam.build([*range(len(items))], items), dict.fromkeys(("bounds", "scores", "pivots", "scored"), 0)
        found.append(sorted(x for s in w for x in decontam.search(ix, s, spent=spent)))
        products.append(spent)
    assert found[0] == found[1] == found[2] and len(found[0]) >= 120
    own = {}  # every passage against every unit
    for k, u in zip(ix.keys.tolist(), ix.weights.tolist(), strict=True):
        own.setdefault(k % len(ix.items), {})[int(ix.terms[k // len(ix.items)])] = u
    want = set()
    for s in w:
        for d in range(s.n_docs):
            mine = s.hashes[s.bounds[d] : s.bounds[d + 1]]
            for low in range(0, max(1, len(mine)), ix.stride):
                has = set(mine[low : low + 2 * ix.stride].tolist())
                want |= {(d, unit, int(s.bounds[d]) + low) for unit, u in own.items() if sum(v for t, v in u.items() if t in has) >= decontam.THRESHOLD}
    assert {(d, unit, low) for d, unit, _, low, _ in found[0]} == want
    few = products[0]
    assert few["scored"] * 2 < few["pivots"] and few["bounds"] + few["scores"] < 20 * few["pivots"]


def leaked(docs, items):
    """(doc_id, item_id) with four fifths of the shingles of the item or of its question; with a short question, also of its answer."""
    tok = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    out = set()
    for d, t in docs:
        w = tok(t)
        for i, x in items:
            q, a = decontam.split_item(x)
            holds = lambda p: bool(p) and len(grams(p, k := min(5, len(p))) & grams(w, k)) >= 0.8 * len(grams(p, k))
            if holds(tok(x)) or holds(tok(q)) and (len(tok(q)) >= 5 or holds(tok(a))):
                out.add((d, i))
    return out


def test_decontamination_finds_questions_without_answers(spark):
    r = np.random.default_rng(8)
    some = lambda n: " ".join(f"w{x}" for x in r.integers(0, 400, n))
    items = [(i, some(6 + i) + "?\n" + some(90 - 2 * i)) for i in range(20)] + [(20, "Why? Because " + some(12)), (21, some(30))]
    docs = [(i, some(20) + " " + decontam.split_item(t)[0] + " " + some(20)) for i, t in items]  # the question alone
    docs += [(100 + i, some(5) + " " + t + " " + some(5)) for i, t in items] + [(200 + i, decontam.split_item(t)[1]) for i, t in items[:20]] + [(300, some(300))]
    d, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaked(docs, items)
    assert all((i, i) in want for i in range(20)) and (20, 20) not in want and (120, 20) in want and 300 not in {i for i, _ in want}
    rows = decontam.leaks(d, own).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == want and len(rows) == len(want)
    assert {x["doc_id"] for x in decontam.clean(d, own).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_toxicity_trains_beside_a_text_over_the_bound(spark):
    docs = [(k, " ".join(["trash" if k % 3 == 0 else "fine", *(f"w{(k * 7 + j) % 50}" for j in range(20))])) for k in range(200)]
    docs = spark.createDataFrame(docs + [(200 + k, "long " * 5000) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(220)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, max_words=4500)
    assert m is not None
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, m).collect() if r["doc_id"] < 200}
    assert all((s >= 0.5) == (k % 3 == 0) for k, s in out.items())


def test_toxicity_keeps_both_kinds_within_the_bound():
    words, toxic = np.array([10, 900, 10, 10, 2000, 40]), np.array([0, 0, 0, 0, 0, 1])
    assert toxicity.fitting(words, toxic, 9999).all()
    assert toxicity.fitting(words, toxic, 1000).tolist() == [True, True, True, True, False, True]
    assert toxicity.fitting(np.array([500, 600, 300]), np.array([1, 1, 0]), 1000).tolist() == [True, False, True]


def test_toxicity_learns_from_all_labelled_documents(spark):
    """Each marker is in a few documents; a shard of 60 rows and runs of 900 words hold few of the markers."""
    rows = [(k, " ".join([f"marker{k // 2 % 8}x" if k % 2 else "fine", *(f"w{(k * 7 + j) % 50}" for j in range(20))])) for k in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, max_rows=60, max_words=900)
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, m).collect()}
    assert sum((out[k] >= 0.5) == (k % 2 == 1) for k in range(400, 640)) >= 235
    held = sum(r["held"] for r in toxicity.dealt(docs, labels, 60, 900).collect())
    common = toxicity.slots(next(toxicity.features(w) for w in T.words(pa.array(["w3"]))))[0, 0]
    n = sum("w3" in t.split() for _, t in rows[:400])
    assert 40 < held < 120 and n * 0.6 < toxicity.PRIOR / (1 / m.known[common] - 1) < n  # documents that hold it and train
    count = toxicity.counted(toxicity.dealt(docs, labels, 60, 900).drop("held"))[1]
    assert count.tolist() == [200, 200, 400 * 21]
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), max_rows=60, max_words=900)
    assert np.array_equal(m.tables, again.tables) and np.array_equal(toxicity.dense(m), toxicity.dense(again)) and m.thresholds == again.thresholds


def test_toxicity_runs_leave_out_nothing():
    sizes = [3, 40, 0, 7, 95, 12, 60, 5, 30, 1]
    codec, words = pa.Codec("zstd"), [" ".join(f"w{d}" for _ in range(n)) for d, n in enumerate(sizes)]
    packed = [len(x).to_bytes(8, "big") + codec.compress(x.encode(), asbytes=True) for x in words]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 6 + [1] * 4, pa.int32()), pa.array([d % 2 for d in range(10)], pa.int32()), pa.nulls(10, pa.string()), pa.array(packed, pa.binary())], ["shard", "toxic", "lang", "packed"])
    got = list(toxicity.runs(iter([batch]), 50))
    assert sorted((s, y, len(t)) for s, texts, own in got for t, y in zip(texts, own.tolist(), strict=True)) == sorted((int(d > 5), d % 2, n) for d, n in enumerate(sizes))
    assert all(sum(map(len, texts)) <= 50 or len(texts) == 1 for _, texts, _ in got)


def test_toxicity_brings_no_document_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "trash here" if k % 2 else "fine here") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(docs), name, lambda *_: 1 / 0)
    assert toxicity.fit(docs, labels) is not None


def test_sums_are_not_copied_row_by_row_in_the_driver(spark, monkeypatch):
    """A model's sums (17 MB a round) and the sketch (8 MB) come as tasks pickled them; what is collected as rows is small."""
    docs = spark.createDataFrame([(k, "trash here" if k % 2 else "fine here") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    size, collect = [], type(docs).collect

    def counted(df):
        rows = collect(df)
        size.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    assert toxicity.fit(docs, labels) is not None
    assert jaccard.sketch(docs, 2).sum() == 40
    assert sum(size) < 1 << 16


def test_toxicity_moves_labelled_texts_once(spark):
    """400 of 4,000 documents have labels: only these are exchanged, to the shards at once; none is lost where many share the bits."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k * 10, k % 2) for k in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    own = labels.filter("doc_id is not null and toxic is not null").repartition(3)
    marked = toxicity.marks(own, 400)
    moved = {r["doc_id"] for r in toxicity.packed(docs, marked).collect()}
    assert moved >= set(range(0, 4000, 10)) and len(moved) < 800
    few = np.zeros(1, np.uint8)  # eight bits for all
    few[:] = 255
    assert toxicity.packed(docs, few).count() == 4001
    got = toxicity.dealt(docs, labels, 60, 9000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2, plan  # documents and labels
    rows = got.rdd.glom().collect()
    assert sum(map(len, rows)) == 400 and len(rows) == 7 and all({r["shard"] for r in part} <= {k} for k, part in enumerate(rows))
    got.unpersist()


def test_toxicity_numbers_words_in_parts(monkeypatch):
    r = np.random.default_rng(3)
    vocabulary = np.unique(r.integers(0, 1 << 32, 900).astype(np.uint32))
    vocabulary = np.stack([vocabulary, vocabulary * np.uint32(3), vocabulary * np.uint32(5)], 1)
    texts = [vocabulary[r.integers(0, len(vocabulary), n)] for n in (0, 5, 700, 1, 0, 90, 40, 300, 0)]
    for size in (1, 64, 1 << 16):
        monkeypatch.setattr(toxicity, "_CHUNK", size)
        left = list(texts)
        words, numbers = toxicity.numbered(left)
        assert not left and len(numbers) == len(texts) and len(words) == len(np.unique(np.concatenate(texts)[:, 0]))
        assert all(np.array_equal(words[n], t) for n, t in zip(numbers, texts, strict=True))


def test_toxicity_trains_without_an_earlier_stages_tokenizer():
    encode.encoder("word_bpe_49k.json")
    assert encode._encoders and list(toxicity.runs(iter([]), 50)) == [] and not encode._encoders
