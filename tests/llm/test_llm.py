"""The training-data operators against brute force, and on the awkward tables."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteline.llm import decontam, encode, jaccard, linededup, lm, packing, passages, quality, registry, store, token_store, toolcalls, toxicity
from siteline.llm import text as T
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(name="documents"):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


@pytest.fixture(scope="module")
def docs():
    d = table()
    return list(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, copies, white space of all kinds."""
    r = random.Random(5)
    w = ["alpha", "Beta", "gamma,", "été", "日本", "x" * 90, "1.5", "don't"]
    long = " ".join(r.choice(w) + str(r.randrange(50)) for _ in range(30000))
    passage = " ".join(f"w{k}" for k in range(60))
    texts = ["", None, " \t\n", "one", "one two", passage, "Pre " + passage + " post", passage.upper(), long, long, long[:90000], "a b\r\nc\x0bd\x0ce  f\n\n\ng ", "same line of text\nsame line of text\nother", "  Same Line of Text \nx", "<|endoftext|> ok"]
    rows = [(k, t, None if k % 3 == 0 else "en", None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3), [(k, t) for k, t, *_ in rows]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    """Null ids, repeated rows, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(None, "some words of a text", "en"), (1, "some words of a text", "en"), (1, "some words of a text", "en"), (2, None, None)], "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("block", "shard", "n", "key", "role", "id", "score")})


def got(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several blocks and shards even on small tables."""
    monkeypatch.setattr(store.parts, "__defaults__", (100_000, 1))


def check_lines(df, rows):
    assert got(df, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(rows)


def test_words_hash_alike():
    texts = ["A b\tc\n", "", None, "é  A"]
    seen = {}
    for size in (1, 1 << 20):
        for w in T.words(pa.array(texts), True, size):
            for k in range(len(w.hashes)):
                assert seen.setdefault(w.word(k), w.hashes[k]) == w.hashes[k]
    assert set(seen) == {"a".encode(), b"b", b"c", "é".encode()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, monkeypatch):
    r = random.Random(3)
    parts = ["a", "Zo", "é", "'s", " ", " ", "\n", "12", "###", "日本", "\t", " ", "́", "<|endoftext|>", "ΑΣ"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 9, 60]))) for _ in range(2000)] + [None]
    for limit in (4_000_000, 300):
        monkeypatch.setattr(encode, "CACHE_WORDS", limit)
        e = encode.Encoder(name)
        for lo in range(0, len(texts), 400):
            for t, ids in zip(texts[lo : lo + 400], e.batch(pa.array(texts[lo : lo + 400], pa.string())), strict=True):
                assert ids.tolist() == e.whole(t or "").tolist()


def test_lm(spark, docs, awkward):
    for df, rows in ((store.documents(spark, DIR), docs), awkward):
        out = lm.score(df, store.fold() != 1, store.fold() == 0).collect()
        want = brute.base_scores(rows)
        assert len(out) == len(rows)
        for r in out:
            n, known, total, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base) and r["score"] < 0
    held = [r for r in lm.query(spark, DIR).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_a_distribution():
    w = lm.learn_weights([(lm.LEVELS**2 * 3 + 5 * lm.LEVELS + 7, 10, -20.0, -30.0)], 1000)
    assert np.allclose(w.sum(1), 1) and (w[:, 1:] > 0).all()


def test_line_dedup(spark, docs, awkward):
    check_lines(linededup.query(spark, DIR), docs)
    check_lines(linededup.deduplicated(awkward[0].select("doc_id", "text")), awkward[1])


def test_line_dedup_is_reversible(spark, docs):
    all_ = store.documents(spark, DIR)
    a, b = all_.filter("doc_id % 3 <> 0"), all_.filter("doc_id % 3 = 0")
    both = linededup.LineStore.empty(spark, 100).insert(a).insert(b)
    check_lines(both.decide(all_), docs)
    less = both.delete(b.select("doc_id"))
    check_lines(less.decide(a), [(i, t) for i, t in docs if i % 3])
    check_lines(less.insert(all_).decide(all_), docs)


def test_cuckoo():
    r = np.random.default_rng(1)
    keys, other = r.integers(0, 1 << 63, (2, 20000)).astype(np.uint64)
    f = linededup.Cuckoo(len(keys))
    f.insert(keys)
    assert f.holds(keys).all() and f.holds(other).mean() < 0.001
    f.delete(keys[:10000])
    assert f.holds(keys[10000:]).all() and f.holds(keys[:10000]).mean() < 0.01
    with pytest.raises(linededup.Full):
        linededup.Cuckoo(10).insert(keys)


def test_toxicity(spark):
    out = toxicity.query(spark, DIR).toPandas()
    assert len(out) == len(table()) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert out.score.notna().all() and (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()


def test_toxicity_learns():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 1 << 62, 80).astype(np.uint64) % np.uint64(400) * np.uint64(0x9E3779B97F4A7C15) for _ in range(900)]
    labels = (np.arange(900) % 5 == 0).astype(int)
    for t, y in zip(texts, labels, strict=True):
        if y:
            t[7] = np.uint64(0xABCDEF0123456789)
    words = [np.stack([t, t * np.uint64(3), t * np.uint64(5)], 1).astype(np.uint32) for t in texts]  # a word and two beginnings
    m = toxicity.train(words[:700], labels[:700])
    bounds = np.arange(0, 80 * 201, 80)
    assert ((m.scores(np.concatenate(words[700:]), bounds) >= 0.5) == labels[700:]).mean() > 0.97


def test_token_store(spark, awkward):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    manifest = token_store.write(awkward[0], store.new_path(spark, "t"), "byte_bpe_50k.json", 0)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in awkward[1]}
    out = got(token_store.read(manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    at = 0
    for i in sorted(want):
        assert out[i] == (at, len(want[i]), zlib.crc32(np.array(want[i], "<u4")))
        at += len(want[i])
    found = got(token_store.lookup(manifest, spark.createDataFrame([(3,), (8,), (999,), (None,)], "doc_id long")), "doc_id", "ids")
    assert found == {3: (want[3],), 8: (want[8],)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 60), 1 << 60, n))
    pilots, slots, _ = token_store.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_passages(spark, docs, awkward):
    cols = ("n_words", "n_removed", "kept_sha256")
    assert got(passages.query(spark, DIR), "doc_id", *cols) == brute.passages(docs)
    assert got(passages.deduplicated(awkward[0]), "doc_id", *cols) == brute.passages(awkward[1])


def test_toolcalls(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    out = toolcalls.query(spark, DIR)
    a = sorted(str([None if v is None else str(v) for v in r]) for r in out.select(*sorted(out.columns)).collect())
    cur = con.execute(toolcalls.SQL)
    names = [x[0] for x in cur.description]
    b = sorted(str([None if r[names.index(c)] is None else str(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert a == b and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_toolcalls_order_and_errors(spark):
    calls = spark.createDataFrame([(1, 1, "a", "f", '{"y": 1, "x": "s"}'), (1, 2, "b", "f", '{"x": 5}'), (1, 3, "c", "g", "[1"), (1, 4, "d", "f", '{"x": null}'), (1, 5, "e", "f", '{"x": "1"}'), (1, 6, "a", "f", "{}")], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 2, "a", "ok"), (1, 9, "zz", "lost"), (1, 9, None, "x")], "conv_id long, turn long, call_id string, content string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("c", "nowhere")], "call_id string, needs string")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "integer", False)], "name string, parameter string, type string, required boolean")
    out = got(toolcalls.link(calls, results, edges, schemas), "call_id", "status", "level", "place", "errors", "json")
    assert out["a"] == ("linked", 2, 3, None, '{"arguments":{"x":"s","y":1},"id":"a","name":"f","result":"ok"}')
    assert out["b"][:4] == ("unanswered", 1, 2, "wrong type x") and out["c"][:4] == ("unanswered", 0, 1, "not an object")
    assert out["d"][1] is None and out["d"][3] == "missing x" and out["zz"][0] == "orphan" and len(out) == 6


def test_decontamination(spark, docs, awkward):
    items = table("benchmark")
    want = brute.leaks(docs, list(zip(items.item_id, items.text, strict=True)))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.query(spark, DIR).collect()} == want and want
    own = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(awkward[0], own).collect()} == brute.leaks(awkward[1], [(1, "one two"), (4, " ".join(f"w{k}" for k in range(40)))])
    assert decontam.leaks(awkward[0], own.limit(0)).count() == 0


def test_quality(spark, docs, awkward):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality.query(spark, DIR)
    assert got(out, "doc_id", *cols) == {i: brute.base_quality(t) for i, t in docs}
    assert got(quality.scored(awkward[0], quality.Model(np.zeros(quality.BUCKETS))), "doc_id", *cols) == {i: brute.base_quality(t) for i, t in awkward[1]}
    assert all(r["kept"] <= (not r["base_failed"]) for r in out.collect())


def test_packing(spark, awkward):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(awkward[0], "word_bpe_49k.json", 1, max_tokens=256, max_segments=4, max_loss=200).toPandas()
    for i, x in awkward[1]:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert b"".join(own.ids) == ids.tobytes() and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 256 and len(s) <= 4 and s.loss_tokens.sum() <= 200
        assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist()


def test_jaccard(spark, docs, awkward):
    cols = ("n_shingles", "component_id")
    assert got(jaccard.query(spark, DIR), "doc_id", *cols) == brute.components(docs, 3, 90)
    assert got(jaccard.joined(awkward[0], 5, 80), "doc_id", *cols) == brute.components(awkward[1], 5, 80)


def test_jaccard_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(200)] = f"n{i}x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    assert got(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90), "doc_id", "n_shingles", "component_id") == brute.components(rows, 3, 90)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm.score(empty, store.fold() != 1, store.fold() == 0).count() == 0
    assert linededup.deduplicated(empty).count() == 0 and passages.deduplicated(empty).count() == 0
    assert jaccard.joined(empty, 3, 90).count() == 0 and packing.pack(empty, "word_bpe_49k.json", 1).count() == 0
    assert quality.judged(empty, labels).count() == 0 and toxicity.kept(empty, labels).count() == 0
    assert token_store.read(token_store.write(empty, store.new_path(spark, "t"), "byte_bpe_50k.json", 0)).count() == 0
    assert decontam.clean(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_null_ids_repeats_and_clashing_names(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert lm.score(clashing, store.fold() != 1, store.fold() == 0).count() == 4
    assert sorted(r["n_dropped"] for r in linededup.deduplicated(clashing).collect()) == [0, 0, 0, 1]
    assert passages.deduplicated(clashing).count() == 4 and jaccard.joined(clashing, 3, 90).count() == 4
    assert packing.pack(clashing, "word_bpe_49k.json", 1).count() >= 4 and quality.judged(clashing, labels).count() == 4
    assert toxicity.kept(clashing, labels).columns == clashing.columns and toxicity.kept(clashing, labels).count() == 4
    assert decontam.clean(clashing, spark.createDataFrame([(1, "words of a")], "item_id long, text string")).count() == 1
    out = token_store.read(token_store.write(clashing, store.new_path(spark, "t"), "byte_bpe_50k.json", 0)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "2", "None"]


def test_pipeline_stages(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    n = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = df.collect() if k < 4 else None
        df = store.written(stage(spark, df, DIR), "s")
        if k < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            n.append((len(before), df.count()))
            rows = [(r["doc_id"], r["text"]) for r in before]
            after = {r["doc_id"]: r["text"] for r in df.collect()}
            if k == 2:
                assert set(after) == {i for i, (_, c) in brute.components(rows, 5, 80).items() if c == i}
            if k == 3:
                items = table("benchmark")
                assert set(after) == {i for i, _ in rows} - {d for d, _ in brute.leaks(rows, list(zip(items.item_id, items.text, strict=True)))}
    assert n[1][0] == n[1][1] and all(b <= a and b > 0.7 * a for a, b in n)
    assert df.count() >= n[-1][1]


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
