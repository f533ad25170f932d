"""The line store: filters stay right through false positives and deletions, keys tell long lines apart, any column name goes."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa

from siteline.llm import linededup, store
from siteline.llm import text as T

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def keys_of(lines):
    return np.concatenate([linededup.line_keys(w)[3] for w in T.words(pa.array(lines))])


def test_keys_known_by_mistake_get_their_own_mark(spark):
    lines = [f"line number {k} of the first document" for k in range(20_000)]
    first = linededup.LineStore.empty(spark, 1).insert(spark.createDataFrame([(1, "\n".join(lines))], DOC))
    f = linededup.Cuckoo.load(first.filters.first()["blob"])
    others = [f"some other line {k}" for k in range(60_000)]
    wrong = [x for x, k in zip(others, f.holds(keys_of(others).view(np.uint64)), strict=True) if k][:5]
    assert wrong
    then = first.insert(spark.createDataFrame([(2, "\n".join(wrong))], DOC)).delete(spark.createDataFrame([(2,)], "doc_id long"))
    last = then.insert(spark.createDataFrame([(3, "\n".join(lines))], DOC))
    assert last.refs.count() == last.refs.select("key", "key2").distinct().count() == len(lines)
    assert last.decide(spark.createDataFrame([(3, "\n".join(lines))], DOC)).first()["n_dropped"] == len(lines)


def test_every_key_has_a_mark_after_any_changes(spark):
    texts = [(d, "\n".join(f"a line of text {k * k % (97 + d)}" for k in range(300))) for d in range(12)]
    s = linededup.LineStore.empty(spark, 1)
    for some in (texts[:4], texts[4:8], texts[2:6], texts[8:]):
        s = s.insert(spark.createDataFrame(some, DOC))
    s = s.delete(spark.createDataFrame([(d,) for d in (0, 5, 11)], "doc_id long")).insert(spark.createDataFrame(texts[5:6], DOC))
    blobs = {r["shard"]: linededup.Cuckoo.load(r["blob"]) for r in s.filters.collect()}
    for r in s.refs.collect():
        assert blobs[r["shard"]].holds(np.array([r["key"]]).view(np.uint64)).all()
    left = [x for x in texts if x[0] not in (0, 11)]
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in s.decide(spark.createDataFrame(left, DOC)).collect()}
    whole = linededup.deduplicated(spark.createDataFrame(left, DOC), batches=1)
    assert out == {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in whole.collect()}


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_long_lines_that_a_polynomial_hash_confuses(spark):
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    out = linededup.deduplicated(spark.createDataFrame([(1, a), (2, b), (3, a)], DOC)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in out} == {1: 0, 2: 0, 3: 1}
    for which in (0, 1):
        raw = np.frombuffer((a + b).encode(), np.uint8)
        assert len(set(T.span_hashes(raw, np.array([0, 2048]), np.array([2048, 4096]), which).tolist())) == 2


def test_span_hashes_depend_on_the_span_alone():
    r = np.random.default_rng(2)
    word = r.integers(97, 100, 300_000).astype(np.uint8)
    data = np.concatenate([word, word[:5], word, word[:5]])
    n = len(word)
    got = T.span_hashes(data, np.array([0, n, n + 5, 2 * n + 5]), np.array([n, n + 5, 2 * n + 5, 2 * n + 10]))
    assert got[0] == got[2] and got[1] == got[3] and got[0] != got[1]
    assert len(np.unique(T.span_hashes(word, np.arange(0, n - 20, 20), np.arange(20, n, 20)))) == len({word[k : k + 20].tobytes() for k in range(0, n - 20, 20)})


def test_any_column_names(spark):
    names = ["n_lines", "n_dropped", "KEPT_SHA256", "__keys", "__id", "__sizes", "shard", "key", "key2", "first", "refs", "known", "blob", "a.b"]
    docs = spark.createDataFrame([(1, "the same line\nx", *range(len(names))), (2, "the same line", *range(len(names)))], DOC + ", " + ", ".join(f"`{x}` long" for x in names))
    out = {r["doc_id"]: r for r in linededup.deduplicated(docs).collect()}
    assert out[2]["n_dropped"] == 1 and out[2]["text"] == "" and out[1]["n_lines"] == 2 and out[1]["a.b"] == len(names) - 1
    assert out[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and out[1]["__keys"] == 3


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.query(spark, DIR).collect()}
    cur = con.execute(linededup.SQL)
    names = [x[0] for x in cur.description]
    assert out == {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in ("n_lines", "n_dropped", "kept_sha256")) for r in cur.fetchall()}
    assert linededup.deduplicated(store.documents(spark, DIR).limit(0)).count() == 0
