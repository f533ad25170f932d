"""The fill-in-middle transformation against plain Python, short and long documents alike."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteline.llm import infill

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases():
    r = random.Random(3)
    texts = [None, "", "\n", "one", "a\nb", "a\n\n\nb\n", "x<P>y", "<<S>", "<P", "P><M >", "été\n日本\n\U0001f600", "<", "<P\n>", "a\r\nb\r\n", "<S<M>"]
    texts += ["".join(r.choice(["a", "é", "\n", "<", "P", ">", "日", " "]) for _ in range(r.randrange(400))) for _ in range(150)]
    long = "".join(r.choice(["word ", "é", "\n", "<", "P ", "\n\n"]) for _ in range(3000))
    return [*texts, long, long, long[:500] + "<M>" + long, "\n" * 700, "x" * 5000]


@pytest.mark.parametrize("chunk", [37, 1 << 16])
def test_rows_equal_plain_python(spark, chunk):
    """Chunks far shorter than a document end inside lines, characters and sentinels."""
    rows = [(k, t) for k, t in enumerate(cases())] + [(None, "no\nid\nhere, and a line longer than one of the short chunks\n"), (None, "x"), (3, "one"), (160, "some\nother text of the same id, longer than a chunk of the short kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "key", "chunk", "h1")}).repartition(3)
    out = infill.transformed(docs, chunk=chunk).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=str)
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=str)
    assert got == want


def test_repeated_rows_and_rates(spark):
    docs = spark.createDataFrame([(k % 40, "l1\nl2\nl3") for k in range(80)], "doc_id long, text string")
    got = sorted((r.doc_id, r.form) for r in infill.transformed(docs, 9, 60, 20).collect())
    assert got == sorted((k % 40, plain(k % 40, "l1\nl2\nl3", 9, 60, 20)[1]) for k in range(80))
    assert {f for _, f in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert infill.transformed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_composition_is_associative_and_equals_a_walk():
    r = np.random.default_rng(1)
    for _ in range(40):
        data = r.choice(np.frombuffer(b"\n<PSM>x", np.uint8), r.integers(0, 60))
        cuts = np.sort(r.integers(0, len(data) + 1, 3))
        whole = infill.scan(data, np.array([0, len(data)]))
        parts = infill.scan(data, np.array([0, *cuts, len(data)]))
        one = [tuple(a[k : k + 1] for a in parts) for k in range(4)]
        left = infill.compose(infill.compose(one[0], one[1]), infill.compose(one[2], one[3]))
        right = infill.compose(one[0], infill.compose(one[1], infill.compose(one[2], one[3])))
        for a, b, c in zip(whole, left, right, strict=True):
            assert (a == b).all() and (b == c).all()
        for state in range(6):
            s, lines, marks = state, 0, 0
            for byte in data:
                kind = infill._CLASS[byte]
                lines, marks, s = lines + infill._BEGINS[kind, s], marks + infill._MARKS[kind, s], infill._NEXT[kind, s]
            assert (whole[0][0, state], whole[1][0, state], whole[2][0, state]) == (s, lines, marks)
