"""Readers and writers of small tables, digests and split records against plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from siteline.operators import folds as K
from siteline.operators import jobs as J
from siteline.operators import relational as L
from siteline.session import scratch
from siteline.sources import readers as S
from siteline.sources import writers as W


def test_commented_csv_round_trip(spark):
    rows = [("a", f"c{i}", i % 3, i) for i in range(500)] + [("b", "x", None, 2), ("b", "y", 1, 1)]
    df = spark.createDataFrame(rows, "g string, chrom string, fold long, at long").repartition(7)
    df = df.withColumn("m", F.create_map(F.lit("made"), F.concat(F.lit("of: "), "g"), F.lit("n"), F.lit("3")))
    path = scratch(spark, "commented")
    W.commented_csv(df, "g", "m", ["at"], path)
    files = [r["value"].rstrip("\n").split("\n") for r in spark.read.text(path, wholetext=True).collect()]
    assert len(files) == 2
    big = next(f for f in files if len(f) > 100)
    assert sorted(big[:2]) == ["# made: of: a", "# n: 3"] and big[2] == "chrom,fold,at" and big[3:] == [f"c{i},{i % 3},{i}" for i in range(500)]
    back = S.commented_csv(spark, path, "chrom string, fold long, at long").collect()
    assert sorted((r["meta"]["made"], r["chrom"], -1 if r["fold"] is None else r["fold"], r["at"]) for r in back) == sorted(("of: " + g, c, -1 if f is None else f, a) for g, c, f, a in rows)
    W.commented_csv(df.limit(0), "g", "m", ["at"], path + "x")
    assert S.commented_csv(spark, path + "x", "chrom string, fold long, at long").count() == 0


def test_commented_csv_heads_end_at_the_first_other_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# k: 1\n#k:2\n# no colon here\nchrom,fold\nx,1\n# late: 3\ny,2\n")
    (tmp_path / "b.csv").write_text("chrom,fold\nz,3\n")
    got = {r["chrom"]: (r["fold"], r["meta"]) for r in S.commented_csv(spark, f"file://{tmp_path}", "chrom string, fold long").collect()}
    assert got == {"x": (1, {"k": "2"}), "y": (2, {"k": "2"}), "z": (3, {})}


def test_digest_is_that_of_the_ordered_lines(spark):
    rows = [(None if i % 4 == 3 else f"k{i % 4}", (i * 37) % 500, None if i == 8 else f"l{i % 11};") for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o long, line string").repartition(5)
    want = {}
    for k, o, t in sorted(rows, key=lambda r: (r[0] or "", r[1], (r[2] or "").encode())):
        want[k] = want.get(k, "") + (t or "")
    assert {r["k"]: r["digest"] for r in L.digest(df, F.col("line"), "o", ["k"]).collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert L.digest(df.limit(0), F.col("line"), "o", ["k"]).count() == 0
    assert "mapInArrow" not in L.digest.__doc__ and L.digest(df, F.col("line"), "o", ["k"]).columns == ["k", "digest"]


def test_split_rows_follow_folds_and_records(spark):
    df = spark.createDataFrame([("s", {"10": ["z"], "2": ["b", "a"], "3": None}), ("t", {}), ("u", None)], "species string, folds map<string, array<string>>")
    assert sorted(map(tuple, K.split_rows(df, ["species"]).collect())) == [("s", 0, "b", 2), ("s", 1, "a", 2), ("s", 2, "z", 10)]


def test_stats_tables_skip_and_raise(spark):
    path = scratch(spark, "stats")
    spark.createDataFrame([("a", "experiment\tn\na\t4"), ("b", "other\n1"), ("c", "experiment\tn\n\t")], "named string, value string").write.partitionBy("named").text(path)
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "experiment string")
    name = F.regexp_extract("file", "named=([^/]*)", 1)
    assert [tuple(r) for r in S.stats_tables(spark, path, ["experiment", "n"], of("a", "zz"), name).collect()] == [("a", "4")]
    with pytest.raises(ValueError, match="header"):
        S.stats_tables(spark, path, ["experiment", "n"], of("a", "b"), name)
    with pytest.raises(ValueError, match="no stats"):
        S.stats_tables(spark, path, ["experiment", "n"], of("zz"), name)


def test_motif_databases(spark):
    genomes = spark.createDataFrame([("yeast", "fungi"), ("pombe", "fungi"), ("fly", "insects"), ("moss", None)], "species string, collection string")
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "species string")
    got = {tuple(r) for r in J.motif_databases(of("yeast", "pombe", "fly", "fly"), genomes, "db", "http://x").collect()}
    file = "JASPAR2026_CORE_{}_non-redundant_pfms_meme.txt".format
    assert got == {(f"db/{file(c)}", f"http://x/JASPAR2026/CORE/{file(c)}") for c in ("fungi", "insects")}
    with pytest.raises(ValueError, match="not among the genomes: frog"):
        J.motif_databases(of("frog", "fly"), genomes, "db", "http://x")
    with pytest.raises(ValueError, match="without a collection: moss"):
        J.motif_databases(of("moss"), genomes, "db", "http://x")
