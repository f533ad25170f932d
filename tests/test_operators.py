"""Operators on hand-made frames, with the cases that the data model calls for."""

import random

import pytest
from pyspark.sql import functions as F

from siteline.functions import seq as Q
from siteline.functions import text as X
from siteline.operators import compare as C
from siteline.operators import folds as K
from siteline.operators import intervals as I
from siteline.operators import qc
from siteline.operators import relational as L
from siteline.operators import signal as S
from siteline.operators.ordinal import with_ordinal
from siteline.sources import readers, writers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sweep_keeps_mass_and_adjacent_levels(spark):
    iv = spark.createDataFrame([("1", 0, 10, 2.0), ("1", 5, 10, 1.0), ("1", 10, 20, 3.0), ("X", 3, 4, 1.0), ("1", 7, 7, 9.0)], "chrom string, start_pos long, end_pos long, value double")
    for bucket in (1 << 20, 4):
        out = I.sweep_sum(iv.filter("start_pos < end_pos"), bucket=bucket)
        assert rows(out, "chrom", "start_pos", "end_pos", "level") == [("1", 0, 5, 2.0), ("1", 5, 10, 3.0), ("1", 10, 20, 3.0), ("X", 3, 4, 1.0)]


def test_merge_gap_touching_and_idempotent(spark):
    iv = spark.createDataFrame([("1", 0, 10), ("1", 10, 12), ("1", 30, 40), ("1", 0, 10)], "chrom string, start_pos long, end_pos long")
    once = I.merge_gap(iv, 5)
    assert rows(once, "start_pos", "end_pos", "n") == [(0, 12, 3), (30, 40, 1)]
    assert rows(I.merge_gap(once, 5), "start_pos", "end_pos") == [(0, 12), (30, 40)]


def test_overlap_and_plan_has_no_nested_loop(spark):
    a = spark.createDataFrame([("1", 0, 5000), ("1", 5000, 5001), ("1", 7, 7)], "chrom string, a_start long, a_end long")
    b = spark.createDataFrame([("1", 4999, 5000), ("X", 0, 9)], "chrom string, b_start long, b_end long")
    out = I.overlap_any(a, b, 100)
    assert rows(out, "a_start", "hit") == [(0, True), (7, False), (5000, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_site(spark):
    p = spark.createDataFrame([("1", "+", 100), ("1", "+", 160), ("1", "-", 100)], "chrom string, strand string, pos long")
    s = spark.createDataFrame([("1", "+", 110), ("1", "+", 300)], "chrom string, strand string, pos long")
    for bucket in (1 << 20, 64):
        assert rows(I.nearest_within(p, s, 50, bucket), "pos", "strand", "near") == [(100, "+", True), (100, "-", False), (160, "+", True)]
        assert rows(I.nearest_within(p, s, 49, bucket).filter("near"), "pos", "distance") == [(100, 10)]


def test_gap_groups_and_tiles(spark):
    p = spark.createDataFrame([(1, "1", 0), (2, "1", 10), (3, "1", 21), (4, "X", 22)], "peak_idx long, chrom string, center long")
    assert rows(I.gap_groups(p, 10), "peak_idx", "grp") == [(1, 1), (2, 1), (3, 2), (4, 1)]
    sizes = spark.createDataFrame([("1", 25), ("X", 9)], "chrom string, size long")
    assert rows(I.tile(sizes, 10), "start_pos", "end_pos") == [(0, 10), (10, 20)]
    peaks = spark.createDataFrame([("1", 9, 10)], "chrom string, start_pos long, end_pos long")
    assert rows(I.mask_tiles(I.tile(sizes, 10), peaks, 10), "start_pos") == [(10,)]


def test_exclusion_bins(spark):
    pts = spark.createDataFrame([("1", 99), ("1", 100), ("1", 299), ("1", 300)], "chrom string, pos long")
    zone = spark.createDataFrame([("1", 100, 200)], "chrom string, start_pos long, end_pos long")
    assert rows(I.mark_excluded(pts, zone), "pos") == [(99,), (300,)]


def test_five_prime_and_profile(spark):
    aln = spark.createDataFrame([("1", 5, 9, "+"), ("1", 5, 9, "-"), ("1", 5, 8, "+")], "chrom string, start_pos long, end_pos long, strand string")
    assert rows(S.five_prime(aln), "strand", "pos", "value") == [("+", 5, 2.0), ("-", 8, 1.0)]
    sites = spark.createDataFrame([(1, "1", 5, "+"), (2, "1", 8, "-"), (3, "1", 900, "+")], "site long, chrom string, pos long, strand string")
    out = {r["offset"]: (r["sense"], r["anti"], r["n_sites"]) for r in S.profile(sites, S.five_prime(aln), 10).collect()}
    assert out[0][2] == 2 and out[0][0] == pytest.approx((2 / 3 + 1 / 3) / 2)
    assert sum(a + b for a, b, _ in out.values()) == pytest.approx(1)


def test_flat_composition_has_no_information(spark):
    f = spark.createDataFrame([(k, b, w) for k in range(12) for b, w in zip("ACGT", (0.18, 0.32, 0.32, 0.18), strict=True)], "offset long, base string, freq double")
    assert all(abs(r["bits"]) < 1e-12 for r in S.information(f).collect())


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("GGGG",)], "s string")
    s = F.col("s")
    assert [r[0] for r in df.select(Q.revcomp(s)).collect()] == ["NACGT", "", "CCCC"]
    assert [r[0] for r in df.select(Q.find_first(s, ["GT", "CG"])).collect()] == [1, -1, -1]
    assert [r[0] for r in df.select(Q.trim_insert(s, ["A"])).collect()] == ["", "", "GGGG"]
    assert [len(r[0]) for r in df.select(Q.kmers(s, 4)).collect()] == [2, 0, 1]
    run = spark.createDataFrame([([2.0, 2.0, 1.0, 2.0],), ([2.0] * 5,)], "b array<double>")
    assert [r[0] for r in run.select(Q.leading_run(F.col("b"))).collect()] == [0, 5]


def test_text(spark):
    df = spark.createDataFrame([("chr1:1,000-2,000",), ("chrX",)], "s string")
    assert [tuple(r[0]) for r in df.select(X.parse_region(F.col("s"))).collect()] == [("chr1", 1000, 2000), ("chrX", None, None)]
    one = spark.range(1)
    assert one.select(X.normalize_name(F.lit("K562 Rep2-a"))).first()[0] == "k562r2a"
    assert one.select(X.path_stem(F.lit("/x/a.b.bed.gz"))).first()[0] == "a.b"
    assert one.select(X.strip_trailing_paren(F.lit("a (b) (c)"))).first()[0] == "a (b)"


def test_unique_key_join_never_fans_out(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert rows(L.join_unique(left, right, ["k"], ["v"]).fillna("-"), "k", "v") == [(1, "a"), (2, "-"), (3, "-")]


def test_keep_compares_as_strings(spark):
    df = spark.createDataFrame([("1",), ("X",), ("01",)], "chrom string")
    assert rows(L.keep(df, spark.createDataFrame([(1,)], "chrom int"), "chrom"), "chrom") == [("1",)]


def test_ordinal(spark):
    out = with_ordinal(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7), "v", name="n")
    assert rows(out, "v", "n") == [(k, k + 1) for k in range(1000)]


def test_ordinal_of_wide_rows_in_many_partitions(spark):
    n = 3_000_000
    wide = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = with_ordinal(wide, "v", name="n").agg(F.count("*"), F.countDistinct("n"), F.max("n"), F.count(F.when(F.col("n") != F.col("v") + 1, 1))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(out) == (n, n, n, 0)
    assert with_ordinal(wide.limit(0), "v", name="n").count() == 0


def test_overlap_any_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("1", 5, 9, "x"), ("1", 5, 9, "x"), ("1", 7, 7, "y"), ("2", 5, 9, "z"), (None, 1, 2, "n")], "chrom string, a_start long, a_end long, tag string").repartition(5)
    b = spark.createDataFrame([("1", 8, 20), ("1", 0, 4000), ("2", 9, 10)], "chrom string, b_start long, b_end long")
    from siteline.operators import intervals

    assert sorted((r["tag"], r["hit"]) for r in intervals.overlap_any(a, b).collect()) == [("n", False), ("x", True), ("x", True), ("y", False), ("z", False)]


def test_upper_median_and_digitize(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([5],)], "v array<long>")
    assert [r[0] for r in df.select(L.upper_median(F.col("v"))).collect()] == [3, 5]
    e = F.array(*(F.lit(float(x)) for x in (0, 10, 20, 30)))
    got = spark.createDataFrame([(-5.0,), (10.0,), (19.0,), (99.0,)], "x double").select(C.digitize(e, F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2]


def test_correlations_of_constants_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "k string, x double, y double")
    assert {r["k"]: r["rho"] for r in C.spearman(df, "x", "y", ["k"]).collect()} == {"a": None, "b": pytest.approx(1.0)}
    arr = spark.createDataFrame([([1.0, 1.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "x array<double>, y array<double>")
    assert [r[0] for r in arr.select(C.array_pearson(F.col("x"), F.col("y"))).collect()] == [None, pytest.approx(1.0)]
    assert arr.select(C.jensen_shannon(C.normalised(F.col("x")), C.normalised(F.col("x")))).first()[0] == 0.0


def test_wilcoxon_needs_six(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 9)] + [("b", 1.0), ("b", 0.0)], "k string, d double")
    out = {r["k"]: (r["w"], r["p"]) for r in C.wilcoxon(df, "d", ["k"]).collect()}
    assert out["a"][0] == 0.0 and 0.005 < out["a"][1] < 0.02 and out["b"][1] is None


def test_greedy_bins_balance_and_keep_groups_whole(spark):
    g = spark.createDataFrame([("1", k, 1 + k % 5) for k in range(100)], "chrom string, grp long, n long")
    out = K.greedy_bins(g, 5).toPandas()
    fill = out.groupby("fold").n.sum()
    assert len(out) == 100 and fill.max() - fill.min() <= 5
    assert (K.greedy_bins(g, 5).toPandas().sort_values("grp").fold.values == out.sort_values("grp").fold.values).all()


def test_flags_and_unmeasured(spark):
    s = spark.createDataFrame(
        [(1, "a", 20.0, None, None, 5), (2, "a", 20.0, 70.0, 499.6, 10), (3, "a", None, None, None, 10), (4, "a", 90.0, None, 500.0, 1), (5, "a", 45.0, 5.0, None, 0), (6, None, None, 50.0, None, None)],
        "experiment long, species string, pct_unique double, pct_rrna double, reads_per_peak double, peaks_total long",
    )
    survey = spark.createDataFrame([(3, ["dimer_run:r1/r2"])], "experiment long, problems array<string>")
    got = dict(rows(qc.flags(s, survey), "experiment", "qc_flags"))
    assert got == {1: "FAIL:very_low_mapping(20%,raw)", 2: "WARN:thin_coverage(500/peak)", 3: "FAIL:dimer_run:r1/r2", 4: "WARN:peaks_below_species(1v8)", 5: "WARN:low_mapping(47%,adj)", 6: ""}
    assert {r["severity"]: r["n"] for r in qc.flag_report(qc.flags(s)).collect()} == {"FAIL": 1, "WARN": 3, "ok": 2}


def test_read_survey_statistics(spark):
    reads = [("r", "R1", x) for x in ("AACCTGGAATTCTCGG", "TGGAATTCTCGGAAAA", "NACGNACGNACGNACG", "A" * 4 + "G" * 12, "ACG", "", None)]
    out = qc.read_survey(spark.createDataFrame(reads, "run string, mate string, seq string")).first().asDict()
    assert (out["n_sampled"], out["read_len"], out["best_adapter"], out["median_insert"]) == (6, 16, "smallRNA_RA3", 4)
    assert round(out["pct_adapter"], 2) == 33.33 and round(out["pct_short_untrimmed"], 2) == 33.33 and out["dead_cycles"] == "-"
    some = qc.read_survey(spark.createDataFrame([("r", "R1", "NA"), ("r", "R1", "CN"), ("r", "R1", "CA")], "run string, mate string, seq string")).first()
    assert some["dead_cycles"] == "1,2" and some["best_adapter"] == "none" and some["median_insert"] is None and round(some["pct_any_n"], 2) == 66.67


def test_interleave_screen_and_survey_flags(spark):
    columns = "experiment string, run string, mate string, project string, paired boolean, n_sampled long, read_len long, pct_polyg double, median_insert long, pct_adapter double, best_adapter string, declared_interleaved string"
    s = spark.createDataFrame([
        ("e", "a", "R1", "p", False, 9, 150, 65.0, 40, 60.0, "nextera", "no"), ("e", "b", "R1", "p", False, 9, 50, 0.1, 3, 30.0, "truseq_universal", "no"), ("e", "c", "R1", "p", False, 9, 51, 0.1, 18, 90.0, "truseq_universal", "no"),
        ("f", "d", "R1", None, False, 9, 75, 5.0, None, 0.0, "none", "yes"), ("f", "d", "R2", None, True, 9, 75, 50.0, 1, 99.0, "nextera", "no"), ("f", "x", "R1", "p", True, 0, None, None, None, None, None, None),
    ], columns)
    seen = qc.interleave_suspect(s)
    assert {(r["run"], r["mate"]): r["interleave_suspect"] for r in seen.collect()} == {("a", "R1"): "polyg,long_for_project", ("b", "R1"): "", ("c", "R1"): "", ("d", "R1"): "polyg", ("d", "R2"): "", ("x", "R1"): ""}
    want = spark.createDataFrame([("e", "smallRNA_RA3"), ("f", "")], "experiment string, adapter string")
    got = {r["experiment"]: r["problems"] for r in qc.survey_flags(seen, want).collect()}
    assert got == {"e": ["dimer_run:b", "interleave_suspect:a", "adapter_mismatch(config=smallRNA_RA3,reads=nextera)"], "f": []}


def test_run_files(spark):
    m = spark.createDataFrame([("r1;r2", "h/r1/x.gz;h/r2_1.gz;h/r12/z.gz", "a;b"), (None, "h/r1/x.gz", "a"), ("r1", "h/r1/x.gz", "a"), ("r3", "", "")], "runs string, urls string, md5s string")
    assert rows(L.run_files(m), "run", "url", "md5") == [("r1", "h/r1/x.gz", "a"), ("r2", "h/r2_1.gz", "b")]


def test_umi_report(spark):
    files = spark.createDataFrame([("a", 1, 8), ("a", 2, 0), ("b", 1, 0), ("b", 2, 8), ("c", 1, 6), ("d", 1, None), ("e", 1, 5)], "run string, mate long, detected long")
    declared = spark.createDataFrame([("a", 8, True, "read1"), ("b", 8, True, "read1"), ("c", 8, False, "nowhere"), ("d", None, True, None)], "run string, umi_len long, paired boolean, place string")
    got = {(r["run"], r["mate"]): (r["expected"], r["verdict"]) for r in qc.umi_report(files, declared).collect()}
    assert got == {("a", 1): (8, "match"), ("a", 2): (0, "none"), ("b", 1): (8, "MISMATCH"), ("b", 2): (0, "undeclared"), ("c", 1): (8, "MISMATCH"), ("d", 1): (0, None), ("e", 1): (0, "undeclared")}
    with pytest.raises(Exception, match="unknown place"):
        qc.umi_report(files, declared.withColumn("paired", F.lit(True))).collect()


def test_strata_guards(spark):
    columns = "peak_idx long, pclass string, qval double, strand string, label string"
    own = [(k, "uni", k / 10, "+", None) for k in range(8)] + [(8, "bi", None, None, "Relaxed"), (9, "bi", None, None, "Stringent(qval)")]
    got = {r["stratum"]: r["n"] for r in K.strata(spark.createDataFrame(own, columns)).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got == {"uni": 8, "bi": 2, "uniq1": 2, "uniq2": 2, "uniq3": 2, "uniq4": 2, "bi_relaxed": 1, "bi_stringentqval": 1}
    for bad in ([(0, "tri", 0.1, "+", None)], [(0, "uni", 0.1, "x", None)], [(0, "uni", 0.1, "+", None), (1, "bi", None, None, "a"), (2, "bi", None, None, "a")]):
        with pytest.raises(ValueError):
            K.strata(spark.createDataFrame(bad, columns))
    assert K.strata(spark.createDataFrame([], columns)).count() == 0
    with pytest.raises(ValueError):
        K.split(spark.createDataFrame([(0,)], "fold long"), 5, 5)


def test_negatives_obey_every_filter(spark):
    columns = "chrom string, start_pos long, end_pos long, seq string, signal double"
    tiles = spark.createDataFrame([("1", 0, 10, "GGGGGAAAAA", 1.0), ("1", 10, 20, "GGGGGNNAAA", 1.0), ("1", 20, 30, "GGGGGAAAAA", 1.0), ("1", 30, 40, "GCGCGATATA", 9.0), ("2", 0, 10, "AAAAAAAAAA", 1.0), ("2", 10, 20, "CCCCCTTTTT", 2.0)], columns)
    peaks = spark.createDataFrame([("1", 25, 35, "GGGGGTTTTT", 4.0)], columns)
    out = K.negatives(tiles, peaks, F.col("start_pos"), beta=0.5)
    assert rows(out, "chrom", "start_pos") == [("1", 0)]
    more = spark.createDataFrame([("9", 0, 10, "GGGGGTTTTT", 4.0)] * 3, columns)
    assert rows(K.negatives(tiles, peaks.unionByName(more), F.col("start_pos"), beta=None), "chrom", "start_pos") == [("1", 0), ("2", 10)]
    report = K.negatives_report(out, peaks, tiles).first()
    assert (report["n_negatives"], report["per_peak"], report["overlap_share"], report["median_background"], report["times_background"]) == (1, 1.0, 0.0, 1.0, 1.0)


def test_transfers(spark):
    pair = "file string, md5 string"
    expected = spark.createDataFrame([("same", "1"), ("other", "1"), ("blank", ""), ("gone", "1"), ("failed", "1"), ("part", "1")], pair)
    have, staged = spark.createDataFrame([("same", "1"), ("other", "2"), ("blank", "9")], pair), spark.createDataFrame([("other", "1"), ("gone", "1"), ("part", "7"), ("blank", "8"), ("same", "1")], pair)
    run = lambda **how: dict(rows(L.transfers(expected, have, staged, **how), "file", "status"))
    assert run() == {"same": "ok", "other": "fetched", "blank": "kept", "gone": "fetched", "failed": "FAILED", "part": "CORRUPT"}
    assert run(verify_only=True) == {"same": "ok", "other": "CORRUPT", "blank": "kept", "gone": "missing", "failed": "missing", "part": "missing"}
    assert run(dry_run=True)["other"] == "ok" and run(dry_run=True)["gone"] == "would fetch" and run(force=True)["blank"] == "fetched"


def test_readers_of_files_larger_than_a_split(spark, tmp_path):
    r = random.Random(9)
    reads = [(f"r{k}", "".join(r.choice("ACGTN") for _ in range(r.randrange(1, 90)))) for k in range(3000)]
    fq = tmp_path / "r.fastq"
    fq.write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    contigs = {f"c{k}": "".join(r.choice("acgt") for _ in range(n)) for k, n in enumerate((5, 40_000, 0, 61, 12_000, 1, 30_000))}
    fa = tmp_path / "g.fa"
    fa.write_text("".join(f">{n} more\n" + "".join(s[j : j + 60] + "\n" for j in range(0, len(s), 60)) for n, s in contigs.items()))
    settings = {"spark.sql.files.maxPartitionBytes": "6000", "spark.sql.files.openCostInBytes": "1000"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(fq)).rdd.getNumPartitions() > 10 and spark.read.text(str(fa)).rdd.getNumPartitions() > 8
        assert rows(readers.fastq(spark, str(fq)), "ordinal", "name", "seq") == sorted((k, n, s) for k, (n, s) in enumerate(reads))
        assert rows(readers.fastq(spark, str(fq), 70), "ordinal", "name", "seq") == sorted((k, n, s) for k, (n, s) in enumerate(reads[:70]))
        for chunk in (64, 1000, 1 << 16):
            got = {}
            for x in sorted(readers.fasta(spark, str(fa), chunk=chunk).collect(), key=lambda x: x["chunk_id"]):
                assert len(x["seq"]) <= chunk and x["chunk_start"] == x["chunk_id"] * chunk == len(got.get(x["chrom"], ""))
                got[x["chrom"]] = got.get(x["chrom"], "") + x["seq"]
            assert got == {n: s.upper() for n, s in contigs.items() if s}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_readers(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("track x\n#c\n1\t5\t9\tn\t0.1\t+\t1\t2\t3\n\nX\t1\t2\tRelaxed\t1\t2\n")
    assert rows(readers.bed_ragged(spark, str(bed)), "chrom", "start_pos", "width") == [("1", 5, 9), ("X", 1, 6)]
    assert rows(readers.bed3(spark, str(bed)), "chrom", "end_pos") == [("1", 9), ("X", 2)]
    fa = tmp_path / "g.fa"
    fa.write_text(">c1 x\nacgt\nACGT\n>c2\nNN\n")
    g = readers.fasta(spark, str(fa), chunk=3)
    assert rows(g, "chrom", "chunk_start", "seq") == [("c1", 0, "ACG"), ("c1", 3, "TAC"), ("c1", 6, "GT"), ("c2", 0, "NN")]
    w = spark.createDataFrame([("w", "c1", 2, 7), ("end", "c1", 6, 20)], "window string, chrom string, start_pos long, end_pos long")
    assert rows(readers.fetch(g, w, 3), "window", "seq") == [("end", "GT"), ("w", "GTACG")]
    fq = tmp_path / "r.fastq"
    fq.write_text("@a\nAC\n+\nII\n@b\nGG\n+\nII\n")
    assert rows(readers.fastq(spark, str(fq), 1), "ordinal", "name", "seq") == [(0, "a", "AC")]
    with pytest.raises(ValueError, match="absent"):
        fai = tmp_path / "g.fai"
        fai.write_text("c1\t8\t0\t60\t61\n")
        readers.fai(spark, str(fai), spark.createDataFrame([("zz",)], "chrom string"))


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(8.0,), (0.125,), (1234567.0,), (0.0,), (1e-7,)], "v double")
    assert [r[0] for r in writers.per_locus(df, ["v"]).collect()] == [f"{x:.6g}" for x in (8.0, 0.125, 1234567.0, 0.0, 1e-7)]


def test_empty_tables(spark):
    iv = spark.createDataFrame([], "chrom string, start_pos long, end_pos long, value double")
    assert I.sweep_sum(iv).count() == 0 and I.merge_gap(iv, 1).count() == 0
    assert S.five_prime(spark.createDataFrame([], "chrom string, start_pos long, end_pos long, strand string")).count() == 0
