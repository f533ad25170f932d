"""Queries of readers, writers, quality rules, curation and orchestration.

A reader's query writes its rows as the format's text into the scratch folder and reads them back.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from siteline.functions import seq as Q
from siteline.functions import text as X
from siteline.operators import folds as K
from siteline.operators import jobs as J
from siteline.operators import qc as C
from siteline.operators import relational as L
from siteline.plans.proxies import sql, table, view
from siteline.plans.registry import Registry
from siteline.session import scratch
from siteline.sources import readers as S
from siteline.sources import tracks as T
from siteline.sources import writers as W

R = Registry()
count = lambda: F.count("*").alias("n")


def text_of(spark, df, value, name, whole=False):
    """``df`` written as lines of ``value``; as one file, in order, if the format needs whole files."""
    path = scratch(spark, name)
    out = df.select(value.alias("value"))
    (out.coalesce(1) if whole else out).write.text(path)
    return path


@R.add("src_bed3", sql("select chrom, start_pos, end_pos from peaks", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    path = scratch(spark, "bed")
    W.bed_gz(p.select("chrom", "start_pos", "end_pos"), path)
    return S.bed3(spark, path)


@R.add("snk_bed_gz", sql("select chrom, start_pos, end_pos, case when pclass = 'uni' then 9 else 6 end as width from peaks", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    tail = F.when(F.col("pclass") == "uni", "n\t0.1\t+\t1\t2\t3").otherwise("Relaxed\t1\t2")
    path = scratch(spark, "bed")
    W.bed_gz(p.select(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), tail).alias("raw")), path)
    return S.bed_ragged(spark, path).select("chrom", "start_pos", "end_pos", F.col("width").cast("int").alias("width"))


@R.add("src_bed_ragged", sql("select case when pclass = 'uni' then 9 else 6 end as width, count(*) as n from peaks group by 1", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    tail = F.when(F.col("pclass") == "uni", "n\t0.1\t+\t1\t2\t3").otherwise("Relaxed\t1\t2")
    path = text_of(spark, p, F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), tail), "bed")
    return S.bed_ragged(spark, path).groupBy(F.col("width").cast("int").alias("width")).agg(count())


@R.add("agg_bed_count", sql("select count(*) as n from peaks", "peaks"))
def _(spark, d):
    path = scratch(spark, "bed")
    W.bed_gz(view(spark, d, "peaks"), path)
    return S.bed3(spark, path).agg(count())


@R.add("src_manifest_tsv", "select cast(c_custkey as varchar) as key, c_name as name, cast(c_nationkey as varchar) as nation from customer")
def _(spark, d):
    path = scratch(spark, "tsv")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("x").alias("extra"))
    W.tsv(t, path, ["key", "name", "nation"])
    return S.tsv(spark, path, ["key", "name", "nation"])


@R.add("snk_tsv", "select n_name as name, cast(n_regionkey as varchar) as region from nation")
def _(spark, d):
    path = scratch(spark, "tsv")
    W.tsv(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "n_comment") if "n_comment" in table(spark, d, "nation").columns else table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path, ["name", "region"])
    return S.tsv(spark, path, ["name", "region"])


@R.add("src_fai", "select cast(c_custkey as varchar) as chrom, c_custkey * 100 as size from customer where c_custkey <= 50")
def _(spark, d):
    c = table(spark, d, "customer")
    path = text_of(spark, c, F.concat_ws("\t", F.col("c_custkey").cast("string"), (F.col("c_custkey") * 100).cast("string"), F.lit("0\t60\t61")), "fai")
    return S.fai(spark, path, c.filter("c_custkey <= 50").select(F.col("c_custkey").alias("chrom")))


@R.add("src_fastq", sql("select doc_id, seq from seqs where seq <> ''", "seqs"))
def _(spark, d):
    s = view(spark, d, "seqs").filter("seq <> ''")
    path = text_of(spark, s, F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "I")), "fastq")
    return S.fastq(spark, path).select(F.col("name").cast("long").alias("doc_id"), "seq")


@R.add("src_fastq_budget", sql("select file, doc_id, seq from (select doc_id % 2 as file, doc_id, seq, row_number() over (partition by doc_id % 2 order by doc_id) as i from seqs where seq <> '') where i <= 20", "seqs"))
def _(spark, d):
    """60 reads of three files, one of which isn't there: 20 of each other."""
    s = view(spark, d, "seqs").filter("seq <> ''")
    record = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit(":"), (F.col("doc_id") % 2).cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "I"))
    paths = [scratch(spark, "fastq") for _ in range(3)]
    for k in (0, 1):
        s.filter(F.col("doc_id") % 2 == k).repartition(1).sortWithinPartitions("doc_id").select(record.alias("value")).write.text(paths[k])  # a file is one by nature here
    name = F.split("name", ":")
    return S.fastq_budget(spark, paths, 60).select(name[1].cast("long").alias("file"), name[0].cast("long").alias("doc_id"), "seq")


FASTA = "select cast(doc_id as varchar) as chrom, seq from seqs where length(seq) >= 20"


def genome(spark, d, wanted=None):
    s = view(spark, d, "seqs").filter("length(seq) >= 20")
    path = text_of(spark, s, F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" x\n"), F.regexp_replace(F.lower("seq"), "(.{50})", "$1\n")), "fasta")  # a contig is a row, and so in one file
    return S.fasta(spark, path, wanted, chunk=64)


@R.add("src_fasta_subset", sql("select chrom, length(seq) as size, upper(substr(seq, 1, 64)) as head from (" + FASTA + ") where chrom in ('1', '3', '10')", "seqs"))
def _(spark, d):
    g = genome(spark, d, ["1", "3", "10"])
    return g.groupBy("chrom").agg(F.sum(F.length("seq")).alias("size"), F.max(F.when(F.col("chunk_id") == 0, F.col("seq"))).alias("head"))


@R.add("src_fasta_random", sql("select chrom, substr(seq, 11, 90) as seq from (" + FASTA + ") where length(seq) > 10", "seqs"))
def _(spark, d):
    g = genome(spark, d)
    w = g.select("chrom").distinct().select(F.col("chrom").alias("window"), "chrom", F.lit(10).cast("long").alias("start_pos"), F.lit(100).cast("long").alias("end_pos"))
    return S.fetch(g, w, chunk=64).filter("seq is not null and seq <> ''").select("chrom", "seq")


@R.add("src_annotation", "select distinct cast(o_custkey % 7 as varchar) as chrom, case when o_orderstatus = 'F' then o_orderkey + 1 else o_orderkey + 500 end as tss, case when o_orderstatus = 'F' then '+' else '-' end as strand from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    line = F.concat_ws("\t", (F.col("o_custkey") % 7).cast("string"), F.lit("src"), F.lit("transcript"), (F.col("o_orderkey") + 1).cast("string"), (F.col("o_orderkey") + 500).cast("string"), F.lit("."), F.when(F.col("o_orderstatus") == "F", "+").otherwise("-"), F.lit("."), F.lit('gene_id "g"; transcript_id "t";'))
    return S.annotation(spark, text_of(spark, o, line, "gtf"))


@R.add("src_rrna_features", "select n_name as chrom, cast(n_nationkey * 10 as bigint) as start_pos, cast(n_nationkey * 10 + 50 as bigint) as end_pos, case when n_nationkey % 2 = 0 then '5S_rRNA' else 'rRNA_25S' end as name, case when n_nationkey % 2 = 0 then '5s' else '35s' end as class from nation")
def _(spark, d):
    attrs = F.when(F.col("n_nationkey") % 2 == 0, "ID=a;Name=5S_rRNA").otherwise("ID=rRNA_25S")
    line = F.concat_ws("\t", "n_name", F.lit("s"), F.lit("rRNA"), (F.col("n_nationkey") * 10 + 1).cast("string"), (F.col("n_nationkey") * 10 + 50).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    return S.rrna_features(spark, text_of(spark, table(spark, d, "nation"), line, "gff"))


@R.add("src_log_layout_fallback", "select c_custkey as sample, case when c_custkey % 3 < 2 then c_custkey || '/' || (c_custkey % 3) end as path from customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"))
    cand = c.select("sample", F.explode(F.array(F.lit(0), F.lit(1))).alias("priority")).withColumn("path", F.concat_ws("/", F.col("sample").cast("string"), F.col("priority").cast("string")))
    return S.first_layout(cand, cand.filter("sample % 3 <= priority and sample % 3 < 2").select("path"))


@R.add("src_bam_idxstats", "select n_regionkey as sample, coalesce(cast(sum(case when n_nationkey % 4 > 0 then n_nationkey * 10 end) as bigint), 0) as mapped from nation group by 1")
def _(spark, d):
    """Index statistics of one alignment a region, of the chromosomes that count."""
    n = table(spark, d, "nation")
    path = scratch(spark, "idxstats")
    line = F.concat_ws("\t", "n_name", F.lit("1000"), (F.col("n_nationkey") * 10).cast("string"), F.lit("3"))
    n.select(line.alias("value"), F.col("n_regionkey").alias("sample")).unionByName(n.select(F.lit("*\t0\t0\t77").alias("value"), F.col("n_regionkey").alias("sample"))).write.partitionBy("sample").text(path)
    files = S.idxstats(spark, path, n.filter("n_nationkey % 4 > 0").select(F.col("n_name").alias("chrom")))
    return files.groupBy(F.regexp_extract("file", "sample=([0-9]+)", 1).cast(n.schema["n_regionkey"].dataType).alias("sample")).agg(F.sum("mapped").alias("mapped"))


SPLITS = """s as (select n_name as species, cast(s_suppkey as varchar) as chrom, cast(s_suppkey % 5 as bigint) as fold from supplier join nation on s_nationkey = n_nationkey)"""


def splits(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_name").alias("species"), F.col("s_suppkey").cast("string").alias("chrom"), (F.col("s_suppkey") % 5).cast("long").alias("fold"))


@R.add("src_commented_csv", "with " + SPLITS + " select chrom, fold, 'tables of ' || species as made_by, cast(count(*) over (partition by species) as varchar) as n_chroms from s")
def _(spark, d):
    """Every species' split table, written with what it was made from in its head."""
    own = splits(spark, d)
    head = own.groupBy("species").agg(F.create_map(F.lit("made_by"), F.concat(F.lit("tables of "), "species"), F.lit("n_chroms"), F.count("*").cast("string")).alias("meta"))
    path = scratch(spark, "csv")
    W.commented_csv(own.join(head, "species"), "species", "meta", ["fold", "chrom"], path)
    return S.commented_csv(spark, path, "chrom string, fold long").select("chrom", "fold", F.col("meta")["made_by"].alias("made_by"), F.col("meta")["n_chroms"].alias("n_chroms"))


@R.add("src_metrics_json", "select 'run' || n_nationkey as run_name, 'pearson' as metric, n_nationkey / 10.0 as value from nation")
def _(spark, d):
    path = scratch(spark, "json")
    n = table(spark, d, "nation")
    n.select(F.concat(F.lit('{"run_name": "run'), F.col("n_nationkey").cast("string"), F.lit('", "genome_wide": {"pearson": '), (F.col("n_nationkey") / 10.0).cast("string"), F.lit("}}")).alias("value"), F.col("n_nationkey").alias("part")).write.partitionBy("part").text(path)
    return S.metrics_json(spark, path + "/*")


@R.add("src_stats_glob", """select 'e' || n_nationkey as experiment, cast(count(*) as varchar) as n_reads, case when n_nationkey % 2 = 0 then cast(count(*) filter (where c_acctbal > 0) as varchar) end as n_peaks
 from customer join nation on c_nationkey = n_nationkey where n_nationkey % 5 < 4 group by n_nationkey""")
def _(spark, d):
    """One table an experiment, in a folder of its name; one that isn't configured has another header and is left out."""
    path, key = scratch(spark, "stats"), F.col("c_nationkey")
    sums = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("string").alias("n"), F.count(F.when(F.col("c_acctbal") > 0, 1)).cast("string").alias("m"))
    row = F.concat_ws("\t", F.concat(F.lit("e"), key.cast("string")), "n", F.when(key % 2 == 0, F.col("m")).otherwise(""))
    body = F.when(key % 5 < 4, F.concat(F.lit("experiment\tn_reads\tn_peaks\n"), row)).otherwise("other\n1")
    sums.select(F.concat(F.lit("e"), key.cast("string")).alias("named"), body.alias("value")).write.partitionBy("named").text(path)
    configured = table(spark, d, "nation").filter("n_nationkey % 5 < 4").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment"))
    return S.stats_tables(spark, path, ["experiment", "n_reads", "n_peaks"], configured, F.regexp_extract("file", "named=([^/]*)", 1))


@R.add("src_md5_fetch", """with f as (select c_custkey as k, md5(c_name) as m, case when c_custkey % 5 = 0 then '' else md5(c_name) end as want from customer),
 h as (select *, k % 4 > 0 as here, case when k % 3 = 0 then md5('other') else m end as old, k % 7 > 0 as staged, case when k % 11 = 0 then md5('part') else m end as new from f)
 select 'f' || k as file, case when here and want = '' then 'kept' when here and old = want then 'ok' when not staged then 'FAILED' when want <> '' and new <> want then 'CORRUPT' else 'fetched' end as fetched,
   case when not here then 'missing' when want = '' then 'kept' when old = want then 'ok' else 'CORRUPT' end as verified, case when not here then 'would fetch' when want = '' then 'kept' else 'ok' end as planned from h""")
def _(spark, d):
    """Files on disk, staged files and their digests, under the three ways to run a transfer."""
    key, name = F.col("c_custkey"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file")
    c, digest = table(spark, d, "customer"), F.md5(F.col("c_name").cast("binary"))
    expected = c.select(name, F.when(key % 5 == 0, "").otherwise(digest).alias("md5"))
    have = c.filter("c_custkey % 4 > 0").select(name, F.when(key % 3 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(digest).alias("md5"))
    staged = c.filter("c_custkey % 7 > 0").select(name, F.when(key % 11 == 0, F.md5(F.lit("part").cast("binary"))).otherwise(digest).alias("md5"))
    out = [L.transfers(expected, have, staged, **{x: True for x in how}).withColumnRenamed("status", as_) for how, as_ in (((), "fetched"), (("verify_only",), "verified"), (("dry_run",), "planned"))]
    return out[0].join(out[1], "file").join(out[2], "file")


SIG = "sig as (select chrom, strand, case when strand='+' then start_pos else end_pos-1 end as pos, cast(count(*) as double) as value from aln where mapq >= 255 group by 1, 2, 3)"


def track_of(spark, d, strand):
    """The counts of a strand's 5' ends written as a track."""
    from siteline.operators.signal import five_prime

    path = scratch(spark, "track")
    signal = five_prime(view(spark, d, "aln").filter("mapq >= 255")).filter(F.col("strand") == strand)
    T.write(signal.select("chrom", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), "value"), view(spark, d, "sizes"), path)
    return T.read(spark, path)


@R.add("snk_bigwig", sql(SIG + " select cast(chrom as integer) as chrom, pos, value from sig where strand = '+'", "aln"))
def _(spark, d):
    return track_of(spark, d, "+").select(F.col("chrom").cast("int").alias("chrom"), F.col("start_pos").alias("pos"), "value")


@R.add("src_bigwig_intervals", sql(SIG + " select chrom, pos as start_pos, pos + 1 as end_pos, value from sig where chrom = '3' and strand = '-'", "aln"))
def _(spark, d):
    return track_of(spark, d, "-").filter("chrom = '3'")


@R.add("src_bigwig_region", sql(SIG + ", w as (select chrom, max(size) / 3 as low, max(size) / 2 as high from sizes group by 1 having chrom = '4') select sig.chrom, count(*) as n, sum(value) as total from sig join w on sig.chrom = w.chrom and pos + 1 > low and pos < high where strand = '+' group by 1", "aln", "sizes"))
def _(spark, d):
    """The intervals of one region of a track; only their blocks are read."""
    size = view(spark, d, "sizes").filter("chrom = '4'").first()["size"]
    own = track_of(spark, d, "+").filter((F.col("chrom") == "4") & (F.col("end_pos") > size / 3) & (F.col("start_pos") < size / 2))
    return own.groupBy("chrom").agg(count(), F.sum("value").alias("total"))


@R.add("src_bigwig_values", sql(SIG + ", g as (select p.peak_idx, p.chrom, unnest(range(p.start_pos, p.end_pos)) as pos from peaks p where start_pos < end_pos) select peak_idx, g.pos as pos, coalesce(value, 0) as value from g left join sig on sig.chrom = g.chrom and sig.pos = g.pos and sig.strand = '+'", "aln", "peaks"))
def _(spark, d):
    return T.values(track_of(spark, d, "+"), view(spark, d, "peaks"))


@R.add("snk_markdown", "select '| ' || s_suppkey || ' | ' || printf('%.1fM', s_nationkey * 100000 / 1e6) || ' |' as line from supplier")
def _(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 100000).alias("n_reads"))
    return W.markdown(t, {"s_suppkey": "supplier", "n_reads": "reads"})


@R.add("snk_per_locus_tsv", "select event_id, printf('%.6g', cast(user_id as double)) as users from events")
def _(spark, d):
    return W.per_locus(table(spark, d, "events").select("event_id", F.col("user_id").alias("users")), ["users"])


@R.add("snk_metrics_json", sql("m as (select experiment, fold, round(avg(profile_score), 2) as v from per_locus group by 1, 2) select experiment as run_name, length(string_agg(fold, ',' order by fold)) as n_chars from m group by 1", "per_locus").replace("length(string_agg(fold, ',' order by fold))", "count(*)").replace("n_chars", "n_folds"))
def _(spark, d):
    m = view(spark, d, "per_locus").groupBy(F.col("experiment").alias("run_name"), "fold").agg(F.round(F.avg("profile_score"), 2).alias("value")).withColumn("metric", F.lit("mean"))
    j = W.metrics_json(m)
    return j.select("run_name", F.size(F.map_keys(F.from_json(F.get_json_object("json", "$.per_fold"), "map<string, map<string, double>>"))).cast("long").alias("n_folds"))


@R.add("snk_stratum_beds", sql("select pclass as stratum, count(*) as n from peaks group by 1", "peaks"))
def _(spark, d):
    path = scratch(spark, "strata")
    W.strata(view(spark, d, "peaks").select(F.col("pclass").alias("stratum"), F.concat_ws("\t", "chrom", F.col("start_pos").cast("string")).alias("raw")), path)
    return spark.read.schema("value string, stratum string").text(path).groupBy("stratum").agg(count())


STATS = """st as (select s_suppkey as experiment, n_name as species, cast(s_suppkey % 101 as double) as pct_unique, case when s_suppkey % 4 = 0 then cast(s_suppkey % 60 as double) end as pct_rrna,
  (s_suppkey * 37) % 1000 as peaks_total, case when s_suppkey % 6 > 0 then cast((s_suppkey * 53) % 1400 as double) end as reads_per_peak from supplier join nation on s_nationkey = n_nationkey),
 pr as (select s_suppkey as experiment, concat_ws(',', case when s_suppkey % 11 = 0 then 'FAIL:dimer_run:r' || s_suppkey end, case when s_suppkey % 13 = 0 then 'FAIL:interleave_suspect:r' || s_suppkey end) as said from supplier)"""
FLAG = """ md as (select species, median(peaks_total) as med from st where peaks_total <> 0 group by 1 having count(*) >= 3),
 rt as (select *, case when pct_rrna < 100 then least(100.0, pct_unique / (1 - pct_rrna / 100)) end as adj from st),
 rb as (select *, coalesce(adj, pct_unique) as rate, case when adj is not null then 'adj' else 'raw' end as basis from rt),
 fl as (select experiment, round(adj, 1) as pct_unique_adj, concat_ws(',',
   case when rate < 25 then 'FAIL:very_low_mapping(' || cast(round_even(rate, 0) as bigint) || '%,' || basis || ')' when rate < 50 then 'WARN:low_mapping(' || cast(round_even(rate, 0) as bigint) || '%,' || basis || ')' end,
   case when reads_per_peak < 500 then 'WARN:thin_coverage(' || cast(round_even(reads_per_peak, 0) as bigint) || '/peak)' end,
   case when peaks_total <> 0 and peaks_total < 0.5 * med then 'WARN:peaks_below_species(' || peaks_total || 'v' || cast(round_even(med, 0) as bigint) || ')' end,
   nullif(said, '')) as qc_flags from rb left join md using (species) join pr using (experiment))"""


def stats(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    return s.select(
        key.alias("experiment"), F.col("n_name").alias("species"), (key % 101).cast("double").alias("pct_unique"), F.when(key % 4 == 0, (key % 60).cast("double")).alias("pct_rrna"),
        ((key * 37) % 1000).alias("peaks_total"), F.when(key % 6 > 0, ((key * 53) % 1400).cast("double")).alias("reads_per_peak"),
    )


def flagged(spark, d):
    """The flags of ``stats`` and of one surveyed file an experiment."""
    key = F.col("s_suppkey")
    survey = table(spark, d, "supplier").select(
        key.alias("experiment"), F.concat(F.lit("r"), key.cast("string")).alias("run"), F.lit("R1").alias("mate"), F.lit(10).alias("n_sampled"), F.when(key % 11 == 0, 17).otherwise(18).alias("median_insert"),
        F.lit(25.0).alias("pct_adapter"), F.lit("none").alias("best_adapter"), F.when(key % 13 == 0, "polyg").otherwise("").alias("interleave_suspect"), F.lit("no").alias("declared_interleaved"),
    )
    return C.flags(stats(spark, d), C.survey_flags(survey, survey.select("experiment", F.lit("").alias("adapter"))))


@R.add("qc_flags", "with " + STATS + "," + FLAG + " select experiment, pct_unique_adj, qc_flags from fl")
def _(spark, d):
    return flagged(spark, d)


@R.add("qc_flag_report", "with " + STATS + "," + FLAG + " select case when qc_flags like '%FAIL%' then 'FAIL' when qc_flags <> '' then 'WARN' else 'ok' end as severity, count(*) as n from fl group by 1")
def _(spark, d):
    return C.flag_report(flagged(spark, d))


@R.add("orc_stats_all", "with " + STATS + "," + FLAG + " select experiment, species, qc_flags from fl join st using (experiment)")
def _(spark, d):
    return stats(spark, d).select("experiment", "species").join(flagged(spark, d).select("experiment", "qc_flags"), "experiment")


PROBES = {"first": "TTA", "second": "GAA"}


def survey(spark, d):
    return C.read_survey(view(spark, d, "seqs"), PROBES, "GGGG")


SURVEY = """pb as (select run, mate, seq, length(seq) as l, instr(seq, 'TTA') - 1 as p1, instr(seq, 'GAA') - 1 as p2 from seqs where seq is not null),
 rl as (select run, mate, l as read_len from (select run, mate, l, count(*) as n from pb group by 1, 2, 3) qualify row_number() over (partition by run, mate order by n desc, l) = 1),
 fs as (select run, mate, count(*) as n_sampled, count(*) filter (p1 >= 0) as h1, count(*) filter (p2 >= 0) as h2, count(*) filter (contains(seq, 'N')) as an, count(*) filter (contains(seq, 'GGGG')) as pg from pb group by 1, 2),
 bs as (select *, case when h1 + h2 = 0 then 'none' when h1 >= h2 then 'first' else 'second' end as best_adapter from fs),
 ip as (select pb.run, pb.mate, read_len, case best_adapter when 'first' then p1 when 'second' then p2 else -1 end as pos from pb join bs on pb.run = bs.run and pb.mate = bs.mate join rl on rl.run = pb.run and rl.mate = pb.mate),
 im as (select run, mate, count(*) as h, cast(list_sort(list(pos))[count(*) // 2 + 1] as bigint) as median_insert, count(*) filter (pos < 0.66 * read_len) as short from ip where pos >= 0 group by 1, 2),
 np as (select run, mate, i, count(*) as c from (select run, mate, seq, unnest(range(1, l + 1)) as i from pb where contains(seq, 'N')) where substr(seq, i, 1) = 'N' group by 1, 2, 3),
 dd as (select np.run, np.mate, string_agg(i, ',' order by i) as dead from np join fs on fs.run = np.run and fs.mate = np.mate where c >= 0.2 * n_sampled group by 1, 2),
 sv as (select bs.run, bs.mate, n_sampled, read_len, best_adapter, 100.0 * coalesce(h, 0) / n_sampled as pct_adapter, median_insert, 100.0 * coalesce(short, 0) / n_sampled as pct_short_untrimmed,
   coalesce(dead, '-') as dead_cycles, 100.0 * an / n_sampled as pct_any_n, 100.0 * pg / n_sampled as pct_polyg
   from bs join rl on rl.run = bs.run and rl.mate = bs.mate left join im on im.run = bs.run and im.mate = bs.mate left join dd on dd.run = bs.run and dd.mate = bs.mate)"""
_ROUNDED = ["pct_adapter", "pct_short_untrimmed", "pct_any_n", "pct_polyg"]
PROJECT = """, pj as (select run, case mate when 'en' then 'R1' else 'R2' end as mate, right(run, 1) as project, run like '%1%' as paired, n_sampled, read_len, pct_polyg, median_insert, pct_adapter, best_adapter from sv),
 pm as (select a.run, a.mate, median(b.read_len) as m from pj a join pj b on a.project = b.project and a.run <> b.run group by 1, 2),
 sp as (select pj.*, case when pj.mate = 'R1' and not paired then concat_ws(',', case when pct_polyg >= 5 then 'polyg' end, case when read_len >= 2.0 * m then 'long_for_project' end) else '' end as suspect from pj left join pm on pm.run = pj.run and pm.mate = pj.mate)"""


def screened(spark, d):
    s = survey(spark, d).withColumns({"mate": F.when(F.col("mate") == "en", "R1").otherwise("R2"), "project": F.right("run", F.lit(1)), "paired": F.col("run").contains("1")})
    return C.interleave_suspect(s)


@R.add("qc_read_survey", sql(SURVEY + " select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _ROUNDED) + ") from sv", "seqs"))
def _(spark, d):
    return survey(spark, d).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@R.add("qc_interleave_screen", sql(SURVEY + PROJECT + " select run, mate, read_len, suspect as interleave_suspect from sp", "seqs"))
def _(spark, d):
    return screened(spark, d).select("run", "mate", "read_len", "interleave_suspect")


@R.add("qc_survey_flags", sql(SURVEY + PROJECT + """, r1 as (select right(run, 1) as experiment, * from sp where mate = 'R1'),
 wr as (select experiment, best_adapter, count(*) as n from r1 where best_adapter not in ('none', 'second') and pct_adapter >= 50 group by 1, 2)
 select experiment, concat_ws(';', nullif('dimer_run:' || coalesce(string_agg(distinct run, '/' order by run) filter (median_insert < 18 and pct_adapter >= 25), ''), 'dimer_run:'),
   nullif('interleave_suspect:' || coalesce(string_agg(distinct run, '/' order by run) filter (suspect <> ''), ''), 'interleave_suspect:'),
   (select 'adapter_mismatch(config=second,reads=' || best_adapter || ')' from wr where wr.experiment = r1.experiment order by n desc, best_adapter limit 1)) as problems from r1 group by 1""", "seqs"))
def _(spark, d):
    s = screened(spark, d).withColumns({"experiment": F.right("run", F.lit(1)), "declared_interleaved": F.lit("no")})
    configured = s.select("experiment", F.lit("second").alias("adapter")).distinct()
    return C.survey_flags(s, configured).select("experiment", F.array_join("problems", ";").alias("problems"))


@R.add("qc_umi_verdict", """with f as (select c_custkey as run, unnest([1, 2]) as mate, c_custkey % 9 as umi, c_custkey % 4 > 0 as paired, case when c_custkey % 5 = 0 then 'read2' else 'read1' end as place, c_custkey % 7 as seen from customer),
 e as (select run, mate, case when umi > 0 and mate = case when not paired then 1 when place = 'read2' then 2 else 1 end then umi else 0 end as expected, case when (run + mate) % 6 > 0 then case when mate = 1 then seen else 0 end end as detected from f)
 select run, cast(mate as bigint) as mate, expected, detected, case when detected is null then null when expected = 0 and detected = 0 then 'none' when expected = 0 then 'undeclared' when expected = detected then 'match' else 'MISMATCH' end as verdict from e""")
def _(spark, d):
    key = F.col("c_custkey")
    c = table(spark, d, "customer").select(key.alias("run"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("mate"))
    files = c.withColumn("detected", F.when((F.col("run") + F.col("mate")) % 6 > 0, F.when(F.col("mate") == 1, F.col("run") % 7).otherwise(0)))
    declared = table(spark, d, "customer").select(key.alias("run"), (key % 9).alias("umi_len"), (key % 4 > 0).alias("paired"), F.when(key % 5 == 0, "read2").otherwise("read1").alias("place"))
    return C.umi_report(files, declared)


#: References by language: all three classes, without rRNA for es, none for fr.  Reads are cut where either adapter begins.
KM = """rf as (select lang as index, seq, ['rrna_35s', 'rrna_5s', 'organellar'][doc_id % 3 + 1] as class, doc_id % 3 as priority from sl where length(seq) >= 20 and lang <> 'fr' and (lang <> 'es' or doc_id % 3 = 2)),
 bt as (select * from rf union all select index, reverse(translate(seq, 'ACGTN', 'TGCAN')), class, priority from rf),
 kn as (select index, kmer, arg_min(class, priority) as class from (select index, substr(seq, i, 20) as kmer, class, priority from (select index, seq, class, priority, unnest(range(1, length(seq) - 18)) as i from bt)) group by 1, 2),
 ip as (select doc_id, run, lang, seq, least(case when instr(seq, 'TTAGA') > 0 then instr(seq, 'TTAGA') else 1000000000 end, case when instr(seq, 'GAATC') > 0 then instr(seq, 'GAATC') else 1000000000 end) as p from sl),
 rd as (select doc_id as read, run || '/' || lang as experiment, lang as index, substr(seq, 1, p - 1) as seq from ip where least(length(seq), p - 1) >= 20),
 ht as (select read, arg_min(class, i) as class from (select read, index, i, substr(seq, i, 20) as kmer from (select read, index, seq, unnest(range(1, length(seq) - 18)) as i from rd)) join kn using (index, kmer) group by 1)"""
SL = "sl as (select doc_id, run, mate as lang, seq from seqs)"


def rrna_parts(spark, d):
    """experiments, inserts and references of the reads of every document."""
    s = view(spark, d, "seqs").select("doc_id", "run", F.col("mate").alias("lang"), "seq")
    kind = F.element_at(F.array(F.lit("rrna_35s"), F.lit("rrna_5s"), F.lit("organellar")), (F.col("doc_id") % 3 + 1).cast("int"))
    ref = s.filter("length(seq) >= 20 and lang <> 'fr' and (lang <> 'es' or doc_id % 3 = 2)").select(F.col("lang").alias("index"), "seq", kind.alias("class"), (F.col("doc_id") % 3).alias("priority"))
    inserts = s.select(F.concat_ws("/", "run", "lang").alias("experiment"), F.col("doc_id").alias("read"), F.col("lang").alias("index"), Q.trim_insert(F.col("seq"), ["TTAGA", "GAATC"]).alias("seq"))
    return inserts.select("experiment", "index").distinct(), inserts, ref


LOOKUP = """rf as (select seq, case when doc_id % 2 = 0 then '35s' else '5s' end as class, doc_id % 2 as priority from seqs where length(seq) >= 20),
 bt as (select * from rf union all select reverse(translate(seq, 'ACGTN', 'TGCAN')), class, priority from rf),
 kn as (select kmer, arg_min(class, priority) as class from (select substr(seq, i, 20) as kmer, class, priority from (select seq, class, priority, unnest(range(1, length(seq) - 18)) as i from bt)) group by 1),
 rd as (select doc_id as read, seq from seqs where length(seq) >= 20),
 ht as (select read, arg_min(class, i) as class from (select read, i, substr(seq, i, 20) as kmer from (select read, seq, unnest(range(1, length(seq) - 18)) as i from rd)) join kn using (kmer) group by 1)"""


@R.add("join_sequence_lookup", sql(LOOKUP + " select read, class from rd left join ht using (read)", "seqs"))
def _(spark, d):
    s = view(spark, d, "seqs").filter("length(seq) >= 20")
    ref = s.select("seq", F.when(F.col("doc_id") % 2 == 0, "35s").otherwise("5s").alias("class"), (F.col("doc_id") % 2).alias("priority"))
    return C.classify_reads(s.select(F.col("doc_id").alias("read"), "seq"), ref, 20)


@R.add("qc_rrna_content", sql(SL + ", " + KM + """, ex as (select distinct run || '/' || lang as experiment, lang as index from sl), ix as (select index, bool_or(class <> 'organellar') as has from rf group by 1),
 ct as (select experiment, count(*) as n, count(*) filter (class = 'rrna_35s') as a, count(*) filter (class = 'rrna_5s') as b, count(*) filter (class = 'organellar') as c from rd join ix using (index) left join ht using (read) group by 1)
 select experiment, coalesce(n, 0) as n_scored, case when n > 0 then case when has then 'yes' else 'no' end end as rrna_indexed, round(100.0 * a / n, 2) as pct_rrna_35s, round(100.0 * b / n, 2) as pct_rrna_5s, round(100.0 * c / n, 2) as pct_organellar, round(100.0 * (a + b + c) / n, 2) as pct_rrna_total
 from ex left join ix using (index) left join ct using (experiment)""", "seqs"))
def _(spark, d):
    experiments, inserts, ref = rrna_parts(spark, d)
    return C.rrna_content(experiments, inserts.drop("index"), ref, 20)


@R.add("qc_verify_genome", """with f as (select n_name as species, s_suppkey % 5 as fold, cast(s_suppkey as varchar) as chrom, s_suppkey as k, n_nationkey as s from supplier join nation on s_nationkey = n_nationkey),
 fo as (select species, fold, chrom from f where k % 11 > 0 union all select species, fold + 1, chrom from f where k % 13 = 0 and k % 11 > 0),
 ma as (select species, chrom from f where s % 6 > 0 and k % 7 > 0), co as (select species, chrom from f where s % 4 > 0 and k % 9 > 0), si as (select species, chrom from f where s % 4 > 1 and k % 8 > 0),
 kn as (select distinct species from fo where species in (select species from ma)), me as (select distinct species, chrom from fo where species in (select species from kn)), mk as (select * from ma where species in (select species from kn))
 select distinct species, cast(null as varchar) as chrom, 'no genome' as problem from fo where species not in (select species from kn)
 union all select species, chrom, 'in several folds' from fo where species in (select species from kn) group by 1, 2 having count(*) > 1
 union all select species, chrom, 'not a main chromosome' from me where (species, chrom) not in (select species, chrom from ma) union all select species, chrom, 'in no fold' from mk where (species, chrom) not in (select species, chrom from me)
 union all select species, chrom, 'not in the index' from me where species in (select species from co) and (species, chrom) not in (select species, chrom from co)
 union all select species, chrom, 'not in the sizes' from mk where species in (select species from si) and (species, chrom) not in (select species, chrom from si)
 union all select species, chrom, 'in the sizes but not main' from si where species in (select species from kn) and (species, chrom) not in (select species, chrom from ma)
 union all select species, null, 'not checked' from kn where species not in (select species from co) and species not in (select species from si)""")
def _(spark, d):
    """Folds of each species' chromosomes against the main ones, the index and the size table, each short of some."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    f = s.select(F.col("n_name").alias("species"), (F.col("s_suppkey") % 5).alias("fold"), F.col("s_suppkey").alias("chrom"), F.col("s_suppkey").alias("k"), F.col("n_nationkey").alias("s"))
    own = f.filter("k % 11 > 0")
    folds = own.select("species", "fold", "chrom").unionByName(own.filter("k % 13 = 0").select("species", (F.col("fold") + 1).alias("fold"), "chrom"))
    return J.verify_folds(folds, f.filter("s % 6 > 0 and k % 7 > 0"), f.filter("s % 4 > 0 and k % 9 > 0"), f.filter("s % 4 > 1 and k % 8 > 0"))


@R.add("qc_resolution_basis", "with s as (select distinct p_brand as name, p_size as sample from part), n as (select name, count(distinct sample) as n from s group by 1) select name, sample, case when n = 1 then 'unique' else 'AMBIGUOUS' end as basis from s join n using (name)")
def _(spark, d):
    return C.resolution_basis(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("sample")).distinct())


@R.add("orc_targets", sql("select experiment, case when depth < 0 then 'no runs' else 'ready' end as state from experiments where taxon <> 2", "experiments"))
def _(spark, d):
    return view(spark, d, "experiments").filter("taxon <> 2").select("experiment", F.when(F.col("depth") < 0, "no runs").otherwise("ready").alias("state"))


@R.add("orc_two_level_grouping", "select o_custkey as experiment, o_orderkey as sample, count(l_linenumber) as n_runs from (select distinct o_custkey, o_orderkey from orders) left join lineitem on l_orderkey = o_orderkey group by 1, 2")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("sample")).distinct()
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), "l_linenumber"), "sample", "left").groupBy("experiment", "sample").agg(F.count("l_linenumber").alias("n_runs"))


@R.add("orc_job_enumeration", sql("""e as (select experiment, case when experiment % 17 > 0 then experiment % 4 + 2 end as n_folds, depth < 0 as lacking from experiments),
 j as (select experiment, unnest(range(0, n_folds)) as fold, lacking from e where n_folds > 0)
 select reason, count(*) as n, cast(sum(coalesce(fold, 0)) as bigint) as folds from (select experiment, fold, case when lacking then 'missing data' when (experiment + fold) % 4 = 0 then 'trained' else 'run' end as reason from j
   union all select experiment, null, 'unusable' from e where n_folds is null) group by 1""", "experiments"))
def _(spark, d):
    e = view(spark, d, "experiments")
    plan = e.select("experiment", F.when(F.col("experiment") % 17 > 0, F.col("experiment") % 4 + 2).alias("n_folds"))
    trained = e.select("experiment", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("fold")).filter("(experiment + fold) % 4 = 0")
    return J.job_plan(plan, e.filter("depth < 0"), trained).groupBy("reason").agg(count(), F.sum(F.coalesce("fold", F.lit(0))).alias("folds"))


@R.add("orc_missing_inputs", sql("""i as (select experiment, unnest(['peaks', 'sequences', 'gc_negatives', 'signals', 'signals', 'controls']) as kind, unnest([0, 0, 0, 0, 1, 0]) as place, unnest([0, 1, 2, 3, 4, 5]) as r from experiments),
 p as (select *, case when not (kind = 'gc_negatives' and experiment % 3 = 0) then kind || '/' || experiment || '/' || place end as path from i),
 m as (select *, case when kind in ('signals', 'controls') then kind || '[' || place || ']' else kind end || ': ' || coalesce(path, 'none') as said from p where path is null or (experiment + r) % 5 = 0)
 select experiment, coalesce(a.missing, '') as missing, coalesce(b.missing, '') as missing_for_qc from experiments left join (select experiment, string_agg(said, '; ' order by r) as missing from m group by 1) a using (experiment)
   left join (select experiment, string_agg(said, '; ' order by r) as missing from m where kind in ('peaks', 'sequences', 'signals') group by 1) b using (experiment)""", "experiments"))
def _(spark, d):
    kinds = [("peaks", 0), ("sequences", 0), ("gc_negatives", 0), ("signals", 0), ("signals", 1), ("controls", 0)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("place"), F.lit(r).alias("r")) for r, (k, p) in enumerate(kinds)))).alias("i")
    named = view(spark, d, "experiments").select("experiment", each).select("experiment", "i.*")
    path = F.when(~((F.col("kind") == "gc_negatives") & (F.col("experiment") % 3 == 0)), F.concat_ws("/", "kind", F.col("experiment").cast("string"), F.col("place").cast("string")))
    inputs = named.withColumn("path", path)
    there = inputs.filter("(experiment + r) % 5 <> 0")
    whole, qc = J.missing_inputs(inputs, there), J.missing_inputs(inputs, there, J.QC_INPUTS)
    return whole.select("experiment", F.array_join("missing", "; ").alias("missing")).join(qc.select("experiment", F.array_join("missing", "; ").alias("missing_for_qc")), "experiment")


@R.add("orc_paths", sql("""select experiment, 'models/bp/' || experiment || '_ctl' as model_dir, 'models/bp/' || experiment || '_ctl/' || experiment || '.fold2' as model_name, 'models/bp/' || experiment || '_ctl/' || experiment || '.fold2.torch' as model_path,
 'models/bp/' || experiment || '_ctl/' || experiment || '.fold2.final.torch' as final_path, 'attributions/' || experiment || '_filtered.bed' as filtered_loci, 'attributions/' || experiment || '_ohe.npz' as onehot, 'benchmarks/bp/' || experiment || '.json' as metrics from experiments""", "experiments"))
def _(spark, d):
    paths = J.artifact_paths(F.col("experiment"), F.lit("bp"), F.lit(2), F.lit("_ctl"))
    return view(spark, d, "experiments").select("experiment", *(c.alias(k) for k, c in paths.items()))


@R.add("orc_motif_db", sql("""g as (select distinct species, ['vertebrates', 'insects', 'nematodes', 'fungi', 'plants'][taxon + 1] as collection from experiments),
 f as (select distinct 'JASPAR2026_CORE_' || collection || '_non-redundant_pfms_meme.txt' as file from experiments join g using (species) where depth > 0) select 'motifs/' || file as path, 'https://example.org/download/JASPAR2026/CORE/' || file as url from f""", "experiments"))
def _(spark, d):
    """The databases that species with data need; several species share a collection's file."""
    e = view(spark, d, "experiments")
    collections = F.array(*(F.lit(x) for x in ("vertebrates", "insects", "nematodes", "fungi", "plants")))
    genomes = e.select("species", F.get(collections, F.col("taxon").cast("int")).alias("collection")).distinct()
    return J.motif_databases(e.filter("depth > 0"), genomes, "motifs", "https://example.org/download")


@R.add("prj_split_rows", "with " + SPLITS + " select species, chrom, fold, row_number() over (partition by species order by fold, chrom) - 1 as place from s")
def _(spark, d):
    """Every species' record of folds, a JSON object of lists, as rows in the order of its table."""
    lists = splits(spark, d).groupBy("species", "fold").agg(F.array_sort(F.collect_list("chrom")).alias("c"))
    record = lists.groupBy("species").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("fold").cast("string").alias("k"), "c")))).alias("folds"))  # a species' record
    return K.split_rows(record.select("species", F.from_json("folds", "map<string, array<string>>").alias("folds")), ["species"])


@R.add("prj_experiment_key", "select c_custkey, concat_ws('|', c_name, cast(c_nationkey as varchar), case when c_nationkey in (1, 2) then c_mktsegment end) as key from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey").isin(1, 2), F.col("c_mktsegment"))).alias("key"))


@R.add("prj_first_nonempty_ids", "select c_custkey, case when c_custkey % 2 = 0 then c_name else c_mktsegment end as id from customer")
def _(spark, d):
    ids = F.filter(F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), F.col("c_mktsegment")), lambda x: x != "")
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(ids, F.lit(1)).alias("id"))


@R.add("prj_provenance", "select r_regionkey, 'r=' || r_name || ';k=' || r_regionkey as provenance from region")
def _(spark, d):
    m = F.create_map(F.lit("r"), "r_name", F.lit("k"), F.col("r_regionkey").cast("string"))
    return table(spark, d, "region").select("r_regionkey", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("provenance"))


@R.add("prj_decoys", "select n_nationkey, case when n_regionkey > 1 then 'rdna,' else '' end || 'mito,plastid' as decoys from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.array_compact(F.array(F.when(F.col("n_regionkey") > 1, "rdna"), F.lit("mito"), F.lit("plastid"))), ",").alias("decoys"))


@R.add("prj_annotation_path", "select n_nationkey, case when n_regionkey <> 0 then 'data/' || n_name || '.gtf' end as path from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 0, F.concat(F.lit("data/"), "n_name", F.lit(".gtf"))).alias("path"))


@R.add("prj_is_paired", "select o_orderkey, o_orderstatus = 'F' as on_disk, o_orderstatus = 'F' or o_shippriority = 1 or o_orderkey % 5 = 0 as processed from orders".replace("o_shippriority = 1 or ", ""))
def _(spark, d):
    deposited = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select("o_orderkey", deposited.alias("on_disk"), (deposited | (F.col("o_orderkey") % 5 == 0)).alias("processed"))


@R.add("prj_blacklist_targets", sql("select distinct 'data/' || species || '.bed' as target from experiments where depth > 0", "experiments"))
def _(spark, d):
    return view(spark, d, "experiments").filter("depth > 0").select(F.concat(F.lit("data/"), "species", F.lit(".bed")).alias("target")).distinct()


@R.add("prj_experiment_load", sql("""p as (select experiment, species, depth, 'data/' || experiment as root from experiments)
 select experiment, species, root || '.bed.gz' as peaks, [root || '_pl.bw', root || '_mn.bw'] as signals, case when taxon_ok then 'genome/' || species || '.fa' end as sequences, case when depth > 0 then root || '_neg.bed' end as negatives, [root || '_pl_c.bw', root || '_mn_c.bw'] as controls, case when depth > 3000 then ['lists/' || species || '.bed'] end as blacklist
 from (select *, experiment % 5 > 0 as taxon_ok from p)""", "experiments"))
def _(spark, d):
    at, sp = F.concat(F.lit("data/"), F.col("experiment").cast("string")), F.col("species")
    held = {
        "peaks": F.concat(at, F.lit(".bed.gz")), "pl_bigwig": F.concat(at, F.lit("_pl.bw")), "mn_bigwig": F.concat(at, F.lit("_mn.bw")), "sequences": F.when(F.col("experiment") % 5 > 0, F.concat(F.lit("genome/"), sp, F.lit(".fa"))),
        "gc_negatives": F.when(F.col("depth") > 0, F.concat(at, F.lit("_neg.bed"))), "pl_control": F.concat(at, F.lit("_pl_c.bw")), "mn_control": F.concat(at, F.lit("_mn_c.bw")), "blacklist": F.when(F.col("depth") > 3000, F.concat(F.lit("lists/"), sp, F.lit(".bed"))).otherwise(""),
    }
    entries = view(spark, d, "experiments").select("experiment", "species", F.create_map(*(x for k, v in held.items() for x in (F.lit(k), v))).alias("processed"))
    return J.load_experiments(entries, use_controls=True)


@R.add("fn_uses_peak_folds", sql("""t as (select distinct species, experiment % 6 as fold from experiments where species in (select n_name from nation where n_regionkey < 2)),
 c as (select distinct species, experiment % 4 as fold from experiments)
 select species, n.n is not null as peak_level, coalesce(n.n, m.n) as n_folds from (select distinct species from experiments) s left join (select species, count(distinct fold) as n from t group by 1) n using (species) left join (select species, count(distinct fold) as n from c group by 1) m using (species)""", "experiments"))
def _(spark, d):
    """Tables of peaks' folds exist for the species of two regions: those in the folder are all there are."""
    e = view(spark, d, "experiments")
    path = scratch(spark, "folds")
    e.filter("taxon < 2").select("species", (F.col("experiment") % 6).alias("fold")).distinct().write.partitionBy("species").csv(path)
    tables = spark.read.schema("fold long, species string").csv(path)
    return J.fold_mechanism(e, tables, e.select("species", (F.col("experiment") % 4).alias("fold")))


@R.add("src_ena_http", "select 'SRR' || c_custkey as run_accession, c_name as sample from customer where c_custkey % 10 = 0")
def _(spark, d):
    """Accession look-ups from a cached table: there is no network."""
    path = scratch(spark, "cache")
    t = table(spark, d, "customer").select(F.concat(F.lit("SRR"), F.col("c_custkey").cast("string")).alias("run_accession"), F.col("c_name").alias("sample"))
    W.tsv(t, path, ["run_accession", "sample"])
    wanted = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.concat(F.lit("SRR"), F.col("c_custkey").cast("string")).alias("run_accession"))
    return S.tsv(spark, path, ["run_accession", "sample"]).join(wanted, "run_accession", "left_semi")


@R.add("src_npz", "select n_regionkey || '.npz' as file, 'keys' as name, count(*) as n, cast(sum(n_nationkey) as double) as total from nation group by 1 union all select n_regionkey || '.npz', 'pairs', 2 * count(*), cast(sum(n_nationkey + length(n_name)) as double) from nation group by 1")
def _(spark, d):
    """An archive a region, of two arrays."""
    path, held = scratch(spark, "npz"), {}
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 nations
        held.setdefault(r["n_regionkey"], []).append((r["n_nationkey"], len(r["n_name"])))
    for region, rows in held.items():
        buffer = io.BytesIO()
        np.savez_compressed(buffer, keys=np.array([k for k, _ in rows]), pairs=np.array(rows, np.float32), label=np.array(["x"]))
        W.put_bytes(spark, buffer.getvalue(), f"{path}/{region}.npz")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return S.npz(spark, path).select("file", "name", F.size("values").cast("long").alias("n"), total.alias("total"))


@R.add("snk_npz", "select vec_id, cast(len(embedding) as bigint) as n, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings")
def _(spark, d):
    path = scratch(spark, "arrays")
    table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return spark.read.schema("vec_id long, embedding array<float>").parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"))


@R.add("snk_yaml_tsv", sql("select cast(experiment as varchar) as experiment, species from experiments", "experiments"))
def _(spark, d):
    path = scratch(spark, "config")
    e = view(spark, d, "experiments").select(F.to_json(F.struct(F.col("experiment").cast("string").alias("experiment"), "species")).alias("value"))
    e.write.text(path)
    return spark.read.schema("experiment string, species string").json(path)


@R.add("snk_plots", sql("select cast(floor(profile_score / 100) as bigint) as bar, count(*) as n from per_locus group by 1", "per_locus"))
def _(spark, d):
    """The table behind a histogram; drawing is left to a plotting tool."""
    return view(spark, d, "per_locus").groupBy(F.floor(F.col("profile_score") / 100).alias("bar")).agg(count())


@R.add("ml_interleave_sampler", sql("select peak_idx, case when peak_idx % 8 = 7 then 'negative' else 'peak' end as kind, (peak_idx * 2654435761) % 401 - 200 as jitter, (peak_idx * 40503) % 2 = 1 as reverse from peaks", "peaks"))
def _(spark, d):
    """One pass of peaks with every eighth place a negative, jitter and strand drawn from the index."""
    i = F.col("peak_idx")
    return view(spark, d, "peaks").select("peak_idx", F.when(i % 8 == 7, "negative").otherwise("peak").alias("kind"), ((i * 2654435761) % 401 - 200).alias("jitter"), ((i * 40503) % 2 == 1).alias("reverse"))


@R.add("orc_emit", sql("select experiment, 'fit --experiment ' || experiment || ' --fold 0' as command from experiments where depth >= 0", "experiments"))
def _(spark, d):
    return view(spark, d, "experiments").filter("depth >= 0").select("experiment", F.concat(F.lit("fit --experiment "), F.col("experiment").cast("string"), F.lit(" --fold 0")).alias("command"))


@R.add("orc_rule_targets", sql("""own as (select * from (values ('all', '', '_pl.bw'), ('all', '', '_mn.bw'), ('all', '', '_peaks.bed.gz'), ('all', 'orientation/', '.tsv'), ('all', 'umi/', '.tsv'), ('all', 'rrna/', '.tsv'), ('all', 'reads/', '.tsv'),
  ('qc', 'orientation/', '.tsv'), ('qc', 'umi/', '.tsv'), ('qc', 'rrna/', '.tsv'), ('qc', 'reads/', '.tsv'), ('orientation', 'orientation/', '.tsv'), ('orientation', 'orientation/', '.orientation_qc.png'), ('signal_only', '', '_pl.bw'), ('signal_only', '', '_mn.bw')) t(rule, a, b)),
 b as (select distinct 'data/' || species || '.bed' as target from experiments where depth > 0)
 select rule, a || experiment || b as target from experiments, own union all select * from (values ('all', 'stats/experiment_stats.tsv'), ('qc', 'stats/experiment_stats.tsv'), ('stats', 'stats/experiment_stats.tsv'), ('stats', 'stats/experiment_stats.md'))
 union all select unnest(['all', 'fetch_only', 'blacklists']), target from b union all select 'fetch_only', 'genome/' || species || '.fa' from (select distinct species from experiments) union all select 'fetch_only', 'fastq/' || experiment || '_' || unnest([1, 2]) || '.fastq.gz' from experiments""", "experiments"))
def _(spark, d):
    e = view(spark, d, "experiments")
    lists = e.filter("depth > 0").select(F.concat(F.lit("data/"), "species", F.lit(".bed")).alias("target"))
    reads = e.select(F.explode(F.array(*(F.concat(F.lit("fastq/"), F.col("experiment").cast("string"), F.lit(f"_{k}.fastq.gz")) for k in (1, 2)))).alias("target"))
    return J.rule_targets(e, lists, reads.unionByName(e.select(F.concat(F.lit("genome/"), "species", F.lit(".fa")).alias("target"))))


@R.add("orc_qc_rules", "with " + STATS + "," + FLAG + " select species, count(*) as n, count(*) filter (where qc_flags <> '') as n_flagged from fl join st using (experiment) group by 1")
def _(spark, d):
    s = stats(spark, d).select("experiment", "species").join(flagged(spark, d), "experiment")
    return s.groupBy("species").agg(count(), F.count(F.when(F.col("qc_flags") != "", 1)).alias("n_flagged"))
