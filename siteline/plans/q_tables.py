"""Queries of filters, projections, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteline.functions import text as X
from siteline.operators import compare as C
from siteline.operators import prefix, qc
from siteline.operators import relational as L
from siteline.plans.proxies import sql, table, view
from siteline.plans.registry import Registry

R = Registry()
count = lambda: F.count("*").alias("n")


@R.add("flt_main_chrom", sql("select peak_idx, chrom, start_pos, end_pos from peaks where chrom in ('1', '3', '5')", "peaks"))
def _(spark, d):
    allowed = spark.createDataFrame([(1,), (3,), (5,)], "chrom int")
    return L.keep(view(spark, d, "peaks"), allowed, "chrom").select("peak_idx", "chrom", "start_pos", "end_pos")


@R.add("join_semi_isin", sql("select chrom, count(*) as n from tss where chrom in (select chrom from folds where fold = 1) group by 1", "tss", "folds"))
def _(spark, d):
    return L.keep(view(spark, d, "tss"), view(spark, d, "folds").filter("fold = 1"), "chrom").groupBy("chrom").agg(count())


@R.add("flt_mapq", sql("select strand, count(*) as n from aln where mapq >= 255 group by 1", "aln"))
def _(spark, d):
    return view(spark, d, "aln").filter("mapq >= 255").groupBy("strand").agg(count())


@R.add("flt_mate_flag", sql("select sample, count(*) as n from aln where (sample > 3) or (flag & 64) <> 0 group by 1", "aln"))
def _(spark, d):
    paired = F.col("sample") <= 3
    return view(spark, d, "aln").filter(F.when(paired, F.col("flag").bitwiseAND(64) != 0).otherwise(True)).groupBy("sample").agg(count())


@R.add("flt_fold", sql("select peak_idx, fold from peaks join folds using (chrom) where fold in (0, 2)", "peaks", "folds"))
def _(spark, d):
    return view(spark, d, "peaks").join(view(spark, d, "folds").filter("fold in (0, 2)"), "chrom").select("peak_idx", "fold")


@R.add("flt_select_experiments", sql("""select experiment, species, case when depth < 0 then 'no runs' when taxon = 0 then 'bundled' end as skipped from experiments where species like 'C%' or experiment in (1, 2, 3)""", "experiments"))
def _(spark, d):
    why = F.when(F.col("depth") < 0, "no runs").when(F.col("taxon") == 0, "bundled")
    return view(spark, d, "experiments").filter(F.col("species").startswith("C") | F.col("experiment").isin(1, 2, 3)).select("experiment", "species", why.alias("skipped"))


@R.add("flt_dropna_subset", "select o.o_orderkey, l.toxic from (select distinct o_orderkey from orders) o left join labels l on l.doc_id = o.o_orderkey where l.toxic is not null")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey").distinct().join(table(spark, d, "labels"), F.col("o_orderkey") == F.col("doc_id"), "left").dropna(subset=["toxic"]).select("o_orderkey", "toxic")


@R.add("flt_signal_mode", sql("""select experiment, case when taxon = 0 then false when taxon = 1 then true else depth >= 1000 end as flag,
 case when taxon = 0 then 'off' when taxon = 1 then 'on' when depth >= 1000 then 'auto: deep' else 'auto: shallow' end as why from experiments""", "experiments"))
def _(spark, d):
    deep = F.col("depth") >= 1000
    flag = F.when(F.col("taxon") == 0, False).when(F.col("taxon") == 1, True).otherwise(deep)
    why = F.when(F.col("taxon") == 0, "off").when(F.col("taxon") == 1, "on").when(deep, "auto: deep").otherwise("auto: shallow")
    return view(spark, d, "experiments").select("experiment", flag.alias("flag"), why.alias("why"))


@R.add("prj_required_columns", "select region.r_regionkey, region.r_name from region")
def _(spark, d):
    return L.require_columns(table(spark, d, "region"), ["r_regionkey", "r_name"]).select("r_regionkey", "r_name")


AB = "a as (select experiment, fold, round(avg(profile_score), 9) as score from per_locus where event_id % 2 = 0 group by 1, 2), b as (select experiment, fold, round(avg(profile_score), 9) as score from per_locus where event_id % 2 = 1 group by 1, 2)"


def ab(spark, d):
    p = view(spark, d, "per_locus")
    return [p.filter(f"event_id % 2 = {k}").groupBy("experiment", "fold").agg(F.round(F.avg("profile_score"), 9).alias("score")) for k in (0, 1)]


@R.add("join_inner_metrics", sql(AB + " select experiment, fold, round(a.score, 6) as score_a, round(b.score, 6) as score_b, round(a.score - b.score, 6) as delta from a join b using (experiment, fold)", "per_locus"))
def _(spark, d):
    a, b = ab(spark, d)
    return a.withColumnRenamed("score", "score_a").join(b.withColumnRenamed("score", "score_b"), ["experiment", "fold"]).select("experiment", "fold", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), F.round(F.col("score_a") - F.col("score_b"), 6).alias("delta"))


@R.add("join_left_map", sql("select o_custkey as experiment, coalesce(max(species), 'unknown') as species, count(*) as n from orders left join experiments on o_custkey = experiment group by 1", "experiments"))
def _(spark, d):
    return table(spark, d, "orders").join(view(spark, d, "experiments"), F.col("o_custkey") == F.col("experiment"), "left").groupBy(F.col("o_custkey").alias("experiment")).agg(F.coalesce(F.max("species"), F.lit("unknown")).alias("species"), count())


@R.add("join_left_unique_key", sql("""u as (select chrom, start_pos, case when count(*) = 1 then max(qval) end as qval from peaks where peak_idx % 3 <> 0 group by 1, 2)
 select peak_idx, u.qval from peaks p left join u using (chrom, start_pos)""", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    return L.join_unique(p.select("peak_idx", "chrom", "start_pos"), p.filter("peak_idx % 3 <> 0"), ["chrom", "start_pos"], ["qval"]).select("peak_idx", "qval")


@R.add("join_positional", sql("select p.peak_idx, p.chrom, (p.peak_idx * 7) % 5 as fold from peaks p", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    folds = p.select("peak_idx", "chrom", ((F.col("peak_idx") * 7) % 5).alias("fold"))
    bad = L.difference_both_ways(p.select("peak_idx", "chrom"), folds.select("peak_idx", "chrom"))
    if not bad.isEmpty():
        raise ValueError("the fold table isn't aligned with the peaks")
    return p.select("peak_idx", "chrom").join(folds, ["peak_idx", "chrom"])


@R.add("join_priority_cascade", """select s_suppkey, coalesce(cast(p.p_partkey as bigint), cast(c.c_custkey as bigint), cast(o.o_orderkey as bigint)) as value,
 case when p.p_partkey is not null then 'curated' when c.c_custkey is not null then 'experiment' when o.o_orderkey is not null then 'alias' else 'UNRESOLVED' end as basis
 from supplier left join (select p_partkey from part where p_partkey % 5 = 0) p on p.p_partkey = s_suppkey
 left join (select c_custkey from customer where c_custkey % 3 = 0) c on c.c_custkey = s_suppkey left join (select distinct o_orderkey from orders where o_orderkey % 2 = 0) o on o.o_orderkey = s_suppkey""")
def _(spark, d):
    rules = [
        ("curated", table(spark, d, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("s_suppkey"), F.col("p_partkey").cast("long").alias("value"))),
        ("experiment", table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_custkey").cast("long").alias("value"))),
        ("alias", table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("s_suppkey"), F.col("o_orderkey").cast("long").alias("value")).distinct()),
    ]
    return L.cascade(table(spark, d, "supplier").select("s_suppkey"), rules, "s_suppkey", "value")


@R.add("join_explode_containment", """m as (select 'SRR' || o_custkey as run, ['ftp/x/SRR' || o_custkey || '/a_' || o_orderkey || '.gz', 'ftp/y/SRR' || o_custkey || '_2_' || o_orderkey || '.gz', 'ftp/SRR' || (o_custkey + 1) || '/b' || o_orderkey || '.gz'] as urls, ['m' || o_orderkey, 'n' || o_orderkey] as md5s from orders),
 e as (select run, urls[i] as url, coalesce(md5s[i], '') as md5 from (select run, urls, md5s, unnest(range(1, 4)) as i from m))
 select distinct run, url, md5 from e where contains(url, '/' || run || '/') or starts_with(regexp_extract(url, '[^/]*$'), run)""".replace("m as", "with m as", 1))
def _(spark, d):
    """Files of a manifest's row belong to the run in their path or at the head of their name; a missing checksum is blank."""
    key, order = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    run = F.concat(F.lit("SRR"), key.cast("string"))
    url = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    urls = F.array(url("ftp/x/", run, "/a_", order, ".gz"), url("ftp/y/", run, "_2_", order, ".gz"), url("ftp/SRR", (key + 1).cast("string"), "/b", order, ".gz"))
    m = table(spark, d, "orders").select(run.alias("runs"), F.array_join(urls, ";").alias("urls"), F.array_join(F.array(url("m", order), url("n", order)), ";").alias("md5s"))
    return L.run_files(m)


@R.add("join_manifest_runs", "select c_custkey, c_nationkey, count(o_orderkey) as n_runs from customer left join orders on c_custkey = o_custkey group by 1, 2")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("n_runs"))


@R.add("join_anti_setdiff", "select c_custkey as key, 'no orders' as problem from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 > 0) union all select distinct o_custkey, 'no customer' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 7 > 0)")
def _(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    no_orders = c.join(o.filter("o_orderkey % 3 > 0"), "key", "left_anti").withColumn("problem", F.lit("no orders"))
    return no_orders.unionByName(o.select("key").distinct().join(c.filter("key % 7 > 0"), "key", "left_anti").withColumn("problem", F.lit("no customer")))


@R.add("join_config_vs_measured", """with c as (select c_custkey as experiment, case c_nationkey % 4 when 0 then '' when 1 then 'nextera' when 2 then 'truseq_universal' end as adapter from customer),
 m as (select o_custkey as experiment, case o_orderkey % 3 when 0 then 'R2' else 'R1' end as mate, o_orderkey % 7 as n_sampled, case o_orderpriority when '1-URGENT' then 'nextera' when '2-HIGH' then ' truseq_universal ' when '3-MEDIUM' then 'none' when '4-NOT SPECIFIED' then 'smallRNA_RA3' end as best, o_totalprice / 4000 as pct from orders),
 x as (select c.experiment, trim(best) as got, coalesce(adapter <> '' and trim(best) not in ('', 'none', 'missing') and trim(best) <> adapter and pct >= 50, false) as other from c join m using (experiment) where mate = 'R1' and n_sampled > 0),
 w as (select experiment, got, row_number() over (partition by experiment order by count(*) desc, got) as i from x where other group by 1, 2)
 select c.experiment, coalesce(adapter, '') as configured, (select count(*) from x where x.experiment = c.experiment) as n_runs, (select count(*) from x where x.experiment = c.experiment and other) as n_conflicts, w.got as measured from c left join w on w.experiment = c.experiment and i = 1""")
def _(spark, d):
    """Each customer as an experiment with a configured adapter, each order as a run with a measured one."""
    n, o = F.col("c_nationkey") % 4, F.col("o_orderpriority")
    adapters = table(spark, d, "customer").select(F.col("c_custkey").alias("experiment"), F.when(n == 0, "").when(n == 1, "nextera").when(n == 2, "truseq_universal").alias("adapter"))
    best = F.when(o == "1-URGENT", "nextera").when(o == "2-HIGH", " truseq_universal ").when(o == "3-MEDIUM", "none").when(o == "4-NOT SPECIFIED", "smallRNA_RA3")
    key = F.col("o_orderkey")
    survey = table(spark, d, "orders").select(F.col("o_custkey").alias("experiment"), F.when(key % 3 == 0, "R2").otherwise("R1").alias("mate"), (key % 7).alias("n_sampled"), best.alias("best_adapter"), (F.col("o_totalprice") / 4000).alias("pct_adapter"))
    return qc.adapter_conflicts(survey, adapters)


@R.add("join_first_file_wins", """select d.doc_id, case when l.doc_id is not null then l.toxic else g.k end as value, l.doc_id is not null or g.k is not null as found
 from documents d left join (select doc_id, toxic from labels) l on l.doc_id = d.doc_id left join (select doc_id, 9 as k from documents where doc_id % 2 = 0) g on g.doc_id = d.doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    own = table(spark, d, "labels").select("doc_id", "toxic", F.lit(True).alias("has_own"))
    wide = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("k"))
    value = F.when(F.col("has_own"), F.col("toxic")).otherwise(F.col("k"))
    return docs.join(own, "doc_id", "left").join(wide, "doc_id", "left").select("doc_id", value.alias("value"), (F.col("has_own").isNotNull() | F.col("k").isNotNull()).alias("found"))


@R.add("agg_group_count", sql("select pclass, end_pos - start_pos as width, count(*) as n from peaks group by 1, 2", "peaks"))
def _(spark, d):
    return view(spark, d, "peaks").groupBy("pclass", (F.col("end_pos") - F.col("start_pos")).alias("width")).agg(count())


@R.add("agg_count_with_zero_groups", sql("select n_name as species, count(experiment) as n, round(count(experiment) / (select count(*) from experiments), 9) as share from nation left join experiments on n_name = species and depth > 9000 group by 1", "experiments").replace("(select count(*) from experiments)", "(select count(*) from experiments where depth > 9000)"))
def _(spark, d):
    out = L.counts_with_zeros(table(spark, d, "nation").select(F.col("n_name").alias("species")), view(spark, d, "experiments").filter("depth > 9000"), "species")
    return out.withColumn("share", F.round("share", 9))


@R.add("agg_sum_multivalue", """with x as (select doc_id, unnest(string_split(source || ';' || lang || ';' || n_chars, ';')) as v from documents)
 select doc_id, cast(sum(try_cast(v as bigint)) as bigint) as total from x group by 1""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat_ws(";", "source", "lang", F.col("n_chars").cast("string")), ";")).alias("v"))
    return docs.groupBy("doc_id").agg(F.sum(F.col("v").try_cast("long")).alias("total"))


@R.add("agg_pct", "select o_custkey, round(100 * sum(case when o_orderstatus = 'F' then 1.0 else 0.0 end) / count(*), 1) as pct from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(X.pct(F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), F.count("*")).alias("pct"))


@R.add("agg_fold_mean_sd", sql(AB + " select experiment, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, count(*) as n_folds from a group by 1", "per_locus"))
def _(spark, d):
    return ab(spark, d)[0].groupBy("experiment").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("sd"), F.count("*").alias("n_folds"))


@R.add("agg_species_median", sql("select species, median(depth) as median_depth, count(*) as n from experiments where depth > 0 group by 1 having count(*) >= 3", "experiments"))
def _(spark, d):
    return view(spark, d, "experiments").filter("depth > 0").groupBy("species").agg(F.median("depth").alias("median_depth"), count()).filter("n >= 3")


@R.add("agg_upper_median", "select lang, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] as upper_median from documents group by 1")
def _(spark, d):
    return prefix.order_statistics(table(spark, d, "documents"), ["lang"], "n_chars", {"upper_median": lambda n: F.floor(n / 2)})


@R.add("agg_mode", "with c as (select lang, n_chars, count(*) as n, min(doc_id) as first from documents group by 1, 2) select lang, arg_max(n_chars, struct_pack(n := n, f := -first)) as mode from c group by 1")
def _(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "n_chars").agg(count(), F.min("doc_id").alias("first"))
    return c.groupBy("lang").agg(F.max_by("n_chars", F.struct("n", -F.col("first"))).alias("mode"))


@R.add("agg_argmax_key", "with c as (select lang, source, count(*) as n from documents group by 1, 2) select lang, source as best, n from (select *, row_number() over (partition by lang order by n desc, source) as rn from c) where rn = 1")
def _(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(count())
    return L.first_rows(c.withColumn("minus", -F.col("n")), ["lang"], ["minus", "source"]).select("lang", F.col("source").alias("best"), "n")


@R.add("agg_distinct_join", "select o_custkey, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as priorities from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"))


@R.add("agg_nested_map", "select n_regionkey, string_agg(n_name || '=' || n_nationkey, ',' order by n_name) as members from nation group by 1")
def _(spark, d):
    m = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    return m.select("n_regionkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("members"))


@R.add("agg_digest_ordered", sql("select chrom, sha256(string_agg(peak_idx || ':' || start_pos || ';', '' order by peak_idx)) as digest from peaks group by 1", "peaks"))
def _(spark, d):
    return L.digest(view(spark, d, "peaks"), F.concat_ws("", F.col("peak_idx").cast("string"), F.lit(":"), F.col("start_pos").cast("string"), F.lit(";")), "peak_idx", ["chrom"])


@R.add("agg_summary_delta", sql(AB + ", d as (select experiment, a.score - b.score as delta from a join b using (experiment, fold)) select experiment, count(*) as n, count(*) filter (where delta > 0) as n_better, round(median(delta), 6) as median_delta, round(avg(delta), 6) as mean_delta from d group by 1", "per_locus"))
def _(spark, d):
    a, b = ab(spark, d)
    delta = a.join(b.withColumnRenamed("score", "other"), ["experiment", "fold"]).withColumn("delta", F.col("score") - F.col("other"))
    return delta.groupBy("experiment").agg(count(), F.count(F.when(F.col("delta") > 0, 1)).alias("n_better"), F.round(F.median("delta"), 6).alias("median_delta"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@R.add("agg_star_rollup", "select o_custkey, count(*) as n_logs, cast(sum(case when o_orderstatus = 'F' then cast(floor(o_totalprice) as bigint) end) as bigint) as unique_reads from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_logs"), F.sum(F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("long"))).alias("unique_reads"))


ROW = """ex as (select s_suppkey as experiment, n_name as species, case when s_suppkey % 3 = 0 then 'include' else '' end as tier, 'cap' as assay_family, case when s_suppkey % 2 = 0 then 'PAIRED' else 'SINGLE' end as layout,
   s_suppkey % 5 = 0 as umi, s_suppkey % 4 + 1 as n_samples, s_suppkey % 7 + 1 as n_runs, case when s_suppkey % 6 > 0 then s_suppkey * 1000 end as archive_reads from supplier join nation on s_nationkey = n_nationkey),
 lg as (select l_suppkey as experiment, sum(l_partkey) as i, sum(case when l_linenumber % 2 = 0 then l_partkey end) as u from lineitem where l_suppkey % 9 > 0 group by 1),
 sg as (select l_suppkey as experiment, coalesce(sum(case when species like 'C%' or l_linenumber <= 3 then cast(l_quantity as bigint) end), 0) as r from lineitem join ex on ex.experiment = l_suppkey where l_suppkey % 8 > 0 group by 1),
 pk as (select l_suppkey as experiment, count(*) as n, count(*) filter (l_returnflag = 'N') as u, count(*) filter (l_returnflag <> 'N') as b from lineitem where l_linenumber = 1 and l_suppkey % 10 > 0 group by 1)"""


@R.add("agg_experiment_row", "with " + ROW + """ select ex.experiment, species, tier, assay_family, layout, case when umi then 'yes' else 'no' end as has_umi, n_samples, n_runs, archive_reads, cast(lg.i as bigint) as input_reads, cast(lg.u as bigint) as unique_reads,
 round(100.0 * lg.u / nullif(lg.i, 0), 1) as pct_unique, cast(sg.r as bigint) as signal_reads, round(100.0 * sg.r / nullif(lg.u, 0), 1) as pct_signal_of_unique, pk.n as peaks_total, pk.u as peaks_unidirectional, pk.b as peaks_bidirectional,
 cast(round_even(nullif(sg.r, 0) / nullif(pk.n, 0), 0) as bigint) as reads_per_peak from ex left join lg on lg.experiment = ex.experiment left join sg on sg.experiment = ex.experiment left join pk on pk.experiment = ex.experiment""")
def _(spark, d):
    """One species in three letters has no list of main chromosomes, so that all of its count."""
    key, l = F.col("s_suppkey"), table(spark, d, "lineitem").withColumn("experiment", F.col("l_suppkey"))
    e = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("experiment"), F.col("n_name").alias("species"), F.when(key % 3 == 0, "include").otherwise("").alias("tier"), F.lit("cap").alias("assay_family"), F.when(key % 2 == 0, "PAIRED").otherwise("SINGLE").alias("layout"),
        (key % 5 == 0).alias("umi_enabled"), (key % 4 + 1).alias("n_samples"), (key % 7 + 1).alias("n_runs"), F.when(key % 6 > 0, key * 1000).alias("archive_reads"),
    )
    logs = l.filter("l_suppkey % 9 > 0").select("experiment", F.col("l_partkey").alias("input"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("unique"))
    mapped = l.filter("l_suppkey % 8 > 0").select("experiment", F.col("l_linenumber").cast("string").alias("chrom"), F.col("l_quantity").cast("long").alias("reads"))
    main = e.filter("species not like 'C%'").select("species", F.explode(F.array(*(F.lit(x) for x in "123"))).alias("chrom")).distinct()
    peaks = l.filter("l_linenumber = 1 and l_suppkey % 10 > 0").select("experiment", F.when(F.col("l_returnflag") == "N", "uni").otherwise("bi").alias("pclass"))
    return L.experiment_rows(e, logs, mapped, main, peaks)


@R.add("agg_any_flag", "select o_custkey, bool_or(lower(trim(o_orderstatus)) in ('f', 'p')) as any_flag from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.lower(F.trim("o_orderstatus")).isin("f", "p")).alias("any_flag"))


@R.add("agg_wanted_runs", "select l_suppkey as run, string_agg(distinct cast(l_linenumber as varchar), ';' order by cast(l_linenumber as varchar)) as wanted_by from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ";").alias("wanted_by"))


@R.add("agg_status_tally", "select o_orderstatus as status, count(*) as n from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(count())


@R.add("agg_peak_classes", sql("select chrom, count(*) filter (where pclass = 'uni') as n_uni, count(*) filter (where pclass = 'bi') as n_bi from peaks group by 1", "peaks"))
def _(spark, d):
    return view(spark, d, "peaks").groupBy("chrom").agg(F.count(F.when(F.col("pclass") == "uni", 1)).alias("n_uni"), F.count(F.when(F.col("pclass") == "bi", 1)).alias("n_bi"))


@R.add("agg_sample_fastqs", "select o_custkey, string_agg(o_orderkey, ',' order by o_orderkey) as inputs from (select distinct o_custkey, o_orderkey from orders) group by 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey").distinct()
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("inputs"))


@R.add("win_quartile_slice", sql("r as (select peak_idx, row_number() over (order by qval, peak_idx) - 1 as r, count(*) over () as n from peaks where pclass = 'uni') select peak_idx, case when r < n//4 then 1 when r < 2*n//4 then 2 when r < 3*n//4 then 3 else 4 end as quartile from r", "peaks").replace("1 when", "cast(1 as bigint) when"))
def _(spark, d):
    from siteline.operators.ordinal import with_ordinal

    uni = view(spark, d, "peaks").filter("pclass = 'uni'")
    ranked = with_ordinal(uni, "qval", "peak_idx", name="r", first=0)
    n = uni.agg(F.count("*").alias("n"))
    edge = lambda k: F.floor(k * F.col("n") / 4)
    q = F.when(F.col("r") < edge(1), 1).when(F.col("r") < edge(2), 2).when(F.col("r") < edge(3), 3).otherwise(4).cast("long")
    return ranked.crossJoin(F.broadcast(n)).select("peak_idx", q.alias("quartile"))  # one row


@R.add("win_peer_median", "select a.s_suppkey, median(b.s_acctbal) as peers from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey group by 1")
def _(spark, d):
    return C.peer_median(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", "s_suppkey", "peers").filter("peers is not null").select("s_suppkey", "peers")


@R.add("win_row_alternate", "select conv_id, turn, case when turn % 2 = 0 then 1 else 2 end as mate, turn // 2 as record from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, 1).otherwise(2).alias("mate"), F.expr("turn div 2").alias("record"))


@R.add("ext_deinterleave", "select conv_id, turn // 2 as record, max(case when turn % 2 = 0 then text end) as mate1, max(case when turn % 2 = 1 then text end) as mate2 from conversations group by 1, 2")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", F.expr("turn div 2").alias("record")).agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("mate1"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("mate2"))


@R.add("srt_bed", sql("select peak_idx, chrom, start_pos, row_number() over (order by chrom, start_pos, peak_idx) as place from peaks", "peaks"))
def _(spark, d):
    from siteline.operators.ordinal import with_ordinal

    return with_ordinal(view(spark, d, "peaks").select("peak_idx", "chrom", "start_pos"), "chrom", "start_pos", "peak_idx", name="place").withColumn("place", F.col("place").cast("long"))


@R.add("srt_stable", sql("select peak_idx, row_number() over (partition by chrom order by (start_pos + end_pos)//2, peak_idx) as place from peaks", "peaks"))
def _(spark, d):
    centred = view(spark, d, "peaks").select("peak_idx", "chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("center"))
    return prefix.numbered(centred, ["chrom"], ["center", "peak_idx"], "place").select("peak_idx", "place")


FLAGS = "concat_ws(',', case when depth < 0 then 'FAIL:depth' end, case when depth < 2000 then 'WARN:thin' end)"


@R.add("srt_multi_key", sql(f"f as (select experiment, {FLAGS} as flags from experiments) select experiment, flags, row_number() over (order by case when flags like '%FAIL%' then 0 when flags like '%WARN%' then 1 else 2 end, experiment) as place from f", "experiments"))
def _(spark, d):
    from siteline.operators.ordinal import with_ordinal

    f = view(spark, d, "experiments").select("experiment", F.expr(FLAGS).alias("flags")).withColumn("sev", L.severity(F.col("flags")))
    return with_ordinal(f, "sev", "experiment", name="place").select("experiment", "flags", F.col("place").cast("long").alias("place"))


@R.add("lim_prefix", sql("select peak_idx, chrom from peaks where peak_idx <= 100", "peaks"))
def _(spark, d):
    return view(spark, d, "peaks").filter("peak_idx <= 100").select("peak_idx", "chrom")


@R.add("top_k_counts", "select source, count(*) as n from documents group by 1 order by n desc, source limit 8")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(count()).orderBy(F.desc("n"), "source").limit(8)


@R.add("set_union_all_peaks", sql("select chrom, start_pos, end_pos, pclass from peaks where pclass = 'uni' union all select chrom, start_pos, end_pos, 'bi' from peaks where pclass = 'bi'", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks").select("chrom", "start_pos", "end_pos", "pclass")
    return p.filter("pclass = 'uni'").unionByName(p.filter("pclass = 'bi'"), allowMissingColumns=True)


@R.add("set_concat_frames", sql("select fold, event_id from per_locus", "per_locus"))
def _(spark, d):
    """Frames of even and odd folds and of none, their columns in different orders, as one."""
    p = view(spark, d, "per_locus").select("fold", "event_id")
    return L.concat_frames([p.filter("fold % 2 = 0"), p.filter("fold % 2 <> 0").select("event_id", "fold"), p.filter("fold is null").select("event_id")]).select("fold", "event_id")


@R.add("set_except", "(select o_custkey % 50 as k from orders except all select c_custkey % 50 from customer)")
def _(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k")).exceptAll(table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("k")))


@R.add("snk_split_csv", """select n_name as "group", case n_nationkey % 3 when 0 then 'created' when 1 then 'unchanged' else 'rewritten' end as status, count(*) as n_chroms from supplier join nation on s_nationkey = n_nationkey group by n_name, n_nationkey""")
def _(spark, d):
    """Tables of chromosomes and folds as CSV, a folder a species, against what an earlier run wrote."""
    from siteline.operators import folds as K
    from siteline.session import scratch

    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("n_name").alias("group"), F.col("s_suppkey").alias("chrom"), (F.col("s_suppkey") % 5).alias("fold"), "n_nationkey")
    path = scratch(spark, "splits")
    old = rows.filter("n_nationkey % 3 > 0").select("group", "chrom", F.when(F.col("n_nationkey") % 3 == 2, (F.col("fold") + 1) % 5).otherwise(F.col("fold")).alias("fold"))
    old.write.partitionBy("group").csv(path, header=True)
    existing = spark.read.csv(path, header=True, schema="chrom string, fold long, group string")
    return K.split_status(rows.drop("n_nationkey"), existing)


@R.add("set_intersect_chroms", sql("(select chrom from aln where strand = '+' intersect select chrom from aln where strand = '-')", "aln").replace("), (select", ") (select"))
def _(spark, d):
    a = view(spark, d, "aln")
    return a.filter("strand = '+'").select("chrom").intersect(a.filter("strand = '-'").select("chrom"))


@R.add("set_union_blacklists", sql("select chrom, start_pos, end_pos from peaks where qval > 0.05 union all select chrom, start_pos, end_pos from peaks where pclass = 'bi'", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    return p.filter("qval > 0.05").select("chrom", "start_pos", "end_pos").unionByName(p.filter("pclass = 'bi'").select("chrom", "start_pos", "end_pos"))


@R.add("set_dedup_first", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) as rn from orders) where rn = 1")
def _(spark, d):
    return L.first_rows(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice"]).select("o_custkey", "o_orderkey")
