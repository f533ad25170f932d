"""Queries of interval and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteline.functions import seq
from siteline.operators import barcodes
from siteline.operators import intervals as I
from siteline.operators import ordinal, prefix
from siteline.operators import signal as S
from siteline.plans.proxies import sql, table, view
from siteline.plans.registry import Registry

R = Registry()

SIG = """sig as (select chrom, strand, case when strand='+' then start_pos else end_pos-1 end as pos, cast(count(*) as double) as value
 from aln where mapq >= 255 group by 1, 2, 3)"""


def signal(spark, d):
    return S.five_prime(view(spark, d, "aln").filter("mapq >= 255"))


@R.add("sig_genomecov5", sql(SIG + " select * from sig", "aln"))
def _(spark, d):
    return signal(spark, d)


@R.add("sig_replicate_merge", sql("""select chrom, strand, case when strand='+' then start_pos else end_pos-1 end as pos, cast(count(*) as double) as value
 from aln where sample <= 2 group by 1, 2, 3""", "aln"))
def _(spark, d):
    aln = view(spark, d, "aln")
    return S.merge_tracks(*(S.five_prime(aln.filter(f"sample = {k}")) for k in (1, 2)))


#: Reads of a stretch of a strand, with barcodes of four bases.
UMIS = """um as (select cast(l_suppkey % 7 as varchar) as chrom, case when l_linestatus = 'O' then '+' else '-' end as strand, (l_orderkey * 20) // 200000 as pos,
   translate(cast(l_partkey // 64 % 4 as varchar) || cast(l_partkey // 16 % 4 as varchar) || cast(l_partkey // 4 % 4 as varchar) || cast(l_partkey % 4 as varchar), '0123', 'ACGT') as umi from lineitem)"""


def barcoded(spark, d):
    digit = lambda k: F.expr(f"cast(l_partkey div {k} % 4 as string)")
    return table(spark, d, "lineitem").selectExpr("cast(l_suppkey % 7 as string) as chrom", "case when l_linestatus = 'O' then '+' else '-' end as strand", "(l_orderkey * 20) div 200000 as pos", "l_partkey").withColumn("umi", F.translate(F.concat(*(digit(k) for k in (64, 16, 4, 1))), "0123", "ACGT")).drop("l_partkey")


@R.add("ext_dedup", "with recursive " + UMIS + """, ct as (select chrom, strand, pos, umi, count(*) as n from um group by all),
 rk as (select *, row_number() over (partition by chrom, strand, pos order by n desc, umi) as r from ct),
 ed as (select a.chrom, a.strand, a.pos, a.umi as a, b.umi as b from rk a join rk b on a.chrom = b.chrom and a.strand = b.strand and a.pos = b.pos and a.n >= 2 * b.n - 1 and hamming(a.umi, b.umi) = 1),
 reach as (select chrom, strand, pos, umi, r from rk union select ed.chrom, ed.strand, ed.pos, ed.b, reach.r from reach join ed on ed.chrom = reach.chrom and ed.strand = reach.strand and ed.pos = reach.pos and ed.a = reach.umi),
 best as (select chrom, strand, pos, umi, min(r) as r from reach group by all)
 select b.chrom, b.strand, b.pos, k.umi as root, cast(sum(c.n) as bigint) as n_reads, count(*) as n_barcodes from best b join rk k on k.chrom = b.chrom and k.strand = b.strand and k.pos = b.pos and k.r = b.r
   join ct c on c.chrom = b.chrom and c.strand = b.strand and c.pos = b.pos and c.umi = b.umi group by 1, 2, 3, 4""")
def _(spark, d):
    """The molecules of each place: barcodes taken in by those read at least twice as often, with their reads."""
    found = barcodes.directional(barcoded(spark, d), ["chrom", "strand", "pos"])
    return found.groupBy("chrom", "strand", "pos", "root").agg(F.sum("n").alias("n_reads"), F.count("*").alias("n_barcodes"))


@R.add("ext_dedup_exact", sql("""select distinct sample, chrom, strand, case when strand='+' then start_pos else end_pos-1 end as pos, umi from aln where mapq >= 255""", "aln"))
def _(spark, d):
    return S.dedup_umi(view(spark, d, "aln").filter("mapq >= 255"))


@R.add("ext_unique", sql("select chrom, count(*) as n from aln where mapq >= 255 group by 1", "aln"))
def _(spark, d):
    return view(spark, d, "aln").filter("mapq >= 255").groupBy("chrom").agg(F.count("*").alias("n"))


@R.add("ext_one_mate", sql("select chrom, strand, start_pos, end_pos, sample, umi from (select distinct * from aln) where mapq >= 255 and (flag & 64) <> 0", "aln"))
def _(spark, d):
    return view(spark, d, "aln").distinct().filter((F.col("mapq") >= 255) & (F.col("flag").bitwiseAND(64) != 0)).select("chrom", "strand", "start_pos", "end_pos", "sample", "umi")


@R.add("ext_merge_bam", sql("""select chrom, strand, pos, cast(count(*) as double) as value from (
 select distinct sample, chrom, strand, case when strand='+' then start_pos else end_pos-1 end as pos, umi from aln) group by 1, 2, 3""", "aln"))
def _(spark, d):
    return S.dedup_umi(view(spark, d, "aln")).groupBy("chrom", "strand", "pos").agg(F.count("*").cast("double").alias("value"))


@R.add("ext_bedgraph", sql("select chrom, strand, pos as start_pos, pos + 1 as end_pos, case when strand = '-' then -value else value end as value from (with " + SIG + " select * from sig)", "aln"))
def _(spark, d):
    """Both strands' tracks, the minus strand's values negative."""
    return signal(spark, d).select("chrom", "strand", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), F.when(F.col("strand") == "-", -F.col("value")).otherwise(F.col("value")).alias("value"))


@R.add("ext_merge_run_fastqs", sql("select run, count(*) as n_reads, cast(sum(length(seq)) as bigint) as n_bases from seqs group by 1", "seqs"))
def _(spark, d):
    return view(spark, d, "seqs").groupBy("run").agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))


SWEEP = """ev as (select chrom, pos, sum(delta) as delta from (
   select chrom, start_pos as pos, cast(end_pos - start_pos as double) as delta from peaks where start_pos < end_pos
   union all select chrom, end_pos, -cast(end_pos - start_pos as double) from peaks where start_pos < end_pos) group by 1, 2),
 lv as (select chrom, pos as start_pos, lead(pos) over (partition by chrom order by pos) as end_pos, sum(delta) over (partition by chrom order by pos) as level from ev)
 select chrom, start_pos, end_pos, round(level, 6) as level from lv where end_pos is not null and level > 1e-9"""


def valued(spark, d):
    return view(spark, d, "peaks").filter("start_pos < end_pos").withColumn("value", (F.col("end_pos") - F.col("start_pos")).cast("double"))


@R.add("sig_sum_strands", sql(SWEEP, "peaks"))
def _(spark, d):
    return I.sweep_sum(valued(spark, d)).withColumn("level", F.round("level", 6))


@R.add("win_cumsum_level", sql("""ev as (select chrom, pos, sum(delta) as delta from (
   select chrom, start_pos as pos, cast(1 as bigint) as delta from peaks union all select chrom, end_pos, cast(-1 as bigint) from peaks) group by 1, 2)
 select chrom, pos, cast(sum(delta) over (partition by chrom order by pos) as bigint) as depth from ev""", "peaks"))
def _(spark, d):
    return I.depths(view(spark, d, "peaks"))


@R.add("sig_unstranded", sql(SIG + " select chrom, pos, sum(abs(case when strand = '-' then -value else value end)) as value from sig group by 1, 2", "aln"))
def _(spark, d):
    return S.unstranded(signal(spark, d).withColumn("value", F.when(F.col("strand") == "-", -F.col("value")).otherwise(F.col("value"))))


TOTALS = SIG + """, uns as (select chrom, pos, sum(value) as value from sig group by 1, 2),
 tot as (select p.peak_idx, coalesce(sum(u.value), 0) as total from peaks p left join uns u on u.chrom = p.chrom
   and u.pos >= greatest(0, (p.start_pos + p.end_pos)//2 - 50) and u.pos < (p.start_pos + p.end_pos)//2 + 50 group by 1)"""


def totals(spark, d):
    return S.window_totals(view(spark, d, "peaks"), S.unstranded(signal(spark, d)), 100)


@R.add("join_window_signal", sql(TOTALS + " select * from tot", "aln", "peaks"))
def _(spark, d):
    return totals(spark, d).select("peak_idx", "total")


@R.add("sig_window_total_median", sql(TOTALS + " select median(total) as median_total, count(*) as n from tot", "aln", "peaks"))
def flagship(spark, d):
    return prefix.quantiles(totals(spark, d), [], "total", {"median_total": 0.5}).select("median_total", F.col("__count").alias("n"))


@R.add("agg_global_quantile", sql(TOTALS + " select round(quantile_cont(total, 0.99), 6) as p99 from tot", "aln", "peaks"))
def _(spark, d):
    return prefix.quantiles(totals(spark, d), [], "total", {"p99": 0.99}).select(F.round("p99", 6).alias("p99"))


@R.add("flt_outlier", sql(TOTALS + " select peak_idx, total from tot where total <= 1.2 * (select quantile_cont(total, 0.99) from tot)", "aln", "peaks"))
def _(spark, d):
    t = totals(spark, d).select("peak_idx", "total")
    edge = prefix.quantiles(t, [], "total", {"p99": 0.99}).select((1.2 * F.col("p99")).alias("edge"))
    return t.crossJoin(F.broadcast(edge)).filter("total <= edge").drop("edge")  # one row


@R.add("sig_peak_maxima", sql(SIG + """, hit as (select p.peak_idx, p.chrom, s.pos, s.strand, s.value from peaks p join sig s on s.chrom = p.chrom and s.pos >= p.start_pos and s.pos < p.end_pos)
 select peak_idx, chrom, pos, strand, value from (select *, row_number() over (partition by peak_idx order by value desc, strand asc, pos asc) as rn from hit) where rn = 1""", "aln", "peaks"))
def _(spark, d):
    return S.peak_maxima(view(spark, d, "peaks"), signal(spark, d))


PROFILE = SIG + """, sites as (select chrom, pos, strand, cast(row_number() over (order by chrom, pos, strand) as bigint) as site from tss),
 hit as (select t.site, case when t.strand='+' then s.pos - t.pos else t.pos - s.pos end as off, t.strand = s.strand as sense, s.value
   from sites t join sig s on s.chrom = t.chrom and s.pos between t.pos - 60 and t.pos + 60),
 tot as (select site, sum(value) as total from hit group by 1)"""


def profiled(spark, d, flank=60):
    sites = ordinal.with_ordinal(view(spark, d, "tss"), "chrom", "pos", "strand", name="site")
    return S.profile(sites, signal(spark, d), flank)


@R.add("sig_metaplot", sql(PROFILE + """ select cast(off as bigint) as "offset", round(sum(case when sense then value/total else 0 end) / (select count(*) from tot), 9) as sense,
 round(sum(case when sense then 0 else value/total end) / (select count(*) from tot), 9) as anti, (select count(*) from tot) as n_sites from hit join tot using (site) group by 1""", "aln", "tss"))
def _(spark, d):
    return profiled(spark, d).select(F.col("offset").cast("long").alias("offset"), F.round("sense", 9).alias("sense"), F.round("anti", 9).alias("anti"), "n_sites")


# The statistics read the profile rounded, so that the order of its sums doesn't decide between equal heights.
DENSE = PROFILE + """, prof as (select off as o, round(sum(case when sense then value/total else 0 end) / (select count(*) from tot), 9) as sense, round(sum(case when sense then 0 else value/total end) / (select count(*) from tot), 9) as ans from hit join tot using (site) group by 1),
 dn as (select g.o, coalesce(sense, 0) as sense, coalesce(ans, 0) as ans from (select unnest(range(-60, 60)) as o) g left join prof on prof.o = g.o)"""
SUMMIT = """, sm as (select sum(sense) as sense, sum(ans) as ans, coalesce(sum(ans) filter (abs(o) between 5 and 50 and o < 0), 0) as up, coalesce(sum(ans) filter (abs(o) between 5 and 50 and o > 0), 0) as down,
   (select ans from dn where abs(o) between 5 and 50 order by ans desc, o limit 1) as peak_height, (select o from dn where abs(o) between 5 and 50 order by ans desc, o limit 1) as peak_offset,
   median(ans) filter (abs(o) between 5 and 50) as band_median, avg(ans) filter (abs(o) < 5) as inner_ from dn),
 sn as (select *, ans / greatest(sense + ans, 1e-9) as anti_share, log2((up + 1e-12) / (down + 1e-12)) as lr, band_median > 0 and peak_height >= 1.5 * band_median and 50 - abs(peak_offset) > 10 as localized from sm),
 st as (select round(anti_share, 7) as anti_share, round(up, 7) as up, round(down, 7) as down, round(lr, 5) as log2_up_down, cast(peak_offset as bigint) as peak_offset, round(peak_height, 7) as peak_height, round(band_median, 7) as band_median, localized, round(inner_, 7) as "inner",
   case when ans <= 0 then 'none' when anti_share <= 0.05 then 'weak' when lr <= -1 and localized then 'swapped' when lr <= -1 then 'REVIEW' when peak_height > 0 and inner_ >= 2 * peak_height then 'on summit' else 'ok' end as note from sn)"""


def dense(spark, d, profile=None):
    own = profiled(spark, d) if profile is None else profile
    return S.dense(own.select("offset", F.round("sense", 9).alias("sense"), F.round("anti", 9).alias("anti")), 60)


def rounded(df):
    digits = {"log2_up_down": 5, "prominence": 5, "vs_sense": 5}
    return df.select(*(F.round(c, digits.get(c, 7)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@R.add("sig_magnitude", sql(DENSE + """ select (select cast(o as bigint) from dn where o between -50 and -5 order by ans desc, o limit 1) as at_upstream, (select cast(o as bigint) from dn where abs(o) between 5 and 50 order by ans desc, o limit 1) as at_band,
 round(max(ans) filter (o between -50 and -5), 7) as height, round(max(ans) filter (o between -50 and -5) / nullif(median(ans) filter (abs(o) between 5 and 50), 0), 5) as prominence, round(max(ans) filter (o between -50 and -5) / nullif(max(sense), 0), 5) as vs_sense from dn""", "aln", "tss"))
def _(spark, d):
    return rounded(S.magnitude(dense(spark, d), 5, 50))


@R.add("sig_summit_stats", sql(DENSE + SUMMIT + " select * from st", "aln", "tss"))
def _(spark, d):
    return rounded(S.summit_stats(dense(spark, d), 5, 50, 10))


TOPS = SIG + """, mx as (select peak_idx, p.chrom, s.pos, s.strand, row_number() over (partition by peak_idx order by value desc, s.strand = '+' desc, s.pos) as k from peaks p join sig s on s.chrom = p.chrom and s.pos >= p.start_pos and s.pos < p.end_pos and p.start_pos < p.end_pos),
 sites as (select peak_idx as site, chrom, pos, strand from mx where k = 1),
 hit as (select t.site, case when t.strand='+' then s.pos - t.pos else t.pos - s.pos end as off, t.strand = s.strand as sense, s.value, s.chrom, s.pos, t.strand as ts
   from sites t join sig s on s.chrom = t.chrom and s.pos between t.pos - 60 and t.pos + 60),
 tot as (select site, sum(value) as total from hit group by 1)"""


def summits(spark, d):
    tops = S.peak_maxima(view(spark, d, "peaks"), signal(spark, d))
    return tops.select(F.col("peak_idx").alias("site"), "chrom", "pos", "strand")


@R.add("sig_summit_metaplot", sql(TOPS + """ select cast(off as bigint) as "offset", round(sum(case when sense then value/total else 0 end) / (select count(*) from tot), 9) as sense,
 round(sum(case when sense then 0 else value/total end) / (select count(*) from tot), 9) as anti, (select count(*) from tot) as n_sites from hit join tot using (site) group by 1""", "aln", "peaks"))
def _(spark, d):
    return S.profile(summits(spark, d), signal(spark, d), 60).select(F.col("offset").cast("long").alias("offset"), F.round("sense", 9).alias("sense"), F.round("anti", 9).alias("anti"), "n_sites")


NEAR = """, q as (select chrom, strand, pos, value from sig),
 nr as (select q.chrom, q.strand, q.pos, q.value, least(q.pos - b.pos, a.pos - q.pos) as distance
   from q asof left join tss b on b.chrom = q.chrom and b.strand = q.strand and q.pos >= b.pos asof left join tss a on a.chrom = q.chrom and a.strand = q.strand and q.pos <= a.pos)"""


@R.add("join_nearest_within", sql(SIG + NEAR + " select chrom, strand, pos, case when distance <= 50 then distance end as distance, coalesce(distance <= 50, false) as near from nr", "aln", "tss"))
def _(spark, d):
    out = I.nearest_within(signal(spark, d).drop("value"), view(spark, d, "tss"), 50)
    return out.select("chrom", "strand", "pos", F.when(F.col("near"), F.col("distance")).alias("distance"), "near")


PARTED = TOPS + """, st0 as (select distinct chrom, strand, pos from tss),
 pt as (select s.site, s.chrom, s.pos, s.strand, bool_or(t.pos is not null) as paired, coalesce(bool_or((s.strand = '+' and t.pos < s.pos) or (s.strand = '-' and t.pos > s.pos)), false) as paired_upstream
   from sites s left join st0 t on t.chrom = s.chrom and t.strand <> s.strand and abs(t.pos - s.pos) between 3 and 52 group by 1, 2, 3, 4)"""


def parted(spark, d):
    return S.divergent_partition(summits(spark, d), view(spark, d, "tss"), 5, 50, 2)


@R.add("sig_divergent_partition", sql(PARTED + """, ph as (select case when paired then 'paired' else 'unpaired' end as class, hit.* from hit join pt using (site)),
 pn as (select class, count(distinct site) as n from ph group by 1)
 select class, cast(off as bigint) as "offset", round(sum(case when sense then value/total else 0 end) / any_value(n), 9) as sense, round(sum(case when sense then 0 else value/total end) / any_value(n), 9) as anti, any_value(n) as n_sites
 from ph join tot using (site) join pn using (class) group by 1, 2""", "aln", "peaks", "tss"))
def _(spark, d):
    """Profiles of the sites with and without a start of the other strand in either band."""
    sites, own = parted(spark, d), signal(spark, d)
    profiles = [S.profile(sites.filter(keep).drop("paired", "paired_upstream"), own, 60).withColumn("class", F.lit(name)) for name, keep in (("paired", "paired"), ("unpaired", "not paired"))]
    return profiles[0].unionByName(profiles[1]).select("class", F.col("offset").cast("long").alias("offset"), F.round("sense", 9).alias("sense"), F.round("anti", 9).alias("anti"), "n_sites")


SHIFTS = [2300, 7100, 13700, 23300, 41900]


@R.add("sig_attribution_null", sql(PARTED + """, w as (select case when ts = '+' then '-' else '+' end as strand, hit.chrom, hit.pos, value/total as w from hit join tot using (site) where not sense and off between -50 and -5),
 sh as (select unnest([0, 2300, 7100, 13700, 23300, 41900]) as shift),
 mv as (select shift, chrom, strand, pos - shift as pos, w from w, sh),
 nr as (select m.shift, m.w, coalesce(t.pos >= m.pos - 2, false) as near from mv m asof left join st0 t on t.chrom = m.chrom and t.strand = m.strand and m.pos + 2 >= t.pos),
 s as (select shift, sum(case when near then w else 0 end) / sum(w) as share from nr group by 1),
 r as (select max(share) filter (where shift = 0) as observed, median(share) filter (where shift <> 0) as expected from s)
 select round(observed, 7) as observed, round(expected, 7) as expected, case when expected > 0 then round(observed / expected, 5) when observed > 0 then 'inf'::double end as enrichment from r""", "aln", "peaks", "tss"))
def _(spark, d):
    """The share of upstream antisense near a start of its strand, against starts that are shifted."""
    hits = S.site_hits(summits(spark, d), signal(spark, d), 60).filter("not is_sense and offset between -50 and -5")
    points = hits.select("chrom", "strand", "pos", (F.col("value") / F.col("site_total")).alias("weight"))
    out = S.attribution(points, view(spark, d, "tss"), [-s for s in SHIFTS], 2)
    return out.select(F.round("observed", 7).alias("observed"), F.round("expected", 7).alias("expected"), F.round("enrichment", 5).alias("enrichment"))


@R.add("sig_read_partition", sql(PARTED + """, un as (select hit.* from hit join pt using (site) where not paired), nu as (select count(distinct site) as n from un), ns as (select count(distinct site) as n from hit),
 prof as (select off as o, round(sum(case when sense then value/total else 0 end) / (select n from nu), 9) as sense, round(sum(case when sense then 0 else value/total end) / (select n from nu), 9) as ans from un join tot using (site) group by 1),
 dn as (select g.o, coalesce(sense, 0) as sense, coalesce(ans, 0) as ans from (select unnest(range(-60, 60)) as o) g left join prof on prof.o = g.o)""" + SUMMIT + """,
 pk as (select ns.n as n_sites, nu.n as n_unpaired, log2_up_down, case when localized then peak_offset end as peak from st, ns, nu)
 select n_sites, n_unpaired, log2_up_down, peak, case when n_sites = 0 then 'no usable sites' when n_unpaired / n_sites < 0.1 or log2_up_down is null then 'inconclusive' when peak <= -5 and log2_up_down >= 0.5 then 'survives'
   when peak > -5 then 'not divergent' when log2_up_down >= 0.5 then 'partly survives' else 'gene pairs' end as verdict from pk""", "aln", "peaks", "tss"))
def _(spark, d):
    sites, own = parted(spark, d), signal(spark, d)
    used = S.site_hits(sites, own, 60).select("site", "paired").distinct().agg(F.count("*").alias("n_sites"), F.count(F.when(~F.col("paired"), 1)).alias("n_unpaired"))
    alone = S.profile(sites.filter("not paired").drop("paired", "paired_upstream"), own, 60)
    found = rounded(S.summit_stats(dense(spark, d, alone), 5, 50, 10))
    both = used.crossJoin(F.broadcast(found)).select("n_sites", "n_unpaired", "log2_up_down", F.when(F.col("localized"), F.col("peak_offset")).alias("peak"))  # one row each
    return both.withColumn("verdict", S.partition_verdict(F.col("n_sites"), F.col("n_unpaired"), F.col("log2_up_down"), F.col("peak"), 5))


@R.add("join_interval_overlap", sql("""neg as (select chrom, start_pos + 1000 as start_pos, end_pos + 1040 as end_pos, peak_idx from peaks)
 select n.peak_idx, bool_or(p.chrom is not null) as hit from neg n left join (select distinct chrom, start_pos, end_pos from peaks where start_pos < end_pos) p on p.chrom = n.chrom and p.start_pos < n.end_pos and n.start_pos < p.end_pos group by 1""", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    neg = p.selectExpr("peak_idx", "chrom", "start_pos + 1000 as a_start", "end_pos + 1040 as a_end")
    return I.overlap_any(neg, p.selectExpr("chrom", "start_pos as b_start", "end_pos as b_end")).select("peak_idx", "hit")


@R.add("ivl_overlap_fraction", sql("""neg as (select chrom, start_pos + 1000 as start_pos, end_pos + 1040 as end_pos, peak_idx from peaks),
 h as (select n.peak_idx, bool_or(p.chrom is not null) as hit from neg n left join (select distinct chrom, start_pos, end_pos from peaks where start_pos < end_pos) p on p.chrom = n.chrom and p.start_pos < n.end_pos and n.start_pos < p.end_pos group by 1)
 select round(avg(case when hit then 1.0 else 0.0 end), 6) as share, count(*) as n from h""", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks")
    neg = p.selectExpr("peak_idx", "chrom", "start_pos + 1000 as a_start", "end_pos + 1040 as a_end")
    return I.overlap_any(neg, p.selectExpr("chrom", "start_pos as b_start", "end_pos as b_end")).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("share"), F.count("*").alias("n"))


@R.add("win_running_max_merge", sql("""o as (select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach, row_number() over (partition by chrom order by start_pos, end_pos) as rn from peaks),
 g as (select *, sum(case when start_pos - reach <= 500 then 0 else 1 end) over (partition by chrom order by rn) as grp from o)
 select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n from g group by chrom, grp""", "peaks"))
def _(spark, d):
    return I.merge_gap(view(spark, d, "peaks"), 500)


@R.add("win_running_max_end", sql("select peak_idx, chrom, max(end_pos) over (partition by chrom order by start_pos, end_pos, peak_idx rows between unbounded preceding and current row) as max_end from peaks", "peaks"))
def _(spark, d):
    return I.running_max_end(view(spark, d, "peaks")).select("peak_idx", "chrom", "max_end")


GROUPS = """c as (select peak_idx, chrom, (start_pos + end_pos)//2 as center from peaks),
 f as (select *, case when center - lag(center) over (partition by chrom order by center, peak_idx) <= 2514 then 0 else 1 end as far from c),
 g as (select peak_idx, chrom, center, cast(sum(far) over (partition by chrom order by center, peak_idx) as bigint) as grp from f)"""


def grouped(spark, d):
    return I.gap_groups(view(spark, d, "peaks").select("peak_idx", "chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("center")), 2514)


@R.add("win_gap_group", sql(GROUPS + " select * from g", "peaks"))
def _(spark, d):
    return grouped(spark, d)


@R.add("ml_gap_groups", sql(GROUPS + " select chrom, grp, count(*) as n, min(center) as first_center, max(center) as last_center from g group by 1, 2", "peaks"))
def _(spark, d):
    return grouped(spark, d).groupBy("chrom", "grp").agg(F.count("*").alias("n"), F.min("center").alias("first_center"), F.max("center").alias("last_center"))


@R.add("win_transform_size", sql(GROUPS + " select peak_idx, count(*) over (partition by chrom, grp) as group_size from g", "peaks"))
def _(spark, d):
    return I.group_sizes(grouped(spark, d)).select("peak_idx", "group_size")


@R.add("agg_nunique", sql(GROUPS + " select count(distinct (chrom, grp)) as n_groups, count(distinct chrom) as n_chroms from g", "peaks"))
def _(spark, d):
    return grouped(spark, d).agg(F.countDistinct("chrom", "grp").alias("n_groups"), F.countDistinct("chrom").alias("n_chroms"))


TILES = "tiles as (select chrom, unnest(range(0, size - 2114 + 1, 2114)) as start_pos from sizes where size >= 2114)"


@R.add("ivl_tile", sql(TILES + " select chrom, start_pos, start_pos + 2114 as end_pos from tiles", "sizes"))
def _(spark, d):
    return I.tile(view(spark, d, "sizes"), 2114)


@R.add("ivl_peak_mask", sql(TILES + " select chrom, start_pos, start_pos + 2114 as end_pos from tiles t where not exists (select 1 from peaks p where p.chrom = t.chrom and p.start_pos < p.end_pos and p.start_pos < t.start_pos + 2114 and p.end_pos > t.start_pos)", "sizes", "peaks"))
def _(spark, d):
    return I.mask_tiles(I.tile(view(spark, d, "sizes"), 2114), view(spark, d, "peaks"), 2114)


@R.add("ivl_jitter_ratio", "select tile, greatest(1, cast(round_even(tile * 1000 / 2114.0, 0) as bigint)) as out_tile from (select p_partkey as tile from part)")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("tile"), F.greatest(F.lit(1).cast("long"), F.bround(F.col("p_partkey") * 1000 / 2114.0, 0).cast("long")).alias("out_tile"))


@R.add("flt_blacklist", sql("""zones as (select chrom, start_pos, end_pos from peaks where pclass = 'bi'), b as (select distinct chrom, unnest(range(start_pos//100, end_pos//100 + 1)) as bin from zones)
 select chrom, pos, strand from tss t where not exists (select 1 from b where b.chrom = t.chrom and b.bin = t.pos//100)""", "peaks", "tss"))
def _(spark, d):
    return I.mark_excluded(view(spark, d, "tss"), view(spark, d, "peaks").filter("pclass = 'bi'").select("chrom", "start_pos", "end_pos")).select("chrom", "pos", "strand")


@R.add("flt_regions_exclude", sql("""select chrom, pos, strand from tss t where not exists (select 1 from peaks p where p.pclass = 'bi' and p.chrom = t.chrom and t.pos + 1 between p.start_pos and p.end_pos)""", "peaks", "tss"))
def _(spark, d):
    sites = ordinal.with_ordinal(view(spark, d, "tss"), "chrom", "pos", "strand", name="a_id").withColumns({"a_start": F.col("pos") + 1, "a_end": F.col("pos") + 2})
    zones = view(spark, d, "peaks").filter("pclass = 'bi'").select("chrom", F.col("start_pos").alias("b_start"), (F.col("end_pos") + 1).alias("b_end"))
    return I.overlap_any(sites, zones).filter("not hit").select("chrom", "pos", "strand")


@R.add("flt_window_bounds", sql("select chrom, pos, strand from tss join sizes using (chrom) where pos - 300 >= 0 and pos + 300 < size", "tss", "sizes"))
def _(spark, d):
    return view(spark, d, "tss").join(view(spark, d, "sizes"), "chrom").filter("pos - 300 >= 0 and pos + 300 < size").select("chrom", "pos", "strand")


@R.add("fn_midpoint_window", sql("select peak_idx, greatest(0, (start_pos + end_pos)//2 - 1057) as low, (start_pos + end_pos)//2 + 1057 as high from peaks", "peaks"))
def _(spark, d):
    low, high = seq.midpoint_window(F.col("start_pos"), F.col("end_pos"), 2114)
    return view(spark, d, "peaks").select("peak_idx", low.alias("low"), high.alias("high"))


@R.add("fn_clamped_window", sql("select peak_idx, greatest(0, (start_pos + end_pos)//2 - 1057) as low, greatest(0, (start_pos + end_pos)//2 - 1057) + 2114 as high from peaks", "peaks"))
def _(spark, d):
    low, high = seq.clamped_window(F.col("start_pos"), F.col("end_pos"), 2114)
    return view(spark, d, "peaks").select("peak_idx", low.alias("low"), high.alias("high"))


PWM = """w as (select unnest(regexp_extract_all(seq, '.{12}')) as seq, mate as strand from seqs), g as (select case when strand = 'fr' then reverse(translate(seq, 'ACGTN', 'TGCAN')) else seq end as seq from w where regexp_full_match(seq, '[ACGT]{12}')),
 b as (select unnest(range(12)) as i), c as (select i as "offset", substr(seq, i + 1, 1) as base, count(*) as n from g, b group by 1, 2),
 f as (select "offset", base, n / sum(n) over (partition by "offset") as freq from c)"""


def pwm(spark, d):
    """Over all windows of 12 bases, side by side, of every sequence."""
    s = view(spark, d, "seqs").select(F.explode(F.regexp_extract_all("seq", F.lit("(.{12})"), F.lit(1))).alias("seq"), F.when(F.col("mate") == "fr", "-").otherwise("+").alias("strand"))
    return S.pwm(s, 12)


@R.add("seq_pwm", sql(PWM + ' select "offset", base, round(freq, 9) as freq from f', "seqs"))
def _(spark, d):
    return pwm(spark, d).withColumn("freq", F.round("freq", 9))


@R.add("seq_information", sql(PWM + """, m as (select base, sum(freq) as bg from f where "offset" >= 5 group by 1), n as (select base, bg / (select sum(bg) from m) as bg from m)
 select "offset", greatest(0.0, round(sum(freq * log2(freq / bg)), 7)) + 0.0 as bits from f join n using (base) group by 1""", "seqs"))
def _(spark, d):
    return S.information(pwm(spark, d)).withColumn("bits", F.round("bits", 7))


INFO = PWM + """, m as (select base, sum(freq) as bg from f where "offset" >= 5 group by 1), n as (select base, bg / (select sum(bg) from m) as bg from m),
 ic as (select "offset" as o, greatest(0.0, round(sum(freq * log2(freq / bg)), 7)) + 0.0 as bits from f join n using (base) group by 1)"""


@R.add("sig_verdict", sql(DENSE + ", " + INFO + """, tp as (select bits, o - 1 as "at" from ic order by bits desc, o limit 1),
 sm as (select sum(sense) filter (o >= 0) as down, sum(sense) filter (o < 0) as up, sum(ans) as ans, sum(sense) as sense from dn),
 an as (select unnest([true, false]) as anchored)
 select anchored, bits, cast("at" as bigint) as "at", case when bits >= 0.15 then 'ok' when "at" in (-1, 0) then 'diluted' else 'flat and misplaced' end as motif, round(down / greatest(up, 1e-9), 5) as down_up,
   case when down > up then 'ok' when anchored then 'FLAG' else 'REVIEW' end as direction, round(ans / greatest(sense, 1e-9), 5) as anti_sense, case when ans <= sense then 'ok' when anchored then 'FLAG' else 'REVIEW' end as strands from tp, sm, an""", "aln", "tss", "seqs"))
def _(spark, d):
    """Both gradings: where annotated starts are taken for true starts, and where they aren't."""
    bits, own = S.information(pwm(spark, d)).withColumn("bits", F.round("bits", 7)), dense(spark, d)
    out = [S.orientation(bits, own, a, 1).withColumn("anchored", F.lit(a)) for a in (True, False)]
    return out[0].unionByName(out[1]).withColumns({c: F.round(c, 5) for c in ("down_up", "anti_sense")}).withColumn("at", F.col("at").cast("long"))


DRAW = "(start_pos * 2654435761 + cast(chrom as bigint) * 40503) % 4294967296"


@R.add("sig_random_baseline", sql(SIG + f""", tl as (select chrom, unnest(range(0, size - 999, 1000)) as start_pos from sizes where size >= 1000),
 dr as (select chrom, start_pos from tl order by {DRAW}, chrom, start_pos limit 2000),
 tt as (select dr.chrom, dr.start_pos, coalesce(sum(value), 0) as total from dr left join sig on sig.chrom = dr.chrom and sig.pos >= dr.start_pos and sig.pos < dr.start_pos + 1000 group by 1, 2)
 select median(total) as median_total, count(*) as n from tt""", "aln", "sizes"))
def _(spark, d):
    """A sample of 2,000 windows, by size; the draw is a fixed order of all windows."""
    tiles = I.tile(view(spark, d, "sizes"), 1000)
    some = tiles.orderBy(F.expr(DRAW), "chrom", "start_pos").limit(2000)
    return S.window_totals(ordinal.with_ordinal(some, "chrom", "start_pos", name="peak_idx"), S.unstranded(signal(spark, d)), 1000).agg(F.median("total").alias("median_total"), F.count("*").alias("n"))
