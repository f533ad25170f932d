"""Queries of sequence and text functions, score metrics, comparisons, folds and negatives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteline import session
from siteline.functions import seq as Q
from siteline.functions import text as X
from siteline.functions import trim
from siteline.operators import compare as C
from siteline.operators import folds as K
from siteline.operators import intervals as I
from siteline.operators import kmers
from siteline.operators import signal as G
from siteline.operators.ordinal import with_ordinal
from siteline.plans.proxies import sql, table, view
from siteline.plans.registry import Registry

R = Registry()
count = lambda: F.count("*").alias("n")
seqs = lambda spark, d: view(spark, d, "seqs")


@R.add("fn_normalize_name", "select doc_id, regexp_replace(regexp_replace(lower(source || ' Rep2 ' || lang), '[^a-z0-9]', '', 'g'), 'rep([0-9])', 'r\\1', 'g') as name from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_name(F.concat("source", F.lit(" Rep2 "), "lang")).alias("name"))


@R.add("fn_strip_trailing_paren", "select c_custkey, c_name || case when c_custkey % 2 = 0 then '' else ' [kept]' end as name from customer")
def _(spark, d):
    tail = F.when(F.col("c_custkey") % 2 == 0, " (rep 2)").otherwise(" [kept]")
    return table(spark, d, "customer").select("c_custkey", X.strip_trailing_paren(F.concat("c_name", tail)).alias("name"))


@R.add("fn_extract_gsm", "select c_custkey, array_to_string(regexp_extract_all('a GSM' || c_custkey || ', xGSM1 (GSM' || c_nationkey || ')', '\\bGSM[0-9]+\\b'), ';') as ids from customer")
def _(spark, d):
    s = F.concat(F.lit("a GSM"), F.col("c_custkey").cast("string"), F.lit(", xGSM1 (GSM"), F.col("c_nationkey").cast("string"), F.lit(")"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(X.extract_all(s, "\\bGSM[0-9]+\\b"), ";").alias("ids"))


@R.add("fn_path_stem", "select c_custkey, 'sample.' || c_custkey as stem from customer")
def _(spark, d):
    path = F.concat(F.lit("/data/x/sample."), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".bed.gz").otherwise(".json"))
    return table(spark, d, "customer").select("c_custkey", X.path_stem(path).alias("stem"))


@R.add("fn_revcomp", sql("select doc_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) as rc from seqs", "seqs"))
def _(spark, d):
    return seqs(spark, d).select("doc_id", Q.revcomp(F.col("seq")).alias("rc"))


FIRST = "case when instr(seq, 'TTA') > 0 and instr(seq, 'GAA') > 0 then least(instr(seq, 'TTA'), instr(seq, 'GAA')) else greatest(instr(seq, 'TTA'), instr(seq, 'GAA')) end - 1"


@R.add("fn_find_first", sql(f"select doc_id, {FIRST} as pos from seqs", "seqs"))
def _(spark, d):
    return seqs(spark, d).select("doc_id", Q.find_first(F.col("seq"), ["TTA", "GAA"]).cast("long").alias("pos"))


@R.add("fn_trim_insert", sql(f"p as (select doc_id, seq, {FIRST} as pos from seqs) select doc_id, case when pos >= 0 then substr(seq, 1, pos) else seq end as kept from p", "seqs"))
def _(spark, d):
    return seqs(spark, d).select("doc_id", Q.trim_insert(F.col("seq"), ["TTA", "GAA"]).alias("kept"))


ADAPTERS = ["TTAGAACT", "GAATTCCA"]
TAIL = "G"


def _begins(adapter: str) -> str:
    """DuckDB: where an adapter begins in ``rest``, from 0; null where it doesn't."""
    n = len(adapter)
    both = f"least({n}, length(rest) - p)"
    return f"list_filter(range(0, length(rest) - 3), lambda p: hamming(substr(rest, p + 1, {both}), substr('{adapter}', 1, {both})) <= {both} // 8)[1]"


@R.add("ext_trim", sql(f"""b as (select run, seq, substr(seq, 1, 6) as umi, substr(seq, 7) as rest from seqs), a as (select run, umi, rest, least({_begins("TTAGAACT")}, {_begins("GAATTCCA")}) as pos from b),
 k as (select run, umi, pos, case when pos is null then rest else substr(rest, 1, pos) end as kept from a),
 l as (select *, regexp_extract(kept, '(G*([^G]G*){{0,5}})$', 1) as last from k),
 t as (select *, coalesce(list_max(list_filter(range(3, length(last) + 1), lambda n: last[length(last) - n + 1] = 'G' and length(replace(right(last, n), 'G', '')) <= least(5, n // 8))), 0) as tail from l)
 select run, count(*) as n, count(distinct umi) as n_umis, count(*) filter (pos is not null) as n_adapter, count(*) filter (tail > 0) as n_tail, count(*) filter (length(kept) - tail >= 18) as n_kept, cast(sum(length(kept) - tail) as bigint) as bases from t group by 1""", "seqs"))
def _(spark, d):
    """A barcode of six bases, either adapter with one mismatch in eight bases, then a tail of G, by run."""
    umi, rest = trim.split_barcode(F.col("seq"), 6)
    own = seqs(spark, d).filter("seq is not null").select("run", umi.alias("umi"), rest.alias("rest"))
    cut = own.withColumn("kept", trim.trim_adapters(F.col("rest"), ADAPTERS)).withColumn("tail", trim.tail_length(F.col("kept"), TAIL, least=3))
    length = F.length("kept") - F.col("tail")
    return cut.groupBy("run").agg(count(), F.countDistinct("umi").alias("n_umis"), F.count(F.when(F.length("kept") < F.length("rest"), 1)).alias("n_adapter"), F.count(F.when(F.col("tail") > 0, 1)).alias("n_tail"), F.count(F.when(length >= 18, 1)).alias("n_kept"), F.sum(length).alias("bases"))


MATES = """i as (select doc_id, substr(seq, 1, cast(30 + doc_id % 40 as int)) as ins, doc_id % 9 as wrong from seqs where length(seq) >= 70),
 m as (select doc_id, substr(ins || 'TTAGAACTGAATTCCATTAGAACTGAATTCCATTAGAACT', 1, 60) as r1, substr(translate(reverse(ins), 'ACGTN', 'TGCAN') || 'CCATTGGACCATTGGACCATTGGACCATTGGA', 1, 60) as r2, wrong from i),
 x as (select doc_id, case when wrong < 5 then substr(r1, 1, cast(wrong as int)) || translate(substr(r1, cast(wrong + 1 as int), 3), 'ACGT', 'CGTA') || substr(r1, cast(wrong + 4 as int)) else r1 end as r1, r2 from m)"""


@R.add("ext_trim_pairs", sql(MATES + """, y as (select doc_id, r1, translate(reverse(r2), 'ACGTN', 'TGCAN') as rc, length(r1) as a, length(r2) as b from x)
 select doc_id, cast(list_max(list_filter(range(30, least(a, b) + 1), lambda n: hamming(substr(r1, 1, n), substr(rc, b - n + 1, n)) <= least(5, n * 20 // 100))) as int) as insert_length from y""", "seqs"))
def _(spark, d):
    """Mates of inserts of 30 to 69 bases, sequenced into the adapters, some with three wrong bases; both run past the insert where it is shorter than 60."""
    s = seqs(spark, d).filter("length(seq) >= 70").selectExpr("doc_id", "substr(seq, 1, cast(30 + doc_id % 40 as int)) as ins", "doc_id % 9 as at")
    m = s.select("doc_id", "at", F.substring(F.concat("ins", F.lit("TTAGAACTGAATTCCA" * 2 + "TTAGAACT")), 1, 60).alias("r1"), F.substring(F.concat(Q.revcomp(F.col("ins")), F.lit("CCATTGGA" * 4)), 1, 60).alias("r2"))
    x = m.withColumn("r1", F.expr("case when at < 5 then concat(substr(r1, 1, cast(at as int)), translate(substr(r1, cast(at + 1 as int), 3), 'ACGT', 'CGTA'), substr(r1, cast(at + 4 as int))) else r1 end"))
    return x.select("doc_id", trim.insert_length(F.col("r1"), F.col("r2")).alias("insert_length"))


@R.add("fn_polyg", sql("select run, count(*) filter (where contains(seq, 'GGG')) as n_polyg, count(*) filter (where contains(seq, 'N')) as n_any_n from seqs group by 1", "seqs"))
def _(spark, d):
    return seqs(spark, d).groupBy("run").agg(F.count(F.when(F.col("seq").contains("GGG"), 1)).alias("n_polyg"), F.count(F.when(F.col("seq").contains("N"), 1)).alias("n_any_n"))


@R.add("fn_kmers", sql("b as (select seq from seqs union all select reverse(translate(seq, 'ACGTN', 'TGCAN')) from seqs), k as (select substr(seq, i, 20) as kmer from (select seq, unnest(range(1, length(seq) - 18)) as i from b where length(seq) >= 20)) select kmer, count(*) as n from k group by 1", "seqs"))
def _(spark, d):
    return kmers.count_kmers(seqs(spark, d), 20)


@R.add("fn_parse_region", "select c_custkey, 'chr' || c_nationkey as contig, case when c_custkey % 2 = 0 then c_custkey * 1000 end as first, case when c_custkey % 2 = 0 then c_custkey * 1000 + 500 end as last from customer")
def _(spark, d):
    c = F.concat(F.lit("chr"), F.col("c_nationkey").cast("string"))
    region = F.when(F.col("c_custkey") % 2 == 0, F.concat(c, F.lit(":"), F.format_number(F.col("c_custkey") * 1000, 0), F.lit("-"), F.format_number(F.col("c_custkey") * 1000 + 500, 0))).otherwise(c)
    return table(spark, d, "customer").select("c_custkey", X.parse_region(region).alias("r")).select("c_custkey", "r.contig", "r.first", "r.last")


@R.add("fn_gff_attr", "select c_custkey, c_name as name, case when c_custkey % 2 = 0 then cast(c_nationkey as varchar) end as id from customer")
def _(spark, d):
    attrs = F.concat(F.lit("Name="), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(";ID="), F.col("c_nationkey").cast("string"))).otherwise(""))
    t = table(spark, d, "customer").select("c_custkey", attrs.alias("a"))
    return t.select("c_custkey", X.gff_attr(F.col("a"), "Name").alias("name"), X.gff_attr(F.col("a"), "ID").alias("id"))


@R.add("fn_slug", "select n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') as slug from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.slug(F.col("n_name")).alias("slug"))


BASES = ", ".join(f"cast(length(seq) - length(replace(seq, '{b}', '')) as double) as n{b}" for b in "ACGT")


def base_counts():
    return [(F.length("seq") - F.length(F.regexp_replace("seq", b, ""))).cast("double") for b in "ACGT"]


ENT = "case when t > 0 then round(" + " + ".join(f"case when n{b} > 0 then -(n{b}/t)*log2(n{b}/t) else 0 end" for b in "ACGT") + ", 9) end"


@R.add("fn_entropy", sql(f"c as (select doc_id, {BASES} from seqs), s as (select *, nA + nC + nG + nT as t from c) select doc_id, {ENT} as bits from s", "seqs"))
def _(spark, d):
    return seqs(spark, d).select("doc_id", F.round(Q.entropy(base_counts()), 9).alias("bits"))


@R.add("fn_log2_ratio", "select event_id, round(log2((value + 1e-12) / (user_id + 1e-12)), 7) as r from events where value > 0 and user_id > 0")
def _(spark, d):
    return table(spark, d, "events").filter("value > 0 and user_id > 0").select("event_id", F.round(F.log2((F.col("value") + 1e-12) / (F.col("user_id") + 1e-12)), 7).alias("r"))


@R.add("fn_log1p", "select event_id, round(ln(1 + abs(value)), 9) as l, round(exp(-abs(value) / 1000), 9) as e from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.log1p(F.abs("value")), 9).alias("l"), F.round(F.exp(-F.abs("value") / 1000), 9).alias("e"))


@R.add("fn_log_softmax", """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 50) as e from embeddings), m as (select vec_id, e, list_max(e) as top from v),
 l as (select vec_id, list_transform(e, lambda x: x - top - ln(list_sum(list_transform(e, lambda y: exp(y - top))))) as l from m)
 select vec_id, round(list_min(l), 6) as lowest, round(list_max(l), 6) as highest, round(list_sum(list_transform(l, lambda x: exp(x))), 6) as total from l""")
def _(spark, d):
    logs = C.log_softmax(F.transform("embedding", lambda x: x.cast("double") * 50))
    own = table(spark, d, "embeddings").select("vec_id", logs.alias("l"))
    return own.select("vec_id", F.round(F.array_min("l"), 6).alias("lowest"), F.round(F.array_max("l"), 6).alias("highest"), F.round(F.aggregate(F.transform("l", F.exp), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@R.add("fn_num_or_null", "select doc_id, try_cast(trim(case when doc_id % 3 = 0 then ' ' || n_chars || ' ' when doc_id % 3 = 1 then 'n/a' else '' end) as double) as v from documents")
def _(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, "n/a").otherwise("")
    return table(spark, d, "documents").select("doc_id", X.number_or_null(s).alias("v"))


@R.add("fn_star_sa_prefix", "select n_nationkey, case n_regionkey when 0 then 'genome' when 1 then 'ensembl' else 'ucsc' end as prefix from nation")
def _(spark, d):
    style = F.create_map(*(F.lit(x) for kv in {0: "genome", 1: "ensembl", 2: "ucsc", 3: "ucsc", 4: "ucsc"}.items() for x in kv))
    found = style[F.col("n_regionkey").cast("int")]
    return table(spark, d, "nation").select("n_nationkey", F.when(found.isNull(), F.raise_error(F.lit("unknown naming style"))).otherwise(found).alias("prefix"))


@R.add("fn_ena_url", "select c_custkey, 'SRR' || (c_custkey * 997) as run, case when length('SRR' || (c_custkey * 997)) > 9 then '/vol/' || substr('SRR' || (c_custkey * 997), 1, 6) || '/' || lpad(substr('SRR' || (c_custkey * 997), 10), 3, '0') else '/vol/' || substr('SRR' || (c_custkey * 997), 1, 6) end as url from customer")
def _(spark, d):
    run = F.concat(F.lit("SRR"), (F.col("c_custkey") * 997).cast("string"))
    head = F.concat(F.lit("/vol/"), F.substring(run, 1, 6))
    return table(spark, d, "customer").select("c_custkey", run.alias("run"), F.when(F.length(run) > 9, F.concat(head, F.lit("/"), F.lpad(F.substring(run, 10, 99), 3, "0"))).otherwise(head).alias("url"))


@R.add("fn_md5", "select doc_id, md5(text) as digest from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.add("flt_acgt_window", sql("w as (select doc_id, i as start_pos, substr(seq, i + 1, 30) as s from (select doc_id, seq, unnest(range(0, length(seq), 30)) as i from seqs)) select doc_id, start_pos from w where length(s) = 30 and regexp_full_match(s, '[ACGT]*')", "seqs"))
def _(spark, d):
    """Windows of 30 bases side by side, over whole sequences."""
    tiles = seqs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit("(?s)(.{1,30})"), F.lit(1))).alias("i", "s"))
    return tiles.filter(Q.all_acgt(F.col("s"), 30)).select("doc_id", (F.col("i") * 30).cast("long").alias("start_pos"))


@R.add("flt_blank_onehot", sql("select doc_id, regexp_matches(seq, '[^ACGT]') as blank from seqs", "seqs"))
def _(spark, d):
    hot = Q.onehot(F.col("seq"))
    return seqs(spark, d).select("doc_id", (F.exists(hot, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x) == 0) & (F.length("seq") > 0)).alias("blank"))


@R.add("ml_onehot", sql("x as (select seq, unnest(range(1, length(seq) + 1)) as i from seqs) select substr(seq, i, 1) as base, i - 1 as pos, count(*) as n from x where substr(seq, i, 1) <> 'N' group by 1, 2", "seqs"))
def _(spark, d):
    hot = seqs(spark, d).select(F.posexplode(Q.onehot(F.col("seq"))).alias("pos", "hot"))
    one = hot.select("pos", F.explode(F.arrays_zip(F.array(*(F.lit(b) for b in "ACGT")).alias("b"), F.col("hot").alias("h"))).alias("z"))
    return one.filter("z.h = 1").groupBy(F.col("z.b").alias("base"), F.col("pos").cast("long").alias("pos")).agg(count())


@R.add("ml_freq_reference", sql("x as (select base, sum(n) as n from (select unnest(['A', 'C', 'G', 'T', 'N']) as base, unnest([length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', '')), length(seq) - length(replace(seq, 'N', ''))]) as n from seqs) group by 1 having sum(n) > 0) select base, round(n / (select sum(n) from x), 9) as freq from x", "seqs"))
def _(spark, d):
    counts = seqs(spark, d).select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), (F.length("seq") - F.length(F.regexp_replace("seq", b, ""))).alias("n")) for b in "ACGTN"))).alias("c"))
    by = counts.groupBy("c.base").agg(F.sum("c.n").alias("n")).filter("n > 0")
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("base", F.round(F.col("n") / F.col("all"), 9).alias("freq"))  # one row


@R.add("agg_base_histogram", sql("x as (select mate, i - 1 as pos, substr(seq, i, 1) as base from (select mate, seq, unnest(range(1, 13)) as i from seqs) where i <= length(seq)) select mate, pos, base, count(*) as n from x group by 1, 2, 3", "seqs"))
def _(spark, d):
    b = seqs(spark, d).filter("seq <> ''").select("mate", F.posexplode(F.split(F.substring("seq", 1, 12), "")).alias("pos", "base"))
    return b.groupBy("mate", F.col("pos").cast("long").alias("pos"), "base").agg(count())


def _umi(spark, d):
    b = seqs(spark, d).filter("seq <> ''").select("run", F.posexplode(F.split(F.substring("seq", 1, 12), "")).alias("pos", "base"))
    counts = [F.sum(F.when(F.col("base") == x, 1.0).otherwise(0.0)) for x in "ACGT"]
    by = b.groupBy("run", "pos").agg(*(c.alias(f"n{x}") for c, x in zip(counts, "ACGT", strict=True)))
    return by.select("run", "pos", Q.entropy([F.col(f"n{x}") for x in "ACGT"]).alias("bits"))


UMI = """x as (select run, i - 1 as pos, substr(seq, i, 1) as base from (select run, seq, unnest(range(1, 13)) as i from seqs) where i <= length(seq)),
 c as (select run, pos, """ + ", ".join(f"cast(count(*) filter (where base = '{b}') as double) as n{b}" for b in "ACGT") + " from x group by 1, 2), s as (select *, nA + nC + nG + nT as t from c), e as (select run, pos, " + ENT.replace("round(", "(").replace(", 9)", ")") + " as bits from s)"


@R.add("win_leading_run", sql(UMI + ", r as (select run, coalesce(min(case when bits < 1.7 or bits is null then pos end), count(*)) as n from e group by 1) select run, case when n >= 4 then n else 0 end as leading from r", "seqs"))
def _(spark, d):
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("bits", F.lit(0.0)).alias("bits")))), lambda s: s["bits"])
    return _umi(spark, d).groupBy("run").agg(arr.alias("bits")).select("run", Q.leading_run(F.col("bits"), 1.7, 4).cast("long").alias("leading"))


PAIR = "pr as (select a.vec_id, list_transform(a.embedding, lambda x: abs(cast(x as double))) as o, list_transform(b.embedding, lambda x: cast(x as double)) as p from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def pairs(spark, d):
    e = table(spark, d, "embeddings")
    dbl = lambda c: F.transform(c, lambda v: v.cast("double"))
    a = e.select("vec_id", F.transform(dbl(F.col("embedding")), lambda v: F.abs(v)).alias("o"))
    return a.join(e.select((F.col("vec_id") - 1).alias("vec_id"), dbl(F.col("embedding")).alias("p")), "vec_id")


@R.add("met_profile_pearson", "with " + PAIR + ", u as (select vec_id, unnest(o) as o, unnest(list_transform(p, lambda x: exp(x))) as p from pr) select vec_id, round(corr(o, p), 6) as r from u group by 1")
def _(spark, d):
    return pairs(spark, d).select("vec_id", F.round(C.array_pearson(F.col("o"), C.softmax(F.col("p"))), 6).alias("r"))


@R.add("met_profile_jsd", "with " + PAIR + """, n as (select vec_id, o, list_transform(p, lambda x: exp(x)) as p from pr), s as (select vec_id, unnest(o) / list_sum(o) as o, unnest(p) / list_sum(p) as p from n)
 select vec_id, round(sqrt(greatest(0, sum(case when o > 0 then o * ln(2*o/(o+p)) else 0 end + case when p > 0 then p * ln(2*p/(o+p)) else 0 end) / 2)), 6) as jsd from s group by 1""")
def _(spark, d):
    return pairs(spark, d).select("vec_id", F.round(C.jensen_shannon(C.normalised(F.col("o")), C.softmax(F.col("p"))), 6).alias("jsd"))


@R.add("met_track_gap", "with " + PAIR + ", u as (select vec_id, unnest(o) as o, unnest(p) as p from pr) select vec_id, round(corr(o, abs(p)), 6) as r, round(abs(sum(o) - sum(abs(p))), 4) as gap from u group by 1")
def _(spark, d):
    absp = F.transform("p", lambda v: F.abs(v))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return pairs(spark, d).select("vec_id", F.round(C.array_pearson(F.col("o"), absp), 6).alias("r"), F.round(F.abs(total(F.col("o")) - total(absp)), 4).alias("gap"))


TRACKS = """w as (select peak_idx as locus, chrom, greatest(0, (start_pos + end_pos) // 2 - 50) as s, (start_pos + end_pos) // 2 + 50 as e from peaks),
 five as (select chrom, strand, case when strand = '+' then start_pos else end_pos - 1 end as pos, sample from aln where mapq >= 255),
 ta as (select chrom, strand, pos, cast(count(*) as double) as v from five where sample <= 3 group by all), tb as (select chrom, strand, pos, cast(count(*) as double) as v from five where sample >= 2 group by all),
 g as (select locus, chrom, strand, unnest(range(s, e)) as pos from w, (values ('+'), ('-')) t(strand)),
 v as (select locus, coalesce(ta.v, 0) as a, coalesce(tb.v, 0) as b from g left join ta on ta.chrom = g.chrom and ta.strand = g.strand and ta.pos = g.pos left join tb on tb.chrom = g.chrom and tb.strand = g.strand and tb.pos = g.pos),
 k as (select locus, sum(a) as ca, sum(b) as cb, sum(exp(b)) as eb, min(a) < max(a) and min(b) < max(b) as varies, corr(a, b) as r from v group by 1),
 d as (select locus, a / ca as q, exp(b) / eb as p from v join k using (locus) where ca > 0),
 j as (select locus, sqrt(greatest(0, sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end)) / 2) as jsd from d group by 1),
 l as (select locus, ca as a_count, cb as b_count, case when varies then r end as profile_pearson, jsd as profile_jsd from k left join j using (locus))"""


def two_tracks(spark, d):
    """Peaks' windows and the counts of two sets of samples that share some."""
    mid = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    loci = view(spark, d, "peaks").select(F.col("peak_idx").alias("locus"), "chrom", F.greatest(F.lit(0), mid - 50).alias("start_pos"), (mid + 50).alias("end_pos"))
    aln = view(spark, d, "aln").filter("mapq >= 255")
    return loci, G.five_prime(aln.filter("sample <= 3")), G.five_prime(aln.filter("sample >= 2"))


@R.add("met_track_profiles", sql(TRACKS + " select locus, a_count, b_count, round(profile_pearson, 6) as profile_pearson, round(profile_jsd, 6) as profile_jsd from l", "peaks", "aln"))
def _(spark, d):
    return C.locus_scores(*two_tracks(spark, d)).withColumns({c: F.round(c, 6) for c in ("profile_pearson", "profile_jsd")})


@R.add("met_track_compare", sql(TRACKS + """, x as (select a_count, b_count, avg(i) over (partition by a_count) as ra, avg(h) over (partition by b_count) as rb from (select a_count, b_count, row_number() over (order by a_count) as i, row_number() over (order by b_count) as h from l))
 select 'profile_pearson' as metric, round(quantile_disc(profile_pearson, 0.5), 6) as value, count(profile_pearson) as n from l union all select 'profile_jsd', round(quantile_disc(profile_jsd, 0.5), 6), count(profile_jsd) from l
 union all select 'counts_pearson', round(corr(a_count, b_count), 6), count(*) from l union all select 'log_counts_pearson', round(corr(ln(1 + a_count), ln(1 + b_count)), 6), count(*) from l
 union all select 'counts_spearman', round(corr(ra, rb), 6), count(*) from x""", "peaks", "aln"))
def _(spark, d):
    return C.compare_tracks(*two_tracks(spark, d)).withColumn("value", F.round("value", 6))


@R.add("met_scaled_prediction", "with " + PAIR + ", n as (select vec_id, p, list_sum(list_transform(p, lambda x: exp(x))) as t, list_sum(o) as c from pr), u as (select vec_id, exp(unnest(p)) / t * c as v from n) select vec_id, round(sum(v), 5) as total, round(max(v), 5) as top from u group by 1")
def _(spark, d):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    scaled = pairs(spark, d).select("vec_id", C.softmax(F.col("p")).alias("s"), total(F.col("o")).alias("c")).select("vec_id", F.transform("s", lambda v: v * F.col("c")).alias("v"))
    return scaled.select("vec_id", F.round(total(F.col("v")), 5).alias("total"), F.round(F.array_max("v"), 5).alias("top"))


@R.add("ml_mean_over_folds", "with u as (select vec_id % 10 as locus, i, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)) select locus, i - 1 as pos, round(avg(v), 6) as mean from u group by 1, 2")
def _(spark, d):
    u = table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("locus"), F.posexplode("embedding").alias("pos", "v"))
    return u.groupBy("locus", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@R.add("met_counts_pearson", sql("select fold, round(corr(exp(profile_score / 1000 - 1), obs_counts), 6) as r from per_locus group by 1", "per_locus"))
def _(spark, d):
    return view(spark, d, "per_locus").groupBy("fold").agg(F.round(C.pearson(F.exp(F.col("profile_score") / 1000 - 1), F.col("obs_counts")), 6).alias("r"))


@R.add("met_log_counts_pearson", sql("select fold, round(corr(profile_score, ln(1 + obs_counts)), 6) as r from per_locus group by 1", "per_locus"))
def _(spark, d):
    return view(spark, d, "per_locus").groupBy("fold").agg(F.round(C.pearson(F.col("profile_score"), F.log1p("obs_counts")), 6).alias("r"))


def ranks(key: str) -> str:
    return f"r as (select {key} as k, rank() over (partition by {key} order by obs_counts) + (count(*) over (partition by {key}, obs_counts) - 1) / 2.0 as rx, rank() over (partition by {key} order by profile_score) + (count(*) over (partition by {key}, profile_score) - 1) / 2.0 as ry from per_locus)"


@R.add("met_counts_spearman", sql(ranks("fold") + " select k as fold, round(corr(rx, ry), 6) as rho, count(*) as n from r group by 1", "per_locus"))
def _(spark, d):
    return C.spearman(view(spark, d, "per_locus"), "obs_counts", "profile_score", ["fold"]).withColumn("rho", F.round("rho", 6))


@R.add("st_within_spearman", sql(ranks("experiment") + " select k as experiment, round(corr(rx, ry), 6) as rho, count(*) as n from r group by 1", "per_locus"))
def _(spark, d):
    return C.spearman(view(spark, d, "per_locus"), "obs_counts", "profile_score", ["experiment"]).withColumn("rho", F.round("rho", 6))


@R.add("met_pooled", sql("select round(corr(profile_score, obs_counts), 6) as r, round(median(profile_score), 6) as median_score, count(*) as n from per_locus", "per_locus"))
def _(spark, d):
    return view(spark, d, "per_locus").agg(F.round(C.pearson(F.col("profile_score"), F.col("obs_counts")), 6).alias("r"), F.round(F.median("profile_score"), 6).alias("median_score"), count())


@R.add("met_nan_share", sql("select fold, round(avg(case when event_id % 11 = 0 then 1.0 else 0.0 end), 9) as share from per_locus group by 1", "per_locus"))
def _(spark, d):
    score = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("profile_score"))
    return view(spark, d, "per_locus").groupBy("fold").agg(F.round(F.avg(F.isnan(score).cast("double")), 9).alias("share"))


@R.add("met_align_mask", sql("select peak_idx, chrom, start_pos, end_pos - start_pos as predicted from peaks where chrom in ('1', '2', '5') and qval < 0.08", "peaks"))
def _(spark, d):
    """Predictions, stored without coordinates in the order of the loci that were kept, put back to these by the mask."""
    p = view(spark, d, "peaks").filter("chrom in ('1', '2', '5')")
    loci = session.written(with_ordinal(p, "peak_idx", name="place", first=0).withColumn("place", F.col("place").cast("long")), "loci")
    predictions = with_ordinal(loci.filter("qval < 0.08").select("peak_idx", (F.col("end_pos") - F.col("start_pos")).alias("predicted")), "peak_idx", name="row", first=0).select("row", "predicted")
    return C.align_masked(loci.select("place", "peak_idx", "chrom", "start_pos"), loci.select("place", (F.col("qval") < 0.08).alias("kept")), predictions).select("peak_idx", "chrom", "start_pos", "predicted")


EDGES = "e as (select list_distinct([quantile_cont(obs_counts, k / 10.0) for k in range(11)]) as x from per_locus)"


@R.add("st_pooled_quantile_edges", sql("select unnest([0,1,2,3,4,5,6,7,8,9,10]) as k, unnest(quantile_cont(obs_counts, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1])) as edge from per_locus", "per_locus").replace("select unnest([0,1,2,3,4,5,6,7,8,9,10]) as k,", "select distinct"))
def _(spark, d):
    return C.quantile_edges(view(spark, d, "per_locus"), "obs_counts", 10).select(F.explode("edges").alias("edge"))


CELLS = """e as (select quantile_cont(obs_counts, [.2,.4,.6,.8]) as q, min(obs_counts) as lo, max(obs_counts) as hi from per_locus),
 g as (select p.*, cast((case when obs_counts >= q[1] then 1 else 0 end) + (case when obs_counts >= q[2] then 1 else 0 end) + (case when obs_counts >= q[3] then 1 else 0 end) + (case when obs_counts >= q[4] then 1 else 0 end) as bigint) as cell from per_locus p, e),
 m as (select cell, count(*) filter (where experiment = 'click') as n_a, count(*) filter (where experiment = 'view') as n_b, median(profile_score) filter (where experiment = 'click') as median_a, median(profile_score) filter (where experiment = 'view') as median_b from g group by 1),
 c as (select *, case when n_a = 0 or n_b = 0 then 'one-sided' when n_a < 50 or n_b < 50 then 'few' end as dropped from m)"""


def celled(spark, d):
    p = view(spark, d, "per_locus")
    edges = C.quantile_edges(p, "obs_counts", 5)
    return p.crossJoin(F.broadcast(edges)).withColumn("cell", C.digitize(F.col("edges"), F.col("obs_counts")).cast("long")).drop("edges")  # one row


def medians(spark, d):
    return C.cell_medians(celled(spark, d), "experiment", "cell", "profile_score", ("click", "view"), 50)


@R.add("st_digitize", sql(CELLS + " select event_id, cell from g", "per_locus"))
def _(spark, d):
    return celled(spark, d).select("event_id", "cell")


@R.add("st_cell_cross", sql(CELLS + " select event_id, cell * 5 + fold as crossed from g", "per_locus"))
def _(spark, d):
    return celled(spark, d).select("event_id", (F.col("cell") * 5 + F.col("fold")).alias("crossed"))


@R.add("st_cell_medians", sql(CELLS + " select cell, n_a, n_b, round(median_a, 6) as median_a, round(median_b, 6) as median_b, dropped from c", "per_locus"))
def _(spark, d):
    return medians(spark, d).withColumns({c: F.round(c, 6) for c in ("median_a", "median_b")})


@R.add("st_direct_standardise", sql(CELLS + ", u as (select *, n_a + n_b as w from c where dropped is null) select round(sum(median_a * w) / sum(w), 6) as std_a, round(sum(median_b * w) / sum(w), 6) as std_b, count(*) as n_cells, round((sum(median_a * w) / sum(w)) / (sum(median_b * w) / sum(w)), 6) as ratio from u", "per_locus"))
def _(spark, d):
    return C.direct_standardise(medians(spark, d)).withColumns({c: F.round(c, 6) for c in ("std_a", "std_b", "ratio")})


@R.add("st_ratio_iqr", sql(CELLS + ", q as (select median_a / median_b as r from c where dropped is null and median_b <> 0) select round(median(r), 6) as median_ratio, round(quantile_cont(r, 0.25), 6) as p25, round(quantile_cont(r, 0.75), 6) as p75, round(avg(case when r > 1 then 1.0 else 0.0 end), 6) as share_above from q", "per_locus"))
def _(spark, d):
    r = medians(spark, d).filter("dropped is null and median_b <> 0").select((F.col("median_a") / F.col("median_b")).alias("r"))
    return r.agg(F.round(F.median("r"), 6).alias("median_ratio"), F.round(F.expr("percentile(r, 0.25)"), 6).alias("p25"), F.round(F.expr("percentile(r, 0.75)"), 6).alias("p75"), F.round(F.avg((F.col("r") > 1).cast("double")), 6).alias("share_above"))


DELTA = "d as (select experiment, fold, round(avg(profile_score) filter (where event_id % 2 = 0) - avg(profile_score) filter (where event_id % 2 = 1), 6) as delta from per_locus group by 1, 2)"


def deltas(spark, d):
    a, b = (F.avg(F.when(F.col("event_id") % 2 == k, F.col("profile_score"))) for k in (0, 1))
    return view(spark, d, "per_locus").groupBy("experiment", "fold").agg(F.round(a - b, 6).alias("delta"))


@R.add("st_win_rate", sql(DELTA + " select experiment, count(*) as n, count(*) filter (where delta > 0) as n_better from d group by 1", "per_locus"))
def _(spark, d):
    return deltas(spark, d).groupBy("experiment").agg(count(), F.count(F.when(F.col("delta") > 0, 1)).alias("n_better"))


@R.add("st_wilcoxon", sql(DELTA + """, z as (select 'all' as k, delta, abs(delta) as a from d where delta <> 0), r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as r from z),
 s as (select k, count(*) as n, least(sum(case when delta > 0 then r else 0 end), sum(case when delta < 0 then r else 0 end)) as w, (select sum(t * t * t - t) from (select cast(count(*) as double) as t from z group by a)) as ties from r group by 1),
 v as (select *, n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48 as variance from s), y as (select k, n, w, case when n >= 6 and variance > 0 then abs(w - n * (n + 1) / 4.0) / sqrt(variance) end as z from v),
 u as (select *, 1 / (1 + 0.2316419 * z) as t from y)
 select k, n, w, round(z, 6) as z, round(2 * exp(-z * z / 2) / 2.50662827463100 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))), 6) as p from u""", "per_locus"))
def _(spark, d):
    return C.wilcoxon(deltas(spark, d).withColumn("k", F.lit("all")), "delta", ["k"]).select("k", "n", "w", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@R.add("st_strata", sql("""r as (select peak_idx, row_number() over (order by qval, peak_idx) - 1 as r, count(*) over () as n from peaks where pclass = 'uni'), q as (select peak_idx, case when r < n//4 then 'uniq1' when r < 2*n//4 then 'uniq2' when r < 3*n//4 then 'uniq3' else 'uniq4' end as stratum from r)
 select stratum, count(*) as n, cast(sum(peak_idx) as bigint) as places from (select peak_idx, pclass as stratum from peaks union all select * from q union all select peak_idx, case when peak_idx % 3 = 0 then 'bi_stringentqval' else 'bi_relaxed' end from peaks where pclass = 'bi') group by 1""", "peaks"))
def _(spark, d):
    p = view(spark, d, "peaks").withColumns({"strand": F.lit("+"), "label": F.when(F.col("peak_idx") % 3 == 0, "Stringent(qval)").otherwise("Relaxed")})
    return K.strata(p, 0.25).groupBy("stratum").agg(count(), F.sum("peak_idx").alias("places"))


@R.add("ml_fold_split", sql("t as (select unnest([0, 1, 2, 3, 4]) as i) select cast(i as bigint) as i, cast(f.fold as bigint) as fold, case when f.fold = i then 'test' when f.fold = (i + 1) % 5 then 'valid' else 'train' end as role from t, (select distinct fold from folds) f", "folds"))
def _(spark, d):
    return K.roles(view(spark, d, "folds").select("fold").distinct(), 5)


@R.add("ml_fold_loci", sql("select cast(i as bigint) as i, case when f.fold = i then 'test' when f.fold = (i + 1) % 5 then 'valid' else 'train' end as role, count(*) as n from peaks p join folds f using (chrom), (select unnest([0, 1, 2, 3, 4]) as i) group by 1, 2", "peaks", "folds"))
def _(spark, d):
    f = view(spark, d, "folds")
    r = K.roles(f.select("fold").distinct(), 5)
    return view(spark, d, "peaks").join(f, "chrom").join(r, "fold").groupBy("i", "role").agg(count())


@R.add("ml_all_folds", sql("select f.fold, string_agg(chrom, ',' order by chrom) as test_chroms, 'model_' || f.fold as model_path from folds f group by 1", "folds"))
def _(spark, d):
    return view(spark, d, "folds").groupBy("fold").agg(F.array_join(F.array_sort(F.collect_list("chrom")), ",").alias("test_chroms")).withColumn("model_path", F.concat(F.lit("model_"), F.col("fold").cast("string")))


SHUFFLED = "((grp + 1) * 2654435761 + cast(chrom as bigint) * 40503) % 4294967296"


@R.add("ml_greedy_bins", sql(f"""c as (select peak_idx, chrom, (start_pos + end_pos)//2 as center from peaks),
 g as (select *, sum(far) over (partition by chrom order by center, peak_idx) as grp from (select *, case when center - lag(center) over (partition by chrom order by center, peak_idx) <= 2514 then 0 else 1 end as far from c)),
 z as (select chrom, cast(grp as bigint) as grp, count(*) as n from g group by 1, 2),
 o as (select *, row_number() over (order by {SHUFFLED}, chrom, grp) as i from z),
 walk(i, fill, fold) as (select cast(0 as bigint), [0, 0, 0, 0, 0]::bigint[], cast(-1 as bigint)
   union all select o.i, list_transform([0, 1, 2, 3, 4], lambda k: fill[k + 1] + case when k + 1 = list_position(fill, list_min(fill)) then o.n else 0 end), list_position(fill, list_min(fill)) - 1 from walk w join o on o.i = w.i + 1)
 select o.chrom, o.grp, o.n, w.fold from o join walk w on w.i = o.i""", "peaks").replace("with ", "with recursive ", 1))
def _(spark, d):
    p = view(spark, d, "peaks").select("peak_idx", "chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("center"))
    sizes = I.gap_groups(p, 2514).groupBy("chrom", F.col("grp").cast("long").alias("grp")).agg(count())
    return K.greedy_bins(sizes, 5, order=F.expr(SHUFFLED))


PICK = "(cast(chrom as bigint) * 2654435761 + start_pos * 40503) % 4294967296"
LEVEL = "cast((cast(chrom as bigint) * 7919 + start_pos * 31) % 1000 as double)"
NEG = f"""tl as (select cast(doc_id as varchar) as chrom, i as start_pos, i + 50 as end_pos, substr(seq, i + 1, 50) as s from (select doc_id, seq, unnest(range(0, length(seq) - 49, 50)) as i from seqs where length(seq) >= 50)),
 pk as (select *, {LEVEL} as signal from (select cast(doc_id as varchar) as chrom, cast(25 as bigint) as start_pos, cast(75 as bigint) as end_pos, substr(seq, 26, 50) as s from seqs where doc_id % 4 = 0 and length(seq) >= 75)),
 tg as (select *, {LEVEL} as signal from tl),
 gc as (select chrom, start_pos, end_pos, signal, (50 - length(regexp_replace(s, '[GC]', '', 'g'))) * 100 // 100 as bin from tg where 50 - length(replace(s, 'N', '')) <= 5 and signal <= (select 0.9 * quantile_cont(signal + 500, 0.01) from pk)
   and not exists (select 1 from pk where pk.chrom = tg.chrom and pk.start_pos < tg.end_pos and tg.start_pos < pk.end_pos)),
 pb as (select (50 - length(regexp_replace(s, '[GC]', '', 'g'))) * 100 // 100 as bin, count(*) as quota from pk group by 1),
 ng as (select gc.chrom, gc.start_pos, gc.end_pos, cast(gc.bin as bigint) as bin, gc.signal from (select *, row_number() over (partition by bin order by {PICK}, start_pos) as rn from gc) gc join pb using (bin) where rn <= quota)"""


def neg_parts(spark, d):
    """Tiles of 50 bases of every sequence, and a peak in every fourth, with a made-up signal."""
    s = seqs(spark, d).select(F.col("doc_id").cast("string").alias("chrom"), "doc_id", "seq")
    tiles = s.select("chrom", F.posexplode(F.regexp_extract_all("seq", F.lit("(?s)(.{50})"), F.lit(1))).alias("i", "seq")).select("chrom", (F.col("i") * 50).cast("long").alias("start_pos"), "seq")
    peaks = s.filter("doc_id % 4 = 0 and length(seq) >= 75").select("chrom", F.lit(25).cast("long").alias("start_pos"), F.substring("seq", 26, 50).alias("seq"))
    add = lambda df: df.withColumns({"end_pos": F.col("start_pos") + 50, "signal": F.expr(LEVEL)})
    return add(tiles), add(peaks)


def neg_found(spark, d):
    tiles, peaks = neg_parts(spark, d)
    raised = peaks.withColumn("signal", F.col("signal") + 500)
    return K.negatives(tiles, raised, F.expr(PICK), beta=0.9), tiles, peaks


@R.add("ml_gc_match", sql(NEG + " select * from ng", "seqs"))
def _(spark, d):
    return neg_found(spark, d)[0]


@R.add("ml_neg_report", sql(NEG + """ select (select count(*) from ng) as n_negatives, (select count(*) from pk) as n_peaks, round((select count(*) from ng) / (select count(*) from pk), 6) as per_peak, cast(0 as double) as overlap_share,
 (select median(signal) from ng) as median_negatives, (select median(signal) from pk) as median_peaks, (select median(signal) from tg) as median_background, round((select median(signal) from ng) / (select median(signal) from tg), 6) as times_background""", "seqs"))
def _(spark, d):
    found, tiles, peaks = neg_found(spark, d)
    return K.negatives_report(found, peaks, tiles).withColumns({"per_peak": F.round("per_peak", 6), "times_background": F.round("times_background", 6)})


@R.add("ml_ratio_cap", "select n_nationkey, least(0.25, n_nationkey / cast(greatest(n_regionkey, 1) as double)) as ratio from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.least(F.lit(0.25), F.col("n_nationkey") / F.greatest("n_regionkey", F.lit(1))).alias("ratio"))


@R.add("ml_isotonic_guard", sql("""u as (select species, depth > 0 as up, abs(depth) as x, row_number() over (partition by species, depth > 0 order by abs(depth)) - 1 as i, count(*) over (partition by species, depth > 0) as n from experiments where depth <> 0),
 h as (select species, max(case when not up then -x end) as lower, max(case when up then x end) as upper from u where i = least(cast(floor(n * 0.75) as bigint), n - 1) group by 1)
 select s.species, coalesce(lower, cast('-inf' as double)) as lower, coalesce(upper, cast('inf' as double)) as upper from (select distinct species from experiments) s left join h using (species)""", "experiments"))
def _(spark, d):
    return C.one_signed_thresholds(view(spark, d, "experiments"), ["species"], "depth", 0.75)
