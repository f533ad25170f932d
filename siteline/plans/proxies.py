"""The driver's tables seen as the engine's own: the views that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteline import session
from siteline.operators.ordinal import with_ordinal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_PEAK_ORDER = "l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
_PEAKS = """
select {idx} cast(l_suppkey % 7 as string) as chrom, l_orderkey*20 as start_pos,
       l_orderkey*20 + cast(floor(l_quantity) as bigint) as end_pos,
       l_discount as qval, case when l_returnflag='N' then 'uni' else 'bi' end as pclass {rest}
from lineitem where l_linenumber = 1"""
VIEWS = {
    "aln": """
select cast(l_suppkey % 7 as string) as chrom, l_orderkey*20 as start_pos, l_orderkey*20 + cast(floor(l_quantity) as bigint) as end_pos,
       case when l_linestatus='O' then '+' else '-' end as strand, case when l_linenumber <= 5 then 255 else 3 end as mapq,
       case l_returnflag when 'A' then 64 when 'R' then 128 else 0 end as flag, cast(l_partkey % 16 as string) as umi,
       cast(l_linenumber as bigint) as sample
from lineitem""",
    "peaks": _PEAKS.format(idx=f"cast(row_number() over (order by {_PEAK_ORDER}) as bigint) as peak_idx,", rest=""),
    "tss": """
select cast(o_custkey % 7 as string) as chrom, o_orderkey*20+7 as pos, case when o_orderstatus='F' then '+' else '-' end as strand from orders""",
    "experiments": """
select s_suppkey as experiment, n_name as species, n_regionkey as taxon, cast(s_acctbal as double) as depth
from supplier join nation on s_nationkey = n_nationkey""",
    "folds": "select distinct cast(l_suppkey % 7 as string) as chrom, cast((l_suppkey % 7) % 5 as bigint) as fold from lineitem",
    "per_locus": """
select event_id, event_type as experiment, cast(user_id % 5 as bigint) as fold, cast(value as double) as profile_score, cast(user_id as double) as obs_counts from events""",
    "seqs": "select doc_id, source as run, lang as mate, regexp_replace(upper(text),'[^ACGTN]',''{g}) as seq from documents",
    "sizes": "select cast(l_suppkey % 7 as string) as chrom, max(l_orderkey)*20 + 100 as size from lineitem group by 1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_peaks(spark: SparkSession) -> DataFrame:
    raw = spark.sql(_PEAKS.format(idx="", rest=", " + _PEAK_ORDER))
    out = with_ordinal(raw, *_PEAK_ORDER.split(", "), name="peak_idx")
    return out.selectExpr("cast(peak_idx as bigint) as peak_idx", "chrom", "start_pos", "end_pos", "qval", "pclass")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy view as a DataFrame; peaks are numbered without a single task."""
    for t in TABLES:
        if f" {t}" in VIEWS[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    if name == "peaks":
        return _numbered_peaks(spark)
    found = spark.sql(VIEWS[name].replace("{g}", ""))
    if name == "seqs":  # its expression would be run again for every use of a sequence
        few = found.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism  # a small table in one file
        return session.written(found.repartition(spark.sparkContext.defaultParallelism) if few else found, "seqs")
    return found


def sql(body: str, *names: str) -> str:
    """DuckDB SQL of ``body`` with the named views before it."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].replace('{g}', ", 'g'")})" for n in names) + (", " + body if not body.lstrip().lower().startswith("select") else " " + body)
