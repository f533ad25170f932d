"""Writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed list of columns; extra ones are dropped, nulls are blank."""
    df.select(*columns).write.csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def bed_gz(df: DataFrame, path: str) -> None:
    """Raw lines as they were, or else the first three columns."""
    value = F.col("raw") if "raw" in df.columns else F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"))
    df.select(value.alias("value")).write.text(path, compression="gzip")


def metrics_json(per_fold: DataFrame) -> DataFrame:
    """One JSON document a run, from (run_name, fold, metric, value)."""
    folds = per_fold.groupBy("run_name", "fold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    runs = folds.groupBy("run_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("fold").cast("string").alias("k"), F.col("m").alias("v")), ), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))).alias("per_fold"))
    return runs.select("run_name", F.to_json(F.struct("run_name", "per_fold")).alias("json"))


def per_locus(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Numbers as text with at most six significant digits, without trailing zeros."""
    short = lambda s: F.regexp_replace(F.regexp_replace(s, "(\\.[0-9]*?)0+(e.*)?$", "$1$2"), "\\.(e.*)?$", "$1")
    return df.withColumns({c: F.when(F.col(c).isNotNull(), short(F.format_string("%.6g", F.col(c).cast("double")))) for c in numbers})


def markdown(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows as table lines; counts of reads (names ending in ``_reads``) in millions."""
    cell = lambda c: F.coalesce(F.format_string("%.1fM", F.col(c) / 1e6) if c.endswith("_reads") else F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("line"))


def strata(df: DataFrame, path: str) -> None:
    """Raw lines, a folder a stratum."""
    df.select("stratum", F.col("raw").alias("value")).write.partitionBy("stratum").text(path)


def commented_csv(df: DataFrame, by: str, meta: str, order: list[str], path: str) -> None:
    """A CSV file a value of ``by``, in a folder of its own: ``# key: value`` lines from the map ``meta`` (one a value), a header, and the rest of the columns in ``order``.

    A file is written by one task as a stream sorted on disk; the format has no other way to keep its head and order.
    """
    body = [c for c in df.columns if c not in (by, meta)]
    of = lambda kind, *what: F.struct(F.lit(kind).alias("kind"), *what)
    at = [F.col(c).alias(f"o{k}") for k, c in enumerate(order)]
    rows = df.select(by, F.lit(2).alias("kind"), *at, F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in body)).alias("value"))
    one = df.groupBy(by).agg(F.first(meta).alias("m"))
    heads = F.transform(F.map_entries("m"), lambda e: of(0, F.concat(F.lit("# "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))).alias("value")))
    columns = F.array(of(1, F.lit(",".join(body)).alias("value")))
    head = one.select(by, F.explode(F.concat(F.coalesce(heads, F.array().cast("array<struct<kind:int,value:string>>")), columns)).alias("h")).select(by, "h.*")
    every = rows.unionByName(head, allowMissingColumns=True).repartition(by).sortWithinPartitions(by, "kind", *(f"o{k}" for k in range(len(order))), "value")
    every.select(by, "value").write.partitionBy(by).text(path)


def put_bytes(spark: SparkSession, raw: bytes, path: str) -> None:
    """A small file of bytes, whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hadoop.Path(f"{path}.incoming"), True)
    out.write(bytearray(raw))
    out.close()
    fs.rename(hadoop.Path(f"{path}.incoming"), hadoop.Path(path))


def one_file(df: DataFrame, path: str) -> None:
    """The lines of a small table (value) as one file of that name, put there whole by a rename."""
    spark = df.sparkSession
    staged = f"{path}.incoming"
    df.coalesce(1).write.text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(str(f.getPath()) for f in fs.listStatus(hadoop.Path(staged)) if f.getPath().getName().startswith("part-"))
    fs.rename(hadoop.Path(part), hadoop.Path(path))
    fs.delete(hadoop.Path(staged), True)
