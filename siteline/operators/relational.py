"""Filters, joins, aggregates and set operations that the data model needs beyond plain DataFrame calls."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def keep(df: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Rows whose key is exactly one of ``allowed``; keys compare as strings."""
    return df.withColumn(on, F.col(on).cast("string")).join(allowed.select(F.col(on).cast("string")).distinct(), on, "left_semi")


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``; a key that ``right`` holds more than once gives nulls, never more rows."""
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in columns)).select(*keys, *(F.when(F.col("__n") == 1, F.col(c)).alias(c) for c in columns))
    return left.join(once, keys, "left")


def cascade(left: DataFrame, rules: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The value and name of the first rule that finds ``key``; each rule is (name, lookup of key and value), key by key unique."""
    out = left
    for k, (_, lookup) in enumerate(rules):
        out = out.join(lookup.select(F.col(key), F.col(value).alias(f"__v{k}")), key, "left")
    found = F.coalesce(*(F.col(f"__v{k}") for k in range(len(rules))))
    basis = reduce(lambda c, k: c.when(F.col(f"__v{k}").isNotNull(), rules[k][0]), range(1, len(rules)), F.when(F.col("__v0").isNotNull(), rules[0][0])).otherwise("UNRESOLVED")
    return out.select(*left.columns, found.alias(value), basis.alias("basis"))


def run_files(manifest: DataFrame) -> DataFrame:
    """run, url and md5 of ``manifest`` (runs, urls, md5s; each joined by semicolons), each once.

    A file is the run's if its path has the run as a folder or its name starts with it.  Files are exploded
    beside their own row's runs, so that no two rows meet.
    """
    named = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")
    files = F.arrays_zip(named(F.col("urls")).alias("url"), named(F.col("md5s")).alias("md5"))
    each = manifest.select(F.explode(named(F.col("runs"))).alias("run"), files.alias("f")).select("run", F.explode("f").alias("f")).select("run", "f.url", F.coalesce("f.md5", F.lit("")).alias("md5"))
    own = F.col("url").contains(F.concat(F.lit("/"), "run", F.lit("/"))) | F.regexp_extract("url", "([^/]*)$", 1).startswith(F.col("run"))
    return each.filter(own).distinct()


def counts_with_zeros(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every key of ``dimension`` with its number of facts, 0 included, and its share."""
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    total = facts.agg(F.count("*").alias("all"))
    joined = dimension.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.crossJoin(F.broadcast(total)).select(key, "n", F.when(F.col("all") > 0, F.col("n") / F.col("all")).alias("share"))  # one row


def experiment_rows(experiments: DataFrame, logs: DataFrame, mapped: DataFrame, main: DataFrame, peaks: DataFrame) -> DataFrame:
    """The 18 columns of an experiment; what isn't measured is null, never 0.

    ``experiments``: experiment, species, tier, assay_family, layout, umi_enabled, n_samples, n_runs, archive_reads;
    ``logs``: experiment, input, unique (a row an aligned sample); ``mapped``: experiment, chrom, reads;
    ``main``: species, chrom, the chromosomes that count (a species without any counts all); ``peaks``: experiment, pclass.
    """
    of_log = logs.groupBy("experiment").agg(F.sum("input").alias("input_reads"), F.sum("unique").alias("unique_reads"))
    named = mapped.join(experiments.select("experiment", "species"), "experiment")
    listed = main.select("species").distinct().withColumn("listed", F.lit(True))
    kept = named.join(main.select("species", "chrom", F.lit(True).alias("is_main")).distinct(), ["species", "chrom"], "left").join(listed, "species", "left").filter("listed is null or is_main")
    of_signal = named.select("experiment").distinct().join(kept.groupBy("experiment").agg(F.sum("reads").alias("signal_reads")), "experiment", "left").withColumn("signal_reads", F.coalesce("signal_reads", F.lit(0).cast("long")))
    of_peaks = peaks.groupBy("experiment").agg(F.count("*").alias("peaks_total"), F.count(F.when(F.col("pclass") == "uni", 1)).alias("peaks_unidirectional"), F.count(F.when(F.col("pclass") == "bi", 1)).alias("peaks_bidirectional"))
    all_ = experiments
    for part in (of_log, of_signal, of_peaks):
        all_ = all_.join(part, "experiment", "left")
    pct = lambda a, b: F.when(F.col(b) != 0, F.round(100.0 * F.col(a) / F.col(b), 1))
    per_peak = F.when((F.col("signal_reads") != 0) & (F.col("peaks_total") != 0), F.bround(F.col("signal_reads") / F.col("peaks_total"), 0).cast("long"))
    return all_.select(
        "experiment", "species", "tier", "assay_family", "layout", F.when(F.col("umi_enabled"), "yes").otherwise("no").alias("has_umi"), "n_samples", "n_runs", "archive_reads",
        "input_reads", "unique_reads", pct("unique_reads", "input_reads").alias("pct_unique"), "signal_reads", pct("signal_reads", "unique_reads").alias("pct_signal_of_unique"),
        "peaks_total", "peaks_unidirectional", "peaks_bidirectional", per_peak.alias("reads_per_peak"),
    )


def transfers(expected: DataFrame, have: DataFrame, staged: DataFrame, force: bool = False, dry_run: bool = False, verify_only: bool = False) -> DataFrame:
    """file and status of ``expected`` (file, md5): what a transfer does, or has done, with each.

    ``have`` (file, md5) are the complete files, ``staged`` (file, md5) what a transfer left; an expected file without
    a published md5 is ``kept`` as it is.  ok and CORRUPT compare digests; ``missing``, ``would fetch``, ``FAILED`` and
    ``fetched`` are of files that aren't there or, unless only verified, don't match.
    """
    all_ = expected.select("file", F.coalesce("md5", F.lit("")).alias("md5")).join(have.select("file", F.col("md5").alias("old")), "file", "left").join(staged.select("file", F.col("md5").alias("new")), "file", "left")
    here, same = F.col("old").isNotNull() & F.lit(not force), F.col("old") == F.col("md5")
    found = F.when(F.col("md5") == "", "kept").when(same | F.lit(dry_run), "ok")
    if verify_only:
        status = F.when(here, F.coalesce(found, F.lit("CORRUPT"))).otherwise("missing")
    else:
        fetched = F.lit("would fetch") if dry_run else F.when(F.col("new").isNull(), "FAILED").when((F.col("md5") != "") & (F.col("new") != F.col("md5")), "CORRUPT").otherwise("fetched")
        status = F.coalesce(F.when(here, found), fetched)
    return all_.select("file", status.alias("status"))


def upper_median(values: Column) -> Column:
    """The element at half the count of a sorted array: the upper one, no average."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def difference_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (repeats counted) in one and not in the other, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("only_left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right")))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def digest(df: DataFrame, line: Column, order: str, keys: list[str]) -> DataFrame:
    """sha256 over the ordered lines of each key; lines of equal order follow their bytes, null lines are empty.

    A digest of a sequence can't be put together from parts, so a key is one task's stream: sorted on disk,
    read batch by batch into a running hash, never held.
    """
    sorted_ = df.select(*keys, F.col(order).alias("__order"), F.coalesce(line, F.lit("")).alias("__line")).repartition(*keys).sortWithinPartitions(*keys, "__order", "__line").select(*keys, "__line")
    kinds = sorted_.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, schema = None, None, None
        end = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(last, schema, strict=True)), pa.array([state.hexdigest()])], [*keys, "digest"])
        for batch in batches:
            schema = [batch.schema.field(k) for k in range(len(keys))]
            columns = [batch.column(k).to_pylist() for k in range(len(keys))]
            for *key, text in zip(*columns, batch.column(len(keys)).to_pylist(), strict=True):
                if key != last:
                    if state is not None:
                        yield end()
                    last, state = key, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield end()

    return sorted_.mapInArrow(run, StructType([*kinds.fields, StructField("digest", StringType())]))


def severity(flags: Column) -> Column:
    return F.when(flags.contains("FAIL"), 0).when(flags.contains("WARN"), 1).otherwise(2)


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames, columns by name; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
