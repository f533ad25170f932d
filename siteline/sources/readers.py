"""Readers of the text formats, each with an explicit schema: chromosomes are strings, nothing is inferred.

Blank and comment lines are skipped where the format has them.  A line with too few fields gives
nulls, which the reader's filter drops where a field is required.  Missing paths raise as Spark's readers do.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.functions import text as X
from siteline.sources import records


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("f", F.split("value", "\t"))


def _at(k: int) -> Column:
    return F.try_element_at("f", F.lit(k))


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A manifest: a header line, every column a string, blank as null."""
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def params_json(spark: SparkSession, path: str, schema: str, overrides: dict) -> DataFrame:
    """Parameters, a null override keeping the file's value."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumns({k: F.coalesce(F.lit(v), F.col(k)) for k, v in overrides.items() if k in df.columns})


def bed3(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos of the first three columns."""
    df = _fields(spark.read.text(path).filter(~F.col("value").rlike("^\\s*(#|track|browser|$)")))
    return df.select(_at(1).alias("chrom"), _at(2).try_cast("long").alias("start_pos"), _at(3).try_cast("long").alias("end_pos"))


def bed_ragged(spark: SparkSession, path: str) -> DataFrame:
    """Lines of different widths: chrom, start_pos, end_pos, width, fields and the raw line."""
    df = _fields(spark.read.text(path).filter(~F.col("value").rlike("^\\s*(#|track|browser|$)")))
    return df.select(_at(1).alias("chrom"), _at(2).try_cast("long").alias("start_pos"), _at(3).try_cast("long").alias("end_pos"), F.size("f").alias("width"), F.col("f").alias("fields"), F.col("value").alias("raw"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (from 0, in the file's order) and line of small files; a file is one record, so as to keep its order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("ordinal", "line"))
    return whole.withColumn("ordinal", F.col("ordinal").cast("long"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, ordinal (from 0, in the file's order) and line of files of any size, read in splits.

    A split's lines come in order, so a line's number is its place in the split and the lines of
    the file's splits before it, which a first scan counts.  A compressed file is one split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("opens"), F.count("*").alias("n"))  # a row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.select("file", "block", "opens", before.alias("before")), ["file", "block"]).select("file", "block", (F.col("before") + F.col("at") - F.col("opens")).alias("ordinal"), "line")


def _records(own: DataFrame) -> DataFrame:
    part = lambda k: F.max(F.when(F.col("ordinal") % 4 == k, F.col("line")))
    four = own.groupBy("file", F.expr("ordinal div 4").alias("record")).agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("qual"))
    return four.select("file", F.col("record").alias("ordinal"), F.expr("substring(name, 2)").alias("name"), "seq", "qual").filter("seq is not null")


def fastq(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """file, ordinal, name, seq and qual of four-line records, of files of any size; the first ``first`` of each file if asked.

    For those, one task a file reads its splits in order and stops at the last line wanted.  All records are formed where
    they are read (see ``records``); only with more splits than may be broadcast are their lines exchanged.
    """
    if first is None:
        rows = records.raw(spark, path)
        splits = records.edges(rows)
        if splits.count() > records.BROADCAST_SPLITS:
            return _records(numbered_lines(spark, path))
        places = records.placed(splits)
        whole = records.inside(rows, places).join(places.select("split", "file"), "split")
        return whole.select("file", "ordinal", "name", "seq", "qual").unionByName(_records(records.crossing(places)))
    out = None
    for file in sorted(spark.read.text(path).inputFiles()):
        head = spark.read.text(file).coalesce(1).limit(4 * first)
        own = head.select(F.lit(file).alias("file"), F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("line"))
        out = own if out is None else out.unionByName(own)
    return _records(out if out is not None else numbered_lines(spark, path).drop("block"))


def fastq_budget(spark: SparkSession, paths: list[str], n: int) -> DataFrame:
    """The first n / len(paths) reads of each path; one that isn't there is skipped, but has its share."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, None
    for p in paths:
        if not hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p)):
            continue
        own = fastq(spark, p, n // max(1, len(paths)))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("none of the files is there")
    return out


def fasta(spark: SparkSession, path: str, wanted: list[str] | None = None, chunk: int = 1 << 16) -> DataFrame:
    """Contigs in chunks (chrom, chunk_id, chunk_start, seq upper-cased); only ``wanted`` ones if given.

    Files may be of any size and no contig is ever one row: a line learns its contig and its place in it from
    its own split and from one row for each split before it, and is cut at the chunks' bounds.
    """
    own = numbered_lines(spark, path)
    name = F.when(F.col("line").startswith(">"), F.regexp_extract("line", "^>(\\S+)", 1))
    split = Window.partitionBy("file", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    named = own.withColumns({"name": name, "open": F.last(name, ignorenulls=True).over(split), "bases": F.when(name.isNull(), F.length(F.trim("line"))).otherwise(0).cast("long")})
    # a split's row: the contig that it ends in, and the bases that it adds to it
    last = F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ordinal")))
    ends = named.groupBy("file", "block").agg(last.alias("ends"), F.sum(F.when(F.col("open").isNull(), F.col("bases")).otherwise(0)).alias("head"))
    tails = named.filter("open is not null").groupBy("file", "block", "open").agg(F.sum("bases").alias("tail"))
    ends = ends.join(tails.withColumnRenamed("open", "ends"), ["file", "block", "ends"], "left")
    order = Window.partitionBy("file").orderBy("block")
    carried = ends.withColumn("carried", F.last("ends", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = carried.withColumn("run", F.count("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)))  # splits that go on with one contig
    adds = F.when(F.col("ends").isNotNull(), F.col("tail")).otherwise(F.col("head"))
    within = Window.partitionBy("file", "carried_run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # bases of the carried contig before the split: the tail of the split that opened it and the heads of those between
    opened = run.withColumn("carried_run", F.col("run") + F.col("ends").isNotNull().cast("long")).withColumn("adds", F.coalesce(adds, F.lit(0)))
    opened = opened.withColumn("sum", F.sum("adds").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    done = opened.select("file", "block", "carried", F.coalesce(F.lag("sum").over(order), F.lit(0)).alias("done"))
    place = F.sum("bases").over(Window.partitionBy("file", "block", "open").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bases")
    placed = named.withColumn("place", place).join(done, ["file", "block"]).select(F.coalesce("open", "carried").alias("chrom"), F.when(F.col("open").isNull(), F.col("place") + F.col("done")).otherwise(F.col("place")).alias("place"), F.upper(F.trim("line")).alias("s"), "bases")
    body = placed.filter("chrom is not null and bases > 0")
    if wanted is not None:
        body = body.filter(F.col("chrom").isin(wanted))
    pieces = body.select("chrom", "place", "s", "bases", F.explode(F.sequence(F.floor(F.col("place") / chunk), F.floor((F.col("place") + F.col("bases") - 1) / chunk))).alias("chunk_id"))
    low = F.greatest(F.col("chunk_id") * chunk - F.col("place"), F.lit(0))
    high = F.least((F.col("chunk_id") + 1) * chunk - F.col("place"), F.col("bases"))
    cut = pieces.select("chrom", "chunk_id", F.struct(F.greatest("place", F.col("chunk_id") * chunk).alias("at"), F.substring("s", (low + 1).cast("int"), (high - low).cast("int")).alias("s")).alias("p"))
    whole = cut.groupBy("chrom", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias("seq"))  # a chunk at most
    return whole.select("chrom", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), "seq")


def fetch(genome: DataFrame, windows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``windows`` (window, chrom, start_pos, end_pos) with ``seq``, joined from the chunks that they touch; shorter where the contig ends."""
    touched = F.explode(F.sequence(F.floor(F.col("start_pos") / chunk), F.floor((F.col("end_pos") - 1) / chunk))).alias("chunk_id")
    w = windows.filter("start_pos < end_pos").select("window", "chrom", "start_pos", "end_pos", touched)
    low = F.greatest(F.col("start_pos") - F.col("chunk_start"), F.lit(0))
    part = F.substring("seq", (low + 1).cast("int"), (F.col("end_pos") - F.col("chunk_start") - low).cast("int"))
    pieces = w.join(genome, ["chrom", "chunk_id"]).select("window", F.struct("chunk_id", part.alias("s")).alias("p"))
    return windows.join(pieces.groupBy("window").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias("seq")), "window", "left")


def fai(spark: SparkSession, path: str, allowed: DataFrame) -> DataFrame:
    """chrom and size of the allowed contigs; raises, naming them, where some are absent."""
    df = _fields(spark.read.text(path)).select(_at(1).alias("chrom"), _at(2).try_cast("long").alias("size"))
    keep = allowed.select(F.col("chrom").cast("string")).distinct()
    absent = [r[0] for r in keep.join(df, "chrom", "left_anti").orderBy("chrom").limit(20).collect()]
    if absent:
        raise ValueError(f"contigs absent from the index: {', '.join(absent)}")
    return df.join(keep, "chrom", "left_semi")


def annotation(spark: SparkSession, path: str, coding_only: bool = False) -> DataFrame:
    """Distinct starts (chrom, tss, strand) of GTF transcripts or GFF3 genes; positions stay 1-based, as they are used."""
    df = _fields(spark.read.text(path).filter(~F.col("value").startswith("#"))).filter((F.size("f") >= 9) & _at(3).isin("transcript", "gene"))
    if coding_only:
        df = df.filter(_at(9).rlike("(gene_biotype|gene_type|biotype|transcript_type)[ =]\"?protein_coding"))
    is_gtf = _at(9).contains('gene_id "')
    df = df.filter(F.when(is_gtf, _at(3) == "transcript").otherwise(_at(3) == "gene"))
    tss = F.when(_at(7) == "+", _at(4)).otherwise(_at(5)).try_cast("long")
    return df.filter(_at(7).isin("+", "-")).select(_at(1).alias("chrom"), tss.alias("tss"), _at(7).alias("strand")).dropDuplicates()


def rrna_features(spark: SparkSession, path: str) -> DataFrame:
    """rRNA features of a GFF3: chrom, half-open bounds, name (Name, else ID) and whether 5S."""
    df = _fields(spark.read.text(path).filter(~F.col("value").startswith("#"))).filter((F.size("f") >= 9) & (_at(3) == "rRNA"))
    name = F.coalesce(X.gff_attr(_at(9), "Name"), X.gff_attr(_at(9), "ID"))
    return df.select(_at(1).alias("chrom"), (_at(4).try_cast("long") - 1).alias("start_pos"), _at(5).try_cast("long").alias("end_pos"), name.alias("name"), F.when(name.contains("5S") & ~name.contains("35S") & ~name.contains("25S"), "5s").otherwise("35s").alias("class"))


def star_log(spark: SparkSession, path: str) -> DataFrame:
    """file, input and uniquely mapped reads of aligner logs; null where a log lacks the line."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    number = F.regexp_extract("value", "\\|\\s*([0-9]+)\\s*$", 1).try_cast("long")
    get = lambda key: F.max(F.when(F.col("value").contains(key), number))
    return df.groupBy("file").agg(get("Number of input reads").alias("n_input"), get("Uniquely mapped reads number").alias("n_unique"))


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files with their ``file`` and its ``meta``: a map of the ``# key: value`` lines before the first other line, the last of a repeated key; empty without any."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("ordinal"), F.col("value").alias("line"))
    is_head = F.col("line").startswith("#")
    seen = df.groupBy("file").agg(F.min(F.when(~is_head, F.col("ordinal"))).alias("first"), F.collect_list(F.when(is_head, F.struct("ordinal", "line"))).alias("marked"))  # lines with a mark only
    head = seen.select("file", "first", F.explode("marked").alias("l")).select("file", "first", "l.*").filter(F.col("line").contains(":") & (F.col("first").isNull() | (F.col("ordinal") < F.col("first"))))
    pair = F.regexp_extract("line", "^#([^:]*):(.*)$", 1), F.regexp_extract("line", "^#([^:]*):(.*)$", 2)
    keys = head.select("file", F.trim(pair[0]).alias("k"), F.trim(pair[1]).alias("v"), "ordinal").groupBy("file", "k").agg(F.max_by("v", "ordinal").alias("v"))
    meta = keys.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))  # a file's head
    body = spark.read.csv(path, header=True, schema=schema, comment="#").select("*", F.col("_metadata.file_path").alias("file"))
    return body.join(meta, "file", "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """run_name (else the file's stem) and the genome-wide metrics of one document a file."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    run = F.coalesce(F.get_json_object("value", "$.run_name"), X.path_stem(F.col("file")))
    metrics = F.explode(F.from_json(F.get_json_object("value", "$.genome_wide"), "map<string, double>")).alias("metric", "value")
    return df.withColumn("run_name", run).select("run_name", metrics)


def stats_tables(spark: SparkSession, path: str, header: list[str], configured: DataFrame, name: Column | None = None) -> DataFrame:
    """One-row tables by experiment, named by ``name`` of ``file`` (its stem); those of no experiment in ``configured`` are skipped, another header or no row at all raises."""
    df = lines(spark, path).withColumn("experiment", X.path_stem(F.col("file")) if name is None else name).join(configured.select(F.col("experiment").cast("string")).distinct(), "experiment", "left_semi")
    if not df.filter((F.col("ordinal") == 0) & (F.col("line") != "\t".join(header))).isEmpty():
        raise ValueError("a stats table has another header")
    body = df.filter("ordinal > 0 and trim(line) <> ''").withColumn("f", F.split("line", "\t"))
    if body.isEmpty():
        raise ValueError("no stats rows")
    return body.select(F.coalesce(_at(header.index("experiment") + 1), "experiment").alias("experiment") if "experiment" in header else "experiment", *(F.nullif(_at(k + 1), F.lit("")).alias(c) for k, c in enumerate(header) if c != "experiment"))


def meme_motifs(spark: SparkSession, path: str) -> DataFrame:
    """file, whether it starts with the format's magic line, and its number of motifs."""
    return lines(spark, path).groupBy("file").agg(F.bool_or((F.col("ordinal") == 0) & F.col("line").startswith("MEME version")).alias("valid"), F.count(F.when(F.col("line").startswith("MOTIF "), 1)).alias("n_motifs"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file and md5 of whole files below a path; a file is one record, so it must be smaller than 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.md5("content").alias("md5"))


def npz(spark: SparkSession, path: str) -> DataFrame:
    """file, name, shape and values (row by row, as doubles) of the numeric arrays in numpy archives; an archive is one record, so it must be smaller than 2 GB."""
    schema = "file string, name string, shape array<long>, values array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(raw), allow_pickle=False) as held:
                    rows.extend((file, name, list(held[name].shape), held[name].astype(float).ravel()) for name in held.files if held[name].dtype.kind in "biuf")
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["file", "name", "shape", "values"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")
    return files.mapInArrow(run, schema)


def idxstats(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """file and mapped reads of index statistics (chrom, size, mapped, unmapped), of the chromosomes of ``keep`` if given; reads without a chromosome don't count."""
    df = _fields(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))).select("file", _at(1).alias("chrom"), _at(3).try_cast("long").alias("mapped"))
    own = df.filter("chrom <> '*'")
    if keep is not None:
        own = own.join(keep.select(F.col("chrom").cast("string")).distinct(), "chrom", "left_semi")
    sums = own.groupBy("file").agg(F.sum("mapped").alias("mapped"))
    return df.select("file").distinct().join(sums, "file", "left").select("file", F.coalesce("mapped", F.lit(0).cast("long")).alias("mapped"))


def first_layout(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """For each sample of ``candidates`` (sample, path, priority) the existing path of the best priority; none is null."""
    have = candidates.join(existing.select("path").distinct(), "path", "left_semi").groupBy("sample").agg(F.min_by("path", "priority").alias("path"))
    return candidates.select("sample").distinct().join(have, "sample", "left")


def config_tables(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """An experiment configuration, a JSON (or YAML, where a parser is installed) map of name to record, as rows."""
    try:
        import yaml

        parsed = yaml.safe_load(text)
    except ImportError:
        parsed = json.loads(text)
    rows = [(json.dumps(v | {"id": str(k)}),) for k, v in parsed.items()]
    return spark.createDataFrame(rows, "v string").select(F.from_json("v", schema).alias("r")).select("r.*")
