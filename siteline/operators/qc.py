"""Quality rules over one row an experiment or a file; null means not measured and raises no flag."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline.operators import kmers

# Fixed values of the rules.
MAP_FAIL, MAP_WARN = 25.0, 50.0
THIN_COVERAGE = 500
PEAK_FRACTION, SPECIES_LEAST = 0.5, 3
DIMER_INSERT, DIMER_PCT = 18, 25.0
ADAPTER_CONFLICT_PCT = 50.0
POLYG_PCT, LENGTH_OUTLIER = 5.0, 2.0
ADAPTERS = {"smallRNA_RA3": "TGGAATTCTCGGGTGCCAAGG", "truseq_universal": "AGATCGGAAGAGC", "nextera": "CTGTCTCTTATACACATCT"}
ADAPTER_PREFIX = 12
MATCH_FRACTION = 0.66
DEAD_CYCLE_FRACTION = 0.20
POLYG = "G" * 12


def adjusted_rate(unique_pct: Column, rrna_pct: Column) -> Column:
    """The mapping rate among reads that aren't rRNA; null where either isn't measured."""
    return F.when(unique_pct.isNotNull() & rrna_pct.isNotNull() & (rrna_pct < 100), F.least(F.lit(100.0), unique_pct / (1 - rrna_pct / 100)))


def _whole(x: Column) -> Column:
    """A number rounded half to even, as text."""
    return F.bround(x.cast("double"), 0).cast("long").cast("string")


def flags(stats: DataFrame, survey: DataFrame | None = None) -> DataFrame:
    """experiment, pct_unique_adj and qc_flags of ``stats`` (experiment, species, pct_unique, pct_rrna, reads_per_peak, peaks_total).

    ``survey`` has (experiment, problems): what ``survey_flags`` found, each a failure.  Flags are joined by
    commas, in the order of the rules; an experiment without figures has none.
    """
    medians = stats.filter("peaks_total <> 0").groupBy("species").agg(F.median("peaks_total").alias("med"), F.count("*").alias("n")).filter(F.col("n") >= SPECIES_LEAST).select("species", "med")
    adjusted = adjusted_rate(F.col("pct_unique"), F.col("pct_rrna"))
    rate, basis = F.coalesce(adjusted, F.col("pct_unique")), F.when(adjusted.isNotNull(), "adj").otherwise("raw")
    shown = F.concat(F.lit("("), _whole(rate), F.lit("%,"), basis, F.lit(")"))
    rules = [
        F.when(rate < MAP_FAIL, F.concat(F.lit("FAIL:very_low_mapping"), shown)).when(rate < MAP_WARN, F.concat(F.lit("WARN:low_mapping"), shown)),
        F.when(F.col("reads_per_peak") < THIN_COVERAGE, F.concat(F.lit("WARN:thin_coverage("), _whole(F.col("reads_per_peak")), F.lit("/peak)"))),
        F.when((F.col("peaks_total") != 0) & (F.col("med") != 0) & (F.col("peaks_total") < PEAK_FRACTION * F.col("med")), F.concat(F.lit("WARN:peaks_below_species("), _whole(F.col("peaks_total")), F.lit("v"), _whole(F.col("med")), F.lit(")"))),
    ]
    joined = stats.join(medians, "species", "left")
    if survey is not None:
        joined = joined.join(survey.select("experiment", "problems"), "experiment", "left")
        rules.append(F.array_join(F.transform("problems", lambda p: F.concat(F.lit("FAIL:"), p)), ","))
    said = F.array_join(F.filter(F.array(*rules), lambda r: r.isNotNull() & (r != "")), ",")
    return joined.select("experiment", F.round(adjusted, 1).alias("pct_unique_adj"), said.alias("qc_flags"))


def flag_report(flagged: DataFrame) -> DataFrame:
    """Experiments by severity."""
    level = F.when(F.col("qc_flags").contains("FAIL"), "FAIL").when(F.col("qc_flags") != "", "WARN").otherwise("ok")
    return flagged.groupBy(level.alias("severity")).agg(F.count("*").alias("n"))


def read_survey(reads: DataFrame, adapters: Mapping[str, str] = ADAPTERS, polyg: str = POLYG, keys: tuple[str, ...] = ("run", "mate")) -> DataFrame:
    """Nine statistics of each file's reads (keys, seq).

    Everything is read off one histogram of (kind, position) a file, counted before it is shuffled; its
    size is bounded by the read length.  The usual length is the shortest of the most frequent; adapters
    that are hit equally often go by the order given; medians are the upper ones.
    """
    s, none = F.col("seq"), F.array().cast("array<struct<kind:string,pos:int>>")
    event = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"))
    probes = {name: F.locate(text[:ADAPTER_PREFIX], s) for name, text in adapters.items()}
    n_at = F.array_compact(F.transform(F.split(s, ""), lambda c, i: F.when(c == "N", event("N", i + 1))))
    single = F.array_compact(F.array(event("length", F.length(s)), F.when(s.contains("N"), event("any N", F.lit(0))), F.when(s.contains(polyg), event("poly-G", F.lit(0))), *(F.when(at > 0, event(f"adapter {name}", at - 1)) for name, at in probes.items())))
    events = F.concat(single, F.when(s.contains("N"), n_at).otherwise(none))
    hist = reads.filter(s.isNotNull()).select(*keys, F.explode(events).alias("e")).groupBy(*keys, "e.kind", "e.pos").agg(F.count("*").alias("n"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    usual = F.max(F.when(F.col("kind") == "length", F.struct("n", (-F.col("pos")).alias("shorter"))))["shorter"]
    files = hist.groupBy(*keys).agg(total("length").alias("n_sampled"), (-usual).cast("long").alias("read_len"), total("any N").alias("any_n"), total("poly-G").alias("polyg"), *(total(f"adapter {a}").alias(f"hits {a}") for a in adapters))
    most = reduce(lambda a, b: F.greatest(a, b), (F.col(f"`hits {a}`") for a in adapters), F.lit(0))
    first = F.coalesce(*(F.when((F.col(f"`hits {a}`") == most) & (most > 0), a) for a in adapters), F.lit("none"))
    files = files.select(*keys, "n_sampled", "read_len", "any_n", "polyg", first.alias("best_adapter"), most.alias("hits"))
    own = hist.join(files, list(keys))
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    inserts = own.filter(F.col("kind") == F.concat(F.lit("adapter "), "best_adapter")).withColumn("so_far", so_far)
    inserts = inserts.groupBy(*keys).agg(F.min(F.when(F.col("so_far") > F.floor(F.col("hits") / 2), F.col("pos"))).cast("long").alias("median_insert"), F.sum(F.when(F.col("pos") < MATCH_FRACTION * F.col("read_len"), F.col("n")).otherwise(0)).alias("short"))
    dead = own.filter((F.col("kind") == "N") & (F.col("n") >= DEAD_CYCLE_FRACTION * F.col("n_sampled"))).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("dead_cycles"))
    pct = lambda c: 100.0 * F.coalesce(F.col(c), F.lit(0)) / F.col("n_sampled")
    return files.join(inserts, list(keys), "left").join(dead, list(keys), "left").select(
        *keys, "n_sampled", "read_len", "best_adapter", pct("hits").alias("pct_adapter"), "median_insert", pct("short").alias("pct_short_untrimmed"),
        F.coalesce("dead_cycles", F.lit("-")).alias("dead_cycles"), pct("any_n").alias("pct_any_n"), pct("polyg").alias("pct_polyg"),
    )


def interleave_suspect(survey: DataFrame) -> DataFrame:
    """``survey`` (run, mate, project, paired, n_sampled, read_len, pct_polyg) with why a first mate's file may hold two mates.

    The length rule compares with the median of the project's other runs, from the project's histogram of
    lengths less the run's own.  A null project is one project; paired deposits aren't suspected.
    """
    own = survey.withColumn("__p", F.coalesce("project", F.lit("")))
    measured = own.filter("n_sampled > 0 and read_len is not null")
    lengths = measured.groupBy("__p", "read_len").agg(F.count("*").alias("n")).withColumnRenamed("read_len", "l")
    mine = measured.groupBy("__p", "run", F.col("read_len").alias("l")).agg(F.count("*").alias("mine"))
    asked = measured.filter("mate = 'R1' and not coalesce(paired, false)").select("__p", "run").distinct()
    others = asked.join(lengths, "__p").join(mine, ["__p", "run", "l"], "left").withColumn("n", F.col("n") - F.coalesce("mine", F.lit(0))).filter("n > 0")
    medians = others.groupBy("__p", "run").agg(F.percentile("l", F.lit(0.5), F.col("n")).alias("peer_median"))
    may = (F.col("n_sampled") > 0) & (F.col("mate") == "R1") & ~F.coalesce("paired", F.lit(False))
    why = F.concat_ws(",", F.when(F.col("pct_polyg") >= POLYG_PCT, "polyg"), F.when(F.col("read_len") >= LENGTH_OUTLIER * F.col("peer_median"), "long_for_project"))
    return own.join(medians, ["__p", "run"], "left").select(*survey.columns, F.when(may, why).otherwise("").alias("interleave_suspect"))


def _other_adapter() -> Column:
    """Whether reads show an adapter other than the configured one, often enough."""
    got = F.trim(F.coalesce("best_adapter", F.lit("")))
    return (F.coalesce("adapter", F.lit("")) != "") & ~got.isin("", "none", "missing") & (got != F.col("adapter")) & (F.col("pct_adapter") >= ADAPTER_CONFLICT_PCT)


def adapter_conflicts(survey: DataFrame, adapters: DataFrame) -> DataFrame:
    """Every experiment of ``adapters`` (experiment, adapter) with ``configured``, ``n_runs`` measured, ``n_conflicts`` and ``measured``, what most of these show.

    ``survey`` has experiment, mate, n_sampled, best_adapter and pct_adapter.  Only first mates that were sampled count; a
    blank configured adapter leaves detection to the trimmer and conflicts with nothing.  Ties go to the first name.
    """
    first = survey.filter("n_sampled > 0 and mate = 'R1'").join(adapters, "experiment")
    got = F.trim("best_adapter")
    by = first.withColumn("other", F.coalesce(_other_adapter(), F.lit(False))).groupBy("experiment", "other", got.alias("got")).agg(F.count("*").alias("n"))
    sums = by.groupBy("experiment").agg(F.sum("n").alias("n_runs"), F.sum(F.when(F.col("other"), F.col("n"))).alias("n_conflicts"), F.min(F.when(F.col("other"), F.struct((-F.col("n")).alias("n"), "got"))).alias("w"))
    zero = F.lit(0).cast("long")
    return adapters.join(sums, "experiment", "left").select("experiment", F.coalesce("adapter", F.lit("")).alias("configured"), F.coalesce("n_runs", zero).alias("n_runs"), F.coalesce("n_conflicts", zero).alias("n_conflicts"), F.col("w.got").alias("measured"))


def survey_flags(survey: DataFrame, adapters: DataFrame) -> DataFrame:
    """experiment and ``problems`` of ``survey`` (experiment, run, mate, n_sampled, median_insert, pct_adapter, best_adapter, interleave_suspect, declared_interleaved).

    ``adapters`` has (experiment, adapter): the configured one, blank where none is.  Only first mates count.  Of
    contradicting adapters the one in most runs is named, the first by name among equals.
    """
    first = survey.filter("n_sampled > 0 and mate = 'R1'").join(adapters, "experiment", "left")
    dimer = (F.col("median_insert") < DIMER_INSERT) & (F.col("pct_adapter") >= DIMER_PCT)
    hidden = (F.coalesce("interleave_suspect", F.lit("")) != "") & (F.lower(F.coalesce("declared_interleaved", F.lit("no"))) != "yes")
    got = F.trim(F.coalesce("best_adapter", F.lit("")))
    other = _other_adapter()
    runs = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("run").cast("string")))), "/")
    listed = first.groupBy("experiment").agg(runs(dimer).alias("dimer"), runs(hidden).alias("hidden"))
    wrong = first.filter(other).groupBy("experiment", "adapter", got.alias("got")).agg(F.count("*").alias("n"))
    named = wrong.groupBy("experiment").agg(F.min(F.struct((-F.col("n")).alias("n"), "got", "adapter")).alias("w"))
    said = F.array(
        F.when(F.col("dimer") != "", F.concat(F.lit("dimer_run:"), "dimer")), F.when(F.col("hidden") != "", F.concat(F.lit("interleave_suspect:"), "hidden")),
        F.when(F.col("w").isNotNull(), F.concat(F.lit("adapter_mismatch(config="), F.col("w.adapter"), F.lit(",reads="), F.col("w.got"), F.lit(")"))),
    )
    return listed.join(named, "experiment", "left").select("experiment", F.array_compact(said).alias("problems"))


#: Which mate a barcode's place stands for.
UMI_MATES = {"read1": 1, "per_read": 1, "read2": 2}


def umi_verdict(expected: Column, detected: Column) -> Column:
    """``none`` where neither is there, ``undeclared`` where only the barcode is, ``match`` where lengths agree, else ``MISMATCH``; null where the file wasn't read."""
    return F.when(detected.isNull(), F.lit(None).cast("string")).when((expected == 0) & (detected == 0), "none").when(expected == 0, "undeclared").when(expected == detected, "match").otherwise("MISMATCH")


def umi_report(files: DataFrame, declared: DataFrame, mates: Mapping[str, int] = UMI_MATES) -> DataFrame:
    """``files`` (run, mate 1 or 2, detected) with the length expected on each mate and the verdict.

    ``declared`` has (run, umi_len, paired, place); a barcode is expected on the mate of its place only, and on the first of
    single reads.  A place that isn't known raises where it matters.
    """
    known = F.create_map(*(F.lit(x) for kv in mates.items() for x in kv))
    length = F.coalesce(F.col("umi_len"), F.lit(0)).cast("long")
    named = F.when(~F.coalesce("paired", F.lit(False)), F.lit(1)).otherwise(known[F.col("place")])
    mate = F.when(length == 0, F.lit(0)).when(named.isNull(), F.raise_error(F.concat(F.lit("unknown place of a barcode: "), F.coalesce("place", F.lit("none"))))).otherwise(named)
    joined = files.join(declared, "run", "left").withColumn("expected", F.when(F.col("mate") == mate, length).otherwise(F.lit(0)).cast("long"))
    return joined.select("run", "mate", "expected", F.col("detected").cast("long").alias("detected"), umi_verdict(F.col("expected"), F.col("detected")).alias("verdict"))


#: Reference k-mers, of 12 bytes each, that are sent to every task; where there may be more, they and the reads' are exchanged.
BLOCK_KMERS = 1 << 20


def classify_reads(reads: DataFrame, references: DataFrame, k: int, block_kmers: int = BLOCK_KMERS) -> DataFrame:
    """``reads`` (seq, index and more) without seq and index, with ``class``: that of its first k-mer that ``references`` (index, seq, class, priority) hold on either strand; else null.

    A read is looked up in the references of its own index; a frame without that column has one.  Where classes share a k-mer the lowest priority wins; a priority, 0 or more, belongs to one class.
    References of ``block_kmers`` k-mers at most are held by every task, and no read moves; beyond, blocks of reads ask for
    their k-mers round by round (``kmers.exchanged_hits``), and no task and no driver holds all references.
    """
    reads, references = (df if "index" in df.columns else df.withColumn("index", F.lit("")) for df in (reads, references))
    names = references.filter("priority is not null").groupBy(F.col("priority").cast("int").alias("priority")).agg(F.min("class").alias("class"))
    known = references.select(F.coalesce("index", F.lit("")).alias("index"), "seq", F.col("priority").cast("int").alias("priority")).filter((F.length("seq") >= k) & F.col("priority").isNotNull())
    kept = [c for c in reads.columns if c not in ("seq", "index")]
    own = reads.select(*kept, "seq", F.coalesce("index", F.lit("")).alias("index"))
    n = kmers.windows(known, k)
    if not n:
        return own.select(*kept, F.lit(None).cast("string").alias("class"))
    found = kmers.held_hits(own, known, k, kept) if n <= block_kmers else kmers.exchanged_hits(own, known, k, kept, n)
    return found.join(F.broadcast(names.withColumnRenamed("priority", "__priority")), "__priority", "left").select(*kept, "class")


RRNA = ("rrna_35s", "rrna_5s")
ORGANELLAR = "organellar"


def rrna_content(experiments: DataFrame, inserts: DataFrame, references: DataFrame, k: int, per: int | None = None) -> DataFrame:
    """A row an experiment: inserts scored, whether its species' index has rRNA, and percentages of each class and of all.

    ``experiments``: (experiment, index); ``inserts``: (experiment, read, seq), trimmed reads; ``references`` as for ``classify_reads``.
    Inserts shorter than ``k`` aren't scored; with ``per``, an experiment's first so many by ``read`` are (a sample, where one is wanted).
    Where nothing is scored, or the species has no index, ``n_scored`` is 0 and all else is null: unmeasured, not 0 %.
    ``rrna_indexed`` is ``no`` where the index holds organelles only.
    """
    indexed = references.filter(F.length("seq") >= k).groupBy(F.coalesce("index", F.lit("")).alias("index")).agg(F.bool_or(F.col("class").isin(*RRNA)).alias("has_rrna"))
    known = experiments.select("experiment", F.coalesce("index", F.lit("")).alias("index"))
    long = inserts.filter(F.length("seq") >= k).join(known.join(indexed, "index", "left_semi"), "experiment")
    if per is not None:
        long = long.withColumn("__n", F.row_number().over(Window.partitionBy("experiment").orderBy("read"))).filter(F.col("__n") <= per).drop("__n")
    named = classify_reads(long.select("experiment", "read", "seq", "index"), references, k)
    n = F.count("*")
    of = lambda *names: F.round(100.0 * F.count(F.when(F.col("class").isin(*names), 1)) / n, 2)
    rows = named.groupBy("experiment").agg(n.alias("n"), of("rrna_35s").alias("pct_rrna_35s"), of("rrna_5s").alias("pct_rrna_5s"), of(ORGANELLAR).alias("pct_organellar"), of(*RRNA, ORGANELLAR).alias("pct_rrna_total"))
    told = known.join(indexed, "index", "left").join(rows, "experiment", "left")
    return told.select(
        "experiment", F.coalesce("n", F.lit(0)).alias("n_scored"), F.when(F.col("n").isNotNull(), F.when(F.col("has_rrna"), "yes").otherwise("no")).alias("rrna_indexed"),
        "pct_rrna_35s", "pct_rrna_5s", "pct_organellar", "pct_rrna_total",
    )


def resolution_basis(names: DataFrame) -> DataFrame:
    """``names`` (name, sample) with whether the name is that of one sample only."""
    n = names.groupBy("name").agg(F.countDistinct("sample").alias("n"))
    return names.join(n, "name").select("name", "sample", F.when(F.col("n") == 1, "unique").otherwise("AMBIGUOUS").alias("basis"))
