"""What there is to run, what it needs and where it goes: plans as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The inputs that training and quality control need, in the order in which they are named.
TRAINING_INPUTS = ("peaks", "sequences", "gc_negatives", "signals", "controls", "blacklist")
QC_INPUTS = ("peaks", "sequences", "signals")
#: Kinds of which an experiment may have several; their labels carry a number.
SEVERAL = ("signals", "controls", "blacklist")
#: What each named rule asks for: files of each experiment, and files in all.
RULES = {
    "all": (("{}_pl.bw", "{}_mn.bw", "{}_peaks.bed.gz", "orientation/{}.tsv", "umi/{}.tsv", "rrna/{}.tsv", "reads/{}.tsv"), ("stats/experiment_stats.tsv",)),
    "qc": (("orientation/{}.tsv", "umi/{}.tsv", "rrna/{}.tsv", "reads/{}.tsv"), ("stats/experiment_stats.tsv",)),
    "stats": ((), ("stats/experiment_stats.tsv", "stats/experiment_stats.md")),
    "orientation": (("orientation/{}.tsv", "orientation/{}.orientation_qc.png"), ()),
    "signal_only": (("{}_pl.bw", "{}_mn.bw"), ()),
    "fetch_only": ((), ()),
    "blacklists": ((), ()),
}


def job_plan(experiments: DataFrame, missing: DataFrame, done: DataFrame) -> DataFrame:
    """A row a job: experiment, fold and ``reason`` (run, trained, missing data, or unusable where the number of folds isn't known).

    ``experiments``: experiment, n_folds; ``missing``: experiment, of those that lack an input; ``done``: experiment, fold.
    """
    usable = experiments.filter("n_folds > 0").select("experiment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_folds").cast("long") - 1)).alias("fold"))
    lacking = missing.select("experiment").distinct().withColumn("lacking", F.lit(True))
    trained = done.select("experiment", F.col("fold").cast("long").alias("fold")).distinct().withColumn("trained", F.lit(True))
    reason = F.when(F.col("lacking"), "missing data").when(F.col("trained"), "trained").otherwise("run")
    jobs = usable.join(lacking, "experiment", "left").join(trained, ["experiment", "fold"], "left").select("experiment", "fold", reason.alias("reason"))
    return jobs.unionByName(experiments.filter("coalesce(n_folds, 0) <= 0").select("experiment", F.lit(None).cast("long").alias("fold"), F.lit("unusable").alias("reason")))


def missing_inputs(inputs: DataFrame, existing: DataFrame, kinds: tuple[str, ...] = TRAINING_INPUTS) -> DataFrame:
    """experiment and ``missing``, the labelled paths of ``inputs`` (experiment, kind, place, path) that aren't among ``existing`` (path).

    A null path is missing; kinds that aren't asked for don't count; an experiment that lacks nothing has an empty list.
    """
    rank = reduce(lambda c, k: c.when(F.col("kind") == kinds[k], k), range(1, len(kinds)), F.when(F.col("kind") == kinds[0], 0))
    label = F.when(F.col("kind").isin(*SEVERAL), F.concat("kind", F.lit("["), F.col("place").cast("string"), F.lit("]"))).otherwise(F.col("kind"))
    there = existing.select("path", F.lit(True).alias("there")).dropna().distinct()
    asked = inputs.filter(F.col("kind").isin(*kinds)).join(there, "path", "left")
    said = F.struct(rank.alias("rank"), F.col("place").alias("place"), F.concat(label, F.lit(": "), F.coalesce("path", F.lit("none"))).alias("said"))
    lacking = asked.filter("there is null").groupBy("experiment").agg(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["said"]).alias("missing"))  # an experiment's inputs are few
    return inputs.select("experiment").distinct().join(lacking, "experiment", "left").select("experiment", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def artifact_paths(experiment: Column, family: Column, fold: Column, suffix: Column | None = None) -> dict[str, Column]:
    """Where an experiment's artifacts go, by name."""
    tail = F.lit("") if suffix is None else suffix
    path = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    folder = path("models/", family, "/", experiment, tail)
    name = path(folder, "/", experiment, ".fold", fold)
    return {
        "model_dir": folder, "model_name": name, "model_path": path(name, ".torch"), "final_path": path(name, ".final.torch"),
        "filtered_loci": path("attributions/", experiment, "_filtered.bed"), "onehot": path("attributions/", experiment, "_ohe.npz"), "metrics": path("benchmarks/", family, "/", experiment, ".json"),
    }


def rule_targets(experiments: DataFrame, blacklists: DataFrame, fetched: DataFrame) -> DataFrame:
    """rule and target of every named rule, each once.

    ``experiments`` (experiment); ``blacklists`` (target) belong to all rules that fetch or finish inputs; ``fetched``
    (target), the reads and genomes of the experiments, to the one that only fetches.
    """
    each = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name")) for rule, (own, _) in RULES.items() for name in own))
    once = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("target")) for rule, (_, whole) in RULES.items() for name in whole))
    own = experiments.select("experiment", F.explode(each).alias("e")).select("e.rule", F.replace("e.name", F.lit("{}"), F.col("experiment").cast("string")).alias("target"))
    whole = experiments.sparkSession.range(1).select(F.explode(once).alias("e")).select("e.rule", "e.target")
    lists = blacklists.select(F.explode(F.array(*(F.lit(x) for x in ("all", "fetch_only", "blacklists")))).alias("rule"), "target")
    return own.unionByName(whole).unionByName(lists).unionByName(fetched.select(F.lit("fetch_only").alias("rule"), "target")).distinct()


def load_experiments(entries: DataFrame, use_controls: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """experiment, species and resolved paths of ``entries`` (experiment, species, processed: a map of kind to path).

    peaks, sequences and negatives are null where an entry lacks them, and so is an empty blacklist.  Both signals must be
    there; controls, plus before minus, only where they are asked for, and then both.  What is absent raises, by name, as does an
    experiment of ``wanted`` without an entry.
    """
    found = entries if wanted is None else entries.filter(F.col("experiment").cast("string").isin(wanted))
    if wanted is not None:
        known = {str(r[0]) for r in found.select("experiment").distinct().collect()}  # those asked for by name
        if unknown := sorted(set(wanted) - known):
            raise KeyError(f"unknown experiments: {', '.join(unknown[:20])}")
    at = lambda kind: F.col("processed")[kind]
    for kinds in [("pl_bigwig", "mn_bigwig")] + [("pl_control", "mn_control")] * use_controls:
        lacking = found.filter(" or ".join(f"processed['{k}'] is null" for k in kinds)).select(F.col("experiment").cast("string")).orderBy("experiment").limit(20).collect()
        if lacking:
            raise KeyError(f"no {' or '.join(kinds)} of {', '.join(r[0] for r in lacking)}")
    pair = lambda a, b: F.array(at(a), at(b))
    none = F.lit(None).cast("array<string>")
    return found.select(
        "experiment", "species", at("peaks").alias("peaks"), pair("pl_bigwig", "mn_bigwig").alias("signals"), at("sequences").alias("sequences"), at("gc_negatives").alias("negatives"),
        (pair("pl_control", "mn_control") if use_controls else none).alias("controls"), F.when(at("blacklist") != "", F.array(at("blacklist"))).otherwise(none).alias("blacklist"),
    )


def fold_mechanism(species: DataFrame, tables: DataFrame, splits: DataFrame) -> DataFrame:
    """species, ``peak_level`` and ``n_folds``: a species with a table of peaks' folds uses it, others their chromosomes' folds.

    ``tables`` (species, fold) are the rows of the tables that exist, a null fold counting as none; ``splits`` (species, fold)
    those of chromosomes.  A species with neither raises.
    """
    peaks = tables.groupBy("species").agg(F.countDistinct("fold").alias("__peaks"))
    chroms = splits.groupBy("species").agg(F.countDistinct("fold").alias("__chroms"))
    both = species.select("species").distinct().join(peaks, "species", "left").join(chroms, "species", "left")
    neither = both.filter("__peaks is null and __chroms is null").orderBy("species").limit(20).collect()
    if neither:
        raise KeyError(f"no fold assignment for {', '.join(str(r['species']) for r in neither)}")
    return both.select("species", F.col("__peaks").isNotNull().alias("peak_level"), F.coalesce("__peaks", "__chroms").alias("n_folds"))


def verify_folds(folds: DataFrame, main: DataFrame, contigs: DataFrame, sizes: DataFrame) -> DataFrame:
    """species, chrom and problem, from ``folds`` (species, fold, chrom) and the chromosomes (species, chrom) that are main, in the index and in the size table.

    A species without an index and without sizes is ``not checked``, never passed; one without main chromosomes has ``no genome``.
    """
    key = ["species", "chrom"]
    text = lambda df: df.select("species", F.col("chrom").cast("string").alias("chrom"))
    members, main, contigs, sizes = text(folds).distinct(), text(main).distinct(), text(contigs).distinct(), text(sizes).distinct()
    species = folds.select("species").distinct()
    known = species.join(main.select("species").distinct(), "species", "left_semi")
    of = lambda df, also: df.join(also.select("species").distinct(), "species", "left_semi")
    own, main = of(members, known), of(main, known)
    said = lambda df, problem: df.select(*key, F.lit(problem).alias("problem"))
    alone = lambda df, problem: said(df.withColumn("chrom", F.lit(None).cast("string")), problem)
    twice = of(folds.select("species", F.col("chrom").cast("string").alias("chrom"), "fold"), known).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    found = [
        alone(species.join(known, "species", "left_anti"), "no genome"), said(twice, "in several folds"), said(own.join(main, key, "left_anti"), "not a main chromosome"), said(main.join(own, key, "left_anti"), "in no fold"),
        said(of(own, contigs).join(contigs, key, "left_anti"), "not in the index"), said(of(main, sizes).join(sizes, key, "left_anti"), "not in the sizes"), said(of(sizes, known).join(main, key, "left_anti"), "in the sizes but not main"),
        alone(known.join(contigs.select("species").unionByName(sizes.select("species")).distinct(), "species", "left_anti"), "not checked"),
    ]
    return reduce(DataFrame.unionByName, found)


#: Release and file name of the public motif collections.
MOTIF_RELEASE = "2026"
MOTIF_FILE = "JASPAR{release}_CORE_{collection}_non-redundant_pfms_meme.txt"


def motif_databases(wanted: DataFrame, genomes: DataFrame, folder: str, base: str, release: str = MOTIF_RELEASE) -> DataFrame:
    """path and url of the distinct motif databases that the ``wanted`` species need by their collection in ``genomes`` (species, collection).

    Raises, naming some, where a species is not in ``genomes`` or has no collection there.
    """
    known = genomes.groupBy("species").agg(F.max("collection").alias("collection"), F.lit(True).alias("known"))
    named = wanted.select("species").distinct().join(known, "species", "left")
    for bad, what in (("known is null", "not among the genomes"), ("coalesce(collection, '') = ''", "without a collection")):
        some = [str(r["species"]) for r in named.filter(bad).orderBy("species").limit(20).collect()]  # for the message
        if some:
            raise ValueError(f"{what}: {', '.join(some)}")
    before, after = MOTIF_FILE.format(release=release, collection="\n").split("\n")
    file = F.concat(F.lit(before), "collection", F.lit(after))
    return named.select("collection").distinct().select(F.concat(F.lit(f"{folder}/"), file).alias("path"), F.concat(F.lit(f"{base}/JASPAR{release}/CORE/"), file).alias("url"))
