"""Cross-validation folds, strata and matched background."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline import session
from siteline.operators import prefix
from siteline.operators.intervals import overlap_any
from siteline.operators.ordinal import with_ordinal


def split(folds: DataFrame, i: int, n: int) -> DataFrame:
    """fold and role in split ``i`` of ``n``; raises where there is no such split."""
    if not 0 <= i < n:
        raise ValueError(f"no split {i} of {n}")
    return roles(folds, n).filter(F.col("i") == i).drop("i")


def roles(folds: DataFrame, n: int) -> DataFrame:
    """Role of every fold in each of ``n`` splits: split i tests i, validates the next and trains on the rest."""
    i = folds.select("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    role = F.when(F.col("fold") == F.col("i"), "test").when(F.col("fold") == (F.col("i") + 1) % n, "valid").otherwise("train")
    return i.select("i", F.col("fold").cast("long").alias("fold"), role.alias("role"))


def split_rows(nested: DataFrame, keys: list[str], folds: str = "folds") -> DataFrame:
    """``keys``, ``place``, chrom and fold of records with a map of fold to its chromosomes: folds as numbers in order, a fold's chromosomes in the record's own; nested in a record, so nothing meets.

    A null map or list has no rows, a fold that is no number raises.
    """
    pairs = F.transform(F.map_entries(folds), lambda e: F.struct(e["key"].cast("long").alias("fold"), e["value"].alias("chroms")))
    flat = F.flatten(F.transform(F.array_sort(pairs, lambda a, b: F.when(a["fold"] < b["fold"], -1).when(a["fold"] > b["fold"], 1).otherwise(0)), lambda p: F.transform(F.coalesce(p["chroms"], F.array().cast("array<string>")), lambda c: F.struct(c.alias("chrom"), p["fold"].alias("fold")))))
    return nested.select(*keys, F.posexplode(flat).alias("place", "__row")).select(*keys, F.col("place").cast("long").alias("place"), "__row.chrom", "__row.fold")


#: Share of unidirectional peaks below which the classes must have been read wrongly.
UNI_LEAST = 0.5
STRANDS = ("+", "-", ".")


def strata(peaks: DataFrame, least_uni: float = UNI_LEAST) -> DataFrame:
    """peak_idx and stratum of ``peaks`` (peak_idx, pclass ``uni`` or ``bi``, qval, strand, label): the class, a unidirectional peak's quarter by q-value rank, a bidirectional one's label.

    Raises where a class is neither, where fewer than ``least_uni`` are unidirectional, and where one of these
    has no strand.  Without a q-value for every unidirectional peak there are no quarters.  No peaks, no strata.
    """
    uni = peaks.filter("pclass = 'uni'")
    seen = peaks.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("pclass") == "uni", 1)).alias("uni"), F.count(F.when(~F.coalesce(F.col("pclass").isin("uni", "bi"), F.lit(False)), 1)).alias("unknown"),
        F.count(F.when((F.col("pclass") == "uni") & ~F.coalesce(F.col("strand").isin(*STRANDS), F.lit(False)), 1)).alias("strandless"), F.count(F.when((F.col("pclass") == "uni") & F.col("qval").isNull(), 1)).alias("unranked"),
    ).first()
    if seen["unknown"]:
        raise ValueError(f"{seen['unknown']} peaks are of neither class")
    if seen["n"] and seen["uni"] < least_uni * seen["n"]:
        raise ValueError(f"only {seen['uni']} of {seen['n']} peaks are unidirectional")
    if seen["strandless"]:
        raise ValueError(f"{seen['strandless']} unidirectional peaks have no strand")
    label = F.concat(F.lit("bi_"), F.regexp_replace(F.lower("label"), "[^\\p{L}\\p{N}]", ""))
    out = peaks.select("peak_idx", F.explode(F.array_compact(F.array("pclass", F.when(F.col("pclass") == "bi", label)))).alias("stratum"))
    if seen["unranked"]:
        return out
    ranked = with_ordinal(uni.select("peak_idx", "qval"), "qval", "peak_idx", name="r", first=0)
    edge = lambda k: (k * seen["uni"]) // 4
    q = F.when(F.col("r") < edge(1), "uniq1").when(F.col("r") < edge(2), "uniq2").when(F.col("r") < edge(3), "uniq3").otherwise("uniq4")
    return out.unionByName(ranked.select("peak_idx", q.alias("stratum")))


def greedy_bins(groups: DataFrame, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """``groups`` (chrom, grp, n) with ``fold``: in a seeded hash order (or the one given), each into the emptiest fold.

    A fold's fill depends on all groups before, so one task walks the groups (not the
    loci) as a stream, in order, holding ``n`` sums.
    """
    ordered = groups.withColumn("__key", F.xxhash64(F.lit(seed), "chrom", "grp") if order is None else order).repartition(1).sortWithinPartitions("__key", "chrom", "grp")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fill = [0] * n
        for b in batches:
            out = []
            for size in b["n"]:
                k = fill.index(min(fill))
                fill[k] += size
                out.append(k)
            yield b.drop(columns="__key").assign(fold=pd.array(out, dtype="int64"))

    return ordered.mapInPandas(walk, "chrom string, grp long, n long, fold long")


def drift(spark: SparkSession, old: dict[str, str], new: dict[str, str], ignored: set[str]) -> DataFrame:
    """Keys whose values differ between two provenance records."""
    rows = [(k, old.get(k), new.get(k)) for k in sorted(old.keys() | new.keys()) if k not in ignored and old.get(k) != new.get(k)]
    return spark.createDataFrame(rows, "key string, a string, b string")


def gc_match(tiles: DataFrame, peaks: DataFrame, order: Column, ties: list[str], span: int = 1 << 32, cells: int = 4096) -> DataFrame:
    """In each bin, as many tiles as it has peaks, the first in a pseudo-random order (whole numbers in ``[0, span)``), then by ``ties``.

    Tiles are first counted by bin and cell of the order; those beyond the cell in which a bin's quota is met go where they
    are read.  What is left, about the quota, is ranked in even parts of the order (see ``prefix``).
    """
    own = session.written(tiles.withColumn("__order", order), "tiles")
    cell = F.least(F.lit(cells - 1), F.floor(F.col("__order") * cells / span))
    quota = peaks.groupBy("bin").agg(F.count("*").alias("quota"))
    filled = own.groupBy("bin", cell.alias("__cell")).agg(F.count("*").alias("n")).withColumn("__to", F.sum("n").over(Window.partitionBy("bin").orderBy("__cell")))
    met = filled.join(quota, "bin").groupBy("bin", "quota").agg(F.coalesce(F.min(F.when(F.col("__to") >= F.col("quota"), F.col("__cell"))), F.lit(cells)).alias("__last"))
    some = own.join(met, "bin").filter(cell <= F.col("__last"))
    return prefix.numbered(some, ["bin"], ["__order", *ties], "__n").filter("__n <= quota").drop("__n", "__order", "quota", "__last")


def negatives(tiles: DataFrame, peaks: DataFrame, order: Column, beta: float | None = 0.5, n_share: float = 0.1, bin_percent: int = 2) -> DataFrame:
    """Background tiles with the peaks' composition: chrom, start_pos, end_pos, bin and signal.

    Both inputs have (chrom, start_pos, end_pos, seq, signal).  Tiles with more than ``n_share`` of N, those
    that touch a peak and, unless ``beta`` is None, those with more signal than ``beta`` times the
    first percentile of the peaks' go; of what is left each bin of ``bin_percent`` of GC gives as many
    as it has peaks, or all it has, in ``order``.
    """
    share = lambda bases: F.length("seq") - F.length(F.regexp_replace("seq", f"[{bases}]", ""))
    binned = lambda df: df.filter(F.length("seq") > 0).withColumn("bin", F.floor(share("GC") * 100 / (F.length("seq") * bin_percent)))
    left = tiles.filter(share("N") <= n_share * F.length("seq"))
    if beta is not None:
        limit = prefix.quantiles(peaks, [], "signal", {"q": 0.01}).select((beta * F.col("q")).alias("__limit"))
        left = left.crossJoin(F.broadcast(limit)).filter("signal <= __limit").drop("__limit")  # one row
    zones = peaks.select("chrom", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    free = overlap_any(left.withColumnsRenamed({"start_pos": "a_start", "end_pos": "a_end"}), zones).filter("not hit").drop("hit").withColumnsRenamed({"a_start": "start_pos", "a_end": "end_pos"})
    return gc_match(binned(free).drop("seq"), binned(peaks), order, ["chrom", "start_pos"]).select("chrom", "start_pos", "end_pos", "bin", "signal")


def negatives_report(found: DataFrame, peaks: DataFrame, background: DataFrame) -> DataFrame:
    """One row: negatives, per peak, the share that overlaps a peak, median signal of negatives, peaks and background (signal), and negatives against background."""
    zones = peaks.select("chrom", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    hit = overlap_any(found.withColumnsRenamed({"start_pos": "a_start", "end_pos": "a_end"}), zones)
    a = hit.agg(F.count("*").alias("n_negatives"), F.avg(F.col("hit").cast("double")).alias("overlap_share"), F.median("signal").alias("median_negatives"))
    b = peaks.agg(F.count("*").alias("n_peaks"), F.median("signal").alias("median_peaks"))
    c = background.agg(F.median("signal").alias("median_background"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    return one.select(
        "n_negatives", "n_peaks", (F.col("n_negatives") / F.greatest("n_peaks", F.lit(1))).alias("per_peak"), "overlap_share", "median_negatives", "median_peaks", "median_background",
        F.when(F.col("median_background") != 0, F.col("median_negatives") / F.col("median_background")).alias("times_background"),
    )


def split_status(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """group and status of ``rows`` (group, chrom, fold): created where ``existing`` has no row of it, unchanged, or rewritten."""
    count = lambda df, name: df.groupBy("group", F.col("chrom").cast("string").alias("chrom"), F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias(name))
    both = count(rows, "new").join(count(existing, "old"), ["group", "chrom", "fold"], "full")
    differs = F.max((F.coalesce("new", F.lit(0)) != F.coalesce("old", F.lit(0))).cast("int")) == 1
    by = both.groupBy("group").agg(F.count("new").alias("n"), F.count("old").alias("had"), differs.alias("differs")).filter("n > 0")
    return by.select("group", F.when(F.col("had") == 0, "created").when(F.col("differs"), "rewritten").otherwise("unchanged").alias("status"), F.col("n").alias("n_chroms"))
