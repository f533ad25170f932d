"""Interval algebra on half-open intervals ``[start_pos, end_pos)`` of a chromosome.

Range joins go through bins, an equality that any join strategy can use, with the exact
condition as a residual; sweeps are scans of position buckets, or of even parts of the order.  Zero-length intervals overlap nothing.
Null coordinates drop a row.  Repeated intervals count as often as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline.operators import prefix

BIN = 2048


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size)))


def bin_join(a: DataFrame, b: DataFrame, size: int = BIN, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """All overlapping pairs of ``a`` (a_start, a_end) and ``b`` (b_start, b_end), each once.

    Both sides have ``keys``; a pair is made in the bin where its overlap starts.
    """
    left = a.filter("a_start < a_end").withColumn("bin", _bins(F.col("a_start"), F.col("a_end"), size))
    right = b.filter("b_start < b_end").withColumn("bin", _bins(F.col("b_start"), F.col("b_end"), size))
    start = F.greatest("a_start", "b_start")
    return left.join(right, [*keys, "bin"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.floor(start / size) == F.col("bin"))).drop("bin")


def overlap_any(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """``a`` (chrom, a_start, a_end, ...) with ``hit``: whether any interval of ``b`` overlaps it."""
    key = ["chrom", "a_start", "a_end"]
    right = b.filter("b_start < b_end").select("chrom", "b_start", "b_end", _bins(F.col("b_start"), F.col("b_end"), size).alias("bin")).distinct()
    left = a.filter("a_start < a_end").select(*key).distinct().withColumn("bin", _bins(F.col("a_start"), F.col("a_end"), size))
    hits = left.join(right, ["chrom", "bin"]).filter("a_start < b_end and b_start < a_end").select(*key).distinct()
    return a.join(hits.withColumn("hit", F.lit(True)), key, "left").select(*a.columns, F.coalesce("hit", F.lit(False)).alias("hit"))


def sweep_sum(intervals: DataFrame, keys: tuple[str, ...] = ("chrom",), least: float = 1e-9, bucket: int = 1 << 20) -> DataFrame:
    """Summed level of overlapping valued intervals, between each two event positions.

    Adjacent equal levels stay apart.  A chromosome is swept in buckets of positions side by side:
    each bucket's running sum starts from the total of the buckets before it.
    """
    plus = intervals.select(*keys, F.col("start_pos").alias("pos"), F.col("value").alias("delta"))
    minus = intervals.select(*keys, F.col("end_pos").alias("pos"), (-F.col("value")).alias("delta"))
    events = plus.unionByName(minus).dropna().groupBy(*keys, "pos").agg(F.sum("delta").alias("delta")).withColumn("bucket", F.floor(F.col("pos") / bucket))
    totals = events.groupBy(*keys, "bucket").agg(F.sum("delta").alias("total"), F.min("pos").alias("opens"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    carried = totals.select(*keys, "bucket", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("carry"), F.lead("opens").over(order).alias("next_opens"))
    within = Window.partitionBy(*keys, "bucket").orderBy("pos")
    level = F.col("carry") + F.sum("delta").over(within)
    swept = events.join(carried, [*keys, "bucket"]).select(*keys, F.col("pos").alias("start_pos"), F.coalesce(F.lead("pos").over(within), F.col("next_opens")).alias("end_pos"), level.alias("level"))
    return swept.filter((F.col("end_pos").isNotNull()) & (F.col("level") > least))


def merge_gap(intervals: DataFrame, gap: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Intervals merged where the next starts at most ``gap`` after the end so far; with how many were merged."""
    rows = prefix.placed(intervals.dropna(subset=["start_pos", "end_pos"]), keys, ["start_pos", "end_pos"])
    reached = prefix.running(rows, keys, "max", F.col("end_pos"), "reach", before=True)
    opened = F.when(F.col("start_pos") - F.col("reach") <= gap, 0).otherwise(1)
    grouped = prefix.running(reached, keys, "sum", opened, "grp")
    return grouped.groupBy(*keys, "grp").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n")).drop("grp")


def running_max_end(intervals: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Each interval with the largest end of those up to it, by start."""
    rows = prefix.placed(intervals, keys, ["start_pos", "end_pos", "peak_idx"])
    return prefix.bare(prefix.running(rows, keys, "max", F.col("end_pos"), "max_end"))


def depths(intervals: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, pos and depth: how many intervals are open from each position at which one starts or ends."""
    ends = F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("end_pos").alias("pos"), F.lit(-1).cast("long").alias("delta"))))
    events = intervals.dropna(subset=["start_pos", "end_pos"]).select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.delta").alias("delta"))
    return prefix.running(prefix.placed(events, keys, ["pos"]), keys, "sum", F.col("delta"), "depth").select(*keys, "pos", "depth")


def gap_groups(points: DataFrame, threshold: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``grp``: a new group where a centre is more than ``threshold`` after the one before it."""
    rows = prefix.running(prefix.placed(points, keys, ["center", "peak_idx"]), keys, "max", F.col("center"), "__last", before=True)
    far = F.when(F.col("center") - F.col("__last") <= threshold, 0).otherwise(1).cast("long")
    return prefix.bare(prefix.running(rows, keys, "sum", far, "grp")).drop("__last")


def group_sizes(grouped: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``grouped`` (keys, grp) with ``group_size``; sizes are counted first and joined, so that a large group is no task of its own."""
    sizes = grouped.groupBy(*keys, "grp").agg(F.count("*").alias("group_size"))
    return grouped.join(sizes, [*keys, "grp"])


def nearest_within(points: DataFrame, sites: DataFrame, halfwidth: int, bucket: int = 1 << 20) -> DataFrame:
    """Points (chrom, strand, pos) with ``near``: whether a site of their chromosome and strand is within ``halfwidth``, and its distance (else null).

    Sites and points are swept together, once up and once down, in buckets of positions; a site also
    enters the neighbouring bucket that it can reach.
    """
    bin_ = lambda shift: F.floor((F.col("pos") + shift) / max(bucket, 2 * halfwidth + 1))
    spread = sites.select("chrom", "strand", "pos", F.col("pos").alias("site"), F.explode(F.array_distinct(F.array(bin_(-halfwidth), bin_(0), bin_(halfwidth)))).alias("__bin"), F.lit(0).alias("__point"))
    both = points.withColumns({"site": F.lit(None).cast("long"), "__bin": bin_(0), "__point": F.lit(1)}).unionByName(spread, allowMissingColumns=True)
    part = Window.partitionBy("chrom", "strand", "__bin")
    before = F.max("site").over(part.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("site").over(part.orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, 0))
    near = F.least(F.col("pos") - before, after - F.col("pos"))
    found = both.withColumn("distance", near).filter("__point = 1").withColumn("near", F.coalesce(F.col("distance") <= halfwidth, F.lit(False)))
    return found.withColumn("distance", F.when(F.col("near"), F.col("distance"))).drop("site", "__point", "__bin")


def tile(sizes: DataFrame, width: int) -> DataFrame:
    """Non-overlapping whole tiles of ``sizes`` (chrom, size)."""
    fits = sizes.filter(F.col("size") >= width)
    return fits.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - width, F.lit(width).cast("long"))).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + width)


def mask_tiles(tiles: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Tiles on the grid of ``width`` that no interval touches."""
    taken = intervals.filter("start_pos < end_pos").select("chrom", _bins(F.col("start_pos"), F.col("end_pos"), width).alias("bin")).distinct().select("chrom", (F.col("bin") * width).alias("start_pos"))
    return tiles.join(taken, ["chrom", "start_pos"], "left_anti")


def mark_excluded(points: DataFrame, zones: DataFrame, grain: int = 100) -> DataFrame:
    """Points that share no bin of ``grain`` with a zone, its last bin being that of its end."""
    bins = zones.select("chrom", F.explode(F.sequence(F.floor(F.col("start_pos") / grain), F.floor(F.col("end_pos") / grain))).alias("bin")).distinct()
    return points.withColumn("bin", F.floor(F.col("pos") / grain)).join(bins, ["chrom", "bin"], "left_anti").drop("bin")
