"""Row numbers without a single task: one range sort, written once, then the partitions' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteline import session


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal", first: int = 1) -> DataFrame:
    """``df`` with contiguous numbers in the order of ``order``; equal rows are numbered in any order.

    A range exchange samples its bounds anew each time it runs, so the sorted rows are written
    with their partition and place, and both counts and rows are read from that table.  Only one
    count a partition meets in one place.  Nulls come first; an empty table stays empty.
    """
    at = "__ordinal_at"
    while at in df.columns:
        at += "_"
    path = session.scratch(df.sparkSession, "ordinal")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.withColumn(at, F.monotonically_increasing_id()).write.parquet(path)  # partition << 33 | place
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a partition
    out = rows.join(F.broadcast(offsets), part == F.col("__part"), "left")
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + F.lit(first)
    return out.select(*(c for c in rows.columns if c not in (at, name)), place.alias(name))
