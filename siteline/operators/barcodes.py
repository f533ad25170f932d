"""Reads of one place grouped by barcodes that may hold read errors.

A barcode takes in another that differs in one base where it has been read at least twice as often, less one (a
"directed" link); what that one takes in goes with it.  Barcodes are ordered by reads, most first, then by text; each belongs to the
first that reaches it by links.

Links are found by equality: a barcode with one base masked meets those that agree in all other bases, so that no two barcodes of a
place are ever compared, and a meeting has no more members than a base has values.  The first that reaches a barcode spreads
along links, with pointers doubled in each round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline import session


def links(counts: DataFrame, place: Sequence[str]) -> DataFrame:
    """place, ``a`` and ``b``: the barcodes ``b`` that ``a`` takes in, of ``counts`` (place, umi, n)."""
    masked = F.transform(F.sequence(F.lit(1), F.length("umi")), lambda i: F.concat(F.substring("umi", F.lit(1), i - 1), F.lit("*"), F.substring("umi", i + 1, F.length("umi"))))
    met = counts.filter(F.length("umi") > 0).select(*place, "umi", "n", F.explode(masked).alias("__key")).groupBy(*place, "__key").agg(F.collect_list(F.struct("umi", "n")).alias("m")).filter(F.size("m") > 1)
    pairs = met.select(*place, F.explode("m").alias("a"), "m").select(*place, "a", F.explode("m").alias("b"))
    return pairs.filter((F.col("a.umi") != F.col("b.umi")) & (F.col("a.n") >= 2 * F.col("b.n") - 1)).select(*place, F.col("a.umi").alias("a"), F.col("b.umi").alias("b"))


def _matched(place: Sequence[str], left: str, right: str) -> Column:
    same = F.col(f"l.{left}") == F.col(f"r.{right}")
    for c in place:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return same


def directional(reads: DataFrame, place: Sequence[str]) -> DataFrame:
    """place, umi, n (its reads) and ``root``: the barcode that takes it in, of ``reads`` (place, umi), a row a read.

    Null barcodes are left out; barcodes of different lengths never meet, and an empty one stands alone.
    """
    spark = reads.sparkSession
    counts = session.written(reads.filter("umi is not null").groupBy(*place, "umi").agg(F.count("*").alias("n")), "barcodes")
    edges = session.written(links(counts, place), "links")
    first = F.struct((-F.col("n")).alias("back"), F.col("umi").alias("umi"))  # the order of barcodes
    state = session.written(counts.select(*place, "umi", "n", first.alias("root")), "roots")
    while True:
        sent = edges.alias("l").join(state.alias("r"), _matched(place, "a", "umi")).groupBy(*(F.col(f"l.{c}").alias(c) for c in place), F.col("l.b").alias("umi")).agg(F.min("r.root").alias("offer"))
        met = state.alias("l").join(sent.alias("r"), _matched(place, "umi", "umi"), "left").select(*(F.col(f"l.{c}").alias(c) for c in place), "l.umi", "l.n", F.col("l.root").alias("was"), F.least("l.root", "r.offer").alias("now"))
        now = session.written(met, "roots")
        ahead = now.select(*place, "umi", F.col("now").alias("further"))
        hop = now.withColumn("__at", F.col("now.umi"))
        jumped = hop.alias("l").join(ahead.alias("r"), _matched(place, "__at", "umi")).select(*(F.col(f"l.{c}").alias(c) for c in place), "l.umi", "l.n", "l.was", F.least("l.now", "r.further").alias("root"))
        after = session.written(jumped, "roots")
        changed = after.filter(F.col("was") != F.col("root")).limit(1).count()
        state = after.drop("was")
        if not changed:
            return state.select(*place, "umi", "n", F.col("root.umi").alias("root"))
