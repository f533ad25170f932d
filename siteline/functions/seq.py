"""Sequence functions on string columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(s: Column) -> Column:
    """Reverse complement; N stays N."""
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def find_first(s: Column, patterns: list[str]) -> Column:
    """0-based position of the earliest of several patterns; -1 where there is none."""
    at = [F.when(F.locate(p, s) > 0, F.locate(p, s) - 1) for p in patterns]
    return F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(-1))


def trim_insert(s: Column, patterns: list[str]) -> Column:
    """What lies before the earliest pattern; the whole where there is none."""
    at = find_first(s, patterns)
    return F.when(at >= 0, F.substring(s, F.lit(1), at)).otherwise(s)


def kmers(s: Column, k: int) -> Column:
    """All k-mers, left to right; none for a shorter sequence.  One pass: ``substring`` counts from the start each time."""
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def entropy(counts: list[Column]) -> Column:
    """Shannon bits of a composition; null where nothing is counted."""
    total = sum(counts[1:], counts[0])
    bits = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(bits[1:], bits[0]))


def leading_run(bits: Column, least: float = 1.95, shortest: int = 4) -> Column:
    """Length of the leading run of values of at least ``least``; 0 if shorter than ``shortest``."""
    run = F.aggregate(bits, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, b: F.struct((a["n"] + F.when(a["on"] & (b >= least), 1).otherwise(0)).alias("n"), (a["on"] & (b >= least)).alias("on")))["n"]
    return F.when(run >= shortest, run).otherwise(0)


def onehot(s: Column) -> Column:
    """Four 0/1 values for each base; a base that isn't ACGT is a column of zeros."""
    return F.transform(F.split(s, ""), lambda c: F.array(*(F.when(c == b, 1).otherwise(0).cast("tinyint") for b in "ACGT")))


def all_acgt(s: Column, length: int) -> Column:
    """Whether a window is whole and has no other base."""
    return F.coalesce((F.length(s) == length) & s.rlike("^[ACGT]*$"), F.lit(False))


def midpoint_window(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """Window around the midpoint, clipped at 0: it may be short."""
    mid = F.floor((start + end) / 2)
    return F.greatest(F.lit(0), mid - width // 2), mid + (width + 1) // 2


def clamped_window(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """Window around the midpoint, shifted to start at 0 at least: it keeps its width."""
    low = F.greatest(F.lit(0), F.floor((start + end) / 2) - width // 2)
    return low, low + width
