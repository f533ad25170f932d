"""Read trimming on columns: adapters and tails with mismatches, barcodes, and mates that run past each other's start.

Sequences are strings of single bytes.  A null sequence gives null.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteline.functions.seq import revcomp
from siteline.operators.compare import let

# Fixed values of the trimming rule.
LEAST_OVERLAP = 4  #: bases that an adapter shares with a read at least
BASES_A_MISMATCH = 8
TAIL_LEAST, TAIL_MISMATCHES = 10, 5
PAIR_LEAST, PAIR_MISMATCHES, PAIR_PERCENT = 30, 5, 20


def _bases(s: Column) -> Column:
    return F.split(s, "")


def _mismatches(a: Column, a_from: Column, b: Column, b_from: Column, n: Column) -> Column:
    """Places in which ``n`` bases of two arrays differ, from 0-based starts."""
    return F.when(n <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(F.get(a, a_from + i) == F.get(b, b_from + i), 0).otherwise(1)))


def _first(candidates: Column, test) -> Column:
    """The first of an array of whole numbers that passes; null where none does.  Nothing is tested after it."""
    return F.aggregate(candidates, F.lit(None).cast("int"), lambda s, p: F.when(s.isNotNull(), s).otherwise(F.when(test(p), p)))


def _pieces(adapter: str, mismatches: int) -> str:
    """A pattern that matches, without taking anything, where one of ``mismatches + 1`` pieces of the adapter stands in its place: a whole adapter has one at least."""
    edges = [k * len(adapter) // (mismatches + 1) for k in range(mismatches + 2)]
    return "(?=" + "|".join(f".{{{low}}}{re.escape(adapter[low:high])}" for low, high in itertools.pairwise(edges)) + ")"


def adapter_start(s: Column, adapter: str, least: int = LEAST_OVERLAP, bases_a_mismatch: int = BASES_A_MISMATCH, ahead: int = 0) -> Column:
    """0-based start of an adapter in a read, the first that fits; null where there is none.

    The adapter may run past the read's end, and begin up to ``ahead`` bases before its start (a negative start).  Of the bases that both have
    (``least`` or more), one in ``bases_a_mismatch`` may differ.  Whole adapters are only looked for where one of their pieces
    stands unchanged, which one pattern marks; those cut off at either end are tried place by place.
    """
    size, n = len(adapter), F.length(s)
    own = F.lit(list(adapter))
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def fits(a: Column, p: Column) -> Column:
        at, skip = F.greatest(p, F.lit(0)), F.greatest(-p, F.lit(0))
        both = F.least(F.lit(size) - skip, F.size(a) - at)
        return (both >= least) & (_mismatches(a, at, own, skip, both) <= F.floor(both / bases_a_mismatch))

    def step(a: Column):
        def of(x: Column, part: Column) -> Column:
            at = x["at"] + F.length(part)
            tried = F.when(x["found"].isNotNull(), x["found"]).when((at <= F.size(a) - size) & fits(a, at), at)
            return F.struct(at.alias("at"), tried.alias("found"))

        return of

    marked = F.split(F.regexp_replace(s, _pieces(adapter, size // bases_a_mismatch), "_"), "_")
    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))
    whole = lambda a: F.aggregate(marked, none, step(a), lambda x: x["found"])
    ends = lambda a: _first(places(F.greatest(F.lit(0), n - size + 1), n - least), lambda p: fits(a, p))
    heads = (lambda a: _first(places(F.lit(-ahead), F.least(F.lit(-1), n - least)), lambda p: fits(a, p))) if ahead else (lambda a: F.lit(None).cast("int"))
    return F.when(s.isNull() | (n == 0), None).otherwise(let(_bases(s), lambda a: F.coalesce(heads(a), whole(a), ends(a))))


def trim_adapters(s: Column, adapters: list[str], **rule: int) -> Column:
    """What lies before the earliest of several adapters; the whole where there is none."""
    starts = [adapter_start(s, a, **rule) for a in adapters]
    at = F.least(*starts) if len(starts) > 1 else starts[0]
    return let(F.struct(s.alias("s"), at.alias("at")), lambda x: F.when(x["at"].isNull(), x["s"]).otherwise(F.substring(x["s"], F.lit(1), F.greatest(x["at"], F.lit(0)))))


def tail_length(s: Column, bases: str = "G", least: int = TAIL_LEAST, most: int = TAIL_MISMATCHES, bases_a_mismatch: int = BASES_A_MISMATCH) -> Column:
    """Length of the longest tail of one base (any of ``bases``): it begins with that base, has ``least`` bases or more, and one in ``bases_a_mismatch`` may differ, ``most`` at most; else 0."""

    def of(a: Column, base: str) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("off"), F.lit(0).alias("best"))

        def step(x: Column, c: Column) -> Column:
            n, off = x["n"] + 1, x["off"] + F.when(c == base, 0).otherwise(1)
            good = (c == base) & (n >= least) & (off <= F.least(F.lit(most).cast("long"), F.floor(n / bases_a_mismatch)))
            return F.struct(n.alias("n"), off.alias("off"), F.when(good, n).otherwise(x["best"]).alias("best"))

        return F.aggregate(a, zero, step, lambda x: x["best"])

    last = lambda b: F.reverse(_bases(F.regexp_extract(s, f"({b}*(?:[^{b}]{b}*){{0,{most}}})$", 1)))  # no more than ``most`` others: all that can be the tail
    found = [of(last(b), b) for b in bases]
    return F.when(s.isNull(), None).otherwise(F.greatest(*found) if len(found) > 1 else found[0])


def trim_tail(s: Column, bases: str = "G", **rule: int) -> Column:
    return F.when(F.length(s) == 0, s).otherwise(F.substring(s, F.lit(1), F.length(s) - tail_length(s, bases, **rule)))


def split_barcode(s: Column, length: int) -> tuple[Column, Column]:
    """The barcode at a read's start, and the rest; a read that is shorter is all barcode."""
    return F.substring(s, 1, length), F.substring(s, F.lit(length + 1), F.length(s))


def insert_length(one: Column, two: Column, least: int = PAIR_LEAST, most: int = PAIR_MISMATCHES, percent: int = PAIR_PERCENT) -> Column:
    """Length of the insert that both mates run through: the longest beginning of ``one`` that is the reverse complement of the beginning of ``two``.

    ``percent`` of its bases may differ, ``most`` at most; null where none of ``least`` bases or more fits.
    """
    top = F.least(F.length(one), F.length(two))
    candidates = F.when(top >= least, F.sequence(top, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    arrays = F.struct(_bases(one).alias("a"), _bases(revcomp(two)).alias("b"), F.length(two).alias("n"))
    test = lambda x: lambda i: _mismatches(x["a"], F.lit(0), x["b"], x["n"] - i, i) <= F.least(F.lit(most).cast("long"), F.floor(i * percent / 100))
    return F.when(one.isNull() | two.isNull(), None).otherwise(let(arrays, lambda x: _first(candidates, test(x))))
