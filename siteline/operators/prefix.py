"""Running values, ranks and order statistics along an order, without a task for each key.

``placed`` deals rows into parts that follow the order, of about equal size however the keys are spread, and writes them with
their part and place.  A running value is then a scan within each part, started from what the parts before it hold of the
key: one row for each part and key.  Rows that are equal in keys and order share a part; null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline import session

PART, PLACE = "__part", "__place"


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by ``keys`` and ``order``, written once with each row's part and place, as a range exchange samples its bounds anew each time."""
    by = [*keys, *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id())
    return session.written(sorted_, "placed").withColumn(PART, F.shiftright(PLACE, 33))


def _combined(fold: str, a: Column, b: Column) -> Column:
    return F.greatest(a, b) if fold == "max" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running(rows: DataFrame, keys: Sequence[str], fold: str, value: Column, name: str, before: bool = False) -> DataFrame:
    """``rows`` (placed) with ``name``: the ``sum`` or ``max`` of ``value`` over a key's rows up to each, or only those before it."""
    of: Callable[[Column], Column] = {"sum": F.sum, "max": F.max}[fold]
    own = rows.withColumn("__value", value)
    totals = own.groupBy(PART, *keys).agg(of(F.col("__value")).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(PART).alias("__p"), *(F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)), of(F.col("__total")).over(earlier).alias("__carry"))  # a row a part and key
    same = F.col(PART) == F.col("__p")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    within = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    scanned = own.withColumn("__scan", of(F.col("__value")).over(within))
    joined = scanned.join(carried, same, "left").withColumn(name, _combined(fold, F.col("__scan"), F.col("__carry")))
    return joined.select(*rows.columns, name)


def bare(rows: DataFrame) -> DataFrame:
    """``rows`` without their part and place."""
    return rows.drop(PART, PLACE)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with contiguous numbers within each key, in order; rows that are equal in order are numbered in any order."""
    return bare(running(placed(df, keys, order), keys, "sum", F.lit(1).cast("long"), name, before=True).withColumn(name, F.col(name) + first))


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each key in order, ``__n`` of each and ``__before`` it."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return running(placed(counts, keys, [value]), keys, "sum", F.col("__n"), "__before", before=True)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys`` and the values at some places of each key's sorted values: a place is a function of their number, from 0; a place beyond gives null.

    Exact: values are counted, the counts are added up along the order, and a place falls into the value that takes the sum past it.
    Null values are left out; a key without any other has no row, but without keys there is one row.
    """
    counts = _counted(df, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        total = total.withColumnRenamed(k, f"__k{j}")
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    with_all = counts.join(total, same) if keys else counts.crossJoin(F.broadcast(total))  # one row
    holds = lambda at: (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
    return with_all.groupBy(*keys).agg(*(F.max(F.when(holds(at(F.col("__all"))), F.col(value))).alias(name) for name, at in places.items()))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and interpolated quantiles of each key's values, exact (see ``order_statistics``); with ``__count`` of the values."""
    at = lambda q, n: F.lit(float(q)) * (n - 1)
    places = {}
    for name, q in shares.items():
        places[f"__low_{name}"] = lambda n, q=q: F.floor(at(q, n))
        places[f"__high_{name}"] = lambda n, q=q: F.ceil(at(q, n))
    found = order_statistics(df.withColumn("__q", F.col(value).cast("double")), keys, "__q", places)
    counted = df.groupBy(*keys).agg(F.count(value).alias("__count"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        found = found.withColumnRenamed(k, f"__k{j}")
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    both = counted.join(found, same, "left") if keys else counted.crossJoin(F.broadcast(found))  # one row each
    share = lambda name, q: F.col(f"__low_{name}") + (at(q, F.col("__count")) - F.floor(at(q, F.col("__count")))) * (F.col(f"__high_{name}") - F.col(f"__low_{name}"))
    return both.select(*keys, "__count", *(share(name, q).alias(name) for name, q in shares.items()))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, ``value`` and ``name``: the average rank, from 1, of each distinct value within its key."""
    return _counted(df, keys, value).select(*keys, value, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))
