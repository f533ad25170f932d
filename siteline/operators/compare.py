"""Score metrics and comparisons of populations, with defined results for constant and empty input.

Correlations are taken from sums, so that a constant side gives null rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline import session
from siteline.operators import prefix
from siteline.operators.intervals import bin_join


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of the rows where both are there; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    ok = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """``df`` with the average rank of ``column`` within its keys; rows where it is null are left out."""
    found = prefix.average_ranks(df, keys, column, name)
    ranks = found.select(*(F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)), F.col(column).alias("__v"), name)
    same = F.col(column) == F.col("__v")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    return df.join(ranks, same).select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Correlation of average ranks within each key; rows with a null side are left out, a constant side gives null.

    Ranks come from counts of distinct values (see ``prefix``) and are joined back to the distinct pairs; their mean is known, so
    that one weighted pass gives the sums.
    """
    pairs = df.dropna(subset=[x, y]).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__w"))
    own = session.written(pairs, "pairs")

    def ranked(side: str) -> DataFrame:
        counts = own.groupBy(*keys, side).agg(F.sum("__w").alias("__n"))
        placed = prefix.running(prefix.placed(counts, keys, [side]), keys, "sum", F.col("__n"), "__before", before=True)
        return placed.select(*(F.col(k).alias(f"{side}{k}") for k in keys), F.col(side).alias(f"{side}v"), (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(f"{side}r"))

    def same(side: str) -> Column:
        out = F.col(side) == F.col(f"{side}v")
        for k in keys:
            out = out & F.col(k).eqNullSafe(F.col(f"{side}{k}"))
        return out

    n = own.groupBy(*keys).agg(F.sum("__w").alias("n"))
    named = n.select(*(F.col(k).alias(f"__n{k}") for k in keys), "n")
    key = F.lit(True)
    for k in keys:
        key = key & F.col(k).eqNullSafe(F.col(f"__n{k}"))
    joined = own.join(ranked("__x"), same("__x")).join(ranked("__y"), same("__y")).join(named, key)
    mean = (F.col("n") + 1) / 2.0
    a, b, w = F.col("__xr") - mean, F.col("__yr") - mean, F.col("__w")
    sums = joined.groupBy(*keys).agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w).alias("n"))
    return sums.select(*keys, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"), "n")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def array_pearson(x: Column, y: Column) -> Column:
    """Pearson of two arrays of one length; null where one is constant."""
    centred = lambda a: let(a, lambda v: let(total(v) / F.size(v), lambda m: F.transform(v, lambda e: e - m)))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    step = lambda s, v: F.struct((s["xy"] + v["a"] * v["b"]).alias("xy"), (s["xx"] + v["a"] * v["a"]).alias("xx"), (s["yy"] + v["b"] * v["b"]).alias("yy"))
    both = F.zip_with(centred(x), centred(y), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(both, zero, step, lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])))


def softmax(x: Column) -> Column:
    powers = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda e: F.exp(e - top)))
    return let(x, lambda v: let(powers(v), lambda e: let(total(e), lambda t: F.transform(e, lambda p: p / t))))


def log_softmax(x: Column) -> Column:
    """Logarithms of the softmax, from differences to the largest value, so that nothing overflows."""
    rest = lambda v, top: F.log(total(F.transform(v, lambda e: F.exp(e - top))))
    return let(x, lambda v: let(F.array_max(v), lambda top: let(rest(v, top), lambda r: F.transform(v, lambda e: e - top - r))))


def normalised(x: Column) -> Column:
    """Values as shares of their sum; null where that is 0."""
    return let(x, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda e: e / t))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions: the square root of the divergence, natural logarithm."""
    half = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / 2))


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: distinct edges of ``bins`` equal shares of the pooled values."""
    at = ", ".join(str(k / bins) for k in range(bins + 1))
    return df.agg(F.array_distinct(F.expr(f"percentile({column}, array({at}))")).alias("edges"))


def digitize(edges: Column, x: Column) -> Column:
    """Bin of a value between interior edges: right-open, clipped to the outer bins; 0-based."""
    interior = F.slice(edges, 2, F.greatest(F.lit(0), F.size(edges) - 2))
    return F.size(F.filter(interior, lambda e: e <= x))


def cell_medians(df: DataFrame, group: str, cell: str, value: str, sides: tuple, least: int) -> DataFrame:
    """Medians and counts of both sides in each cell, and whether the cell is usable."""
    a, b = (F.when(F.col(group) == s, F.col(value)) for s in sides)
    out = df.groupBy(cell).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.median(a).alias("median_a"), F.median(b).alias("median_b"))
    why = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "one-sided").when((F.col("n_a") < least) | (F.col("n_b") < least), "few")
    return out.withColumn("dropped", why)


def direct_standardise(cells: DataFrame) -> DataFrame:
    """One row: side medians weighted by the pooled occupancy of usable cells, and their ratio."""
    use = cells.filter("dropped is null").withColumn("w", F.col("n_a") + F.col("n_b"))
    std = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return use.agg(std("median_a").alias("std_a"), std("median_b").alias("std_b"), F.count("*").alias("n_cells")).withColumn("ratio", F.when(F.col("std_b") != 0, F.col("std_a") / F.col("std_b")))


def wilcoxon(df: DataFrame, delta: str, keys: list[str], least: int = 6) -> DataFrame:
    """Signed-rank statistic by key, and its p-value by the normal approximation with tie correction; null under ``least`` pairs or without a nonzero delta."""
    own = df.dropna(subset=[delta]).filter(F.col(delta) != 0).withColumn("__abs", F.abs(delta))
    ranked = average_rank(own, "__abs", "__r", keys)
    ties = own.groupBy(*keys, "__abs").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(delta) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(delta) < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n")).join(ties, keys)
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.sqrt(variance)
    return sums.select(*keys, "n", F.least("w_plus", "w_minus").alias("w"), F.when((n >= least) & (variance > 0), z).alias("z")).withColumn("p", 2 * normal_tail(F.col("z")))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the continued product of Abramowitz and Stegun 26.2.17 (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def peer_median(df: DataFrame, keys: list[str], value: str, row: str, name: str) -> DataFrame:
    """``df`` with the median of the other rows' values within its keys; null for a row that is alone.

    Rows are numbered by value within their keys; without a row, the values before it keep their places and those after
    it move up by one, so that four places of the sorted values serve every row.  Rows with a null value are left out.
    """
    low, high = (lambda n: F.floor((n - 2) / 2)), (lambda n: F.ceil((n - 2) / 2))
    own = df.filter(F.col(value).isNotNull())
    places = {"__l0": low, "__l1": lambda n: low(n) + 1, "__h0": high, "__h1": lambda n: high(n) + 1}
    at = prefix.order_statistics(own, keys, value, places)
    n = own.groupBy(*keys).agg(F.count("*").alias("__all"))
    same = F.lit(True)
    for k in keys:
        at, n = at.withColumnRenamed(k, f"__a{k}"), n.withColumnRenamed(k, f"__n{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"__a{k}")) & F.col(k).eqNullSafe(F.col(f"__n{k}"))
    joined = at.join(n, [F.col(f"__a{k}").eqNullSafe(F.col(f"__n{k}")) for k in keys])
    both = prefix.numbered(own, keys, [value, row], "__own", first=0).join(joined, same)
    side = lambda place, a, b: F.when(place(F.col("__all")) < F.col("__own"), F.col(a)).otherwise(F.col(b))
    middle = (side(low, "__l0", "__l1").cast("double") + side(high, "__h0", "__h1").cast("double")) / 2
    return both.select(*df.columns, F.when(F.col("__all") > 1, middle).alias(name))


def locus_scores(loci: DataFrame, a: DataFrame, b: DataFrame, strands: int = 2) -> DataFrame:
    """``locus``, a_count, b_count, profile_pearson and profile_jsd of two tracks (chrom, strand, pos, value) at ``loci`` (locus, chrom, start_pos, end_pos).

    A profile is the absolute value of each base and strand.  The distance is of the softmax of ``b`` from ``a`` as shares of
    its sum.  Only bases with signal are joined: those without have known terms, so that the work doesn't depend on the loci's
    width.  A constant side has no correlation (null), and an ``a`` without signal no distance.  Loci that overlap count each.
    """
    one = lambda t, name: t.groupBy("chrom", "strand", "pos").agg(F.sum(F.abs("value")).alias(name))
    zero = F.lit(0.0)
    both = one(a, "a").join(one(b, "b"), ["chrom", "strand", "pos"], "full").select("chrom", F.col("pos").alias("b_start"), (F.col("pos") + 1).alias("b_end"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    own = loci.select("locus", "chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    wide = (strands * (F.col("a_end") - F.col("a_start"))).cast("double")
    of = Window.partitionBy("locus")  # at most the bases of a locus
    hits = bin_join(own, both).select("locus", wide.alias("n"), "a", "b", F.count("*").over(of).alias("hits"), F.sum("a").over(of).alias("sa"), F.max("b").over(of).alias("top"))
    hits = hits.withColumn("e", F.exp(F.col("b") - F.col("top"))).withColumn("none", F.exp(-F.col("top")))
    hits = hits.withColumn("all", F.sum("e").over(of) + (F.col("n") - F.col("hits")) * F.col("none"))
    p, q = F.col("e") / F.col("all"), F.when(F.col("sa") > 0, F.col("a") / F.col("sa"))
    half = lambda x, y: F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(0.0)
    first = lambda c: F.max(c)
    sums = hits.groupBy("locus").agg(
        first("n").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"),
        F.sum(half(p, q) + half(q, p)).alias("apart"), first((F.col("n") - F.col("hits")) * F.col("none") / F.col("all")).alias("rest"),
    )
    va, vb = F.col("n") * F.col("aa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("bb") - F.col("sb") * F.col("sb")
    r = F.when((va > 0) & (vb > 0), (F.col("n") * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(va) / F.sqrt(vb))
    jsd = F.when(F.col("sa") > 0, F.sqrt(F.greatest(zero, F.col("apart") + F.col("rest") * F.ln(F.lit(2.0))) / F.lit(2.0)))
    scored = sums.select("locus", "sa", "sb", r.alias("profile_pearson"), jsd.alias("profile_jsd"))
    return loci.select("locus").join(scored, "locus", "left").select("locus", F.coalesce("sa", zero).alias("a_count"), F.coalesce("sb", zero).alias("b_count"), "profile_pearson", "profile_jsd")


def compare_tracks(loci: DataFrame, a: DataFrame, b: DataFrame, strands: int = 2) -> DataFrame:
    """metric, value and ``n``, the loci that it is of: medians of the profile scores (the lower of two in the middle) and the three correlations of counts.

    Loci whose profile score isn't defined are left out of its median, as ``n`` shows.
    """
    own = session.written(locus_scores(loci, a, b, strands), "scores")
    logs = own.agg(pearson(F.col("a_count"), F.col("b_count")).alias("counts_pearson"), pearson(F.log1p("a_count"), F.log1p("b_count")).alias("log_counts_pearson"), F.count("*").alias("n"))
    rho = spearman(own, "a_count", "b_count", [])
    middle = {"value": lambda n: F.floor((n - 1) / 2)}
    out = logs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), "n") for c in ("counts_pearson", "log_counts_pearson")))).alias("m")).select("m.*")
    out = out.unionByName(rho.select(F.lit("counts_spearman").alias("metric"), F.col("rho").alias("value"), "n"))
    for score in ("profile_pearson", "profile_jsd"):
        found = prefix.order_statistics(own, [], score, middle).select(F.lit(score).alias("metric"), "value")
        out = out.unionByName(found.join(own.agg(F.count(score).alias("n")), how="cross"))  # one row each
    return out


def align_masked(loci: DataFrame, mask: DataFrame, predictions: DataFrame) -> DataFrame:
    """``predictions`` (row, ...) with the columns of the loci that they belong to: row k is the k-th locus that the mask keeps.

    ``loci`` (place, ...) and ``mask`` (place, kept) number the same list from 0, a null not kept.  A mask of other places than
    the loci, or rows other than 0 to the number kept less one, raises, as coordinates would move to other loci.
    """
    wrong = loci.select("place").exceptAll(mask.select("place")).unionByName(mask.select("place").exceptAll(loci.select("place")))
    if not wrong.isEmpty():
        raise ValueError("the mask is of other loci")
    kept = mask.filter("kept").join(loci, "place")
    rows = session.written(prefix.numbered(kept, [], ["place"], "row", first=0), "kept")
    odd = rows.select("row").exceptAll(predictions.select(F.col("row").cast("long").alias("row"))).unionByName(predictions.select(F.col("row").cast("long").alias("row")).exceptAll(rows.select("row")))
    if not odd.isEmpty():
        raise ValueError("the mask keeps another number of loci than were predicted")
    return rows.drop("kept").join(predictions.withColumn("row", F.col("row").cast("long")), "row")


def one_signed_thresholds(scores: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``keys``, ``lower`` and ``upper``: on each side of zero, the value that ``share`` of the side's values don't pass outwards.

    A side without values keeps everything out: its threshold is infinite.  Nulls, zeros and values that aren't numbers are on no side.
    """
    side = scores.filter(f"`{value}` <> 0 and not isnan(`{value}`)").withColumn("__up", F.col(value) > 0).withColumn("__size", F.abs(value).cast("double"))
    at = lambda n: F.least(F.floor(n * share), n - 1)
    found = prefix.order_statistics(side, [*keys, "__up"], "__size", {"__t": at})
    sides = found.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max(F.when(~F.col("__up"), -F.col("__t"))).alias("lower"), F.max(F.when(F.col("__up"), F.col("__t"))).alias("upper"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inf = F.lit(float("inf"))
    return scores.select(*keys).distinct().join(sides, same, "left").select(*keys, F.coalesce("lower", -inf).alias("lower"), F.coalesce("upper", inf).alias("upper"))
