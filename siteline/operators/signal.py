"""Point-signal algebra: 5' counts, windows of signal, profiles around sites, base frequencies.

Signal is sparse, (chrom, strand, pos, value); a base without a row is zero.  Positions are
0-based.  Null values count as zero; windows that leave a contig are dropped, not padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline.functions import seq
from siteline.operators import prefix
from siteline.operators.intervals import bin_join


def five_prime(aln: DataFrame, swap: bool = False) -> DataFrame:
    """Alignments' 5' ends counted by base and strand: the start on +, the last base on -."""
    strand = F.when(F.col("strand") == "+", "-").otherwise("+") if swap else F.col("strand")
    pos = F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("end_pos") - 1)
    return aln.select("chrom", strand.alias("strand"), pos.alias("pos")).groupBy("chrom", "strand", "pos").agg(F.count("*").cast("double").alias("value"))


def dedup_umi(aln: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """One alignment for each 5' position, strand and identical barcode of a sample: (chrom, strand, pos, umi, keys)."""
    pos = F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("end_pos") - 1)
    return aln.select(*keys, "chrom", "strand", pos.alias("pos"), "umi").distinct()


def merge_tracks(*tracks: DataFrame) -> DataFrame:
    """Replicates pooled: the sum of their values at each base."""
    out = tracks[0]
    for t in tracks[1:]:
        out = out.unionByName(t)
    return out.groupBy("chrom", "strand", "pos").agg(F.sum("value").alias("value"))


def unstranded(signal: DataFrame) -> DataFrame:
    """Both strands' absolute values added, by base."""
    return signal.groupBy("chrom", "pos").agg(F.sum(F.abs("value")).alias("value"))


def window(mid: Column, width: int) -> tuple[Column, Column]:
    """The window of ``width`` around a midpoint, clipped at 0."""
    return F.greatest(F.lit(0), mid - width // 2), mid + (width + 1) // 2


def window_totals(regions: DataFrame, signal: DataFrame, width: int) -> DataFrame:
    """``regions`` (peak_idx, chrom, start_pos, end_pos) with the signal in the window around their midpoint; none is 0.

    A window's total is what has been added up before its end less that before its start, both found in one running sum over
    bases and window edges together, so that the work doesn't depend on ``width``.  Whole numbers are exact; of others the
    total keeps the rounding of the chromosome's running sum.
    """
    low, high = window(F.floor((F.col("start_pos") + F.col("end_pos")) / 2), width)
    edge = lambda pos, sign: F.struct(pos.cast("long").alias("pos"), F.lit(sign).alias("sign"))
    asked = regions.dropna(subset=["start_pos", "end_pos"]).select("peak_idx", "chrom", F.explode(F.array(edge(low, -1.0), edge(high, 1.0))).alias("e")).select("peak_idx", "chrom", "e.*", F.lit(0).alias("kind"), F.lit(0.0).alias("value"))
    bases = signal.dropna(subset=["pos"]).groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(F.sum("value").alias("value")).withColumn("kind", F.lit(1))
    rows = prefix.placed(asked.unionByName(bases, allowMissingColumns=True), ["chrom"], ["pos", "kind", "peak_idx"])
    passed = prefix.running(rows, ["chrom"], "sum", F.coalesce("value", F.lit(0.0)), "passed").filter("kind = 0")
    sums = passed.groupBy("peak_idx").agg(F.sum(F.col("sign") * F.col("passed")).alias("total"))
    return regions.join(sums, "peak_idx", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def peak_maxima(peaks: DataFrame, signal: DataFrame) -> DataFrame:
    """Each peak's highest base on the strand with the larger maximum; + and the first base win ties; peaks without signal go."""
    a = peaks.select("peak_idx", "chrom", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    b = signal.select("chrom", "strand", F.col("pos").alias("b_start"), (F.col("pos") + 1).alias("b_end"), F.abs("value").alias("value"))
    best = F.max_by(F.struct(F.col("b_start").alias("pos"), "strand", "value"), F.struct("value", F.col("strand") == "+", -F.col("b_start"))).alias("best")
    return bin_join(a, b).filter("value > 0").groupBy("peak_idx", "chrom").agg(best).select("peak_idx", "chrom", "best.*")


def site_hits(sites: DataFrame, signal: DataFrame, flank: int, sizes: DataFrame | None = None) -> DataFrame:
    """The bases with signal around each site (site, chrom, pos, strand, ...): pos and strand of the base, offset, is_sense, value and the site's total.

    Offsets run with the site's strand.  With ``sizes`` only sites with a whole window count; sites without
    signal have no row.
    """
    own = sites
    if sizes is not None:
        own = own.join(sizes, "chrom").filter((F.col("pos") - flank >= 0) & (F.col("pos") + flank < F.col("size"))).drop("size")
    rest = [c for c in own.columns if c not in ("site", "chrom", "pos", "strand")]
    a = own.select("site", "chrom", *rest, F.col("pos").alias("center"), F.col("strand").alias("site_strand"), F.greatest(F.lit(0), F.col("pos") - flank).alias("a_start"), (F.col("pos") + flank + 1).alias("a_end"))
    b = signal.select("chrom", "strand", F.col("pos").alias("b_start"), (F.col("pos") + 1).alias("b_end"), F.abs("value").alias("value"))
    hit = bin_join(a, b).withColumn("offset", F.when(F.col("site_strand") == "+", F.col("b_start") - F.col("center")).otherwise(F.col("center") - F.col("b_start"))).withColumn("is_sense", F.col("strand") == F.col("site_strand"))
    totals = hit.groupBy("site").agg(F.sum("value").alias("site_total")).filter("site_total > 0")
    return hit.join(totals, "site").select("site", "chrom", *rest, F.col("b_start").alias("pos"), "strand", "offset", "is_sense", "value", "site_total")


def profile(sites: DataFrame, signal: DataFrame, flank: int, sizes: DataFrame | None = None) -> DataFrame:
    """Mean normalised profile: offset, sense and anti, over the sites that have signal.

    ``sites``: (site, chrom, pos, strand).  A site's two strands share its total as denominator; a site
    on - is mirrored.  Only bases with signal are joined; zero offsets have no row.
    """
    hit = site_hits(sites, signal, flank, sizes)
    n = hit.agg(F.countDistinct("site").alias("n_sites"))
    share = F.col("value") / F.col("site_total")
    summed = hit.groupBy("offset").agg(F.sum(F.when(F.col("is_sense"), share).otherwise(0.0)).alias("sense"), F.sum(F.when(~F.col("is_sense"), share).otherwise(0.0)).alias("anti"))
    return summed.crossJoin(F.broadcast(n)).select("offset", (F.col("sense") / F.col("n_sites")).alias("sense"), (F.col("anti") / F.col("n_sites")).alias("anti"), "n_sites")  # one row


def pwm(windows: DataFrame, length: int) -> DataFrame:
    """offset, base and frequency over windows (seq, strand) that are whole and ACGT; those on - are reverse-complemented."""
    good = windows.filter((F.length("seq") == length) & F.col("seq").rlike("^[ACGT]+$"))
    turned = good.select(F.when(F.col("strand") == "-", seq.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    bases = turned.select(F.posexplode(F.split("seq", "")).alias("offset", "base"))
    counts = bases.groupBy("offset", "base").agg(F.count("*").alias("n"))
    totals = counts.groupBy("offset").agg(F.sum("n").alias("total"))
    return counts.join(totals, "offset").select(F.col("offset").cast("long").alias("offset"), "base", (F.col("n") / F.col("total")).alias("freq"))


def information(freqs: DataFrame, background_from: int = 5, center: int = 0) -> DataFrame:
    """Relative entropy in bits of each offset against the mean composition ``background_from`` or more away from ``center``."""
    mean = freqs.filter(F.abs(F.col("offset") - center) >= background_from).groupBy("base").agg(F.sum("freq").alias("bg"))
    total = mean.agg(F.sum("bg").alias("all"))
    bg = mean.crossJoin(F.broadcast(total)).select("base", (F.col("bg") / F.col("all")).alias("bg"))  # four bases
    joined = freqs.join(F.broadcast(bg), "base", "left").withColumn("bg", F.coalesce("bg", F.lit(0.25)))
    bits = F.when(F.col("freq") > 0, F.col("freq") * F.log2(F.col("freq") / F.col("bg"))).otherwise(0.0)
    return joined.groupBy("offset").agg(F.sum(bits).alias("bits")).withColumn("bits", F.when(F.col("bits") > 0, F.col("bits")).otherwise(0.0))  # never below 0 but by rounding


# Fixed values of the summit and motif rules.
SUMMIT_NEAR, SUMMIT_FAR, SUMMIT_EDGE = 20, 300, 60
SUMMIT_PROMINENCE, SUMMIT_ON_FACTOR, SUMMIT_SWAP, SUMMIT_WEAK = 1.5, 2.0, -1.0, 0.05
FLAT_BITS, INITIATOR_OFFSETS = 0.15, (-1, 0)
UNPAIRED_LEAST, SURVIVES = 0.10, 0.5


def dense(profile_: DataFrame, flank: int) -> DataFrame:
    """offset, sense and anti at every offset of ``[-flank, flank)``, 0 where the profile has no row."""
    spark = profile_.sparkSession
    grid = spark.range(-flank, flank).select(F.col("id").alias("offset"))
    own = profile_.select(F.col("offset").cast("long").alias("offset"), "sense", "anti")
    return grid.join(own, "offset", "left").select("offset", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sense", "anti")))


def _argmax(keep: Column, value: Column) -> Column:
    """The largest value where ``keep`` holds, with its smallest offset, as (value, offset)."""
    top = F.max(F.when(keep, F.struct(value.alias("value"), (-F.col("offset")).alias("back"))))
    return F.when(top.isNotNull(), F.struct(top["value"].alias("value"), (-top["back"]).alias("offset")))


def summit_stats(profile_: DataFrame, near: int = SUMMIT_NEAR, far: int = SUMMIT_FAR, edge: int = SUMMIT_EDGE) -> DataFrame:
    """One row of a dense profile: antisense up- and downstream of the anchor, their log2 ratio, the bands' peak, and a note.

    ``note``: ``none`` without antisense, ``weak`` where there is too little to tell, ``swapped`` where it lies
    downstream and peaks there, ``REVIEW`` where it does so without a peak, ``on summit`` where it is
    concentrated on the anchor, else ``ok``.  Of equal heights the smallest offset is the peak.
    """
    x = F.col("offset")
    band = F.abs(x).between(near, far)
    in_band = lambda c: F.coalesce(F.sum(F.when(band & c, F.col("anti"))), F.lit(0.0))
    found = profile_.agg(
        F.sum("sense").alias("sense"), F.sum("anti").alias("anti"), in_band(x < 0).alias("up"), in_band(x > 0).alias("down"), _argmax(band, F.col("anti")).alias("top"),
        F.median(F.when(band, F.col("anti"))).alias("band_median"), F.avg(F.when(F.abs(x) < near, F.col("anti"))).alias("inner"),
    )
    share = F.col("anti") / F.greatest(F.col("sense") + F.col("anti"), F.lit(1e-9))
    ratio = F.log2((F.col("up") + 1e-12) / (F.col("down") + 1e-12))
    localized = (F.col("band_median") > 0) & (F.col("peak_height") >= SUMMIT_PROMINENCE * F.col("band_median")) & (far - F.abs("peak_offset") > edge)
    note = (
        F.when(F.coalesce("anti", F.lit(0.0)) <= 0, "none").when(F.col("anti_share") <= SUMMIT_WEAK, "weak").when((F.col("log2_up_down") <= SUMMIT_SWAP) & F.col("localized"), "swapped")
        .when(F.col("log2_up_down") <= SUMMIT_SWAP, "REVIEW").when((F.col("peak_height") > 0) & (F.col("inner") >= SUMMIT_ON_FACTOR * F.col("peak_height")), "on summit").otherwise("ok")
    )
    named = found.withColumns({"anti_share": share, "log2_up_down": ratio, "peak_offset": F.col("top.offset"), "peak_height": F.col("top.value")})
    marked = named.withColumn("localized", F.coalesce(localized, F.lit(False))).withColumn("note", note)
    return marked.select("anti_share", "up", "down", "log2_up_down", "peak_offset", "peak_height", "band_median", "localized", "inner", "note")


def magnitude(profile_: DataFrame, near: int = SUMMIT_NEAR, far: int = SUMMIT_FAR) -> DataFrame:
    """One row of a dense profile: where the antisense peaks upstream and in both bands, its height there, against the bands' median and against the largest sense."""
    x = F.col("offset")
    found = profile_.agg(_argmax(x.between(-far, -near), F.col("anti")).alias("up"), _argmax(F.abs(x).between(near, far), F.col("anti")).alias("band"), F.median(F.when(F.abs(x).between(near, far), F.col("anti"))).alias("mid"), F.max("sense").alias("top"))
    height = F.col("up.value")
    return found.select(F.col("up.offset").alias("at_upstream"), F.col("band.offset").alias("at_band"), height.alias("height"), F.when(F.col("mid") > 0, height / F.col("mid")).alias("prominence"), F.when(F.col("top") > 0, height / F.col("top")).alias("vs_sense"))


def orientation(information_: DataFrame, profile_: DataFrame, tss_anchored: bool = True, center: int = 0) -> DataFrame:
    """One row: what the motif at the summits and the profile at annotated starts say of the strands.

    ``motif``: ``flat and misplaced`` where the information is low and not at the initiator, ``diluted`` where it is
    low but in place, else ``ok``.  ``direction`` and ``strands`` are suspicious where sense signal isn't downstream
    and where antisense outweighs sense; that is a ``FLAG``, but only a ``REVIEW`` where the annotation doesn't mark the starts.
    """
    best = F.max(F.struct("bits", (-F.col("offset")).alias("back")))
    top = information_.agg(best.alias("t")).select(F.col("t.bits").alias("bits"), (-F.col("t.back") - center).alias("at"))
    sums = profile_.agg(F.sum(F.when(F.col("offset") >= 0, F.col("sense"))).alias("down"), F.sum(F.when(F.col("offset") < 0, F.col("sense"))).alias("up"), F.sum("anti").alias("anti"), F.sum("sense").alias("sense"))
    placed = F.col("at").isin(*INITIATOR_OFFSETS)
    motif = F.when(F.col("bits") >= FLAT_BITS, "ok").when(placed, "diluted").otherwise("flat and misplaced")
    raised = "FLAG" if tss_anchored else "REVIEW"
    return top.crossJoin(sums).select(  # one row each
        "bits", "at", motif.alias("motif"),
        (F.col("down") / F.greatest("up", F.lit(1e-9))).alias("down_up"), F.when(F.col("down") <= F.col("up"), raised).otherwise("ok").alias("direction"),
        (F.col("anti") / F.greatest("sense", F.lit(1e-9))).alias("anti_sense"), F.when(F.col("anti") > F.col("sense"), raised).otherwise("ok").alias("strands"),
    )


def divergent_partition(sites: DataFrame, starts: DataFrame, near: int = SUMMIT_NEAR, far: int = SUMMIT_FAR, halfwidth: int = 0) -> DataFrame:
    """``sites`` (site, chrom, pos, strand) with whether a start of the other strand lies within ``halfwidth`` of a base of either band (``paired``), and of the upstream one (``paired_upstream``)."""
    plus = F.col("strand") == "+"
    left = F.struct((F.col("pos") - far - halfwidth).alias("a_start"), (F.col("pos") - near + halfwidth + 1).alias("a_end"), plus.alias("upstream"))
    right = F.struct((F.col("pos") + near - halfwidth).alias("a_start"), (F.col("pos") + far + halfwidth + 1).alias("a_end"), (~plus).alias("upstream"))
    bands = sites.select("site", "chrom", F.when(plus, "-").otherwise("+").alias("strand"), F.explode(F.array(left, right)).alias("b")).select("site", "chrom", "strand", "b.upstream", F.greatest("b.a_start", F.lit(0)).alias("a_start"), "b.a_end")
    marks = starts.select("chrom", "strand", F.col("pos").alias("b_start"), (F.col("pos") + 1).alias("b_end")).distinct()
    met = bin_join(bands, marks, keys=("chrom", "strand")).groupBy("site").agg(F.bool_or("upstream").alias("up"))
    return sites.join(met, "site", "left").select(*sites.columns, F.col("up").isNotNull().alias("paired"), F.coalesce("up", F.lit(False)).alias("paired_upstream"))


def attribution(points: DataFrame, sites: DataFrame, shifts: list[int], halfwidth: int, keys: tuple[str, ...] = ("chrom", "strand")) -> DataFrame:
    """One row: the weighted share of points (keys, pos, weight) near a site, against the median over shifted points; 0/0 is null."""
    moved = points.select(*keys, "weight", F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), (F.col("pos") + s).alias("pos")) for s in [0, *shifts]))).alias("m")).select(*keys, "weight", "m.*")
    from siteline.operators.intervals import nearest_within

    near = nearest_within(moved, sites, halfwidth)
    share = near.groupBy("shift").agg((F.sum(F.when(F.col("near"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    row = share.agg(F.max(F.when(F.col("shift") == 0, F.col("share"))).alias("observed"), F.median(F.when(F.col("shift") != 0, F.col("share"))).alias("expected"))
    ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).when(F.col("observed") > 0, F.lit(float("inf")))
    return row.withColumn("enrichment", ratio)


def partition_verdict(n_sites: Column, n_unpaired: Column, log2: Column, peak: Column, near: int = SUMMIT_NEAR) -> Column:
    """What the sites without a partner show, from typed numbers; ``peak`` is null where none is localized."""
    return (
        F.when(F.coalesce(n_sites, F.lit(0)) == 0, "no usable sites").when((n_unpaired / n_sites < UNPAIRED_LEAST) | log2.isNull(), "inconclusive").when((peak <= -near) & (log2 >= SURVIVES), "survives")
        .when(peak > -near, "not divergent").when(log2 >= SURVIVES, "partly survives").otherwise("gene pairs")
    )
