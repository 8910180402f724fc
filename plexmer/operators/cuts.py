"""Thresholds that follow from the data: noise, drops of histograms and curves, variability, spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def noise_threshold(matrix: DataFrame, samples: DataFrame, replicates: int = 6, share: float = 0.02) -> float:
    """Largest value that makes up `share` of the counts seen in few of the largest group's replicates; -1 if none does.

    A feature is noise if at least n - n div 3 of the n <= `replicates` first replicates of the group lack it.  All features are read.
    """
    sizes = samples.groupBy("grp").agg(F.count("*").alias("n"))
    grp = sizes.orderBy(F.desc("n"), "grp").select("grp").limit(1)
    first = samples.join(F.broadcast(grp), "grp", "left_semi").orderBy("ord").limit(replicates).select("ord")
    n = first.count()
    cells = matrix.join(F.broadcast(first), "ord", "left_semi").where("val <> 0")
    noisy = cells.groupBy("kmer_id").agg(F.count("*").alias("seen")).where(F.lit(n) - F.col("seen") >= n - n // 3).select("kmer_id")
    shares = cells.join(noisy, "kmer_id", "left_semi").groupBy("val").agg(F.count("*").alias("n"))
    total = shares.agg(F.sum("n")).first()[0]
    found = shares.where(F.col("n") >= share * total).agg(F.max("val")).first()[0] if total else None
    return -1.0 if found is None else float(found)


def view_histogram(occ: DataFrame) -> DataFrame:
    """(nview, n): how many k-mers have each number of views."""
    return occ.groupBy("nview").agg(F.count("*").alias("n"))


def winner_cut(occ: DataFrame, part: float = 0.005) -> DataFrame:
    """K-mers viewed at least as often as where the drop of the view histogram first falls below `part` of its steepest one.

    Unit bins from 1 to the largest number of views, of which the last two values share one.  The window is over
    these bins, a row for each number of views.
    """
    most = occ.agg(F.max("nview")).first()[0] or 0
    if most < 3:
        return occ
    counts = view_histogram(occ).select(F.least("nview", F.lit(most - 1)).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n"))
    bins = occ.sparkSession.range(1, most).join(F.broadcast(counts), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    drops = bins.withColumn("drop", F.lead("n").over(Window.orderBy("id")) - F.col("n")).where("drop IS NOT NULL")
    steepest = drops.agg(F.min("drop")).first()[0]
    level = drops.where(F.col("drop") > F.lit(part * steepest)).agg(F.min("id")).first()[0]
    return occ.where(F.col("nview") > (level or 1))


#: Windows of `smooth` by name; each gives so many weights.
WINDOWS = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}


def smooth(x: np.ndarray, length: int = 10, window: str = "hanning") -> np.ndarray:
    """Weighted means of `length` neighbours of a curve that goes on as its mirror image; weights sum to 1.

    The result has a value for every stretch that touches the curve.  Shorter curves, and lengths below 3, stay as they are.
    """
    if min(len(x), length) < max(length, 3):
        return x
    weights = WINDOWS[window](length)
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, length - 1, "reflect"), length) @ (weights / weights.sum())


def slope_cut(occ: DataFrame, width: int = 10, part: float = 0.01) -> DataFrame:
    """The k-mers, by falling views, up to where the smoothed slope of block means falls below `part` of the steepest one.

    All is read off the cumulated counts and sums of the histogram, a row for each number of views; the curve of blocks is drawn
    only as far as the cut, and doubles while it is not found.
    """
    counts = np.array(sorted(((r["nview"], r["n"]) for r in view_histogram(occ).collect()), reverse=True), float).reshape(-1, 2)
    ends = np.concatenate(([0.0], np.cumsum(counts[:, 1])))
    sums = np.concatenate(([0.0], np.cumsum(counts[:, 0] * counts[:, 1])))
    blocks = int(ends[-1]) // width

    def slopes(at: np.ndarray) -> np.ndarray:
        """Mean of the block after each minus its own; sums grow in a line within equal views."""
        low, middle, high = (np.interp((at + i) * width, ends, sums) for i in range(3))
        return (high - 2 * middle + low) / width

    if blocks < 2:
        return occ.limit(0)
    # slopes differ from 0 only beside blocks where the number of views changes
    near = np.unique(np.clip((ends[1:-1] // width).astype(int)[:, None] + np.arange(-2, 2), 0, blocks - 2)) if len(counts) > 1 else np.zeros(1, int)
    steepest, drawn, keep = slopes(near).min(), 0, 0
    while drawn < blocks - 1 and not keep:
        drawn = min(blocks - 1, max(1024, 2 * drawn))
        found = np.flatnonzero(smooth(slopes(np.arange(drawn))) > steepest * part)
        keep = int(found[0]) if len(found) and (found[0] < drawn or drawn == blocks - 1) else 0  # what lies beyond the drawn part is not mirrored yet
        if len(found) and not found[0]:
            break
    return occ.orderBy(F.desc("nview"), "kmer_id").limit(keep * width)


def running_counts(counts: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """`counts` (key, n), a row a key, with upto: the sum of n of all keys up to its own; keys are cut into `parts` ranges, summed apart."""
    shares = [i / parts for i in range(1, parts)]
    cut = sorted(set(counts.agg(F.percentile_approx(key, shares)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c <= F.col(key))) if cut else F.lit(0)
    placed = counts.withColumn("_part", part)
    totals = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.sum("n").over(Window.partitionBy("_part").orderBy(key))
    return placed.join(F.broadcast(before), "_part").select(*counts.columns, (own + F.col("_before")).alias("upto"))


def view_bins(occ: DataFrame, bins: int = 20) -> DataFrame:
    """(bin from 1, n): equal-width histogram of views; the largest value belongs to the last bin."""
    low, high = occ.agg(F.min("nview"), F.max("nview")).first()
    at = F.least(F.lit(bins), F.floor((F.col("nview") - F.lit(low)) * bins / F.lit((high - low) or 1)) + 1) if low is not None else F.lit(1)
    return occ.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def view_profile(occ: DataFrame) -> DataFrame:
    """Mean, largest and standard deviation (of the population) of each run's views."""
    return occ.groupBy("run").agg(F.avg("nview").alias("mean"), F.max("nview").alias("most"), F.stddev_pop("nview").alias("deviation"))


def group_spread(dense: DataFrame, samples: DataFrame) -> DataFrame:
    """(kmer_id, ord, spread) of dense rows: (value - median) / MAD in the sample's group; 0 where the MAD is 0."""
    cells = dense.select("kmer_id", F.posexplode("vals").alias("ord", "val")).join(samples.select("ord", "grp"), "ord")
    middle = cells.groupBy("kmer_id", "grp").agg(F.median("val").alias("mid"))
    off = cells.join(middle, ["kmer_id", "grp"])
    mad = off.groupBy("kmer_id", "grp").agg(F.median(F.abs(F.col("val") - F.col("mid"))).alias("mad"))
    return off.join(mad, ["kmer_id", "grp"]).select("kmer_id", "ord", F.coalesce(F.try_divide(F.col("val") - F.col("mid"), F.col("mad")), F.lit(0.0)).alias("spread"))


def sum_buckets(matrix: DataFrame) -> DataFrame:
    """(kmer_id, total, bucket): features of about equal totals side by side, a bucket as large as the most frequent total.

    Cumulative counts run over the distinct totals, not over the features.
    """
    sums = matrix.groupBy("kmer_id").agg(F.sum("val").alias("total"))
    counts = sums.groupBy("total").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    placed = running_counts(counts, "total").select("total", F.floor((F.col("upto") - 1) / most).alias("bucket"))
    return sums.join(placed, "total").select("kmer_id", "total", "bucket")


def variability(dense: DataFrame, bins: int = 20) -> DataFrame:
    """(kmer_id, ratio, bin, z): mean over variance, its bin of `bins` by rank, and its z-score there; constant rows have none.

    Ranks come from counts of distinct ratios, so features are not sorted in one task; equal ratios share a bin.
    """
    sums = F.aggregate("vals", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, x: F.struct((t["s"] + x).alias("s"), (t["q"] + x * x).alias("q")))
    rows = dense.select("kmer_id", F.size("vals").alias("n"), F.explode(F.array(sums)).alias("t")).select("kmer_id", "n", "t.s", "t.q")
    ratio = F.try_divide(F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    ratio = rows.select("kmer_id", F.round(ratio, 9).alias("ratio")).where("ratio IS NOT NULL")
    counts = ratio.groupBy("ratio").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    ranked = running_counts(counts, "ratio").select("ratio", F.floor((F.col("upto") - F.col("n")) * bins / total).alias("bin"))
    binned = ratio.join(ranked, "ratio")
    stats = binned.groupBy("bin").agg(F.avg("ratio").alias("mid"), F.stddev_samp("ratio").alias("dev"))
    return binned.join(F.broadcast(stats), "bin").select("kmer_id", "ratio", "bin", F.try_divide(F.col("ratio") - F.col("mid"), F.col("dev")).alias("z"))  # `bins` rows
