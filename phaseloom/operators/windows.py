"""Sample windows and per-window signal features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from phaseloom.operators.ordered import last_known, ranges, with_carry
from phaseloom.operators.surrogates import in_groups

#: Series whose sizes are broadcast, at most; rows of a piece of a series.
SERIES, PIECE = 100_000, 8_192


def whole(keys: list[str], order: str) -> WindowSpec:
    """All rows of a key, added up in their order: a mean has the same last bits wherever the rows came from.

    Values that lie on the mean, or means on the edge between two rounded numbers, fall to one side or the other by them.
    """
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def with_mean(df: DataFrame, v: str, keys: list[str], order: str, name: str) -> DataFrame:
    """df with the mean of each key's values, to which the mean of what they leave over is added.

    Doubles lose their last bits in a sum, and a value that lies on the mean would fall under it by them; the second
    sum is of small numbers, and gives these bits back.
    """
    over = whole(keys, order)
    df = df.withColumn("__rough", F.avg(v).over(over))
    rest = F.avg(F.col(v) - F.col("__rough")).over(over)
    return df.withColumn(name, F.nanvl(F.col("__rough") + rest, F.col("__rough"))).drop("__rough")


def tumbling(samples: DataFrame, keys: list[str], length: int, cap: int | None = None) -> DataFrame:
    """(keys, w, n_samples, status): windows of a series; a series shorter than one window gives one row marked short_window.

    cap keeps the first windows of each series.
    """
    n = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    full = F.floor(F.col("n") / length).cast("int")
    last = F.least(full, F.lit(cap)) if cap is not None else full
    w = F.when(full == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1))
    return n.select(*keys, F.explode(w).alias("w"), F.when(full == 0, F.col("n")).otherwise(length).cast("long").alias("n_samples"), F.when(full == 0, "short_window").otherwise("ok").alias("status"))


def spaced(samples: DataFrame, keys: list[str], length: int, count: int) -> DataFrame:
    """(keys, w, start): count windows evenly over the usable span; they may overlap."""
    n = samples.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= length)
    w = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("w"))
    return w.select(*keys, "w", F.floor(F.col("w") * (F.col("n") - length) / max(count - 1, 1)).cast("int").alias("start"))


def sliding(samples: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """samples with w, once for each full window that holds them; windows start at multiples of step."""
    sizes = samples.groupBy(*keys).agg(F.count("*").alias("__size"))
    samples = samples.join(F.broadcast(sizes) if sizes.count() <= SERIES else sizes, keys)
    lo = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / step)).cast("int")
    hi = F.least(F.floor(F.col("n") / step), F.floor((F.col("__size") - length) / step)).cast("int")
    s = samples.withColumn("__lo", lo).withColumn("__hi", hi).filter(F.col("__lo") <= F.col("__hi"))
    return s.withColumn("w", F.explode(F.sequence("__lo", "__hi"))).drop("__size", "__lo", "__hi")


def trailing_drops(series: DataFrame, keys: list[str], order: str, x: str, lag: int = 5, z: float = 3.0) -> DataFrame:
    """(keys, order, z): how far a value lies below the mean of the lag values before it, where over z standard deviations.

    order numbers the rows of a series without gaps: they are cut into pieces of that order, each with the lag rows before it.
    """
    piece = F.floor(F.col(order) / PIECE).cast("long")
    mine = F.when(F.col(order) % PIECE >= PIECE - lag, F.array(piece, piece + 1)).otherwise(F.array(piece))
    back = W.partitionBy(*keys, "__piece").orderBy(order).rowsBetween(-lag, -1)
    series = series.select(*keys, order, x, F.explode(mine).alias("__piece"))
    s = series.select(*keys, order, x, (piece == F.col("__piece")).alias("__own"), F.avg(x).over(back).alias("mu"), F.stddev_pop(x).over(back).alias("sigma"), F.count(x).over(back).alias("__n"))
    s = s.filter(F.col("__own") & (F.col("__n") == lag) & (F.col("sigma") > 1e-9)).withColumn("z", (F.col("mu") - F.col(x)) / F.col("sigma"))
    return s.filter(F.col("z") > z).select(*keys, order, "z")


def refractory(hits: DataFrame, keys: list[str], order: str, gap: int = 3) -> DataFrame:
    """(keys, order): hits that are at least gap after the last one kept.

    A hit that lies gap or more after the one before it is kept whatever came before, so the hits fall into islands that
    are worked on apart, many in a batch; one group is one island of hits in close succession. Islands are cut within
    ranges of the hits, to which the last hit and the last island of the ranges before are carried.
    """
    h = ranges(hits.select(*keys, F.col(order).cast("long").alias(order)), keys, [order])
    ends = h.groupBy("__part", *keys).agg(F.max(order).alias("__last"))
    carry = ends.withColumn("__carry", F.max("__last").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    h = with_carry(h.withColumn("__before", F.lag(order).over(W.partitionBy("__part", *keys).orderBy(order))), keys, carry)
    fresh = F.coalesce(F.col(order) - F.coalesce("__before", "__carry") >= gap, F.lit(True))
    h = last_known(h.select("__part", *keys, order, F.when(fresh, F.col(order)).alias("__fresh")), keys, [order], F.col("__fresh"), "__island")

    def make(part: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        at, keep = part[order].to_numpy(), np.zeros(ends[-1], bool)
        keep[starts] = True
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            last = at[a]
            for i in range(a + 1, b):
                if at[i] - last >= gap:
                    keep[i], last = True, at[i]
        return part.iloc[np.flatnonzero(keep)][[*keys, order]]

    types = dict(h.dtypes)
    return in_groups(h.select(*keys, "__island", order), [*keys, "__island"], [order], make, ", ".join(f"{k} {types[k]}" for k in [*keys, order]))


def scaled(df: DataFrame, col: str, keys: list[str] | None = None) -> Column:
    """Min-max scaling within keys, 0.5 where all values are equal."""
    over = W.partitionBy(*(keys or [F.lit(0)]))
    lo, hi = F.min(col).over(over), F.max(col).over(over)
    return F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((F.col(col) - lo) / (hi - lo))


def znorm(col: str, keys: list[str]) -> Column:
    """Difference from the mean in standard deviations within keys; 0 where there is no spread."""
    over = W.partitionBy(*keys)
    sd = F.stddev_pop(col).over(over)
    return F.when(sd < 1e-12, F.lit(0.0)).otherwise((F.col(col) - F.avg(col).over(over)) / sd)


def binary_activity(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v") -> DataFrame:
    """(keys, active, transitions): share of samples whose channel mean lies above the window's mean, and sign changes."""
    m = windowed.groupBy(*keys, order).agg(F.avg(v).alias("m"))
    on = (F.col("m") > F.avg("m").over(W.partitionBy(*keys))).cast("int")
    m = m.withColumn("on", on).withColumn("was", F.lag("on").over(W.partitionBy(*keys).orderBy(order)))
    return m.groupBy(*keys).agg(F.avg("on").alias("active"), F.coalesce(F.sum((F.col("on") != F.col("was")).cast("int")), F.lit(0)).alias("transitions"))


def artifact(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v") -> DataFrame:
    """(keys, artifact_score, flat_ratio, clip_ratio, outlier_ratio)."""
    at = W.partitionBy(*keys)
    s = windowed.withColumn("jump", F.abs(F.col(v) - F.lag(v).over(at.orderBy(order)))).withColumn("mu", F.avg(v).over(at)).withColumn("sd", F.stddev_pop(v).over(at)).withColumn("lo", F.min(v).over(at)).withColumn("hi", F.max(v).over(at))
    share = lambda c: F.avg(c.cast("double"))
    return s.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.avg("jump") / (F.max("sd") + 1e-6)).alias("artifact_score"), share(F.coalesce(F.col("jump") < 1e-9, F.lit(False))).alias("flat_ratio"), share((F.col(v) == F.col("lo")) | (F.col(v) == F.col("hi"))).alias("clip_ratio"), share(F.abs(F.col(v) - F.col("mu")) > 3 * F.col("sd")).alias("outlier_ratio")
    )


def rounded_entropy(windowed: DataFrame, keys: list[str], v: str = "v", digits: int = 1) -> DataFrame:
    """(keys, entropy): bits of the histogram of values rounded to so many digits."""
    h = windowed.groupBy(*keys, F.round(v, digits).alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(*keys))
    return h.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def binned_entropy(windowed: DataFrame, keys: list[str], v: str = "v", bins: int = 10) -> DataFrame:
    """(keys, entropy): entropy of equal bins between least and largest value, as a share of its maximum."""
    at = W.partitionBy(*keys)
    lo, hi = F.min(v).over(at), F.max(v).over(at)
    b = F.when(hi > lo, F.least(F.floor((F.col(v) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    h = windowed.withColumn("b", b).groupBy(*keys, "b").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(at)
    return h.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(bins)))).alias("entropy"))


def substring_diversity(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v", longest: int = 4) -> DataFrame:
    """(keys, lzc): distinct substrings of up to so many symbols of the thresholded series, for each sample."""
    at = W.partitionBy(*keys)
    s = with_mean(windowed, v, keys, order, "__mean").withColumn("bit", F.when(F.col(v) >= F.col("__mean"), "1").otherwise("0"))
    run = at.orderBy(order)
    parts = [F.when(F.lead("bit", k - 1).over(run).isNotNull(), F.concat(*[F.lead("bit", i).over(run) if i else F.col("bit") for i in range(k)])) for k in range(1, longest + 1)]
    s = s.select(*keys, F.array(*parts).alias("subs"), F.count("*").over(at).alias("n")).select(*keys, "n", F.explode(F.array_compact("subs")).alias("sub"))
    return s.groupBy(*keys).agg((F.countDistinct("sub") / F.max("n")).alias("lzc"))


def power(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v") -> DataFrame:
    s = windowed.withColumn("p", F.avg(F.col(v) * F.col(v)).over(whole(keys, order)))
    return s.groupBy(*keys).agg(F.max("p").alias("power"))


def spectrum(windowed: DataFrame, keys: list[str], length: int, order: str = "k", v: str = "v") -> DataFrame:
    """(keys, f, re, im, power): one-sided discrete Fourier sums of each window, bin by bin."""
    s = windowed.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = 2 * F.pi() * F.col(order) * F.col("f") / length
    out = s.groupBy(*keys, "f").agg(F.sum(F.col(v) * F.cos(angle)).alias("re"), (-F.sum(F.col(v) * F.sin(angle))).alias("im"))
    return out.withColumn("power", F.col("re") ** 2 + F.col("im") ** 2)


def permutation_entropy(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v") -> DataFrame:
    """(keys, entropy): normalised entropy of the order patterns of three samples in a row; ties keep the earlier first."""
    run = W.partitionBy(*keys).orderBy(order)
    a, b, c = F.col(v), F.lead(v, 1).over(run), F.lead(v, 2).over(run)
    s = windowed.select(*keys, a.alias("a"), b.alias("b"), c.alias("c")).filter(F.col("c").isNotNull())
    pattern = (F.col("b") < F.col("a")).cast("int") * 4 + (F.col("c") < F.col("a")).cast("int") * 2 + (F.col("c") < F.col("b")).cast("int")
    h = s.groupBy(*keys, pattern.alias("pattern")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*keys))
    return h.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(6.0))).alias("entropy"))
