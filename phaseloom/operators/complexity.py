"""Complexity of series, graphs and evoked epochs, and clusters with their lineages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import ordered
from phaseloom.operators.plugins import f_tail
from phaseloom.operators.windows import SERIES
from phaseloom.sources.readers import checkpointed


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{k} {types[k]}" for k in keys), more])


def in_order(windowed: DataFrame, keys: list[str], order: str = "k", v: str = "v") -> DataFrame:
    """(keys, s): the samples of each window as one array; windows have a fixed, small number of samples."""
    return windowed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(v).alias("v")))), lambda x: x["v"]).alias("s"))


def sample_entropy(windowed: DataFrame, keys: list[str], m: int = 2, share: float = 0.2) -> DataFrame:
    """(keys, entropy): -ln of the share of templates alike in m samples, within share standard deviations, that stay alike in one more.

    Null where no templates are alike. Each pair of templates of a window is compared once, inside the window's row.
    """
    a = in_order(windowed, keys).withColumn("n", F.size("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / F.col("n")
    a = a.withColumn("r", share * F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.col("n")))

    def alike(size: int):  # noqa: ANN202
        same = lambda i, j: F.forall(F.sequence(F.lit(0), F.lit(size - 1)), lambda o: F.abs(F.get("s", i + o) - F.get("s", j + o)) <= F.col("r"))
        starts = F.sequence(F.lit(0), F.col("n") - m - 1)
        return F.aggregate(F.transform(starts, lambda i: F.size(F.filter(starts, lambda j: (j > i) & same(i, j)))), F.lit(0), lambda t, x: t + x)

    a = a.withColumn("b", alike(m)).withColumn("c", alike(m + 1))
    return a.select(*keys, F.when((F.col("b") > 0) & (F.col("c") > 0), -F.ln(F.col("c") / F.col("b"))).alias("entropy"))


def fractal_dimension(windowed: DataFrame, keys: list[str], steps: int = 4, order: str = "k", v: str = "v") -> DataFrame:
    """(keys, dimension): Higuchi's, the slope of log curve length over log 1 / step for steps of 1 to `steps` samples."""
    at = W.partitionBy(*keys).orderBy(order)
    size = F.count("*").over(W.partitionBy(*keys))
    ahead = F.array(*[F.struct(F.lit(k).alias("step"), F.abs(F.lead(v, k).over(at) - F.col(v)).alias("d")) for k in range(1, steps + 1)])
    d = windowed.select(*keys, F.col(order).alias("k"), size.alias("n"), ahead.alias("x"))
    d = d.select(*keys, "k", "n", F.explode("x").alias("x")).select(*keys, "k", "n", "x.step", "x.d").filter("d is not null").withColumn("m", F.col("k") % F.col("step"))
    full = F.floor((F.first("n") - 1 - F.col("m")) / F.col("step"))
    lengths = d.groupBy(*keys, "step", "m").agg((F.sum("d") * (F.first("n") - 1) / full / F.col("step") / F.col("step")).alias("l"))
    mean = lengths.groupBy(*keys, "step").agg(F.avg("l").alias("l")).filter("l > 0")
    return mean.groupBy(*keys).agg(F.regr_slope(F.ln("l"), F.ln(1 / F.col("step"))).alias("dimension"))


#: Series of fewer samples give no multifractal estimates.
LEAST_SAMPLES = 1_000
#: The 16 powers from -4 to 4 in steps of one half, without 0.
POWERS = [k / 2 for k in range(-8, 9) if k]


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows, in ranges, with the place of each in its series, from 0."""
    return ordered.running_sum(ordered.ranges(rows, keys, order), keys, order, F.lit(1), name)


def profile(series: DataFrame, keys: list[str], order: str, v: str) -> DataFrame:
    """series with y, the running sum of the differences from the series' mean up to each sample."""
    means = series.groupBy(*keys).agg(F.avg(v).alias("__mean"))
    x = series.join(F.broadcast(means) if means.count() <= SERIES else means, keys).withColumn("__d", F.col(v) - F.col("__mean"))
    x = ordered.running_sum(ordered.ranges(x, keys, [order]), keys, [order], F.col("__d"), "__y")
    return x.withColumn("y", F.col("__y") + F.col("__d")).drop("__mean", "__d", "__y", "__part")


def multifractal(series: DataFrame, keys: list[str], order: str, v: str, powers: list[float] = POWERS, least: int = LEAST_SAMPLES) -> DataFrame:
    """(keys, n, q, h, tau, alpha, f): detrended fluctuation exponents h(q), their masses tau = q h - 1 and the singularity spectrum.

    alpha is the slope of tau over neighbouring powers, one-sided at the ends, and f = q alpha - tau. Lags are up to 30
    whole numbers over 2, evenly spaced in the logarithm up to a quarter of the series; the profile, a running sum over
    ranges, is cut into boxes of each lag from its start and from its end, each detrended by a line. Series of fewer than
    `least` samples, or with fewer than five lags, give one row of nulls. order numbers the samples from 0 without gaps.
    """
    stats = series.groupBy(*keys).agg(F.count("*").alias("__size"))
    top = F.log10(F.col("__size") / 4)
    lags = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.floor(F.pow(F.lit(10.0), 0.7 + i * (top - 0.7) / 29) + 1e-9).cast("long")))
    stats = checkpointed(stats.withColumn("lags", F.filter(lags, lambda s: s > 2)), "series")
    usable = stats.filter((F.col("__size") >= least) & (F.size("lags") >= 5)).select(*keys, "__size", "lags")
    x = series.select(*keys, order, v).join(F.broadcast(usable) if usable.count() <= SERIES else usable, keys)
    x = profile(x, keys, order, v).select(*keys, order, "__size", "y", F.explode("lags").alias("s"))
    boxes = F.array(F.floor(F.col(order) / F.col("s")), F.when(F.col(order) >= F.col("__size") % F.col("s"), -1 - F.floor((F.col(order) - F.col("__size") % F.col("s")) / F.col("s"))))
    x = x.select(*keys, F.col(order).alias("t"), "y", "s", F.explode(F.array_compact(boxes)).alias("box"))
    rss = F.regr_syy("y", "t") - F.regr_sxy("y", "t") ** 2 / F.regr_sxx("y", "t")
    b = x.groupBy(*keys, "s", "box").agg(F.count("*").alias("held"), rss.alias("rss")).filter("held = s").withColumn("f2", F.greatest(F.col("rss") / F.col("held"), F.lit(1e-30)))
    f = b.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in powers]))).groupBy(*keys, "s", "q").agg(F.avg(F.pow("f2", F.col("q") / 2)).alias("m"))
    h = f.groupBy(*keys, "q").agg(F.regr_slope(F.ln("m") / F.col("q"), F.ln("s")).alias("h")).withColumn("tau", F.col("q") * F.col("h") - 1)
    by = W.partitionBy(*keys).orderBy("q")  # as many rows a series as there are powers
    ahead, behind = (lambda c: F.coalesce(F.lead(c).over(by), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(by), F.col(c)))
    h = h.withColumn("alpha", (ahead("tau") - behind("tau")) / (ahead("q") - behind("q"))).withColumn("f", F.col("q") * F.col("alpha") - F.col("tau"))
    return stats.select(*keys, F.col("__size").alias("n")).join(h, keys, "left")


def singularity_width(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, alpha_min, alpha_max, width) of multifractal(); null where there is no spectrum."""
    known = F.when(F.abs("alpha") < float("inf"), F.col("alpha"))
    return spectrum.groupBy(*keys).agg(F.max("n").alias("n"), F.min(known).alias("alpha_min"), F.max(known).alias("alpha_max")).withColumn("width", F.col("alpha_max") - F.col("alpha_min"))


def graph_paths(edges: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """(keys, global_efficiency, small_worldness) of unweighted graphs of a fixed number of channels; one group is one window's graph.

    Efficiency is the mean of 1 / distance over all pairs, 0 where there is no path. Small-worldness is transitivity over
    that of a random graph of the density, divided by mean path length (of the components' means, where there are several)
    over ln n / ln mean degree.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        link = np.zeros((channels, channels), bool)
        link[pdf["a"], pdf["b"]] = link[pdf["b"], pdf["a"]] = True
        far = np.where(link, 1.0, np.inf)
        np.fill_diagonal(far, 0)
        for k in range(channels):
            far = np.minimum(far, far[:, k : k + 1] + far[k])
        above = np.triu_indices(channels, 1)
        efficiency = float((1 / far[above]).mean())
        parts = {tuple(np.flatnonzero(np.isfinite(row))) for row in far}
        inner = [far[np.ix_(p, p)][np.triu_indices(len(p), 1)].mean() for p in parts if len(p) > 1]
        degree = link.sum(1)
        triads, closed = (degree * (degree - 1)).sum(), np.trace(np.linalg.matrix_power(link.astype(int), 3))
        density, mean = link.sum() / (channels * (channels - 1)), degree.mean()
        clustering, length = (closed / triads if triads else 0.0), (float(np.mean(inner)) if inner else 0.0)
        random = np.log(channels) / np.log(max(mean, 1.001)) if mean > 1 else 1.0
        small = float(clustering / density / (length / random)) if density > 0 and length > 0 else 0.0
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "global_efficiency": efficiency, "small_worldness": small}])

    return edges.select(*keys, "a", "b").groupBy(*keys).applyInPandas(run, _schema(edges, keys, "global_efficiency double, small_worldness double"))


def evoked_complexity(epochs: DataFrame, keys: list[str], onset: int, k: float = 1.2, min_snr: float = 1.1, variance: float = 99.0, steps: int = 100) -> DataFrame:
    """(keys, complexity, n_components): state transitions of evoked epochs; samples before onset are the baseline.

    The response is reduced to the principal components that hold so much of its variance and whose response stands out
    of the baseline. A component's distances between samples are cut at many thresholds; how much oftener they cross one
    in the response than k times in the baseline, at best, is summed over the components. epochs(keys, channel, k, v):
    one group is one epoch.
    """

    def flips(d: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        near = d[None] <= thresholds[:, None, None]
        return (near[:, :, 1:] != near[:, :, :-1]).sum((1, 2)) / len(d) ** 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="channel", columns="k", values="v").sort_index().sort_index(axis=1)
        signal, response = x.to_numpy(float), np.asarray(x.columns) >= onset
        total, kept = 0.0, 0
        if np.isfinite(signal).all() and response.sum() >= 2 and (~response).sum() >= 2:
            size, basis = np.linalg.svd(signal[:, response].T, full_matrices=False)[1:]
            power = np.cumsum(size**2) / max((size**2).sum(), 1e-300)
            parts = basis[: int(np.searchsorted(power, variance / 100) + 1)] @ signal
            before, after = parts[:, ~response], parts[:, response]
            with np.errstate(divide="ignore", invalid="ignore"):
                snr = np.sqrt((after**2).mean(1) / (before**2).mean(1))
            for b, a in zip(before[np.isfinite(snr) & (snr > min_snr)], after[np.isfinite(snr) & (snr > min_snr)], strict=True):
                kept += 1
                db, da = np.abs(b[:, None] - b), np.abs(a[:, None] - a)
                if da.max() > np.median(db):
                    at = np.linspace(np.median(db), da.max(), steps)
                    total += max(float((flips(da, at) - k * flips(db, at)).max()), 0.0) * len(a)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "complexity": total, "n_components": kept}])

    return epochs.select(*keys, "channel", "k", "v").groupBy(*keys).applyInPandas(run, _schema(epochs, keys, "complexity double, n_components int"))


def lagged_tests(windowed: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, source, target, lag, f, p): whether the past of source improves a linear prediction of target, for lags up to longest.

    F compares the residuals of the target's own past with those of both pasts. One group is one window, whose channels
    are few; null where the window is too short for the lag.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="k", columns="channel", values="v").sort_index()
        values, out = x.to_numpy(float), []
        left = lambda y, z: float(((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum())
        for lag in range(1, longest + 1):
            n = len(values) - lag
            past = [np.column_stack([values[lag - i - 1 : len(values) - i - 1, c] for i in range(lag)]) for c in range(values.shape[1])]
            for b, target in enumerate(x.columns):
                own = np.column_stack([np.ones(n), past[b]])
                rss0 = left(values[lag:, b], own)
                for a, source in enumerate(x.columns):
                    free = n - 2 * lag - 1
                    if a == b:
                        continue
                    f = None
                    if free > 0:
                        rss1 = left(values[lag:, b], np.column_stack([own, past[a]]))
                        f = max((rss0 - rss1) / lag / (rss1 / free), 0.0) if rss1 > 1e-12 else None
                    out.append((source, target, lag, f, None if f is None else f_tail(f, lag, free)))
        frame = pd.DataFrame(out, columns=["source", "target", "lag", "f", "p"]).assign(**{k: pdf[k].iloc[0] for k in keys})
        return frame[[*keys, "source", "target", "lag", "f", "p"]]

    kind = dict(windowed.dtypes)["channel"]
    return windowed.select(*keys, "channel", "k", "v").groupBy(*keys).applyInPandas(run, _schema(windowed, keys, f"source {kind}, target {kind}, lag int, f double, p double"))


def spatial_clusters(points: DataFrame, keys: list[str], least: int = 3, eps: float | None = None) -> DataFrame:
    """(keys, cluster, x, y, charge, size, eps): density clusters of the points of each frame; cluster -1 stands for the noise, without a place.

    eps: radius, by default the median distance to the nearest other point. Frames of fewer than `least` points have no
    clusters: all their points are noise. points(keys, id, x, y, charge); one group is one frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        xy, n = pdf[["x", "y"]].to_numpy(float), len(pdf)
        label, radius = np.full(n, -1), float(eps or 0.0)
        if n >= least:
            d = np.hypot(*(xy[:, None] - xy).T)
            radius = eps if eps is not None else float(np.median(np.where(np.eye(n, dtype=bool), np.inf, d).min(1)))
            near = d <= radius
            core = near.sum(1) >= least
            found = 0
            for i in np.flatnonzero(core):  # in order: a border point joins the first cluster that reaches it
                if label[i] >= 0:
                    continue
                label[i], todo = found, [i]
                while todo:
                    j = todo.pop()
                    if core[j]:
                        fresh = np.flatnonzero(near[j] & (label < 0))
                        label[fresh] = found
                        todo += fresh.tolist()
                found += 1
        out = [(c, *xy[label == c].mean(0), float(pdf["charge"][label == c].sum()), int((label == c).sum()), radius) for c in range(label.max() + 1)]
        out.append((-1, None, None, float(pdf["charge"][label < 0].sum()), int((label < 0).sum()), radius))
        frame = pd.DataFrame(out, columns=["cluster", "x", "y", "charge", "size", "eps"]).astype({"x": float, "y": float}).assign(**{k: pdf[k].iloc[0] for k in keys})
        return frame[[*keys, "cluster", "x", "y", "charge", "size", "eps"]]

    return points.select(*keys, "id", "x", "y", "charge").groupBy(*keys).applyInPandas(run, _schema(points, keys, "cluster int, x double, y double, charge double, size int, eps double"))


def cluster_links(clusters: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, frame, cluster, next): each cluster's nearest one in the next frame, within twice the radius of its own frame.

    A cluster of the next frame is taken by the first that has it as its nearest. One group is one pair of frames.
    """
    c = clusters.filter("cluster >= 0").select(*keys, frame, "cluster", "x", "y", "eps")
    both = c.withColumn("pair", F.col(frame)).withColumn("side", F.lit(0)).unionByName(c.withColumn("pair", F.col(frame) - 1).withColumn("side", F.lit(1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("cluster") for s in (0, 1))
        out, used = [], set()
        for _, r in a.iterrows():
            if len(b):
                d = np.hypot(b["x"] - r["x"], b["y"] - r["y"]).to_numpy()
                j = int(d.argmin())
                if j not in used and 0 < r["eps"] and d[j] <= 2 * r["eps"]:
                    used.add(j)
                    out.append((r[frame], r["cluster"], b["cluster"].iloc[j]))
        return pd.DataFrame(out, columns=[frame, "cluster", "next"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, frame, "cluster", "next"]]

    kind = dict(clusters.dtypes)[frame]
    return both.groupBy(*keys, "pair").applyInPandas(run, _schema(clusters, keys, f"{frame} {kind}, cluster int, next int"))


def spin_assignments(sensors: DataFrame, spins: int, seed: int, reflect: bool = True) -> DataFrame:
    """(spin, channel, source): which sensor's value each sensor gets after a rigid rotation about the centre, each value used once.

    Sensors with the nearest match choose first. spin 0 leaves all where they are. sensors(channel, x, y) is a montage, a
    small table of the recording's layout; one group is one spin.
    """
    montage = sensors.withColumn("spin", F.explode(F.sequence(F.lit(0), F.lit(spins))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, spin = pdf.sort_values("channel"), int(pdf["spin"].iloc[0])
        xy = pdf[["x", "y"]].to_numpy(float)
        xy = xy - xy.mean(0)
        rng = np.random.default_rng([seed, spin])
        turn = rng.uniform(0, 2 * np.pi) if spin else 0.0
        rot = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        if spin and reflect and rng.random() < 0.5:
            rot = rot @ np.diag([1.0, -1.0])
        d = ((xy[:, None] - (xy @ rot.T)[None]) ** 2).sum(2)
        source, free = np.zeros(len(xy), int), np.ones(len(xy), bool)
        for i in np.argsort(d.min(1), kind="stable"):
            source[i] = int(np.where(free, d[i], np.inf).argmin())
            free[source[i]] = False
        return pd.DataFrame({"spin": spin, "channel": pdf["channel"].to_numpy(), "source": pdf["channel"].to_numpy()[source]})

    return montage.groupBy("spin").applyInPandas(run, "spin int, channel long, source long")
