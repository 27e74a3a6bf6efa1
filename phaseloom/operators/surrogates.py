"""Surrogate series and metrics that need linear algebra, one group of a window at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _seed(*parts) -> int:  # noqa: ANN002
    import hashlib

    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def channel_shuffle(windowed: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Channels renumbered by the order of a hash of (seed, keys, channel)."""
    ch = windowed.select(*keys, "channel").distinct()
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("channel").cast("string")), 256)
    to = ch.withColumn("new", (F.row_number().over(W.partitionBy(*keys).orderBy(digest)) - 1).cast("long"))
    return windowed.join(to, [*keys, "channel"]).withColumn("channel", F.col("new")).drop("new")


def time_reverse(windowed: DataFrame, keys: list[str], order: str = "k") -> DataFrame:
    """Samples of each window in reverse."""
    return windowed.withColumn(order, F.max(order).over(W.partitionBy(*keys)) - F.col(order))


def randomized(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series with the same amplitude spectrum and random phases; the mean and the Nyquist part stay real."""
    spec = np.fft.rfft(x)
    turn = np.exp(1j * rng.uniform(0, 2 * np.pi, len(spec)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(spec * turn, len(x))


def adjusted(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """A series with the values of x and nearly its amplitude spectrum, by alternating between the two."""
    return _adjust(x[None], rng.permutation(x)[None], rounds)[0]


def _adjust(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> np.ndarray:
    """adjusted() of the rows of x, each begun with its permutation in y."""
    amp, ranked = np.abs(np.fft.rfft(x, axis=1)), np.sort(x, axis=1)
    for _ in range(rounds):
        spec = np.fft.rfft(y, axis=1)
        y = np.fft.irfft(amp * np.exp(1j * np.angle(spec)), x.shape[1], axis=1)
        y = np.take_along_axis(ranked, np.argsort(np.argsort(y, axis=1, kind="stable"), axis=1, kind="stable"), axis=1)
    return y


def drawn(x: np.ndarray, generators: list[np.random.Generator], kind: str = "ft") -> np.ndarray:
    """(draws, samples): a surrogate of the series for each generator; Fourier transforms are taken of all at once."""
    if kind != "ft":
        return _adjust(np.tile(x, (len(generators), 1)), np.stack([g.permutation(x) for g in generators]))
    spec = np.fft.rfft(x)
    turn = np.exp(1j * np.stack([g.uniform(0, 2 * np.pi, len(spec)) for g in generators]))
    turn[:, 0] = 1
    if len(x) % 2 == 0:
        turn[:, -1] = 1
    return np.fft.irfft(spec * turn, len(x), axis=1)


def in_groups(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """make(part, starts, ends) of sorted rows that hold whole groups of the keys, many at once; a group is part[start:end].

    Groups stand one after the other in their partitions, so a task works on whole batches and a group costs no call from Spark.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def made(part: pd.DataFrame, last: bool) -> tuple[pd.DataFrame | None, pd.DataFrame]:
            before = part[keys].shift()
            fresh = ((part[keys] != before) & ~(part[keys].isna() & before.isna())).any(axis=1).to_numpy()
            fresh[:1] = True
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(part))
            whole = len(starts) if last else len(starts) - 1  # the last group may go on in the next batch
            rest = part.iloc[ends[whole - 1] if whole else 0 :]
            return (make(part, starts[:whole], ends[:whole]) if whole else None), rest

        for b in batches:
            if len(b):
                out, rest = made(pd.concat([*held, b], ignore_index=True), False)
                held = [rest]
                if out is not None:
                    yield out
        if held and len(held[0]):
            yield made(held[0].reset_index(drop=True), True)[0]

    return rows.repartition(places(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def places(spark: SparkSession) -> int:
    """Partitions for work that its rows' bytes do not show: a number that is given is not coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def surrogates(windowed: DataFrame, keys: list[str], count: int, seed: str, kind: str = "ft") -> DataFrame:
    """(keys, channel, surrogate, k, v): count surrogates of each series, made where the series are, in batches of series."""
    per = [*keys, "channel"]

    def make(part: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out, v = [], part["v"].to_numpy(float)
        for a, b, key in zip(starts, ends, part.iloc[starts][per].itertuples(index=False, name=None), strict=True):
            y = drawn(v[a:b], [np.random.default_rng(_seed(seed, *key, i)) for i in range(1, count + 1)], kind)
            out.append(y.ravel())
        at = np.concatenate([np.tile(np.arange(a, b), count) for a, b in zip(starts, ends, strict=True)])
        number = np.concatenate([np.repeat(np.arange(1, count + 1), b - a) for a, b in zip(starts, ends, strict=True)])
        return part.iloc[at][[*per, "k"]].reset_index(drop=True).assign(surrogate=number, v=np.concatenate(out))[[*per, "surrogate", "k", "v"]]

    types = dict(windowed.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in per), "surrogate int", f"k {types['k']}", "v double"])
    return in_groups(windowed.select(*per, "k", "v"), per, ["k"], make, schema)


def surrogate_metrics(windowed: DataFrame, keys: list[str], by: list[str], count: int, seed: str, metric: Callable[[np.ndarray], float], kind: str = "ft") -> DataFrame:
    """(by, observed, nulls): a metric of each group and of its surrogates; null where the metric failed or gave no number.

    by is keys, or keys and channel; the metric gets the samples of a channel, or (channels, samples) of a window. The
    surrogates are those of surrogates() and live only while their group is worked on, so no rows are made of them.
    """
    each = "channel" in by

    def value(x: np.ndarray) -> float | None:
        try:
            v = float(metric(x))
        except Exception:  # a metric may fail on a group; the others go on  # noqa: BLE001
            return None
        return v if v == v else None

    def make(part: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        v, channel, seen, nulls = part["v"].to_numpy(float), part["channel"].to_numpy(), [], []
        for a, b, key in zip(starts, ends, part.iloc[starts][keys].itertuples(index=False, name=None), strict=True):
            cuts = [a, *(a + 1 + np.flatnonzero(channel[a + 1 : b] != channel[a : b - 1])), b]
            series = [v[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            made = [drawn(x, [np.random.default_rng(_seed(seed, *key, channel[i], n)) for n in range(1, count + 1)], kind) for x, i in zip(series, cuts, strict=False)]
            seen.append(value(series[0] if each else np.stack(series)))
            nulls.append([value(made[0][n] if each else np.stack([m[n] for m in made])) for n in range(count)])
        return part.iloc[starts][by].reset_index(drop=True).assign(observed=seen, nulls=nulls)

    types = dict(windowed.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in by), "observed double", "nulls array<double>"])
    rows = windowed.filter(F.expr(" and ".join(f"`{k}` is not null" for k in by)))
    return in_groups(rows.select(*keys, "channel", "k", "v"), by, ["k"] if each else ["channel", "k"], make, schema)


def gated(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """gate() of the rows of surrogate_metrics()."""
    ok = F.filter("nulls", lambda x: x.isNotNull())
    m = metrics.select(*keys, "observed", ok.alias("ok"), F.size(ok).alias("n"), (F.size("nulls") - F.size(ok)).cast("long").alias("n_failed"))
    total = lambda f: F.aggregate("ok", F.lit(0.0), lambda t, x: t + f(x))
    m = m.withColumn("mean", F.when(F.col("n") > 0, total(lambda x: x) / F.col("n")))
    m = m.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / (F.col("n") - 1))))
    hits = F.size(F.filter("ok", lambda x: x >= F.col("observed")))
    return m.select(*keys, "observed", ((F.col("observed") - F.col("mean")) / F.when(F.col("sd") > 1e-12, F.col("sd"))).alias("z"), ((hits + 1) / (F.col("n") + 1)).alias("p"), "n_failed")


def gate(observed: DataFrame, nulls: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, observed, z, p, n_failed): one-sided (k+1)/(n+1) p of the observed metric among its nulls; nulls may be null."""
    n = nulls.join(observed.withColumnRenamed(metric, "observed"), keys)
    ok = F.col(metric).isNotNull()
    return n.groupBy(*keys).agg(
        F.first("observed").alias("observed"), ((F.first("observed") - F.avg(metric)) / F.when(F.stddev_samp(metric) > 1e-12, F.stddev_samp(metric))).alias("z"), ((F.count_if(ok & (F.col(metric) >= F.col("observed"))) + 1) / (F.count_if(ok) + 1)).alias("p"), F.count_if(~ok).alias("n_failed")
    )


def analytic_signal(windowed: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """(keys, k, theta, amp): phase and amplitude of the part of each series between two Fourier bins."""

    def make(part: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        v, z = part["v"].to_numpy(float), np.zeros(ends[-1], complex)
        for n in np.unique(ends - starts):  # series of one length at once
            at = starts[ends - starts == n][:, None] + np.arange(n)
            f = np.arange(n)
            z[at] = np.fft.ifft(np.where((f >= lo) & (f <= hi), 2 * np.fft.fft(v[at], axis=1), 0), axis=1)
        return part.iloc[: ends[-1]][[*keys, "k"]].assign(theta=np.angle(z), amp=np.abs(z))

    types = dict(windowed.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"k {types['k']}", "theta double", "amp double"])
    return in_groups(windowed.select(*keys, "k", "v"), keys, ["k"], make, schema)


def lagged_predictability(windowed: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
    """(keys, source, target, f): how much the past of source adds to a linear prediction of target from its own past."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="k", columns="channel", values="v").sort_index()
        out, values = [], x.to_numpy()
        n = len(values) - lag
        past = lambda c: [values[lag - i - 1 : len(values) - i - 1, c] for i in range(lag)]
        for b, target in enumerate(x.columns):
            y = values[lag:, b]
            own = np.column_stack([np.ones(n), *past(b)])
            rss0 = float(((y - own @ np.linalg.lstsq(own, y, rcond=None)[0]) ** 2).sum())
            for a, source in enumerate(x.columns):
                if a != b:
                    both = np.column_stack([own, *past(a)])
                    rss1 = float(((y - both @ np.linalg.lstsq(both, y, rcond=None)[0]) ** 2).sum())
                    free = n - both.shape[1]
                    out.append((source, target, (rss0 - rss1) / lag / (rss1 / free) if free > 0 and rss1 > 1e-12 else None))
        return pd.DataFrame(out, columns=["source", "target", "f"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "source", "target", "f"]]

    types = dict(windowed.dtypes)
    return windowed.select(*keys, "channel", "k", "v").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"source {types['channel']}", f"target {types['channel']}", "f double"]))


def graph_shape(edges: DataFrame, keys: list[str], weight: str, threshold: float, channels: int) -> DataFrame:
    """(keys, beta0, beta1, spectral_dimension): components and independent loops, filled triangles taken off, of the graph of strong edges, and twice the slope of the count of its Laplacian eigenvalues in logarithms, 0 for fewer than three."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = {(int(a), int(b)) for a, b, x in zip(pdf["a"], pdf["b"], pdf[weight], strict=True) if x >= threshold}
        index = {e: i for i, e in enumerate(sorted(pairs))}
        root = list(range(channels))

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        beta0 = sum(find(i) == i for i in range(channels))
        pivots: dict[int, int] = {}
        rank = 0
        for a in range(channels):
            for b in range(a + 1, channels):
                for c in range(b + 1, channels):
                    if {(a, b), (b, c), (a, c)} <= pairs:
                        row = 1 << index[a, b] | 1 << index[b, c] | 1 << index[a, c]
                        while row and row.bit_length() in pivots:
                            row ^= pivots[row.bit_length()]
                        if row:
                            pivots[row.bit_length()] = row
                            rank += 1
        link = np.zeros((channels, channels))
        for a, b in pairs:
            link[a, b] = link[b, a] = 1
        frequencies = np.linalg.eigvalsh(np.diag(link.sum(1)) - link)
        frequencies = frequencies[frequencies > 1e-9]
        slope = 0.0  # too few to fit
        if len(frequencies) >= 3:
            counted = np.log(np.arange(1, len(frequencies) + 1))
            slope = 2 * float(np.polyfit(np.log(frequencies), counted, 1)[0]) if np.ptp(frequencies) > 1e-9 else None
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "beta0": beta0, "beta1": len(pairs) - channels + beta0 - rank, "spectral_dimension": slope}])

    types = dict(edges.dtypes)
    return edges.select(*keys, "a", "b", weight).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "beta0 int", "beta1 int", "spectral_dimension double"]))


def lempel_ziv(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complexity): phrases of a sequential parse of the thresholded series, for each sample."""

    def phrases(v: np.ndarray) -> float:
        bits = "".join("1" if x else "0" for x in v >= v.mean())
        seen, phrase = set(), ""
        for b in bits:
            phrase += b
            if phrase not in seen:
                seen.add(phrase)
                phrase = ""
        return (len(seen) + bool(phrase)) / len(bits)

    def make(part: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        v = part["v"].to_numpy(float)
        return part.iloc[starts][keys].reset_index(drop=True).assign(complexity=[phrases(v[a:b]) for a, b in zip(starts, ends, strict=True)])

    types = dict(windowed.dtypes)
    return in_groups(windowed.select(*keys, "k", "v"), keys, ["k"], make, ", ".join([*(f"{k} {types[k]}" for k in keys), "complexity double"]))
