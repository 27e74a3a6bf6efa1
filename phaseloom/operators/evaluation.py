"""Scores, calibration and ranking quality of binary predictions, and permutation statistics seeded by hashes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import hash_unit
from phaseloom.operators import ordered
from phaseloom.sources.readers import checkpointed

#: Keys times permutations whose cuts are broadcast, at most; keys whose replicates a task holds at once.
CUTS, HELD = 100_000, 64
#: Rows whose hashes are held at once; half the width of the band of hashes that is sorted, in standard deviations of the place of its cut.
HASHED, BAND = 128, 2.5


def auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "y", one_class: float | None = 0.5) -> DataFrame:
    """(keys, auc): concordant pairs, ties one half, from counts per distinct score and a running sum over ranges; one_class where a class is missing."""
    c = scored.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    c = ordered.running_sum(ordered.ranges(c, keys, [score]), keys, [score], F.col("neg"), "below")
    c = c.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    both = F.sum("pos") * F.sum("neg")
    return c.groupBy(*keys).agg(F.when(both == 0, F.lit(one_class).cast("double")).otherwise(F.sum("won") / both).alias("auc"))


def brier(score: Column, label: Column) -> Column:
    return F.avg((score - label) ** 2)


def ece(scored: DataFrame, keys: list[str], score: str = "score", label: str = "y", bins: int = 5) -> DataFrame:
    """(keys, ece): expected calibration error over equal bins, the last of which is closed."""
    b = scored.groupBy(*keys, F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("conf"), F.avg(label).alias("acc"))
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def known_mean(*cols: Column) -> Column:
    """Mean of the columns that are neither null nor NaN; null if there are none."""
    known = F.filter(F.array(*cols), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def m_score(features: list[Column], artifact: Column) -> Column:
    """Mean of the features there are (else 0.5), cut by up to 30 % for artifacts, between 0 and 1."""
    penalty = F.when(artifact.isNull() | F.isnan(artifact), 1.0).otherwise(1 - F.least(artifact, F.lit(1.0)) * 0.3)
    return clamp(F.coalesce(known_mean(*features), F.lit(0.5)) * penalty)


def mt_score(m: Column, q_abs: Column, f_dress: Column, quality: Column) -> Column:
    """0.6 of the m score and 0.4 of the mean of the topology features; the m score where there are none."""
    cut = lambda c: F.when(c.isNotNull() & ~F.isnan(c), F.least(c, F.lit(1.0)))
    t = known_mean(cut(q_abs), cut(f_dress), quality)
    return F.when(t.isNull(), m).otherwise(clamp(m * 0.6 + t * 0.4))


#: How the share of null statistics at least as extreme as the observed one is counted.
EXTREME = {
    "two-sided": lambda null, seen: F.abs(null) >= F.abs(seen) - 1e-9,
    "greater": lambda null, seen: null >= seen - 1e-9,
    "less": lambda null, seen: null <= seen + 1e-9,
}


def _difference_of_means(first: Column, rest: Column) -> Column:
    return F.avg(first) - F.avg(rest)


def _null_share(stats: DataFrame, keys: list[str], stat: str, alternative: str) -> DataFrame:
    """(keys, observed, exceed, n, p) from one row a key and permutation; permutation 0 is the observed one."""
    seen = stats.filter("perm = 0").select(*keys, F.col(stat).alias("observed"))
    nulls = stats.filter("perm > 0")
    nulls = nulls.join(seen, keys) if keys else nulls.crossJoin(F.broadcast(seen))  # one row
    hit = EXTREME[alternative](F.col(stat), F.col("observed"))
    return nulls.groupBy(*keys).agg(F.first("observed").alias("observed"), F.count_if(hit).alias("exceed"), F.count("*").alias("n"), ((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p"))


def permutation_test(
    df: DataFrame, keys: list[str], row: str, value: str, group: str, first: str, permutations: int, seed: str,
    alternative: str = "two-sided", statistic: Callable[[Column, Column], Column] = _difference_of_means,
) -> DataFrame:
    """(keys, observed, exceed, n, p): label-shuffle test; statistic combines two columns, null outside their group, by aggregates.

    Each permutation orders the rows by a hash of (seed, permutation, row) and gives the first as many as the first group
    has to it. Differences of means need no row for each row and permutation; other statistics do.
    """
    rows = df.select(*keys, row, F.col(value).alias("v"), (F.col(group) == first).alias("is_first"))
    rows = checkpointed(rows, "labelled")
    if statistic is _difference_of_means:
        d = _shuffled_means(rows, keys, row, permutations, seed)
    else:
        d = _shuffled(rows, keys, row, permutations, seed, statistic)
    return _null_share(checkpointed(d, "statistics"), keys, "stat", alternative)


def _shuffled(rows: DataFrame, keys: list[str], row: str, permutations: int, seed: str, statistic: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, perm, stat): any statistic, from a row for each row and permutation.

    Ranges of the hash go to one side or the other as a whole, by a running count of their sizes; only the rows of the
    range where the groups meet are dealt out and sorted. The other rows are aggregated where they are read.
    """
    p = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    by_label = F.when(F.col("is_first"), "0").otherwise("f")
    p = p.withColumn("h", F.when(F.col("perm") == 0, by_label).otherwise(F.sha2(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col(row).cast("string")), 256)))
    p = p.withColumn("range", F.rpad(F.substring("h", 1, 2), 2, "0"))
    sizes = p.groupBy(*keys, "perm", "range").agg(F.count("*").alias("held"), F.count_if("is_first").alias("firsts"))
    at = W.partitionBy(*keys, "perm")
    before = F.coalesce(F.sum("held").over(at.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("perm").alias("__perm"), F.col("range").alias("cut"), "held", (F.sum("firsts").over(at) - before).alias("room"))
    # one row a key and permutation: the range that has rows of both sides, or the last one that is full
    cuts = sizes.filter("room > 0").groupBy(*(f"__{k}" for k in keys), "__perm").agg(F.max_by(F.struct("cut", "room"), "cut").alias("at"))
    cuts = checkpointed(cuts.select("*", "at.cut", "at.room").drop("at"), "cuts")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("perm") == F.col("__perm")]
    met = p.join(F.broadcast(cuts) if cuts.count() <= CUTS else cuts, same, "left").drop("__perm", *(f"__{k}" for k in keys))
    met = met.withColumn("cut", F.coalesce("cut", F.lit("")))  # a permutation without a first group
    apart = met.filter("range <> cut").select(*keys, "perm", "v", (F.col("range") < F.col("cut")).alias("side"))
    r = F.row_number().over(W.partitionBy(*keys, "perm").orderBy("h", row))
    dealt = met.filter("range = cut AND perm > 0").select(*keys, "perm", "v", (r <= F.col("room")).alias("side"))
    seen = met.filter("range = cut AND perm = 0").select(*keys, "perm", "v", F.lit(True).alias("side"))
    sides = apart.unionByName(dealt).unionByName(seen)
    return sides.groupBy(*keys, "perm").agg(statistic(F.when(F.col("side"), F.col("v")), F.when(~F.col("side"), F.col("v"))).alias("stat"))


def _shuffled_means(rows: DataFrame, keys: list[str], row: str, permutations: int, seed: str) -> DataFrame:
    """(keys, perm, stat): differences of means; a row's hashes of all permutations are taken and added up where it is read.

    The cut between the sides lies near the first group's share of all hashes. Rows outside a band around it only add to
    sums, those within it become rows and are sorted. Permutations whose cut lies outside the band are drawn again, with a
    band twice as wide, until none is left.
    """
    label = F.coalesce("is_first", F.lit(False))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(label).alias("__firsts"))
    n_keys, at = sizes.count(), [*keys, "perm"]
    few = n_keys <= HELD
    dealt = rows.select(*keys, F.col(row).cast("string").alias("__row"), F.col("v").cast("double").alias("v"))
    dealt = _beside(dealt, F.broadcast(sizes) if n_keys <= CUTS else sizes, keys)
    # keys that share a row share its hashes where they are few; many come one after the other
    order, places = ["__row", *keys] if few else [*keys, "__row"], 4 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = (dealt.repartition(places, "__row") if few else dealt.repartitionByRange(places, *order)).sortWithinPartitions(*order)
    out = rows.groupBy(*keys).agg((F.avg(F.when(label, F.col("v"))) - F.avg(F.when(~label, F.col("v")))).alias("stat")).select(*keys, F.lit(0).alias("perm"), "stat")
    perms, width = list(range(1, permutations + 1)), BAND
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "perm int, hash binary, place int, v double, firsts long, below long, n_first long, sum_first double, n_rest long, sum_rest double"])
    while perms:
        drawn = checkpointed(dealt.mapInArrow(_drawn(keys, perms, seed, width), schema), "drawn")
        sums = drawn.filter("hash is null").groupBy(*at).agg(F.first("firsts").alias("firsts"), *(F.sum(c).alias(c) for c in ("below", "n_first", "sum_first", "n_rest", "sum_rest")))
        room = sums.select(*at, (F.col("firsts") - F.col("below")).alias("room"))
        near = _beside(drawn.filter("hash is not null").select(*at, "hash", "place", "v"), F.broadcast(room) if n_keys * len(perms) <= CUTS else room, at)
        near = near.withColumn("side", F.row_number().over(W.partitionBy(*at).orderBy("hash", "v")) <= F.col("room"))
        part = [f(F.when(side, F.col("v"))).alias(f"{c}_{name}") for name, side in (("near_first", F.col("side")), ("near_rest", ~F.col("side"))) for c, f in (("n", F.count), ("sum", F.sum))]
        near = near.groupBy(*at).agg(F.count_if(F.col("place") < 0).alias("under"), F.count_if(F.col("place") <= 0).alias("upto"), *part)
        sums = _beside(sums, near, at, "left").fillna(0, ["under", "upto", *(f"{c}_near_{side}" for c in ("n", "sum") for side in ("first", "rest"))])
        mean = lambda side: (F.col(f"sum_{side}") + F.col(f"sum_near_{side}")) / F.nullif(F.col(f"n_{side}") + F.col(f"n_near_{side}"), F.lit(0))
        inside = (F.col("firsts") - F.col("below")).between(F.col("under"), F.col("upto"))
        sums = checkpointed(sums.select(*at, (mean("first") - mean("rest")).alias("stat"), inside.alias("inside")), "differences")
        found = sums.groupBy("perm").agg(F.bool_and("inside").alias("inside"))  # one row a permutation
        perms, width = sorted(r["perm"] for r in found.filter("NOT inside").select("perm").collect()), 2 * width
        out = out.unionByName(sums.join(found.filter("inside").select("perm"), "perm", "left_semi").select(*at, "stat"))
    return out


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of other, which has one row a key; null keys are equal."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # one row
    named = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*(f"__{k}" for k in keys))


def _drawn(keys: list[str], perms: list[int], seed: str, width: float):  # noqa: ANN202
    """For mapInArrow over rows(keys, __row, v, __n, __firsts): counts and sums beside the bands, one row a key and permutation, and the rows within them.

    place is -1 under the band, 0 within it and 1 over it. Values that are no finite numbers always become rows.
    """
    prefixes, names = [f"{seed}|{p}".encode() for p in perms], [*keys, "perm", "hash", "place", "v", "firsts", "below", "n_first", "sum_first", "n_rest", "sum_rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def totals() -> Iterator[pa.RecordBatch]:
            for key, (firsts, t) in held.items():
                n = len(perms)
                null = [pa.nulls(n, k) for k in (pa.binary(), pa.int32(), pa.float64())]
                cells = [pa.array(perms, pa.int32()), *null, pa.array([firsts] * n, pa.int64()), pa.array(t[0].astype(np.int64)), pa.array(t[1].astype(np.int64)), pa.array(t[2]), pa.array(t[3].astype(np.int64)), pa.array(t[4])]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, kind) for k, kind in zip(key, kinds, strict=True)), *cells], names=names)
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for at in range(0, batch.num_rows, HASHED):
                part = batch.slice(at, HASHED)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                own = column("__row").to_pylist()
                place_of = {r: i for i, r in enumerate(dict.fromkeys(own))}
                of_row = np.array([place_of[r] for r in own])
                tails = [b"" if r is None else b"|" + r.encode() for r in place_of]
                digests = np.frombuffer(b"".join([sha256(p + t).digest() for t in tails for p in prefixes]), np.uint8).reshape(len(tails), len(perms), 32)
                hashes = np.ascontiguousarray(digests[:, :, :8]).view(">u8")[:, :, 0].astype(np.uint64)[of_row]
                v = column("v").to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
                known = np.asarray(column("v").is_valid())
                odd = known & ~np.isfinite(v)
                n, firsts = column("__n").to_numpy(), column("__firsts").to_numpy()
                share = firsts / n
                half = width * np.sqrt(share * (1 - share) / n) + 2 * width / n
                edge = lambda x: np.array([min(max(int(a * 2.0**64), 0), (1 << 64) - 1) for a in x], np.uint64)[:, None]
                place = (hashes > edge(share + half)).astype(np.int8) - (hashes < edge(share - half))
                of: dict = {}
                for i, key in enumerate(zip(*(column(k).to_pylist() for k in keys), strict=True) if keys else [()] * len(own)):
                    of.setdefault(key, []).append(i)
                for key, some in of.items():
                    if key not in held:
                        if len(held) >= HELD:
                            yield from totals()
                        held[key] = int(firsts[some[0]]), np.zeros((5, len(perms)))
                    some = np.array(some)[~odd[some]]
                    has, x = known[some].astype(float), np.where(known[some], v[some], 0.0)
                    under, over = (place[some] < 0).astype(float), (place[some] > 0).astype(float)
                    held[key][1][:3] += np.stack([np.ones(len(some)), has, x]) @ under
                    held[key][1][3:] += np.stack([has, x]) @ over
                i, j = np.nonzero((place == 0) | odd[:, None])
                if len(i):
                    data = digests[of_row[i], j, :16]
                    binary = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(np.arange(0, 16 * len(i) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    none = [pa.nulls(len(i), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())]
                    rows = [*(column(k).take(pa.array(i)) for k in keys), pa.array(np.array(perms, np.int32)[j]), binary, pa.array(place[i, j].astype(np.int32)), column("v").take(pa.array(i)), *none]
                    yield pa.RecordBatch.from_arrays(rows, names=names)
        yield from totals()

    return run


def sign_flip_test(diffs: DataFrame, keys: list[str], subject: str, diff: str, permutations: int, seed: str, alternative: str = "two-sided") -> DataFrame:
    """(keys, observed, exceed, n, p): paired test; each permutation flips the signs of subjects by a hash."""
    p = diffs.select(*keys, F.col(subject).alias("s"), F.col(diff).alias("d")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    sign = F.when((F.col("perm") == 0) | (hash_unit(F.lit(seed), F.col("perm"), F.col("s")) < 0.5), 1.0).otherwise(-1.0)
    return _null_share(p.groupBy(*keys, "perm").agg(F.avg(F.col("d") * sign).alias("m")), keys, "m", alternative)


def subject_blocked_test(df: DataFrame, subject: str, group: str, value: str, permutations: int, seed: str, alternative: str = "two-sided") -> DataFrame:
    """One row (method, observed, exceed, n, p, effect): each subject counts once.

    If any subject has both groups, their differences (first group by name minus second) are tested by sign flips, with
    the paired effect mean / standard deviation; else subjects' means are shuffled between the groups, with Cohen's d.
    Raises unless there are exactly two groups.
    """
    cells = df.groupBy(F.col(subject).alias("s"), F.col(group).cast("string").alias("g")).agg(F.avg(value).alias("v")).filter("v is not null")
    names = sorted(r["g"] for r in cells.select("g").distinct().limit(3).collect())
    if len(names) != 2:
        raise ValueError(f"two groups are needed, there are {names}")
    a, b = names
    wide = cells.groupBy("s").agg((F.max(F.when(F.col("g") == a, F.col("v"))) - F.max(F.when(F.col("g") == b, F.col("v")))).alias("d")).filter("d is not null")
    if not wide.isEmpty():
        t = sign_flip_test(wide, [], "s", "d", permutations, seed, alternative).withColumn("method", F.lit("paired"))
        effect = wide.agg((F.avg("d") / F.when(F.stddev_samp("d") > 0, F.stddev_samp("d"))).alias("effect"))
    else:
        t = permutation_test(cells, [], "s", "v", "g", a, permutations, seed, alternative).withColumn("method", F.lit("between"))
        effect = cohens_d(cells, [], "v", "g", a, b).withColumnRenamed("d", "effect")
    return t.crossJoin(F.broadcast(effect)).select("method", "observed", "exceed", "n", "p", "effect")  # one row each


def cohens_d(df: DataFrame, keys: list[str], value: str, group: str, a: str, b: str) -> DataFrame:
    """(keys, d): difference of means over the pooled standard deviation; null for under two rows in a group."""
    g = df.groupBy(*keys).agg(*[f(F.when(F.col(group) == x, F.col(value))).alias(f"{n}{i}") for i, x in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return g.select(*keys, F.when((F.col("n0") >= 2) & (F.col("n1") >= 2), (F.col("m0") - F.col("m1")) / (pooled + 1e-12)).alias("d"))


def anova(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """(keys, f, eta_squared, n_groups, n): one-way analysis of variance from group sums."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    at = W.partitionBy(*(keys or [F.lit(0)]))
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(at) / F.sum("n").over(at))
    s = g.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("n_groups"), F.sum("n").alias("n"))
    f = (F.col("between") / (F.col("n_groups") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("n_groups")), F.lit(0.0))
    return s.select(*keys, f.alias("f"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"), "n_groups", "n")


def null_summary(nulls: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """(keys, null_mean, null_std, z): z is null where the nulls do not vary."""
    return nulls.groupBy(*keys).agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"), ((F.first(observed) - F.avg(value)) / F.when(F.stddev_pop(value) > 1e-12, F.stddev_pop(value))).alias("z"))


def bootstrap_mean(df: DataFrame, keys: list[str], row: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(keys, lo, hi): 95 % interval of the mean; each replicate weighs rows by Poisson(1) counts drawn from hashes."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    drawn = [f"{seed}|{rep}".encode() for rep in range(1, replicates + 1)]
    types = dict(df.dtypes)

    def totals(groups: dict) -> Iterator[pd.DataFrame]:
        for key, (c, cv, known) in groups.items():
            out = pd.DataFrame({"rep": range(1, replicates + 1), "c": c, "cv": cv if known else None})
            yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "rep", "c", "cv"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict = {}
        for b in batches:
            for *key, at, v in b.itertuples(index=False, name=None):
                own = b"" if at is None else b"|" + at.encode()
                u = np.frombuffer(b"".join([sha256(x + own).digest()[:4] for x in drawn]), ">u4") / 4294967296
                weight = np.searchsorted(steps, u, side="right")
                if tuple(key) not in groups:
                    if len(groups) >= HELD:
                        yield from totals(groups)
                        groups = {}
                    groups[tuple(key)] = [np.zeros(replicates, np.int64), np.zeros(replicates), False]
                held = groups[tuple(key)]
                held[0] += weight
                if v == v and v is not None:
                    held[1] += weight * v
                    held[2] = True
        yield from totals(groups)

    rows = df.select(*keys, F.col(row).cast("string").alias("__row"), F.col(value).cast("double").alias("v"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = rows.repartition(4 * cores).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "rep int, c long, cv double"]))
    m = parts.groupBy(*keys, "rep").agg((F.sum("cv") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    return m.groupBy(*keys).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal statistic."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")

    return tail(z)


def within_effect(rows: DataFrame, subject: str, x: str, y: str) -> DataFrame:
    """One row (effect, n_subjects, n_obs, se, z, p): slope within subjects, its cluster-robust error and two-sided normal p, from three sums of each subject.

    A subject's score is what its centred rows leave of the normal equation; with the sums of squares and products of
    every subject no second pass over the rows is needed. Rows with a null in any of the three do not count.
    """
    rows = rows.filter(F.col(subject).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*")
    s = rows.groupBy(subject).agg((F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n).alias("xy"), (F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n).alias("xx"), n.alias("n"))
    beta = s.agg((F.sum("xy") / F.sum("xx")).alias("effect"), F.sum("xx").alias("sxx"), F.sum("n").alias("n_obs"))
    score = F.col("xy") - F.col("effect") * F.col("xx")
    m = F.count("*")
    t = s.crossJoin(F.broadcast(beta)).agg(F.first("effect").alias("effect"), m.alias("n_subjects"), F.first("n_obs").alias("n_obs"), (F.sqrt(m / (m - 1) * F.sum(score * score)) / F.first("sxx")).alias("se"))  # beta is one row
    t = t.withColumn("z", F.col("effect") / F.when(F.col("se") > 0, F.col("se")))
    return t.withColumn("p", normal_two_sided(F.col("z")))


def mixed_effect(rows: DataFrame, subject: str, x: str, y: str, rounds: int = 6, points: int = 25) -> DataFrame:
    """One row (effect, se, p, converged, n_obs, n_subjects, variance_ratio): slope of a model with a random constant for each subject, by restricted likelihood.

    Six sums of each subject are enough: for a ratio of the variances between and within subjects, generalised least
    squares and the likelihood are sums over subjects. Each round scores `points` ratios in one pass and goes on between
    the neighbours of the best. converged: the best ratio lies inside the range that is looked through, and the rounds
    have narrowed it. Null rows do not count; fewer than two subjects or no variation of x give nulls.
    """
    spark = rows.sparkSession
    r = rows.select(F.col(subject).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sums = r.groupBy("s").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    sums = checkpointed(sums, "subject-sums")
    lo, hi, best = -8.0, 6.0, None
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        g = sums.crossJoin(F.broadcast(spark.createDataFrame([(v, 10.0**v) for v in grid], "at double, ratio double")))  # `points` rows
        c = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
        less = lambda a, b, m: F.sum(F.col(m) - c * F.col(a) * F.col(b))  # noqa: B023, E731
        t = g.groupBy("at").agg(less("n", "n", "n").alias("a"), less("n", "sx", "sx").alias("b"), less("sx", "sx", "xx").alias("d"), less("n", "sy", "sy").alias("p"), less("sx", "sy", "xy").alias("q"), less("sy", "sy", "yy").alias("w"), F.sum("n").alias("n_obs"), F.count("*").alias("m"), F.sum(F.log1p(F.col("n") * F.col("ratio"))).alias("logs"))
        found = []
        for row in t.collect():  # `points` rows
            det = row["a"] * row["d"] - row["b"] ** 2
            if det <= 1e-12 * max(row["a"] * row["d"], 1e-300) or row["n_obs"] <= 2 or row["m"] < 2:
                continue
            slope, level = (row["a"] * row["q"] - row["b"] * row["p"]) / det, (row["d"] * row["p"] - row["b"] * row["q"]) / det
            var = max((row["w"] - slope * row["q"] - level * row["p"]) / (row["n_obs"] - 2), 1e-300)
            likelihood = -0.5 * ((row["n_obs"] - 2) * math.log(var) + row["logs"] + math.log(det))
            found.append((likelihood, row["at"], slope, math.sqrt(var * row["a"] / det), int(row["n_obs"]), row["m"]))
        if not found:
            break
        best = max(found)
        step = (hi - lo) / (points - 1)
        lo, hi = max(best[1] - step, -8.0), min(best[1] + step, 6.0)
    schema = "effect double, se double, p double, converged boolean, n_obs long, n_subjects long, variance_ratio double"
    if best is None:
        return spark.createDataFrame([(None, None, None, False, int(r.count()), int(sums.count()), None)], schema)
    _, at, slope, se, n_obs, m = best
    p = math.erfc(abs(slope) / se / math.sqrt(2)) if se > 0 else None
    return spark.createDataFrame([(slope, se, p, at < 5.9, n_obs, m, 10.0**at)], schema)
