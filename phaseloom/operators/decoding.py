"""Cross-validated logistic decoding with a permutation null: all fits of all folds and permutations in one job a step.

A Newton step of every fit needs sums over rows of products of features, so one pass over the rows, a matrix product a
block, gives the gradients and second derivatives of all fits; the driver solves one small system a fit. A permutation
moves labels and folds together, so folds stay stratified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import hash_unit
from phaseloom.operators.resampling import with_permutations

STATUS = "status string, n_samples long, n_rows_dropped long, n_features int, cv_folds int, accuracy double, chance_level double, null_mean double, null_std double, n_permutations int, p_value double"
#: Rows of a matrix product.
ROWS = 256


def stratified(rows: DataFrame, id_col: str, label: str, folds: int, seed: str) -> DataFrame:
    """rows with fold: within each class, rows in the order of a hash go to the folds in turn, range by range of the hash."""
    h = rows.withColumn("__u", hash_unit(F.lit(seed), F.lit("fold"), F.col(id_col)))
    h = h.withColumn("__range", F.floor(F.col("__u") * 1024).cast("int"))
    sizes = h.groupBy(label, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(label).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 1,024 rows a class
    at = F.row_number().over(W.partitionBy(label, "__range").orderBy("__u", id_col)) - 1
    placed = h.withColumn("__at", at).join(F.broadcast(sizes.select(label, "__range", before.alias("__before"))), [label, "__range"])
    return placed.withColumn("fold", ((F.col("__at") + F.col("__before")) % folds).cast("int")).drop("__u", "__range", "__at", "__before")


def _pairs(f: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(f)


def _pass(data: DataFrame, features: int, folds: int, draws: int, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, test: bool) -> np.ndarray:
    """(folds, draws+1, k) sums over rows: gradient and second derivatives of the rows outside each fold, or rows and hits inside."""
    f = features + 1
    a, b = _pairs(f)
    k = 2 if test else f + len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((folds, draws + 1, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                drawn = np.frombuffer(b"".join(part.column("perms").to_pylist()), np.uint8).reshape(len(x), draws)
                cat = np.column_stack([part.column("cat").to_numpy(zero_copy_only=False).astype(np.uint8), drawn])
                y, fold = (cat >= folds).astype(float), cat % folds
                z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
                for j in range(folds):
                    out_of = fold != j
                    logit = np.clip(z @ weights[j].T, -30, 30)
                    if test:
                        inside = ~out_of
                        out[j, :, 0] += inside.sum(0)
                        out[j, :, 1] += (inside & ((logit > 0) == (y > 0))).sum(0)
                    else:
                        p = 1 / (1 + np.exp(-logit))
                        out[j, :, :f] += ((p - y) * out_of).T @ z
                        out[j, :, f:] += (p * (1 - p) * out_of).T @ (z[:, a] * z[:, b])
        flat = out.reshape(folds * (draws + 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["fit", "s"])

    parts = data.select("x", "cat", "perms").mapInArrow(run, "fit int, s array<double>")
    total = parts.groupBy("fit").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k))).orderBy("fit").toArrow()  # one row a fit
    return np.column_stack([total[f"s{i}"].to_numpy() for i in range(k)]).reshape(folds, draws + 1, k)


def decoding(rows: DataFrame, id_col: str, label: str, features: list[str], folds: int = 5, draws: int = 1000, seed: str = "", steps: int = 12) -> DataFrame:
    """One row with the fields of STATUS: mean accuracy over folds of logistic regression on standardised features, and its null.

    p counts permutations that do as well or better, the observed labels included. Rows with a null or non-finite feature,
    id or label are dropped and counted. status: computed; not_applicable unless there are two classes and some feature;
    insufficient_data where a class has fewer rows than there are folds. The ridge term is that of a unit normal prior on
    the weights, none on the constant.
    """
    spark = rows.sparkSession
    x = F.array(*(F.col(c).cast("double") for c in features))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(label).isNotNull() & F.col(id_col).isNotNull()
    kept = rows.select(id_col, F.col(label).cast("string").alias("__label"), x.alias("x")).filter(F.coalesce(usable, F.lit(False)) if features else F.lit(False))
    counts = {r["__label"]: r["n"] for r in kept.groupBy("__label").agg(F.count("*").alias("n")).orderBy("__label").limit(3).collect()}
    n = sum(counts.values())
    base = [n, rows.count() - kept.count(), len(features), folds]
    if len(counts) != 2 or min(counts.values()) < folds:
        status = "not_applicable" if len(counts) != 2 else "insufficient_data"
        return spark.createDataFrame([(status, *base, None, max(counts.values()) / n if n else None, None, None, draws, None)], STATUS)
    second = sorted(counts)[1]
    dealt = stratified(kept.withColumn("y", (F.col("__label") == second).cast("int")), id_col, "y", folds, seed).withColumn("cat", F.col("y") * folds + F.col("fold"))
    data = with_permutations(dealt.select(id_col, "x", "cat"), id_col, "cat", 2 * folds, draws, seed)
    f = len(features)
    moments = data.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # one row a feature
    mean, scale = np.array([r["m"] for r in moments]), np.array([r["s"] if r["s"] > 1e-12 else 1.0 for r in moments])
    weights = np.zeros((folds, draws + 1, f + 1))
    a, b = _pairs(f + 1)
    ridge = None
    for _ in range(steps):
        sums = _pass(data, f, folds, draws, mean, scale, weights, False)
        if ridge is None:
            # At weights of zero these are a quarter of the sums of products outside the fold: the variances there, on which
            # a fit's features are standardised, tell how the ridge term weighs in the scale of all rows.
            at = {pair: 4 * sums[..., f + 1 + i] for i, pair in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
            var = np.stack([at[i, i] / at[f, f] - (at[i, f] / at[f, f]) ** 2 for i in range(f)], -1)
            ridge = np.concatenate([np.where(var > 1e-12, var, 1.0), np.zeros((folds, draws + 1, 1))], -1)
        second_derivatives = np.zeros((folds, draws + 1, f + 1, f + 1))
        second_derivatives[..., a, b] = second_derivatives[..., b, a] = sums[..., f + 1 :]
        move = np.linalg.solve(second_derivatives + (ridge + 1e-9)[..., None] * np.eye(f + 1), (sums[..., : f + 1] + ridge * weights)[..., None])[..., 0]
        weights = weights - move * np.minimum(1, 5 / np.maximum(np.abs(move).max(-1, keepdims=True), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    hits = _pass(data, f, folds, draws, mean, scale, weights, True)
    accuracy = (hits[..., 1] / hits[..., 0]).mean(0)
    null = accuracy[1:]
    p = (np.count_nonzero(null >= accuracy[0] - 1e-12) + 1) / (draws + 1)
    return spark.createDataFrame([("computed", *base, float(accuracy[0]), max(counts.values()) / n, float(null.mean()), float(null.std()), draws, float(p))], STATUS)
