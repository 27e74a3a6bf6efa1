"""Neighbours, density clusters and regions of grids against all pairs and whole slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import spatial as sp


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(300, 200), (7, 7), (500, 500)]
    got = {r.node: r.root for r in sp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 120)) and got[300] == 200 and got[500] == 500


@pytest.mark.parametrize("dims", [2, 64])
def test_nearest_on_clumps_with_an_outlier(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 1e-3, (70, dims)), rng.normal(5, 1, (60, dims)), np.full((1, dims), 1e6), np.tile(rng.normal(9, 1, (1, dims)), (25, 1))])
    rows = [("g", i, v.tolist()) for i, v in enumerate(x)] + [("one", 0, x[0].tolist()), ("g", 999, None), (None, 1, x[0].tolist())]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    got = {(r.g, r.i): r.d for r in sp.nearest_distances(df, ["g"], "i", "v", leaf=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got.pop(("one", 0)) is None and len(got) == len(x)
    assert np.allclose([got["g", i] for i in range(len(x))], d.min(1), rtol=1e-9, atol=1e-9)


def _dbscan(ids, xy, eps, least):
    near = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]) <= eps
    core = near.sum(1) >= least
    label = {i: i for i in range(len(xy)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            best = min(label[j] for j in label if near[i, j])
            changed |= best < label[i]
            label[i] = best
    return {ids[i]: min((ids[label[j]] for j in label if near[i, j]), default=None) if not core[i] else ids[label[i]] for i in range(len(xy))}


@pytest.mark.parametrize("direct", [10_000, 3])
def test_density_clusters_equal_the_plain_loop(spark, monkeypatch, direct):
    monkeypatch.setattr(sp, "DIRECT", direct)
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.5, (30, 2)), rng.uniform(-4, 8, (50, 2)), np.full((12, 2), 6.0), [[0.5 * i, -3.0] for i in range(12)]])
    rows = [("a", 7, i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("b", 7, i, float(x), float(y)) for i, (x, y) in enumerate(xy[60:100])]
    df = spark.createDataFrame(rows, "z string, t int, id long, x double, y double")
    got = {(r.z, r.id): r.cluster for r in sp.density_clusters(df, ["z", "t"], 0.6, 4).collect()}
    want = {("a", k): v for k, v in _dbscan(list(range(len(xy))), xy, 0.6, 4).items()} | {("b", k): v for k, v in _dbscan(list(range(40)), xy[60:100], 0.6, 4).items()}
    assert got == want


def _betti(on):
    label, (h, w) = {}, on.shape
    for start in zip(*np.nonzero(on), strict=True):
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            i, j = todo.pop()
            for a in range(max(i - 1, 0), min(i + 2, h)):
                for b in range(max(j - 1, 0), min(j + 2, w)):
                    if on[a, b] and (a, b) not in label:
                        label[a, b] = start
                        todo.append((a, b))
    cells = list(label)
    corners = {(i + a, j + b) for i, j in cells for a in (0, 1) for b in (0, 1)}
    edges = {e for i, j in cells for e in ((i, j, 0), (i + 1, j, 0), (i, j, 1), (i, j + 1, 1))}
    beta0 = len(set(label.values()))
    return beta0, beta0 - (len(corners) - len(edges) + len(cells))


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_betti_numbers_over_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    v = rng.random((23, 18))
    ring = np.ones((23, 18))
    ring[2:20, 2:16] = 0
    ring[4:18, 4:14] = 1
    rows = [(k, i, j, float(g[i, j])) for k, g in (("r", v), ("ring", ring)) for i in range(23) for j in range(18)] + [("r", 40, 40, float("nan")), ("none", 0, 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, j int, theta double")
    got = {(r.k, r.threshold): (r.beta0, r.beta1) for r in sp.betti_numbers(df, ["k"], [0.2, 0.5, 0.7], tile=tile).collect()}
    for t in (0.2, 0.5, 0.7):
        assert got["r", t] == _betti(v <= t) and got["ring", t] == (1, 1) and got["none", t] == (0, 0)


def test_a_large_slice_in_tiles(spark):
    """Stripes that a spine joins: one region over all tiles."""
    n = 512
    df = spark.range(n * n).select(F.lit("s").alias("k"), (F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    df = df.withColumn("theta", F.when((F.col("i") % 4 == 0) | (F.col("j") == 0), 0.0).otherwise(1.0))
    got = {r.threshold: (r.beta0, r.beta1) for r in sp.betti_numbers(df, ["k"], [-1.0, 0.5, 2.0]).collect()}
    assert got == {-1.0: (0, 0), 0.5: (1, 0), 2.0: (1, 0)}
