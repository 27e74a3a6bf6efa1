"""Centroid clustering against a plain loop, and rows that are not vectors."""

import hashlib

import numpy as np
from pyspark.sql import types as T

from phaseloom.llm import clustering

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def brute(rows, k, rounds, seed, scale):
    kept = [(i, np.floor(np.array(v) * scale).astype(np.int64)) for i, v in rows]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    x = np.array([v for _, v in kept])
    c = x[:k].copy()
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        at = near().argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(0)]
    d = near()
    return sorted((str(i), int(a), int(e)) for (i, _), a, e in zip(kept, d.argmin(1), d.min(1), strict=True)), c


def test_clusters_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.4, (400, 6))
    base[100:250] = base[7]  # copies, a third of all rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)] + [(None, [0.5] * 6), (3, [1.0] + [0.0] * 5)]
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], SCHEMA).repartition(5)
    out, centroids = clustering.centroid_clusters(df, k=5, rounds=6, dims=6)
    want, c = brute(rows, 5, 6, 3, 1024)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect()) == want
    assert centroids.tolist() == c.tolist()


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(1, [0.1, 0.2], ""), (2, [0.1, 0.2], "")], SCHEMA)
    out, centroids = clustering.centroid_clusters(two, dims=2)
    assert len(centroids) == 2 and {(r.cluster, r.distance) for r in out.collect()} == {(0, 0)}  # ties go to the smaller number
    out, centroids = clustering.centroid_clusters(two.limit(0), dims=2)
    assert out.count() == 0 and len(centroids) == 0


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-3, 3, (200, 8)), np.repeat(rng.integers(-99, 99, (5, 8)), 40, 0), rng.integers(-(10**6), 10**6, (50, 8)), np.zeros((1, 8), np.int64)):
        words, codes = clustering.dictionaries(x)
        assert np.array_equal(np.hstack([w[c] for w, c in zip(words, codes, strict=True)]), x)
    words, _ = clustering.dictionaries(np.repeat(rng.integers(-99, 99, (5, 8)), 40, 0))
    assert len(words) == 1 and len(words[0]) == 5  # copies share one entry of all dimensions
