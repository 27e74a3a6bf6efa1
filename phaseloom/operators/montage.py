"""Values of scattered sensors on a regular grid: sparse weights over their triangulation, applied as a join.

The weights depend on the montage only, whose size is fixed, so they are worked out once: a cubic patch on each triangle
from the values and gradients at its corners, gradients by least squares over the sensors a triangle's edge leads to.
Points outside all triangles take the nearest sensor. Interpolation is linear in the values, so a sample's grid is a sum
of weights times values, and weights are a small table that is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.functions.exprs import TAU, wrap_phase

#: Smaller weights are rounding noise.
NOISE = 1e-12


def gradients(xy: np.ndarray, triangles: list[tuple[int, int, int]]) -> np.ndarray:
    """(n, 2, n): the gradient at each sensor as weights of the sensors' values, least squares over neighbouring edges weighed by 1 / distance squared."""
    n = len(xy)
    beside = [set() for _ in range(n)]
    for t in triangles:
        for a in t:
            beside[a] |= set(t) - {a}
    out = np.zeros((n, 2, n))
    for i, near in enumerate(map(sorted, beside)):
        if not near:
            continue
        d = xy[near] - xy[i]
        w = 1 / np.maximum((d**2).sum(1), 1e-300)
        solve = np.linalg.pinv((d * w[:, None]).T @ d) @ (d * w[:, None]).T
        out[i][:, near] = solve
        out[i][:, i] = -solve.sum(1)
    return out


def grid_weights(xy: np.ndarray, triangles: list[tuple[int, int, int]], xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(i, j, sensor, weight) of the grid points (xs[i], ys[j]); weights of a point add up to 1, and linear fields are reproduced inside."""
    slope = gradients(xy, triangles)
    value = np.eye(len(xy))
    out = []
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            p, row = np.array([x, y]), None
            for t in triangles:
                corner = xy[list(t)]
                b = np.linalg.solve(np.vstack([corner.T, np.ones(3)]), np.append(p, 1.0))
                if b.min() >= -1e-9:
                    bubble = b.prod()
                    row = np.zeros(len(xy))
                    for k in range(3):
                        row += (b[k] ** 2 * (3 - 2 * b[k]) + 2 * bubble) * value[t[k]]
                        for m in range(3):
                            if m != k:
                                along = corner[m] - corner[k]
                                row += (b[k] ** 2 * b[m] + bubble / 2) * (along @ slope[t[k]])
                    break
            if row is None:
                row = value[int(((xy - p) ** 2).sum(1).argmin())]
            out += [(i, j, s, float(w)) for s, w in enumerate(row) if abs(w) > NOISE]
    return out


def _grids(samples: DataFrame, keys: list[str], sensor: str, value: str, weights: DataFrame) -> DataFrame:
    """(keys, grid): points(i, j, at) of each sample in order of i and j; at is null where the sample has no sensor of the point, at.v where it lacks one."""
    parts = F.array_sort(F.collect_list(F.struct("sensor", "weight"))).alias("parts")
    points = weights.groupBy("i", "j").agg(parts).agg(F.array_sort(F.collect_list(F.struct("i", "j", "parts"))).alias("__points"))  # one row: grid points x sensors of one montage
    held = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(sensor).alias("sensor"), F.col(value).alias("v")))).alias("h"))
    sensors = F.transform("h", lambda x: x["sensor"])
    alone = lambda x: F.size(F.filter("h", lambda o: o["sensor"] == x["sensor"])) == 1
    values = F.when(F.size(F.array_distinct(sensors)) == F.size("h"), F.transform("h", lambda x: x["v"])).otherwise(F.transform("h", lambda x: F.when(alone(x), x["v"])))
    held = held.select(*keys, sensors.alias("__sensors"), values.alias("__values"))

    def at(p: Column) -> Column:
        def add(s: Column, w: Column) -> Column:
            place = F.coalesce(F.array_position("__sensors", w["sensor"]), F.lit(0))
            v = F.when(place > 0, F.get("__values", place - 1))
            return F.struct((s["met"] | (place > 0)).alias("met"), (s["t"] + w["weight"] * v).alias("t"))

        s = F.aggregate(p["parts"], F.struct(F.lit(False).alias("met"), F.lit(0.0).alias("t")), add, lambda s: F.when(s["met"], F.struct(s["t"].alias("v"))))
        return F.struct(p["i"].alias("i"), p["j"].alias("j"), s.alias("at"))

    return held.crossJoin(F.broadcast(points)).select(*keys, F.transform("__points", at).alias("grid"))


def on_grid(samples: DataFrame, keys: list[str], sensor: str, value: str, weights: DataFrame) -> DataFrame:
    """(keys, i, j, value): the grid of each sample; weights(i, j, sensor, weight) of one montage. A point that needs sensors a sample lacks is null there, or missing if the sample has none of them."""
    g = _grids(samples, keys, sensor, value, weights).select(*keys, F.explode("grid").alias("p")).filter("p.at is not null")
    return g.select(*keys, "p.i", "p.j", F.col("p.at.v").alias(value))


def grid_patches(samples: DataFrame, keys: list[str], sensor: str, value: str, weights: DataFrame) -> DataFrame:
    """(keys, i, j, q): plaquettes() of on_grid(), worked out within each sample's grid, so that grid points are neither shuffled nor sorted."""
    points = weights.select("i", "j").distinct().agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("p")).select(F.posexplode("p").alias("n", "p")).select("n", "p.i", "p.j")
    corner = lambda n, i, j: points.select(F.col("n").alias(n), (F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"))
    patches = points.select(F.col("n").alias("a"), "i", "j")
    for n, i, j in (("b", 1, 0), ("c", 1, 1), ("d", 0, 1)):
        patches = patches.join(corner(n, i, j), ["i", "j"])
    patches = patches.agg(F.collect_list(F.struct("i", "j", "a", "b", "c", "d")).alias("__patches"))  # one row of one montage
    g = _grids(samples, keys, sensor, value, weights).crossJoin(F.broadcast(patches))
    at = lambda p, n: F.get("grid", p[n])["at"]
    g = g.select(*keys, F.explode(F.transform("__patches", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), *(at(p, n).alias(n) for n in "abcd")))).alias("p"))
    turn = lambda x, y: wrap_phase(F.col(f"p.{y}.v") - F.col(f"p.{x}.v"))
    q = (turn("a", "b") + turn("b", "c") + turn("c", "d") + turn("d", "a")) / TAU
    return g.filter("p.a is not null and p.b is not null and p.c is not null and p.d is not null").select(*keys, "p.i", "p.j", q.alias("q"))
