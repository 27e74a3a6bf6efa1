"""Tracks of points over frames: links between neighbouring frames, then ids along the links."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.sources.readers import checkpointed


#: Candidate partners that a point starts with and may get a round, and distances that are held at once.
NEAREST, HELD = 8, 4_000_000


def _augmented(edges: list[dict[int, float]], columns: int, none: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Each row's column in the assignment of least cost over the edges, and the prices of rows and columns.

    Shortest augmenting paths, one a row. A row may also stay alone at the cost `none`: its column is then `columns` or more.
    """
    price = [0.0] * len(edges)
    paid: dict[int, float] = {}
    owner: dict[int, int] = {}
    column_of = [-1] * len(edges)
    for start in range(len(edges)):
        reach: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for j, cost in (*edges[row].items(), (columns + row, none)):
                to = base + cost - price[row] - paid.get(j, 0.0)
                if j not in done and to < reach.get(j, np.inf):
                    reach[j], back[j] = to, row
                    heapq.heappush(heap, (to, j))
            far, j = heapq.heappop(heap)
            while j in done:
                far, j = heapq.heappop(heap)
            done[j] = far
            if j not in owner:
                break
            row, base = owner[j], far
        price[start] += far
        for k, d in done.items():
            if k != j:
                price[owner[k]] += far - d
                paid[k] = paid.get(k, 0.0) - (far - d)
        while True:
            row = back[j]
            owner[j], column_of[row], j = row, j, column_of[row]
            if row == start:
                break
    return column_of, np.array(price), np.array([paid.get(j, 0.0) for j in range(columns)])


def assignment(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of points of a and b, all of the smaller side, of least total distance.

    The assignment is made over the nearest partners only; pairs that its prices show to be missing are added, a few for
    each point, until none is, so the result is that of all pairs though only edges are held.
    """
    if len(a) > len(b):
        return [(i, j) for j, i in assignment(b, a)]
    if not len(a):
        return []
    step = max(1, HELD // len(b))
    parts = [slice(lo, lo + step) for lo in range(0, len(a), step)]
    apart = lambda part: np.hypot(a[part, None, 0] - b[None, :, 0], a[part, None, 1] - b[None, :, 1])
    edges: list[dict[int, float]] = [{} for _ in a]
    price, paid = np.full(len(a), np.inf), np.zeros(len(b))
    none = 1.0
    while True:
        missing = False
        for part in parts:
            d = apart(part)
            none = max(none, 4 * float(d.max()) * (len(a) + 1))
            left = d - np.where(np.isinf(price[part]), 0, price[part])[:, None] - paid
            few = np.argsort(left, axis=1, kind="stable")[:, :NEAREST]
            for k, row in enumerate(range(len(a))[part]):
                for j in few[k].tolist():
                    if j not in edges[row] and (np.isinf(price[row]) or left[k, j] < -1e-9):
                        edges[row][j], missing = float(d[k, j]), True
        if not missing:
            return sorted((i, j) for i, j in enumerate(column_of))  # noqa: F821
        column_of, price, paid = _augmented(edges, len(b), none)


def frame_links(points: DataFrame, keys: list[str], frame: str, max_dist: float) -> DataFrame:
    """(keys, id_from, id_to): least-cost matches between each frame and the next, of which those over max_dist are dropped.

    points(keys, frame, id, x, y): each pair of frames is one group, so pairs are matched in parallel and hold edges, not all
    pairs of points. The assignment is made on the distances as they are; the limit only rejects matches afterwards.
    """
    both = points.select(*keys, F.col(frame).alias("pair"), F.lit(0).alias("side"), "id", "x", "y").unionByName(points.select(*keys, (F.col(frame) - 1).alias("pair"), F.lit(1).alias("side"), "id", "x", "y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1))
        out = []
        if len(a) and len(b):
            p, q = a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float)
            out = [(a["id"].iloc[i], b["id"].iloc[j]) for i, j in assignment(p, q) if np.hypot(*(p[i] - q[j])) <= max_dist]
        return pd.DataFrame(out, columns=["id_from", "id_to"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "id_from", "id_to"]]

    types = dict(points.dtypes)
    return both.groupBy(*keys, "pair").applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"id_from {types['id']}", f"id_to {types['id']}"]))


def tracks(points: DataFrame, links: DataFrame) -> DataFrame:
    """points with track, the id of the first point of their track.

    Pointer jumping: each round doubles the reach, until no pointer moves; tracks may be of any length. Rounds are
    checkpointed, so lineage does not grow and lost executors cost one round.
    """
    at = checkpointed(points.select("id").join(links.select(F.col("id_to").alias("id"), "id_from"), "id", "left").select("id", F.coalesce("id_from", "id").alias("root")))
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        new = checkpointed(at.join(up, "root").select("id", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            return points.join(at.withColumnRenamed("root", "track"), "id")
