"""Lineages of points and plug-in metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lineages(centroids: DataFrame, keys: list[str], frame: str, reach: float) -> DataFrame:
    """(keys, id_from, id_to): nearest unused centroid of the next frame within reach, taken greedily from the closest pair on."""
    both = centroids.select(*keys, F.col(frame).alias("pair"), F.lit(0).alias("side"), "id", "x", "y").unionByName(centroids.select(*keys, (F.col(frame) - 1).alias("pair"), F.lit(1).alias("side"), "id", "x", "y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1))
        out, used_a, used_b = [], set(), set()
        if len(a) and len(b):
            d = np.hypot(a["x"].to_numpy()[:, None] - b["x"].to_numpy(), a["y"].to_numpy()[:, None] - b["y"].to_numpy())
            for k in np.argsort(d, axis=None, kind="stable"):
                i, j = divmod(int(k), d.shape[1])
                if d[i, j] > reach:
                    break
                if i not in used_a and j not in used_b:
                    used_a.add(i)
                    used_b.add(j)
                    out.append((a["id"].iloc[i], b["id"].iloc[j]))
        return pd.DataFrame(out, columns=["id_from", "id_to"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "id_from", "id_to"]]

    types = dict(centroids.dtypes)
    return both.groupBy(*keys, "pair").applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), f"id_from {types['id']}", f"id_to {types['id']}"]))


#: Metrics by name, each a function of the samples of one channel in order.
METRICS: dict[str, Callable[[np.ndarray], float]] = {"range": lambda v: float(np.ptp(v)), "roughness": lambda v: float(np.abs(np.diff(v)).mean())}


def plugged_metric(windowed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, value, error): a registered metric of each group; a failure gives a row with its message.

    Groups stand one after the other in their partitions, so a task calls the metric on slices of whole batches.
    """
    metric = METRICS[name]
    types = dict(windowed.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, part in _with_last(batches):
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            before = part[keys].shift()
            fresh = ((part[keys] != before) & ~(part[keys].isna() & before.isna())).any(axis=1).to_numpy()
            fresh[:1] = True
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(part))
            whole = len(starts) if last else len(starts) - 1  # the last group may go on in the next batch
            rest, v, out = part.iloc[ends[whole - 1] if whole else 0 :], part["v"].to_numpy(float), []
            for a, b in zip(starts[:whole], ends[:whole], strict=True):
                try:
                    out.append((float(metric(v[a:b])), None))
                except Exception as e:  # a metric may fail on a group; the others go on  # noqa: BLE001
                    out.append((None, str(e)))
            if whole:
                yield part.iloc[starts[:whole]][keys].reset_index(drop=True).assign(value=[x for x, _ in out], error=[e for _, e in out])

    rows = windowed.select(*keys, "k", "v").repartition(*keys).sortWithinPartitions(*keys, "k")
    return rows.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "value double", "error string"]))


def _with_last(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None and len(held):
        yield True, held
