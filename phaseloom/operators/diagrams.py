"""Curves and summaries of persistence diagrams kept as tables of births and deaths."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _on_grid(diagram: DataFrame, start: float, step: float, points: int) -> DataFrame:
    """Each bar at each grid point; grid points are the decimals that start and step are written as, not sums of rounded ones."""
    at = (F.lit(Decimal(str(start))) + F.col("g") * F.lit(Decimal(str(step)))).cast("double")
    return diagram.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", at)


def betti_curve(diagram: DataFrame, keys: list[str], start: float, step: float, points: int) -> DataFrame:
    """(keys, g, alive): bars that are alive at each grid point."""
    alive = (F.col("birth") <= F.col("at")) & (F.col("death") > F.col("at"))
    return _on_grid(diagram, start, step, points).groupBy(*keys, "g").agg(F.count_if(alive).alias("alive"))


def landscape(diagram: DataFrame, keys: list[str], start: float, step: float, points: int, layers: int) -> DataFrame:
    """(keys, g, layer, height): the highest tents over each grid point.

    Each batch of bars gives the highest of each key first, so that bars times grid points are never rows or sorted.
    """
    at = [float(Decimal(str(start)) + g * Decimal(str(step))) for g in range(points)]
    tents = F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(x) - F.col("birth"), F.col("death") - F.lit(x))) for x in at))
    bars = diagram.select(*keys, tents.alias("heights"))

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.stack(b["heights"].to_numpy()) if len(b) else np.zeros((0, points))
            group = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            kept = []
            for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(b) else []:
                top = np.sort(h[rows], axis=0)[::-1][:layers]
                kept.append(b.iloc[rows[: len(top)]][keys].assign(heights=list(top)))
            if kept:
                yield pd.concat(kept)[[*keys, "heights"]]

    t = bars.mapInPandas(highest, bars.schema).select(*keys, F.posexplode("heights").alias("g", "height"))
    r = F.row_number().over(W.partitionBy(*keys, "g").orderBy(F.desc("height")))
    return t.withColumn("layer", r).filter(F.col("layer") <= layers).select(*keys, "g", "layer", "height")


def summary(diagram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bars, n_open, total_persistence, mean_lifetime); bars that never die count as open only."""
    life = F.when(F.col("death") != float("inf"), F.col("death") - F.col("birth"))
    return diagram.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.count_if(F.col("death") == float("inf")).alias("n_open"), F.sum(life).alias("total_persistence"), F.avg(life).alias("mean_lifetime"))


def band_mass(diagram: DataFrame, keys: list[str], start: float, step: float, points: int, band: Column) -> DataFrame:
    """(keys, band, mass, share): area under the first landscape layer by trapezoids, within bands of grid points given by g."""
    top = _on_grid(diagram, start, step, points).groupBy(*keys, "g").agg(F.max(F.greatest(F.lit(0.0), F.least(F.col("at") - F.col("birth"), F.col("death") - F.col("at")))).alias("h"))
    area = step / 2 * (F.col("h") + F.lead("h").over(W.partitionBy(*keys).orderBy("g")))
    b = top.withColumn("area", area).filter("area is not null").groupBy(*keys, band.alias("band")).agg(F.sum("area").alias("mass"))
    total = F.sum("mass").over(W.partitionBy(*keys))
    return b.select(*keys, "band", "mass", (F.col("mass") / F.nullif(total, F.lit(0.0))).alias("share"))
