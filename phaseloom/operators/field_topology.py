"""Winding charge, defects and energy of phase fields on grids, as joins of neighbouring cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import TAU, excess_winding, wrap_phase


def plaquettes(field: DataFrame, keys: list[str], theta: str = "theta", amp: str | None = "amp") -> DataFrame:
    """(keys, i, j, q, patch): winding around each 2 x 2 patch and its mean amplitude.

    The loop (i,j) -> (i+1,j) -> (i+1,j+1) -> (i,j+1) gives the negative of the counter-clockwise charge. Cells are led
    within rows and then within columns, so a patch counts only where all four cells exist.
    """
    along = W.partitionBy(*keys, "i").orderBy("j")
    both = F.struct(F.col(theta).alias("theta"), *([F.col(amp).alias("amp")] if amp else [F.lit(0.0).alias("amp")]))
    row = field.select(*keys, "i", "j", both.alias("here"), F.lead(F.struct("j", both.alias("c"))).over(along).alias("right"))
    row = row.filter(F.col("right.j") == F.col("j") + 1).select(*keys, "i", "j", "here", F.col("right.c").alias("right"))
    down = W.partitionBy(*keys, "j").orderBy("i")
    cell = row.withColumn("below", F.lead(F.struct("i", "here", "right")).over(down)).filter(F.col("below.i") == F.col("i") + 1)
    a, b, c, d = (F.col(x) for x in ("here", "below.here", "below.right", "right"))
    turn = lambda x, y: wrap_phase(y["theta"] - x["theta"])
    q = (turn(a, b) + turn(b, c) + turn(c, d) + turn(d, a)) / TAU
    return cell.select(*keys, "i", "j", q.alias("q"), ((a["amp"] + b["amp"] + c["amp"] + d["amp"]) / 4).alias("patch"))


def slice_charge(field: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, q_abs): rounded net charge and summed absolute charge of each slice."""
    p = plaquettes(field, keys, amp=None)
    return p.groupBy(*keys).agg(F.rint(F.sum("q")).cast("int").alias("q"), F.sum(F.abs("q")).alias("q_abs"))


def nematic_charge(field: DataFrame, keys: list[str], theta: str = "theta") -> DataFrame:
    """(keys, charge): half-integer charge of a director field, with the counter-clockwise sign."""
    twice = field.withColumn("__twice", wrap_phase(2 * F.col(theta)))
    return plaquettes(twice, keys, "__twice", None).groupBy(*keys).agg((-F.rint(F.sum("q")) / 2 + 0.0).alias("charge"))


def charge_over_time(field: DataFrame, time: str = "t", slice_: str = "z") -> DataFrame:
    """(t, z, q, q_abs, f_dress): charges of each slice and the excess of absolute over net charge of each time."""
    q = slice_charge(field, [time, slice_])
    at = W.partitionBy(time)
    return q.withColumn("f_dress", excess_winding(F.avg("q_abs").over(at), F.avg("q").over(at)))


def defects(field: DataFrame, keys: list[str], amp_threshold: float = 0.2) -> DataFrame:
    """(keys, i, j, sign): patches of charge over one half and low amplitude."""
    return plaquettes(field, keys).filter((F.abs("q") > 0.5) & (F.col("patch") < amp_threshold)).select(*keys, "i", "j", F.signum("q").cast("int").alias("sign"))


def energy(field: DataFrame, keys: list[str], kappa: float = 1.0, a: float = 1.0) -> DataFrame:
    """(keys, free_energy, order_r, order_psi) of each slice; steps over missing cells do not count."""
    step = lambda axis, other: F.when(
        F.lead(axis).over(W.partitionBy(*keys, other).orderBy(axis)) == F.col(axis) + 1, wrap_phase(F.lead("theta").over(W.partitionBy(*keys, other).orderBy(axis)) - F.col("theta"))
    )
    g = field.withColumn("gi", step("i", "j")).withColumn("gj", step("j", "i"))
    c, s = F.avg(F.cos("theta")), F.avg(F.sin("theta"))
    return g.groupBy(*keys).agg((kappa * (F.avg(F.col("gi") ** 2) + F.avg(F.col("gj") ** 2)) + a * (1 - c)).alias("free_energy"), F.sqrt(c * c + s * s).alias("order_r"), F.atan2(s, c).alias("order_psi"))


def charge_events(charges: DataFrame, slice_: str = "z", time: str = "t", q: str = "q") -> DataFrame:
    """(z, t, delta): times after which the charge of a slice changes."""
    at = W.partitionBy(slice_).orderBy(time)
    return charges.select(slice_, time, (F.lead(q).over(at) - F.col(q)).alias("delta")).filter("delta <> 0")


def stationarity(series: DataFrame, keys: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """(keys, x, gradient, stationary): central differences, one-sided at the ends."""
    at = W.partitionBy(*keys).orderBy(x)
    lo, hi = F.lag(F.struct(x, y)).over(at), F.lead(F.struct(x, y)).over(at)
    here = F.struct(F.col(x), F.col(y))
    left, right = F.coalesce(lo, here), F.coalesce(hi, here)
    grad = (right[y] - left[y]) / F.nullif(right[x] - left[x], F.lit(0))
    return series.select(*keys, x, grad.alias("gradient")).withColumn("stationary", F.abs("gradient") < tolerance)


def swept_area(path: DataFrame, keys: list[str], order: str, x: str, y: str, dt: float = 1.0) -> DataFrame:
    """(keys, rate): mean signed area that a centred trajectory sweeps per time; 0 for under three points."""
    at = W.partitionBy(*keys)
    run = at.orderBy(order)
    c = path.select(*keys, order, (F.col(x) - F.avg(x).over(at)).alias("x"), (F.col(y) - F.avg(y).over(at)).alias("y"), F.count("*").over(at).alias("n"))
    c = c.withColumn("area", F.col("x") * (F.lead("y").over(run) - F.col("y")) - F.col("y") * (F.lead("x").over(run) - F.col("x")))
    return c.groupBy(*keys).agg(F.when(F.max("n") < 3, F.lit(0.0)).otherwise(F.avg("area") / (2 * dt)).alias("rate"))


def director_angle(dxx: Column, dxy: Column) -> Column:
    """Angle of the main axis of a symmetric traceless tensor."""
    return 0.5 * F.atan2(dxy, dxx)


HALF_TURN = math.pi
