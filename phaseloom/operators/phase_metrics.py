"""Synchrony, gradient and connectivity metrics of channel phases, and winding over sensor triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import TAU, excess_winding, wrap_phase


def kuramoto(phase: DataFrame, keys: list[str], at: str = "k") -> DataFrame:
    """(keys, r_mean, metastability): mean and spread over time of the order parameter."""
    c, s = F.avg(F.cos("theta")), F.avg(F.sin("theta"))
    r = phase.groupBy(*keys, at).agg(F.sqrt(c * c + s * s).alias("r"))
    return r.groupBy(*keys).agg(F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("metastability"))


def channel_gradient(phase: DataFrame, keys: list[str], at: str = "k") -> DataFrame:
    """(keys, q, q_abs, phase_grad, f_dress) from wrapped differences of neighbouring channels."""
    step = wrap_phase(F.lead("theta").over(W.partitionBy(*keys, at).orderBy("channel")) - F.col("theta"))
    s = phase.select(*keys, "channel", step.alias("d")).filter(F.col("d").isNotNull())
    c = s.groupBy(*keys, "channel").agg(F.avg("d").alias("m"), F.avg(F.abs("d")).alias("g"))
    q = c.groupBy(*keys).agg((F.sum("m") / TAU).alias("q"), (F.sum(F.abs("m")) / TAU).alias("q_abs"), F.avg("g").alias("phase_grad"))
    return q.withColumn("f_dress", excess_winding(F.col("q_abs"), F.col("q")))


def pairs(phase: DataFrame, keys: list[str], at: str = "k", value: str = "theta") -> DataFrame:
    """(keys, k, a, b, x, y): values of every unordered pair of channels at the same time."""
    left = phase.select(*keys, at, F.col("channel").alias("a"), F.col(value).alias("x"))
    right = phase.select(*keys, at, F.col("channel").alias("b"), F.col(value).alias("y"))
    return left.join(right, [*keys, at]).filter("a < b")


def phase_coupling(phase: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, plv, pli, wpli)."""
    d = pairs(phase, keys).withColumn("d", F.col("y") - F.col("x"))
    c, s = F.avg(F.cos("d")), F.avg(F.sin("d"))
    return d.groupBy(*keys, "a", "b").agg(
        F.sqrt(c * c + s * s).alias("plv"), F.abs(F.avg(F.signum(F.sin("d")))).alias("pli"), F.when(F.avg(F.abs(F.sin("d"))) == 0, 0.0).otherwise(F.abs(s) / F.avg(F.abs(F.sin("d")))).alias("wpli")
    )


def correlation(windowed: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, a, b, r)."""
    return pairs(windowed, keys, value=value).groupBy(*keys, "a", "b").agg(F.corr("x", "y").alias("r"))


def network_means(edges: DataFrame, sensor: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, within, between): mean weight of the pairs inside a region and across regions."""
    of = lambda c: sensor.select(F.col("channel").alias(c), F.col("region").alias(f"region_{c}"))
    e = edges.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b").withColumn("same", F.col("region_a") == F.col("region_b"))
    return e.groupBy(*keys).agg(F.avg(F.when(F.col("same"), F.col(weight))).alias("within"), F.avg(F.when(~F.col("same"), F.col(weight))).alias("between"))


def top_edges(edges: DataFrame, keys: list[str], weight: str, density: float) -> DataFrame:
    """The strongest share of each window's edges; ties with the last one stay."""
    at = W.partitionBy(*keys)
    e = edges.withColumn("__r", F.rank().over(at.orderBy(F.desc(weight)))).withColumn("__n", F.count("*").over(at))
    return e.filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(density * F.col("__n")))).drop("__r", "__n")


def graph_summary(edges: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """(keys, n_edges, mean_degree, transitivity) of unweighted graphs."""
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v")))
    degree = both.groupBy(*keys, "u").agg(F.count("*").alias("d"))
    triads = degree.groupBy(*keys).agg((F.sum(F.col("d") * (F.col("d") - 1)) / 2).alias("triads"), (F.sum("d") / 2).cast("long").alias("n_edges"))
    ab = edges.select(*keys, "a", "b")
    bc = edges.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
    ac = edges.select(*keys, "a", F.col("b").alias("c"))
    tri = ab.join(bc, [*keys, "b"]).join(ac, [*keys, "a", "c"]).groupBy(*keys).agg(F.count("*").alias("triangles"))
    return triads.join(tri, keys, "left").select(*keys, "n_edges", (2 * F.col("n_edges") / channels).alias("mean_degree"), F.when(F.col("triads") == 0, 0.0).otherwise(3 * F.coalesce("triangles", F.lit(0)) / F.col("triads")).alias("transitivity"))


def modularity(edges: DataFrame, sensor: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, modularity) of the given regions."""
    of = lambda c: sensor.select(F.col("channel").alias(c), F.col("region").alias(f"region_{c}"))
    e = edges.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b")
    m = e.groupBy(*keys).agg(F.count("*").alias("m"), F.sum((F.col("region_a") == F.col("region_b")).cast("int")).alias("inner"))
    ends = e.select(*keys, F.col("region_a").alias("region")).union(e.select(*keys, F.col("region_b").alias("region"))).groupBy(*keys, "region").agg(F.count("*").alias("d"))
    sq = ends.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    return m.join(sq, keys).select(*keys, (F.col("inner") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def triangle_winding(phase: DataFrame, triangle: DataFrame, keys: list[str], at: str = "k") -> DataFrame:
    """(keys, k, tri_id, winding, gap, low): winding in vertex order, mean absolute edge difference, least amplitude."""
    corners = triangle.select("tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "channel"))
    v = phase.join(F.broadcast(corners), "channel").groupBy(*keys, at, "tri_id").agg(F.array_sort(F.collect_list(F.struct("corner", "theta", "amp"))).alias("c")).filter(F.size("c") == 3)
    th = [F.col("c")[i]["theta"] for i in range(3)]
    d = [wrap_phase(th[(i + 1) % 3] - th[i]) for i in range(3)]
    return v.select(*keys, at, "tri_id", ((d[0] + d[1] + d[2]) / TAU).alias("winding"), ((F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])) / 3).alias("gap"), F.least(*[F.col("c")[i]["amp"] for i in range(3)]).alias("low"))


def amplitude_floor(phase: DataFrame, keys: list[str], at: str = "k", quantile: float = 0.1) -> DataFrame:
    """(keys, k, floor): quantile of the amplitudes at each time."""
    return phase.groupBy(*keys, at).agg(F.percentile("amp", quantile).alias("floor"))


def sensor_topology(winding: DataFrame, keys: list[str], at: str = "k") -> DataFrame:
    """(keys, k, q, q_abs, f_dress, phase_grad, n_valid, defect_density)."""
    t = winding.groupBy(*keys, at).agg(F.rint(F.sum("winding")).alias("q"), F.sum(F.abs("winding")).alias("q_abs"), F.avg("gap").alias("phase_grad"), F.count("*").alias("n_valid"))
    return t.withColumn("f_dress", excess_winding(F.col("q_abs"), F.col("q"))).withColumn("defect_density", F.col("q_abs") / F.greatest("n_valid", F.lit(1)))


def triangle_regions(triangle: DataFrame, sensor: DataFrame) -> DataFrame:
    """(tri_id, region): the region of at least two vertices; null if a vertex has none or all differ."""
    v = triangle.select("tri_id", F.explode(F.array("v0", "v1", "v2")).alias("channel")).join(sensor.select("channel", "region"), "channel", "left")
    n = v.groupBy("tri_id", "region").agg(F.count("*").alias("n"))
    return n.groupBy("tri_id").agg(F.when(F.max(F.col("region").isNull()), F.lit(None)).otherwise(F.max_by(F.when(F.col("n") >= 2, F.col("region")), "n")).alias("region"))


def majority_label(corners: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """(key, label): the label of most of the corners of each shape of `size` corners; null if a corner has none or no label has most."""
    votes = corners.groupBy(key, label).agg(F.count("*").alias("n"))
    g = votes.groupBy(key).agg(F.sum("n").alias("total"), F.count_if(F.col(label).isNull()).alias("lost"), F.max(F.when(2 * F.col("n") > size, F.col(label))).alias(label))
    return g.filter(F.col("total") == size).select(key, F.when(F.col("lost") == 0, F.col(label)).alias(label))


def valid_triangles(edges: DataFrame, keys: list[str], weight: str, least: float) -> DataFrame:
    """(keys, n_triangles, n_valid, valid_share): triangles of three edges, and those whose mean absolute weight is over least."""
    e = edges.select(*keys, "a", "b", F.abs(weight).alias("x"))
    second = e.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("x").alias("y"))
    third = e.select(*keys, "a", F.col("b").alias("c"), F.col("x").alias("z"))
    t = e.join(second, [*keys, "b"]).join(third, [*keys, "a", "c"])
    valid = F.count_if((F.col("x") + F.col("y") + F.col("z")) / 3 > least)
    return t.groupBy(*keys).agg(F.count("*").alias("n_triangles"), valid.alias("n_valid"), (valid / F.count("*")).alias("valid_share"))
