"""Queries of the field operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.operators import field_topology as ft
from phaseloom.plans.views import field, rounded, sql, _wrap

QUERIES = {}


def query(name: str, statement: str):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


@query("g1_plaquette_charge", sql("SELECT t, z, i, j, round(q, 6) + 0.0 AS q FROM plaquette", "plaquette"))
def _g1(spark, d):  # noqa: ANN001, ANN202
    return ft.plaquettes(field(spark, d), ["t", "z"]).select("t", "z", "i", "j", rounded(F.col("q")).alias("q"))


@query("g2_slice_charge", sql("SELECT t, z, q, round(q_abs, 6) AS q_abs FROM qzt", "qzt"))
def _g2(spark, d):  # noqa: ANN001, ANN202
    return ft.slice_charge(field(spark, d), ["t", "z"]).select("t", "z", "q", rounded(F.col("q_abs")).alias("q_abs"))


_NEM = sql(", field2 AS (SELECT t, z, i, j, " + _wrap("2 * theta") + " AS theta FROM field), pq AS (SELECT a.t, a.z, (" + " + ".join(_wrap(x) for x in ("b.theta - a.theta", "c.theta - b.theta", "d.theta - c.theta", "a.theta - d.theta")) +
        ") / (2 * pi()) AS q FROM field2 a JOIN field2 b ON b.t = a.t AND b.z = a.z AND b.i = a.i + 1 AND b.j = a.j JOIN field2 c ON c.t = a.t AND c.z = a.z "
        "AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN field2 d ON d.t = a.t AND d.z = a.z AND d.i = a.i AND d.j = a.j + 1) SELECT t, z, -round_even(sum(q), 0) / 2 "
        "+ 0.0 AS charge FROM pq GROUP BY t, z"
    , "field")


@query("g3_nematic_charge", _NEM)
def _g3(spark, d):  # noqa: ANN001, ANN202
    return ft.nematic_charge(field(spark, d), ["t", "z"])


@query("g4_charge_over_time", sql(
        "SELECT t, z, q, round(q_abs, 6) AS q_abs, round((avg(q_abs) OVER (PARTITION BY t) - abs(avg(q) OVER (PARTITION BY t))) / (abs(avg(q) OVER (PARTITION "
        "BY t)) + 1e-12), 4) AS f_dress FROM qzt WHERE t BETWEEN 0 AND 9999"
    , "qzt"))
def _g4(spark, d):  # noqa: ANN001, ANN202
    return ft.charge_over_time(field(spark, d)).select("t", "z", "q", rounded(F.col("q_abs")).alias("q_abs"), rounded(F.col("f_dress"), 4).alias("f_dress"))


@query("g5_defects", sql("SELECT t, z, i, j, CAST(sign(q) AS INTEGER) AS sign FROM plaquette WHERE abs(q) > 0.5 AND patch < 0.2", "plaquette"))
def _g5(spark, d):  # noqa: ANN001, ANN202
    return ft.defects(field(spark, d), ["t", "z"])


@query(
    "g7_free_energy",
    sql(
        ", gi AS (SELECT a.t, a.z, avg(power(" + _wrap("b.theta - a.theta") + ", 2)) AS g FROM field a JOIN field b ON b.t = a.t AND b.z = a.z AND b.i = a.i + 1 AND b.j = a.j GROUP BY a.t, a.z)"
        ", gj AS (SELECT a.t, a.z, avg(power(" + _wrap("b.theta - a.theta") + ", 2)) AS g FROM field a JOIN field b ON b.t = a.t AND b.z = a.z AND b.j = a.j + 1 AND b.i = a.i GROUP BY a.t, a.z)"
        ", o AS (SELECT t, z, avg(cos(theta)) AS c, avg(sin(theta)) AS s FROM field GROUP BY t, z)"

                " SELECT o.t, o.z, round(gi.g + gj.g + 1 - c, 6) AS free_energy, round(sqrt(c * c + s * s), 6) AS order_r, round(atan2(s, c), 6) AS order_psi FROM o "
                "JOIN gi ON gi.t = o.t AND gi.z = o.z JOIN gj ON gj.t = o.t AND gj.z = o.z"
,
        "field",
    ),
)
def _g7(spark, d):  # noqa: ANN001, ANN202
    e = ft.energy(field(spark, d), ["t", "z"])
    return e.select("t", "z", *(rounded(F.col(c)).alias(c) for c in ("free_energy", "order_r", "order_psi")))


@query("g8_window_summary", sql("SELECT t, count(*) AS n_slices, CAST(sum(q) AS BIGINT) AS q_net, round(sum(q_abs), 6) AS q_abs, CAST(max(abs(q)) AS INTEGER) AS q_peak FROM qzt GROUP BY t", "qzt"))
def _g8(spark, d):  # noqa: ANN001, ANN202
    q = ft.slice_charge(field(spark, d), ["t", "z"])
    return q.groupBy("t").agg(F.count("*").alias("n_slices"), F.sum("q").alias("q_net"), rounded(F.sum("q_abs")).alias("q_abs"), F.max(F.abs("q")).alias("q_peak"))


@query("g9_winding_summary", sql(
        ", s AS (SELECT z, sum(q) AS n, sum(abs(q)) AS a FROM qzt GROUP BY z) SELECT z, CAST(n AS DOUBLE) AS q_net, CAST(a AS DOUBLE) AS q_abs, CAST(a - "
        "abs(n) AS DOUBLE) AS q_excess, CASE WHEN a = 0 THEN 0.0 ELSE round(CAST(a - abs(n) AS DOUBLE) / a, 6) END AS f_dress FROM s"
    , "qzt"))
def _g9(spark, d):  # noqa: ANN001, ANN202
    q = ft.slice_charge(field(spark, d), ["t", "z"]).groupBy("z").agg(F.sum("q").cast("double").alias("q_net"), F.sum(F.abs("q")).cast("double").alias("q_abs"))
    from phaseloom.functions.exprs import excess_share

    return q.select("z", "q_net", "q_abs", (F.col("q_abs") - F.abs("q_net")).alias("q_excess"), rounded(excess_share(F.col("q_abs"), F.col("q_net"))).alias("f_dress"))


@query("w1_charge_events", sql(", d AS (SELECT z, t, lead(q) OVER (PARTITION BY z ORDER BY t) - q AS delta FROM qzt) SELECT z, t, delta FROM d WHERE delta <> 0", "qzt"))
def _w1(spark, d):  # noqa: ANN001, ANN202
    return ft.charge_events(ft.slice_charge(field(spark, d), ["t", "z"]))


_W6 = sql(
        ", g AS (SELECT z, t, (lead(q_abs, 1, q_abs) OVER w - lag(q_abs, 1, q_abs) OVER w) / (lead(t, 1, t) OVER w - lag(t, 1, t) OVER w) AS gradient FROM qzt "
        "WINDOW w AS (PARTITION BY z ORDER BY t)) SELECT z, t, round(gradient, 6) + 0.0 AS gradient, abs(gradient) < 1.5 AS stationary FROM g"
    , "qzt")


@query("w6_stationarity", _W6)
def _w6(spark, d):  # noqa: ANN001, ANN202
    return ft.stationarity(ft.slice_charge(field(spark, d), ["t", "z"]), ["z"], "t", "q_abs", 1.5).select("z", "t", rounded(F.col("gradient")).alias("gradient"), "stationary")


@query("w6b_stationary_fraction", _W6.replace(" SELECT z, t, round(gradient, 6) + 0.0 AS gradient, abs(gradient) < 1.5 AS stationary FROM g", " SELECT z, count(*) AS n, round(avg(CASE WHEN abs(gradient) < 1.5 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM g GROUP BY z"))
def _w6b(spark, d):  # noqa: ANN001, ANN202
    s = ft.stationarity(ft.slice_charge(field(spark, d), ["t", "z"]), ["z"], "t", "q_abs", 1.5)
    return s.groupBy("z").agg(F.count("*").alias("n"), rounded(F.avg(F.col("stationary").cast("double"))).alias("fraction"))


@query("w7_swept_area", sql(
        ", p AS (SELECT t, z, avg(cos(theta)) AS x, avg(sin(theta)) AS y FROM field GROUP BY t, z), c AS (SELECT z, t, x - avg(x) OVER (PARTITION BY z) AS x, "
        "y - avg(y) OVER (PARTITION BY z) AS y FROM p), a AS (SELECT z, x * (lead(y) OVER w - y) - y * (lead(x) OVER w - x) AS area FROM c WINDOW w AS "
        "(PARTITION BY z ORDER BY t)) SELECT z, CASE WHEN count(*) < 3 THEN 0.0 ELSE round(avg(area) / 2, 6) + 0.0 END AS rate FROM a GROUP BY z"
    , "field"))
def _w7(spark, d):  # noqa: ANN001, ANN202
    p = field(spark, d).groupBy("t", "z").agg(F.avg(F.cos("theta")).alias("x"), F.avg(F.sin("theta")).alias("y"))
    return ft.swept_area(p, ["z"], "t", "x", "y").select("z", rounded(F.col("rate")).alias("rate"))
