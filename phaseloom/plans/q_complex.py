"""Queries of complexity, graph paths, clusters, spins and states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import clusters as cl
from phaseloom.operators import complexity as cx
from phaseloom.operators import evaluation as ev
from phaseloom.operators import field_topology as ft
from phaseloom.operators import montage as mt
from phaseloom.operators import phase_metrics as pm
from phaseloom.operators import surrogates as sg
from phaseloom.operators import windows as wn
from phaseloom.plans.q_signal import _CORR, _PAIR, _TOP, _TR, _edges
from phaseloom.plans.views import SENSORS, TRIANGLES, _wrap, channel_windows, field, phase, rounded, rounded_double, samples, sensor, sql, table, triangle, windowed

QUERIES = {}
KEY = ["recording_id", "w"]
CH = [*KEY, "channel"]


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


_ALIKE = " AND ".join(f"abs(list_extract(s, i + {o}) - list_extract(s, j + {o})) <= r" for o in range(3))


@query(
    "q11_sample_entropy",
    sql(
        f""", a AS (SELECT recording_id, w, channel, list(v ORDER BY k) AS s, 0.2 * stddev_pop(v) AS r FROM windowed GROUP BY ALL),
        t AS (SELECT *, unnest(range(1, 15)) AS i FROM a), u AS (SELECT *, unnest(range(i + 1, 15)) AS j FROM t WHERE i < 14),
        c AS (SELECT recording_id, w, channel, count(*) FILTER (WHERE {" AND ".join(_ALIKE.split(" AND ")[:2])}) AS b, count(*) FILTER (WHERE {_ALIKE}) AS c FROM u GROUP BY ALL)
        SELECT recording_id, w, channel, CASE WHEN b > 0 AND c > 0 THEN round(-ln(c / b), 6) + 0.0 END AS entropy FROM c""",
        "windowed@own",
    ),
)
def _q11(spark, d):  # noqa: ANN001, ANN202
    return cx.sample_entropy(channel_windows(spark, d), CH).withColumn("entropy", rounded(F.col("entropy")))


@query(
    "q11_fractal_dimension",
    sql(
        """, d AS (SELECT recording_id, w, channel, k % step AS m, step, abs(CASE step WHEN 1 THEN lead(v, 1) OVER p WHEN 2 THEN lead(v, 2) OVER p WHEN 3 THEN lead(v, 3) OVER p ELSE lead(v, 4) OVER p END - v) AS d
          FROM windowed, range(1, 5) r(step) WINDOW p AS (PARTITION BY recording_id, w, channel, step ORDER BY k)),
        l AS (SELECT recording_id, w, channel, step, m, sum(d) * 15 / floor((15 - m) / step) / step / step AS l FROM d WHERE d IS NOT NULL GROUP BY recording_id, w, channel, step, m),
        n AS (SELECT recording_id, w, channel, step, avg(l) AS l FROM l GROUP BY ALL HAVING avg(l) > 0)
        SELECT recording_id, w, channel, round(regr_slope(ln(l), ln(1 / step)), 5) + 0.0 AS dimension FROM n GROUP BY ALL""",
        "windowed@own",
    ),
)
def _q11b(spark, d):  # noqa: ANN001, ANN202
    return cx.fractal_dimension(channel_windows(spark, d), CH).withColumn("dimension", rounded(F.col("dimension"), 5))


_FRACTAL = """WITH s AS (SELECT event_type AS recording_id, CAST(-1 AS BIGINT) AS channel, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events UNION ALL
        SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 FROM events WHERE user_id < 3),
        st AS (SELECT recording_id, channel, count(*) AS n, avg(v) AS mean, list_filter(list_distinct(list_transform(range(0, 30), lambda i: CAST(floor(power(10.0, 0.7 + i * (log10(count(*) / 4) - 0.7) / 29) + 1e-9) AS BIGINT))), lambda x: x > 2) AS lags FROM s GROUP BY ALL),
        y AS (SELECT recording_id, channel, t, n, lags, sum(v - mean) OVER (PARTITION BY recording_id, channel ORDER BY t ROWS UNBOUNDED PRECEDING) AS y FROM s JOIN st USING (recording_id, channel) WHERE n >= 1000 AND len(lags) >= 5),
        e AS (SELECT * EXCLUDE lags, unnest(lags) AS s FROM y), x AS (SELECT recording_id, channel, t, y, s, t // s AS box FROM e UNION ALL SELECT recording_id, channel, t, y, s, -1 - (t - n % s) // s FROM e WHERE t >= n % s),
        b AS (SELECT recording_id, channel, s, box, greatest((regr_syy(y, t) - power(regr_sxy(y, t), 2) / regr_sxx(y, t)) / count(*), 1e-30) AS f2 FROM x GROUP BY ALL HAVING count(*) = s),
        f AS (SELECT recording_id, channel, s, q, avg(power(f2, q / 2)) AS m FROM b, (SELECT (k - 8) / 2.0::DOUBLE AS q FROM range(0, 17) r(k) WHERE k <> 8) GROUP BY ALL),
        h AS (SELECT recording_id, channel, q, regr_slope(ln(m) / q, ln(s)) AS h FROM f GROUP BY ALL), tau AS (SELECT *, q * h - 1 AS tau FROM h),
        a AS (SELECT *, (lead(tau, 1, tau) OVER w - lag(tau, 1, tau) OVER w) / (lead(q, 1, q) OVER w - lag(q, 1, q) OVER w) AS alpha FROM tau WINDOW w AS (PARTITION BY recording_id, channel ORDER BY q))"""


def _spectrum(spark, d):  # noqa: ANN001, ANN202
    """Whole recordings as channel -1, and the users 0 to 2 of each, most of which are too short."""
    e = table(spark, d, "events").select(F.col("event_type").alias("recording_id"), F.col("user_id").alias("channel"), "ts", "event_id", F.col("value").alias("v"))
    both = e.withColumn("channel", F.lit(-1).cast("long")).unionByName(e.filter("channel < 3"))
    return cx.multifractal(cx.numbered(both, ["recording_id", "channel"], ["ts", "event_id"]), ["recording_id", "channel"], "n", "v")


@query("q12_multifractal", _FRACTAL + " SELECT st.recording_id, st.channel, st.n, q, round(h, 4) + 0.0 AS h, round(tau, 4) + 0.0 AS tau, round(alpha, 4) + 0.0 AS alpha, round(q * alpha - tau, 4) + 0.0 AS f FROM st LEFT JOIN a USING (recording_id, channel)")
def _q12(spark, d):  # noqa: ANN001, ANN202
    return _spectrum(spark, d).select("recording_id", "channel", "n", "q", *(rounded(F.col(c), 4).alias(c) for c in ("h", "tau", "alpha", "f")))


@query("q12_singularity_width", _FRACTAL + " SELECT st.recording_id, st.channel, st.n, round(min(alpha), 4) + 0.0 AS alpha_min, round(max(alpha), 4) + 0.0 AS alpha_max, round(max(alpha) - min(alpha), 4) + 0.0 AS width FROM st LEFT JOIN a USING (recording_id, channel) GROUP BY ALL")
def _q12b(spark, d):  # noqa: ANN001, ANN202
    w = cx.singularity_width(_spectrum(spark, d), ["recording_id", "channel"])
    return w.select("recording_id", "channel", "n", *(rounded(F.col(c), 4).alias(c) for c in ("alpha_min", "alpha_max", "width")))


_PATHS = (
    _TOP
    + """, nb AS (SELECT recording_id, w, a AS u, b AS v FROM g UNION SELECT recording_id, w, b, a FROM g),
  reach AS (SELECT recording_id, w, u, v, min(len_) AS far FROM (WITH RECURSIVE p AS (SELECT recording_id, w, u, v, 1 AS len_ FROM nb UNION SELECT p.recording_id, p.w, p.u, nb.v, len_ + 1 FROM p JOIN nb ON nb.recording_id = p.recording_id AND nb.w = p.w AND nb.u = p.v WHERE len_ < 7) SELECT * FROM p) WHERE u <> v GROUP BY ALL),
  part AS (SELECT recording_id, w, u, least(u, min(v)) AS root FROM reach GROUP BY recording_id, w, u),
  inner_ AS (SELECT recording_id, w, root, avg(far) AS far FROM reach JOIN part USING (recording_id, w, u) GROUP BY ALL),
  len_ AS (SELECT recording_id, w, avg(far) AS l FROM inner_ GROUP BY ALL), eff AS (SELECT recording_id, w, sum(1 / far) / 56 AS e FROM reach GROUP BY ALL),
  deg AS (SELECT recording_id, w, u, count(*) AS d FROM nb GROUP BY ALL), tri AS (SELECT x.recording_id, x.w, count(*) AS closed FROM nb x JOIN nb y ON y.recording_id = x.recording_id AND y.w = x.w AND y.u = x.v JOIN nb z ON z.recording_id = x.recording_id AND z.w = x.w AND z.u = y.v AND z.v = x.u GROUP BY ALL),
  dg AS (SELECT recording_id, w, sum(d * (d - 1)) AS triads, sum(d) / 56 AS density, sum(d) / 8 AS mean_ FROM deg GROUP BY ALL)"""
)


@query(
    "c7_graph_paths",
    sql(
        _PATHS + """ SELECT recording_id, w, round(e, 6) AS global_efficiency, round(coalesce(closed, 0) / nullif(triads, 0) / density / (l / CASE WHEN mean_ > 1 THEN ln(8) / ln(greatest(mean_, 1.001)) ELSE 1 END), 6) AS small_worldness
        FROM eff JOIN len_ USING (recording_id, w) JOIN dg USING (recording_id, w) LEFT JOIN tri USING (recording_id, w)""",
        "phase",
    ),
)
def _c7(spark, d):  # noqa: ANN001, ANN202
    g = cx.graph_paths(_edges(spark, d), KEY, 8)
    return g.select(*KEY, rounded(F.col("global_efficiency")).alias("global_efficiency"), rounded(F.col("small_worldness")).alias("small_worldness"))


@query("q16_evoked_complexity")
def _q16(spark, d):  # noqa: ANN001, ANN202
    return cx.evoked_complexity(windowed(spark, d), KEY, 6)


@query("c5_lagged_tests")
def _c5(spark, d):  # noqa: ANN001, ANN202
    return cx.lagged_tests(windowed(spark, d), KEY, 3)


@query(
    "c6_connectivity_row",
    sql(

                ", p AS (SELECT a.recording_id, a.w, a.channel AS a, b.channel AS b, avg(cos(b.theta - a.theta)) AS c, avg(sin(b.theta - a.theta)) AS s, "
                "abs(avg(sign(sin(b.theta - a.theta)))) AS pli, avg(abs(sin(b.theta - a.theta))) AS m"
 + _PAIR + ")" + _CORR
        + """, q AS (SELECT recording_id, w, count(*) AS n_pairs, avg(sqrt(c * c + s * s)) AS plv, avg(pli) AS pli, avg(CASE WHEN m = 0 THEN 0.0 ELSE abs(s) / m END) AS wpli, count(*) FILTER (WHERE sqrt(c * c + s * s) > 0.5) AS n_locked FROM p GROUP BY ALL),
        r AS (SELECT recording_id, w, avg(abs(r)) AS r, count(*) FILTER (WHERE abs(r) * sqrt(14 / nullif(1 - r * r, 0)) > 2.144787) AS n_correlated FROM e GROUP BY ALL)
        SELECT recording_id, w, n_pairs, round(plv, 6) AS mean_plv, round(pli, 6) AS mean_pli, round(wpli, 6) AS mean_wpli, n_locked, round(r, 6) AS mean_abs_r, n_correlated FROM q JOIN r USING (recording_id, w)""",
        "phase",
    ),
)
def _c6(spark, d):  # noqa: ANN001, ANN202
    q = pm.phase_coupling(phase(spark, d), KEY).groupBy(*KEY)
    q = q.agg(F.count("*").alias("n_pairs"), *(rounded(F.avg(c)).alias(f"mean_{c}") for c in ("plv", "pli", "wpli")), F.count_if(F.col("plv") > 0.5).alias("n_locked"))
    t = F.abs("r") * F.sqrt(14 / F.nullif(1 - F.col("r") ** 2, F.lit(0.0)))  # beyond 2.144787 with 14 degrees of freedom p is under 0.05
    r = pm.correlation(windowed(spark, d), KEY).groupBy(*KEY).agg(rounded(F.avg(F.abs("r"))).alias("mean_abs_r"), F.count_if(t > 2.144787).alias("n_correlated"))
    return q.join(r, KEY)


@query("c6_predictability_row")
def _c6b(spark, d):  # noqa: ANN001, ANN202
    least = cx.lagged_tests(windowed(spark, d), KEY, 3).groupBy(*KEY, "source", "target").agg(F.min("p").alias("p"))
    return least.groupBy(*KEY).agg(F.count("p").alias("n_pairs"), rounded(F.avg("p")).alias("mean_least_p"), F.count_if(F.col("p") < 0.05).alias("n_significant"))


@query("c11_window_records")
def _c11(spark, d):  # noqa: ANN001, ANN202
    shape = sg.graph_shape(pm.phase_coupling(phase(spark, d), KEY), KEY, "plv", 0.3, 8)
    low, looped = F.col("spectral_dimension") < 2, F.col("beta1") > 0
    flags = F.array_join(F.filter(F.array(F.when(looped, F.lit("loops")), F.when(low, F.lit("low_dimension")), F.when(F.col("beta0") > 1, F.lit("split"))), lambda f: f.isNotNull()), ";")
    return shape.select(*KEY, "beta0", "beta1", rounded(F.col("spectral_dimension")).alias("spectral_dimension"), flags.alias("flags"))


@query(
    "c12_cohort_metrics",
    sql(
        _CORR.replace(", e AS", ", e0 AS") + """, e AS (SELECT * FROM e0), bars AS (SELECT recording_id, w, a, 1 - abs(r) AS len_ FROM e), s AS (SELECT recording_id, count(DISTINCT w) AS n_windows, round(avg(len_), 6) AS mean_bar, round(sum(len_), 4) AS total_bar FROM bars GROUP BY ALL),
        gm AS (SELECT recording_id, avg(n) AS mean_strong FROM (SELECT recording_id, w, count(*) FILTER (WHERE abs(r) > 0.5) AS n FROM e GROUP BY ALL) GROUP BY ALL), ids AS (SELECT DISTINCT event_type AS recording_id FROM events UNION ALL SELECT 'absent')
        SELECT recording_id, coalesce(n_windows, 0) AS n_windows, mean_bar, total_bar, round(mean_strong, 6) AS mean_strong, CASE WHEN n_windows IS NULL THEN 'error: no complete windows' ELSE 'ok' END AS status FROM ids LEFT JOIN s USING (recording_id) LEFT JOIN gm USING (recording_id)""",
        "windowed",
    ),
)
def _c12(spark, d):  # noqa: ANN001, ANN202
    e = pm.correlation(windowed(spark, d), KEY).withColumn("len", 1 - F.abs("r"))
    s = e.groupBy("recording_id").agg(F.countDistinct("w").alias("n_windows"), rounded(F.avg("len")).alias("mean_bar"), rounded(F.sum("len"), 4).alias("total_bar"))
    strong = e.groupBy(*KEY).agg(F.count_if(F.abs("r") > 0.5).alias("n")).groupBy("recording_id").agg(rounded(F.avg("n")).alias("mean_strong"))
    ids = table(spark, d, "events").select(F.col("event_type").alias("recording_id")).distinct().union(spark.createDataFrame([("absent",)], "id string"))
    out = ids.join(s, "recording_id", "left").join(strong, "recording_id", "left")
    status = F.when(F.col("n_windows").isNull(), "error: no complete windows").otherwise("ok")
    return out.select("recording_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "mean_bar", "total_bar", "mean_strong", status.alias("status"))


def _charged(spark, d):  # noqa: ANN001, ANN202
    p = ft.defects(field(spark, d), ["t", "z"])
    return p.select("z", "t", F.concat_ws("-", "t", "z", "i", "j").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("sign").cast("double").alias("charge"))


@query("n7_cluster_summary")
def _n7(spark, d):  # noqa: ANN001, ANN202
    return cx.spatial_clusters(_charged(spark, d), ["z", "t"], 3)


@query("j15_cluster_survival")
def _j15(spark, d):  # noqa: ANN001, ANN202
    c = cx.spatial_clusters(_charged(spark, d), ["z", "t"], 3)
    links = cx.cluster_links(c, ["z"], "t")
    ends = c.filter("cluster >= 0").groupBy("z").agg(F.count("*").alias("n_clusters"))
    n = links.groupBy("z").agg(F.count("*").alias("n_links"))
    # each link makes one lineage of two, so the mean length is clusters over lineages
    return ends.join(n, "z", "left").select("z", "n_clusters", F.coalesce("n_links", F.lit(0)).alias("n_links"), rounded(F.col("n_clusters") / (F.col("n_clusters") - F.coalesce("n_links", F.lit(0)))).alias("mean_survival"))


@query("v9_spin_test")
def _v9(spark, d):  # noqa: ANN001, ANN202
    spins = cx.spin_assignments(sensor(spark).select("channel", "x", "y"), 1000, 9)
    m = phase(spark, d).groupBy("recording_id", F.col("channel").alias("source")).agg(F.avg("theta").alias("v"))
    spun = m.join(F.broadcast(spins), "source").join(F.broadcast(sensor(spark).select("channel", "region")), "channel")  # eight sensors
    mean = lambda r: F.avg(F.when(F.col("region") == r, F.col("v")))
    c = spun.groupBy("recording_id", F.col("spin").alias("perm")).agg((mean("left") - mean("right")).alias("contrast"))
    t = ev._null_share(c.filter("contrast is not null"), ["recording_id"], "contrast", "two-sided")
    failed = c.groupBy("recording_id").agg(F.count_if(F.col("contrast").isNull()).alias("n_failed"))
    return t.join(failed, "recording_id").select("recording_id", rounded(F.col("observed")).alias("observed"), "exceed", "n", rounded(F.col("p")).alias("p"), "n_failed")


_J10 = """lines AS (SELECT l_orderkey AS tri_id, n_regionkey AS label, n_nationkey % 7 = 0 AS unlabelled FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linenumber <= 3),
  whole AS (SELECT tri_id, bool_or(unlabelled) AS lost FROM lines GROUP BY ALL HAVING count(*) = 3), votes AS (SELECT tri_id, label, count(*) AS n FROM lines GROUP BY ALL)"""


@query("j10_order_triangles",
        f"WITH {_J10} SELECT w.tri_id, CASE WHEN NOT lost THEN max(CASE WHEN n >= 2 THEN label END) END AS region FROM whole w JOIN votes v ON v.tri_id = "
        f"w.tri_id GROUP BY w.tri_id, lost"
    )
def _j10(spark, d):  # noqa: ANN001, ANN202
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_regionkey")).alias("label"))
    corners = table(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("tri_id"), "l_suppkey").join(s, "l_suppkey")
    return pm.majority_label(corners, "tri_id", "label", 3).withColumnRenamed("label", "region")


@query(
    "n5_unassigned",
    sql(_TR.replace("ELSE 'right' END", "WHEN count(*) FILTER (WHERE region = 'right' AND channel <> 7) >= 2 THEN 'right' END").replace("FROM (SELECT tri_id", "FROM (SELECT tri_id") +
            " SELECT recording_id, w, coalesce(region, 'unassigned') AS region, count(*) AS n, round(sum(winding), 6) + 0.0 AS net, round(sum(abs(winding)), 6) AS "
            "absolute FROM winding JOIN tr USING (tri_id) GROUP BY ALL"
        , "winding", "sensor"),
)
def _n5(spark, d):  # noqa: ANN001, ANN202
    corners = triangle(spark).select("tri_id", F.explode(F.array("v0", "v1", "v2")).alias("channel")).join(sensor(spark), "channel").withColumn("region", F.when((F.col("channel") != 7) | (F.col("region") == "left"), F.col("region")))
    regions = corners.groupBy("tri_id").agg(F.when(F.count_if(F.col("region") == "left") >= 2, "left").when(F.count_if(F.col("region") == "right") >= 2, "right").alias("region"))
    t = pm.triangle_winding(phase(spark, d), triangle(spark), KEY).join(F.broadcast(regions), "tri_id")
    return t.groupBy(*KEY, F.coalesce("region", F.lit("unassigned")).alias("region")).agg(F.count("*").alias("n"), rounded(F.sum("winding")).alias("net"), rounded(F.sum(F.abs("winding"))).alias("absolute"))


@query(
    "n9_valid_triangles",
    sql(
        _CORR + """, s AS (SELECT recording_id, w, a, b, abs(r) AS r FROM e), t AS (SELECT x.recording_id, x.w, count(*) AS n, count(*) FILTER (WHERE (x.r + y.r + z.r) / 3 > 0.3) AS valid FROM s x JOIN s y ON y.recording_id = x.recording_id AND y.w = x.w AND y.a = x.b JOIN s z ON z.recording_id = x.recording_id AND z.w = x.w AND z.a = x.a AND z.b = y.b GROUP BY ALL)
        SELECT recording_id, w, n AS n_triangles, valid AS n_valid, round(valid / n, 6) AS valid_share FROM t""",
        "windowed",
    ),
)
def _n9(spark, d):  # noqa: ANN001, ANN202
    return pm.valid_triangles(pm.correlation(windowed(spark, d), KEY), KEY, "r", 0.3).withColumn("valid_share", rounded(F.col("valid_share")))





#: An 8 x 8 grid that reaches half a unit beyond the sensors.
_SIDE = 8


def _weights() -> list[tuple[int, int, int, float]]:
    xy = np.array([(x, y) for _, x, y, _ in SENSORS])
    return mt.grid_weights(xy, [t[1:] for t in TRIANGLES], np.linspace(-0.5, 3.5, _SIDE), np.linspace(-0.5, 1.5, _SIDE))


_MONTAGE = ", wt AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {s}, {w!r}::DOUBLE)" for i, j, s, w in _weights()) + ") t(i, j, channel, weight)), g AS (SELECT recording_id, w, k, i, j, sum(theta * weight) AS theta FROM phase JOIN wt USING (channel) GROUP BY ALL)"


def _montage(spark, d):  # noqa: ANN001, ANN202
    return phase(spark, d), [*KEY, "k"], "channel", "theta", spark.createDataFrame(_weights(), "i int, j int, sensor long, weight double")


@query(
    "n8_grid_charge",
    sql(
        _MONTAGE + f""", q AS (SELECT a.recording_id, a.w, a.k, ({_wrap('b.theta - a.theta')} + {_wrap('c.theta - b.theta')} + {_wrap('d.theta - c.theta')} + {_wrap('a.theta - d.theta')}) / (2 * pi()) AS q FROM g a
        JOIN g b ON b.recording_id = a.recording_id AND b.w = a.w AND b.k = a.k AND b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.recording_id = a.recording_id AND c.w = a.w AND c.k = a.k AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN g d ON d.recording_id = a.recording_id AND d.w = a.w AND d.k = a.k AND d.i = a.i AND d.j = a.j + 1)
        SELECT recording_id, w, k, CAST(round_even(sum(q), 0) AS INTEGER) AS q, round(sum(abs(q)), 5) AS q_abs, count(*) AS n_patches FROM q GROUP BY ALL""",
        "phase",
    ),
)
def _n8(spark, d):  # noqa: ANN001, ANN202
    p = mt.grid_patches(*_montage(spark, d))
    return p.groupBy(*KEY, "k").agg(F.rint(F.sum("q")).cast("int").alias("q"), rounded(F.sum(F.abs("q")), 5).alias("q_abs"), F.count("*").alias("n_patches"))


@query("n8_interpolated_grid", sql(_MONTAGE + " SELECT recording_id, w, k, i, j, round(theta, 6) + 0.0 AS theta FROM g", "phase"))
def _n8b(spark, d):  # noqa: ANN001, ANN202
    return mt.on_grid(*_montage(spark, d)).withColumn("theta", rounded(F.col("theta")))


@query("q4_state_metrics")
def _q4(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.plans.q_last import _q4 as states

    s = states(spark, d)
    at = W.partitionBy(*KEY).orderBy("k")
    s = s.withColumn("moved", (F.col("state") != F.lag("state").over(at)).cast("int"))
    n = s.groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("moved").alias("n_transitions"))
    o = s.groupBy("recording_id", "state").agg(F.count("*").alias("held"))
    return o.join(n, "recording_id").select("recording_id", "state", rounded(F.col("held") / F.col("n")).alias("occupancy"), "n_transitions")


@query(
    "q15_feature_rows",
    sql(
        """, p AS (SELECT recording_id, w, channel, avg(v * v) AS power FROM windowed GROUP BY ALL), h AS (SELECT recording_id, w, channel, round(v, 1) AS bin, count(*) AS n FROM windowed GROUP BY ALL),
        e AS (SELECT recording_id, w, channel, -sum(n / 16 * log2(n / 16)) AS entropy FROM h GROUP BY ALL), b AS (SELECT recording_id, w, channel, k, CASE WHEN v >= avg(v) OVER (PARTITION BY recording_id, w, channel) THEN '1' ELSE '0' END AS s FROM windowed),
        t AS (SELECT recording_id, w, channel, string_agg(s, '' ORDER BY k) AS s FROM b GROUP BY ALL), x AS (SELECT DISTINCT recording_id, w, channel, s[CAST(i AS INTEGER):CAST(i + l - 1 AS INTEGER)] AS sub FROM t, range(1, 17) a(i), range(1, 5) c(l) WHERE i + l - 1 <= 16),
        z AS (SELECT recording_id, w, channel, count(*) / 16 AS lzc FROM x GROUP BY ALL)
        SELECT recording_id, w, channel, round(power, 2) AS spectral_power_proxy, round(entropy, 5) + 0.0 AS entropy_proxy, round(lzc, 6) AS lzc_proxy FROM p JOIN e USING (recording_id, w, channel) JOIN z USING (recording_id, w, channel)""",
        "windowed@own",
    ),
)
def _q15(spark, d):  # noqa: ANN001, ANN202
    w = channel_windows(spark, d)
    out = wn.power(w, CH).join(wn.rounded_entropy(w, CH), CH).join(wn.substring_diversity(w, CH), CH)
    return out.select(*CH, rounded_double(F.col("power"), 2).alias("spectral_power_proxy"), rounded(F.col("entropy"), 5).alias("entropy_proxy"), rounded(F.col("lzc")).alias("lzc_proxy"))


@query("v3_two_sided_gate")
def _v3(spark, d):  # noqa: ANN001, ANN202
    m = sg.surrogate_metrics(channel_windows(spark, d), KEY, CH, 50, "v3", cl.METRICS["roughness"])
    known = F.filter("nulls", lambda x: x.isNotNull())
    m = m.select(*CH, "observed", known.alias("nulls")).filter(F.size("nulls") > 0)
    mean = F.aggregate("nulls", F.lit(0.0), lambda t, x: t + x) / F.size("nulls")
    t = m.select(*CH, (F.col("observed") - mean).alias("observed"), F.transform("nulls", lambda x: x - mean).alias("nulls"))
    hits = F.size(F.filter("nulls", lambda x: ev.EXTREME["two-sided"](x, F.col("observed")))).cast("long")
    t = t.select(*CH, "observed", hits.alias("exceed"), F.size("nulls").cast("long").alias("n")).withColumn("p", (F.col("exceed") + 1) / (F.col("n") + 1))
    return t.select(*CH, rounded(F.col("observed")).alias("observed"), "exceed", "n", rounded(F.col("p")).alias("p"))
