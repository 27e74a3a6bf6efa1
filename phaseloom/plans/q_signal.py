"""Queries of the window, phase and connectivity operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import phase_metrics as pm
from phaseloom.operators import windows as wn
from phaseloom.plans.views import channel_windows, _wrap, phase, rounded, rounded_double, samples, sensor, sql, triangle, windowed

QUERIES = {}
KEY = ["recording_id", "w"]
CH = [*KEY, "channel"]


def query(name: str, statement: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


def _r(df, keys, *cols):  # noqa: ANN001, ANN202
    return df.select(*keys, *(rounded(F.col(c)).alias(c) for c in cols))


@query("w2_tumbling_windows", sql(
        ", s AS (SELECT recording_id, channel, count(*) AS n FROM samples GROUP BY ALL) SELECT recording_id, channel, CAST(w AS INTEGER) AS w, CASE WHEN n < "
        "16 THEN n ELSE 16 END AS n_samples, CASE WHEN n < 16 THEN 'short_window' ELSE 'ok' END AS status FROM (SELECT *, unnest(range(0, greatest(least(n // "
        "16, 10), 1))) AS w FROM s)"
    , "samples"))
def _w2(spark, d):  # noqa: ANN001, ANN202
    return wn.tumbling(samples(spark, d), ["recording_id", "channel"], 16, cap=10)


@query("w2b_spaced_windows", sql(
        ", s AS (SELECT recording_id, channel, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) >= 16) SELECT recording_id, channel, CAST(w AS INTEGER) "
        "AS w, CAST(floor(w * (n - 16) / 4) AS INTEGER) AS start FROM s, range(5) r(w)"
    , "samples"))
def _w2b(spark, d):  # noqa: ANN001, ANN202
    return wn.spaced(samples(spark, d), ["recording_id", "channel"], 16, 5)


@query("w3_sliding_windows", sql(
        ", s AS (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS size FROM samples) SELECT recording_id, channel, CAST(w AS INTEGER) AS w, "
        "count(*) AS n_samples, round(avg(v), 6) AS mean_v FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((n - 15) / 8)) AS BIGINT), least(n // 8, (size - "
        "16) // 8) + 1)) AS w FROM s WHERE size >= 16) GROUP BY ALL"
    , "samples"))
def _w3(spark, d):  # noqa: ANN001, ANN202
    s = wn.sliding(samples(spark, d), ["recording_id", "channel"], 16, 8)
    return s.groupBy("recording_id", "channel", "w").agg(F.count("*").alias("n_samples"), rounded(F.avg("v")).alias("mean_v"))


@query("w4_trailing_drops", sql(
        ", b AS (SELECT recording_id, channel, n, v, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sigma, count(v) OVER w AS c FROM samples WINDOW w AS "
        "(PARTITION BY recording_id, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT recording_id, channel, n, round((mu - v) / sigma, 4) "
        "AS z FROM b WHERE c = 5 AND sigma > 1e-9 AND (mu - v) / sigma > 2"
    , "samples"))
def _w4(spark, d):  # noqa: ANN001, ANN202
    z = wn.trailing_drops(samples(spark, d), ["recording_id", "channel"], "n", "v", z=2.0)
    return z.select("recording_id", "channel", "n", rounded(F.col("z"), 4).alias("z"))


@query(
    "w4_refractory_drops",
    sql(
        """, t AS (SELECT recording_id, channel, n, v, avg(v) OVER b AS mu, stddev_pop(v) OVER b AS sigma, count(v) OVER b AS c FROM samples
          WINDOW b AS (PARTITION BY recording_id, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
        h AS (SELECT recording_id, channel, n FROM t WHERE c = 5 AND sigma > 1e-9 AND (mu - v) / sigma > 2),
        nxt AS (SELECT a.recording_id, a.channel, a.n, min(b.n) AS m FROM h a LEFT JOIN h b ON b.recording_id = a.recording_id AND b.channel = a.channel AND b.n >= a.n + 3 GROUP BY ALL),
        kept AS (SELECT * FROM (WITH RECURSIVE k AS (SELECT recording_id, channel, min(n) AS n FROM h GROUP BY ALL UNION ALL SELECT nxt.recording_id, nxt.channel, nxt.m FROM k JOIN nxt USING (recording_id, channel, n) WHERE nxt.m IS NOT NULL) SELECT * FROM k))
        SELECT recording_id, channel, n FROM kept""",
        "samples",
    ),
)
def _w4b(spark, d):  # noqa: ANN001, ANN202
    return wn.refractory(wn.trailing_drops(samples(spark, d), ["recording_id", "channel"], "n", "v", z=2.0), ["recording_id", "channel"], "n")


@query("w5_sliding_matrix_mean", sql(
        ", p AS (SELECT a.recording_id, a.w, a.channel AS a, b.channel AS b, sqrt(power(avg(cos(b.theta - a.theta)), 2) + power(avg(sin(b.theta - a.theta)), "
        "2)) AS plv FROM phase a JOIN phase b USING (recording_id, w, k) WHERE a.channel < b.channel GROUP BY ALL) SELECT recording_id, w, a, b, "
        "round(avg(plv) OVER (PARTITION BY recording_id, a, b ORDER BY w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS mean_plv FROM p"
    , "phase"))
def _w5(spark, d):  # noqa: ANN001, ANN202
    p = pm.phase_coupling(phase(spark, d), KEY)
    over = W.partitionBy("recording_id", "a", "b").orderBy("w").rowsBetween(0, 2)
    return p.select(*KEY, "a", "b", rounded(F.avg("plv").over(over)).alias("mean_plv"))


@query("w8_scaling", sql(
        " SELECT recording_id, w, channel, k, CASE WHEN max(v) OVER p - min(v) OVER p < 1e-12 THEN 0.5 ELSE round((v - min(v) OVER p) / (max(v) OVER p - "
        "min(v) OVER p), 6) END AS scaled, CASE WHEN stddev_pop(v) OVER p < 1e-12 THEN 0.0 ELSE round((v - avg(v) OVER p) / stddev_pop(v) OVER p, 5) + 0.0 END "
        "AS z FROM windowed WINDOW p AS (PARTITION BY recording_id, w, channel)"
    , "windowed"))
def _w8(spark, d):  # noqa: ANN001, ANN202
    w = windowed(spark, d)
    return w.select(*CH, "k", rounded(wn.scaled(w, "v", CH)).alias("scaled"), rounded(wn.znorm("v", CH), 5).alias("z"))


@query("w9_binary_activity", sql(
        ", m AS (SELECT recording_id, w, k, avg(v) AS m FROM windowed GROUP BY ALL), o AS (SELECT recording_id, w, k, CASE WHEN m > avg(m) OVER (PARTITION BY "
        "recording_id, w) THEN 1 ELSE 0 END AS s FROM m), l AS (SELECT *, lag(s) OVER (PARTITION BY recording_id, w ORDER BY k) AS b FROM o) SELECT "
        "recording_id, w, round(avg(s), 6) AS active, CAST(sum(CASE WHEN b IS NOT NULL AND b <> s THEN 1 ELSE 0 END) AS BIGINT) AS transitions FROM l GROUP BY "
        "ALL"
    , "windowed"))
def _w9(spark, d):  # noqa: ANN001, ANN202
    a = wn.binary_activity(windowed(spark, d), KEY)
    return a.select(*KEY, rounded(F.col("active")).alias("active"), "transitions")


@query("w10_artifacts", sql(
        ", j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY recording_id, w, channel ORDER BY k)) AS jump, avg(v) OVER p AS mu, stddev_pop(v) OVER p AS sd, "
        "min(v) OVER p AS lo, max(v) OVER p AS hi FROM windowed WINDOW p AS (PARTITION BY recording_id, w, channel)) SELECT recording_id, w, channel, "
        "round(least(1.0, avg(jump) / (max(sd) + 1e-6)), 6) AS artifact_score, round(avg(CASE WHEN jump < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS flat_ratio, "
        "round(avg(CASE WHEN v = lo OR v = hi THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio, round(avg(CASE WHEN abs(v - mu) > 3 * sd THEN 1.0 ELSE 0.0 END), 6) AS "
        "outlier_ratio FROM j GROUP BY ALL"
    , "windowed"))
def _w10(spark, d):  # noqa: ANN001, ANN202
    return _r(wn.artifact(windowed(spark, d), CH), CH, "artifact_score", "flat_ratio", "clip_ratio", "outlier_ratio")


@query("q2_channel_gradient", sql(", s AS (SELECT recording_id, w, channel, " + _wrap("lead(theta) OVER (PARTITION BY recording_id, w, k ORDER BY channel) - theta") +
        " AS d FROM phase), c AS (SELECT recording_id, w, channel, avg(d) AS m, avg(abs(d)) AS g FROM s WHERE d IS NOT NULL GROUP BY ALL), q AS (SELECT "
        "recording_id, w, sum(m) / (2 * pi()) AS q, sum(abs(m)) / (2 * pi()) AS q_abs, avg(g) AS phase_grad FROM c GROUP BY ALL) SELECT recording_id, w, "
        "round(q, 6) + 0.0 AS q, round(q_abs, 6) AS q_abs, round(phase_grad, 6) AS phase_grad, round((q_abs - abs(q)) / (abs(q) + 1e-12), 2) AS f_dress FROM q"
    , "phase"))
def _q2(spark, d):  # noqa: ANN001, ANN202
    g = pm.channel_gradient(phase(spark, d), KEY)
    return _r(g, KEY, "q", "q_abs", "phase_grad").join(g.select(*KEY, rounded(F.col("f_dress"), 2).alias("f_dress")), KEY)


@query("q3_kuramoto_order", sql(
        ", r AS (SELECT recording_id, w, k, sqrt(power(avg(cos(theta)), 2) + power(avg(sin(theta)), 2)) AS r FROM phase GROUP BY ALL) SELECT recording_id, w, "
        "round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS metastability FROM r GROUP BY ALL"
    , "phase"))
def _q3(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.kuramoto(phase(spark, d), KEY), KEY, "r_mean", "metastability")


@query("q4_coherence_sums", sql(
        ", m AS (SELECT recording_id, w, k, sum(cos(theta) * cos(theta)) AS cc, sum(cos(theta) * sin(theta)) AS cs, sum(sin(theta) * sin(theta)) AS ss FROM "
        "phase GROUP BY ALL) SELECT recording_id, w, k, round((cc + ss + sqrt(power(cc - ss, 2) + 4 * cs * cs)) / 2, 6) AS leading_value FROM m"
    , "phase"))
def _q4(spark, d):  # noqa: ANN001, ANN202
    m = phase(spark, d).groupBy(*KEY, "k").agg(F.sum(F.cos("theta") ** 2).alias("cc"), F.sum(F.cos("theta") * F.sin("theta")).alias("cs"), F.sum(F.sin("theta") ** 2).alias("ss"))
    top = (F.col("cc") + F.col("ss") + F.sqrt((F.col("cc") - F.col("ss")) ** 2 + 4 * F.col("cs") ** 2)) / 2
    return m.select(*KEY, "k", rounded(top).alias("leading_value"))


@query("q5_temporal_phase", sql(
        ", m AS (SELECT recording_id, w, channel, k, CASE WHEN v - avg(v) OVER (PARTITION BY recording_id, w, channel) >= 0 THEN 0.0 ELSE pi() END AS th FROM "
        "windowed), s AS (SELECT recording_id, w, channel, th - lag(th) OVER (PARTITION BY recording_id, w, channel ORDER BY k) AS d FROM m) SELECT "
        "recording_id, w, channel, round(sum(d) / (2 * pi()), 6) + 0.0 AS q, round(sum(abs(d)) / (2 * pi()), 6) AS q_abs FROM s GROUP BY ALL"
    , "windowed@own"))
def _q5(spark, d):  # noqa: ANN001, ANN202
    th = F.when(F.col("v") - F.col("mean") >= 0, 0.0).otherwise(F.pi())
    s = wn.with_mean(channel_windows(spark, d), "v", CH, "k", "mean").withColumn("th", th).withColumn("d", F.col("th") - F.lag("th").over(W.partitionBy(*CH).orderBy("k")))
    return s.groupBy(*CH).agg(rounded(F.sum("d") / (2 * F.pi())).alias("q"), rounded(F.sum(F.abs("d")) / (2 * F.pi())).alias("q_abs"))


_SPEC = ", spec AS (SELECT recording_id, w, channel, f, sum(v * cos(2 * pi() * k * f / 16)) AS re, -sum(v * sin(2 * pi() * k * f / 16)) AS im FROM windowed, range(9) g(f) GROUP BY ALL)"


@query("q1_band_phasors", sql(_SPEC +
        ", b AS (SELECT recording_id, w, channel, CASE WHEN f BETWEEN 1 AND 2 THEN 'slow' WHEN f BETWEEN 3 AND 5 THEN 'mid' WHEN f >= 6 THEN 'fast' END AS "
        "band, sum(re) AS re, sum(im) AS im, sum(re * re + im * im) AS power FROM spec WHERE f > 0 GROUP BY ALL) SELECT recording_id, w, channel, band, "
        "round(sqrt(re * re + im * im), 5) AS amp, round(power, 4) AS power FROM b"
    , "windowed@own"))
def _q1(spark, d):  # noqa: ANN001, ANN202
    band = F.when(F.col("f").between(1, 2), "slow").when(F.col("f").between(3, 5), "mid").when(F.col("f") >= 6, "fast")
    b = wn.spectrum(channel_windows(spark, d), CH, 16).filter("f > 0").groupBy(*CH, band.alias("band")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("power").alias("power"))
    return b.select(*CH, "band", rounded(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 5).alias("amp"), rounded(F.col("power"), 4).alias("power"))


@query("q6_spectral_ratio", sql(
        ", m AS (SELECT recording_id, w, k, avg(v) AS v FROM windowed GROUP BY ALL), s AS (SELECT recording_id, w, f, power(sum(v * cos(2 * pi() * k * f / "
        "16)), 2) + power(sum(v * sin(2 * pi() * k * f / 16)), 2) AS p FROM m, range(9) g(f) GROUP BY ALL) SELECT recording_id, w, round(sum(CASE WHEN f >= 5 "
        "THEN p ELSE 0 END) / (sum(CASE WHEN f BETWEEN 1 AND 4 THEN p ELSE 0 END) + 1e-12), 5) AS ratio FROM s GROUP BY ALL"
    , "windowed"))
def _q6(spark, d):  # noqa: ANN001, ANN202
    m = windowed(spark, d).groupBy(*KEY, "k").agg(F.avg("v").alias("v"))
    s = wn.spectrum(m, KEY, 16)
    part = lambda lo, hi: F.sum(F.when(F.col("f").between(lo, hi), F.col("power")).otherwise(0.0))
    return s.groupBy(*KEY).agg(rounded(part(5, 8) / (part(1, 4) + 1e-12), 5).alias("ratio"))


@query("q8_band_power", sql(_SPEC +
        ", p AS (SELECT recording_id, w, channel, CASE WHEN f BETWEEN 1 AND 2 THEN 'slow' WHEN f BETWEEN 3 AND 5 THEN 'mid' ELSE 'fast' END AS band, sum(re * "
        "re + im * im) / 16 AS power FROM spec WHERE f > 0 GROUP BY ALL) SELECT recording_id, w, channel, band, round(power, 4) AS power, round(power / "
        "sum(power) OVER (PARTITION BY recording_id, w, channel), 5) AS share FROM p"
    , "windowed@own"))
def _q8(spark, d):  # noqa: ANN001, ANN202
    band = F.when(F.col("f").between(1, 2), "slow").when(F.col("f").between(3, 5), "mid").otherwise("fast")
    p = wn.spectrum(channel_windows(spark, d), CH, 16).filter("f > 0").groupBy(*CH, band.alias("band")).agg((F.sum("power") / 16).alias("power"))
    return p.select(*CH, "band", rounded(F.col("power"), 4).alias("power"), rounded(F.col("power") / F.sum("power").over(W.partitionBy(*CH)), 5).alias("share"))


@query("q9_coherence", sql(_SPEC +
        ", x AS (SELECT a.recording_id, a.channel AS a, b.channel AS b, a.f, sum(a.re * b.re + a.im * b.im) AS re, sum(a.im * b.re - a.re * b.im) AS im, "
        "sum(a.re * a.re + a.im * a.im) AS pa, sum(b.re * b.re + b.im * b.im) AS pb FROM spec a JOIN spec b USING (recording_id, w, f) WHERE a.channel < "
        "b.channel AND a.f > 0 GROUP BY ALL) SELECT recording_id, a, b, CAST(f AS INTEGER) AS f, round((re * re + im * im) / (pa * pb), 5) AS coherence FROM x"
    , "windowed"))
def _q9(spark, d):  # noqa: ANN001, ANN202
    s = wn.spectrum(windowed(spark, d), CH, 16).filter("f > 0")
    a = s.select(*KEY, "f", F.col("channel").alias("a"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = s.select(*KEY, "f", F.col("channel").alias("b"), F.col("re").alias("br"), F.col("im").alias("bi"))
    x = a.join(b, [*KEY, "f"]).filter("a < b").groupBy("recording_id", "a", "b", "f")
    x = x.agg(F.sum(F.expr("ar * br + ai * bi")).alias("re"), F.sum(F.expr("ai * br - ar * bi")).alias("im"), F.sum(F.expr("ar * ar + ai * ai")).alias("pa"), F.sum(F.expr("br * br + bi * bi")).alias("pb"))
    return x.select("recording_id", "a", "b", "f", rounded((F.col("re") ** 2 + F.col("im") ** 2) / (F.col("pa") * F.col("pb")), 5).alias("coherence"))


@query("q10_aperiodic", sql(_SPEC +
        ", p AS (SELECT recording_id, channel, f, avg(re * re + im * im) AS p FROM spec WHERE f > 0 GROUP BY ALL) SELECT recording_id, channel, "
        "round(-regr_slope(log10(p), log10(f)), 5) + 0.0 AS exponent, round(regr_intercept(log10(p), log10(f)), 5) AS offset_, round(regr_r2(log10(p), "
        "log10(f)), 5) AS r2 FROM p GROUP BY ALL"
    , "windowed@own"))
def _q10(spark, d):  # noqa: ANN001, ANN202
    p = wn.spectrum(channel_windows(spark, d), CH, 16).filter("f > 0").groupBy("recording_id", "channel", "f").agg(F.avg("power").alias("p"))
    y, x = F.log10("p"), F.log10("f")
    return p.groupBy("recording_id", "channel").agg(rounded(-F.regr_slope(y, x), 5).alias("exponent"), rounded(F.regr_intercept(y, x), 5).alias("offset_"), rounded(F.regr_r2(y, x), 5).alias("r2"))


@query("q11_permutation_entropy", sql(
        ", l AS (SELECT recording_id, w, channel, v AS a, lead(v) OVER p AS b, lead(v, 2) OVER p AS c FROM windowed WINDOW p AS (PARTITION BY recording_id, w, "
        "channel ORDER BY k)), h AS (SELECT recording_id, w, channel, (CASE WHEN b < a THEN 4 ELSE 0 END) + (CASE WHEN c < a THEN 2 ELSE 0 END) + (CASE WHEN c "
        "< b THEN 1 ELSE 0 END) AS s, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL), q AS (SELECT recording_id, w, channel, n / sum(n) OVER "
        "(PARTITION BY recording_id, w, channel) AS p FROM h) SELECT recording_id, w, channel, round(-sum(p * log2(p)) / log2(6), 6) + 0.0 AS entropy FROM q "
        "GROUP BY ALL"
    , "windowed@own"))
def _q11(spark, d):  # noqa: ANN001, ANN202
    return _r(wn.permutation_entropy(channel_windows(spark, d), CH), CH, "entropy")


@query("q13_rounded_entropy", sql(
        ", h AS (SELECT recording_id, w, channel, round(v, 1) AS bin, count(*) AS n FROM windowed GROUP BY ALL), q AS (SELECT recording_id, w, channel, n / "
        "sum(n) OVER (PARTITION BY recording_id, w, channel) AS p FROM h) SELECT recording_id, w, channel, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM q "
        "GROUP BY ALL"
    , "windowed@own"))
def _q13(spark, d):  # noqa: ANN001, ANN202
    return _r(wn.rounded_entropy(channel_windows(spark, d), CH), CH, "entropy")


@query("q13_binned_entropy", sql(
        ", b AS (SELECT recording_id, w, channel, CASE WHEN max(v) OVER p > min(v) OVER p THEN least(floor((v - min(v) OVER p) / (max(v) OVER p - min(v) OVER "
        "p) * 10), 9) ELSE 0 END AS b FROM windowed WINDOW p AS (PARTITION BY recording_id, w, channel)), h AS (SELECT recording_id, w, channel, b, count(*) "
        "AS n FROM b GROUP BY ALL), q AS (SELECT recording_id, w, channel, n / sum(n) OVER (PARTITION BY recording_id, w, channel) AS p FROM h) SELECT "
        "recording_id, w, channel, round(-sum(p * log2(p)) / log2(10), 6) + 0.0 AS entropy FROM q GROUP BY ALL"
    , "windowed@own"))
def _q13b(spark, d):  # noqa: ANN001, ANN202
    return _r(wn.binned_entropy(channel_windows(spark, d), CH), CH, "entropy")


@query("q14_substring_diversity", sql(
        ", b AS (SELECT recording_id, w, channel, k, CASE WHEN v >= avg(v) OVER (PARTITION BY recording_id, w, channel) THEN '1' ELSE '0' END AS s FROM "
        "windowed), t AS (SELECT recording_id, w, channel, string_agg(s, '' ORDER BY k) AS s FROM b GROUP BY ALL), x AS (SELECT DISTINCT recording_id, w, "
        "channel, s[CAST(i AS INTEGER):CAST(i + l - 1 AS INTEGER)] AS sub FROM t, range(1, 17) a(i), range(1, 5) c(l) WHERE i + l - 1 <= 16) SELECT "
        "recording_id, w, channel, round(count(*) / 16, 6) AS lzc FROM x GROUP BY ALL"
    , "windowed@own"))
def _q14(spark, d):  # noqa: ANN001, ANN202
    return _r(wn.substring_diversity(channel_windows(spark, d), CH), CH, "lzc")


_LEVEL_M = sql(
        ", p AS (SELECT recording_id, w, channel, avg(v * v) AS power FROM windowed GROUP BY ALL), h AS (SELECT recording_id, w, channel, round(v, 1) AS bin, "
        "count(*) AS n FROM windowed GROUP BY ALL), e AS (SELECT recording_id, w, channel, -sum(n / 16 * log2(n / 16)) AS entropy FROM h GROUP BY ALL), j AS "
        "(SELECT *, abs(v - lag(v) OVER (PARTITION BY recording_id, w, channel ORDER BY k)) AS jump FROM windowed), a AS (SELECT recording_id, w, channel, "
        "least(1.0, avg(jump) / (stddev_pop(v) + 1e-6)) AS art FROM j GROUP BY ALL) SELECT recording_id, w, channel, round(power, 2) AS spectral_power_proxy, "
        "round(entropy, 5) + 0.0 AS entropy_proxy, round(art, 5) AS artifact_score, CASE WHEN art >= 0.9 THEN 'artifact' ELSE 'ok' END AS feature_status FROM "
        "p JOIN e USING (recording_id, w, channel) JOIN a USING (recording_id, w, channel)"
    , "windowed@own")


@query("q15_level_m_features", _LEVEL_M)
def _q15(spark, d):  # noqa: ANN001, ANN202
    w = channel_windows(spark, d)
    out = wn.power(w, CH).join(wn.rounded_entropy(w, CH), CH).join(wn.artifact(w, CH), CH)
    return out.select(*CH, rounded_double(F.col("power"), 2).alias("spectral_power_proxy"), rounded(F.col("entropy"), 5).alias("entropy_proxy"), rounded(F.col("artifact_score"), 5).alias("artifact_score"), F.when(F.col("artifact_score") >= 0.9, "artifact").otherwise("ok").alias("feature_status"))


@query("n1_triangle_winding", sql(" SELECT recording_id, w, k, tri_id, round(winding, 6) + 0.0 AS winding FROM winding", "winding"))
def _n1(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.triangle_winding(phase(spark, d), triangle(spark), KEY), [*KEY, "k", "tri_id"], "winding")


@query("n2_amplitude_mask", sql(
        ", f AS (SELECT recording_id, w, k, quantile_cont(amp, 0.1) AS floor FROM phase GROUP BY ALL) SELECT recording_id, w, k, tri_id, round(winding, 6) + "
        "0.0 AS winding FROM winding JOIN f USING (recording_id, w, k) WHERE low > floor"
    , "winding"))
def _n2(spark, d):  # noqa: ANN001, ANN202
    p = phase(spark, d)
    t = pm.triangle_winding(p, triangle(spark), KEY).join(pm.amplitude_floor(p, KEY), [*KEY, "k"]).filter("low > floor")
    return _r(t, [*KEY, "k", "tri_id"], "winding")


_N3 = ", s AS (SELECT recording_id, w, k, round_even(sum(winding), 0) AS q, sum(abs(winding)) AS q_abs, avg(gap) AS phase_grad, count(*) AS n FROM winding GROUP BY ALL)"


@query("n3_sensor_topology", sql(_N3 +
        " SELECT recording_id, w, round_even(median(q), 0) + 0.0 AS q, round(avg(q_abs), 6) AS q_abs, round(avg(phase_grad), 6) AS phase_grad, round(avg(q_abs "
        "/ n), 6) AS defect_density FROM s GROUP BY ALL"
    , "winding"))
def _n3(spark, d):  # noqa: ANN001, ANN202
    s = pm.sensor_topology(pm.triangle_winding(phase(spark, d), triangle(spark), KEY), KEY)
    return s.groupBy(*KEY).agg((F.rint(F.percentile("q", 0.5)) + 0.0).alias("q"), *(rounded(F.avg(c)).alias(c) for c in ("q_abs", "phase_grad", "defect_density")))


@query("n4_defect_map", sql(
        " SELECT recording_id, w, k, tri_id, CAST(sign(round_even(winding, 0)) AS INTEGER) AS chirality, round((s0.x + s1.x + s2.x) / 3, 6) AS cx, round((s0.y "
        "+ s1.y + s2.y) / 3, 6) AS cy FROM winding JOIN triangle USING (tri_id) JOIN sensor s0 ON s0.channel = v0 JOIN sensor s1 ON s1.channel = v1 JOIN "
        "sensor s2 ON s2.channel = v2 WHERE round_even(winding, 0) <> 0"
    , "winding", "sensor"))
def _n4(spark, d):  # noqa: ANN001, ANN202
    corner = triangle(spark).select("tri_id", F.explode(F.array("v0", "v1", "v2")).alias("channel")).join(sensor(spark), "channel").groupBy("tri_id").agg(rounded(F.sum("x") / 3).alias("cx"), rounded(F.sum("y") / 3).alias("cy"))
    t = pm.triangle_winding(phase(spark, d), triangle(spark), KEY).filter(F.rint("winding") != 0)
    return t.join(F.broadcast(corner), "tri_id").select(*KEY, "k", "tri_id", F.signum(F.rint("winding")).cast("int").alias("chirality"), "cx", "cy")


_TR = (
        ", tr AS (SELECT tri_id, CASE WHEN count(*) FILTER (WHERE region = 'left') >= 2 THEN 'left' ELSE 'right' END AS region FROM (SELECT tri_id, "
        "unnest([v0, v1, v2]) AS channel FROM triangle) JOIN sensor USING (channel) GROUP BY tri_id)"
)


@query("n5_region_charge", sql(_TR +
        " SELECT recording_id, w, k, region, round(sum(winding), 6) + 0.0 AS net, round(sum(abs(winding)), 6) AS absolute, count(*) AS n, "
        "round(avg(sign(round_even(winding, 0))), 6) + 0.0 AS chirality FROM winding JOIN tr USING (tri_id) GROUP BY ALL"
    , "winding", "sensor"))
def _n5(spark, d):  # noqa: ANN001, ANN202
    t = pm.triangle_winding(phase(spark, d), triangle(spark), KEY).join(F.broadcast(pm.triangle_regions(triangle(spark), sensor(spark))), "tri_id")
    return t.groupBy(*KEY, "k", "region").agg(rounded(F.sum("winding")).alias("net"), rounded(F.sum(F.abs("winding"))).alias("absolute"), F.count("*").alias("n"), rounded(F.avg(F.signum(F.rint("winding")))).alias("chirality"))


@query("n6_region_time_average", sql(_TR +
        ", s AS (SELECT recording_id, w, k, region, sum(winding) AS net, sum(abs(winding)) AS a FROM winding JOIN tr USING (tri_id) GROUP BY ALL), g AS "
        "(SELECT DISTINCT recording_id, w, k, r.region FROM phase, (VALUES ('left'), ('right')) r(region)) SELECT recording_id, w, region, "
        "round(avg(coalesce(net, 0)), 6) + 0.0 AS net, round(avg(coalesce(a, 0)), 6) AS absolute FROM g LEFT JOIN s USING (recording_id, w, k, region) GROUP "
        "BY ALL"
    , "winding", "sensor"))
def _n6(spark, d):  # noqa: ANN001, ANN202
    p = phase(spark, d)
    t = pm.triangle_winding(p, triangle(spark), KEY).join(F.broadcast(pm.triangle_regions(triangle(spark), sensor(spark))), "tri_id")
    s = t.groupBy(*KEY, "k", "region").agg(F.sum("winding").alias("net"), F.sum(F.abs("winding")).alias("absolute"))
    grid = p.select(*KEY, "k").distinct().withColumn("region", F.explode(F.array(F.lit("left"), F.lit("right"))))
    out = grid.join(s, [*KEY, "k", "region"], "left").groupBy(*KEY, "region")
    return out.agg(rounded(F.avg(F.coalesce("net", F.lit(0.0)))).alias("net"), rounded(F.avg(F.coalesce("absolute", F.lit(0.0)))).alias("absolute"))


_PAIR = " FROM phase a JOIN phase b USING (recording_id, w, k) WHERE a.channel < b.channel GROUP BY ALL"


@query("c1_c3_phase_coupling", sql(
        ", p AS (SELECT a.recording_id, a.w, a.channel AS a, b.channel AS b, avg(cos(b.theta - a.theta)) AS c, avg(sin(b.theta - a.theta)) AS s, "
        "abs(avg(sign(sin(b.theta - a.theta)))) AS pli, avg(abs(sin(b.theta - a.theta))) AS m"
     + _PAIR +
        ") SELECT recording_id, w, a, b, round(sqrt(c * c + s * s), 6) AS plv, round(pli, 6) AS pli, round(CASE WHEN m = 0 THEN 0.0 ELSE abs(s) / m END, 6) AS "
        "wpli FROM p"
    , "phase"))
def _c1(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.phase_coupling(phase(spark, d), KEY), [*KEY, "a", "b"], "plv", "pli", "wpli")


_CORR = ", e AS (SELECT a.recording_id, a.w, a.channel AS a, b.channel AS b, corr(a.v, b.v) AS r FROM windowed a JOIN windowed b USING (recording_id, w, k) WHERE a.channel < b.channel GROUP BY ALL)"


@query("c4_correlation", sql(_CORR + " SELECT recording_id, w, a, b, round(r, 6) + 0.0 AS r FROM e", "windowed"))
def _c4(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.correlation(windowed(spark, d), KEY), [*KEY, "a", "b"], "r")


@query("c4_network_means", sql(_CORR +
        " SELECT recording_id, w, round(avg(r) FILTER (WHERE s.region = t.region), 6) AS within, round(avg(r) FILTER (WHERE s.region <> t.region), 6) AS "
        "between FROM e JOIN sensor s ON s.channel = a JOIN sensor t ON t.channel = b GROUP BY ALL"
    , "windowed", "sensor"))
def _c4b(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.network_means(pm.correlation(windowed(spark, d), KEY), sensor(spark), KEY, "r"), KEY, "within", "between")


_TOP = (
        ", p AS (SELECT a.recording_id, a.w, a.channel AS a, b.channel AS b, round(sqrt(power(avg(cos(b.theta - a.theta)), 2) + power(avg(sin(b.theta - "
        "a.theta)), 2)), 9) AS plv"
 + _PAIR +
        "), g AS (SELECT recording_id, w, a, b FROM (SELECT *, rank() OVER (PARTITION BY recording_id, w ORDER BY plv DESC) AS r, count(*) OVER (PARTITION BY "
        "recording_id, w) AS n FROM p) WHERE r <= greatest(1, floor(0.3 * n)))"
)


def _edges(spark, d):  # noqa: ANN001, ANN202
    return pm.top_edges(pm.phase_coupling(phase(spark, d), KEY).withColumn("plv", F.round("plv", 9)), KEY, "plv", 0.3)


@query("t3_top_edges", sql(_TOP + " SELECT recording_id, w, a, b FROM g", "phase"))
def _t3(spark, d):  # noqa: ANN001, ANN202
    return _edges(spark, d).select(*KEY, "a", "b")


@query("c7_graph_summary", sql(_TOP +
        ", d AS (SELECT recording_id, w, u, count(*) AS d FROM (SELECT recording_id, w, a AS u FROM g UNION ALL SELECT recording_id, w, b FROM g) GROUP BY "
        "ALL), t AS (SELECT recording_id, w, sum(d * (d - 1)) / 2 AS triads, CAST(sum(d) // 2 AS BIGINT) AS n_edges FROM d GROUP BY ALL), x AS (SELECT "
        "x.recording_id, x.w, count(*) AS n FROM g x JOIN g y ON y.recording_id = x.recording_id AND y.w = x.w AND y.a = x.b JOIN g z ON z.recording_id = "
        "x.recording_id AND z.w = x.w AND z.a = x.a AND z.b = y.b GROUP BY ALL) SELECT recording_id, w, n_edges, n_edges / 4 AS mean_degree, CASE WHEN triads "
        "= 0 THEN 0.0 ELSE round(3 * coalesce(n, 0) / triads, 6) END AS transitivity FROM t LEFT JOIN x USING (recording_id, w)"
    , "phase"))
def _c7(spark, d):  # noqa: ANN001, ANN202
    g = pm.graph_summary(_edges(spark, d), KEY, 8)
    return g.select(*KEY, "n_edges", "mean_degree", rounded(F.col("transitivity")).alias("transitivity"))


@query("c8_modularity", sql(_TOP +
        ", e AS (SELECT g.recording_id, g.w, s.region AS ra, t.region AS rb FROM g JOIN sensor s ON s.channel = a JOIN sensor t ON t.channel = b), m AS "
        "(SELECT recording_id, w, count(*) AS m, count(*) FILTER (WHERE ra = rb) AS i FROM e GROUP BY ALL), d AS (SELECT recording_id, w, region, count(*) AS "
        "d FROM (SELECT recording_id, w, ra AS region FROM e UNION ALL SELECT recording_id, w, rb FROM e) GROUP BY ALL), q AS (SELECT recording_id, w, sum(d * "
        "d) AS sq FROM d GROUP BY ALL) SELECT recording_id, w, round(i / m - sq / (4 * m * m), 6) + 0.0 AS modularity FROM m JOIN q USING (recording_id, w)"
    , "phase", "sensor"))
def _c8(spark, d):  # noqa: ANN001, ANN202
    return _r(pm.modularity(_edges(spark, d), sensor(spark), KEY), KEY, "modularity")


@query("c6_connectivity_report", sql(_CORR +
        " SELECT recording_id, w, count(*) AS n_pairs, round(avg(abs(r)), 6) AS mean_abs_r, count(*) FILTER (WHERE abs(r) > 0.5) AS n_strong FROM e GROUP BY "
        "ALL"
    , "windowed"))
def _c6(spark, d):  # noqa: ANN001, ANN202
    r = pm.correlation(windowed(spark, d), KEY)
    return r.groupBy(*KEY).agg(F.count("*").alias("n_pairs"), rounded(F.avg(F.abs("r"))).alias("mean_abs_r"), F.count_if(F.abs("r") > 0.5).alias("n_strong"))


@query("n9_channel_proxies", sql(
        ", m AS (SELECT recording_id, w, channel, avg(v) AS m FROM windowed GROUP BY ALL), r AS (SELECT *, coalesce(lead(m) OVER (PARTITION BY recording_id, w "
        "ORDER BY channel), first(m) OVER (PARTITION BY recording_id, w ORDER BY channel)) - m AS step FROM m), s AS (SELECT recording_id, w, sum(abs(step)) "
        "AS ring FROM r GROUP BY ALL), p AS (SELECT a.recording_id, a.w, avg(abs(a.m - b.m)) AS gap FROM m a JOIN m b USING (recording_id, w) WHERE a.channel "
        "< b.channel GROUP BY ALL) SELECT recording_id, w, round(ring, 6) AS ring, round(gap, 6) AS gap FROM s JOIN p USING (recording_id, w)"
    , "windowed"))
def _n9(spark, d):  # noqa: ANN001, ANN202
    m = windowed(spark, d).groupBy(*KEY, "channel").agg(F.avg("v").alias("m"))
    at = W.partitionBy(*KEY).orderBy("channel")
    ring = m.withColumn("step", F.coalesce(F.lead("m").over(at), F.first("m").over(at)) - F.col("m")).groupBy(*KEY).agg(rounded(F.sum(F.abs("step"))).alias("ring"))
    gap = pm.pairs(m.withColumn("k", F.lit(0)), KEY, value="m").groupBy(*KEY).agg(rounded(F.avg(F.abs(F.col("x") - F.col("y")))).alias("gap"))
    return ring.join(gap, KEY)
