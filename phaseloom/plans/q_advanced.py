"""Queries that need grouped numpy functions, machine learning or iteration, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.operators import phase_metrics as pm
from phaseloom.operators import surrogates as sg
from phaseloom.operators import tracking as tk
from phaseloom.operators import field_topology as ft
from phaseloom.plans.views import channel_windows, field, phase, rounded, sql, table, windowed
from phaseloom.streaming import jobs

QUERIES = {}
KEY = ["recording_id", "w"]


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


@query("v1_time_reverse", sql(" SELECT recording_id, w, channel, 15 - k AS k, v FROM windowed", "windowed@own"))
def _v1(spark, d):  # noqa: ANN001, ANN202
    return sg.time_reverse(channel_windows(spark, d), KEY).select(*KEY, "channel", "k", "v")


@query("v1_channel_shuffle", sql(
        ", n AS (SELECT recording_id, w, channel, row_number() OVER (PARTITION BY recording_id, w ORDER BY sha256('s1|' || recording_id || '|' || w || '|' || "
        "channel)) - 1 AS new FROM (SELECT DISTINCT recording_id, w, channel FROM windowed)) SELECT recording_id, w, new AS channel, k, v FROM windowed JOIN n "
        "USING (recording_id, w, channel)"
    , "windowed"))
def _v1b(spark, d):  # noqa: ANN001, ANN202
    return sg.channel_shuffle(windowed(spark, d), KEY, "s1").select(*KEY, "channel", "k", "v")


@query("v1_phase_randomize")
def _v1c(spark, d):  # noqa: ANN001, ANN202
    return sg.surrogates(channel_windows(spark, d), KEY, 1, "v1")


@query("v2_adjusted_surrogates")
def _v2(spark, d):  # noqa: ANN001, ANN202
    return sg.surrogates(channel_windows(spark, d), KEY, 2, "v2", kind="iaaft")


@query("v3_surrogate_gate")
def _v3(spark, d, count=200):  # noqa: ANN001, ANN202
    return sg.gated(sg.surrogate_metrics(windowed(spark, d), KEY, KEY, count, "v3", lambda x: x.max(axis=1).mean()), KEY)


@query("q1_analytic_signal")
def _q1(spark, d):  # noqa: ANN001, ANN202
    return sg.analytic_signal(channel_windows(spark, d), [*KEY, "channel"], 2, 5)


@query("q14_lempel_ziv")
def _q14(spark, d):  # noqa: ANN001, ANN202
    return sg.lempel_ziv(channel_windows(spark, d), [*KEY, "channel"])


@query("c5_lagged_predictability")
def _c5(spark, d):  # noqa: ANN001, ANN202
    return sg.lagged_predictability(windowed(spark, d), KEY)


@query("c9_c11_graph_shape")
def _c9(spark, d):  # noqa: ANN001, ANN202
    return sg.graph_shape(pm.phase_coupling(phase(spark, d), KEY), KEY, "plv", 0.3, 8)


@query("j9_worldlines")
def _j9(spark, d):  # noqa: ANN001, ANN202
    p = ft.defects(field(spark, d), ["t", "z"]).select("z", "t", F.concat_ws("-", "t", "z", "i", "j").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    return tk.tracks(p, tk.frame_links(p, ["z"], "t", 3.0))


@query("a16_dataset_clusters")
def _a16(spark, d):  # noqa: ANN001, ANN202
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.avg(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    v = VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], outputCol="raw").transform(m)
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=3, seed=7).fit(v).transform(v).select("l_suppkey", F.col("prediction").alias("cluster"))


@query("m10_logistic_decoding")
def _m10(spark, d):  # noqa: ANN001, ANN202
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("size"), F.size(F.split("text", "\n")).alias("lines"), "source")
    docs = docs.join(docs.groupBy("source").agg(F.count("*").alias("peers")), "source")
    x = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    x = VectorAssembler(inputCols=["size", "lines", "peers"], outputCol="features").transform(x)
    parts = []
    for k in range(2):
        fitted = LogisticRegression(maxIter=20, regParam=0.01).fit(x.filter(F.col("fold") != k))
        parts.append(fitted.transform(x.filter(F.col("fold") == k)))
    return parts[0].union(parts[1]).select("doc_id", "fold", "label", rounded(vector_to_array("probability")[1]).alias("score"))


for _name, _job in {
    "st1_sensor_ingest": jobs.sensor_ingest, "st2_idempotent_log": jobs.idempotent_log, "st3_windowed_metrics": jobs.windowed_metrics, "st3_sliding_metrics": jobs.sliding_metrics,
    "st4_sessions": jobs.sessions, "st6_latency": jobs.latency, "st7_backfill": jobs.backfill, "st8_late_records": jobs.late_records,
    "st8_late_side_output": jobs.late_side_output, "st5_trailing_drops": jobs.trailing_drops,
}.items():
    QUERIES[_name] = (_job, jobs.SQL.get(_name))
