"""Queries of clusters, spin tests, states, residual evaluation and the remaining sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import clusters as cl
from phaseloom.operators import evaluation as ev
from phaseloom.operators import field_topology as ft
from phaseloom.operators import nulls as nl
from phaseloom.operators import phase_metrics as pm
from phaseloom.operators import relational as rel
from phaseloom.operators import spatial as sp
from phaseloom.operators import windows as wn
from phaseloom.plans.q_eval import _ASOF, _SCORED, _scored
from phaseloom.plans.q_nulls import betti_sql
from phaseloom.plans.q_signal import _SPEC
from phaseloom.plans.views import channel_windows, field, phase, rounded, sensor, sql, table, windowed
from phaseloom.sources import readers
from phaseloom.streaming import jobs

QUERIES = {}
KEY = ["recording_id", "w"]


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


@query("s4_text_documents",
        "WITH f AS (SELECT source, '# ' || doc_id || chr(10) || coalesce(text, '') || chr(10) AS text FROM documents) SELECT source, sum(len(regexp_extract_all(text, '(?m)^#{1,3}[ \\t]'))) AS n_headings, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
        "bool_and(starts_with(text, '# ')) AS titled FROM f GROUP BY source"
    )
def _s4(spark, d):  # noqa: ANN001, ANN202
    """Every document as a section of a file of its source, up to 100 in a file; the files are read whole."""
    path = jobs._shared(spark, "texts")
    docs = table(spark, d, "documents").select("source", F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    docs.repartition(F.col("source"), F.pmod(F.xxhash64("text"), F.lit(8))).write.partitionBy("source").option("maxRecordsPerFile", 100).text(path)
    t = readers.read_texts(spark, path)
    headings = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,3}[ \t]"), 0))
    return t.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(F.sum(headings).alias("n_headings"), F.sum(F.char_length("text")).cast("long").alias("n_chars"), F.bool_and(F.startswith("text", F.lit("# "))).alias("titled"))


@query("s6_checkpoint_series", sql(" SELECT t, count(*) AS n_cells, round(avg(amp), 6) AS mean_amp FROM field GROUP BY t", "field"))
def _s6(spark, d):  # noqa: ANN001, ANN202
    path = jobs._shared(spark, "field")
    field(spark, d).write.partitionBy("t").parquet(path)
    return spark.read.parquet(path).groupBy("t").agg(F.count("*").alias("n_cells"), rounded(F.avg("amp")).alias("mean_amp"))


@query("s7_sensor_feed", "SELECT event_id, user_id AS sensor_id, value AS q FROM events ORDER BY event_id LIMIT 500")
def _s7(spark, d):  # noqa: ANN001, ANN202
    path = jobs._shared(spark, "sensors")
    table(spark, d, "events").select("event_id", F.col("user_id").alias("sensor_id"), F.col("value").alias("q")).write.json(path)
    return spark.read.schema("event_id long, sensor_id long, q double").json(path).orderBy("event_id").limit(500)


@query("s13_stage_tables", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL")
def _s13(spark, d):  # noqa: ANN001, ANN202
    return readers.checked(table(spark, d, "labels"), ["doc_id", "quality", "toxic"]).select("doc_id", "quality", "toxic").dropna()


@query("j6_best_offset",
        f"WITH {_ASOF}, o AS (SELECT * FROM (VALUES (-60), (-37), (0), (30)) t(o)), c AS (SELECT DISTINCT o, p.event_id FROM p, o, s WHERE s.user_id = "
        f"p.user_id AND abs(s.t - (p.t + o)) <= 600) SELECT CAST(o AS DOUBLE) AS offset_, count(*) AS matched FROM c GROUP BY o"
    )
def _j6(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("s_t"))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", (F.col("t") + 37).alias("t"))
    return rel.best_offset(p, s, ["user_id"], "event_id", "t", "s_t", 600.0, [-60.0, -37.0, 0.0, 30.0]).withColumnRenamed("offset", "offset_")


@query("q7_spectral_phase", sql(_SPEC +
        ", a AS (SELECT recording_id, w, channel, f, atan2(im, re) AS th, re * re + im * im AS p FROM spec WHERE f BETWEEN 1 AND 4) SELECT recording_id, w, "
        "channel, CAST(f AS INTEGER) AS f, round(cos(th - lag(th) OVER (PARTITION BY recording_id, w, channel ORDER BY f)), 5) + 0.0 AS step FROM a"
    , "windowed@own"))
def _q7(spark, d):  # noqa: ANN001, ANN202
    a = wn.spectrum(channel_windows(spark, d), [*KEY, "channel"], 16).filter(F.col("f").between(1, 4)).withColumn("th", F.atan2("im", "re"))
    return a.select(*KEY, "channel", "f", rounded(F.cos(F.col("th") - F.lag("th").over(W.partitionBy(*KEY, "channel").orderBy("f"))), 5).alias("step"))


@query("m8_residual_evaluation",
        f"WITH {_SCORED}, v AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN score ELSE score * 0.6 + 0.2 END AS mt FROM scored), b AS (SELECT count(*) AS n, "
        f"avg(power(score - y, 2)) AS bm, avg(power(mt - y, 2)) AS bt, count(DISTINCT y) AS c FROM v) SELECT n AS n_joined, round(bm, 6) AS brier_m, round(bt, "
        f"6) AS brier_mt, CASE WHEN c < 2 THEN 'blocked: insufficient class variation' WHEN bt >= bm THEN 'blocked: no gain' ELSE 'promoted' END AS "
        f"promotion_reason FROM b"
    )
def _m8(spark, d):  # noqa: ANN001, ANN202
    v = _scored(spark, d).withColumn("mt", F.when(F.col("doc_id") % 2 == 0, F.col("score")).otherwise(F.col("score") * 0.6 + 0.2))
    b = v.agg(F.count("*").alias("n_joined"), ev.brier(F.col("score"), F.col("y")).alias("bm"), ev.brier(F.col("mt"), F.col("y")).alias("bt"), F.countDistinct("y").alias("c"))
    reason = x.first_blocker((F.col("c") < 2, "blocked: insufficient class variation"), (F.col("bt") >= F.col("bm"), "blocked: no gain"), otherwise="promoted")
    return b.select("n_joined", rounded(F.col("bm")).alias("brier_m"), rounded(F.col("bt")).alias("brier_mt"), reason.alias("promotion_reason"))


@query("d9_adapter_readiness",
        "WITH u AS (SELECT source, 'lang' AS col, lang AS v FROM documents UNION ALL SELECT source, 'parity', CAST(doc_id % 2 AS VARCHAR) FROM documents) "
        "SELECT source, col, count(DISTINCT v) AS n_distinct, CASE WHEN count(DISTINCT v) = 2 THEN 'draft' ELSE 'manual' END AS plan FROM u GROUP BY ALL"
    )
def _d9(spark, d):  # noqa: ANN001, ANN202
    u = table(spark, d, "documents").select("source", "lang", (F.col("doc_id") % 2).cast("string").alias("parity")).unpivot(["source"], ["lang", "parity"], "col", "v")
    return u.groupBy("source", "col").agg(F.countDistinct("v").alias("n_distinct"), F.when(F.countDistinct("v") == 2, "draft").otherwise("manual").alias("plan"))


@query("v9_spin_contrast", sql(
        ", m AS (SELECT recording_id, channel, avg(theta) AS v FROM phase GROUP BY ALL), rot AS (SELECT s, channel, cos(s * pi() / 4) * (x - 1.5) - sin(s * "
        "pi() / 4) * (y - 0.5) AS x, sin(s * pi() / 4) * (x - 1.5) + cos(s * pi() / 4) * (y - 0.5) AS y FROM sensor, range(8) r(s)), d AS (SELECT s, "
        "rot.channel, b.region, row_number() OVER (PARTITION BY s, rot.channel ORDER BY round(power(rot.x - (b.x - 1.5), 2) + power(rot.y - (b.y - 0.5), 2), "
        "9), b.channel) AS r FROM rot, sensor b) SELECT recording_id, CAST(s AS INTEGER) AS s, round(avg(v) FILTER (WHERE region = 'left') - avg(v) FILTER "
        "(WHERE region = 'right'), 6) + 0.0 AS contrast FROM m JOIN d USING (channel) WHERE r = 1 GROUP BY ALL"
    , "phase", "sensor"))
def _v9(spark, d):  # noqa: ANN001, ANN202
    m = phase(spark, d).groupBy("recording_id", "channel").agg(F.avg("theta").alias("v"))
    se = sensor(spark)
    angle = F.col("s") * F.pi() / 4
    rot = se.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("s", "channel", (F.cos(angle) * (F.col("x") - 1.5) - F.sin(angle) * (F.col("y") - 0.5)).alias("rx"), (F.sin(angle) * (F.col("x") - 1.5) + F.cos(angle) * (F.col("y") - 0.5)).alias("ry"))
    other = se.select(F.col("channel").alias("o"), (F.col("x") - 1.5).alias("ox"), (F.col("y") - 0.5).alias("oy"), "region")
    dist = F.round((F.col("rx") - F.col("ox")) ** 2 + (F.col("ry") - F.col("oy")) ** 2, 9)
    to = rot.crossJoin(F.broadcast(other)).groupBy("s", "channel").agg(F.min_by("region", F.struct(dist, "o")).alias("region"))  # eight sensors
    j = m.join(F.broadcast(to), "channel")
    mean = lambda r: F.avg(F.when(F.col("region") == r, F.col("v")))
    return j.groupBy("recording_id", "s").agg(rounded(mean("left") - mean("right")).alias("contrast"))


@query("v10_embedding_spread",
        "WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.label, count(*) AS n_pairs, round(avg(list_distance(a.e, "
        "b.e)), 5) AS mean_distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label"
    )
def _v10(spark, d):  # noqa: ANN001, ANN202
    return nl.mean_distance(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "n_pairs", rounded(F.col("mean_distance"), 5).alias("mean_distance"))


@query("g10_betti_numbers", betti_sql([-1.5, 0.0, 1.5]))
def _g10(spark, d):  # noqa: ANN001, ANN202
    return sp.betti_numbers(field(spark, d), ["t", "z"], [-1.5, 0.0, 1.5])


def _points(spark, d):  # noqa: ANN001, ANN202
    p = ft.defects(field(spark, d), ["t", "z"])
    return p.select("z", "t", F.concat_ws("-", "t", "z", "i", "j").alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))


@query(
    "n7_density_clusters",
    sql(
        """, p AS (SELECT z, t, concat_ws('-', t, z, i, j) AS id, i::DOUBLE AS x, j::DOUBLE AS y FROM plaquette WHERE abs(q) > 0.5 AND patch < 0.2),
        near AS (SELECT a.z, a.t, a.id, b.id AS other FROM p a JOIN p b ON a.z = b.z AND a.t = b.t AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 1.5),
        core AS (SELECT z, t, id FROM near GROUP BY ALL HAVING count(*) >= 3), link AS (SELECT n.* FROM near n JOIN core a USING (z, t, id) JOIN core b ON b.z = n.z AND b.t = n.t AND b.id = n.other),
        reach AS (SELECT z, t, id, min(root) AS root FROM (WITH RECURSIVE r AS (SELECT z, t, id, id AS root FROM core UNION SELECT l.z, l.t, l.other AS id, r.root FROM r JOIN link l USING (z, t, id)) SELECT * FROM r) GROUP BY ALL)
        SELECT p.z, p.t, p.id, coalesce(own.root, min(beside.root)) AS cluster FROM p LEFT JOIN reach own USING (z, t, id) LEFT JOIN near n USING (z, t, id) LEFT JOIN reach beside ON beside.z = n.z AND beside.t = n.t AND beside.id = n.other GROUP BY p.z, p.t, p.id, own.root""",
        "plaquette",
    ),
)
def _n7(spark, d):  # noqa: ANN001, ANN202
    return sp.density_clusters(_points(spark, d), ["z", "t"], 1.5, 3)


@query("j15_lineages")
def _j15(spark, d):  # noqa: ANN001, ANN202
    return cl.lineages(_points(spark, d), ["z"], "t", 3.0)


@query("e1_plugged_metric", sql(" SELECT recording_id, w, channel, round(max(v) - min(v), 6) AS value FROM windowed GROUP BY ALL", "windowed@own"))
def _e1(spark, d):  # noqa: ANN001, ANN202
    m = cl.plugged_metric(channel_windows(spark, d), [*KEY, "channel"], "range")
    return m.filter("error is null").select(*KEY, "channel", rounded(F.col("value")).alias("value"))


@query("q4_leading_states")
def _q4(spark, d):  # noqa: ANN001, ANN202
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = phase(spark, d)
    m = p.groupBy(*KEY, "k").agg(F.sum(F.cos("theta") ** 2).alias("cc"), F.sum(F.cos("theta") * F.sin("theta")).alias("cs"), F.sum(F.sin("theta") ** 2).alias("ss"), F.transform(F.array_sort(F.collect_list(F.struct("channel", "theta"))), lambda c: c["theta"]).alias("th"))
    turn = F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2  # the leading vector is cos(theta - turn), up to its sign
    v = m.withColumn("v", F.transform("th", lambda t: F.cos(t - turn)))
    up = F.size(F.filter("v", lambda e: e > 0))
    v = v.withColumn("v", F.when(2 * up > F.size("v"), F.transform("v", lambda e: -e)).otherwise(F.col("v"))).select(*KEY, "k", array_to_vector("v").alias("features"))
    return KMeans(k=3, seed=5).fit(v).transform(v).select(*KEY, "k", F.col("prediction").alias("state"))


@query("w12_microstates")
def _w12(spark, d):  # noqa: ANN001, ANN202
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    g = windowed(spark, d).groupBy(*KEY, "k").agg(F.stddev_pop("v").alias("gfp"), F.transform(F.array_sort(F.collect_list(F.struct("channel", "v"))), lambda c: c["v"]).alias("map"), F.avg("v").alias("m"))
    run = W.partitionBy(*KEY).orderBy("k")
    g = g.withColumn("peak", (F.col("gfp") > F.lag("gfp").over(run)) & (F.col("gfp") > F.lead("gfp").over(run)))
    unit = F.transform("map", lambda v: (v - F.col("m")) / (F.col("gfp") + 1e-12))
    first = F.signum(F.get(unit, F.lit(0)))
    g = g.withColumn("features", array_to_vector(F.transform(unit, lambda v: v * F.when(first == 0, 1.0).otherwise(first))))
    fitted = KMeans(k=4, seed=5).fit(g.filter("peak").select("features"))
    s = fitted.transform(g).select(*KEY, "k", F.col("prediction").alias("state"))
    runs = s.withColumn("run", F.sum((F.col("state") != F.coalesce(F.lag("state").over(run), F.col("state"))).cast("int")).over(run))
    runs = runs.groupBy("recording_id", "w", "state", "run").agg(F.count("*").alias("length"))
    return runs.groupBy("recording_id", "state").agg(F.sum("length").alias("n_samples"), F.count("*").alias("occurrences"), rounded(F.avg("length")).alias("mean_length"))


@query("st5_change_points",
        "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT "
        "user_id, count(*) FILTER (WHERE before IS NOT NULL AND before <> event_type) AS n_changes FROM l GROUP BY user_id"
    )
def _st5(spark, d):  # noqa: ANN001, ANN202
    return jobs.change_points(spark, d)


_ = pm
