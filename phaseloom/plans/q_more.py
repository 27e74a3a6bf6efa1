"""Queries of the sources, of classification rules and of composed reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import complexity as cx
from phaseloom.operators import evaluation as ev
from phaseloom.operators import phase_metrics as pm
from phaseloom.operators import relational as rel
from phaseloom.operators import windows as wn
from phaseloom.plans.q_eval import _COHORT, _META, _cohort, _meta
from phaseloom.plans.views import _wrap, phase, rounded, samples, sql, table, windowed
from phaseloom.sources import readers
from phaseloom.streaming.jobs import _shared

QUERIES = {}
KEY = ["recording_id", "w"]
CH = [*KEY, "channel"]


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


@query("s1_delimited_read", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def _s1(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "csv")
    table(spark, d, "labels").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path, ["doc_id", "quality"], "\t").select("doc_id", "quality", "toxic")


@query("s2_file_discovery")
def _s2(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "files")
    table(spark, d, "documents").select("source", "lang", "text").write.partitionBy("source", "lang").text(path)
    return readers.discover(spark, path, "*.txt", 10_000_000, ["source=src0"]).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "size")


@query("s3_json_lines", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click' AND event_id % 10 <> 0")
def _s3(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "jsonl")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type", "user_id")))
    e.select(line).write.text(path)
    return readers.read_json_lines(spark, path, e.schema).filter("event_type = 'click'")


@query("s3_event_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _s3b(spark, d):  # noqa: ANN001, ANN202
    return readers.tail(table(spark, d, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], 50).select("event_id", "event_type")


@query("s5_file_statistics", "SELECT event_type AS file, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL HAVING count(*) >= 4")
def _s5(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "numbers")
    table(spark, d, "events").select("event_type", "value").repartition("event_type").write.partitionBy("event_type").csv(path)
    v = spark.read.schema("value double, event_type string").csv(path)
    return v.groupBy(F.col("event_type").alias("file")).agg(F.count("value").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_pop("value")).alias("std")).filter("n >= 4")


@query("s8_report_sink", "SELECT c_mktsegment AS segment, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))), '; ') AS nations FROM customer GROUP BY ALL")
def _s8(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "report")
    r = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))).alias("nations"))
    readers.write_report(r, path)
    return readers.read_delimited(spark, path, ["segment", "n", "nations"]).withColumn("n", F.col("n").try_cast("long"))


@query("s11_markdown_export", "SELECT p_partkey AS title, '# ' || p_partkey || chr(10) || '- p_name: ' || coalesce(p_name, 'n/a') || chr(10) || '- p_size: ' || p_size AS markdown FROM part")
def _s11(spark, d):  # noqa: ANN001, ANN202
    return readers.as_markdown(table(spark, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("s12_subject_merge", "SELECT o_custkey AS subject, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def _s12(spark, d):  # noqa: ANN001, ANN202
    path = _shared(spark, "subjects")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    o.groupBy("subject").agg(F.collect_list(F.struct("status", "n")).alias("cells")).write.json(path)
    j = spark.read.schema("subject long, cells array<struct<status: string, n: long>>").json(path)
    return j.select("subject", F.explode("cells").alias("c")).select("subject", "c.status", "c.n")


@query("p3_label_targets",
        f"WITH {_META} SELECT doc_id, value, CASE WHEN value = 1 THEN 'positive' WHEN value = 0 THEN 'negative' ELSE 'unknown' END AS status, CASE WHEN value "
        f"IN (0, 1) THEN CAST(value AS INTEGER) END AS y FROM (SELECT doc_id, CAST(value AS INTEGER) AS value FROM meta)"
    )
def _p3(spark, d):  # noqa: ANN001, ANN202
    v = F.col("value")
    return _meta(spark, d).select("doc_id", "value", F.when(v == 1, "positive").when(v == 0, "negative").otherwise("unknown").alias("status"), F.when(v.isin(0, 1), v).alias("y"))


@query("p4_skip_and_report",
        "SELECT event_id, CASE WHEN value < 5 THEN 'skipped: low' WHEN user_id % 11 = 0 THEN 'skipped: user' ELSE 'ok' END AS status, CASE WHEN value >= 5 AND "
        "user_id % 11 <> 0 THEN value END AS value FROM events"
    )
def _p4(spark, d):  # noqa: ANN001, ANN202
    status = x.first_blocker((F.col("value") < 5, "skipped: low"), (F.col("user_id") % 11 == 0, "skipped: user"), otherwise="ok")
    return table(spark, d, "events").select("event_id", status.alias("status"), F.when(status == "ok", F.col("value")).alias("value"))


@query("p5_band_eligibility",
        "WITH b AS (SELECT * FROM (VALUES ('delta', 1.0, 2.0), ('theta', 2.0, 4.0), ('alpha', 4.0, 7.0), ('beta', 7.0, 12.0)) t(band, lo, hi)), r AS (SELECT "
        "event_type AS recording_id, 8.0 + 4 * (length(event_type) % 3) AS sfreq FROM events GROUP BY ALL) SELECT recording_id, band, hi < sfreq / 2 AS "
        "eligible FROM r, b"
    )
def _p5(spark, d):  # noqa: ANN001, ANN202
    b = spark.createDataFrame([("delta", 1.0, 2.0), ("theta", 2.0, 4.0), ("alpha", 4.0, 7.0), ("beta", 7.0, 12.0)], "band string, lo double, hi double")
    r = table(spark, d, "events").select(F.col("event_type").alias("recording_id")).distinct().withColumn("sfreq", 8.0 + 4 * (F.length("recording_id") % 3))
    return r.crossJoin(F.broadcast(b)).select("recording_id", "band", (F.col("hi") < F.col("sfreq") / 2).alias("eligible"))


@query("p6_channel_zones",
        "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '(1|3)$') THEN 'front' WHEN regexp_matches(n_name, '^[A-H]') THEN 'left' WHEN "
        "regexp_matches(n_name, '[02468]$') THEN 'back' ELSE 'other' END AS zone FROM nation"
    )
def _p6(spark, d):  # noqa: ANN001, ANN202
    z = F.when(F.rlike("n_name", F.lit("(1|3)$")), "front").when(F.rlike("n_name", F.lit("^[A-H]")), "left").when(F.rlike("n_name", F.lit("[02468]$")), "back").otherwise("other")
    return table(spark, d, "nation").select("n_nationkey", z.alias("zone"))


@query("p7_lenient_numbers",
        "SELECT event_id, TRY_CAST(nullif(trim(CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN 'n/a' ELSE ' ' || user_id || ' ' END), '') AS "
        "DOUBLE) AS v FROM events"
    )
def _p7(spark, d):  # noqa: ANN001, ANN202
    cell = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", x.number(cell).alias("v"))


@query("p8_default_fields",
        "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE ' ' || p_name END), ''), 'untitled') AS title, coalesce(CASE WHEN "
        "p_size % 3 = 0 THEN NULL ELSE p_size END, 0) AS year FROM part"
    )
def _p8(spark, d):  # noqa: ANN001, ANN202
    t = F.trim(F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(t, F.lit("")), F.lit("untitled")).alias("title"), F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size")).alias("year"))


@query("p12_lookup_action",
        "WITH l AS (SELECT * FROM (VALUES ('BUILDING', 'merge'), ('FURNITURE', 'review'), ('MACHINERY', 'close')) t(segment, action)) SELECT c_custkey, CASE "
        "WHEN c_acctbal < 0 THEN 'stale' ELSE coalesce(action, 'unknown') END AS action FROM customer LEFT JOIN l ON segment = c_mktsegment"
    )
def _p12(spark, d):  # noqa: ANN001, ANN202
    look = spark.createDataFrame([("BUILDING", "merge"), ("FURNITURE", "review"), ("MACHINERY", "close")], "c_mktsegment string, action string")
    c = table(spark, d, "customer").join(F.broadcast(look), "c_mktsegment", "left")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "stale").otherwise(F.coalesce("action", F.lit("unknown"))).alias("action"))


@query("p14_candidate_tags",
        "SELECT page_id, array_to_string(list_filter([CASE WHEN url LIKE '%page=%' THEN 'paged' END, CASE WHEN url LIKE '%/en/%' THEN 'english' END, CASE WHEN "
        "length(html) > 5000 THEN 'long' END], lambda t: t IS NOT NULL), ',') AS tags FROM pages"
    )
def _p14(spark, d):  # noqa: ANN001, ANN202
    tags = x.all_blockers((F.contains("url", F.lit("page=")), "paged"), (F.contains("url", F.lit("/en/")), "english"), (F.char_length("html") > 5000, "long"))
    return table(spark, d, "pages").select("page_id", F.array_join(tags, ",").alias("tags"))


@query("a1_tolerant_means",
        "SELECT 'supplier' AS dataset, n_regionkey AS domain, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP "
        "BY ALL UNION ALL SELECT 'customer', n_regionkey, round(avg(c_acctbal), 4) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"
    )
def _a1(spark, d):  # noqa: ANN001, ANN202
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("dataset"), F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("dataset"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    u = s.unionByName(c, allowMissingColumns=True).join(F.broadcast(table(spark, d, "nation")), "n_nationkey")
    return u.groupBy("dataset", F.col("n_regionkey").alias("domain")).agg(rounded(F.avg("balance"), 4).alias("balance")).dropna()


@query("a15_contract_report",
        f"WITH {_META} SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_subjects, count(*) FILTER (WHERE value = 1) AS n_positive, count(*) FILTER (WHERE "
        f"value = 0) AS n_negative, count(*) FILTER (WHERE value NOT IN (0, 1)) AS n_unknown FROM meta"
    )
def _a15(spark, d):  # noqa: ANN001, ANN202
    v = F.col("value")
    return _meta(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_subjects"), F.count_if(v == 1).alias("n_positive"), F.count_if(v == 0).alias("n_negative"), F.count_if(~v.isin(0, 1)).alias("n_unknown"))


@query("a19_parcel_series", sql(
        ", r AS (SELECT recording_id, n, CASE WHEN channel % 4 < 2 THEN 'left' ELSE 'right' END AS region, avg(v) AS m FROM samples GROUP BY ALL) SELECT "
        "recording_id, region, n, round((m - avg(m) OVER p) / stddev_pop(m) OVER p, 5) + 0.0 AS z FROM r WINDOW p AS (PARTITION BY recording_id, region)"
    , "samples"))
def _a19(spark, d):  # noqa: ANN001, ANN202
    r = samples(spark, d).groupBy("recording_id", "n", F.when(F.col("channel") % 4 < 2, "left").otherwise("right").alias("region")).agg(F.avg("v").alias("m"))
    return r.select("recording_id", "region", "n", rounded(wn.znorm("m", ["recording_id", "region"]), 5).alias("z"))


@query("t6_stable_sort", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def _t6(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "part").orderBy("p_brand", F.desc("p_size"), "p_partkey").select("p_partkey", "p_brand", "p_size")


@query("f2_excess_ratios",
        "SELECT p_partkey, round((p_size + 10 - abs(p_size - 25)) / (abs(p_size - 25) + 1e-12), 0) AS ratio, round((p_size + 10 - abs(p_size - 25)) / (p_size "
        "+ 10), 6) AS share FROM part"
    )
def _f2(spark, d):  # noqa: ANN001, ANN202
    a, n = (F.col("p_size") + 10).cast("double"), (F.col("p_size") - 25).cast("double")
    return table(spark, d, "part").select("p_partkey", rounded(x.excess_winding(a, n), 0).alias("ratio"), rounded(x.excess_share(a, n)).alias("share"))


@query("f5_replay_hash", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS replay_hash FROM events""")
def _f5(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("replay_hash"))


@query("f6_collapsed_text", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents")
def _f6(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").select("doc_id", F.sha2(x.collapse(F.col("text")), 256).alias("h"))


@query("f10_sensor_payload",
        "SELECT event_id, round((value + (value - 10) + (value - 20)) / (2 * pi()), 6) + 0.0 AS q, round((abs(value) + abs(value - 10) + abs(value - 20)) / (2 "
        "* pi()), 6) AS q_abs FROM events"
    )
def _f10(spark, d):  # noqa: ANN001, ANN202
    payload = F.to_json(F.struct(F.array(F.col("value"), F.col("value") - 10, F.col("value") - 20).alias("phase_deltas")))
    e = table(spark, d, "events").select("event_id", F.from_json(payload, "phase_deltas array<double>").alias("p"))
    total = lambda f: F.aggregate("p.phase_deltas", F.lit(0.0), lambda a, v: a + f(v)) / x.TAU
    return e.select("event_id", rounded(total(lambda v: v)).alias("q"), rounded(total(F.abs)).alias("q_abs"))


@query("f11_paths_and_times", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages")
def _f11(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query("f13_ring_sum", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - embedding[i % len(embedding) + 1]::DOUBLE))), 4) AS ring FROM embeddings")
def _f13(spark, d):  # noqa: ANN001, ANN202
    after = F.concat(F.slice("embedding", 2, F.size("embedding")), F.slice("embedding", 1, 1))
    steps = F.zip_with("embedding", after, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", rounded(F.aggregate(steps, F.lit(0.0), lambda t, v: t + v), 4).alias("ring"))


@query("f15_nearest_bin", "SELECT event_id, CAST(floor(value / 10 + 0.5) AS BIGINT) AS bin, floor(value / 10 + 0.5) * 10 AS centre FROM events")
def _f15(spark, d):  # noqa: ANN001, ANN202
    b = F.floor(F.col("value") / 10 + 0.5)
    return table(spark, d, "events").select("event_id", b.alias("bin"), (b * 10).cast("double").alias("centre"))


_PROBES = "pr AS (SELECT user_id, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase')"


@query("j16_probe_epochs",
        f"WITH {_PROBES} SELECT pr.user_id, round(pr.t, 3) AS probe_t, count(e.event_id) AS n, round(avg(e.value), 6) AS mean_v FROM pr LEFT JOIN events e ON "
        f"e.user_id = pr.user_id AND e.event_type = 'click' AND epoch(e.ts) > pr.p AND epoch(e.ts) <= pr.t WHERE pr.p IS NOT NULL AND pr.t - pr.p >= 1 GROUP BY "
        f"ALL"
    )
def _j16(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    pr, clicks = rel.probe_epochs(e, "user_id", "t", F.col("event_type") == "purchase", F.col("event_type") == "click", "event_id", "value")
    out = pr.join(clicks, "event_id", "left").groupBy("user_id", rounded(F.col("t"), 3).alias("probe_t"))
    return out.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), rounded(F.sum("total") / F.sum("n")).alias("mean_v"))


@query("v7_metric_report",
        f"WITH {_COHORT}, u AS (SELECT 'total' AS metric, segment, value AS v FROM cohort UNION ALL SELECT 'cents', segment, value % 100 FROM cohort), g AS "
        f"(SELECT metric, segment, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM u WHERE segment IN ('BUILDING', 'FURNITURE') GROUP BY ALL) SELECT "
        f"a.metric, round(a.m - b.m, 4) AS difference, round((a.m - b.m) / (sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)) + 1e-12), 6) AS d FROM "
        f"g a JOIN g b USING (metric) WHERE a.segment = 'BUILDING' AND b.segment = 'FURNITURE'"
    )
def _v7(spark, d):  # noqa: ANN001, ANN202
    c = _cohort(spark, d).select("segment", F.col("value").alias("total"), (F.col("value") % 100).alias("cents")).unpivot(["segment"], ["total", "cents"], "metric", "v")
    mean = lambda s: F.avg(F.when(F.col("segment") == s, F.col("v")))
    diff = c.groupBy("metric").agg(rounded(mean("BUILDING") - mean("FURNITURE"), 4).alias("difference"))
    return diff.join(ev.cohens_d(c, ["metric"], "v", "segment", "BUILDING", "FURNITURE").select("metric", rounded(F.col("d")).alias("d")), "metric")


@query("v11_trial_contrast",
        "WITH e AS (SELECT user_id % 2 AS cond, epoch(ts) / 3600 AS t FROM events WHERE event_type = 'purchase'), m AS (SELECT DISTINCT cond, "
        "unnest(range(CAST(ceil(t + 1) AS BIGINT), CAST(floor(t + 3) AS BIGINT) + 1)) AS tr FROM e), k AS (SELECT tr, min(cond) AS cond FROM m GROUP BY tr "
        "HAVING count(DISTINCT cond) = 1), s AS (SELECT event_type AS parcel, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tr, value FROM events) SELECT parcel, "
        "round(avg(value) FILTER (WHERE cond = 1) - avg(value) FILTER (WHERE cond = 0), 6) AS contrast FROM s JOIN k USING (tr) GROUP BY parcel"
    )
def _v11(spark, d):  # noqa: ANN001, ANN202
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    e = table(spark, d, "events")
    masks = rel.interval_masks(e.filter("event_type = 'purchase'").select((F.col("user_id") % 2).alias("cond"), hours.alias("t")), "t", "cond", 1, 3).filter("cond is not null")
    s = e.select(F.col("event_type").alias("parcel"), F.floor(hours).alias("tr"), "value").join(masks, "tr")
    mean = lambda c: F.avg(F.when(F.col("cond") == c, F.col("value")))
    return s.groupBy("parcel").agg(rounded(mean(1) - mean(0)).alias("contrast"))


@query("g13_channel_grid", sql(
        ", m AS (SELECT recording_id, w, channel, avg(theta) AS theta FROM phase GROUP BY ALL), g AS (SELECT recording_id, w, c // 3 AS i, c % 3 AS j, c FROM "
        "(SELECT DISTINCT recording_id, w FROM phase), range(9) r(c)) SELECT recording_id, w, i, j, round(coalesce(theta, 0), 6) + 0.0 AS theta FROM g LEFT "
        "JOIN m USING (recording_id, w) WHERE m.channel = g.c OR (g.c >= 8 AND m.channel = 0) "
    , "phase").replace("WHERE m.channel = g.c OR (g.c >= 8 AND m.channel = 0) ", "").replace("LEFT JOIN m USING (recording_id, w)", "LEFT JOIN m ON m.recording_id = g.recording_id AND m.w = g.w AND m.channel = g.c").replace("SELECT recording_id, w, i, j, round", "SELECT g.recording_id, g.w, i, j, round"))
def _g13(spark, d):  # noqa: ANN001, ANN202
    m = phase(spark, d).groupBy(*KEY, F.col("channel").alias("c")).agg(F.avg("theta").alias("theta"))
    g = m.select(*KEY).distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")))
    return g.join(m, [*KEY, "c"], "left").select(*KEY, F.floor(F.col("c") / 3).alias("i"), (F.col("c") % 3).alias("j"), rounded(F.coalesce("theta", F.lit(0.0))).alias("theta"))


@query("q17_tall_metrics", sql(
        ", r AS (SELECT recording_id, w, k, sqrt(power(avg(cos(theta)), 2) + power(avg(sin(theta)), 2)) AS r FROM phase GROUP BY ALL), s AS (SELECT "
        "recording_id, w, channel, "
     + _wrap("lead(theta) OVER (PARTITION BY recording_id, w, k ORDER BY channel) - theta") +
        " AS d FROM phase) SELECT recording_id, w, 'kuramoto' AS metric_kind, round(avg(r), 6) AS value FROM r GROUP BY ALL UNION ALL SELECT recording_id, w, "
        "'phase_grad', round(avg(abs(d)), 6) FROM s WHERE d IS NOT NULL GROUP BY ALL"
    , "phase"))
def _q17(spark, d):  # noqa: ANN001, ANN202
    p = phase(spark, d)
    a = pm.kuramoto(p, KEY).select(*KEY, F.lit("kuramoto").alias("metric_kind"), rounded(F.col("r_mean")).alias("value"))
    return a.unionByName(pm.channel_gradient(p, KEY).select(*KEY, F.lit("phase_grad").alias("metric_kind"), rounded(F.col("phase_grad")).alias("value")))


@query("q12_detrended_fluctuation", sql(
        ", c AS (SELECT recording_id, channel, n, sum(v - m) OVER (PARTITION BY recording_id, channel ORDER BY n ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT "
        "*, avg(v) OVER (PARTITION BY recording_id, channel) AS m FROM samples)), b AS (SELECT recording_id, channel, s, n // s AS box, count(*) AS k, "
        "regr_syy(y, n) - CASE WHEN regr_sxx(y, n) = 0 THEN 0 ELSE power(regr_sxy(y, n), 2) / regr_sxx(y, n) END AS rss FROM c, (VALUES (4), (8), (16), (32)) "
        "t(s) GROUP BY ALL HAVING count(*) = s), f AS (SELECT recording_id, channel, s, sqrt(sum(rss) / sum(k)) AS f FROM b GROUP BY ALL) SELECT recording_id, "
        "channel, round(regr_slope(ln(f), ln(s)), 4) AS alpha FROM f GROUP BY ALL"
    , "samples"))
def _q12(spark, d):  # noqa: ANN001, ANN202
    c = cx.profile(samples(spark, d), ["recording_id", "channel"], "n", "v")
    c = c.withColumn("s", F.explode(F.array(*[F.lit(s) for s in (4, 8, 16, 32)]))).withColumn("box", F.floor(F.col("n") / F.col("s")))
    rss = F.regr_syy("y", "n") - F.when(F.regr_sxx("y", "n") == 0, 0.0).otherwise(F.regr_sxy("y", "n") ** 2 / F.regr_sxx("y", "n"))
    b = c.groupBy("recording_id", "channel", "s", "box").agg(F.count("*").alias("k"), rss.alias("rss")).filter("k = s")
    f = b.groupBy("recording_id", "channel", "s").agg(F.sqrt(F.sum("rss") / F.sum("k")).alias("f"))
    return f.groupBy("recording_id", "channel").agg(rounded(F.regr_slope(F.ln("f"), F.ln("s")), 4).alias("alpha"))


@query("c12_cohort_records", sql(
        ", e AS (SELECT a.recording_id, a.w, corr(a.v, b.v) AS r FROM windowed a JOIN windowed b USING (recording_id, w, k) WHERE a.channel < b.channel GROUP "
        "BY a.recording_id, a.w, a.channel, b.channel), x AS (SELECT recording_id, count(*) AS n_pairs, count(DISTINCT w) AS n_windows, avg(abs(r)) AS m FROM "
        "e GROUP BY ALL) SELECT recording_id, n_windows, n_pairs, round(m, 6) AS mean_abs_r, CASE WHEN n_windows < 13 THEN 'error: too few windows' ELSE 'ok' "
        "END AS status FROM x"
    , "windowed"))
def _c12(spark, d):  # noqa: ANN001, ANN202
    e = pm.correlation(windowed(spark, d), KEY)
    g = e.groupBy("recording_id").agg(F.countDistinct("w").alias("n_windows"), F.count("*").alias("n_pairs"), rounded(F.avg(F.abs("r"))).alias("mean_abs_r"))
    return g.withColumn("status", F.when(F.col("n_windows") < 13, "error: too few windows").otherwise("ok"))
