"""Queries of the evaluation, statistics, relational and join operators."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import evaluation as ev
from phaseloom.operators import relational as rel
from phaseloom.operators import spatial as sp
from phaseloom.plans.views import rounded, sql, table

QUERIES = {}


def query(name: str, statement: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


_SCORED = "scored AS (SELECT d.doc_id, d.source, (d.n_chars % 101) / 100 AS score, l.quality AS y FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents").select("doc_id", "source", ((F.col("n_chars") % 101) / 100).alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_AUC = "(SELECT CASE WHEN count(*) FILTER (WHERE y = 1) = 0 OR count(*) FILTER (WHERE y = 0) = 0 THEN 0.5 END FROM s)"


@query("m1_auc",
        f"WITH {_SCORED} SELECT p.source, round(CASE WHEN n IS NULL THEN 0.5 ELSE won / n END, 6) AS auc FROM (SELECT DISTINCT source FROM scored) p LEFT JOIN "
        f"(SELECT a.source, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS won, count(*) AS n FROM scored a JOIN "
        f"scored b ON a.source = b.source WHERE a.y = 1 AND b.y = 0 GROUP BY a.source) q USING (source)"
    )
def _m1(spark, d):  # noqa: ANN001, ANN202
    return ev.auc(_scored(spark, d), ["source"]).select("source", rounded(F.col("auc")).alias("auc"))


@query("m2_brier", f"WITH {_SCORED} SELECT source, round(avg(power(score - y, 2)), 6) AS brier FROM scored GROUP BY source")
def _m2(spark, d):  # noqa: ANN001, ANN202
    return _scored(spark, d).groupBy("source").agg(rounded(ev.brier(F.col("score"), F.col("y"))).alias("brier"))


@query("m3_ece",
        f"WITH {_SCORED}, b AS (SELECT source, least(floor(score * 5), 4) AS bin, count(*) AS n, avg(score) AS conf, avg(y) AS acc FROM scored GROUP BY ALL) "
        f"SELECT source, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b GROUP BY source"
    )
def _m3(spark, d):  # noqa: ANN001, ANN202
    return ev.ece(_scored(spark, d), ["source"]).select("source", rounded(F.col("ece")).alias("ece"))


_PART_FEATURES = (
        "f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 50 END AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 2000 "
        "END AS b, p_partkey % 13 / 10 AS art, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 17 / 12 END AS q_abs, p_partkey % 3 / 4 AS f_dress FROM "
        "part)"
)


def _features(spark, d):  # noqa: ANN001, ANN202
    p = table(spark, d, "part")
    c = F.col
    return p.select("p_partkey", F.when(c("p_size") % 7 == 0, None).otherwise(c("p_size") / 50).alias("a"), F.when(c("p_size") % 5 == 0, None).otherwise(c("p_retailprice") / 2000).alias("b"), (c("p_partkey") % 13 / 10).alias("art"), F.when(c("p_partkey") % 11 == 0, None).otherwise(c("p_partkey") % 17 / 12).alias("q_abs"), (c("p_partkey") % 3 / 4).alias("f_dress"))


@query("m4_scores",
        f"WITH {_PART_FEATURES}, m AS (SELECT *, greatest(0, least(1, coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT "
        f"NULL)::INT, 0), 0.5) * (1 - least(art, 1) * 0.3))) AS m FROM f) SELECT p_partkey, round(m, 9) AS m_score, round(greatest(0, least(1, m * 0.6 + 0.4 * "
        f"(CASE WHEN q_abs IS NULL THEN 0 ELSE least(q_abs, 1) END + least(f_dress, 1)) / (1 + (q_abs IS NOT NULL)::INT))), 9) AS mt_score FROM m"
    )
def _m4(spark, d):  # noqa: ANN001, ANN202
    m = _features(spark, d).withColumn("m", ev.m_score([F.col("a"), F.col("b")], F.col("art")))
    return m.select("p_partkey", rounded(F.col("m"), 9).alias("m_score"), rounded(ev.mt_score(F.col("m"), F.col("q_abs"), F.col("f_dress"), F.lit(None).cast("double")), 9).alias("mt_score"))


@query("m5_metrics",
        f"WITH {_SCORED}, v AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN score ELSE score * 0.6 + 0.2 END AS mt FROM scored), w AS (SELECT source, count(*) AS "
        f"n, count(DISTINCT y) AS classes, avg(power(score - y, 2)) AS bm, avg(power(mt - y, 2)) AS bt FROM v GROUP BY source) SELECT source, n AS n_rows, CASE "
        f"WHEN classes = 2 THEN 'ok' ELSE 'blocked: insufficient class variation' END AS state, CASE WHEN classes = 2 THEN round(bm, 6) END AS brier_m, CASE "
        f"WHEN classes = 2 THEN round(bt, 6) END AS brier_mt FROM w"
    )
def _m5(spark, d):  # noqa: ANN001, ANN202
    v = _scored(spark, d).withColumn("mt", F.when(F.col("doc_id") % 2 == 0, F.col("score")).otherwise(F.col("score") * 0.6 + 0.2))
    w = v.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("y").alias("classes"), ev.brier(F.col("score"), F.col("y")).alias("bm"), ev.brier(F.col("mt"), F.col("y")).alias("bt"))
    both = F.col("classes") == 2
    return w.select("source", "n_rows", F.when(both, "ok").otherwise("blocked: insufficient class variation").alias("state"), F.when(both, rounded(F.col("bm"))).alias("brier_m"), F.when(both, rounded(F.col("bt"))).alias("brier_mt"))


@query("m6_ablations",
        f"WITH {_SCORED}, a AS (SELECT * FROM (VALUES ('full', 1.0, 0.0), ('half', 0.5, 0.25), ('flat', 0.0, 0.5)) t(ablation, k, c)), s AS (SELECT ablation, "
        f"score * CAST(k AS DOUBLE) + CAST(c AS DOUBLE) AS score, y FROM scored, a) SELECT ablation, count(*) AS n, round(avg(power(score - y, 2)), 6) AS "
        f"brier, round((SELECT sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / count(*) FROM s p, s q WHERE p.y = 1 "
        f"AND q.y = 0 AND p.ablation = s.ablation AND q.ablation = s.ablation), 6) AS auc FROM s GROUP BY ablation"
    )
def _m6(spark, d):  # noqa: ANN001, ANN202
    a = spark.createDataFrame([("full", 1.0, 0.0), ("half", 0.5, 0.25), ("flat", 0.0, 0.5)], "ablation string, k double, c double")
    s = _scored(spark, d).crossJoin(F.broadcast(a)).withColumn("score", F.col("score") * F.col("k") + F.col("c"))
    b = s.groupBy("ablation").agg(F.count("*").alias("n"), rounded(ev.brier(F.col("score"), F.col("y"))).alias("brier"))
    return b.join(ev.auc(s, ["ablation"]).select("ablation", rounded(F.col("auc")).alias("auc")), "ablation")


@query("m7_reversed_null",
        f"WITH {_SCORED}, r AS (SELECT source, score, y, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY source "
        f"ORDER BY doc_id DESC) AS j FROM scored), n AS (SELECT a.source, a.score, b.y FROM r a JOIN r b ON a.source = b.source AND a.i = b.j) SELECT source, "
        f"round(avg(power(score - y, 2)), 6) AS null_brier FROM n GROUP BY source"
    )
def _m7(spark, d):  # noqa: ANN001, ANN202
    by = W.partitionBy("source")
    r = _scored(spark, d).withColumn("i", F.row_number().over(by.orderBy("doc_id"))).withColumn("j", F.row_number().over(by.orderBy(F.desc("doc_id"))))
    n = r.select("source", "score", "i").join(r.select("source", "y", F.col("j").alias("i")), ["source", "i"])
    return n.groupBy("source").agg(rounded(ev.brier(F.col("score"), F.col("y"))).alias("null_brier"))


@query("m9_contrasts",
        f"WITH {_SCORED}, c AS (SELECT * FROM (VALUES ('even', 0), ('odd', 1)) t(contrast, bit)) SELECT contrast, source, count(*) AS n, round(avg(power(score "
        f"- y, 2)), 6) AS brier, round(avg(y), 6) AS base_rate FROM scored JOIN c ON doc_id % 2 = bit GROUP BY ALL"
    )
def _m9(spark, d):  # noqa: ANN001, ANN202
    c = spark.createDataFrame([("even", 0), ("odd", 1)], "contrast string, bit int")
    s = _scored(spark, d).withColumn("bit", (F.col("doc_id") % 2).cast("int")).join(F.broadcast(c), "bit")
    return s.groupBy("contrast", "source").agg(F.count("*").alias("n"), rounded(ev.brier(F.col("score"), F.col("y"))).alias("brier"), rounded(F.avg("y")).alias("base_rate"))


_COHORT = "cohort AS (SELECT c_custkey AS subject, c_mktsegment AS segment, o_orderkey, o_orderstatus AS status, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"


def _cohort(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment")), "subject")


@query("a2_subject_cells", f"WITH {_COHORT} SELECT subject, status, round(avg(value), 6) AS mean_value, round(median(value), 4) AS median_value FROM cohort GROUP BY ALL")
def _a2(spark, d):  # noqa: ANN001, ANN202
    return _cohort(spark, d).groupBy("subject", "status").agg(rounded(F.avg("value"), 6).alias("mean_value"), rounded(F.percentile("value", 0.5), 4).alias("median_value"))


@query("a3_status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large FROM orders GROUP BY ALL")
def _a3(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a4_metric_summary", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, l_returnflag AS flag, {m} AS v FROM lineitem" for m in _METRICS) +
        ") SELECT metric, flag, count(*) AS n, round(avg(v), 4) AS mean_v, round(stddev_pop(v), 4) AS std_v, min(v) AS min_v, max(v) AS max_v FROM u GROUP BY "
        "ALL"
    )
def _a4(spark, d):  # noqa: ANN001, ANN202
    return rel.metric_summary(table(spark, d, "lineitem"), ["l_returnflag"], _METRICS).withColumnRenamed("l_returnflag", "flag").select("metric", "flag", "n", rounded(F.col("mean_v"), 4).alias("mean_v"), rounded(F.col("std_v"), 4).alias("std_v"), "min_v", "max_v")


@query("a5_leakage_report",
        f"WITH {_COHORT} SELECT status, count(*) AS n_rows, count(DISTINCT subject) AS n_subjects, count(*) = count(DISTINCT o_orderkey) AS unique_rows FROM "
        f"cohort GROUP BY status"
    )
def _a5(spark, d):  # noqa: ANN001, ANN202
    return _cohort(spark, d).groupBy("status").agg(F.count("*").alias("n_rows"), F.countDistinct("subject").alias("n_subjects"), (F.count("*") == F.countDistinct("o_orderkey")).alias("unique_rows"))


@query("a6_quality_report",
        "SELECT l_shipdate::DATE AS day, count(*) AS n, round(avg(l_discount), 6) AS mean_score, max(l_discount) AS max_score, count(*) FILTER (WHERE "
        "l_discount >= 0.08) AS n_high, count(*) FILTER (WHERE l_discount >= 0.08) > 0.5 * count(*) AS dominated FROM lineitem GROUP BY ALL"
    )
def _a6(spark, d):  # noqa: ANN001, ANN202
    high = F.count_if(F.col("l_discount") >= 0.08)
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), rounded(F.avg("l_discount")).alias("mean_score"), F.max("l_discount").alias("max_score"), high.alias("n_high"), (high > 0.5 * F.count("*")).alias("dominated"))


_PROFILE = ["lang", "source", "doc_id"]


@query("a7_column_profile", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM documents" for c in _PROFILE) +
        ") SELECT col, count(*) AS n, count(*) FILTER (WHERE trim(v) <> '') AS n_filled, count(DISTINCT v) AS n_distinct, CASE WHEN count(DISTINCT v) = 2 THEN "
        "'binary' WHEN count(DISTINCT v) <= 20 THEN 'categorical' ELSE 'free' END AS kind FROM u GROUP BY col"
    )
def _a7(spark, d):  # noqa: ANN001, ANN202
    return rel.column_profile(table(spark, d, "documents"), _PROFILE)


@query("a8_correlation", "SELECT l_returnflag AS flag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL HAVING count(*) >= 3")
def _a8(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), rounded(F.corr("l_quantity", "l_extendedprice")).alias("r")).filter("n >= 3")


#: Where the counts 1 to 8 of a Poisson variable of mean 1 begin in a uniform draw.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


@query(
    "a9_bootstrap_interval",
    f"""WITH u AS (SELECT c_mktsegment, rep, c_acctbal AS v, CAST('0x' || sha256('boot|' || rep || '|' || c_custkey)[1:8] AS BIGINT) / 4294967296 AS u FROM customer, range(1, 2001) r(rep)),
    m AS (SELECT c_mktsegment, rep, sum(c * v) / sum(c) AS m FROM (SELECT *, {' + '.join(f'(u >= {x!r})::INT' for x in _POISSON)} AS c FROM u) GROUP BY ALL)
    SELECT c_mktsegment, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m GROUP BY ALL""",
)
def _a9(spark, d, replicates=2_000):  # noqa: ANN001, ANN202
    b = ev.bootstrap_mean(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", replicates, "boot")
    return b.select("c_mktsegment", rounded(F.col("lo"), 4).alias("lo"), rounded(F.col("hi"), 4).alias("hi"))


@query("a10_cohens_d",
        f"WITH {_COHORT}, g AS (SELECT status, segment, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM cohort WHERE segment IN ('BUILDING', "
        f"'FURNITURE') GROUP BY ALL) SELECT a.status, round((a.m - b.m) / (sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) + 1e-12), 6) AS d FROM g "
        f"a JOIN g b USING (status) WHERE a.segment = 'BUILDING' AND b.segment = 'FURNITURE'"
    )
def _a10(spark, d):  # noqa: ANN001, ANN202
    return ev.cohens_d(_cohort(spark, d), ["status"], "value", "segment", "BUILDING", "FURNITURE").select("status", rounded(F.col("d")).alias("d"))


@query("a11_anova",
        f"WITH {_COHORT}, g AS (SELECT status, segment, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM cohort GROUP BY ALL), h AS (SELECT *, sum(n * "
        f"m) OVER (PARTITION BY status) / sum(n) OVER (PARTITION BY status) AS g FROM g), s AS (SELECT status, sum(n * power(m - g, 2)) AS b, sum(n * v) AS w, "
        f"count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY status) SELECT status, round((b / (k - 1)) / (w / (n - k)), 5) AS f, round(b / (b + w), 6) "
        f"AS eta_squared, k AS n_groups, n FROM s"
    )
def _a11(spark, d):  # noqa: ANN001, ANN202
    return ev.anova(_cohort(spark, d), ["status"], "value", "segment").select("status", rounded(F.col("f"), 5).alias("f"), rounded(F.col("eta_squared")).alias("eta_squared"), "n_groups", "n")


@query("a12_pivot",
        "SELECT l_returnflag AS flag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS o, round(sum(l_quantity) FILTER (WHERE l_linestatus = "
        "'F'), 4) AS f FROM lineitem GROUP BY ALL"
    )
def _a12(spark, d):  # noqa: ANN001, ANN202
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["O", "F"]).agg(rounded(F.sum("l_quantity"), 4))
    return p.withColumnsRenamed({"O": "o", "F": "f"})


@query("a13_condition_counts",
        "SELECT source, count(*) AS n_seen, count(*) FILTER (WHERE n_chars >= 200) AS n_included, count(*) FILTER (WHERE n_chars < 200) AS n_withheld, "
        "count(*) FILTER (WHERE text LIKE '%***%') AS n_quarantined FROM documents GROUP BY source"
    )
def _a13(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_seen"), F.count_if(F.col("n_chars") >= 200).alias("n_included"), F.count_if(F.col("n_chars") < 200).alias("n_withheld"), F.count_if(F.contains("text", F.lit("***"))).alias("n_quarantined"))


@query("a14_priority_action",
        "WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) t(action, priority)), a AS "
        "(SELECT o_custkey AS subject, o_orderpriority AS action, coalesce(priority, 9) AS priority FROM orders LEFT JOIN p ON action = o_orderpriority) "
        "SELECT subject, count(*) AS n, min(CAST(priority AS VARCHAR) || ' ' || action) AS first_action FROM a GROUP BY subject"
    )
def _a14(spark, d):  # noqa: ANN001, ANN202
    p = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 4), ("5-LOW", 5)], "action string, priority int")
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("action")).join(F.broadcast(p), "action", "left").withColumn("priority", F.coalesce("priority", F.lit(9)))
    return a.groupBy("subject").agg(F.count("*").alias("n"), F.min_by(F.concat_ws(" ", F.col("priority").cast("string"), "action"), F.struct("priority", "action")).alias("first_action"))


@query("a17_duplicate_groups",
        "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'n:' || p_brand || '|' || p_size ELSE 'd:' || p_type || '|' || p_size END AS key FROM "
        "part), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_partkey) AS r, first(p_partkey) OVER (PARTITION BY key ORDER BY p_partkey) AS "
        "kept FROM k) SELECT p_partkey, kept, r > 1 AS duplicate FROM r"
    )
def _a17(spark, d):  # noqa: ANN001, ANN202
    p = table(spark, d, "part")
    doi = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("d:"), "p_type", F.lit("|"), F.col("p_size").cast("string")))
    key = F.coalesce(doi, F.concat(F.lit("n:"), "p_brand", F.lit("|"), F.col("p_size").cast("string")))
    return rel.first_wins(p.withColumn("key", key), "key", "p_partkey")


@query("a18_extension_counts", "SELECT lower(regexp_extract(url, '\\.([A-Za-z]+)(/|$|\\?)', 1)) AS ext, count(*) AS n FROM pages GROUP BY ALL")
def _a18(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "pages").groupBy(F.lower(F.regexp_extract("url", r"\.([A-Za-z]+)(/|$|\?)", 1)).alias("ext")).agg(F.count("*").alias("n"))


@query("a20_inventory", "SELECT event_type AS file, count(*) AS n_rows, count(DISTINCT user_id) AS n_channels, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL")
def _a20(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "events").groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_channels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("v5_permutation_test",
        f"WITH {_COHORT}, s AS (SELECT subject, segment, avg(value) AS v FROM cohort WHERE segment IN ('BUILDING', 'FURNITURE') GROUP BY ALL), r AS (SELECT "
        f"perm, v, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN CASE WHEN segment = 'BUILDING' THEN '0' ELSE '1' END ELSE sha256('v5|' "
        f"|| perm || '|' || subject) END, subject) AS r, (SELECT count(*) FROM s WHERE segment = 'BUILDING') AS n FROM s, range(0, 51) p(perm)), d AS (SELECT "
        f"perm, avg(v) FILTER (WHERE r <= n) - avg(v) FILTER (WHERE r > n) AS diff FROM r GROUP BY perm), o AS (SELECT diff AS observed FROM d WHERE perm = 0) "
        f"SELECT round(observed, 4) AS observed, count(*) FILTER (WHERE abs(diff) >= abs(observed) - 1e-9) AS exceed, count(*) AS n, round((count(*) FILTER "
        f"(WHERE abs(diff) >= abs(observed) - 1e-9) + 1) / (count(*) + 1), 6) AS p FROM d, o WHERE perm > 0 GROUP BY observed"
    )
def _v5(spark, d):  # noqa: ANN001, ANN202
    s = _cohort(spark, d).filter(F.col("segment").isin("BUILDING", "FURNITURE")).groupBy("subject", "segment").agg(F.avg("value").alias("v"))
    t = ev.permutation_test(s, [], "subject", "v", "segment", "BUILDING", 50, "v5")
    return t.select(rounded(F.col("observed"), 4).alias("observed"), "exceed", "n", rounded(F.col("p")).alias("p"))


@query("v6_paired_sign_flip",
        f"WITH {_COHORT}, s AS (SELECT subject, segment, avg(value) FILTER (WHERE status = 'O') - avg(value) FILTER (WHERE status = 'F') AS d FROM cohort GROUP "
        f"BY ALL), k AS (SELECT * FROM s WHERE d IS NOT NULL), m AS (SELECT segment, perm, avg(d * CASE WHEN perm = 0 OR CAST('0x' || sha256('v6|' || perm || "
        f"'|' || subject)[1:8] AS BIGINT) / 4294967296 < 0.5 THEN 1 ELSE -1 END) AS m FROM k, range(0, 51) p(perm) GROUP BY ALL), o AS (SELECT segment, m AS "
        f"observed FROM m WHERE perm = 0) SELECT segment, round(observed, 4) AS observed, count(*) FILTER (WHERE abs(m) >= abs(observed) - 1e-9) AS exceed, "
        f"count(*) AS n, round((count(*) FILTER (WHERE abs(m) >= abs(observed) - 1e-9) + 1) / (count(*) + 1), 6) AS p FROM m JOIN o USING (segment) WHERE perm "
        f"> 0 GROUP BY segment, observed"
    )
def _v6(spark, d):  # noqa: ANN001, ANN202
    s = _cohort(spark, d).groupBy("subject", "segment").agg((F.avg(F.when(F.col("status") == "O", F.col("value"))) - F.avg(F.when(F.col("status") == "F", F.col("value")))).alias("d")).filter("d is not null")
    t = ev.sign_flip_test(s, ["segment"], "subject", "d", 50, "v6")
    return t.select("segment", rounded(F.col("observed"), 4).alias("observed"), "exceed", "n", rounded(F.col("p")).alias("p"))


@query("v4_null_summary",
        "WITH n AS (SELECT p_brand, p_type, avg(p_retailprice) AS v FROM part GROUP BY ALL), o AS (SELECT p_brand, max(v) AS observed FROM n GROUP BY ALL) "
        "SELECT p_brand, round(avg(v), 5) AS null_mean, round(stddev_pop(v), 5) AS null_std, round((observed - avg(v)) / nullif(stddev_pop(v), 0), 5) AS z "
        "FROM n JOIN o USING (p_brand) GROUP BY p_brand, observed"
    )
def _v4(spark, d):  # noqa: ANN001, ANN202
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"))
    n = n.withColumn("observed", F.max("v").over(W.partitionBy("p_brand")))
    s = ev.null_summary(n, ["p_brand"], "v", "observed")
    return s.select("p_brand", *(rounded(F.col(c), 5).alias(c) for c in ("null_mean", "null_std", "z")))


@query("v8_within_subject_effect",
        f"WITH {_COHORT}, b AS (SELECT subject, value - avg(value) OVER (PARTITION BY subject) AS y, (status = 'O')::INT - avg((status = 'O')::INT) OVER "
        f"(PARTITION BY subject) AS x FROM cohort WHERE status IN ('O', 'F')) SELECT count(*) AS n, count(DISTINCT subject) AS n_subjects, round(sum(x * y) / "
        f"sum(x * x), 4) AS effect FROM b"
    )
def _v8(spark, d):  # noqa: ANN001, ANN202
    by = W.partitionBy("subject")
    c = _cohort(spark, d).filter(F.col("status").isin("O", "F")).withColumn("on", (F.col("status") == "O").cast("int"))
    b = c.select("subject", (F.col("value") - F.avg("value").over(by)).alias("y"), (F.col("on") - F.avg("on").over(by)).alias("x"))
    return b.agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), rounded(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 4).alias("effect"))


@query("j1_strict_join", "SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _j1(spark, d):  # noqa: ANN001, ANN202
    m = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rel.strict_lookup(m, t, ["c_custkey"]).withColumnRenamed("c_custkey", "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment", "o_totalprice")


@query("j2_join_quality",
        "SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_missing, (SELECT count(*) FROM customer WHERE "
        "c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_extra, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS "
        "n_left_duplicates, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS n_right_duplicates"
    )
def _j2(spark, d):  # noqa: ANN001, ANN202
    return rel.join_quality(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


_META = "meta AS (SELECT doc_id, quality AS value FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 9 ELSE 1 - quality END FROM labels WHERE doc_id % 17 = 0)"


def _meta(spark, d):  # noqa: ANN001, ANN202
    la = table(spark, d, "labels")
    flipped = F.when(F.col("doc_id") % 19 == 0, 9).otherwise(1 - F.col("quality"))
    return la.select("doc_id", F.col("quality").cast("int").alias("value")).unionByName(la.filter("doc_id % 17 = 0").select("doc_id", flipped.cast("int").alias("value")))


@query("j3_label_alignment",
        f"WITH {_META}, g AS (SELECT doc_id, count(DISTINCT value) AS n, max(value) AS v FROM meta GROUP BY doc_id) SELECT d.doc_id, CASE WHEN n IS NULL THEN "
        f"'no_match' WHEN n > 1 THEN 'conflicting_labels' WHEN v = 1 THEN 'aligned' WHEN v = 0 THEN 'aligned' ELSE 'unknown_value' END AS alignment_status, "
        f"CASE WHEN n = 1 AND v IN (0, 1) THEN CAST(v AS INTEGER) END AS y FROM documents d LEFT JOIN g USING (doc_id)"
    )
def _j3(spark, d):  # noqa: ANN001, ANN202
    return rel.align_labels(table(spark, d, "documents").select("doc_id"), _meta(spark, d), "doc_id", "value", [1], [0])


@query("j4_target_injection",
        f"WITH {_META}, g AS (SELECT doc_id, CASE WHEN count(DISTINCT value) = 1 THEN CAST(min(value) AS INTEGER) END AS y, count(DISTINCT value) > 1 AS "
        f"rejected FROM meta GROUP BY doc_id) SELECT d.doc_id, d.n_chars, g.y, coalesce(rejected, false) AS rejected FROM documents d LEFT JOIN g USING (doc_id)"
    )
def _j4(spark, d):  # noqa: ANN001, ANN202
    return rel.inject_targets(table(spark, d, "documents").select("doc_id", "n_chars"), _meta(spark, d), "doc_id", "value")


@query("j5_pruned_join", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def _j5(spark, d):  # noqa: ANN001, ANN202
    li = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return li.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderstatus")


_ASOF = "s AS (SELECT user_id, epoch(ts) AS t FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, epoch(ts) + 37 AS t FROM events WHERE event_type = 'purchase')"


@query("j6_nearest_join",
        f"WITH {_ASOF}, c AS (SELECT p.event_id, s.t AS s_t, abs(s.t - p.t) AS gap FROM p JOIN s ON s.user_id = p.user_id AND abs(s.t - p.t) <= 7200), r AS "
        f"(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, s_t) AS r FROM c) SELECT event_id, round(gap, 3) AS gap FROM r WHERE r = 1"
    )
def _j6(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("s_t"))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", (F.col("t") + 37).alias("t"))
    return rel.nearest_join(p, s, ["user_id"], "event_id", "t", "s_t", 7200.0).select("event_id", rounded(F.col("gap"), 3).alias("gap"))


@query("j7_trial_masks",
        "WITH e AS (SELECT user_id % 2 AS cond, epoch(ts) / 3600 AS t FROM events WHERE event_type = 'purchase'), m AS (SELECT DISTINCT cond, "
        "unnest(range(CAST(ceil(t + 1) AS BIGINT), CAST(floor(t + 3) AS BIGINT) + 1)) AS tr FROM e) SELECT tr, count(DISTINCT cond) AS n_conditions, CASE WHEN "
        "count(DISTINCT cond) = 1 THEN min(cond) END AS cond FROM m GROUP BY tr"
    )
def _j7(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 2).alias("cond"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"))
    return rel.interval_masks(e, "t", "cond", 1, 3)


@query("j8_nearest_neighbour",
        "WITH n AS (SELECT a.label, a.vec_id, min(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id "
        "GROUP BY ALL) SELECT label, count(*) AS n, round(median(d), 5) AS median_nn FROM n GROUP BY label"
    )
def _j8(spark, d):  # noqa: ANN001, ANN202
    near = sp.nearest_distances(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    return near.groupBy("label").agg(F.count("d").alias("n"), rounded(F.percentile("d", 0.5), 5).alias("median_nn")).filter("n > 0")


@query("j12_integrity",
        "SELECT 'dangling_nation' AS violation, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE "
        "n_regionkey < 3) UNION ALL SELECT 'no_customer', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer "
        "WHERE c_acctbal > 9000)"
    )
def _j12(spark, d):  # noqa: ANN001, ANN202
    n, s, c = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    a = rel.dangling(s, "s_nationkey", n.filter("n_regionkey < 3"), "n_nationkey", "s_suppkey", "dangling_nation")
    return a.unionByName(rel.dangling(n, "n_nationkey", c.filter("c_acctbal > 9000"), "c_nationkey", "n_nationkey", "no_customer"))


@query("j13_cartesian_plan", "SELECT r_name, n_name, 'q' || r_regionkey || '-' || n_nationkey AS plan_id FROM region, nation")
def _j13(spark, d):  # noqa: ANN001, ANN202
    x_ = F.broadcast(table(spark, d, "region")).crossJoin(table(spark, d, "nation"))
    return x_.select("r_name", "n_name", F.concat(F.lit("q"), F.col("r_regionkey").cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")).alias("plan_id"))


@query("j14_any_match", "SELECT o_orderkey, bool_or(l_returnflag = 'R') AS risky FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _j14(spark, d):  # noqa: ANN001, ANN202
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("risky"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.bool_or("risky").alias("risky"))


@query("j11_channel_pairs", sql(
        " SELECT a.recording_id, a.channel AS a, b.channel AS b, count(*) AS n, round(sum(a.v * b.v), 4) AS dot FROM windowed a JOIN windowed b USING "
        "(recording_id, w, k) WHERE a.channel < b.channel GROUP BY ALL"
    , "windowed"))
def _j11(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.operators import phase_metrics as pm
    from phaseloom.plans.views import windowed

    p = pm.pairs(windowed(spark, d), ["recording_id", "w"], value="v")
    return p.groupBy("recording_id", "a", "b").agg(F.count("*").alias("n"), rounded(F.sum(F.col("x") * F.col("y")), 4).alias("dot"))


@query("u1_union_by_name", "SELECT s_nationkey AS nation, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _u1(spark, d):  # noqa: ANN001, ANN202
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_key_difference",
        "SELECT 'left' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'right', o_custkey "
        "FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)"
    )
def _u2(spark, d):  # noqa: ANN001, ANN202
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).select(F.lit("left").alias("side"), "k").union(b.subtract(a).select(F.lit("right").alias("side"), "k"))


@query("u3_both_conditions", "SELECT o_custkey AS subject FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2")
def _u3(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderstatus")
    return o.filter("o_orderstatus = 'O'").select("subject").intersect(o.filter("o_orderstatus = 'F'").select("subject"))


@query("u4_distinct", "SELECT DISTINCT l_shipmode_ AS flag, l_linenumber FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, l_linenumber FROM lineitem)")
def _u4(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_linenumber").dropDuplicates()


@query("t4_priority_queue", "SELECT p_partkey, row_number() OVER (ORDER BY p_size * 10 + p_retailprice / 100 DESC, p_partkey) AS place FROM part")
def _t4(spark, d):  # noqa: ANN001, ANN202
    return rel.ranked(table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10 + F.col("p_retailprice") / 100).alias("s")), "s", "p_partkey", "place").select("p_partkey", "place")


@query("t5_seeded_sample", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY sha256('7|' || c_custkey) LIMIT 100")
def _t5(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "customer").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("c_custkey").cast("string")), 256)).limit(100).select("c_custkey", "c_mktsegment")


@query("t7_group_cap", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def _t7(spark, d):  # noqa: ANN001, ANN202
    r = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("r", r).filter("r <= 5").select("user_id", "event_id")


@query("f1_wrap_phase", "SELECT event_id, round(value + pi() - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) + 0.0 AS theta FROM events")
def _f1(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "events").select("event_id", rounded(x.wrap_phase(F.col("value"))).alias("theta"))


@query("f3_stable_ids", "SELECT doc_id, 'art_' || sha256(source || '|' || lang || '|' || doc_id)[1:16] AS id, CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS seed FROM documents")
def _f3(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").select("doc_id", x.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), prefix="art_").alias("id"), x.hash_seed(F.col("doc_id")).alias("seed"))


@query("f7_tokens", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\wÀ-ɏ]+'), lambda t: length(t) > 1)) AS INTEGER) AS n_tokens FROM documents")
def _f7(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").select("doc_id", F.size(x.tokens(F.col("text"))).alias("n_tokens"))


@query("f9_json_fields", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def _f9(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("p1_path_tokens",
        "SELECT page_id, coalesce(nullif(regexp_extract(url, 'example\\.([a-z]+)/', 1), ''), 'unknown') AS zone, coalesce(nullif(regexp_extract(url, "
        "'/(en|fr|de|es)/', 1), ''), 'unknown') AS lang, CASE WHEN url LIKE '%page=%' THEN 'paged' WHEN url LIKE '%#%' THEN 'anchor' WHEN url LIKE 'https:%' "
        "THEN 'secure' ELSE 'plain' END AS state FROM pages"
    )
def _p1(spark, d):  # noqa: ANN001, ANN202
    u = F.col("url")
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract("url", p, 1), F.lit("")), F.lit("unknown"))
    state = F.when(F.contains(u, F.lit("page=")), "paged").when(F.contains(u, F.lit("#")), "anchor").when(u.startswith("https:"), "secure").otherwise("plain")
    return table(spark, d, "pages").select("page_id", part(r"example\.([a-z]+)/").alias("zone"), part(r"/(en|fr|de|es)/").alias("lang"), state.alias("state"))


@query("p2_first_match_class",
        "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE '%STEEL%' AND p_size > 25 THEN 'big_steel' WHEN p_type LIKE '%STEEL%' "
        "THEN 'steel' WHEN p_brand LIKE '%1' THEN 'brand_one' ELSE 'other' END AS class FROM part"
    )
def _p2(spark, d):  # noqa: ANN001, ANN202
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.when(F.contains("p_type", F.lit("BRASS")), "brass").when(F.contains("p_type", F.lit("STEEL")) & (c("p_size") > 25), "big_steel").when(F.contains("p_type", F.lit("STEEL")), "steel").when(c("p_brand").endswith("1"), "brand_one").otherwise("other").alias("class"))


@query("p9_row_validation",
        "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_retailprice < 950 THEN 'price' END, CASE WHEN "
        "p_brand NOT LIKE 'Brand%' THEN 'brand' END], lambda e: e IS NOT NULL), ';') AS errors FROM part"
    )
def _p9(spark, d):  # noqa: ANN001, ANN202
    c = F.col
    errors = x.all_blockers((c("p_size") > 45, "size"), (c("p_retailprice") < 950, "price"), (~c("p_brand").startswith("Brand"), "brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(errors, ";").alias("errors"))


@query("p10_gate",
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked: negative balance' WHEN c_mktsegment = 'MACHINERY' THEN 'blocked: segment' WHEN n_regionkey > "
        "2 THEN 'blocked: region' ELSE 'promoted' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey"
    )
def _p10(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    status = x.first_blocker((F.col("c_acctbal") < 0, "blocked: negative balance"), (F.col("c_mktsegment") == "MACHINERY", "blocked: segment"), (F.col("n_regionkey") > 2, "blocked: region"), otherwise="promoted")
    return c.select("c_custkey", status.alias("status"))


@query("p11_weighted_score",
        "SELECT p_partkey, round(0.5 * p_size / 50 + 0.3 * least(p_retailprice / 2000, 1) + 0.2 * (p_partkey % 10) / 10, 6) AS score, CASE WHEN p_size > 40 "
        "THEN 'high' WHEN p_size > 20 THEN 'mid' ELSE 'low' END AS class FROM part"
    )
def _p11(spark, d):  # noqa: ANN001, ANN202
    c = F.col
    s = 0.5 * c("p_size") / 50 + 0.3 * F.least(c("p_retailprice") / 2000, F.lit(1.0)) + 0.2 * (c("p_partkey") % 10) / 10
    return table(spark, d, "part").select("p_partkey", rounded(s).alias("score"), F.when(c("p_size") > 40, "high").when(c("p_size") > 20, "mid").otherwise("low").alias("class"))


@query("p13_vector_phase", "SELECT vec_id, round(atan2(embedding[2], embedding[1]), 5) + 0.0 AS phase, round(0.5 * atan2(embedding[4], embedding[3]), 5) + 0.0 AS director FROM embeddings")
def _p13(spark, d):  # noqa: ANN001, ANN202
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return table(spark, d, "embeddings").select("vec_id", rounded(F.atan2(e[1], e[0]), 5).alias("phase"), rounded(0.5 * F.atan2(e[3], e[2]), 5).alias("director"))
