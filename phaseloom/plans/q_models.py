"""Queries of the residual evaluation, of group tests and of plug-in points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import evaluation as ev
from phaseloom.operators import plugins as pl
from phaseloom.operators import windows as wn
from phaseloom.plans.q_eval import _COHORT, _cohort
from phaseloom.plans.views import rounded, table

QUERIES = {}


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


# --- windows with features of two levels and a target, from the part table ----------------------------------------------

#: The topology feature that each ablation adds to the first level; all of them at once in the last.
_ABLATIONS = {"q_net": "q_net", "q_abs": "q_abs", "f_dress": "f_dress", "defect_density": "defect_density", "topology_quality": "topology_quality"}
_NAMES = ["M_only", *(f"M_plus_{a}" for a in _ABLATIONS), "M_plus_all_T"]

_ROWS = """
  rows_ AS (
    SELECT p_partkey AS id, p_brand AS dataset, p_size / 50 AS power, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 2000 END AS entropy,
           CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_partkey % 29) / 28 END AS lzc, (p_partkey % 13) / 10 AS artifact,
           (p_partkey % 7 - 3) / 2 AS q_net, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 17) / 12 END AS q_abs,
           (p_partkey % 3) / 4 AS f_dress, (p_partkey % 19) / 18 AS defect_density, (p_partkey % 23) / 22 AS topology_quality,
           CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_type LIKE 'PROMO%' OR p_size > 40 THEN 1 ELSE 0 END AS y
    FROM part),
  valid AS (SELECT * FROM rows_ WHERE y IS NOT NULL),
  m0 AS (SELECT *, greatest(0, least(1, coalesce(list_avg([v FOR v IN [power, entropy, lzc] IF v IS NOT NULL]), 0.5) * (1 - least(artifact, 1) * 0.3))) AS m FROM valid),
  m1 AS (SELECT *, CASE WHEN max(m) OVER d - min(m) OVER d < 1e-12 THEN 0.5 ELSE (m - min(m) OVER d) / (max(m) OVER d - min(m) OVER d) END AS m_scaled FROM m0 WINDOW d AS (PARTITION BY dataset)),
  t0 AS (SELECT *, list_avg([v FOR v IN [CASE WHEN q_abs < 1 THEN q_abs WHEN q_abs IS NOT NULL THEN 1 END, least(f_dress, 1), topology_quality] IF v IS NOT NULL]) * 0.4 AS t FROM m1)"""


def _all_scores(m: str) -> str:
    return f"CASE WHEN t IS NULL THEN {m} ELSE greatest(0, least(1, {m} * 0.6 + t)) END"


def _scaled_sql(col: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys})"
    return f"CASE WHEN max({col}) {w} - min({col}) {w} < 1e-12 THEN 0.5 ELSE ({col} - min({col}) {w}) / (max({col}) {w} - min({col}) {w}) END"


def _auc_sql(source: str, keys: str) -> str:
    """AUC from ranks with ties at their middle."""
    return f"""(SELECT {keys}, CASE WHEN min(y) = max(y) THEN 0.5 ELSE (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2 AS r FROM {source}) GROUP BY {keys})"""


def _ece_sql(source: str, keys: str) -> str:
    return f"(SELECT {keys}, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT {keys}, least(floor(score * 5), 4) AS bin, count(*) AS n, avg(score) AS c, avg(y) AS a FROM {source} GROUP BY ALL) GROUP BY {keys})"


def _rows(spark, d):  # noqa: ANN001, ANN202
    p, key, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    promo = F.startswith("p_type", F.lit("PROMO")) | (size > 40)
    return p.select(
        key.alias("id"), F.col("p_brand").alias("dataset"), (size / 50).alias("power"), F.when(size % 5 != 0, F.col("p_retailprice") / 2000).alias("entropy"),
        F.when(size % 3 != 0, (key % 29) / 28).alias("lzc"), ((key % 13) / 10).alias("artifact"), ((key % 7 - 3) / 2).alias("q_net"),
        F.when(key % 11 != 0, (key % 17) / 12).alias("q_abs"), ((key % 3) / 4).alias("f_dress"), ((key % 19) / 18).alias("defect_density"),
        ((key % 23) / 22).alias("topology_quality"), F.when(key % 31 != 0, promo.cast("int")).alias("y"),
    )


def _levels(spark, d):  # noqa: ANN001, ANN202
    """Rows with a target, with the score of the first level as it is (m) and scaled within its dataset."""
    v = _rows(spark, d).filter("y is not null")
    v = v.withColumn("m", ev.m_score([F.col("power"), F.col("entropy"), F.col("lzc")], F.col("artifact")))
    return v.withColumn("m_scaled", wn.scaled(v, "m", ["dataset"]))


def _both_levels(m):  # noqa: ANN001, ANN202
    return ev.mt_score(m, F.col("q_abs"), F.col("f_dress"), F.col("topology_quality"))


def _tall(v):  # noqa: ANN001, ANN202
    """(dataset, level, id, score, y): scaled scores of the first and of both levels."""
    v = v.withColumn("mt", _both_levels(F.col("m_scaled")))
    v = v.withColumn("mt", wn.scaled(v, "mt", ["dataset"])).select("dataset", "id", "y", F.col("m_scaled").alias("m"), "mt")
    return v.unpivot(["dataset", "id", "y"], ["m", "mt"], "level", "score")


_TALL = f"""{_ROWS},
  t1 AS (SELECT *, {_all_scores('m_scaled')} AS mt FROM t0), t2 AS (SELECT *, {_scaled_sql('mt', 'dataset')} AS mt_scaled FROM t1),
  tall AS (SELECT dataset, id, y, 'm' AS level, m_scaled AS score FROM t2 UNION ALL SELECT dataset, id, y, 'mt', mt_scaled FROM t2),
  auc AS {_auc_sql('tall', 'dataset, level')}, ece AS {_ece_sql('tall', 'dataset, level')}, brier AS (SELECT dataset, level, avg(power(score - y, 2)) AS brier FROM tall GROUP BY ALL),
  per AS (SELECT dataset, max(auc) FILTER (WHERE level = 'm') AS auc_m, max(auc) FILTER (WHERE level = 'mt') AS auc_mt, max(ece) FILTER (WHERE level = 'm') AS ece_m,
          max(ece) FILTER (WHERE level = 'mt') AS ece_mt, max(brier) FILTER (WHERE level = 'm') AS brier_m, max(brier) FILTER (WHERE level = 'mt') AS brier_mt
          FROM auc JOIN ece USING (dataset, level) JOIN brier USING (dataset, level) GROUP BY dataset),
  state AS (SELECT dataset, count(*) AS n_rows, count(y) AS n_targets, count(DISTINCT y) AS classes FROM rows_ GROUP BY dataset)"""


def _metrics(spark, d):  # noqa: ANN001, ANN202
    """One row a dataset: counts, AUC, calibration error and Brier score of both levels."""
    tall = _tall(_levels(spark, d))
    keys = ["dataset", "level"]
    brier = tall.groupBy(*keys).agg(ev.brier(F.col("score"), F.col("y")).alias("brier"))
    m = ev.auc(tall, keys).join(ev.ece(tall, keys), keys).join(brier, keys)
    pick = lambda c, level: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{c}_{level}")
    wide = m.groupBy("dataset").agg(*(pick(c, level) for c in ("auc", "ece", "brier") for level in ("m", "mt")))
    state = _rows(spark, d).groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count("y").alias("n_targets"), F.countDistinct("y").alias("classes"))
    return state.join(wide, "dataset", "left")


_STATE = "CASE WHEN n_targets = 0 THEN 'blocked: no explicit targets available' WHEN classes < 2 THEN 'blocked: insufficient class variation' ELSE 'available' END"


def _state():  # noqa: ANN202
    return x.first_blocker((F.col("n_targets") == 0, "blocked: no explicit targets available"), (F.col("classes") < 2, "blocked: insufficient class variation"), otherwise="available")


_M5 = ["auc_m", "auc_mt", "ece_m", "ece_mt", "brier_m", "brier_mt"]


@query("m5_residual_metrics", f"WITH {_TALL} SELECT dataset, n_rows, {_STATE} AS state, " + ", ".join(f"CASE WHEN classes = 2 THEN round({c}, 6) END AS {c}" for c in _M5) +
        ", CASE WHEN classes = 2 THEN round(auc_mt - auc_m, 6) + 0.0 END AS delta_auc, CASE WHEN classes = 2 THEN round(ece_mt - ece_m, 6) + 0.0 END AS "
        "delta_ece FROM state LEFT JOIN per USING (dataset)"
    )
def _m5(spark, d):  # noqa: ANN001, ANN202
    both = lambda c: F.when(F.col("classes") == 2, rounded(c))
    delta = [both(F.col(f"{c}_mt") - F.col(f"{c}_m")).alias(f"delta_{c}") for c in ("auc", "ece")]
    return _metrics(spark, d).select("dataset", "n_rows", _state().alias("state"), *(both(F.col(c)).alias(c) for c in _M5), *delta)


def _with_feature_sql(name: str) -> str:
    return f"greatest(0, least(1, m * 0.6 + coalesce(least(abs({name}), 1) * 0.4, 0)))" if name != "topology_quality" else f"greatest(0, least(1, m * 0.6 + coalesce({name} * 0.4, 0)))"


_M6_SCORES = {"M_only": "m", **{f"M_plus_{a}": _with_feature_sql(a) for a in _ABLATIONS}, "M_plus_all_T": _all_scores("m")}
_M6_UNION = " UNION ALL ".join(f"SELECT dataset, '{name}' AS ablation, y, {e} AS raw FROM t0" for name, e in _M6_SCORES.items())


@query(
    "m6_feature_ablations",
    f"""WITH {_ROWS}, u AS ({_M6_UNION}), s AS (SELECT dataset, ablation, y, {_scaled_sql('raw', 'dataset, ablation')} AS score FROM u),
    r AS (SELECT * FROM {_auc_sql('s', 'dataset, ablation')} JOIN {_ece_sql('s', 'dataset, ablation')} USING (dataset, ablation)), b AS (SELECT dataset, auc AS auc0, ece AS ece0 FROM r WHERE ablation = 'M_only')
    SELECT dataset, ablation, round(auc, 6) AS auc, round(auc - auc0, 6) + 0.0 AS delta_auc, round(ece, 6) AS ece, round(ece - ece0, 6) + 0.0 AS delta_ece FROM r JOIN b USING (dataset)""",
)
def _m6(spark, d):  # noqa: ANN001, ANN202
    v, m = _levels(spark, d), F.col("m")
    one = lambda f: ev.clamp(m * 0.6 + F.coalesce((F.least(F.abs(F.col(f)), F.lit(1.0)) if f != "topology_quality" else F.col(f)) * 0.4, F.lit(0.0)))
    raw = {"M_only": m, **{f"M_plus_{a}": one(f) for a, f in _ABLATIONS.items()}, "M_plus_all_T": _both_levels(m)}
    u = v.select("dataset", "y", *(e.alias(n) for n, e in raw.items())).unpivot(["dataset", "y"], _NAMES, "ablation", "raw")
    keys = ["dataset", "ablation"]
    s = u.withColumn("score", wn.scaled(u, "raw", keys))
    r = ev.auc(s, keys).join(ev.ece(s, keys), keys)
    base = r.filter("ablation = 'M_only'").select("dataset", F.col("auc").alias("auc0"), F.col("ece").alias("ece0"))
    return r.join(base, "dataset").select(*keys, rounded(F.col("auc")).alias("auc"), rounded(F.col("auc") - F.col("auc0")).alias("delta_auc"), rounded(F.col("ece")).alias("ece"), rounded(F.col("ece") - F.col("ece0")).alias("delta_ece"))


#: How much larger than that of reversed labels the gain in AUC has to be.
MARGIN = 0.01

_NULL = f"""{_TALL}, n0 AS (SELECT dataset, {_all_scores('m')} AS raw, row_number() OVER (PARTITION BY dataset ORDER BY id) AS i, row_number() OVER (PARTITION BY dataset ORDER BY id DESC) AS j, y FROM t0),
  n1 AS (SELECT a.dataset, a.raw, b.y FROM n0 a JOIN n0 b ON a.dataset = b.dataset AND a.i = b.j), n2 AS (SELECT dataset, y, {_scaled_sql('raw', 'dataset')} AS score FROM n1),
  nul AS (SELECT dataset, auc AS null_auc FROM {_auc_sql('n2', 'dataset')})"""


def _nulls(spark, d):  # noqa: ANN001, ANN202
    """(dataset, null_auc): the AUC of both levels against the labels in reverse order."""
    v = _levels(spark, d).withColumn("raw", _both_levels(F.col("m")))
    by = W.partitionBy("dataset")
    v = v.withColumn("i", F.row_number().over(by.orderBy("id"))).withColumn("n", F.count("*").over(by))
    flipped = v.select("dataset", (F.col("n") + 1 - F.col("i")).cast("int").alias("i"), "y")
    s = v.select("dataset", "i", "raw").join(flipped, ["dataset", "i"])
    return ev.auc(s.withColumn("score", wn.scaled(s, "raw", ["dataset"])), ["dataset"]).withColumnRenamed("auc", "null_auc")


@query("m7_null_margin",
        f"WITH {_NULL} SELECT dataset, round(null_auc, 6) AS null_auc, round(auc_mt - auc_m, 6) + 0.0 AS delta_auc, round(null_auc - 0.5, 6) + 0.0 AS "
        f"null_delta, auc_mt - auc_m > null_auc - 0.5 + {MARGIN} AS nulls_passed FROM nul JOIN per USING (dataset)"
    )
def _m7(spark, d):  # noqa: ANN001, ANN202
    m = _metrics(spark, d).join(_nulls(spark, d), "dataset")
    delta, null = F.col("auc_mt") - F.col("auc_m"), F.col("null_auc") - 0.5
    return m.select("dataset", rounded(F.col("null_auc")).alias("null_auc"), rounded(delta).alias("delta_auc"), rounded(null).alias("null_delta"), (delta > null + MARGIN).alias("nulls_passed"))


@query(
    "m8_promotion",
    f"""WITH {_NULL}, lost AS (SELECT p_brand AS dataset, count(*) FILTER (WHERE p_partkey % 11 = 0) AS n_missing FROM part GROUP BY ALL)
    SELECT dataset, n_rows, n_missing, CASE WHEN n_missing > 0.2 * n_rows THEN 'blocked: join quality' WHEN n_targets = 0 THEN 'blocked: no explicit targets available' WHEN classes < 2 THEN 'blocked: insufficient class variation'
      WHEN auc_mt - auc_m <= 0 THEN 'blocked: no gain in ranking' WHEN ece_mt > ece_m THEN 'blocked: calibration is worse' WHEN auc_mt - auc_m <= null_auc - 0.5 + {MARGIN} THEN 'blocked: nulls not passed' ELSE 'promoted' END AS promotion_reason
    FROM state JOIN lost USING (dataset) LEFT JOIN per USING (dataset) LEFT JOIN nul USING (dataset)""",
)
def _m8(spark, d):  # noqa: ANN001, ANN202
    rows = _rows(spark, d)
    lost = rows.groupBy("dataset").agg(F.count_if(F.col("q_abs").isNull()).alias("n_missing"))
    m = _metrics(spark, d).join(lost, "dataset").join(_nulls(spark, d), "dataset", "left")
    delta = F.col("auc_mt") - F.col("auc_m")
    reason = x.first_blocker(
        (F.col("n_missing") > 0.2 * F.col("n_rows"), "blocked: join quality"), (F.col("n_targets") == 0, "blocked: no explicit targets available"), (F.col("classes") < 2, "blocked: insufficient class variation"),
        (delta <= 0, "blocked: no gain in ranking"), (F.col("ece_mt") > F.col("ece_m"), "blocked: calibration is worse"), (delta <= F.col("null_auc") - 0.5 + MARGIN, "blocked: nulls not passed"), otherwise="promoted",
    )
    return m.select("dataset", "n_rows", "n_missing", reason.alias("promotion_reason"))


# --- group tests -------------------------------------------------------------------------------------------------------

#: Permutations of the registered group tests; their statements draw the same ones.
DRAWS = 200
#: Those of the group report, as in the reference.
REPORT_DRAWS = 2000


def _shuffle_sql(source: str, keys: str, first: str, seed: str, stat: str = "avg(v) FILTER (WHERE r <= n) - avg(v) FILTER (WHERE r > n)", row: str = "subject", draws: int = DRAWS) -> str:
    part = f"{keys}, perm" if keys else "perm"
    per = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT {part}, {stat} AS stat FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY CASE WHEN perm = 0 THEN CASE WHEN g = '{first}' THEN '0' ELSE 'f' END ELSE sha256('{seed}|' || perm || '|' || {row}) END, {row}) AS r
      FROM (SELECT *, count(*) FILTER (WHERE g = '{first}') OVER ({per}) AS n FROM {source}) q, range(0, {draws + 1}) p(perm)) GROUP BY {part})"""


def _flip_sql(source: str, keys: str, seed: str) -> str:
    part = f"{keys}, perm" if keys else "perm"
    return f"(SELECT {part}, avg(d * CASE WHEN perm = 0 OR CAST('0x' || sha256('{seed}|' || perm || '|' || subject)[1:8] AS BIGINT) / 4294967296 < 0.5 THEN 1 ELSE -1 END) AS stat FROM {source}, range(0, {DRAWS + 1}) p(perm) GROUP BY ALL)"


_HITS = {"two-sided": "abs(stat) >= abs(o) - 1e-9", "greater": "stat >= o - 1e-9", "less": "stat <= o + 1e-9"}


def _share_sql(source: str, keys: str, hit: str, more: str = "") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return f"SELECT {keys + ', ' if keys else ''}{more}round(max(o), 4) + 0.0 AS observed, count(*) FILTER (WHERE {hit}) AS exceed, count(*) AS n, round((count(*) FILTER (WHERE {hit}) + 1) / (count(*) + 1), 6) AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN stat END) OVER ({over}) AS o FROM {source}) WHERE perm > 0" + (f" GROUP BY {keys}" if keys else "")


_SUBJECTS = f"{_COHORT}, subj AS (SELECT subject, segment AS g, avg(value) AS v FROM cohort WHERE segment IN ('BUILDING', 'FURNITURE') GROUP BY ALL)"


def _subjects(spark, d):  # noqa: ANN001, ANN202
    return _cohort(spark, d).filter(F.col("segment").isin("BUILDING", "FURNITURE")).groupBy("subject", F.col("segment").alias("g")).agg(F.avg("value").alias("v"))


def _shown(t, *more):  # noqa: ANN001, ANN002, ANN202
    return t.select(*more, rounded(F.col("observed"), 4).alias("observed"), "exceed", "n", rounded(F.col("p")).alias("p"))


@query("v5_alternatives", f"WITH {_SUBJECTS}, s AS {_shuffle_sql('subj', '', 'BUILDING', 'v5')} " + " UNION ALL ".join(_share_sql("s", "", hit, f"'{name}' AS alternative, ") for name, hit in _HITS.items()))
def _v5(spark, d):  # noqa: ANN001, ANN202
    out = None
    for name in ev.EXTREME:
        t = _shown(ev.permutation_test(_subjects(spark, d), [], "subject", "v", "g", "BUILDING", DRAWS, "v5", name).withColumn("alternative", F.lit(name)), "alternative")
        out = t if out is None else out.unionByName(t)
    return out


@query("e2_chosen_statistic", f"WITH {_SUBJECTS}, s AS {_shuffle_sql('subj', '', 'BUILDING', 'e2', 'stddev_samp(v) FILTER (WHERE r <= n) / stddev_samp(v) FILTER (WHERE r > n)')} " + _share_sql("s", "", _HITS["greater"]))
def _e2(spark, d):  # noqa: ANN001, ANN202
    ratio = pl.STATISTICS["spread_ratio"]
    return _shown(ev.permutation_test(_subjects(spark, d), [], "subject", "v", "g", "BUILDING", DRAWS, "e2", "greater", ratio))


_PAIRED = (
        f"{_COHORT}, wide AS (SELECT subject, avg(value) FILTER (WHERE status = 'F') - avg(value) FILTER (WHERE status = 'O') AS d FROM cohort WHERE status IN "
        f"('F', 'O') GROUP BY subject), diffs AS (SELECT * FROM wide WHERE d IS NOT NULL)"
)


@query("v6_blocked_paired",
        f"WITH {_PAIRED}, s AS {_flip_sql('diffs', '', 'v6')}, t AS ({_share_sql('s', '', _HITS['two-sided'])}) SELECT 'paired' AS method, t.*, (SELECT "
        f"round(avg(d) / stddev_samp(d), 6) + 0.0 FROM diffs) AS effect FROM t"
    )
def _v6(spark, d):  # noqa: ANN001, ANN202
    t = ev.subject_blocked_test(_cohort(spark, d).filter(F.col("status").isin("F", "O")), "subject", "status", "value", DRAWS, "v6")
    return _shown(t.withColumn("effect", rounded(F.col("effect"))), "method", "effect")


@query(
    "v6_blocked_between",
    f"""WITH {_SUBJECTS}, s AS {_shuffle_sql('subj', '', 'BUILDING', 'v6b')}, t AS ({_share_sql('s', '', _HITS['less'])}), g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS w FROM subj GROUP BY g)
    SELECT 'between' AS method, t.*, (SELECT round((a.m - b.m) / (sqrt(((a.n - 1) * a.w + (b.n - 1) * b.w) / (a.n + b.n - 2)) + 1e-12), 6) + 0.0 FROM g a, g b WHERE a.g = 'BUILDING' AND b.g = 'FURNITURE') AS effect FROM t""",
)
def _v6b(spark, d):  # noqa: ANN001, ANN202
    c = _cohort(spark, d).filter(F.col("segment").isin("BUILDING", "FURNITURE"))
    t = ev.subject_blocked_test(c, "subject", "segment", "value", DRAWS, "v6b", "less")
    return _shown(t.withColumn("effect", rounded(F.col("effect"))), "method", "effect")


@query(
    "v8_cluster_robust",
    f"""WITH {_COHORT}, b AS (SELECT subject, value - avg(value) OVER p AS y, (status = 'O')::INT - avg((status = 'O')::INT) OVER p AS x FROM cohort WHERE status IN ('O', 'F') WINDOW p AS (PARTITION BY subject)),
    f AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx FROM b), c AS (SELECT subject, sum(x * (y - beta * x)) AS score FROM b, f GROUP BY ALL)
, t AS (SELECT any_value(beta) AS effect, count(*) AS n_subjects, sqrt(count(*) / (count(*) - 1) * sum(score * score)) / any_value(sxx) AS se FROM c, f), n AS (SELECT count(*) AS n_obs FROM cohort WHERE status IN ('O', 'F') AND value IS NOT NULL),
    p AS (SELECT *, least(abs(effect / se), 8) AS z FROM t) -- the normal tail by Simpson's rule
    SELECT round(effect, 4) + 0.0 AS effect, n_subjects, n_obs, round(se, 4) AS se, round(1 - 2 * z / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 2000, 2) / 2))) / sqrt(2 * pi()), 6) + 0.0 AS p FROM p, n""",
)
def _v8(spark, d):  # noqa: ANN001, ANN202
    c = _cohort(spark, d).filter(F.col("status").isin("O", "F")).withColumn("on", (F.col("status") == "O").cast("int"))
    t = ev.within_effect(c, "subject", "on", "value")
    return t.select(rounded(F.col("effect"), 4).alias("effect"), "n_subjects", "n_obs", rounded(F.col("se"), 4).alias("se"), rounded(F.col("p")).alias("p"))


@query("v8_mixed_effect")
def _v8b(spark, d):  # noqa: ANN001, ANN202
    c = _cohort(spark, d).filter(F.col("status").isin("O", "F")).withColumn("on", (F.col("status") == "O").cast("int"))
    t = ev.mixed_effect(c, "subject", "on", "value")
    return t.select(*(rounded(F.col(k), 4).alias(k) for k in ("effect", "se", "p", "variance_ratio")), "converged", "n_obs", "n_subjects")


_METRICS = {"total": "value", "cents": "value % 100", "thousands": "floor(value / 1000)"}
_TALL_METRICS = " UNION ALL ".join(f"SELECT '{m}' AS metric, o_orderkey AS row_, subject, segment AS g, {e} AS v FROM cohort WHERE segment IN ('BUILDING', 'FURNITURE')" for m, e in _METRICS.items())


@query(
    "v7_group_report",
    f"""WITH {_COHORT}, u AS ({_TALL_METRICS}), cells AS (SELECT metric, subject, g, avg(v) AS v FROM u GROUP BY ALL), a AS {_shuffle_sql('u', 'metric', 'BUILDING', 'v7', row='row_', draws=REPORT_DRAWS)}, b AS {_shuffle_sql('cells', 'metric', 'BUILDING', 'v7', draws=REPORT_DRAWS)}
    {_share_sql('a', 'metric', _HITS['two-sided'], "'window_pooled' AS kind, ")} UNION ALL {_share_sql('b', 'metric', _HITS['two-sided'], "'subject_blocked' AS kind, ")}""",
)
def _v7(spark, d):  # noqa: ANN001, ANN202
    c = _cohort(spark, d).filter(F.col("segment").isin("BUILDING", "FURNITURE")).select("subject", F.col("o_orderkey").alias("row_"), F.col("segment").alias("g"), *(F.expr(e).cast("double").alias(m) for m, e in _METRICS.items()))
    u = c.unpivot(["subject", "row_", "g"], list(_METRICS), "metric", "v")
    pooled = ev.permutation_test(u, ["metric"], "row_", "v", "g", "BUILDING", REPORT_DRAWS, "v7").withColumn("kind", F.lit("window_pooled"))
    cells = u.groupBy("metric", "subject", "g").agg(F.avg("v").alias("v"))
    blocked = ev.permutation_test(cells, ["metric"], "subject", "v", "g", "BUILDING", REPORT_DRAWS, "v7").withColumn("kind", F.lit("subject_blocked"))
    return _shown(pooled.unionByName(blocked), "metric", "kind")


@query("a10_paired_effect",
        f"WITH {_COHORT}, w AS (SELECT segment, subject, avg(value) FILTER (WHERE status = 'F') - avg(value) FILTER (WHERE status = 'O') AS d FROM cohort GROUP "
        f"BY ALL) SELECT segment, count(d) AS n_pairs, round(avg(d) / nullif(stddev_samp(d), 0), 6) + 0.0 AS dz FROM w GROUP BY segment"
    )
def _a10(spark, d):  # noqa: ANN001, ANN202
    mean = lambda s: F.avg(F.when(F.col("status") == s, F.col("value")))
    w = _cohort(spark, d).groupBy("segment", "subject").agg((mean("F") - mean("O")).alias("d"))
    return w.groupBy("segment").agg(F.count("d").alias("n_pairs"), rounded(F.avg("d") / F.when(F.stddev_samp("d") > 0, F.stddev_samp("d"))).alias("dz"))


@query("a8_correlation_test",
        "WITH g AS (SELECT p_brand AS g, count(*) AS n, corr(p_size, p_retailprice) AS r FROM part GROUP BY ALL HAVING count(*) >= 3) SELECT g, n, round(r, 6) "
        "+ 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) + 0.0 AS t FROM g"
    )
def _a8(spark, d):  # noqa: ANN001, ANN202
    return pl.correlation_test(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice").select(F.col("p_brand").alias("g"), "n", rounded(F.col("r")).alias("r"), rounded(F.col("t"), 5).alias("t"))


@query("a8_correlation_p")
def _a8p(spark, d):  # noqa: ANN001, ANN202
    t = pl.correlation_test(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")
    return t.select(F.col("p_brand").alias("g"), "n", rounded(F.col("r")).alias("r"), rounded(F.col("p")).alias("p"))


# --- plug-in points ----------------------------------------------------------------------------------------------------


@query(
    "e3_subject_job",
    """WITH s AS (SELECT user_id AS subject, count(*) AS n, max(value) - min(value) AS span, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY ALL)
    SELECT subject, CASE WHEN bought < 10 THEN 'error' ELSE 'done' END AS status, CASE WHEN bought < 10 THEN 'no purchases to work on' END AS error, CASE WHEN bought >= 10 THEN round(span, 6) END AS result FROM s""",
)
def _e3(spark, d):  # noqa: ANN001, ANN202
    def span(rows: pd.DataFrame) -> float:
        if (rows["event_type"] == "purchase").sum() < 10:
            raise ValueError("no purchases to work on")
        return float(rows["value"].max() - rows["value"].min())

    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_type", "value")
    return pl.subject_job(e, "subject", span).withColumn("result", rounded(F.col("result")))


@query(
    "e4_literature_records",
    """SELECT 'atom' AS adapter, 'doc-' || doc_id AS record_id, 'Text ' || doc_id || ' & <' || lang || '>' AS title, source AS authors, CAST(1990 + doc_id % 30 AS INTEGER) AS year, 'https://example.org/' || doc_id AS url FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'json', 'doc-' || doc_id, 'Text ' || doc_id, source || '; ' || lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(1990 + doc_id % 30 AS INTEGER) END, 'https://example.org/' || doc_id FROM documents WHERE doc_id % 2 = 1""",
)
def _e4(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (1990 + F.col("doc_id") % 30).cast("int").alias("year"))
    url, ident = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    title = F.concat(F.lit("Text "), F.col("doc_id").cast("string"))
    atom = docs.filter("doc_id % 2 = 0").select(
        ident.alias("id"), F.concat(title, F.lit(" & <"), "lang", F.lit(">")).alias("title"), F.concat(F.col("year").cast("string"), F.lit("-03-01T00:00:00Z")).alias("published"),
        F.array(F.struct(F.col("source").alias("name"))).alias("author"), F.struct(url.alias("_href")).alias("link"),
    )
    year = F.when(F.col("doc_id") % 7 != 0, F.col("year"))
    other = docs.filter("doc_id % 2 = 1").select(ident.alias("id"), title.alias("title"), year.alias("publication_year"), F.array("source", "lang").alias("authors"), url.alias("landing_page_url"))
    return pl.read_literature(spark, pl.written(atom, "xml", rowTag="entry", rootTag="feed"), pl.written(other, "json"))
