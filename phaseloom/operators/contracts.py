"""Manifests, sync plans and contract checks over tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, path, size, sha256, class, action) of documents taken as files."""
    n = F.col("n_chars")
    return docs.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), n.alias("size"), F.sha2("text", 256).alias("sha256"),
        F.when(n > 5000, "large").when(n > 500, "medium").otherwise("small").alias("class"), F.when(F.contains("text", F.lit("@")), "review").otherwise("index").alias("action"),
    )


def sync_plan(left: DataFrame, right: DataFrame, key: str, content: str, names: dict[str, str]) -> DataFrame:
    """(key, action): full outer join on the key; names gives the words for left, right, changed and same."""
    a, b = left.select(key, F.col(content).alias("__a")), right.select(key, F.col(content).alias("__b"))
    both = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), key, "full")
    action = F.when(F.col("__r").isNull(), names["left"]).when(F.col("__l").isNull(), names["right"]).when(~F.col("__a").eqNullSafe(F.col("__b")), names["changed"]).otherwise(names["same"])
    return both.select(key, action.alias("action"))


def resume(rows: DataFrame, done: DataFrame, key: str, least: int) -> DataFrame:
    """(key, n_rows, status) of the subjects that are not done yet; failures are rows, not exceptions."""
    n = rows.join(done.distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_rows"))
    return n.withColumn("status", F.when(F.col("n_rows") < least, "error: too few rows").otherwise("done"))


def stage_contracts(spark: SparkSession, stages: dict[str, DataFrame], required: list[tuple[str, str]]) -> DataFrame:
    """(stage, n_required, n_missing, status): required columns against those that the stages have."""
    want = spark.createDataFrame(required, "stage string, col string")
    have = spark.createDataFrame([(s, c) for s, df in stages.items() for c in df.columns], "stage string, col string")
    j = want.join(have.withColumn("found", F.lit(True)), ["stage", "col"], "left")
    missing = F.count_if(F.col("found").isNull())
    return j.groupBy("stage").agg(F.count("*").alias("n_required"), missing.alias("n_missing"), F.when(missing == 0, "ok").otherwise("error").alias("status"))


def first_match(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The value of the first rule of which the text holds a needle; rules are a fixed, short table."""
    out = None
    for value, needles in rules:
        hit = F.contains(text, F.lit(needles[0]))
        for n in needles[1:]:
            hit = hit | F.contains(text, F.lit(n))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def first_match_sql(text: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    """The same as a CASE expression."""
    if not rules:
        return f"'{otherwise}'"
    when = " ".join("WHEN " + " OR ".join(f"contains({text}, '{n}')" for n in needles) + f" THEN '{value}'" for value, needles in rules)
    return f"CASE {when} ELSE '{otherwise}' END"


# Fixed values of the score's gates: bounds of the composite and of single dimensions.
GATES = {"a": 3.8, "a_support": 4, "a_falsifiable": 4, "b": 3.0, "b_falsifiable": 3, "x_overclaim": 5, "x_support": 4}


def weighted_status(rows: DataFrame, weights: dict[str, float], rejected: Column, ceilings: DataFrame, key: str) -> DataFrame:
    """rows with composite, status and gate_reasons: gates of a weighted score, then the ceiling of the row's key.

    ceilings(key, ceiling) is a small table; statuses rise from C over B to A, X stands outside.
    """
    total = F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 9)  # so that a sum on a gate's bound passes it
    rank = lambda c: F.when(c == "A", 2).when(c == "B", 1).otherwise(0)
    s = rows.withColumn("composite", total).withColumn("rejected", rejected)
    gate = (
        F.when(F.col("rejected") | ((F.col("overclaim") >= GATES["x_overclaim"]) & (F.col("support") < GATES["x_support"])), "X")
        .when((F.col("composite") >= GATES["a"]) & (F.col("support") >= GATES["a_support"]) & (F.col("falsifiable") >= GATES["a_falsifiable"]), "A")
        .when((F.col("composite") >= GATES["b"]) & (F.col("falsifiable") >= GATES["b_falsifiable"]), "B").otherwise("C")
    )
    s = s.withColumn("gate", gate).join(F.broadcast(ceilings), key, "left")
    held = (F.col("gate") != "X") & (rank(F.col("gate")) > rank(F.col("ceiling"))) & F.col("ceiling").isNotNull()
    reasons = F.filter(F.array(F.when(held, F.concat(F.lit("ceiling:"), "ceiling")), F.when(F.col("rejected"), F.lit("rejected"))), lambda x: x.isNotNull())
    return s.withColumn("status", F.when(held, F.col("ceiling")).otherwise(F.col("gate"))).withColumn("gate_reasons", F.array_join(reasons, ";")).drop("gate", "ceiling", "rejected")


def upsert(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """current with incoming applied by key: equal contents keep the stored row, others are replaced, new keys are added; action tells which."""
    a, b = current.select(key, *(F.col(c).alias(f"__a_{c}") for c in current.columns if c != key), F.lit(True).alias("__a")), incoming.withColumn("__b", F.lit(True))
    j = a.join(b, key, "full")
    same = F.col("__a") & F.col("__b") & F.col(f"__a_{content}").eqNullSafe(F.col(content))
    action = F.when(F.col("__b").isNull(), "untouched").when(F.col("__a").isNull(), "insert").when(same, "unchanged").otherwise("update")
    keep = F.col("__b").isNull() | same
    values = [F.when(keep, F.col(f"__a_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c != key]
    return j.select(key, *values, action.alias("action"))


def contract_checks(tables: dict[str, DataFrame], columns: list[tuple[str, str]], keys: list[tuple[str, str]], texts: list[tuple[str, str, str]]) -> DataFrame:
    """(stage, n_errors, errors): missing columns, missing or repeated keys and unsafe phrases of each table; each is read once a check."""
    found = []
    for name, df in tables.items():
        have = {c.lower() for c in df.columns}
        lost = [f"missing column {c}" for t, c in columns if t == name and c.lower() not in have]
        checks = [F.lit(m) for m in lost]
        for t, k in keys:
            if t == name:
                checks.append(F.when(F.count_if(F.col(k).isNull()) > 0, F.lit(f"null key {k}")))
                checks.append(F.when(F.count(k) > F.countDistinct(k), F.lit(f"repeated key {k}")))
        for t, c, phrase in texts:
            if t == name:
                checks.append(F.when(F.count_if(F.contains(F.lower(F.col(c)), F.lit(phrase))) > 0, F.lit(f"unsafe text {phrase}")))
        errors = F.filter(F.array(F.when(F.count("*") == 0, F.lit("no rows")), *checks), lambda x: x.isNotNull())
        found.append(df.agg(errors.alias("e")).select(F.lit(name).alias("stage"), F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def hash_manifest(files: DataFrame, path: str, content: str, excluded: list[str]) -> DataFrame:
    """(path, sha256) of the files whose path matches none of the patterns."""
    out = files
    for pattern in excluded:
        out = out.filter(~F.rlike(path, F.lit(pattern)))
    return out.select(path, F.sha2(content, 256).alias("sha256"))


def label_profiles(values: DataFrame, key: str, most: int) -> DataFrame:
    """(key, n_candidates, n_binary, first_col, vals): columns of each dataset with 1 to `most` values; values(key, col, v)."""
    p = values.groupBy(key, "col").agg(F.countDistinct("v").alias("n"))
    few = p.filter((F.col("n") >= 1) & (F.col("n") <= most))
    kept = values.join(few, [key, "col"]).groupBy(key, "col", "n").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("vals"))  # `most` values at most
    g = kept.groupBy(key).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("n") == 2).alias("n_binary"), F.min("col").alias("first_col"), F.min_by("vals", "col").alias("vals"))
    return values.select(key).distinct().join(g, key, "left").na.fill(0, ["n_candidates", "n_binary"])


def contract_drafts(profiles: DataFrame, key: str) -> DataFrame:
    """(key, explicit_label_column, status, unresolved_values, blockers): a draft that names what people have to decide."""
    none, several = F.col("n_candidates") == 0, F.col("n_candidates") > 1
    status = F.when(none, "blocked_no_candidate_column").when(F.col("n_binary") == 0, "blocked_needs_explicit_mapping").otherwise("inactive_review_required")
    blockers = F.array(
        F.when(none, F.lit("explicit_label_column_required")), F.when(several, F.lit("choose_label_column")), F.when(F.col("vals").isNotNull(), F.lit("declare_positive_and_negative_values")), F.lit("verify_join_keys")
    )
    named = F.array_join(F.filter(blockers, lambda b: b.isNotNull()), ";")
    return profiles.select(key, F.col("first_col").alias("explicit_label_column"), status.alias("status"), F.coalesce("vals", F.lit("")).alias("unresolved_values"), named.alias("blockers"))


def run_batch(rows: DataFrame, path: str, subject: str, least: int, run: int) -> None:
    """Work on the subjects that the manifest under path does not hold yet and append their rows to it; failures are rows with an error."""
    spark = rows.sparkSession
    todo = rows if run == 1 else rows.join(spark.read.parquet(path).select(subject).distinct(), subject, "left_anti")
    out = todo.groupBy(subject).agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))
    status = F.when(F.col("n_rows") < least, "error: too few rows").otherwise("done")
    out.withColumn("status", status).write.mode("overwrite").parquet(f"{path}/run={run}")  # a run that is repeated replaces itself


def _stored_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs have left under path, if there is anything."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_jobs(rows: DataFrame, path: str, subject: str, job: Callable[[pd.DataFrame], dict[str, float]], results: list[str]) -> int:
    """Call job on the rows of each subject that no earlier run under path has done, and append a row a subject; gives the run's number.

    A job that raises gives its subject a row with the error, and the others go on; such subjects are taken up again by
    the next run, those that are done are not. The number follows from the runs that are there, so a run that was broken
    off, and has left no rows, is repeated under its own number. job gets one subject's rows and returns the results by name.
    """
    spark = rows.sparkSession
    before = _stored_runs(spark, path)
    number = 1 if before is None else (before.agg(F.max("run")).first()[0] or 0) + 1
    todo = rows if before is None else rows.join(before.filter("status = 'done'").select(subject).distinct(), subject, "left_anti")
    kind = dict(rows.dtypes)[subject]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        head = {subject: part[subject].iloc[0], "n_rows": len(part)}
        try:
            found = job(part)
            return pd.DataFrame([{**head, **{r: float(found[r]) for r in results}, "status": "done"}])
        except Exception as e:  # a job may fail on a subject  # noqa: BLE001
            return pd.DataFrame([{**head, **dict.fromkeys(results), "status": f"error: {e}"}])

    schema = ", ".join([f"{subject} {kind}", "n_rows long", *(f"{r} double" for r in results), "status string"])
    todo.groupBy(subject).applyInPandas(run, schema).write.mode("overwrite").parquet(f"{path}/run={number}")
    return number
