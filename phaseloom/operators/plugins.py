"""Plug-in points: statistics, per-subject jobs and adapters of foreign records, and p values of test statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.sources.readers import shared_path

#: Statistics of two groups by name: aggregates of two columns that are null outside their group.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "mean_difference": lambda a, b: F.avg(a) - F.avg(b),
    "median_difference": lambda a, b: F.percentile(a, 0.5) - F.percentile(b, 0.5),
    "spread_ratio": lambda a, b: F.stddev_samp(a) / F.stddev_samp(b),
}


def subject_job(rows: DataFrame, subject: str, job: Callable[[pd.DataFrame], float]) -> DataFrame:
    """(subject, status, error, result): job over the rows of each subject; a failure is a row, the others go on.

    A subject's rows come to one task as a frame: subjects are the unit that a job is written for.
    """
    kind = dict(rows.dtypes)[subject]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[subject].iloc[0]
        try:
            out = (key, "done", None, float(job(pdf)))
        except Exception as e:  # noqa: BLE001
            out = (key, "error", str(e), None)
        return pd.DataFrame([out], columns=[subject, "status", "error", "result"])

    return rows.groupBy(subject).applyInPandas(run, f"{subject} {kind}, status string, error string, result double")


def written(df: DataFrame, kind: str, **options: str) -> str:
    """The path of df, written in a format to the shared folder."""
    path = shared_path(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


def read_literature(spark: SparkSession, atom: str, records: str) -> DataFrame:
    """(adapter, record_id, title, authors, year, url): Atom feeds and JSON records in one form; unknown years are null."""
    a = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, published string, author array<struct<name:string>>, link struct<_href:string>").load(atom)
    a = a.select(F.lit("atom").alias("adapter"), F.col("id").alias("record_id"), "title", F.array_join(F.transform("author", lambda x: x["name"]), "; ").alias("authors"), F.substring("published", 1, 4).try_cast("int").alias("year"), F.col("link._href").alias("url"))
    j = spark.read.schema("id string, title string, publication_year int, authors array<string>, landing_page_url string").json(records)
    j = j.select(F.lit("json").alias("adapter"), F.col("id").alias("record_id"), "title", F.array_join("authors", "; ").alias("authors"), F.col("publication_year").alias("year"), F.col("landing_page_url").alias("url"))
    return a.unionByName(j)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def f_tail(f: float, k: float, n: float) -> float:
    """P(F >= f) with k and n degrees of freedom."""
    return beta_share(n / (n + k * f), n / 2, k / 2)


def correlation_test(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, r, t, p): Pearson correlation over complete pairs, three at least, with a two-sided p from Student's t.

    p is worked out on the aggregated rows, one a key.
    """
    g = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).filter("n >= 3")
    g = g.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") ** 2, F.lit(0.0))))
    tail = F.pandas_udf(lambda t, n: pd.Series([None if pd.isna(x) else f_tail(x * x, 1, m - 2) for x, m in zip(t, n, strict=True)], dtype="float64"), "double")
    return g.withColumn("p", tail("t", "n"))
