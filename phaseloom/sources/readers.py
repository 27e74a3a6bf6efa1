"""Readers with declared schemas and sinks for result tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    """A table lacks required columns."""


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """All columns as strings, from files with a header; raises where required columns are missing."""
    return checked(spark.read.option("header", True).option("sep", sep).csv(path), required)


def checked(df: DataFrame, required: list[str]) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise MissingColumnsError(f"missing columns: {missing}")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON-lines files; blank and malformed lines are passed over."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).filter(F.col("_bad").isNull()).drop("_bad")


def tail(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n events."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def discover(spark: SparkSession, path: str, pattern: str, largest: int, ignored: list[str]) -> DataFrame:
    """(path, size): files under path by name pattern, without ignored folders and larger files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    for name in ignored:
        files = files.filter(~F.contains("path", F.lit(f"/{name}/")))
    return files.filter(F.col("size") <= largest)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, title): whole files; the title is the first heading or else the first line."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.split_part("text", F.lit("\n"), F.lit(1)))
    return t.withColumn("title", F.trim(title))


def column_statistics(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """(file, n, mean, std) of headerless numeric files with at least so many rows."""
    v = spark.read.schema("v double").csv(path).select(F.col("_metadata.file_name").alias("file"), "v")
    return v.groupBy("file").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).filter(F.col("n") >= least)


def write_report(df: DataFrame, path: str, form: str = "csv", list_sep: str = "; ") -> None:
    """Append a table as CSV, JSON or Parquet; CSV gets arrays joined into one cell."""
    if form == "csv":
        df = df.select(*(F.array_join(F.col(c).cast("array<string>"), list_sep).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
        df.write.mode("append").option("header", True).csv(path)
    else:
        df.write.mode("append").format(form).save(path)


def as_markdown(records: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(title, markdown): one document for each record."""
    lines = [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("n/a"))) for f in fields]
    return records.select(F.col(title).alias("title"), F.concat_ws("\n", F.concat(F.lit("# "), F.col(title).cast("string")), *lines).alias("markdown"))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset and Spark runs on one machine, as in tests, a temporary folder is used; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/phaseloom-{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, what: str = "table") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it ends, for jobs that run round by round; the session's own choice is put back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
