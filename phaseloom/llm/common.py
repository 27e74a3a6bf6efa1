"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir; where that is unset and Spark runs on one machine, as in tests, a
    temporary folder is made and set as the context's checkpoint folder. On a cluster that is an error.
    """
    return f"{checkpoint_root(spark)}/phaseloom-{what}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, what: str, rows_a_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    rows_a_file: for rows of megabytes. The writer holds a hundred rows before it looks at their bytes, the reader up to
    4,096 of a file; a file of few rows bounds both.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as none of the columns has it, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str = "inner", ways: int = 16) -> DataFrame:
    """Join on keys where one key may hold a large part of many's rows: they are dealt to so many places by another value.

    few, which has one row a key, is repeated for each place.
    """
    left = many.withColumn("__place", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    right = few.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [*keys, "__place"], how).drop("__place")


def hot_join(many: DataFrame, few: DataFrame, key: str, by: Column, limit: int | None = None, how: str = "inner", size: str = "", ways: int = 16) -> DataFrame:
    """Join on a key of which few has one row; keys with over limit rows in many are dealt to several places by a value of many.

    The keys over limit, of which there are many's rows / limit at most, are looked up first: the caller's limit bounds
    what the driver gets and what is broadcast, and where there are none the join is a plain one. size: a column of few
    that holds a key's rows in many, if it has one; many and few should be stored tables. No limit: hot_limit() of many's
    rows.
    """
    limit = hot_limit(many.count()) if limit is None else limit
    counts = few.select(key, F.col(size).alias("__n")) if size else many.groupBy(key).agg(F.count("*").alias("__n"))
    found = counts.filter(F.col("__n") > limit).select(key).collect()
    if not found:
        return many.join(few, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, T.StructType([many.schema[key]])).withColumn("__hot", F.lit(True)))
    left = many.join(hot, key, "left").withColumn("__place", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).otherwise(0)).drop("__hot")
    places = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(hot, key, "left").withColumn("__place", F.explode(places)).drop("__hot")
    return left.join(right, [key, "__place"], how).drop("__place")


#: Keys with more than this share of all rows are dealt to several places; it bounds their number.
HOT_SHARE, HOT_LEAST = 5_000, 500


def hot_limit(rows: int) -> int:
    return max(HOT_LEAST, rows // HOT_SHARE)


def slices(batch: pa.RecordBatch, column: str | int, most: int = 4_000_000, rows: int = 5_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes in the named column and so many rows; a longer value is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def give_back() -> None:
    """Hand unused memory back at the end of a task: a worker that is used again keeps its size otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
