"""Running sums and last known values along an order, over ranges of it.

A table is dealt to ranges of (keys, order) and written once. Windows lie within a range; what a key's rows in the ranges
before add to a range is carried over, one row a range at most, since the rows of a key lie in neighbouring ranges and
only the first key of a range can have rows before it. So no task gets a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.sources.readers import checkpointed


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df, stored, with __part: rows in ranges of (keys, order); rows that agree in both lie in one."""
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def with_carry(ranged: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """carry(__part, keys, __carry) joined to the rows of its range and key."""
    few = F.broadcast(carry.filter("__carry is not null").select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k_{k}") for k in keys), "__carry"))  # a row a range at most
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return ranged.join(few, on, "left").drop("__p", *(f"__k_{k}" for k in keys))


def running_sum(ranged: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """ranged with name: the sum of value over the key's rows before each row; 0 for the first."""
    rows = ranged.withColumn("__v", value)
    sums = rows.groupBy("__part", *keys).agg(F.sum("__v").alias("__s"))
    carry = sums.withColumn("__carry", F.sum("__s").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    within = F.sum("__v").over(W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0)
    return with_carry(rows.withColumn("__w", within), keys, carry).withColumn(name, F.coalesce("__w", zero) + F.coalesce("__carry", zero)).drop("__v", "__w", "__carry")


def last_known(ranged: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """ranged with name: the last non-null value at or before each row of its key; with ahead the first at or after it."""
    rows = ranged.withColumn("__v", value)
    by = [F.desc_nulls_last(c) if ahead else F.asc_nulls_first(c) for c in order]
    at = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    ends = rows.filter(F.col("__v").isNotNull()).groupBy("__part", *keys).agg(pick("__v", at).alias("__e"))
    parts = rows.groupBy("__part", *keys).agg(F.lit(None).cast(rows.schema["__v"].dataType).alias("__e")).unionByName(ends).groupBy("__part", *keys).agg(F.first("__e", ignorenulls=True).alias("__e"))
    along = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__part") if ahead else F.asc("__part")).rowsBetween(W.unboundedPreceding, -1)
    carry = parts.withColumn("__carry", F.last("__e", ignorenulls=True).over(along))
    within = F.last("__v", ignorenulls=True).over(W.partitionBy("__part", *keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return with_carry(rows.withColumn("__w", within), keys, carry).withColumn(name, F.coalesce("__w", "__carry")).drop("__v", "__w", "__carry")
