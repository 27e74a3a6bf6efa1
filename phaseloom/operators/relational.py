"""Joins with contracts, reports and profiles over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import ordered
from phaseloom.sources.readers import checkpointed


class JoinContractError(ValueError):
    """A strict join met duplicate keys or rows without a partner."""


def violations(left: DataFrame, right: DataFrame, keys: list[str], unique_left: bool = True) -> DataFrame:
    """(keys, violation): keys that stand twice on a side, or on the left only."""
    twice = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.lit(name).alias("violation"))
    out = twice(right, "duplicate_right").unionByName(left.select(*keys).join(right, keys, "left_anti").distinct().withColumn("violation", F.lit("missing_right")))
    return out.unionByName(twice(left, "duplicate_left")) if unique_left else out


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one inner join; raises where a key stands twice or a left row has no partner. Extra right rows are dropped."""
    if bad := violations(left, right, keys).take(5):
        raise JoinContractError(f"join keys violate the contract: {bad}")
    return left.join(right, keys)


def strict_lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Many-to-one inner join; raises where a right key stands twice or a left row has no partner."""
    if bad := violations(left, right, keys, unique_left=False).take(5):
        raise JoinContractError(f"join keys violate the contract: {bad}")
    return left.join(right, keys)


def join_quality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_missing, n_extra, n_left_duplicates, n_right_duplicates."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    twice = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    parts = [one(left.join(right.select(*keys), keys, "left_anti"), "n_missing"), one(right.join(left.select(*keys), keys, "left_anti"), "n_extra"), one(twice(left), "n_left_duplicates"), one(twice(right), "n_right_duplicates")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def align_labels(rows: DataFrame, meta: DataFrame, key: str, value: str, positive: list, negative: list) -> DataFrame:
    """(key, alignment_status, y): rows with the single label their key has, or the reason why there is none."""
    g = meta.groupBy(key).agg(F.countDistinct(value).alias("n"), F.max(value).alias("v"))
    known = F.col("v").isin(positive + negative)
    status = F.when(F.col("n").isNull(), "no_match").when(F.col("n") > 1, "conflicting_labels").when(known, "aligned").otherwise("unknown_value")
    y = F.when((F.col("n") == 1) & known, F.col("v").isin(positive).cast("int"))
    return rows.join(g, key, "left").select(key, status.alias("alignment_status"), y.alias("y"))


def inject_targets(rows: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """rows with y, where the labels of a key agree, and rejected, where they do not."""
    g = labels.groupBy(key).agg(F.when(F.countDistinct(value) == 1, F.min(value)).alias("y"), (F.countDistinct(value) > 1).alias("rejected"))
    return rows.join(g, key, "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], row: str, t: str, other: str, tolerance: float) -> DataFrame:
    """left rows with the nearest right row in time within the tolerance, and the gap; earlier ones win ties.

    Both sides lie in one order of time; each left row meets the last right row before it and the first one after it, of
    its range or carried into it, and no other. Of right rows of one time the least in all columns counts. Rows with a null
    key or time find nothing.
    """
    time = lambda df, c, mine: df.select(*keys, F.col(c).cast("double").alias("__t"), F.struct(*mine.columns).alias("__l") if mine is left else F.lit(None).alias("__l"), F.struct(*mine.columns).alias("__r") if mine is right else F.lit(None).alias("__r"))
    known = lambda df, c: df.filter(F.expr(" and ".join(f"`{k}` is not null" for k in [*keys, c])))
    both = time(known(left, t), t, left).unionByName(time(known(right, other), other, right))
    r = ordered.ranges(both, keys, ["__t"])
    r = r.withColumn("__r", F.min("__r").over(W.partitionBy("__part", *keys, "__t")))  # rows of one time lie in one range
    right_only = F.when(F.col("__r").isNotNull(), F.struct("__t", "__r"))
    r = ordered.last_known(r, keys, ["__t"], right_only, "__behind")
    r = ordered.last_known(r, keys, ["__t"], right_only, "__ahead", ahead=True).filter(F.col("__l").isNotNull())
    gap = lambda c: F.abs(F.col(c)["__t"] - F.col("__t"))
    best = F.when(F.col("__ahead").isNull() | (gap("__behind") <= gap("__ahead")), F.col("__behind")).otherwise(F.col("__ahead"))
    r = r.withColumn("__b", best).withColumn("gap", gap("__b")).filter(F.col("gap") <= tolerance)
    return r.select(*(F.col("__l")[c].alias(c) for c in left.columns), *(F.col("__b")["__r"][c].alias(c) for c in right.columns if c not in keys), "gap")


def best_offset(left: DataFrame, right: DataFrame, keys: list[str], row: str, t: str, other: str, tolerance: float, offsets: list[float]) -> DataFrame:
    """(offset, matched): for each clock offset, how many left rows find a partner."""
    shifted = left.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn(t, F.col(t) + F.col("offset"))
    found = nearest_join(shifted.withColumn("__id", F.struct(row, "offset")), right, keys, "__id", t, other, tolerance)
    return found.groupBy("offset").agg(F.count("*").alias("matched"))


def interval_masks(events: DataFrame, t: str, condition: str, lo: float, hi: float) -> DataFrame:
    """(tr, n_conditions, cond): whole samples in [t+lo, t+hi] of any event; cond is null where conditions overlap."""
    first, last = F.ceil(F.col(t) + lo), F.floor(F.col(t) + hi)
    m = events.filter(first <= last).select(F.col(condition).alias("c"), F.explode(F.sequence(first, last)).alias("tr"))
    return m.groupBy("tr").agg(F.countDistinct("c").alias("n_conditions"), F.when(F.countDistinct("c") == 1, F.min("c")).alias("cond"))


def dangling(rows: DataFrame, fk: str, parents: DataFrame, pk: str, row: str, name: str) -> DataFrame:
    """(violation, id): rows whose foreign key has no parent."""
    lost = rows.join(parents.select(F.col(pk).alias("__pk")), rows[fk] == F.col("__pk"), "left_anti")
    return lost.select(F.lit(name).alias("violation"), F.col(row).cast("string").alias("id"))


def metric_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, n, mean_v, std_v, min_v, max_v)."""
    u = df.unpivot(keys, metrics, "metric", "v")
    return u.groupBy(*keys, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def column_profile(df: DataFrame, columns: list[str], categories: int = 20) -> DataFrame:
    """(col, n, n_filled, n_distinct, kind) of each column."""
    u = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "col", "v")
    n = F.countDistinct("v")
    return u.groupBy("col").agg(F.count("*").alias("n"), F.count_if(F.trim("v") != "").alias("n_filled"), n.alias("n_distinct"), F.when(n == 2, "binary").when(n <= categories, "categorical").otherwise("free").alias("kind"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """(order, kept, duplicate): the first row of each key is kept; order is unique. Null keys are one key."""
    rows = df.select(order, F.struct(key).alias("__key"))
    kept = dealt_join(rows, rows.groupBy("__key").agg(F.min(order).alias("kept")), "__key", F.col(order))
    return kept.select(order, "kept", (F.col(order) != F.col("kept")).alias("duplicate"))


def ranked(df: DataFrame, score: str, tie: str, name: str) -> DataFrame:
    """df with its place by falling score, from a distributed sort: places within ranges of the score, then a prefix sum.

    The ranged table is written once, so that both uses of its partition numbers see the same ranges.
    """
    s = checkpointed(df.repartitionByRange(F.desc(score), F.asc(tie)).withColumn("__part", F.spark_partition_id()), "ranged")
    s = s.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(F.desc(score), tie)))
    sizes = s.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return s.join(F.broadcast(before), "__part").withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__in", "__before")


def dealt_join(many: DataFrame, few: DataFrame, key: str, by: Column, ways: int = 8) -> DataFrame:
    """Inner join where a key may hold a large part of many: its rows are dealt to so many places, few is repeated for each."""
    left = many.withColumn("__place", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    return left.join(few.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [key, "__place"]).drop("__place")


def probe_epochs(events: DataFrame, key: str, t: str, is_probe: Column, is_sample: Column, row: str, value: str, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Probes with an epoch, from the probe before (not included) to their own, of `least` at least; and (row, n, total) of the samples in each.

    Every sample goes to the next probe of its key along the order of time, so none meets more than one probe, and a key's
    rows lie in as many ranges as they need.
    """
    marked = events.withColumn("__probe", F.when(is_probe, F.col(row))).withColumn("__after", F.col("__probe").isNotNull()).withColumn("__sample", is_sample)
    ranged = ordered.ranges(marked.filter(F.col("__after") | F.col("__sample")), [key], [t, "__after", row])
    ranged = ordered.last_known(ranged, [key], [t, "__after", row], F.col("__probe"), "__next", ahead=True)
    samples = ranged.filter(F.col("__sample") & F.col("__next").isNotNull())
    held = samples.groupBy(F.col("__next").alias(row)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    only = ordered.ranges(events.filter(is_probe), [key], [t, row])
    by = W.partitionBy("__part", key).orderBy(t, row)
    # the probe before: in the range, or the last one of the ranges before, which the first row of the range gets
    only = only.withColumn("__i", F.row_number().over(by)).withColumn("__in", F.lag(t).over(by))
    last = only.groupBy("__part", key).agg(F.max(t).alias("__e"))
    carried = last.withColumn("__carry", F.max("__e").over(W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    only = ordered.with_carry(only, [key], carried).withColumn("__p", F.coalesce("__in", F.when(F.col("__i") == 1, F.col("__carry"))))
    return only.filter(F.col("__p").isNotNull() & (F.col(t) - F.col("__p") >= least)).select(*events.columns), held
