"""Structured Streaming jobs over the events feed, each run over all available files and read back.

The feed is the events table as files; its times are cast to timestamps in UTC. Sinks and checkpoints lie in the folder
that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.sources.readers import shared_path
from phaseloom.streaming.stateful import ChangePoints, Sessions, StatefulJob, TrailingDrops

HOUR = 3_600_000_000

_shared = shared_path


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; ts is an event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and read it."""
    spark = out.sparkSession
    path = _shared(spark, "stream")
    out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", _shared(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def gathered(out: DataFrame, fold: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Run a stream whose final table is wanted, windows that are still open included: each batch's update replaces its rows by key."""
    spark = out.sparkSession
    path = _shared(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/__batch={number}")  # a batch that is run again replaces itself

    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", _shared(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "__batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in values))


def sensor_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sensor_id, q, q_abs): a metrics row for each record, from its payload."""
    e = feed(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return drained(e.select("event_id", F.col("user_id").alias("sensor_id"), F.round(F.col("value") / 10 - k, 6).alias("q"), F.round(F.abs(F.col("value") / 10 - k), 6).alias("q_abs")))


def idempotent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_hash, event_type): a feed that is replayed gives each event once."""
    e = feed(spark, sf_dir)
    twice = e.union(e).withWatermark("ts", "40 days")
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")), 256)
    return drained(twice.withColumn("event_hash", digest).dropDuplicatesWithinWatermark(["event_hash"]).select("event_hash", "event_type"))


def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, start, n, r): count and phase order of each day."""
    c, s = F.avg(F.cos("value")), F.avg(F.sin("value"))
    w = feed(spark, sf_dir).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "1 day"))
    out = w.agg(F.count("*").alias("n"), F.round(F.sqrt(c * c + s * s), 6).alias("r")).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "r")
    return _latest(gathered(out), ["event_type", "start"])


def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, start, n): counts of two days, every day."""
    w = feed(spark, sf_dir).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "2 days", "1 day"))
    out = w.agg(F.count("*").alias("n")).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    return _latest(gathered(out), ["event_type", "start"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, start, n): bursts of a user's events with gaps of under six hours, closed by timers; the last ones by the feed's end."""
    job = StatefulJob(feed(spark, sf_dir), "user_id", [], Sessions(6 * HOUR), "1 hour")
    job.run()
    return job.finish().select("user_id", F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, n, mean_value, hit_rate, p95): latency statistics of each day."""
    w = feed(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"))
    out = w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg((F.col("event_type") == "view").cast("double")), 6).alias("hit_rate"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))
    return _latest(gathered(out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "mean_value", "hit_rate", "p95")), ["day"])


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, n_rows): one row for each subject of the files that are new, batch by batch."""
    rows = gathered(feed(spark, sf_dir).select(F.col("user_id").alias("subject_id")), lambda b: b.groupBy("subject_id").agg(F.count("*").alias("n")))
    return rows.groupBy("subject_id").agg(F.sum("n").alias("n_rows"))


def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, n, n_late): records that lie more than 20 days behind the newest one of their batch or before."""
    return _late(spark, sf_dir)[0]


def late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, days_late): the late records themselves."""
    return _late(spark, sf_dir)[1]


def _late(spark: SparkSession, sf_dir: str, days: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts and late records. The newest time of each batch is stored beside its counts: a job that starts again reads it there."""
    counts, late = _shared(spark, "counts"), _shared(spark, "late")

    def mark(batch: DataFrame, number: int) -> None:
        times = batch.agg(F.max(F.unix_micros("ts")).alias("newest"))
        if number:  # the batches before, of which each left one row
            before = spark.read.parquet(f"{counts}/newest").filter(F.col("__batch") < number)
            times = times.unionByName(before.select("newest")).agg(F.max("newest").alias("newest"))
        times.write.mode("overwrite").parquet(f"{counts}/newest/__batch={number}")
        newest = spark.read.parquet(f"{counts}/newest/__batch={number}")
        behind = F.floor((F.col("newest") - F.unix_micros("ts")) / 86_400_000_000)
        is_late = F.unix_micros("ts") < F.col("newest") - days * 86_400_000_000
        rows = batch.crossJoin(F.broadcast(newest))  # one row
        rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(is_late).alias("n_late")).write.mode("overwrite").parquet(f"{counts}/rows/__batch={number}")
        rows.filter(is_late).select("event_id", "event_type", behind.alias("days_late")).write.mode("overwrite").parquet(f"{late}/__batch={number}")

    e = feed(spark, sf_dir).select("event_id", "event_type", "ts")
    e.writeStream.foreachBatch(mark).option("checkpointLocation", _shared(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    total = spark.read.parquet(f"{counts}/rows").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))
    return total, spark.read.parquet(late).drop("__batch")


SQL = {
    "st1_sensor_ingest":
            "SELECT event_id, user_id AS sensor_id, round(value / 10 - CAST(props->>'$.k' AS INTEGER), 6) + 0.0 AS q, round(abs(value / 10 - CAST(props->>'$.k' AS "
            "INTEGER)), 6) AS q_abs FROM events"
,
    "st2_idempotent_log": "SELECT DISTINCT sha256(event_id || '|' || event_type || '|' || user_id) AS event_hash, event_type FROM events",
    "st3_windowed_metrics":
            "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sqrt(power(avg(cos(value)), 2) + "
            "power(avg(sin(value)), 2)), 6) AS r FROM events GROUP BY ALL"
,
    "st3_sliding_metrics":
            "SELECT event_type, strftime(date_trunc('day', ts) - CAST(o AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, "
            "range(2) r(o) GROUP BY ALL"
,
    "st7_backfill": "SELECT user_id AS subject_id, count(*) AS n_rows FROM events GROUP BY ALL",
    "st4_sessions":
            "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 "
            "END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, "
            "strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM b GROUP BY user_id, burst"
,
    "st8_late_side_output":
            "SELECT event_id, event_type, CAST(floor((epoch_us(m) - epoch_us(ts)) / 86400000000) AS BIGINT) AS days_late FROM events, (SELECT max(ts) AS m FROM "
            "events) WHERE ts < m - INTERVAL 20 DAY"
,
    "st8_late_records": "SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY) AS BIGINT) AS n_late FROM events GROUP BY ALL",
}


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n_changes): how often a user's event type differs from the one before, a day at a time."""
    job = StatefulJob(feed(spark, sf_dir), "user_id", ["event_id", "event_type"], ChangePoints(24 * HOUR), "1 day")
    job.run()
    return job.finish().groupBy("user_id").agg(F.sum("found").alias("n_changes"))


def trailing_drops(spark: SparkSession, sf_dir: str, lag: int = 8, z: float = 1.0) -> DataFrame:
    """(user_id, n_drops): how often a user's value falls z population deviations below the mean of its last `lag` values."""
    job = StatefulJob(feed(spark, sf_dir), "user_id", ["event_id", "value"], TrailingDrops(24 * HOUR, lag, z), "1 day")
    job.run()
    return job.finish().groupBy("user_id").agg(F.sum("found").alias("n_drops"))


SQL["st5_trailing_drops"] = "WITH w AS (SELECT user_id, value, avg(value) OVER t AS m, stddev_pop(value) OVER t AS s, count(*) OVER t AS c FROM events WINDOW t AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT user_id, count(*) FILTER (WHERE c = 8 AND (value - m) / (s + 1e-12) < -1) AS n_drops FROM w GROUP BY user_id"
