"""Views of the driver's tables that feed the operators, and the same views as DuckDB statements for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import wrap_phase
from phaseloom.operators.surrogates import places

CHANNELS = 8
#: Sensors on a 4 x 2 lattice and the triangles between them.
SENSORS = [(c, float(c % 4), float(c // 4), "left" if c % 4 < 2 else "right") for c in range(CHANNELS)]
TRIANGLES = [(0, 0, 1, 4), (1, 1, 5, 4), (2, 1, 2, 5), (3, 2, 6, 5), (4, 2, 3, 6), (5, 3, 7, 6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, dealt to all cores where the scan gives them fewer pieces.

    Spark cuts scans into pieces of 4 MB or of a core's share, whichever is more, so only a small table, or one in files
    that cannot be cut, has fewer pieces than there are cores; a large one is left as it is.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def rounded_double(col: Column, digits: int = 6) -> Column:
    """A double rounded as the statements do it: its product with a power of ten is; F.round goes by the shortest decimal of the double."""
    return F.round(col * 10.0**digits, 0) / 10.0**digits


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, channel, n, v): one series for each event type and channel.

    Samples are numbered within days and the samples of the days before are added, so that no task gets a whole series.
    """
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording_id"), (F.col("user_id") % CHANNELS).alias("channel"), "ts", "event_id", F.col("value").alias("v"))
    e = e.withColumn("day", F.to_date("ts"))
    series = ["recording_id", "channel", "day"]
    days = e.groupBy(*series).agg(F.count("*").alias("held"))
    days = days.withColumn("before", F.coalesce(F.sum("held").over(W.partitionBy("recording_id", "channel").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("held")
    n = F.row_number().over(W.partitionBy(*series).orderBy("ts", "event_id")) - 1
    return e.withColumn("i", n).join(days, series).select("recording_id", "channel", (F.col("i") + F.col("before")).cast("int").alias("n"), "v")


def _dealt(s: DataFrame, keys: list[str]) -> DataFrame:
    """Samples dealt by window to a number of places that is given.

    What follows works within windows where they are and makes many rows of each, which the bytes of the samples do not
    show: left to them, Spark would put all windows into one or two tasks.
    """
    return s.repartition(places(s.sparkSession), *keys)


def windowed(spark: SparkSession, sf_dir: str, length: int = 16) -> DataFrame:
    """(recording_id, w, channel, k, v): samples of complete windows, those in which every channel has all samples."""
    s = samples(spark, sf_dir).select("recording_id", F.floor(F.col("n") / length).cast("int").alias("w"), "channel", (F.col("n") % length).cast("int").alias("k"), "v")
    full = F.count("*").over(W.partitionBy("recording_id", "w"))
    return _dealt(s, ["recording_id", "w"]).withColumn("__n", full).filter(F.col("__n") == CHANNELS * length).drop("__n")


def channel_windows(spark: SparkSession, sf_dir: str, length: int = 16) -> DataFrame:
    """(recording_id, w, channel, k, v): each channel's own complete windows, whether or not the others have them."""
    s = samples(spark, sf_dir).select("recording_id", F.floor(F.col("n") / length).cast("int").alias("w"), "channel", (F.col("n") % length).cast("int").alias("k"), "v")
    full = F.count("*").over(W.partitionBy("recording_id", "w", "channel"))
    return _dealt(s, ["recording_id", "w", "channel"]).withColumn("__n", full).filter(F.col("__n") == length).drop("__n")


def phase(spark: SparkSession, sf_dir: str, length: int = 16) -> DataFrame:
    """windowed() with theta, the value as a phase, and amp."""
    return windowed(spark, sf_dir, length).select("recording_id", "w", "channel", "k", wrap_phase(F.col("v")).alias("theta"), F.abs("v").alias("amp"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, z, i, j, theta, amp): phase and amplitude on an 8 x 8 grid for each time and slice."""
    li = table(spark, sf_dir, "lineitem")
    cell = li.groupBy(F.year("l_shipdate").alias("t"), F.col("l_linenumber").alias("z"), (F.col("l_partkey") % 8).alias("i"), (F.col("l_suppkey") % 8).alias("j"))
    return cell.agg(wrap_phase(F.sum("l_quantity")).alias("theta"), (F.avg("l_discount") * 4).alias("amp"))


def sensor(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSORS, "channel long, x double, y double, region string")


def triangle(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRIANGLES, "tri_id int, v0 long, v1 long, v2 long")


def _wrap(x: str) -> str:
    return f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


_SENSOR = ", ".join(f"({c}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), '{r}')" for c, x, y, r in SENSORS)
_TRIANGLE = ", ".join(str(t) for t in TRIANGLES)
VIEWS = {
    "samples": "SELECT event_type AS recording_id, user_id % 8 AS channel, row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY ts, event_id) - 1 AS n, value AS v FROM events",
    "windowed":
            "SELECT recording_id, w, channel, k, v FROM (SELECT recording_id, CAST(n // 16 AS INTEGER) AS w, channel, CAST(n % 16 AS INTEGER) AS k, v, count(*) "
            "OVER (PARTITION BY recording_id, n // 16) AS c FROM samples) WHERE c = 128"
,
    "windowed@own":
            "SELECT recording_id, w, channel, k, v FROM (SELECT recording_id, CAST(n // 16 AS INTEGER) AS w, channel, CAST(n % 16 AS INTEGER) AS k, v, count(*) "
            "OVER (PARTITION BY recording_id, channel, n // 16) AS c FROM samples) WHERE c = 16"
,
    "phase": f"SELECT recording_id, w, channel, k, {_wrap('v')} AS theta, abs(v) AS amp FROM windowed",
    "field":
            f"SELECT CAST(t AS INTEGER) AS t, z, i, j, {_wrap('s')} AS theta, amp FROM (SELECT year(l_shipdate) AS t, l_linenumber AS z, l_partkey % 8 AS i, "
            f"l_suppkey % 8 AS j, sum(l_quantity) AS s, avg(l_discount) * 4 AS amp FROM lineitem GROUP BY ALL)"
,
    "sensor": f"SELECT * FROM (VALUES {_SENSOR}) s(channel, x, y, region)",
    "triangle": f"SELECT * FROM (VALUES {_TRIANGLE}) t(tri_id, v0, v1, v2)",
    "plaquette":
            f"SELECT a.t, a.z, a.i, a.j, ({_wrap('b.theta - a.theta')} + {_wrap('c.theta - b.theta')} + {_wrap('d.theta - c.theta')} + "
            f"{_wrap('a.theta - d.theta')}) / (2 * pi()) AS q, (a.amp + b.amp + c.amp + d.amp) / 4 AS patch FROM field a JOIN field b ON b.t = a.t AND b.z = a.z "
            f"AND b.i = a.i + 1 AND b.j = a.j JOIN field c ON c.t = a.t AND c.z = a.z AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN field d ON d.t = a.t AND d.z = a.z "
            f"AND d.i = a.i AND d.j = a.j + 1"
,
    "qzt": "SELECT t, z, CAST(rint_q AS INTEGER) AS q, q_abs FROM (SELECT t, z, round_even(sum(q), 0) AS rint_q, sum(abs(q)) AS q_abs FROM plaquette GROUP BY t, z)",
    "winding":
            f"SELECT p0.recording_id, p0.w, p0.k, tri_id, ({_wrap('p1.theta - p0.theta')} + {_wrap('p2.theta - p1.theta')} + {_wrap('p0.theta - p2.theta')}) / (2 * "
            f"pi()) AS winding, (abs({_wrap('p1.theta - p0.theta')}) + abs({_wrap('p2.theta - p1.theta')}) + abs({_wrap('p0.theta - p2.theta')})) / 3 AS gap, "
            f"least(p0.amp, p1.amp, p2.amp) AS low FROM triangle JOIN phase p0 ON p0.channel = v0 JOIN phase p1 ON p1.channel = v1 AND p1.recording_id = "
            f"p0.recording_id AND p1.w = p0.w AND p1.k = p0.k JOIN phase p2 ON p2.channel = v2 AND p2.recording_id = p0.recording_id AND p2.w = p0.w AND p2.k = p0.k"
,
}
_NEEDS = {"windowed": ["samples"], "windowed@own": ["samples"], "phase": ["windowed"], "plaquette": ["field"], "qzt": ["plaquette"], "winding": ["triangle", "phase"]}


def sql(body: str, *views: str) -> str:
    """A statement over the named views; body may begin with further CTEs, each ended by a comma, after 'AND WITH'. A name with @ is another form of the view before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    ctes = ", ".join(f"{v.split('@')[0]} AS ({VIEWS[v]})" for v in order)
    return f"WITH {ctes} {body}" if ctes else body
