"""Streams drained to their end give what the batch query gives."""

import datetime
import itertools
import random
import statistics

import duckdb
import pytest

from phaseloom.plans import catalog
from phaseloom.sources import readers
from phaseloom.streaming import jobs, stateful

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["st1_sensor_ingest", "st2_idempotent_log", "st3_windowed_metrics", "st4_sessions", "st5_change_points", "st5_trailing_drops", "st8_late_records"])
def test_stream_equals_batch(spark, name):
    df = catalog.queries()[name](spark, DIR)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{DIR}/events.parquet'")
    rel = db.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in names)) for r in rel.fetchall())
    assert got == want


def test_malformed_lines_are_passed_over(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "s": "x"}\n\n{broken\n{"k": 2, "s": "y"}\n')
    schema = spark.createDataFrame([(1, "x")], "k long, s string").schema
    assert sorted(r.k for r in readers.read_json_lines(spark, str(tmp_path), schema).collect()) == [1, 2]


def test_missing_columns_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert readers.read_delimited(spark, str(tmp_path), ["a"]).collect()[0].b == "2"
    with pytest.raises(readers.MissingColumnsError):
        readers.read_delimited(spark, str(tmp_path), ["a", "c"])


ROWS = "event_id long, user_id long, ts timestamp, value double, event_type string"


def _feed(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def _put(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def _made(seed=2):
    """Three files in order of arrival, out of order within twenty minutes, one key with most rows; late rows for the third."""
    rng = random.Random(seed)
    at, rows = datetime.datetime(2024, 1, 1), []
    for i in range(600):
        at += datetime.timedelta(minutes=rng.choice([1, 2, 5, 40, 200]))
        rows.append((i, 1 if i % 2 else rng.randrange(2, 6), at - datetime.timedelta(minutes=rng.randrange(20)), rng.random(), rng.choice("abc")))
    late = [(1000 + i, 1, rows[5][2], 99.0, "z") for i in range(3)]
    return rows[:200], rows[200:400], rows[400:], late


def _bursts(rows, gap):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[1], []).append(r[2])
    for user, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 1
        for t in times[1:]:
            if t - last >= gap:
                out.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((user, start, last, n))
    return sorted(out)


def _us(t):
    return int(t.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize("kind", ["sessions", "drops", "changes"])
def test_state_over_batches_a_restart_and_late_rows(spark, tmp_path, kind):
    first, second, third, late = _made()
    folder, keep = str(tmp_path / "feed"), str(tmp_path / "job")
    hour = jobs.HOUR
    make = {"sessions": lambda: stateful.Sessions(hour // 2), "drops": lambda: stateful.TrailingDrops(6 * hour, 4, 1.0), "changes": lambda: stateful.ChangePoints(6 * hour)}[kind]
    values = {"sessions": [], "drops": ["event_id", "value"], "changes": ["event_id", "event_type"]}[kind]
    _put(spark, folder, first)
    _put(spark, folder, second)
    early = stateful.StatefulJob(_feed(spark, folder), "user_id", values, make(), "1 hour", keep).run().collect()
    assert early  # what the watermark has passed is given before the feed ends
    _put(spark, folder, third + late)  # a new object goes on over the same folder
    job = stateful.StatefulJob(_feed(spark, folder), "user_id", values, make(), "1 hour", keep)
    middle = job.run().count()
    done = job.finish()
    assert len(early) < middle < done.count()
    rows = first + second + third
    if kind == "sessions":
        want = [(u, _us(a), _us(b), n) for u, a, b, n in _bursts(rows, datetime.timedelta(minutes=30))]
        assert sorted((r.user_id, r.start, r.end, r.n) for r in done.collect()) == want
        return
    want = {}
    for user in {r[1] for r in rows}:
        mine = sorted((r[2], r[0], r[3], r[4]) for r in rows if r[1] == user)
        if kind == "changes":
            want[user] = sum(a[3] != b[3] for a, b in itertools.pairwise(mine))
        else:
            v = [x[2] for x in mine]
            want[user] = sum((v[i] - statistics.mean(v[i - 4 : i])) / (statistics.pstdev(v[i - 4 : i]) + 1e-12) < -1 for i in range(4, len(v)))
    got = {}
    for r in done.collect():
        got[r.user_id] = got.get(r.user_id, 0) + r.found
    assert got == want and sum(r.n for r in done.collect()) == len(rows)
