"""Estimators without a statement against plain computations: spectra, mixed effects, grids, graphs, states, jobs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import clusters as cl
from phaseloom.operators import complexity as cx
from phaseloom.operators import contracts as ct
from phaseloom.operators import evaluation as ev
from phaseloom.operators import montage as mt
from phaseloom.operators import nulls as nl
from phaseloom.operators import surrogates as sg
from phaseloom.plans import catalog
from phaseloom.plans.views import SENSORS, TRIANGLES
from phaseloom.sources import readers

DIR = "/root/testdata/sf0.001"


def _mfdfa(v, powers):
    """The same estimate by loops over boxes."""
    n, y = len(v), np.cumsum(v - v.mean())
    lags = sorted({math.floor(10 ** (0.7 + i * (math.log10(n / 4) - 0.7) / 29) + 1e-9) for i in range(30)})
    rows = []
    for s in (s for s in lags if s > 2):
        f2 = []
        for start in (0, n % s):
            for lo in range(start, n - s + 1, s):
                t = np.arange(s)
                f2.append(np.mean((y[lo : lo + s] - np.polyval(np.polyfit(t, y[lo : lo + s], 1), t)) ** 2))
        rows.append([np.log(np.mean(np.maximum(f2, 1e-30) ** (q / 2))) / q for q in powers])
    used = np.log([s for s in lags if s > 2])
    h = np.polyfit(used, np.array(rows), 1)[0]
    q = np.array(powers)
    return h, np.gradient(q * h - 1) / np.gradient(q)


def test_multifractal_spectrum(spark):
    v = np.random.default_rng(1).standard_normal(1100).cumsum() * 0.1 + np.random.default_rng(2).standard_t(3, 1100)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("short", i, 1.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, n long, v double").repartition(3)
    s = cx.multifractal(df, ["k"], "n", "v").cache()
    h, alpha = _mfdfa(v, cx.POWERS)
    got = s.filter("k = 'a'").orderBy("q").collect()
    assert np.allclose([r.h for r in got], h, rtol=1e-6) and np.allclose([r.alpha for r in got], alpha, rtol=1e-6)
    width = {r.k: (r.n, r.width) for r in cx.singularity_width(s, ["k"]).collect()}
    assert width["a"] == (1100, pytest.approx(alpha.max() - alpha.min())) and width["short"] == (40, None)


def test_mixed_effect_maximises_the_restricted_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(x), float(1.5 * x + b + e)) for s, b in enumerate(rng.normal(0, 2, 12)) for x, e in zip(rng.normal(size=8 + s), rng.normal(size=8 + s), strict=True)]
    t = ev.mixed_effect(spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, 2.0)], "s int, x double, y double"), "s", "x", "y").first()
    s, x, y = (np.array(c) for c in zip(*rows, strict=True))
    design = np.column_stack([np.ones(len(x)), x])

    def reml(ratio):
        v = np.eye(len(x)) + ratio * (s[:, None] == s)
        inv = np.linalg.inv(v)
        info = design.T @ inv @ design
        b = np.linalg.solve(info, design.T @ inv @ y)
        var = (y - design @ b) @ inv @ (y - design @ b) / (len(x) - 2)
        return -0.5 * ((len(x) - 2) * np.log(var) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(info)[1]), b[1], np.sqrt(var * np.linalg.inv(info)[1, 1])

    best = max((reml(10**k) for k in np.linspace(-2, 3, 2001)), key=lambda r: r[0])
    assert np.allclose([t.effect, t.se], best[1:], rtol=1e-3) and t.converged and (t.n_obs, t.n_subjects) == (len(x), 12)
    assert t.p == pytest.approx(math.erfc(t.effect / t.se / math.sqrt(2)))
    within = ev.within_effect(spark.createDataFrame(rows, "s int, x double, y double"), "s", "x", "y").first()
    assert within.n_obs == len(x) and within.p == pytest.approx(math.erfc(abs(within.effect / within.se) / math.sqrt(2)))
    assert ev.mixed_effect(spark.createDataFrame([(1, 1.0, 1.0)], "s int, x double, y double"), "s", "x", "y").first().effect is None


def test_grid_weights_reproduce_linear_fields_inside_and_the_nearest_sensor_outside(spark):
    xy, triangles = np.array([(x, y) for _, x, y, _ in SENSORS]), [t[1:] for t in TRIANGLES]
    xs, ys = np.linspace(-0.5, 3.5, 9), np.linspace(-0.5, 1.5, 9)
    w = mt.grid_weights(xy, triangles, xs, ys)
    samples = spark.createDataFrame([("s", c, 2 * x - 3 * y + 1) for c, x, y, _ in SENSORS] + [("gap", 0, 1.0)], "k string, channel long, v double")
    got = {(r.k, r.i, r.j): r.v for r in mt.on_grid(samples, ["k"], "channel", "v", spark.createDataFrame(w, "i int, j int, sensor long, weight double")).collect()}
    for (i, x), (j, y) in itertools.product(enumerate(xs), enumerate(ys)):
        if 0 <= x <= 3 and 0 <= y <= 1:
            assert got["s", i, j] == pytest.approx(2 * x - 3 * y + 1)
        else:
            near = min(SENSORS, key=lambda s: ((s[1] - x) ** 2 + (s[2] - y) ** 2, s[0]))
            assert got["s", i, j] == pytest.approx(2 * near[1] - 3 * near[2] + 1)
    assert got["gap", 2, 3] is None and ("gap", 4, 4) not in got
    for i, j in {(i, j) for i, j, _, _ in w}:
        assert sum(v for a, b, _, v in w if (a, b) == (i, j)) == pytest.approx(1)


def test_graph_shape_of_known_graphs(spark):
    ring = [(i, (i + 1) % 6) for i in range(6)]
    graphs = {"ring": ring, "filled": [(0, 1), (1, 2), (0, 2)], "pair": [(0, 1)], "none": []}
    rows = [(g, min(e), max(e), 1.0) for g, es in graphs.items() for e in es] + [(g, 4, 5, 0.1) for g in graphs]
    got = {r.g: (r.beta0, r.beta1, r.spectral_dimension) for r in sg.graph_shape(spark.createDataFrame(rows, "g string, a int, b int, w double"), ["g"], "w", 0.5, 6).collect()}
    assert got["ring"][:2] == (1, 1) and got["filled"][:2] == (4, 0) and got["pair"] == (5, 0, 0.0) and got["none"] == (6, 0, 0.0)
    lap = 2 * np.eye(6)
    for a, b in ring:
        lap[a, b] = lap[b, a] = -1
    e = np.linalg.eigvalsh(lap)[1:]
    assert got["ring"][2] == pytest.approx(2 * np.polyfit(np.log(e), np.log(np.arange(1, 6)), 1)[0])


def _windows(spark, series):
    return spark.createDataFrame([("r", 0, c, k, float(x)) for c, v in enumerate(series) for k, x in enumerate(v)], "recording_id string, w int, channel long, k int, v double")


def test_parse_phase_and_predictability(spark):
    bits = [0, 0, 1, 0, 1, 1, 0, 1, 1, 1]  # 0 | 01 | 011 | 0111
    assert sg.lempel_ziv(_windows(spark, [bits]), ["recording_id", "w", "channel"]).first().complexity == pytest.approx(4 / 10)
    t = np.arange(32)
    z = {r.k: (r.theta, r.amp) for r in sg.analytic_signal(_windows(spark, [3 * np.cos(2 * np.pi * 4 * t / 32 + 0.5) + np.cos(2 * np.pi * 9 * t / 32)]), ["recording_id", "w", "channel"], 3, 5).collect()}
    assert all(z[k][1] == pytest.approx(3) and np.angle(np.exp(1j * (z[k][0] - 2 * np.pi * 4 * k / 32 - 0.5))) == pytest.approx(0, abs=1e-9) for k in range(32))
    rng = np.random.default_rng(5)
    a = rng.normal(size=60)
    b = np.append(0, a[:-1]) + 0.1 * rng.normal(size=60)
    f = {(r.source, r.target): r.f for r in sg.lagged_predictability(_windows(spark, [a, b]), ["recording_id", "w"]).collect()}
    assert f[0, 1] > 100 and f[1, 0] < 10


def test_microstates_of_two_maps(spark):
    rng = np.random.default_rng(7)
    maps = np.array([[1, -1, 1, -1], [1, 1, -1, -1]]) / 2
    strength = np.abs(np.sin(np.arange(40) * 0.9)) + 0.3
    series = np.array([maps[(k // 10) % 2] * strength[k] * rng.choice([-1, 1]) for k in range(40)]).T + 0.001 * rng.normal(size=(4, 40))
    rows = nl.microstates(_windows(spark, series), ["recording_id", "w"], 2, 3, sfreq=10.0).collect()
    assert sorted(round(r.coverage, 2) for r in rows) == [0.5, 0.5] and sum(r.explained_variance for r in rows) > 0.99
    assert all(r.mean_duration == pytest.approx(1.0) and r.occurrences_per_second == pytest.approx(0.5) for r in rows)


def test_states_and_clusters_of_the_registered_queries(spark):
    q = catalog.queries()
    windows = q["q3_kuramoto_order"](spark, DIR).count()
    states = q["q4_leading_states"](spark, DIR)
    assert states.count() == windows * 16 and {r.state for r in states.select("state").distinct().collect()} <= {0, 1, 2}
    metrics = q["q4_state_metrics"](spark, DIR)
    assert metrics.count() > 0
    held = q["w12_microstates"](spark, DIR).groupBy("recording_id").agg(F.sum("n_samples").alias("n")).agg(F.sum("n")).first()[0]
    assert held == windows * 16
    clusters = q["a16_dataset_clusters"](spark, DIR).collect()
    assert len({r.l_suppkey for r in clusters}) == len(clusters) and {r.cluster for r in clusters} <= {0, 1, 2}
    flags = q["c11_window_records"](spark, DIR).collect()
    assert len(flags) == windows and all(("loops" in r["flags"]) == (r.beta1 > 0) and ("split" in r["flags"]) == (r.beta0 > 1) for r in flags)
    shape = q["c9_c11_graph_shape"](spark, DIR)
    assert shape.count() == windows


def test_plugged_metric_isolates_failures(spark, monkeypatch):
    def odd(v):
        if len(v) == 3:
            raise ValueError("three")
        return v.sum()

    monkeypatch.setitem(cl.METRICS, "odd", odd)
    rows = [("a", k, 1.0) for k in range(5)] + [("b", k, 2.0) for k in range(3)] + [(None, k, 1.0) for k in range(4)] + [(f"c{i}", k, 1.0) for i in range(50) for k in range(2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.g: (r.value, r.error) for r in cl.plugged_metric(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "odd").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"a": (5.0, None), "b": (None, "three"), None: (4.0, None), **{f"c{i}": (2.0, None) for i in range(50)}}


def test_jobs_are_isolated_and_resumed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 7.0)], "s string, v double")
    path, broken = str(tmp_path / "jobs"), {"b"}

    def job(part):
        if part["s"].iloc[0] in broken:
            raise ValueError("broken")
        return {"total": part["v"].sum()}

    assert ct.run_jobs(df.filter("s <> 'c'"), path, "s", job, ["total"]) == 1
    broken.clear()
    assert ct.run_jobs(df, path, "s", job, ["total"]) == 2  # takes up the failed subject and the new one
    assert ct.run_jobs(df, path, "s", job, ["total"]) == 3  # nothing is left
    got = sorted((r.run, r.s, r.n_rows, r.total, r.status) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", 2, 3.0, "done"), (1, "b", 1, None, "error: broken"), (2, "b", 1, 5.0, "done"), (2, "c", 1, 7.0, "done")]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# Title  here\nbody\n\n## More\n")
    (tmp_path / "b.md").write_text("plain line\nnext")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.title) for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("intro\n# Title  here\nbody\n\n## More\n", "Title  here"), "b.md": ("plain line\nnext", "plain line")}
