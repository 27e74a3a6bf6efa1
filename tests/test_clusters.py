import numpy as np
import pytest

from phaseloom.operators import clusters as cl
from phaseloom.operators import spatial as sp
from phaseloom.operators import surrogates as sg
from phaseloom.operators import tracking as tk


def test_density_clusters(spark):
    pts = [("f", k, float(x), 0.0) for k, x in enumerate([0, 1, 2, 10, 11, 12, 13, 30, 3.4])]
    df = spark.createDataFrame(pts, "f string, id int, x double, y double")
    got = {r.id: r.cluster for r in sp.density_clusters(df, ["f"], 1.5, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 8: 1, 3: 4, 4: 4, 5: 4, 6: 4, 7: None}


def test_ring_has_one_component_and_one_loop(spark):
    cells = [(0, i, j, 0.0 if (i, j) != (1, 1) else 5.0) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "s int, i int, j int, theta double")
    got = {r.threshold: (r.beta0, r.beta1) for r in sp.betti_numbers(df, ["s"], [-1.0, 1.0, 9.0]).collect()}
    assert got == {-1.0: (0, 0), 1.0: (1, 1), 9.0: (1, 0)}


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (0, 3), (6, 7)):
        p, q = rng.uniform(size=(n, 2)), rng.uniform(size=(m, 2))
        d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
        got = tk.assignment(p, q)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        least = min(sum(d[i, j] for i, j in (zip(range(n), x, strict=True) if n <= m else zip(x, range(m), strict=True))) for x in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(d[i, j] for i, j in got) == pytest.approx(least)


def test_sparse_assignment_equals_the_dense_one(monkeypatch):
    """Clumps, where the nearest partners are far from enough, and blocks of a few distances."""
    monkeypatch.setattr(tk, "HELD", 500)
    rng = np.random.default_rng(4)
    for n, m in ((60, 60), (40, 90), (90, 40)):
        p, q = np.concatenate([rng.normal(0, 0.1, (n // 2, 2)), rng.normal(5, 1, (n - n // 2, 2))]), rng.normal(2, 2, (m, 2))
        d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
        got = tk.assignment(p, q)
        column_of, price, paid = tk._augmented([dict(enumerate(map(float, row))) for row in (d if n <= m else d.T)], max(n, m), 1e9)
        dense = sum((d if n <= m else d.T)[i, j] for i, j in enumerate(column_of))
        assert sum(d[i, j] for i, j in got) == pytest.approx(dense)
        assert ((d if n <= m else d.T) - price[:, None] - paid >= -1e-9).all() and (paid <= 1e-12).all()  # prices prove it



def test_tracks(spark):
    pts = [("z", 0, "a", 0.0, 0.0), ("z", 1, "b", 1.0, 0.0), ("z", 2, "c", 2.0, 0.0), ("z", 3, "d", 20.0, 0.0)]
    p = spark.createDataFrame(pts, "z string, t int, id string, x double, y double")
    got = {r.id: r.track for r in tk.tracks(p, tk.frame_links(p, ["z"], "t", 3.0)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_surrogates_keep_the_spectrum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=64)
    y = sg.randomized(x, rng)
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y))) and not np.allclose(x, y)
    assert np.allclose(np.sort(x), np.sort(sg.adjusted(x, rng)))


def test_plugged_metric(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(4)], "w int, k int, v double")
    assert cl.plugged_metric(df, ["w"], "range").collect()[0].value == 3.0


def test_assignment_is_made_before_the_limit(spark):
    """With these distances the least total cost takes (a, c) and (b, d); only the first is within the limit."""
    pts = [("z", 0, "a", 0.0, 0.0), ("z", 0, "b", 2.6, 0.0), ("z", 1, "c", 0.1, 0.0), ("z", 1, "d", -2.5, 0.0)]
    p = spark.createDataFrame(pts, "z string, t int, id string, x double, y double")
    links = [(r.id_from, r.id_to) for r in tk.frame_links(p, ["z"], "t", 3.0).collect()]
    cost = [[0.1, 2.5], [2.5, 5.1]]
    best = min(([(0, 0), (1, 1)], [(0, 1), (1, 0)]), key=lambda m: sum(cost[i][j] for i, j in m))
    assert sorted(links) == sorted(("ab"[i], "cd"[j]) for i, j in best if cost[i][j] <= 3.0)


def test_long_tracks(spark):
    pts = [("z", t, f"p{t:03d}", float(t), 0.0) for t in range(150)]
    p = spark.createDataFrame(pts, "z string, t int, id string, x double, y double")
    assert {r.track for r in tk.tracks(p, tk.frame_links(p, ["z"], "t", 3.0)).collect()} == {"p000"}


def test_surrogate_metrics_are_those_of_the_rows(spark):
    """Batches of whole series give each series the surrogates of its own seeds, at any batch border, and the gate of the rows."""
    rng = np.random.default_rng(3)
    rows = [(f"r{w % 2}", w, c, k, float(rng.normal())) for w in range(9) for c in range(2) for k in range(16)]
    df = spark.createDataFrame(rows, "recording_id string, w int, channel long, k int, v double")
    keys, each = ["recording_id", "w"], ["recording_id", "w", "channel"]
    rough = lambda v: float(np.abs(np.diff(v)).mean())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for kind, one in (("ft", sg.randomized), ("iaaft", sg.adjusted)):
            made = sg.surrogates(df, keys, 3, "s", kind).collect()
            got = {}
            for x in sorted(made, key=lambda x: x.k):
                got.setdefault((x.recording_id, x.w, x.channel, x.surrogate), []).append(x.v)
            assert len(got) == 9 * 2 * 3
            for (r, w, c, n), y in got.items():
                x = np.array([v for *at, v in rows if at[:3] == [r, w, c]])
                assert np.allclose(y, one(x, np.random.default_rng(sg._seed("s", r, w, c, n))))
        nulls = spark.createDataFrame([(*k[:3], rough(np.array(v))) for k, v in _series(sg.surrogates(df, keys, 5, "s"), [*each, "surrogate"]).items()], "recording_id string, w int, channel long, x double")
        seen = spark.createDataFrame([(*k, rough(np.array(v))) for k, v in _series(df, each).items()], "recording_id string, w int, channel long, x double")
        want = {tuple(r)[:3]: tuple(r)[3:] for r in sg.gate(seen, nulls, each, "x").collect()}
        have = {tuple(r)[:3]: tuple(r)[3:] for r in sg.gated(sg.surrogate_metrics(df, keys, each, 5, "s", rough), each).collect()}
        assert have.keys() == want.keys() and all(np.allclose(have[k], want[k]) for k in want)
        z = {(r.recording_id, r.w, r.channel, r.k): r.amp for r in sg.analytic_signal(df, each, 2, 5).collect()}
        x = np.array([v for r, w, c, k, v in rows if (w, c) == (4, 1)])
        spec = np.fft.fft(x)
        spec[[i for i in range(16) if not 2 <= i <= 5]] = 0
        assert np.allclose([z["r0", 4, 1, k] for k in range(16)], np.abs(np.fft.ifft(2 * spec)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _series(df, keys):
    out = {}
    for r in df.orderBy(*keys, "k").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append(r.v)
    return out
