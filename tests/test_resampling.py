"""Permutations, transforms along rows, the embedding gates and decoding, against numpy."""

import math

import numpy as np
import pytest

from phaseloom.operators import decoding as dc
from phaseloom.operators import fourier, nulls, resampling


def _vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, int(i % 2), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")


def test_permutations_keep_counts_and_are_uniform(spark):
    df = spark.createDataFrame([(i, int(i < 10), "x") for i in range(30)] + [(None, 1, "x"), (99, None, "x")], "id long, y int, __perms string")
    out = resampling.with_permutations(df, "id", "y", 2, 4000, "s", block=7).collect()
    assert len(out) == 30
    drawn = np.array([np.frombuffer(r.perms, np.uint8) for r in sorted(out, key=lambda r: r.id)])
    assert (drawn.sum(0) == 10).all()
    assert np.abs(drawn.mean(1) - 1 / 3).max() < 5 * math.sqrt(2 / 9 / 4000)
    both = (drawn[:, None] & drawn[None]).mean(2)[np.triu_indices(30, 1)]  # two rows of one class: 10/30 * 9/29
    assert np.abs(both - 90 / 870).max() < 6 * math.sqrt(0.1 * 0.9 / 4000)


@pytest.mark.parametrize(("n", "group"), [(24, None), (1, None), (35, None), (13, 8), (30, 4)])
def test_transform_equals_fft(spark, n, group):
    x = np.random.default_rng(n).normal(size=(n, 3)) + 1j * np.random.default_rng(n + 1).normal(size=(n, 3))
    rows = [(d, i, np.ascontiguousarray(x[i] * (d + 1)).view(float).tolist()) for d in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, fourier.SCHEMA)
    for inverse, want in ((False, np.fft.fft(x, axis=0)), (True, np.fft.ifft(x, axis=0))):
        got = {(r.draw, r.place): np.array(r.x).view(complex) for r in fourier.transform(df, n, inverse, group).collect()}
        assert len(got) == 2 * n
        assert all(np.allclose(got[d, i], want[i] * (d + 1)) for d in range(2) for i in range(n))


@pytest.mark.parametrize("n", [20, 21])
def test_surrogates_keep_the_spectrum_along_rows(spark, n):
    x = np.random.default_rng(5).normal(size=(n, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "place long, v array<double>")
    out = np.zeros((4, n, 4))
    for r in fourier.phase_surrogates(df, "place", "v", n, 3, "q").collect():
        out[r.draw, r.place] = r.v
    assert np.allclose(out[0], x)
    for d in (1, 2, 3):
        assert np.allclose(np.abs(np.fft.fft(out[d], axis=0)), np.abs(np.fft.fft(x, axis=0)))
        turn = np.ones((n, 4), complex)
        for k in range(1, (n - 1) // 2 + 1):
            turn[k] = np.exp(1j * fourier.phases("q", d, k, 4))
            turn[n - k] = np.conj(turn[k])
        assert np.allclose(out[d], np.fft.ifft(np.abs(np.fft.fft(x, axis=0)) * turn, axis=0).real)


def test_gates_equal_numpy(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=(18, 3)), axis=0)
    x[::2] += 2
    df = _vectors(spark, x).union(spark.createDataFrame([(None, 1, [0.0] * 3), (77, 1, None)], "vec_id long, label int, embedding array<double>"))
    t = nulls.spread_against_null(df, "vec_id", "embedding", 40, "g").first()
    spread = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)[np.triu_indices(len(v), 1)].mean()
    drawn = np.zeros((41, 18, 3))
    placed = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "place long, v array<double>")
    for r in fourier.phase_surrogates(placed, "place", "v", 18, 40, "g").collect():
        drawn[r.draw, r.place] = r.v
    null = np.array([spread(v) for v in drawn[1:]])
    z = (spread(x) - null.mean()) / (null.std(ddof=1) + 1e-8)
    assert np.allclose([t.observed, t.null_mean, t.null_std, t.z, t.p], [spread(x), null.mean(), null.std(ddof=1), z, math.erfc(abs(z) / math.sqrt(2))])
    assert t.passes == (abs(z) > 3 and t.p < 0.05)

    whole = _vectors(spark, x)
    c = nulls.centroid_test(whole, "vec_id", "label", "embedding", 300, "c").first()
    perms = np.array([np.frombuffer(r.perms, np.uint8) for r in resampling.with_permutations(whole, "vec_id", "label", 2, 300, "c").orderBy("vec_id").collect()])
    gap = lambda y: np.linalg.norm(x[y == 1].mean(0) - x[y == 0].mean(0))
    seen, null = gap(np.arange(18) % 2), np.array([gap(perms[:, k]) for k in range(300)])
    assert np.allclose([c.observed, c.null_mean, c.null_std, c.p], [seen, null.mean(), null.std(ddof=1), ((null >= seen - 1e-9).sum() + 1) / 301])


def _fitted(z, y):
    """Logistic regression with a unit normal prior on the weights, by Newton steps."""
    z, w = np.column_stack([z, np.ones(len(z))]), np.zeros(z.shape[1] + 1)
    ridge = np.append(np.ones(z.shape[1] - 1), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    return w


def test_decoding_equals_a_fit_at_a_time(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(60) < 0.4).astype(int)
    x = np.column_stack([y + rng.normal(size=60), 100 + 10 * rng.normal(size=60), np.ones(60)])
    rows = [(i, "ab"[c], *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame([*rows, (60, "a", None, 1.0, 1.0), (61, None, 1.0, 1.0, 1.0), (62, "b", float("nan"), 1.0, 1.0)], "id long, label string, a double, b double, c double").repartition(4)
    t = dc.decoding(df, "id", "label", ["a", "b", "c"], folds=3, draws=25, seed="d").first()
    assert (t.status, t.n_samples, t.n_rows_dropped, t.n_features) == ("computed", 60, 3, 3) and t.chance_level == pytest.approx(max(y.mean(), 1 - y.mean()))

    kept = spark.createDataFrame(rows, df.schema).selectExpr("id", "cast(label = 'b' as int) y")
    dealt = dc.stratified(kept, "id", "y", 3, "d").selectExpr("id", "y * 3 + fold cat")
    drawn = sorted(resampling.with_permutations(dealt, "id", "cat", 6, 25, "d").collect(), key=lambda r: r.id)
    cats = np.column_stack([[r.cat for r in drawn], [list(r.perms) for r in drawn]])
    per_class = [[(cats[:, 0] == 3 * c + f).sum() for f in range(3)] for c in (0, 1)]
    assert all(max(p) - min(p) <= 1 for p in per_class)  # stratified
    scores = []
    for cat in cats.T:
        label, fold, parts = cat // 3, cat % 3, []
        for f in range(3):
            m, s = x[fold != f].mean(0), x[fold != f].std(0)
            z = (x - m) / np.where(s > 1e-6, s, 1)
            w = _fitted(z[fold != f], label[fold != f])
            parts.append(((np.column_stack([z, np.ones(60)])[fold == f] @ w > 0) == label[fold == f]).mean())
        scores.append(np.mean(parts))
    null = np.array(scores[1:])
    assert np.allclose([t.accuracy, t.null_mean, t.null_std, t.p_value], [scores[0], null.mean(), null.std(), ((null >= scores[0] - 1e-12).sum() + 1) / 26])


def test_decoding_statuses(spark):
    df = spark.createDataFrame([(i, "a" if i else "b", float(i)) for i in range(9)], "id long, label string, a double")
    assert dc.decoding(df, "id", "label", ["a"], folds=3, draws=5).first().status == "insufficient_data"
    assert dc.decoding(df.filter("id > 0"), "id", "label", ["a"], draws=5).first().status == "not_applicable"
    assert dc.decoding(df.limit(0), "id", "label", ["a"], draws=5).first().n_samples == 0


def test_bootstrap_weights_are_hashed_once_a_row_and_replicate(spark):
    """Weights follow the hash of (seed, replicate, row), null values count as rows, and the replicates of many keys are added up."""
    import hashlib

    from phaseloom.operators import evaluation as ev

    rows = [(f"k{i % 100}", i, None if i == 7 else float(i % 13)) for i in range(700)]
    got = {r.k: (r.lo, r.hi) for r in ev.bootstrap_mean(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v", 40, "s").collect()}
    edges = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(8)])
    for key in ("k7", "k50"):
        means = []
        for rep in range(1, 41):
            c = [(int((int(hashlib.sha256(f"s|{rep}|{i}".encode()).hexdigest()[:8], 16) / 4294967296 >= edges).sum()), v) for k, i, v in rows if k == key]
            if n := sum(x for x, _ in c):
                means.append(sum(x * v for x, v in c if v is not None) / n)
        assert np.allclose(got[key], np.quantile(means, [0.025, 0.975]))


def test_permutations_leave_few_rows_to_sort(spark):
    """Only the rows of the range of hashes where the groups meet are dealt out: the share that a window sorts is a 256th or so."""
    import hashlib

    from phaseloom.operators import evaluation as ev

    rows = [(i, float((i * 37) % 101), "a" if i % 3 else "b") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, v double, g string")
    t = ev.permutation_test(df, [], "i", "v", "g", "a", 30, "s").first()
    n, values = sum(g == "a" for *_, g in rows), {i: v for i, v, _ in rows}
    stats = []
    for perm in range(1, 31):
        order = sorted(values, key=lambda i: hashlib.sha256(f"s|{perm}|{i}".encode()).hexdigest())
        stats.append(np.mean([values[i] for i in order[:n]]) - np.mean([values[i] for i in order[n:]]))
    seen = np.mean([v for _, v, g in rows if g == "a"]) - np.mean([v for _, v, g in rows if g == "b"])
    assert abs(t.observed - seen) < 1e-9 and t.exceed == sum(abs(x) >= abs(seen) - 1e-9 for x in stats) and t.n == 30


def _brute(rows, first, draws, seed):
    import hashlib

    seen = [v for _, v, g in rows if g == first and v is not None], [v for _, v, g in rows if g != first and v is not None]
    n, out = sum(g == first for *_, g in rows), []
    for perm in range(1, draws + 1):
        order = sorted(rows, key=lambda r: hashlib.sha256(f"s|{perm}|{r[0]}".encode()).hexdigest())
        sides = [[v for _, v, _ in part if v is not None] for part in (order[:n], order[n:])]
        out.append(np.mean(sides[0]) - np.mean(sides[1]) if all(sides) else None)
    observed = np.mean(seen[0]) - np.mean(seen[1])
    return observed, sum(x is not None and abs(x) >= abs(observed) - 1e-9 for x in out)


@pytest.mark.parametrize(("band", "held"), [(4.0, 64), (0.01, 64), (0.5, 1)])
def test_differences_of_means_equal_brute_force(spark, monkeypatch, band, held):
    """Cuts outside their band are drawn again; nulls are dealt but do not count, numbers without end do."""
    from phaseloom.operators import evaluation as ev

    monkeypatch.setattr(ev, "BAND", band)
    monkeypatch.setattr(ev, "HELD", held)
    rows = {k: [(i, None if i % 19 == 3 else float((i * 37 + len(k)) % 101), "a" if i % m else "b") for i in range(n)] for k, n, m in (("x", 400, 3), ("yy", 150, 2), ("zzz", 7, 5))}
    df = spark.createDataFrame([(k, *r) for k, part in rows.items() for r in part], "k string, i long, v double, g string")
    got = {r.k: (r.observed, r.exceed, r.n) for r in ev.permutation_test(df, ["k"], "i", "v", "g", "a", 60, "s").collect()}
    for k, part in rows.items():
        observed, exceed = _brute(part, "a", 60, "s")
        assert abs(got[k][0] - observed) < 1e-9 and got[k][1:] == (exceed, 60)
    endless = [(i, math.inf if i == 5 else float(i), "a" if i % 2 else "b") for i in range(300)]
    t = ev.permutation_test(spark.createDataFrame(endless, "i long, v double, g string"), [], "i", "v", "g", "a", 20, "s").first()
    assert (t.observed, t.exceed, t.n) == (math.inf, 20, 20)


def test_group_report_draws_as_often_as_the_reference(spark):
    from phaseloom.plans import catalog

    assert {r.n for r in catalog.queries()["v7_group_report"](spark, "/root/testdata/sf0.001").collect()} == {2000}
