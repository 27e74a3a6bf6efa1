"""Analytic ground truth of the phase operators, against numpy."""

import math

import numpy as np
import pytest

from phaseloom.operators import field_topology as ft
from phaseloom.operators import phase_metrics as pm

N = 12


def grid(spark, theta, amp=None):
    amp = np.ones_like(theta) if amp is None else amp
    rows = [(0, i, j, float(theta[i, j]), float(amp[i, j])) for i in range(theta.shape[0]) for j in range(theta.shape[1])]
    return spark.createDataFrame(rows, "s int, i int, j int, theta double, amp double")


def vortex(k, x0=5.3, y0=5.6):
    i, j = np.mgrid[0:N, 0:N]
    return k * np.arctan2(i - y0, j - x0)


@pytest.mark.parametrize("k", [-3, -2, -1, 1, 2, 3])
def test_integer_charge_has_the_negative_sign(spark, k):
    r = ft.slice_charge(grid(spark, vortex(k)), ["s"]).collect()[0]
    assert r.q == -k


@pytest.mark.parametrize("k", [-1.5, -0.5, 0.5, 1.5])
def test_half_integer_charge(spark, k):
    r = ft.nematic_charge(grid(spark, vortex(k)), ["s"]).collect()[0]
    assert r.charge == pytest.approx(k, abs=1e-9)


def test_uniform_field_has_nothing(spark):
    f = grid(spark, np.full((N, N), 0.7))
    r = ft.slice_charge(f, ["s"]).collect()[0]
    assert (r.q, r.q_abs) == (0, 0.0) and ft.defects(f, ["s"], 2.0).count() == 0
    e = ft.energy(f, ["s"]).collect()[0]
    assert e.order_r == pytest.approx(1) and e.free_energy == pytest.approx(1 - math.cos(0.7))


def test_pair_and_defects(spark):
    theta = vortex(1, 3.4, 3.4) - vortex(1, 8.4, 8.4)
    f = grid(spark, np.angle(np.exp(1j * theta)), np.full((N, N), 0.1))
    r = ft.slice_charge(f, ["s"]).collect()[0]
    assert r.q == 0 and r.q_abs == pytest.approx(2, abs=1e-9)
    assert sorted((d.i, d.j, d.sign) for d in ft.defects(f, ["s"]).collect()) == [(3, 3, -1), (8, 8, 1)]


def test_missing_cells_make_no_plaquettes(spark):
    f = grid(spark, vortex(1)).filter("not (i = 4 and j = 4)")
    assert ft.plaquettes(f, ["s"]).count() == (N - 1) ** 2 - 4
    assert ft.plaquettes(f.limit(0), ["s"]).count() == 0


def test_plaquettes_match_numpy(spark):
    theta = np.random.default_rng(1).uniform(-np.pi, np.pi, (N, N))
    wrap = lambda x: (x + np.pi) % (2 * np.pi) - np.pi
    q = (wrap(theta[1:, :-1] - theta[:-1, :-1]) + wrap(theta[1:, 1:] - theta[1:, :-1]) + wrap(theta[:-1, 1:] - theta[1:, 1:]) + wrap(theta[:-1, :-1] - theta[:-1, 1:])) / (2 * np.pi)
    got = np.zeros((N - 1, N - 1))
    for r in ft.plaquettes(grid(spark, theta), ["s"]).collect():
        got[r.i, r.j] = r.q
    assert np.allclose(got, q, atol=1e-9)


def test_locked_channels(spark):
    rows = [(0, c, k, 0.3 * k + 0.1 * c, 1.0) for c in range(4) for k in range(20)]
    p = spark.createDataFrame(rows, "w int, channel int, k int, theta double, amp double")
    assert all(r.plv == pytest.approx(1) for r in pm.phase_coupling(p, ["w"]).collect())
    k = pm.kuramoto(p, ["w"]).collect()[0]
    assert k.metastability == pytest.approx(0, abs=1e-7) and 0 < k.r_mean <= 1


def test_triangle_winding(spark):
    tri = spark.createDataFrame([(0, 0, 1, 2)], "tri_id int, v0 int, v1 int, v2 int")
    rows = [(0, c, 0, t, 1.0) for c, t in enumerate((0.0, 2 * math.pi / 3, -2 * math.pi / 3))]
    p = spark.createDataFrame(rows, "w int, channel int, k int, theta double, amp double")
    assert pm.triangle_winding(p, tri, ["w"]).collect()[0].winding == pytest.approx(1)
