"""Work that is done in rounds, blocks and pages gives what it gives at once, and leaves no more behind."""

import glob
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import claim_graph, claims, diagrams, field_topology, montage, nulls, resampling, retrieval, surrogates, windows
from phaseloom.plans import views
from phaseloom.sources.readers import shared_path
from phaseloom.streaming import stateful
from phaseloom.streaming.jobs import HOUR


def _folders(spark, what):
    return set(glob.glob(shared_path(spark, what).removeprefix("file://").rsplit("-", 1)[0] + "*"))


def test_surrogates_of_a_spread_are_not_stored_and_rounds_agree(spark, monkeypatch):
    x = np.cumsum(np.random.default_rng(4).normal(size=(30, 3)), axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = _folders(spark, "surrogates")
    once = nulls.spread_against_null(df, "vec_id", "embedding", 5, "r").first()
    assert _folders(spark, "surrogates") == before
    for name, value in (("ROUND", 200), ("BLOCKS", (4, 4)), ("STRIPE", 3)):
        monkeypatch.setattr(nulls, name, value)
    parts = nulls.spread_against_null(df, "vec_id", "embedding", 5, "r").first()
    assert np.allclose(once[1:6], parts[1:6])
    assert once.observed == parts.observed or abs(once.observed - np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(30, 1)].mean()) < 1e-9


class _State:
    """Stands in for the store of one key and counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        return _Value(self, name)

    def getMapState(self, name, key, value):
        return _Map(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class _Value:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def exists(self):
        return self.name in self.state.values

    def get(self):
        return self.state.values[self.name]

    def update(self, value):
        self.state.calls += 1
        self.state.values[self.name] = value

    def clear(self):
        self.state.values.pop(self.name, None)


class _Map:
    def __init__(self, state, name):
        self.state, self.rows = state, state.values.setdefault(name, {})

    def iterator(self):
        return iter(list(self.rows.items()))

    def keys(self):
        return iter(list(self.rows))

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.state.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class _Times:
    def getCurrentWatermarkInMs(self):
        return 10**13

    getExpiryTimeInMs = getCurrentWatermarkInMs


@pytest.mark.parametrize("kind", ["sessions", "drops", "changes"])
def test_calls_to_the_store_do_not_grow_with_bursts_and_days(kind):
    day = 24 * HOUR
    rows = pd.DataFrame({"us": np.arange(60) * day + 19_712 * day, "event_id": range(60), "value": 1.0, "event_type": list("ab") * 30, "ends": False})
    job = {"sessions": stateful.Sessions(6 * HOUR), "drops": stateful.TrailingDrops(day, 8, 1.0), "changes": stateful.ChangePoints(day)}[kind]
    state = _State()
    job.init(state)
    assert not list(job.handleInputRows((1,), iter([rows]), None))
    assert state.calls <= 4 and len(state.timers) == 1  # 60 bursts or days
    out = pd.concat(list(job.handleExpiredTimer((1,), _Times(), _Times())))
    assert len(out) == out["n"].sum() == 60
    assert not state.values.get("waiting") and "open" not in state.values
    if kind != "sessions":
        assert out["found"].sum() == {"drops": 0, "changes": 59}[kind]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_landscape_cuts_batches_before_grid_points_are_rows(spark):
    rng = np.random.default_rng(6)
    bars = [(k, float(b), float(b + d)) for k, b, d in zip("ab" * 40, rng.uniform(0, 1, 80), rng.uniform(0, 1, 80), strict=True)] + [("a", 0.1, float("inf")), ("c", 0.2, 0.9)]
    df = diagrams.landscape(spark.createDataFrame(bars, "k string, birth double, death double"), ["k"], 0.1, 0.1, 9, 3)
    plan = _plan(df)
    assert plan.index("Generate") < plan.index("MapInPandas")  # the plan begins with its last step
    want = []
    for k in "abc":
        for g in range(9):
            at = float(Decimal("0.1") + g * Decimal("0.1"))
            tents = sorted((max(0.0, min(at - b, d - at)) for x, b, d in bars if x == k), reverse=True)
            want += [(k, g, i + 1, h) for i, h in enumerate(tents[:3])]
    assert sorted((r.k, r.g, r.layer, r.height) for r in df.collect()) == want


def test_islands_of_hits_are_worked_on_in_batches(spark):
    rng = np.random.default_rng(7)
    hits = [(k, int(n)) for k in ("a", None, "b") for n in np.flatnonzero(rng.random(400) < 0.4)]
    df = windows.refractory(spark.createDataFrame(hits, "k string, n long"), ["k"], "n", 3)
    assert "FlatMapGroupsInPandas" not in _plan(df)
    want = []
    for k in ("a", None, "b"):
        last = -9
        for n in sorted(n for x, n in hits if x == k):
            if n - last >= 3:
                want.append((str(k), n))
                last = n
    assert sorted((str(r.k), r.n) for r in df.collect()) == sorted(want)


def test_scopes_are_reached_within_the_row(spark):
    before = _folders(spark, "front") | _folders(spark, "scopes")
    subjects = spark.createDataFrame([(1, False), (2, False), (3, True)], "s long, mock boolean")
    have = spark.createDataFrame([(1, "x"), (1, "review")], "s long, evidence string")
    scopes = spark.createDataFrame([("base", 0, False), ("mid", 1, False), ("top", 2, True)], "scope string, level int, needs_real boolean")
    needs = spark.createDataFrame([("mid", "x")], "scope string, evidence string")
    bridges = spark.createDataFrame([("b1", "base", "mid", False, False, False), ("b2", "mid", "top", False, True, False)], "bridge string, source string, target string, needs_real boolean, needs_review boolean, quarantined boolean")
    bridge_needs = spark.createDataFrame([], "bridge string, evidence string")
    m = claim_graph.claim_matrix(subjects, "s", have, scopes, needs, claim_graph.bridge_statuses(subjects, "s", have, bridges, bridge_needs), "base").collect()
    assert {(r.s, r.scope) for r in m if r.reached} == {(1, "base"), (1, "mid"), (1, "top"), (2, "base"), (3, "base")}
    assert {r.s: r.max_scope for r in m} == {1: "top", 2: "base", 3: "base"}
    assert _folders(spark, "front") | _folders(spark, "scopes") == before


def test_permutations_are_unpacked_a_slice_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7)]) for i in range(30)], "id long, y int, v array<double>")
    permuted = resampling.with_permutations(df, "id", "y", 2, 6, "u").coalesce(1)
    once = {r.perm: (r.n, list(r.sums)) for r in resampling.class_sums(permuted, "v", "y", 6, 1).collect()}
    monkeypatch.setattr(resampling, "SLICE", 7)
    assert {r.perm: (r.n, list(r.sums)) for r in resampling.class_sums(permuted, "v", "y", 6, 1).collect()} == once
    assert once[0] == (15, [225.0, sum(float(i * i % 7) for i in range(1, 30, 2))])


def test_patches_of_a_grid_equal_those_of_its_points_without_a_shuffle_of_points(spark):
    w = [(i, j, s, 1.0 / (1 + abs(s - i - 2 * j))) for i in range(3) for j in range(3) for s in (range(4) if i < 2 else [i])]
    rows = [(k, s, math.sin(7 * k + 3 * s) * 3 if (k, s) != (1, 2) else None) for k in range(4) for s in range(4) if (k, s) != (2, 2)]
    args = spark.createDataFrame(rows, "k int, channel int, v double"), ["k"], "channel", "v", spark.createDataFrame(w, "i int, j int, sensor int, weight double")
    patches = montage.grid_patches(*args)
    assert "Window" not in _plan(patches)
    both = [sorted((r.k, r.i, r.j, -9.0 if r.q is None else round(r.q, 9) + 0.0) for r in df.collect()) for df in (patches, field_topology.plaquettes(montage.on_grid(*args), ["k"], "v", None))]
    assert both[0] == both[1] and len({r[0] for r in both[0]}) == 4


def test_windows_stand_in_a_given_number_of_places(spark):
    df = views.windowed(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == surrogates.places(spark)  # what Spark does not coalesce by bytes


def test_searches_of_vectors_make_no_rows_of_pairs(spark, monkeypatch):
    for name, value in (("ROWS", 9), ("QUERIES", 3), ("STRIPE", 2)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, 2.0]), (43, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    whole = retrieval.cosine_scores(df, "id", "v", "id % 5 = 0")
    assert "Join" not in _plan(whole)
    q = df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("w"))
    product = retrieval.norm(F.col("w")) * retrieval.norm(F.col("v"))
    want = df.crossJoin(q).select("query_id", "id", F.when(product == 0, 0.0).otherwise(retrieval.dot(F.col("w"), F.col("v")) / product).alias("s"))
    got = {(r.query_id, r.id): r.similarity for r in whole.collect()}
    assert len(got) == 44 * 9
    for r in want.collect():
        assert (got[r.query_id, r.id] is None and r.s is None) or abs(got[r.query_id, r.id] - r.s) < 1e-12
    best = {}
    for r in retrieval.cosine_scores(df, "id", "v", "id % 5 = 0", best=4).collect():
        best.setdefault(r.query_id, []).append((r.similarity is None, -round(r.similarity or 0, 6), r.id))
    for name, found in best.items():
        full = sorted((s is None, -round(s or 0, 6), i) for (n, i), s in got.items() if n == name and i != name)
        assert sorted(found)[:4] == full[:4]


def test_lines_of_claims_are_lowered_once(spark):
    df = claims.claims(spark.createDataFrame([(1, "the EEG\n\n soul \x0b\r\nnothing")], "id long, t string"), "id", "t")
    plan = _plan(df)
    assert plan.count("lower(") <= 2  # not once for each word
    assert [(r.claim_no, r.text, r.categories) for r in df.orderBy("claim_no").collect()] == [(0, "the EEG", ["science"]), (1, "soul", ["speculation"])]


def test_vectors_are_not_copied_for_blocks_of_queries(spark):
    df = spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(40)], "id long, v array<double>")
    found = retrieval.cosine_scores(df, "id", "v", "id % 5 = 0")
    assert "Generate" not in _plan(found) and found.count() == 320


def test_distances_are_added_up_in_tiles(monkeypatch):
    monkeypatch.setattr(nulls, "STRIPE", 4)
    x = np.random.default_rng(2).normal(size=(23, 5))
    pairs = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for n in (1, 4, 11, 23):
        assert abs(nulls.distance_sum(x[:n], x[:n], True) - np.triu(pairs[:n, :n], 1).sum()) < 1e-9
        assert abs(nulls.distance_sum(x[:n], x[n:], False) - pairs[:n, n:].sum()) < 1e-9
