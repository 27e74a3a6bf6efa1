"""Running sums, last known values and nearest rows over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from phaseloom.operators import evaluation as ev
from phaseloom.operators import ordered
from phaseloom.operators import relational as rel
from phaseloom.operators import windows as wn


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    keys = ["hot"] * 200 + ["b"] * 20 + ["c"] * 3 + [None] * 10
    return [(k, rng.randrange(60), i, rng.choice([None, float(i)]), 1.5) for i, k in enumerate(keys)]


def test_running_sum_and_last_known(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "k string, t long, i long, v double, one double").repartition(3)
    ranged = ordered.ranges(df.repartition(5), ["k"], ["t", "i"])
    assert ranged.select("__part").distinct().count() > 2
    out = ordered.running_sum(ranged, ["k"], ["t", "i"], F.col("one"), "before")
    out = ordered.last_known(out, ["k"], ["t", "i"], F.col("v"), "behind")
    out = ordered.last_known(out, ["k"], ["t", "i"], F.col("v"), "ahead", ahead=True)
    got = {r.i: (r.before, r.behind, r.ahead) for r in out.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key)
        for n, (_, i, _) in enumerate(mine):
            behind = next((v for *_, v in reversed(mine[: n + 1]) if v is not None), None)
            ahead = next((v for *_, v in mine[n:] if v is not None), None)
            assert got[i] == (1.5 * n, behind, ahead)


def test_nearest_join_equals_all_pairs(spark):
    rng = random.Random(7)
    left = [(i, rng.choice("aab"), rng.randrange(200) / 2) for i in range(150)] + [(900, None, 1.0), (901, "a", None), (902, "z", 1.0)]
    right = [(i, rng.choice("ab"), rng.randrange(200) / 2) for i in range(90)] + [(800, "a", None)]
    a, b = spark.createDataFrame(left, "id long, u string, t double"), spark.createDataFrame(right, "other_id long, u string, s double")
    got = {r.id: (r.s, r.other_id, r.gap) for r in rel.nearest_join(a, b, ["u"], "id", "t", "s", 3.0).collect()}
    want = {}
    for i, u, t in left:
        near = [(abs(t - s), s, j) for j, v, s in right if u is not None and t is not None and s is not None and v == u and abs(t - s) <= 3]
        if near:
            gap, s, j = min(near)
            want[i] = (s, j, gap)
    assert got == want


def test_nearest_join_makes_no_row_product(spark):
    """All events within one tolerance: as many rows leave as came in."""
    a = spark.range(20_000).select(F.col("id"), F.lit("u").alias("u"), (F.col("id") / 1e4).alias("t"))
    b = spark.range(20_000).select(F.col("id").alias("o"), F.lit("u").alias("u"), (F.col("id") / 1e4).alias("s"))
    out = rel.nearest_join(a, b, ["u"], "id", "t", "s", 100.0)
    assert out.filter("gap > 0 or o <> id").isEmpty() and out.count() == 20_000
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_auc_of_continuous_scores(spark):
    rng = random.Random(2)
    rows = [(g, rng.random() if g == "x" else float(rng.randrange(4)), rng.randrange(2)) for g in "xy" for _ in range(300)]
    got = {r.g: r.auc for r in ev.auc(spark.createDataFrame(rows, "g string, score double, y int"), ["g"]).collect()}
    for g in "xy":
        pos, neg = ([s for h, s, y in rows if h == g and y == c] for c in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_trailing_drops_over_pieces(spark, monkeypatch):
    rng = random.Random(3)
    v = [rng.gauss(0, 1) - 4 * (i % 17 == 0) for i in range(100)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "k string, n long, v double")
    whole = sorted((r.n, round(r.z, 9)) for r in wn.trailing_drops(df, ["k"], "n", "v", 5, 1.0).collect())
    monkeypatch.setattr(wn, "PIECE", 16)
    assert whole and sorted((r.n, round(r.z, 9)) for r in wn.trailing_drops(df, ["k"], "n", "v", 5, 1.0).collect()) == whole


def test_probe_epochs_and_first_wins(spark):
    rng = random.Random(5)
    events = [(i, rng.choice("aaab"), rng.randrange(300), rng.choice(["probe", "click", "other"]), 1.0) for i in range(400)]
    df = spark.createDataFrame(events, "id long, u string, t long, kind string, v double")
    probes, held = rel.probe_epochs(df, "u", "t", F.col("kind") == "probe", F.col("kind") == "click", "id", "v")
    want, counts = set(), {}
    for u in "ab":
        mine = sorted((t, i) for i, w, t, k, _ in events if w == u and k == "probe")
        want |= {b[1] for a, b in zip(mine, mine[1:], strict=False) if b[0] - a[0] >= 1}
        for i, w, t, k, _ in events:
            if w == u and k == "click" and (after := [p for p in mine if p[0] >= t]):
                counts[after[0][1]] = counts.get(after[0][1], 0) + 1
    assert {r.id for r in probes.collect()} == want and probes.columns == df.columns
    assert {r.id: r.n for r in held.collect()} == counts
    first = {r.id: (r.kept, r.duplicate) for r in rel.first_wins(df.withColumn("key", F.when(F.col("kind") != "other", F.col("u"))), "key", "id").collect()}
    least = {}
    for i, u, _, k, _ in events:
        least.setdefault(u if k != "other" else None, i)
    assert all(first[i] == (least[u if k != "other" else None], i != least[u if k != "other" else None]) for i, u, _, k, _ in events)
