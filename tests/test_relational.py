import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from phaseloom.operators import evaluation as ev
from phaseloom.operators import relational as rel
from phaseloom.operators import retrieval as rt
from phaseloom.operators import windows as wn


def test_strict_join_contract(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    t = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "k int, y double")
    assert rel.strict_join(m, t, ["k"]).count() == 2
    with pytest.raises(rel.JoinContractError):
        rel.strict_join(m.union(m), t, ["k"])
    with pytest.raises(rel.JoinContractError):
        rel.strict_join(m, t.filter("k <> 2"), ["k"])
    with pytest.raises(rel.JoinContractError):
        rel.strict_join(m, t.union(t), ["k"])


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [("g", rng.randrange(8) / 8, rng.randrange(2)) for _ in range(60)] + [("one", 0.5, 1)]
    got = {r.g: r.auc for r in ev.auc(spark.createDataFrame(rows, "g string, score double, y int"), ["g"]).collect()}
    pos, neg = ([s for g, s, y in rows if g == "g" and y == k] for k in (1, 0))
    won = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    assert got["g"] == pytest.approx(won / len(pos) / len(neg)) and got["one"] == 0.5


def test_null_without_spread_has_no_z(spark):
    n = spark.createDataFrame([("a", 1.0, 2.0)] * 3, "k string, v double, o double")
    r = ev.null_summary(n, ["k"], "v", "o").collect()[0]
    assert r.z is None and r.null_mean == 1.0


def test_permutation_test_sees_an_effect_and_no_other(spark):
    rng = random.Random(1)
    rows = [("effect", i, rng.gauss(2.0 * (i % 2), 1), "ab"[i % 2]) for i in range(60)] + [("none", i, rng.gauss(0, 1), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double, g string")
    p = {r.k: r.p for r in ev.permutation_test(df, ["k"], "i", "v", "g", "a", 99, "s").collect()}
    assert p["effect"] == pytest.approx(0.01) and p["none"] > 0.05


def test_nearest_join_ties_and_tolerance(spark):
    a = spark.createDataFrame([(1, "u", 10.0), (2, "u", 30.0), (3, "w", 10.0)], "id int, u string, t double")
    b = spark.createDataFrame([("u", 8.0), ("u", 12.0), ("u", 25.0)], "u string, s double")
    got = {r.id: r.s for r in rel.nearest_join(a, b, ["u"], "id", "t", "s", 5.0).collect()}
    assert got == {1: 8.0, 2: 25.0}
    best = rel.best_offset(a, b, ["u"], "id", "t", "s", 1.0, [-2.0, 0.0, 2.0]).orderBy("offset").collect()
    assert [(r.offset, r.matched) for r in best] == [(-2.0, 1), (2.0, 1)]


def test_ranked_equals_a_global_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    got = {r.i: r.place for r in rel.ranked(spark.createDataFrame(rows, "i int, s int").repartition(7), "s", "i", "place").collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert got == want


def test_sliding_windows_are_full(spark):
    s = spark.createDataFrame([("r", n, float(n)) for n in range(21)], "r string, n int, v double")
    n = {r.w: r["count"] for r in wn.sliding(s, ["r"], 8, 4).groupBy("w").count().collect()}
    assert n == {0: 8, 1: 8, 2: 8, 3: 8}
    short = wn.tumbling(s.limit(5), ["r"], 8).collect()
    assert [(r.n_samples, r.status) for r in short] == [(5, "short_window")]


def test_refractory_gap(spark):
    h = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4, 9, 11)], "k string, n int")
    assert sorted(r.n for r in wn.refractory(h, ["k"], "n", 3).collect()) == [1, 4, 9]


def test_search_in_blocks_meets_every_row(spark):
    from phaseloom.operators.retrieval import against_all

    rows, queries = spark.range(7).withColumnRenamed("id", "r"), spark.range(11).withColumnRenamed("id", "q")
    for block in (100, 3):
        assert sorted((x.r, x.q) for x in against_all(rows, queries, "q", block).collect()) == [(r, q) for r in range(7) for q in range(11)]


def test_bm25_does_not_shuffle_hits(spark):
    from phaseloom.operators import retrieval as rt

    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3} w{i % 5}") for i in range(40)], "id long, text string")
    ask = spark.createDataFrame([(0, "alpha w1 w1"), (1, "beta nothing")], "query_id long, text string")
    scores = rt.search(docs, ask, "id", "text")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(id" in plan
    assert scores.count() == 80 and scores.select("query_id", "id").distinct().count() == 80


def test_line_hits_carry_excerpts_only_with_the_lines(spark):
    from phaseloom.operators import retrieval as rt

    docs = spark.createDataFrame([(i, f"alpha beta gamma {i}\nnothing here\nbeta gamma\nalpha") for i in range(20)], "id long, text string")
    phrases = spark.createDataFrame([("beta gamma",), ("alpha",), ("alpha beta gamma",)], "phrase string")
    hits = rt.line_hits(docs, phrases, "id", "text")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any("pid" in line and "excerpt" in line for line in plan.splitlines() if "Aggregate" in line)
    got = [(r.line_no, r.phrase, r.excerpt) for r in hits.filter("id = 3").orderBy("line_no", "phrase").collect()]
    assert got == [(1, "alpha", "alpha beta gamma 3"), (1, "alpha beta gamma", "alpha beta gamma 3"), (1, "beta gamma", "alpha beta gamma 3"), (3, "beta gamma", "beta gamma"), (4, "alpha", "alpha")]
    assert hits.count() == 100


@pytest.mark.parametrize("small", [False, True])
def test_bm25_of_all_and_of_the_best_equal_brute_force(spark, monkeypatch, small):
    """Copies tie by id, rows of one id are one document."""
    from collections import Counter

    if small:
        monkeypatch.setattr(rt, "ASKED", 7)
        monkeypatch.setattr(rt, "SCORED", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(60)] + [(100 + i, "w1 w2 w3") for i in range(40)] + [(200, None), (201, "")]
    ask = [(q, " ".join(rng.choices([*words, "unknown"], k=5))) for q in range(9)] + [(9, "unknown"), (10, None)]

    def brute(docs):
        held = {}
        for i, t in docs:
            held[i] = held.get(i, Counter()) + Counter((t or "").split())
        df, mean, out = Counter(t for c in held.values() for t in c), sum(c.total() for c in held.values()) / len(docs), {}
        for q, t in ask:
            for i, c in held.items():
                s = sum(n * math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w, n in Counter((t or "").split()).items() if c[w])
                if s:
                    out[q, i] = s
        return out

    queries = spark.createDataFrame(ask, "query_id int, text string")
    for rows in (docs, [*docs, (5, "w1 w1 w7"), (5, None), (None, "w2"), (None, "w3 w3")]):
        table, want = spark.createDataFrame(rows, "id long, text string"), brute(rows)
        found = rt.search(table, queries, "id", "text")
        assert {(r.query_id, r.id): pytest.approx(r.score) for r in found.collect()} == want and found.count() == len(want)
        first = rt.top_k(rt.search(table, queries, "id", "text", best=5).withColumn("by", F.round("score", 8)), "query_id", "by", "id", 5).collect()
        got = {(r.query_id, r["rank"]): r.id for r in first}
        for q in range(11):
            order = sorted(((-round(s, 8), i is not None, i) for (p, i), s in want.items() if p == q))[:5]
            assert [got.get((q, k + 1)) for k in range(len(order))] == [i for *_, i in order] and (q, len(order) + 1) not in got


@pytest.mark.parametrize("known_bytes", [1 << 24, 0])
def test_new_line_hits_meet_lines_once(spark, monkeypatch, known_bytes):
    """Known lines go by their excerpts, wherever the phrase stands; lines in fences and excluded ones are not looked up."""
    monkeypatch.setattr(rt, "KNOWN_BYTES", known_bytes)
    long = "x" * 10
    docs = [(1, f"{long} alpha\nold alpha"), (2, f"{long} no\nalpha beta\n ```\nalpha inside\n```\n # alpha\n{long} alpha\nold alpha"), (None, "beta"), (3, None), (4, "alpha\n```\nbeta")]
    docs = spark.createDataFrame(docs, "id long, text string")
    known = spark.createDataFrame([(long,), ("old alpha",), ("old alpha",), (None,)], "excerpt string")
    phrases = spark.createDataFrame([("alpha",), ("beta",)], "phrase string")
    hits = rt.new_line_hits(docs, phrases, "id", "text", known, r"^\s*#", 10)
    want = {(2, 2, "alpha", "alpha beta"), (2, 2, "beta", "alpha beta"), (None, 1, "beta", "beta"), (4, 1, "alpha", "alpha")}
    rows = [tuple(r) for r in hits.collect()]
    assert set(rows) == want and len(rows) == 4
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
