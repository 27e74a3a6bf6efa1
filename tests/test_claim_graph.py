"""Scopes, bridges and promotion states of a few subjects, worked out by hand."""

from phaseloom.operators import claim_graph as cg

SCOPES = [("base", 0, False), ("one", 1, True), ("two", 2, True), ("far", 3, True)]
NEEDS = [("one", "a"), ("two", "a"), ("two", "b"), ("far", "c")]
BRIDGES = [("x", "base", "one", True, False, False), ("y", "one", "two", True, True, False), ("z", "two", "far", True, False, True), ("back", "two", "one", False, False, False)]


def _tables(spark):
    subjects = spark.createDataFrame([("all", False), ("mock", True), ("few", False), ("unseen", False), ("noreview", False)], "s string, mock boolean")
    have = [("all", e) for e in ("a", "b", "c", "review")] + [("mock", e) for e in ("a", "b", "review")] + [("few", "b"), ("few", "review"), ("noreview", "a"), ("noreview", "b"), ("noreview", "b")]
    rules = [
        spark.createDataFrame(SCOPES, "scope string, level int, needs_real boolean"), spark.createDataFrame(NEEDS, "scope string, evidence string"),
        spark.createDataFrame(BRIDGES, "bridge string, source string, target string, needs_real boolean, needs_review boolean, quarantined boolean"), spark.createDataFrame([("x", "a")], "bridge string, evidence string"),
    ]
    return subjects, spark.createDataFrame(have, "s string, evidence string"), rules


def test_bridges_scopes_and_states(spark):
    subjects, have, (scopes, needs, bridges, bridge_needs) = _tables(spark)
    statuses = cg.bridge_statuses(subjects, "s", have, bridges, bridge_needs)
    got = {(r.s, r.bridge): r.status for r in statuses.collect()}
    assert {got[s, "z"] for s in ("all", "mock", "few", "unseen", "noreview")} == {"quarantined"}
    assert (got["all", "x"], got["mock", "x"], got["few", "x"]) == ("promotable", "blocked_pending_real_execution", "blocked_pending_evidence")
    assert (got["all", "y"], got["noreview", "y"], got["mock", "back"]) == ("promotable", "blocked_pending_review", "promotable")
    m = {(r.s, r.scope): r for r in cg.claim_matrix(subjects, "s", have, scopes, needs, statuses, "base").collect()}
    assert len(m) == 20
    assert {s: m[s, "base"].max_scope for s in ("all", "mock", "few", "unseen", "noreview")} == {"all": "two", "mock": "base", "few": "base", "unseen": "base", "noreview": "one"}
    assert m["all", "far"].allowed and not m["all", "far"].reached  # only a quarantined bridge leads there
    assert m["mock", "two"].blockers == ["real_execution"] and m["few", "two"].blockers == ["a"]
    state = {r.s: r.promotion_state for r in cg.promotion_state(subjects, "s", have, "a", ["b"], "c", "d").collect()}
    assert state == {"all": "empirical_candidate", "mock": "engineering_validated", "few": "blocked_pending_real_execution", "unseen": "blocked_pending_real_execution", "noreview": "blocked_pending_review"}


def test_ledger(spark):
    claims = spark.createDataFrame([(i, "k" if i == 2 else "o", 5.0, 5.0, 5.0, 5.0, 5.0, 0.0, i == 3) for i in (1, 2, 3)], "c long, k string, support double, depth double, coherence double, falsifiable double, relevance double, overclaim double, no boolean")
    weights = {"support": 0.3, "depth": 0.2, "coherence": 0.15, "falsifiable": 0.2, "relevance": 0.15, "overclaim": -0.25}
    links, against = spark.createDataFrame([(1, "p2"), (1, "p1"), (1, "p1"), (9, "p3")], "c long, source string"), spark.createDataFrame([(2, 5), (2, 5), (2, 6)], "c long, falsifier long")
    got = {r.c: r for r in cg.ledger(claims, "c", "k", weights, "no", spark.createDataFrame([("k", "B")], "k string, ceiling string"), links, against).collect()}
    assert [(got[i].status, got[i].event_id, got[i].n_falsifiers, got[i].source_ids) for i in (1, 2, 3)] == [("A", "SEED-001", 0, ["p1", "p2"]), ("B", "SEED-002", 2, []), ("X", "SEED-003", 0, [])]
