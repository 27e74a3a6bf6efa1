from phaseloom.plans import catalog, q_eval

DIR = "/root/testdata/sf0.001"


def test_gate_can_pass_at_one_in_twenty(spark):
    rows = catalog.queries()["v3_surrogate_gate"](spark, DIR).collect()
    assert rows and all(abs(r.p * 201 - round(r.p * 201)) < 1e-9 and r.n_failed == 0 for r in rows)


def test_bootstrap_draws_two_thousand(spark):
    whole = q_eval._a9(spark, DIR, 2_000).collect()
    assert sorted(catalog.queries()["a9_bootstrap_interval"](spark, DIR).collect()) == sorted(whole)
