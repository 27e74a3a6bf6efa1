import numpy as np

from phaseloom.llm import toxicity


def test_pairwise_terms_are_learnt():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        t = list(rng.choice(words, 12)) + ["fool"] * insult + ["tribe"] * group
        texts.append(" ".join(t))
        labels.append(int(insult and group))
    terms = toxicity.Terms()
    rows, y = [terms.of(t) for t in texts], np.array(labels)
    model = toxicity.fit(rows[:2000], y[:2000])
    assert ((model.score(rows[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.98
    pair = model.factors[terms.of("fool")[0]] @ model.factors[terms.of("tribe")[0]]
    assert pair > 0


def test_rows(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "a lovely day ") * 2, "a") for i in range(200)] + [(500, None, "b"), (501, "", "b"), (None, "idiot", "c"), (1, "you idiot you idiot", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (1000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 204 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert [r.score >= 0.5 for r in rows if r.doc_id is None] == [True]
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_pairs_without_marginals_are_learnt_from_few_labels():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bcdfghjklm"), 7)) for _ in range(60)]
    mixed = [(a, b) for _ in range(200) for a in ("fool", "fine") for b in ("tribe", "team")]
    texts = [" ".join([*rng.choice(words, 12), a, b]) for a, b in mixed]
    y = np.array([int((a == "fool") == (b == "tribe")) for a, b in mixed])
    rows = [toxicity.Terms().of(t) for t in texts]
    model = toxicity.fit(rows[:400], y[:400])
    assert ((model.score(rows[400:]) >= 0.5) == (y[400:] == 1)).mean() > 0.95


def test_bias_is_learnt_where_no_term_tells():
    texts = [f"only{chr(97 + i)} word{chr(97 + i)}" for i in range(20)]
    rows = [toxicity.Terms().of(t) for t in texts] + [np.zeros(0, np.int32)] * 4
    model = toxicity.fit(rows, np.array([1] * 3 + [0] * 21))
    assert (model.score(rows) < 0.5).all()


def test_raw_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.FactorizationMachine(0.3, rng.normal(size=toxicity.BUCKETS), rng.normal(size=(toxicity.BUCKETS, toxicity.FACTORS)))
    rows = [np.sort(rng.choice(toxicity.BUCKETS, n, replace=False)).astype(np.int32) for n in (0, 1, 2, 7, 40)]
    got = m.raw(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))[0]
    for r, x in zip(rows, got, strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] for k, i in enumerate(r) for j in r[k + 1 :])
        assert np.isclose(x, 0.3 + m.weights[r].sum() + pairs)


def test_long_texts_ties_and_repeated_ids(spark):
    long = "lovely " * 300_000
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "a lovely day") for i in range(60)] + [(70, long), (70, long), (1, "zzz other words")], "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS items")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, 0), (70, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 63 and {r.score >= 0.5 for r in got if r.text == long} == {False}
    assert len({r.score for r in got if r.text == "you idiot"}) == 1
