import random

import pytest

from phaseloom.llm import near_dedup
from phaseloom.llm.components import components


def brute(docs, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(docs))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    big = [word() for _ in range(120)]
    for _ in range(90):  # one large group, links only between some of its members
        w = list(big)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [" ".join(passage + [word() for _ in range(30)]) for _ in range(40)]
    docs += ["", None, "  ", "one", "One", "one two", "x " * 500]
    rng.shuffle(docs)
    return [(i + 5, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("size", [4, 5])
def test_components_match_brute_force(spark, planted, size):
    df = spark.createDataFrame([(*x, "s") for x in planted], "doc_id long, text string, kept string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, size).collect())
    assert got == brute(planted, size, 80)


def test_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "zz yy xx ww vv"), (None, "A b c d e f"), (None, "only here it is now"), (7, None), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0), r.kept) for r in near_dedup.near_duplicates(df, 4).collect())
    assert got == [(0, 2, 0, True), (0, 3, 1, False), (1, 2, 1, True), (1, 3, 1, True), (1, 3, 1, True), (7, 0, 7, True), (7, 0, 7, True)]
    assert near_dedup.near_duplicates(df.limit(0), 4).count() == 0
    assert near_dedup.deduplicate(df, 4).count() == 6


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (900, 900)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == 500 and roots[900] == 900


def test_hot_keys_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    """One line in all documents, one group of near copies of half of them: every join meets hot keys."""
    from phaseloom.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    monkeypatch.setattr(near_dedup, "PAIRS", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared, base = [word() for _ in range(25)], [word() for _ in range(90)]
    docs = []
    for i in range(160):
        own = list(base) if i % 2 else [word() for _ in range(rng.choice([5, 40, 90]))]
        for _ in range(rng.choice([0, 1, 2])):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(shared + own)))
    docs += [(200, docs[1][1]), (201, docs[1][1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert got == brute(docs, 5, 80)


def test_components_of_a_star_and_a_hub(spark, monkeypatch):
    from phaseloom.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    links = [(0, i) for i in range(1, 60)] + [(i, 100) for i in range(70, 99)] + [(59, 98), (200, 201)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[x] == 0 for link in links[:-1] for x in link) and roots[201] == roots[200] == 200
