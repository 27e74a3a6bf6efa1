import numpy as np
import pytest

from phaseloom.operators import claims as cm
from phaseloom.operators import complexity as cx
from phaseloom.operators import evaluation as ev
from phaseloom.operators import nulls as nl
from phaseloom.operators import plugins as pl
from phaseloom.operators import relational as rel
from phaseloom.operators import retrieval as rt


def windows(spark, x):
    """x[channel, sample] as one window."""
    rows = [("r", 0, c, k, float(v)) for c, row in enumerate(x) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "recording_id string, w int, channel long, k int, v double")


KEY = ["recording_id", "w"]


def test_evoked_complexity_against_loops(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 24))
    x[:, 10:] += 4 * np.sin(np.arange(14)) * rng.normal(size=(3, 1))
    base, resp = slice(0, 10), slice(10, 24)
    s, vt = np.linalg.svd(x[:, resp].T, full_matrices=False)[1:]
    n = next(k for k in range(1, 4) if (s[:k] ** 2).sum() / (s**2).sum() >= 0.99)
    total = 0.0
    for comp in vt[:n] @ x:
        if not np.sqrt((comp[resp] ** 2).mean() / (comp[base] ** 2).mean()) > 1.1:
            continue
        dist = [[abs(a - b) for a in comp[p] for b in comp[p]] for p in (base, resp)]
        best = 0.0
        for cut in np.linspace(np.median(dist[0]), max(dist[1]), 100):
            rate = []
            for p in (base, resp):
                v = comp[p]
                rate.append(sum((abs(v[i] - v[j]) <= cut) != (abs(v[i] - v[j + 1]) <= cut) for i in range(len(v)) for j in range(len(v) - 1)) / len(v) ** 2)
            best = max(best, rate[1] - 1.2 * rate[0])
        total += best * 14
    got = cx.evoked_complexity(windows(spark, x), KEY, 10).first()
    assert got.complexity == pytest.approx(total) and total > 0
    assert cx.evoked_complexity(windows(spark, np.zeros((2, 8))), KEY, 4).first().complexity == 0


def test_lagged_tests_tell_the_direction(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    b = np.append(0, a[:-1]) + 0.3 * rng.normal(size=200)
    p = {(r.source, r.target, r.lag): r.p for r in cx.lagged_tests(windows(spark, [a, b]), KEY, 2).collect()}
    assert p[0, 1, 1] < 1e-6 and p[1, 0, 1] > 0.01 and len(p) == 4


def test_tails():
    assert pl.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert pl.f_tail(3.708265, 3, 10) == pytest.approx(0.05, abs=1e-6)
    assert pl.f_tail(0.0, 2, 5) == 1


def test_spatial_clusters_and_their_links(spark):
    near = [(0, 0), (0, 1), (1, 0), (1, 1)]
    rows = [("z", t, f"{t}-{i}", float(x + t), float(y), 1.0) for t in (0, 1) for i, (x, y) in enumerate(near)]
    rows += [("z", 0, "far", 50.0, 50.0, -1.0), ("z", 2, "alone", 0.0, 0.0, 1.0)]
    c = cx.spatial_clusters(spark.createDataFrame(rows, "z string, t int, id string, x double, y double, charge double"), ["z", "t"], 3).cache()
    got = {(r.t, r.cluster): (r.x, r.charge, r["size"], r.eps) for r in c.collect()}
    assert got[0, 0] == (0.5, 4.0, 4, 1.0) and got[1, 0][0] == 1.5 and got[0, -1][1:3] == (-1.0, 1) and got[2, -1][2] == 1 and (2, 0) not in got
    assert [(r.t, r.cluster, r.next) for r in cx.cluster_links(c, ["z"], "t").collect()] == [(0, 0, 0)]


def test_spins_use_each_sensor_once(spark):
    s = spark.createDataFrame([(c, float(c % 4), float(c // 4)) for c in range(8)], "channel long, x double, y double")
    spins = {}
    for r in cx.spin_assignments(s, 12, 3).collect():
        spins.setdefault(r.spin, {})[r.channel] = r.source
    assert len(spins) == 13 and all(sorted(m.values()) == list(range(8)) for m in spins.values())
    assert all(k == v for k, v in spins[0].items()) and len({tuple(sorted(m.items())) for m in spins.values()}) > 3


def test_common_phase_keeps_spectra_and_lags(spark):
    x = np.random.default_rng(1).normal(size=(3, 16))
    got = nl.common_phase(windows(spark, x), KEY, 1, "s").toPandas().pivot(index="channel", columns="k", values="v").to_numpy()
    a, b = np.fft.rfft(x, axis=1), np.fft.rfft(got, axis=1)
    assert np.allclose(abs(a), abs(b)) and np.allclose(a[0] * a[1].conj(), b[0] * b[1].conj()) and not np.allclose(x, got)


def test_mean_square_spread_against_pairs(spark):
    v = np.random.default_rng(3).normal(size=(7, 4))
    df = spark.createDataFrame([("a", [float(x) for x in row]) for row in v], "label string, e array<double>")
    want = np.mean([((v[i] - v[j]) ** 2).sum() for i in range(7) for j in range(i)])
    assert nl.mean_square_spread(df, ["label"], "e").first().mean_square == pytest.approx(want)


def test_blocked_test_finds_the_design(spark):
    rng = np.random.default_rng(6)
    paired = [(s, g, float(s + (g == "a") + 0.1 * rng.normal())) for s in range(12) for g in "ab"]
    split = [(s, "ab"[s % 2], float(5 * (s % 2) + 0.1 * rng.normal())) for s in range(24) for _ in range(3)]
    run = lambda rows, **k: ev.subject_blocked_test(spark.createDataFrame(rows, "s int, g string, v double"), "s", "g", "v", 99, "t", **k).first()
    assert (run(paired).method, run(split).method) == ("paired", "between")
    assert run(paired).p < 0.05 and run(paired, alternative="less").p > 0.9 and run(split, alternative="less").p < 0.05
    with pytest.raises(ValueError, match="two groups"):
        run([(1, "a", 1.0), (2, "a", 2.0)])


def test_phrases_of_any_length_inside_words(spark):
    words = " ".join(f"w{k}" for k in range(70))
    texts = {1: "Unit One two threesome", 2: "one  two\nthree", 3: "one two", 4: None, 5: "stone two three four fives", 6: f"x{words}y", 7: "ñ. a b", 8: ""}
    phrases = ["one two three", "one two", "two three four five", words, words[:-1] + "x", "ñ", "ne", "thr", "a b", "e t", "zz", "two", "ones two"]
    docs = spark.createDataFrame([*texts.items(), (3, "one two")], "id int, text string")
    got = sorted((r.id, r.hits) for r in rt.phrase_scan(docs, spark.createDataFrame([(p,) for p in phrases], "phrase string"), "id", "text").collect())
    want = [(i, sorted(p for p in phrases if p in " ".join((t or "").lower().split()))) for i, t in [*texts.items(), (3, "one two")]]
    assert got == sorted(want)
    assert {r.status for r in rt.phrase_scan(docs, spark.createDataFrame([], "phrase string"), "id", "text").collect()} == {"clean"}


def test_phrases_are_found_where_texts_are_read(spark, monkeypatch):
    rows = [(1, "One two three"), (1, "One two three"), (None, "two"), (2, None), (3, "tw o")]
    docs = spark.createDataFrame(rows, "id int, text string")
    phrases = spark.createDataFrame([("one two",), ("two",), ("",), (None,), ("two",), ("e t",), ("three one",)], "phrase string")
    plan = rt.phrase_matches(docs, ["id"], "text", phrases)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Generate", "Aggregate"))
    want = [(None, "two"), *[(1, p) for p in ("e t", "one two", "two") for _ in "ab"]]
    for size in (rt.PHRASE_BYTES, 5):  # all phrases at once; in groups
        monkeypatch.setattr(rt, "PHRASE_BYTES", size)
        monkeypatch.setattr(rt, "PLACES", size)
        got = [(r.id, r.phrase) for r in rt.line_hits(docs, phrases, "id", "text").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)  # as many as rows of the table, those without an id too


def test_phrases_in_against_brute_force():
    rng = np.random.default_rng(8)
    for letters in ("ab", "abc ", "añ b", "a"):
        texts = ["".join(rng.choice(list(letters), n)).encode() for n in (0, 1, 300, 0, 7, 40, 150, 0)]
        phrases = {"".join(rng.choice(list(letters), n)).encode() for n in range(1, 14)} | {texts[2][i : i + n] for i, n in ((0, 300), (3, 64), (90, 129), (200, 100))} | {texts[2] + texts[4]}
        phrases, ends = sorted(phrases), np.cumsum([0, *map(len, texts)])
        want = [(i, k) for i, t in enumerate(texts) for k, p in enumerate(phrases) if p in t]
        for places in (1, 50, 1000):
            row, which = rt.phrases_in(b"".join(texts), ends, rt.phrase_table(phrases), places)
            assert sorted(zip(row.tolist(), which.tolist(), strict=True)) == want


def test_claims_and_tiers(spark):
    docs = spark.createDataFrame([(1, "  Soul proves it\r\nplain\nEEG entropy "), (2, None), (3, "An exit cost\n\ninstant arhat, it proves")], "id int, text string")
    got = {r.claim_id: r for r in cm.tiered(cm.claims(docs, "id", "text")).collect()}
    assert sorted(got) == ["1_c0000", "1_c0001", "3_c0000", "3_c0001"]
    assert got["1_c0000"].categories == ["speculation"] and got["1_c0000"].status == "quarantine_only" and got["1_c0000"].needs_rewrite
    assert got["1_c0001"].text == "EEG entropy" and got["1_c0001"].tier == "research_hypothesis" and got["1_c0001"].flags == []
    assert (got["3_c0000"].status, got["3_c0001"].tier, got["3_c0001"].flags) == ("book_safe", "unsafe_or_requires_rewrite", ["unsafe"])
