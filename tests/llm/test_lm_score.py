import math
import random
import zlib
from collections import Counter

import numpy as np

from phaseloom.llm import lm_score
from phaseloom.llm.common import stored


def brute(rows):
    toks = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    grams = [Counter(), Counter(), Counter()]
    for t, h in zip(toks, held, strict=True):
        if not h:
            after = [None, *t]
            grams[0].update((x,) for x in t)
            grams[1].update(zip(after, t, strict=False))
            grams[2].update(zip(after, after[1:], after[2:], strict=False))
    n, v = sum(grams[0].values()), len(grams[0])
    mass = []
    for k in (0, 1):
        histories = Counter(int(x) for x in lm_score.bins(np.array([*grams[k].values()])))
        mass.append(lm_score.mass_for(sum(c == 1 for c in grams[k + 1].values()), sorted(histories.items())))

    def p(history, w):
        if not history:
            return (grams[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        m = mass[len(history) - 1]
        return (grams[len(history)][*history, w] + m * p(history[1:], w)) / (grams[len(history) - 1][history] + m)

    out = []
    for (i, _), t, h in zip(rows, toks, held, strict=True):
        after = (None, *t)
        base = sum(math.log10(p((), w)) for w in t)
        score = sum(math.log10(p(after[max(k - 1, 0) : k + 1], w)) for k, w in enumerate(t))
        out.append((i, h, len(t), sum(grams[0][(w,)] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def test_scores_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdé", k=rng.choice([1, 2, 3]))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    rows += [(None, "a b a b"), (3, None), (3, "A\tB\x0b a"), (400, "qqq zzz"), (5, rows[5][1]), (5, rows[5][1])]
    df = stored(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3), "lm-test")
    want = brute(rows)
    for block, bucket in ((3000, 40), (10_000_000, 2_000_000)):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        monkeypatch.setattr(lm_score, "BUCKET", bucket)
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.lm_scores(df).collect()), key=repr)
        assert got == want
    named = df.withColumn("doc_id", df.doc_id.cast("decimal(12,0)"))
    assert sorted((r.doc_id is None, int(r.doc_id or 0)) for r in lm_score.lm_scores(named).select("doc_id").collect()) == sorted((i is None, i or 0) for i, _ in rows)


def test_counts_do_not_wrap():
    wide = np.array([0, 1, 255, 5_000_000_000, 2**62], np.int64)
    assert (lm_score._unpacked(lm_score._packed(wide), np.int64) == wide).all()
    assert lm_score.bins(np.array([1, 64, 65, 5_000_000_000])).tolist()[:3] == [1, 64, 64]


def test_probabilities_of_a_state_add_up():
    """Over all words, known and unknown, each history's probabilities sum to 1."""
    counts = [np.array([4, 3, 2, 0]), np.array([2, 1, 1, 0] + [0] * 12), np.zeros(0, np.int64)]
    history, word = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    none = np.zeros(0, np.int64)
    m = lm_score.BackoffAutomaton.build(counts, [history, none], [word, none], 9, 3, (1.7, 1.0))
    start = 0
    seen = np.array([10 ** m.traverse(np.array([w]), np.array([w]), np.array([-1]), start)[0] for w in range(4)])
    rest = 1.7 / (4 + 1.7)
    want = np.array([2, 1, 1, 0]) / (4 + 1.7) + rest * (np.array([4, 3, 2, 0]) + 0.1) / (9 + 0.1 * 4)
    assert np.allclose(seen, want) and np.isclose(seen.sum(), 1)


def test_empty_table(spark):
    assert lm_score.lm_scores(stored(spark.createDataFrame([], "doc_id long, text string"), "lm-test")).count() == 0
