"""The kernel against set arithmetic, held-out accuracy on made-up languages, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from phaseloom.llm import lang_id

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "lun"], "bb": ["sch", "ei", "ung", "ver", "lun"], "cc": ["ção", "nh", "ei", "mente", "lun"]}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)).capitalize()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    langs = ["aa"] * 240 + ["bb"] * 50 + ["cc"] * 8  # one language holds most rows
    return [(i, text_of(rng, x, rng.randint(3, 40)), x, "clash") for i, x in enumerate(langs)]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = f" {' '.join(words)} "
    return {padded[i : i + n] for n in lang_id.SIZES for i in range(len(padded) - n + 1)} if words else set()


def test_kernel_counts_common_grams(texts):
    sample = [t for _, t, _, _ in texts[:6] + texts[-6:]] + ["A--b 12 c", "!?", "", None]
    rows = np.zeros((len(sample), lang_id.BUCKETS), np.float32)
    some = lang_id.presence(sample, lang_id.Letters(), rows)
    assert some.tolist() == [True] * 13 + [False] * 3
    exact = [grams(t or "") for t in sample]
    for i, a in enumerate(exact):
        for j, b in enumerate(exact):
            assert abs(rows[i] @ rows[j] - len(a & b)) <= 2 + 0.02 * len(a | b)  # n-grams may share a bucket


def test_long_texts_are_read_in_pieces_whole(monkeypatch):
    text = "abcdefghij klmnop " * 40 + "wxyz"
    a, b = np.zeros((1, lang_id.BUCKETS), np.float32), np.zeros((1, lang_id.BUCKETS), np.float32)
    lang_id.presence([text], lang_id.Letters(), a)
    monkeypatch.setattr(lang_id, "PIECE", 7)
    lang_id.presence([text], lang_id.Letters(), b)
    assert np.array_equal(a, b)


def test_held_out_accuracy_and_odd_rows(spark, texts):
    df = spark.createDataFrame([*texts, *texts[:40]], SCHEMA).repartition(3)  # rows repeat
    model = lang_id.train(df)
    rng = random.Random(9)
    new = [(10_000 + i, text_of(rng, x, 30), x, "") for i, x in enumerate(["aa", "bb", "cc"] * 30)]
    odd = [(1, None, "aa", ""), (2, "", "aa", ""), (3, "12 !!", "bb", ""), (None, "kato mira lun kato", None, ""), (5, "kato " * 200_000, None, ""), (5, "x", "aa", "")]
    out = lang_id.identify(spark.createDataFrame(new + odd, SCHEMA), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(new) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    fresh = [r for r in rows if (r.doc_id or 0) >= 10_000]
    assert sum(r.lang == r.lang_pred for r in fresh) >= 0.98 * len(fresh)
    assert [r.lang_pred for r in rows if r.text in (None, "", "12 !!")] == ["und"] * 3
    assert {r.lang_pred for r in rows if r.text and r.text.startswith("kato ")} == {"aa"}


def test_nothing_to_learn_and_empty_tables(spark, texts):
    none = spark.createDataFrame([(1, "kato", None, ""), (2, None, "aa", "")], SCHEMA)
    assert lang_id.train(none) is None
    assert [r.lang_pred for r in lang_id.identify(none, None).collect()] == ["und", "und"]
    model = lang_id.train(spark.createDataFrame(texts[:3], SCHEMA))  # one language
    assert lang_id.identify(none.limit(0), model).count() == 0
    assert {r.lang_pred for r in lang_id.identify(none, model).collect()} == {"aa", "und"}
