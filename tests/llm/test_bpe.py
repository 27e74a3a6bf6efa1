import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phaseloom.llm import bpe

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
CODEC = bpe.BpeCodec(SPEC)
ORACLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = st.one_of(st.sampled_from(list("  \n\t'aesthingrdlmv'0123éßñ.,!<|>")), st.characters(codec="utf-8"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(ALPHABET, max_size=60), st.lists(st.sampled_from([" the", "\n", "  ", "<|endoftext|>", "don't", " \n ", "aaaa", "\x1c", "\x85", "​", "ñandú", " 123", "'ll"]), max_size=12).map("".join)))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == ORACLE.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(ids) == ORACLE.decode(ids.tolist(), skip_special_tokens=False) == text


def test_ties_and_long_runs():
    for text in ["a" * n for n in range(1, 40)] + ["ab" * 30, "-" * 100, "=" * 5000, " " * 77, "\n" * 33 + "x", "haha" * 50]:
        assert CODEC.encode(text).tolist() == ORACLE.encode(text, add_special_tokens=False).ids


def test_small_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    monkeypatch.setattr(bpe, "VERDICTS", 20)
    monkeypatch.setattr(bpe, "EDGES", 5)
    codec = bpe.BpeCodec(SPEC)
    text = open(bpe.__file__, encoding="utf-8").read()
    assert codec.encode(text).tolist() == ORACLE.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "don't stop", "x", "y"), (1, "don't stop", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (None, "word " * 200_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").selectExpr("*", "7 AS n_tokens")
    got = bpe.tokenize(docs, decoded=True).collect()
    assert sorted((r.doc_id or 0, r.decoded, r.n_tokens) for r in got) == sorted((i or 0, t or "", 7) for i, t, *_ in rows)
    assert all(r.ids == ORACLE.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert bpe.tokenize(docs.limit(0), decoded=True).count() == 0


def test_vocabulary_without_a_byte_is_refused():
    spec = json.loads(SPEC)
    byte = next(t for t, i in spec["model"]["vocab"].items() if len(t) == 1)
    spec["model"]["merges"] = []
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if len(t) == 1 and t != byte}
    with pytest.raises(ValueError, match="no tokens"):
        bpe.BpeCodec(json.dumps(spec))
