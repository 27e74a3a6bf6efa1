import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from phaseloom.llm import quality


def brute(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=5))
def test_longest_repeats(docs):
    flat = [ord(w) + 1000 * d for d, ws in enumerate(docs) for w in ws]
    ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs]) if docs else np.zeros(0, int)
    got = quality.longest_repeats(np.array(flat, np.int64), ends.astype(np.int64))
    assert got.tolist() == [x for d in docs for x in brute(d)]


def test_profile_counts():
    line = "one two three four five six seven eight"
    texts = ["", " \t ", f"{line}\n{line}\n\n\n x", "ä b c # %\x0b|", " ".join(f"w{i}" for i in range(50))]
    got = quality.profile(texts)
    assert got["n_words"].tolist() == [0, 0, 17, 5, 50]
    assert got["n_repeat_words"].tolist() == [0, 0, 16, 0, 0]
    assert got["n_dup_lines"].tolist() == [0, 0, 1, 0, 0]
    assert got["n_symbols"].tolist() == [0, 0, 0, 3, 0]
    assert got["word_chars"].tolist()[3] == len("äb c#%|")
    assert got["longest_repeat"].tolist() == [0, 0, 8, 0, 0]


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "go " * 40, "z"), (3, " ".join(f"w{i}" for i in range(40)), None), (3, " ".join(f"w{i}" for i in range(40)), None)], "doc_id long, text string, kept string")
    rows = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.quality(docs).collect()}
    assert rows == {(1, 0, True, False), (None, 0, True, False), (2, 40, True, False), (3, 40, False, True)}
    assert quality.quality(docs.limit(0)).count() == 0


def brute_profile(text, window=8, least=4):
    """All counts of a text by plain loops over its words and lines."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    n, repeats = len(words), brute(words)
    inside, covered = [False] * n, [False] * n
    for i in range(n):
        if repeats[i] >= window:
            inside[i : i + window] = [True] * window
        if repeats[i] >= least:
            covered[i : i + repeats[i]] = [True] * repeats[i]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "[#*$%&|<>]"[1:-1] for c in text), "n_dup_lines": dup,
        "n_repeat_words": sum(inside), "covered_words": sum(covered), "longest_repeat": max(repeats, default=0),
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "#x", "\n", "a b c d e f g h\n", "\t", "|"]), max_size=40).map(" ".join), max_size=4))
def test_profile_against_loops(texts):
    got = quality.profile(texts)
    for k, text in enumerate(texts):
        assert {f: int(v[k]) for f, v in got.items()} == brute_profile(text)


def test_long_texts_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, 1), (2, long + " " + long, 2), (2, "tie tie", 3), (2, "tie tie", 3)], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id, r.n_words, r.longest_repeat, r.kept) for r in quality.quality(docs).collect())
    assert got == [(1, 300_000, 0, True), (2, 2, 1, False), (2, 2, 1, False), (2, 600_000, 300_000, False)]
