"""Quality rules from suffix arrays over the words of each text.

A suffix array of each text's words is built by prefix doubling with numpy, many texts at once; ranks of 1, 2, 4, ...
words give the longest common prefix of neighbours, whose intervals are the maximal repeated substrings. Their spans are
united; a text fails if repeats cover too much of it or one of them is too long. Texts are read where they lie: no
shuffle. Memory is that of BYTES of text or of the longest text: about 8 bytes for each word and each doubling of the
longest repeat, some 200 times a text of one-letter words that repeats throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, table

#: Bytes of texts whose suffixes are sorted at once.
BYTES = 2_400_000
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def longest_repeats(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of equal keys that starts there and somewhere else too.

    Keys of different texts must differ; end holds, for each position, where its text ends.
    """
    n = len(key)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0], fresh[1:] = True, key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    paired = rank[order[1:]] == rank[order[:-1]]
    levels, step = [rank], 1
    live = np.flatnonzero(np.append(False, paired) | np.append(paired, False))
    while live.size:
        at = order[live]
        ahead = at + step
        follow = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        both = rank[at] * (n + 1) + follow + 1
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[live] = at
        fresh = np.append(True, both[1:] != both[:-1])
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(at)))
        rank = rank.copy()
        rank[at] = np.repeat(live[first], count)
        live = live[np.repeat(count > 1, count)]
        levels.append(rank)
        step *= 2
    pairs = np.flatnonzero(paired)
    a, b = order[pairs], order[pairs + 1]
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _covered(start: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions inside the spans [start, start+size), counted for each text."""
    n = int(bounds[-1])
    step = np.bincount(start, minlength=n + 1).astype(np.int64) - np.bincount(start + size, minlength=n + 1)
    inside = np.append(0, np.cumsum(np.cumsum(step)[:n] > 0))
    return inside[bounds[1:]] - inside[bounds[:-1]]


def profile(texts: list[str], window: int = 8, min_words: int = 4) -> dict[str, np.ndarray]:
    """Word, symbol, line and repeat counts of each text.

    n_repeat_words: words in windows of so many words that are found twice or more; covered_words: words in maximal
    repeats of min_words words or more; longest_repeat: words of the longest repeat.
    """
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    seqs, chars, symbols, lines = [], [], [], []
    for text in texts:
        raw = text.encode()
        words = raw.split()
        seqs.append(np.fromiter((number(w, len(ids)) for w in words), np.int64, len(words)))
        chars.append(len(text) - len(raw) + len(raw.translate(None, SPACE)))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        with_word = [x for x in raw.split(b"\n") if x.strip()]
        lines.append(len(with_word) - len(set(with_word)))
    sizes = np.array([len(s) for s in seqs], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    doc = np.repeat(np.arange(len(seqs)), sizes)
    key = np.concatenate([*seqs, np.zeros(0, np.int64)]) + doc * (len(ids) + 1)
    longest = longest_repeats(key, bounds[1:][doc])
    at = np.flatnonzero(longest >= window)
    wide = np.flatnonzero(longest >= min_words)
    top = np.zeros(len(seqs), np.int64)
    np.maximum.at(top, doc, longest)
    as_long = lambda x: np.array(x, np.int64)
    return {
        "n_words": sizes, "word_chars": as_long(chars), "n_symbols": as_long(symbols), "n_dup_lines": as_long(lines),
        "n_repeat_words": _covered(at, np.full(len(at), window), bounds), "covered_words": _covered(wide, longest[wide], bounds), "longest_repeat": top,
    }


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality(docs: DataFrame, text_col: str = "text", max_covered: float = 0.4, max_longest: float = 0.2, longest_free: int = 30) -> DataFrame:
    """docs with the counts of profile(), base_failed and kept; one row for each row of docs.

    kept is false where base_failed is true, where maximal repeats of 4 words or more cover more than max_covered of the
    words, or where the longest repeat has over longest_free words and over max_longest of the words. A null text counts
    as an empty one: no words, base_failed. Columns of docs with the names of the results are replaced.
    """
    docs = docs.drop(*FIELDS, "base_failed", "kept")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f, T.LongType(), False) for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, BYTES):
                found = profile([t or "" for t in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[f]) for f in FIELDS)], names=[*batch.schema.names, *FIELDS])
        give_back()

    out = docs.mapInArrow(run, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    repetitive = (F.col("covered_words") > max_covered * F.col("n_words")) | ((F.col("longest_repeat") > longest_free) & (F.col("longest_repeat") > max_longest * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~repetitive)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")
