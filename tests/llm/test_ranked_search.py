"""Ranked search against scoring every document, and the bounds of pairs against what documents reach."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm import ranked_search as rs

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("score", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("terms", T.StringType())])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in w for _, w in split) for q in queries.values() for t in q}
    out = []
    for i, q in queries.items():
        scores = []
        for d, w in split:
            m = 50 + (50 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in q if t in w)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return out


def made(seed=6):
    rng = random.Random(seed)
    common = ["the", "of", "Und", "ÄRGER", "x1"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "w" + str(int(rng.expovariate(0.03)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(120)]  # ties
    docs += [(7, docs[7][1]), (None, docs[9][1]), (901, None), (902, ""), (903, "-- !"), (904, "the " * 50_000)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 30])))) for i in range(25)]
    items += [(3, "the extra w1"), (None, "of w2"), (50, None), (51, "nowhere-to-be-found"), (52, "the the THE")]
    return docs, items


def test_equals_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 40)
    docs, items = made()
    index = rs.build_index(spark.createDataFrame([(*d, "", "") for d in docs], DOCS).repartition(3), pair_terms=12)
    assert index.blocks.count() >= 10
    key = lambda r: (str(r[0]), r[1])
    asked = spark.createDataFrame([(*i, "") for i in items], ITEMS)
    want = sorted(brute(docs, items, 20), key=key)
    assert sorted(map(tuple, rs.search(index, asked, k=20).collect()), key=key) == want
    monkeypatch.setattr(rs, "GROUP", 4)  # queries in several groups
    assert sorted(map(tuple, rs.search(index, asked, k=20).collect()), key=key) == want


def test_pair_bounds_hold_and_are_tighter(spark):
    docs, items = made(8)
    index = rs.build_index(spark.createDataFrame([(*d, "", "") for d in docs], DOCS).coalesce(1), pair_terms=12)
    df = dict(index.counts.collect())
    known = sorted({t for _, x in items for t in terms(x)} & df.keys())
    weights = np.array([rs.weight(index.n_docs, df[t]) for t in known])
    frequent = np.array([index.frequent.index(t) if t in index.frequent else -1 for t in known])
    row = index.blocks.toArrow().to_batches()[0].slice(0, 1)
    block = rs._Block(row, pa.array(known), weights, (index.n_docs, index.total), frequent)
    tighter = 0
    for _, x in items:
        present = sorted((known.index(t) for t in set(terms(x)) if t in df and block.top[known.index(t)] > 0), key=lambda t: (block.top[t], t))
        bounds, reached, plain = block.bounds(present), np.zeros(len(block.n), np.int64), 0
        for i, t in enumerate(present):
            where, adds = block.postings(t)
            reached[where] += adds
            plain += block.top[t]
            assert reached.max() <= bounds[i + 1] <= plain and bounds[i] <= bounds[i + 1]
            tighter += bounds[i + 1] < plain
    assert tighter > 20


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", "")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert rs.build_index(docs.limit(0)) is None
    assert rs.search(None, items).collect() == [] and rs.search(rs.build_index(docs), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in rs.search(rs.build_index(docs), items).collect()] == [(1, 1, 1)]


def test_files_of_the_index_hold_few_blocks(spark, monkeypatch):
    """Blocks are megabytes, and Spark reads a file's rows together."""
    monkeypatch.setattr(rs, "BLOCK_DOCS", 10)
    docs = spark.createDataFrame([(i, f"word{i % 7} and more") for i in range(100)], "doc_id long, text string").coalesce(1)
    files = rs.build_index(docs).blocks.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 10 and max(r["count"] for r in files) <= rs.FILE_BLOCKS
