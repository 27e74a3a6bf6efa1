"""Ranked lexical search: MaxScore with bounds of term pairs.

The index is dealt by documents: each of its rows is a block of some documents with its terms, their postings and greatest
impacts, and, for every pair of the PAIR_TERMS most frequent terms of the corpus, how many of the block's documents hold
both and the greatest joint impact of these. A query goes through the blocks with the score of its K-th best document so
far. Its terms are sorted by greatest impact; the longest prefix that cannot reach that score by itself is not used to find
documents, and a block whose every term lies in it is skipped. A prefix's bound is not the sum of the greatest impacts: its
frequent terms are matched in pairs, and a pair counts with its joint maximum, or that of one term alone. Documents found by
the other terms are completed term by term while the bound of the rest lets them reach the score.

Texts never move: statistics send one number a term and task, blocks are written where they are made, and a search sends
at most K documents a query and task. Impacts and scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import LOWER, UPPER, give_back, slices, stored, table

K = 50
#: Terms whose pairs have lists: those in the most documents.
PAIR_TERMS = 128
#: A block's documents and bytes of text, at most; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 4_096, 8_000_000
#: Blocks of a file.
FILE_BLOCKS = 2
#: Terms whose counts a task holds before it hands them on.
COUNTED = 200_000
#: Queries and bytes of their texts that go through the index at once.
GROUP, GROUP_BYTES = 2_000, 4_000_000

_TERM_BYTES = frozenset(b"0123456789" + LOWER.encode() + bytes(range(0x80, 0x100)))
#: A-Z become a-z, other bytes outside terms become spaces.
_FOLD = bytes(b if b in _TERM_BYTES else 0x20 for b in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        out = self[key] = len(self)
        return out


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, total), stored: documents that hold the term; the row without a term has the documents with terms and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = Counter(), 0, 0

        def out(last: bool) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array([t.decode() for t in df] + [None] * last, pa.string()), pa.array([*df.values(), *[n] * last], pa.int64()), pa.array([0] * len(df) + [total] * last, pa.int64())], names=["term", "df", "total"]
            )
            df.clear()
            return rows

        for b in batches:
            for part in slices(b, text_col, BLOCK_BYTES):
                for text in part.column(text_col).to_pylist():
                    words = terms_of(text)
                    df.update(set(words))
                    n, total = n + bool(words), total + len(words)
                if len(df) > COUNTED:
                    yield out(False)
        yield out(True)
        give_back()

    parts = docs.select(text_col).mapInArrow(run, "term string, df long, total long")
    return stored(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "term-counts")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds for each unit of its weight to documents of n terms that hold it tf times."""
    m = 50 + (50 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Index:
    #: One row a block: doc_ids, lengths, terms, dfs, docs, tfs, maxima, both, joint.
    blocks: DataFrame
    #: One row a term: in how many documents it is.
    counts: DataFrame
    n_docs: int
    total: int
    #: The frequent terms and their weights.
    frequent: list[str]
    weights: list[int]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_terms: int = PAIR_TERMS) -> Index | None:
    """Index of all rows of docs, in the shared folder; None where no text has a term. Other columns are not read."""
    counts = statistics(docs, text_col)
    whole = counts.filter("term is null").first()
    if whole is None or not whole["df"]:
        return None
    n_docs, total = whole["df"], whole["total"]
    top = counts.filter("term is not null").orderBy(F.desc("df"), "term").limit(pair_terms).collect()
    frequent, weights = [r["term"] for r in top], [weight(n_docs, r["df"]) for r in top]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_list, blob = T.ArrayType(T.LongType()), T.BinaryType()
    fields = {"doc_ids": T.ArrayType(source.schema["id"].dataType), "lengths": long_list, "terms": T.ArrayType(T.StringType()), "dfs": long_list, "docs": blob, "tfs": blob, "maxima": long_list, "both": blob, "joint": blob}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        numbers, lengths, seqs = _Numbers(), [], []
        for text in part.column("text").to_pylist():
            words = terms_of(text)
            lengths.append(len(words))
            seqs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        n = np.array(lengths, np.int64)
        key, tf = np.unique(np.concatenate(seqs) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, doc = key // len(n), key % len(n)
        starts = np.searchsorted(term, np.arange(len(numbers) + 1))
        g = impacts(tf, n[doc], n_docs, total)
        maxima = np.maximum.reduceat(g, starts[:-1]) if len(g) else np.zeros(0, np.int64)
        dense = np.zeros((len(frequent), len(n)), np.int64)
        for f, (t, w) in enumerate(zip(frequent, weights, strict=True)):
            at = numbers.get(t.encode())
            if at is not None:
                here = slice(starts[at], starts[at + 1])
                dense[f, doc[here]] = w * g[here] + 1  # 1 marks presence where the weight is 0
        both, joint = np.zeros((len(frequent), len(frequent)), np.int32), np.zeros((len(frequent), len(frequent)), np.int64)
        for f, row in enumerate(dense):
            held = np.flatnonzero(row)
            if len(held):
                others = dense[: f + 1, held]
                there = others > 0
                both[f, : f + 1] = there.sum(1)
                joint[f, : f + 1] = np.where(there, others + row[held] - 2, 0).max(1)
        one = lambda v, t: pa.array([v], pa.list_(t))
        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
        return pa.RecordBatch.from_arrays(
            [
                ids, one(n, pa.int64()), one([t.decode() for t in numbers], pa.string()), one(np.diff(starts), pa.int64()), pa.array([doc.astype(np.uint16).tobytes()], pa.binary()), pa.array([tf.astype(np.uint32).tobytes()], pa.binary()),
                one(maxima, pa.int64()), pa.array([both.tobytes()], pa.binary()), pa.array([joint.tobytes()], pa.binary()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", BLOCK_BYTES, BLOCK_DOCS):
                yield block(part)
        give_back()

    return Index(stored(source.mapInArrow(run, schema), "search-blocks", FILE_BLOCKS), counts.filter("term is not null").select("term", "df"), n_docs, total, frequent, weights)


class _Block:
    def __init__(self, row: pa.RecordBatch, terms: pa.Array, weights: np.ndarray, index: tuple[int, int], frequent: np.ndarray):
        column = lambda name: row.column(row.schema.get_field_index(name))[0]
        self.ids, self.n = column("doc_ids").values, column("lengths").values.to_numpy()
        self.at = pc.fill_null(pc.index_in(terms, value_set=column("terms").values), -1).to_numpy(zero_copy_only=False)
        self.ends = np.append(0, np.cumsum(column("dfs").values.to_numpy()))
        self.docs, self.tfs = np.frombuffer(column("docs").as_buffer(), np.uint16), np.frombuffer(column("tfs").as_buffer(), np.uint32)
        self.top = np.where(self.at >= 0, weights * np.append(column("maxima").values.to_numpy(), 0)[self.at], 0)
        joint = np.frombuffer(column("joint").as_buffer(), np.int64)
        side = math.isqrt(len(joint))
        self.joint = joint.reshape(side, side)
        self.weights, self.index, self.frequent, self.lists = weights, index, frequent, {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term of the queries and what it adds to them."""
        if term not in self.lists:
            part = slice(self.ends[self.at[term]], self.ends[self.at[term] + 1])
            docs = self.docs[part].astype(np.int64)
            self.lists[term] = docs, self.weights[term] * impacts(self.tfs[part].astype(np.int64), self.n[docs], *self.index)
        return self.lists[term]

    def bounds(self, terms: list[int]) -> list[int]:
        """What the first i of the terms can add to a document at most, frequent ones matched in pairs; never less for more terms."""
        out, free = [0], []
        for t in terms:
            top, f, best, partner = int(self.top[t]), int(self.frequent[t]), 0, None
            if f >= 0:
                for u in free:
                    g = int(self.frequent[u])
                    a = int(self.top[u])
                    spared = a + top - max(int(self.joint[max(f, g), min(f, g)]), a, top)
                    if spared > best:
                        best, partner = spared, u
                if partner is None:
                    free.append(t)
                else:
                    free.remove(partner)
            out.append(out[-1] + top - best)
        return out

    def search(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with at least this score, which is 1 or more, and their scores."""
        present = sorted((int(t) for t in terms if self.top[t] > 0), key=lambda t: (self.top[t], t))
        bounds = self.bounds(present)
        passive = next((i for i in range(len(present), -1, -1) if bounds[i] < least), 0)
        if passive == len(present):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.n), np.int64)
        for t in present[passive:]:
            docs, adds = self.postings(t)
            score[docs] += adds
        alive = np.flatnonzero(score + bounds[passive] >= max(least, bounds[passive] + 1))
        for i in range(passive - 1, -1, -1):
            if not len(alive):
                break
            docs, adds = self.postings(present[i])
            if len(alive) * 8 < len(docs):
                place = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                score[alive] += np.where(docs[place] == alive, adds[place], 0)
            else:
                score[docs] += adds  # documents that are out stay out
            alive = alive[score[alive] + bounds[i] >= least]
        return alive, score[alive]


def _best(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]


def _search(index: Index, items: list[list[str]], k: int, id_type: T.DataType) -> DataFrame:
    """(query, doc_id, score): what each task found best for each query."""
    spark = index.blocks.sparkSession
    wanted = sorted({t for x in items for t in x})
    df = dict(index.counts.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string")), "term").collect()) if wanted else {}
    known = sorted(df)
    place = {t: i for i, t in enumerate(known)}
    rows = [np.array(sorted(place[t] for t in x if t in place), np.int64) for x in items]
    frequent = {t: i for i, t in enumerate(index.frequent)}
    shared = spark.sparkContext.broadcast((known, np.array([weight(index.n_docs, df[t]) for t in known], np.int64), rows, np.array([frequent.get(t, -1) for t in known], np.int64)))
    totals = index.n_docs, index.total
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, rows, frequent = shared.value
        terms, best, kind = pa.array(known, pa.string()), [[] for _ in rows], None
        for b in batches:
            kind = b.schema.field("doc_ids").type.value_type
            for i in range(b.num_rows):
                block = _Block(b.slice(i, 1), terms, weights, totals, frequent)
                for q, ts in enumerate(rows):
                    docs, scores = block.search(ts, best[q][-1][0] if len(best[q]) == k else 1)
                    if len(docs) > k:
                        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs, scores = docs[keep], scores[keep]
                    if len(docs):
                        best[q] = _best([*best[q], *zip(scores.tolist(), block.ids.take(pa.array(docs)).to_pylist(), strict=True)], k)
        if kind is None:
            return
        flat = [(q, d, s) for q, x in enumerate(best) for s, d in x]
        columns = list(zip(*flat, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=schema.names)
        give_back()

    return index.blocks.select("doc_ids", "lengths", "terms", "dfs", "docs", "tfs", "maxima", "joint").mapInArrow(run, schema)


def search(index: Index | None, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, rank, doc_id, score): each query's k best documents of those with a score above 0, equal scores by ascending doc_id.

    Rows of queries that share an id, null ids too, are one query with the terms of all. Queries without terms, or whose
    terms are in no document, give no rows; nor does an index of None. A row of the index is a document, whether or not
    others have its doc_id; null doc_ids come last among equals. Queries go through the index in groups of bounded size.
    """
    spark = queries.sparkSession
    id_type = queries.schema[id_col].dataType
    doc_type = index.blocks.schema["doc_ids"].dataType.elementType if index else T.LongType()
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    if index is None or not size["n"]:
        return spark.createDataFrame([], schema)
    groups = max(-(-size["n"] // GROUP), -(-size["bytes"] // GROUP_BYTES))
    out = None
    for g in range(groups):
        part = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(groups)) == g).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).collect()
        terms: dict = {}
        for r in part:
            terms.setdefault(r["id"], set()).update(t.decode() for t in terms_of(r["text"]))
        ids = list(terms)
        if not ids:
            continue
        found = _search(index, [sorted(terms[i]) for i in ids], k, doc_type)
        # Tasks' best are merged twice, so that a query of a large corpus does not meet in one task at once.
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("part", F.spark_partition_id() % 256)
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("r") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField(id_col, id_type)]))
        one = found.join(F.broadcast(names), "query").select(id_col, "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), total AS (
  SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), tf AS MATERIALIZED (
  SELECT doc_id, len, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), scores AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * n) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
