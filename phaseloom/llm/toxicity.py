"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if a term hashed to i is in the text. The
pairwise part, computed in linear time as ((sum v)^2 - sum v^2) / 2, lets an insult weigh more beside the mention of a
group than alone. Training takes a bounded sample of labelled rows (MAX_TRAIN); scoring is a map over all texts with the
model, whose size is fixed by BUCKETS and FACTORS, broadcast.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, table

#: Labelled rows that the model is fitted on, at most: those whose ids have the smallest hashes.
MAX_TRAIN = 12_000
#: Hashed terms; the model holds BUCKETS * (FACTORS + 1) floats, 9.4 MB.
BUCKETS = 1 << 18
FACTORS = 8
#: Terms of fewer training texts are not learnt.
MIN_TEXTS = 4
#: Every other term is learnt, with steps shortened by its evidence so that the many neutral words of a long text add
#: little noise: to half where its shares among the classes differ by HALF_Z standard errors or, for its factors, where
#: the squared pull of the pairs (FACTORS by chance) is HALF_PULL.
HALF_Z, HALF_PULL = 4.0, 40.0
#: Beside each word, its first letters count, to so many.
STEMS = (4, 5)
TERM = re.compile(r"[^\W\d_]+")
#: Bytes of words and their hashes that a worker keeps before it starts anew.
CACHE = 20_000_000


class Terms(dict):
    """Buckets of a word and its stems, as packed 32-bit integers; fills itself."""

    held = 0

    def __missing__(self, word: str) -> bytes:
        self.held += 200 + 4 * len(word)
        if self.held > CACHE:
            self.clear()
            self.held = 0
        stems = [f"{word[:k]}*" for k in STEMS if len(word) > k]
        out = self[word] = array("i", [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (word, *stems)]).tobytes()
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a text's lower-cased words, sorted."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(TERM.findall((text or "").lower())))), np.int32))


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of values between ends; 0 for empty rows."""
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
        return total[ends[1:]] - total[ends[:-1]]

    def raw(self, items: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[items]
        mean = self._sums(v, ends)
        pairs = 0.5 * ((mean**2).sum(1) - self._sums((v**2).sum(1), ends))
        return self.bias + self._sums(self.weights[items], ends) + pairs, mean

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, rows)])
        return 1 / (1 + np.exp(-np.clip(self.raw(np.concatenate([*rows, np.zeros(0, np.int32)]), ends)[0], -30, 30)))


class _Batch:
    """Some rows as a matrix of rows by used terms, kept as its ones and laid out for BLOCK terms at a time."""

    BLOCK = 1 << 12

    def __init__(self, pick: np.ndarray, rows: list[np.ndarray], place: np.ndarray, space: np.ndarray):
        items = [x[x >= 0] for x in (place[rows[i]] for i in pick)]
        flat = np.concatenate(items)
        by = np.argsort(flat, kind="stable")
        self.pick, self.space = pick, space  # space holds zeros between uses
        self.used, self.term = np.unique(flat[by], return_inverse=True)
        self.term = self.term.astype(np.int32)
        self.ends = np.searchsorted(self.term, np.arange(len(self.used) + 1))
        self.row = np.repeat(np.arange(len(pick), dtype=np.int16), [len(x) for x in items])[by]

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for lo in range(0, len(self.used), self.BLOCK):
            hi = min(lo + self.BLOCK, len(self.used))
            part = slice(self.ends[lo], self.ends[hi])
            at = self.term[part] - lo, self.row[part]
            self.space[at] = 1
            yield slice(lo, hi), self.space[: hi - lo, : len(self.pick)]
            self.space[at] = 0

    def by_row(self, of_terms: np.ndarray) -> np.ndarray:
        """Sums over each row's terms."""
        out = np.zeros((len(self.pick), of_terms.shape[1]))
        for part, ones in self._blocks():
            out += ones.T @ of_terms[part]
        return out

    def by_term(self, of_rows: np.ndarray) -> np.ndarray:
        """Sums over each used term's rows."""
        return np.concatenate([np.zeros((0, of_rows.shape[1]), np.float32), *(ones @ of_rows for _, ones in self._blocks())])


def _shrunk(evidence: np.ndarray, half: float) -> np.ndarray:
    """From 0 for no evidence to 1, one half where it equals half; never cut off."""
    return evidence**4 / (evidence**4 + half**4)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, l2: float = 2e-4, batch: int = 256, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss over all terms of MIN_TEXTS texts, both classes weighing the same in sum; a term's steps are as long as its evidence.

    The evidence for a weight is how far the term's shares among the two classes lie apart. That for its factors is also
    the pull on them over an epoch, set against the same pull with random signs: it comes from the pairs, so a term that
    tells nothing alone is learnt from what it tells beside others. Each epoch may raise it.
    """
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
    positive = labels.mean() if len(labels) else 0.0
    if not 0 < positive < 1:  # nothing to tell apart
        model.bias = -4.0 if positive == 0 else 4.0
        return model

    def count(label: int) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int32)
        for r, y in zip(rows, labels, strict=True):
            if y == label:
                total[r] += 1  # a row's buckets are distinct
        return total

    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    with_1, with_0 = count(1), count(0)
    terms = np.flatnonzero(with_1 + with_0 >= MIN_TEXTS)
    with_1, with_0 = with_1[terms], with_0[terms]
    share = (with_1 + with_0) / (n1 + n0)
    z = np.abs(with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    alone = _shrunk(z, HALF_Z)
    beside = alone
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    # The bias starts at the share of toxic texts, so that a text of which nothing is known goes with the larger class.
    model.bias = float(np.log(positive / (1 - positive)))
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    order = rng.permutation(len(rows))
    space = np.zeros((_Batch.BLOCK, batch), np.float32)
    batches = [_Batch(order[lo : lo + batch], rows, place, space) for lo in range(0, len(order), batch)]
    # A term's factors and, last, its weight; the sums of their squared slopes; how long its steps are.
    theta = np.column_stack([rng.normal(0, 0.01, (len(terms), FACTORS)), np.zeros(len(terms))]).astype(np.float32)
    seen = np.full(theta.shape, 1e-6, np.float32)
    step = np.repeat(alone[:, None], FACTORS + 1, 1).astype(np.float32) * np.float32(rate)
    step[:, :FACTORS] *= 0.4
    total = 1e-6
    for _ in range(epochs):
        pulls = np.zeros((len(terms), 2 * FACTORS), np.float32)
        for k in rng.permutation(len(batches)):
            b = batches[k]
            now = theta.take(b.used, 0)
            v = now[:, :FACTORS]
            sums = b.by_row(np.column_stack([now, np.einsum("ij,ij->i", v, v)]))
            mean = sums[:, :FACTORS]
            out = model.bias + sums[:, FACTORS] + 0.5 * ((mean**2).sum(1) - sums[:, FACTORS + 1])
            error = weight[b.pick] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[b.pick]) / len(b.pick)
            total += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(total)
            slope = error[:, None] * mean
            by_term = b.by_term(np.column_stack([slope, error, slope**2]).astype(np.float32))
            grad = by_term[:, : FACTORS + 1]
            grad[:, :FACTORS] -= grad[:, FACTORS:] * v
            pulls[b.used] = pulls.take(b.used, 0) + np.delete(by_term, FACTORS, 1)
            grad += np.float32(l2) * now
            past = seen.take(b.used, 0) + grad**2
            seen[b.used] = past
            theta[b.used] = now - step.take(b.used, 0) * grad / np.sqrt(past)
        beside = np.maximum(beside, _shrunk((pulls[:, :FACTORS] ** 2 / np.maximum(pulls[:, FACTORS:], 1e-30)).sum(1), HALF_PULL))
        step[:, :FACTORS] = 0.4 * rate * beside[:, None]
    model.bias, model.weights[terms], model.factors[terms] = float(model.bias), theta[:, FACTORS], theta[:, :FACTORS]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fit on at most max_train labelled documents, those with the smallest hashes of their ids.

    Rows with a null label, id or text teach nothing; ids labelled both ways count as toxic, and an id that several rows
    share teaches by the text that sorts first. The texts are turned into buckets on the executors; the driver gets those
    of max_train texts at most. Other columns are not read.
    """
    pick = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    pick = pick.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "__id").filter(F.col("text").isNotNull()).groupBy("__id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [terms.of(t).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("y"), pa.array(rows, pa.binary())], names=["id", "y", "items"])

    found = chosen.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("items", T.BinaryType())])).withColumn("size", F.octet_length("items")).toArrow()
    found = found.combine_chunks()
    order = np.lexsort((found["size"].to_numpy(), found["id"].to_numpy(zero_copy_only=False)))
    rows = [np.frombuffer(found["items"][int(i)].as_buffer(), np.int32) for i in order]
    return fit(rows, found["y"].to_numpy()[order].astype(np.int64))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """docs with score, from 0 to 1; a null text scores as an empty one, equal texts score alike. A column of docs named score is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(), FactorizationMachine(*shared.value)
        for whole in batches:
            for b in slices(whole, text_col, 2_000_000):
                out = machine.score([terms.of(t) for t in b.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)]))


def held_out(id_col: str, mod: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
