"""Language-model scores of documents from a weighted backoff automaton over words.

Counts of words, word pairs and word triples are taken over all training documents, none left out. The model interpolates
from the shortest history to the longest:

    P(w) = (c(w) + A) / (N + A * (V + 1));   P(w | h) = (c(h, w) + M * P(w | h')) / (c(h) + M)

where h' is h without its first word. M, one for each order, is found from the counts of counts: on average over the
histories, the mass M / (c(h) + M) that goes to the shorter history is the share of n-grams seen once, as Good and Turing
estimate what is unseen.

It becomes an automaton: a state for each history seen, an arc for each n-gram seen, and a failure arc of weight
M / (c(h) + M) to the state of the shorter history, down to the root, whose arcs are the words. A text is read from left
to right; each token is read by an arc of the state that the tokens before it led to, or after one or two failures.

The corpus model grows with the corpus and is never gathered in one place. Texts are cut into blocks of bounded size; a
block's own distinct n-grams go, packed and dealt by ranges of their hashes, to be summed over all blocks, and only the
totals come back, in the order of the block's keys. A range gets a message of a block only if the block has keys there,
so messages are never more than keys. Each block then builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, stored, table
from phaseloom.llm.toxicity import held_out

#: Bytes of text in a block; bounds the memory of a task.
BLOCK = 7_000_000
#: N-grams that the blocks of one merging task bring, about.
BUCKET = 1_200_000
#: Messages that leave a worker at once.
MESSAGES = 256
#: Added to each word's count.
A = 0.1
END = np.uint64(xxhash.xxh3_64_intdigest(b"") ^ 0x5DEECE66D)
#: Fixed odd multiplier that combines hashes.
PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Counts of counts are exact up to here, then gathered by their leading bits.
EXACT = 64


@dataclass
class Tokens:
    """Hashed n-grams of several texts, each ending with a token of its own: word, (before, word), (two before, word).

    A text starts after an end. Its first token has no triple: triple is kept for the others only, whose places in_text
    holds.
    """

    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    in_text: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * PAIR


def tokens(texts: list[bytes]) -> Tokens:
    parts, end = [], np.array([END])
    for t in texts:
        words = t.lower().split()
        parts += [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), end]
    sizes = np.array([len(p) + 1 for p in parts[::2]], np.int64)
    word = np.concatenate([*parts, np.zeros(0, np.uint64)])
    before = np.append(END, word[:-1])[: len(word)]
    pair = _mixed(before * PAIR + word)
    later = np.ones(len(word), bool)
    later[np.cumsum(sizes)[:-1]] = False
    later[:1] = False
    in_text = np.flatnonzero(later)
    triple = _mixed(pair[in_text - 1] * PAIR + word[in_text])
    return Tokens(word, pair, triple, in_text, np.repeat(np.arange(len(sizes)), sizes), sizes)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each is found in training texts, and the place of every key among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place[train], minlength=len(distinct)).astype(np.int64), place


def _orders(t: Tokens, held: list[bool]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, distinct keys, own training counts, places) for words, pairs and triples."""
    train = ~np.array(held, bool)[t.doc]
    for kind, keys in ((0, t.word), (1, t.pair), (2, t.triple)):
        yield kind, *counted(keys, train[t.in_text] if kind == 2 else train)


@dataclass
class BackoffAutomaton:
    """States are the root, words and pairs. root: weights of the words; arcs[k]: weights of what leaves words (k = 0) and
    pairs (k = 1), nan where there is no arc; failure[k]: weights of leaving them for the shorter history."""

    root: np.ndarray
    arcs: tuple[np.ndarray, np.ndarray]
    failure: tuple[np.ndarray, np.ndarray]

    @classmethod
    def build(cls, counts: list[np.ndarray], state_of: list[np.ndarray], shorter: list[np.ndarray], total: int, vocabulary: int, mass: tuple[float, float]) -> BackoffAutomaton:
        """counts: of words, pairs, triples; state_of[k]: the history of each pair and triple; shorter[k]: the same without its first word."""
        below = (counts[0] + A) / (total + A * (vocabulary + 1))
        root, arcs, failure = np.log10(below), [], []
        for k in (0, 1):
            history = counts[k]
            below = (counts[k + 1] + mass[k] * below[shorter[k]]) / (history[state_of[k]] + mass[k])
            arcs.append(np.where(counts[k + 1] > 0, np.log10(below), np.nan))
            failure.append(np.log10(mass[k] / (history + mass[k])))
        return cls(root, tuple(arcs), tuple(failure))

    def traverse(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, start: int) -> np.ndarray:
        """Weight of each token read from left to right; triple is -1 for the first token of a text.

        All tokens take their steps at once: the state that a token finds is told by the two tokens before it. A history
        that was never seen has no state; its failure weighs nothing.
        """
        out, open_ = np.zeros(len(word)), np.ones(len(word), bool)
        before = np.append(start, word[:-1])[: len(word)]
        for arc, state, k in ((triple, np.append(0, pair[:-1])[: len(word)], 1), (pair, before, 0)):
            exists = open_ & (arc >= 0)
            found = np.full(len(word), np.nan)
            found[exists] = self.arcs[k][arc[exists]]
            read = exists & ~np.isnan(found)
            out[read] = out[read] + found[read]
            open_ &= ~read
            failed = exists & ~read
            out[failed] += self.failure[k][state[failed]]
        out[open_] += self.root[word[open_]]
        return out


def mass_for(once: int, histories: list[tuple[float, int]]) -> float:
    """M so that histories, as (count, how many), give the mass of `once` n-grams seen once to shorter ones; by bisection."""
    total = sum(c * m for c, m in histories)
    if not total:
        return 1.0
    target = min(max(once, 1e-3 * total), 0.999 * total)
    lo, hi = 1e-6, 1e12
    for _ in range(100):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if sum(m * c * mid / (c + mid) for c, m in histories) < target else (lo, mid)
    return math.sqrt(lo * hi)


def bins(counts: np.ndarray) -> np.ndarray:
    """The bin of each count: itself up to EXACT, then by its six leading bits."""
    shift = np.maximum(np.frexp(counts.astype(np.float64))[1] - 6, 0)
    return np.where(counts <= EXACT, counts, (counts >> shift) << shift)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list[bytes]]]:
    """(block, ids, held, texts) in the order of the scan, cut by bytes, so that every scan of a table gives the same blocks."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list = []
    texts: list[bytes] = []
    size = 0
    for whole in batches:
        for b in slices(whole, "text"):
            for i, h, t in zip(*(b.column(c).to_pylist() for c in ("id", "held", "text")), strict=True):
                raw = (t or "").encode()
                if ids and size + len(raw) > BLOCK:
                    yield part << 24 | number, ids, held, texts
                    ids, held, texts, size, number = [], [], [], 0, number + 1
                ids.append(i)
                held.append(h)
                texts.append(raw)
                size += len(raw) + 16
    if ids:
        yield part << 24 | number, ids, held, texts


def _packed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of equally weighted bytes."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of 2**bits ranges of hashes hold some of the sorted keys, and where each of those begins and, last, ends."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first], np.append(first, len(keys))


def _count(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held, texts in _blocks(batches):
            t = tokens(texts)
            for kind, keys, n, _ in _orders(t, held):
                buckets, cut = _parts(keys, bits)
                steps = np.diff(keys, prepend=np.uint64(0))
                steps[cut[:-1]] = keys[cut[:-1]]
                for lo in range(0, len(buckets), MESSAGES):
                    own = range(lo, min(lo + MESSAGES, len(buckets)))
                    packed = [[_packed(x[cut[k] : cut[k + 1]]) for k in own] for x in (steps, n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets[lo : lo + MESSAGES]), pa.array([kind] * len(own), pa.int32()), pa.array([block] * len(own), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)],
                        names=["bucket", "kind", "block", "keys", "counts"],
                    )
        give_back()

    return run


MERGED = "block long, kind int, bucket long, size int, mark long, counts binary, bins array<long>, held array<long>"


def _mark(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)).view(np.int64))


def _merge(key: tuple, part: pa.Table) -> pa.Table:
    """Totals over all blocks of one bucket, for each block in the order of its keys; block -1 has the counts of counts."""
    bucket, kind = int(key[0].as_py()), int(key[1].as_py())
    blocks = part.column("block").to_pylist()
    keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in part.column("keys").to_pylist()]
    own = np.concatenate([_unpacked(x, np.int64) for x in part.column("counts").to_pylist()])
    marks, sizes = [_mark(k) for k in keys], [len(k) for k in keys]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, own)
    every = total[place]
    bin_, many = np.unique(bins(total), return_counts=True)
    out, at = [(-1, kind, bucket, 0, int(total.sum()), b"", bin_.tolist(), many.tolist())], 0
    for b, n, mark in zip(blocks, sizes, marks, strict=True):
        out.append((b, kind, bucket, n, mark, _packed(every[at : at + n]), None, None))
        at += n
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in MERGED.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for block, ids, held, texts in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(texts))], pa.binary())],
            names=["block", "ids", "held", "sizes", "packed"],
        )
    give_back()


SCORES = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, vocabulary: int, mass: tuple[float, float], bits: int):  # noqa: ANN202
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        changed = ValueError("a second scan of the table gave its rows in another order: write it to files first")
        if left.num_rows != 1:
            raise changed
        row = left.to_pylist()[0]
        raw = zstandard.ZstdDecompressor().decompress(row["packed"])
        ends = np.cumsum([0, *row["sizes"]]).tolist()
        t = tokens([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        messages: tuple[dict, dict, dict] = ({}, {}, {})
        for kind, bucket, *message in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "size", "mark", "counts")), strict=True):
            messages[kind][bucket] = message
        counts, places = [], []
        for kind, keys, n, place in _orders(t, row["held"]):
            buckets, cut = _parts(keys, bits)
            for k, bucket in enumerate(buckets.tolist()):
                mine = slice(cut[k], cut[k + 1])
                size, mark, packed = messages[kind].get(bucket, (0, 0, b""))
                if size != cut[k + 1] - cut[k] or mark != _mark(keys[mine]):
                    raise changed
                n[mine] = _unpacked(packed, np.int64)
            counts.append(n)
            places.append(place)
        word, pair, short = places
        start = int(word[t.sizes[0] - 1])  # where the first end token is
        triple = np.full(len(word), -1)
        triple[t.in_text] = short
        before = np.append(start, word[:-1])
        state_of = [np.zeros(len(counts[1]), np.int64), np.zeros(len(counts[2]), np.int64)]
        shorter = [np.zeros(len(counts[1]), np.int64), np.zeros(len(counts[2]), np.int64)]
        state_of[0][pair], shorter[0][pair] = before, word
        state_of[1][short], shorter[1][short] = pair[t.in_text - 1], pair[t.in_text]
        machine = BackoffAutomaton.build(counts, state_of, shorter, total, vocabulary, mass)
        sums = lambda x: np.bincount(t.doc, x, len(t.sizes))
        out = [row["ids"], row["held"], t.sizes, sums(counts[0][word] > 0).astype(np.int64), sums(machine.root[word]), sums(machine.traverse(word, pair, triple, start))]
        return pa.table([pa.array(x, k) for x, k in zip(out, types, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def lm_scores(docs: DataFrame, mod: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32 of the id, as text, leaves no remainder by mod are held out: the model learns from all others, null
    ids too. A null text is an empty one, whose only token is the end. Rows may repeat: each is learnt and scored. docs
    must be a table whose scans keep their order (files); should a second scan give another one, the job fails rather
    than scores wrongly. Other columns of docs are not read.
    """
    source = docs.select(F.col(id_col).cast("string").alias("id"), held_out(id_col, mod).alias("held"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(size / 7 / BUCKET, 1))))  # a triple has seven bytes of text, about
    counts = source.mapInArrow(_count(bits), "bucket long, kind int, block long, keys binary, counts binary")
    merged = stored(counts.groupBy("bucket", "kind").applyInArrow(_merge, MERGED), "ngrams")
    found = merged.filter("block = -1").select("kind", F.explode(F.arrays_zip("bins", "held")).alias("x")).groupBy("kind", "x.bins").agg(F.sum("x.held").alias("many")).collect()  # a few hundred bins a kind
    seen = [{r["bins"]: r["many"] for r in found if r["kind"] == k and r["bins"] > 0} for k in (0, 1, 2)]
    total, vocabulary = merged.filter("block = -1 and kind = 0").agg(F.sum("mark")).first()[0] or 0, sum(seen[0].values())
    mass = tuple(mass_for(seen[k + 1].get(1, 0), sorted(seen[k].items())) for k in (0, 1))
    packed = source.mapInArrow(_pack, "block long, ids array<string>, held array<boolean>, sizes array<long>, packed binary")
    totals = merged.filter("block >= 0").select("block", "kind", "bucket", "size", "mark", "counts")
    out = packed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score(total, vocabulary, mass, bits), SCORES)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
