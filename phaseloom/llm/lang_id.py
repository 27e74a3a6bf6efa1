"""Language identification by a string kernel with Nystroem landmarks.

The blended-spectrum presence kernel of two texts is the number of character n-grams, of all lengths in SIZES, that both
hold, over the geometric mean of the numbers that each holds. N-grams of lower-cased letters, with one space for whatever
lies between words, are hashed to BUCKETS places, so a text is a row of zeros and ones and kernels of many texts with all
landmarks are one matrix product. One-versus-rest kernel ridge regression on these kernels is fitted on a bounded sample;
scoring is a map over all texts, which never move, with a model whose size is fixed by BUCKETS and LANDMARKS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, stored, table

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Landmark texts, dealt evenly to the languages; each language gets two at least.
LANDMARKS = 96
#: Labelled rows that the model is fitted on, at most, dealt evenly to the languages.
MAX_TRAIN = 6_000
#: Longer texts are taken into the sample only where a language has no others.
MAX_CHARS = 20_000
#: Weight of the ridge term, and how steeply the regressions' values become shares.
RIDGE, STEEP = 1e-3, 4.0
#: Texts of a matrix product, and code points whose n-grams are hashed at once.
ROWS, PIECE = 64, 500_000
MULTIPLIER, SHIFT = np.uint32(0x9E3779B1), np.uint32(15)
UNKNOWN = "und"


class Letters:
    """Which code points are letters; learnt as they are met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, np.int8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.known[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                self.known[p] = 2 if chr(p).isalpha() else 1
            found = self.known[points]
        return found == 2


def _points(text: str | None, letters: Letters) -> np.ndarray:
    """Code points of the lower-cased letters, a space before, between and after words; none without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    letter = letters.of(points)
    if not letter.any():
        return points[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first place after a word
    points = np.where(letter, points, np.uint32(32))[keep]
    return np.concatenate([np.array([32], np.uint32), points, np.array([32][: int(points[-1] != 32)], np.uint32)])


def presence(texts: list[str | None], letters: Letters, out: np.ndarray) -> np.ndarray:
    """Set out[i, g] to 1 for each n-gram g of text i; tells which texts have letters."""
    some = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        points = _points(text, letters)
        some[i] = len(points) > 0
        for lo in range(0, len(points), PIECE):
            part = points[lo : lo + PIECE + max(SIZES) - 1]
            rolled = np.zeros(len(part), np.uint32)
            for k in range(max(SIZES)):
                rolled = (rolled[: len(part) - k] + part[k:] + np.uint32(1)) * MULTIPLIER
                rolled ^= rolled >> SHIFT
                if k + 1 in SIZES and len(rolled):
                    out[i, rolled & np.uint32(BUCKETS - 1)] = 1
    return some


def _normed(product: np.ndarray, sizes: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    return product / np.sqrt(np.maximum(sizes, 1)[:, None] * np.maximum(landmark_sizes, 1)[None, :])


@dataclass
class StringKernelModel:
    languages: list[str]
    #: Presence rows of the landmarks, packed to bits.
    packed: np.ndarray
    #: Landmarks by languages, and a constant for each language.
    weights: np.ndarray
    bias: np.ndarray

    def landmarks(self) -> np.ndarray:
        return np.unpackbits(self.packed, axis=1).astype(np.float32)


def kernels(batches: Iterator[list[str | None]], landmarks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list of texts: which have letters, and the kernel of each text with each landmark."""
    letters, by, sizes = Letters(), np.ascontiguousarray(landmarks.T), landmarks.sum(1)
    space = np.zeros((ROWS, BUCKETS), np.float32)
    for texts in batches:
        some, parts = [], []
        for lo in range(0, len(texts), ROWS):
            part = texts[lo : lo + ROWS]
            rows = space[: len(part)]
            rows[:] = 0
            some.append(presence(part, letters, rows))
            parts.append(_normed(rows @ by, rows.sum(1), sizes))
        yield np.concatenate([np.zeros(0, bool), *some]), np.concatenate([np.zeros((0, len(sizes)), np.float32), *parts])


def fit(languages: list[str], labels: np.ndarray, k_nm: np.ndarray, k_mm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants of one ridge regression a language on targets of 1 and -1; all languages weigh the same."""
    targets = np.where(labels[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = 1.0 / (np.bincount(labels, minlength=len(languages))[labels] * len(languages))
    x, y = k_nm.astype(np.float64), targets
    mean_x, mean_y = share @ x, share @ y
    x, y = x - mean_x, y - mean_y
    left = (x * share[:, None]).T @ x + RIDGE * k_mm / len(k_mm) + 1e-9 * np.eye(len(k_mm))
    weights = np.linalg.solve(left, (x * share[:, None]).T @ y)
    return weights, mean_y - mean_x @ weights


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", landmarks: int = LANDMARKS, max_train: int = MAX_TRAIN) -> StringKernelModel | None:
    """Fit on at most max_train rows with a language and letters: for each language those whose texts have the smallest hashes.

    Texts of over MAX_CHARS code points come after all others. Rows with a null language or without letters teach nothing;
    None if no row teaches. Every language is learnt. The driver gets the landmark texts and, for each row of the sample,
    its kernels with the landmarks. Other columns are not read.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), (F.char_length(text_col) > MAX_CHARS).alias("long"))
    counts = dict(usable.groupBy("lang").agg(F.sum(F.when(F.col("long"), 0).otherwise(1))).collect())  # one row a language
    if not counts:
        return None
    names = sorted(counts)
    cap, each = max(2, max_train // len(names)), max(2, landmarks // len(names))
    # Only rows whose hashes are small enough that a language keeps a few times its share go on to be ranked.
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, (2.0 * cap + 50) / counts[x]) if counts[x] else 1.0) for x in names], "lang string, share double")
    few = usable.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h")))
    sample = stored(ranked.filter(F.col("rank") <= cap).select("lang", "text", "rank"), "language-sample")
    marks = sorted((r["lang"], r["rank"], r["text"]) for r in sample.filter(F.col("rank") <= each).collect())
    names = sorted({r[0] for r in marks})
    rows = np.zeros((len(marks), BUCKETS), np.float32)
    presence([r[2] for r in marks], Letters(), rows)
    model = StringKernelModel(names, np.packbits(rows.astype(np.uint8), axis=1), np.zeros((len(marks), len(names))), np.zeros(len(names)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for b in batches for p in slices(b, "text", 2_000_000)]  # of the bounded sample
        for p, (_, k) in zip(parts, kernels((p.column("text").to_pylist() for p in parts), shared.value.landmarks()), strict=True):
            yield pa.RecordBatch.from_arrays([p.column("lang"), pa.array([x.tobytes() for x in k.astype(np.float32)], pa.binary())], names=["lang", "k"])
        give_back()

    found = sample.select("lang", "text").mapInArrow(run, "lang string, k binary").toArrow()
    place = {x: i for i, x in enumerate(names)}
    labels = np.array([place[x] for x in found["lang"].to_pylist()])
    k_nm = np.frombuffer(b"".join(found["k"].to_pylist()), np.float32).reshape(-1, len(marks))
    order = np.lexsort((*k_nm.T[:2], labels))  # sums are taken in the same order each time
    sizes = rows.sum(1)
    model.weights, model.bias = fit(names, labels[order], k_nm[order], _normed(rows @ rows.T, sizes, sizes).astype(np.float64))
    return model


def identify(docs: DataFrame, model: StringKernelModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of the predicted language; equal texts get equal results.

    A null text, or one without letters, is "und" with score 0, as is every text where there is no model. Columns of docs
    with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = shared.value, []

        def texts() -> Iterator[list[str | None]]:
            for whole in batches:
                for b in slices(whole, text_col, 1_000_000):
                    held.append(b)
                    yield b.column(text_col).to_pylist()

        weights, bias = m.weights.astype(np.float32), m.bias.astype(np.float32)
        for some, k in kernels(texts(), m.landmarks()):
            b = held.pop()
            values = k @ weights + bias
            best = values.argmax(1)
            share = np.exp(STEEP * (values - values.max(1, keepdims=True)))
            score = np.where(some, 1 / share.sum(1), 0.0)
            names = [m.languages[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
