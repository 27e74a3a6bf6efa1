"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a pre-token has one valid last token: the one that is a suffix of the prefix (found with an automaton of
all tokens) and is compatible with the last token of the prefix before it. Two tokens are compatible if plain merging of
their joined bytes leaves exactly the two, which the merge ranks along their facing edges decide. Following the
back-pointers from the end gives the ids that merging would give, without replaying merges.

Texts are encoded where they lie, in Arrow batches: no shuffle. The vocabulary (a fixed file) is broadcast.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, slices, table

#: Fixed by the byte-level format: how a text is cut into pre-tokens.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that a worker's caches of pieces take, about, and entries of its other caches, before the older half goes. They
#: bound memory, not results, and are emptied at the end of each task.
CACHE_BYTES = 56_000_000
VERDICTS, EDGES = 200_000, 10_000
#: What a cached piece takes beside its characters and ids.
ENTRY = 190


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary (fixed by the format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids, as packed 32-bit integers, of pre-tokens that follow a prefix; fills itself. What was used lately stays."""

    def __init__(self, prefix: str, codec: BpeCodec, most: int) -> None:
        super().__init__()
        self.prefix, self.codec, self.most = prefix, codec, most
        self.old, self.room = {}, most // 2

    def __missing__(self, key: str) -> bytes:
        if self.prefix and not key.isalpha():  # no pre-token by itself
            return self.codec.pieces(self.prefix + key)
        out = self.old.get(key)
        if out is None:
            out = self.codec.piece(self.prefix + key).tobytes()
        if len(key) <= 64:
            self.room -= ENTRY + len(key) + len(out)
            if self.room < 0:
                self.old, self.room = dict(self), self.most // 2
                self.clear()
            self[key] = out
        return out

    def forget(self) -> None:
        self.old, self.room = {}, self.most // 2
        self.clear()


class BpeCodec:
    """Encoder and decoder of one byte-level vocabulary, given as the text of its JSON file."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        chars = byte_chars()
        raw = lambda token: bytes(chars[c] for c in token)
        vocab = {raw(t): i for t, i in j["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in [*vocab.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = b
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        self.rank: dict[int, int] = {}  # by both ids, packed
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right = vocab[raw(a)], vocab[raw(b)]
            self.rank[left << 32 | right] = r
            self.parts.setdefault(vocab[raw(a) + raw(b)], (left, right, r))
        self.tokens = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.tokens.add_word(b.decode("latin-1"), (i, len(b)))
        self.tokens.make_automaton()
        if missing := [b for b in range(256) if bytes([b]) not in vocab]:
            raise ValueError(f"the vocabulary has no tokens for the bytes {missing}")
        self.cut = regex.compile(PRETOKEN)
        self.odd = re.compile(r" \s")
        self.breaks = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.first, self.later = _Pieces("", self, CACHE_BYTES // 8), _Pieces(" ", self, CACHE_BYTES * 7 // 8)
        self.fits: list[dict[int, bool]] = [{} for _ in self.bytes_of]  # by the later token, then the one before it
        self.n_fits = 0
        self.edges: tuple[dict, dict] = ({}, {})

    def forget(self) -> None:
        """Empty the caches; the vocabulary's own tables stay."""
        self.forget_verdicts()
        for cache in self.edges:
            cache.clear()
        self.first.forget()
        self.later.forget()

    def forget_verdicts(self) -> None:
        for verdicts in self.fits:
            verdicts.clear()
        self.n_fits = 0

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at an edge of the token while it is merged together, each with the rank of the merge that ends it."""
        if token not in self.edges[side]:
            if len(self.edges[side]) >= EDGES:
                self.edges[side].clear()
            out, at, until = [], token, len(self.rank)
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                *halves, until = self.parts[at]
                at = halves[1 - side]
            self.edges[side][token] = out
        return self.edges[side][token]

    def compatible(self, a: int, b: int) -> bool:
        """True unless a merge across the seam would come before the merges that build a and b.

        Of equal ranks the left place merges first: a pair inside a comes before one across the seam, which comes before
        one inside b.
        """
        if self.n_fits >= VERDICTS:
            self.forget_verdicts()
        self.n_fits += 1
        rank, left, ok = self.rank.get, self.edge(b, 1), True
        for x, end_x in self.edge(a, 0):
            x <<= 32
            for y, end_y in left:
                r = rank(x | y)
                if r is not None and r < end_x and r <= end_y:
                    ok = False
                    break
            if not ok:
                break
        self.fits[b][a] = ok
        return ok

    def piece(self, text: str) -> array:
        """Ids of one pre-token."""
        raw = text if text.isascii() else text.encode().decode("latin-1")
        fits, known = self.fits, -1
        last, size_of = [-1] * len(raw), [0] * len(raw)  # by the place of a prefix's last byte
        for end, (token, size) in self.tokens.iter(raw):
            if end != known:
                if size <= end:
                    before = last[end - size]
                    ok = fits[token].get(before)
                    if ok is None:
                        ok = self.compatible(before, token)
                    if not ok:
                        continue
                last[end] = token
                size_of[end] = size
                known = end
        out, at = [], len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= size_of[at]
        out.reverse()
        return array("i", out)

    def pieces(self, text: str) -> bytes:
        found = self.cut.findall(text)
        return b"".join([self.later[p[1:]] if p[0] == " " and p[1:].isalpha() else self.first[p] for p in found])

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A space before a character that is no white space always starts a pre-token, so the parts between such spaces are independent."""
        if self.odd.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        if rest and not rest[-1]:  # a space at the end is a pre-token of its own
            return self.pieces(text)
        return self.pieces(head) + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """Ids as 32-bit integers. With special, strings of special tokens in a text become those tokens."""
        if not special or self.breaks is None or not self.breaks.search(text):
            return np.frombuffer(self.plain(text), np.int32)
        out, at = [], 0
        for m in self.breaks.finditer(text):
            out += [self.plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self.plain(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[int, BpeCodec] = {}


def codec_of(shared) -> BpeCodec:  # noqa: ANN001  a broadcast of the vocabulary's text
    """The worker's codec, kept between tasks."""
    spec = shared.value
    key = hash(spec)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(spec)
    return _CODECS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_vocabulary(spark: SparkSession, path: str | None = None):  # noqa: ANN201
    with open(path or default_vocabulary(), encoding="utf-8") as f:  # installed beside the driver's libraries
        return spark.sparkContext.broadcast(f.read())


def tokenize(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", decoded: bool = False, special: bool = True) -> DataFrame:
    """docs with ids (array of int) and, if asked for, decoded (the ids turned back into text).

    vocabulary: path of a byte-level BPE JSON file. A null text is encoded as an empty one: no ids, decoded "". Columns
    of docs named ids or decoded are replaced; all others are kept as they are. Rows keep their number; equal texts give
    equal ids. special: strings of special tokens in a text become those tokens.
    """
    docs = docs.drop("ids", "decoded")
    spec = shared_vocabulary(docs.sparkSession, vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] * decoded)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = [codec.encode(t or "", special) for t in batch.column(text_col).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))]
                names = [*batch.schema.names, "ids"]
                if decoded:
                    out, names = [*out, pa.array([codec.decode(i) for i in ids], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)
        codec.forget()
        give_back()

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
