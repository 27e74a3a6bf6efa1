"""Centroid clustering over subvector dictionaries, exact in integers.

Vectors are written once as chunks. A chunk cuts the dimensions into blocks and keeps, for each block, its distinct
subvectors and one code a vector: lossless, and as wide as pays off, since neighbouring blocks are joined while that
leaves at most half as many distinct subvectors as vectors. A round computes the distance of every distinct subvector to
every centroid once, sums these partial distances by code, and gets the sums of a cluster's vectors from the counts of
its codes. A task hands on one row a cluster, whatever it has read; the driver sees one row a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, stored, table

K, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: Vectors of a chunk, at most; 8 MB of integers at 64 dimensions.
CHUNK = 16_384
#: Components beyond this, after scaling, could overflow 64-bit squared distances; they are refused.
LIMIT = 1 << 27


def valid(vec: str, dims: int) -> Column:
    """True for vectors of so many components, none null or non-finite."""
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def dictionaries(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct subvectors and codes of each block of columns of an integer matrix; blocks follow one another."""
    blocks = []
    for j in range(x.shape[1]):
        values, codes = np.unique(x[:, j], return_inverse=True)
        blocks.append((values[:, None], codes))
    while len(blocks) > 1:
        out, joined, at = [], False, 0
        while at < len(blocks):
            if at + 1 < len(blocks):
                (a, i), (b, j) = blocks[at : at + 2]
                pairs, codes = np.unique(i.astype(np.int64) * len(b) + j, return_inverse=True)
                if 2 * len(pairs) <= len(x) or len(pairs) == 1:
                    out.append((np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes))
                    joined, at = True, at + 2
                    continue
            out.append(blocks[at])
            at += 1
        blocks = out
        if not joined:
            break
    return [a for a, _ in blocks], [c for _, c in blocks]


_CODES = [T.StructField("widths", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("codes", T.BinaryType())]


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Chunks of the valid vectors, written to the shared folder: ids, block widths, dictionary sizes, dictionaries, codes."""
    source = vectors.filter(valid(vec_col, dims)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), *_CODES])

    def chunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        x = np.floor(whole["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * scale)
        if x.size and np.abs(x).max() > LIMIT:
            raise ValueError(f"components of over {LIMIT} after scaling do not fit 64-bit distances")
        words, codes = dictionaries(x.astype(np.int64))
        ids = whole["id"].combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        flat = np.concatenate([w.ravel() for w in words]).tobytes()
        as_list = lambda v: pa.array([v], pa.list_(pa.int32()))
        small = np.stack(codes).astype(np.uint16)
        return pa.RecordBatch.from_arrays([ids, as_list([w.shape[1] for w in words]), as_list([len(w) for w in words]), pa.array([flat], pa.binary()), pa.array([small.tobytes()], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, CHUNK - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)
        give_back()

    return stored(source.mapInArrow(run, schema), "subvectors")


class _Chunk:
    def __init__(self, row: dict):
        self.widths, self.sizes = row["widths"], row["sizes"]
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(len(self.widths), -1)
        flat, at, self.words = np.frombuffer(row["words"], np.int64), 0, []
        for width, size in zip(self.widths, self.sizes, strict=True):
            self.words.append(flat[at : at + width * size].reshape(size, width))
            at += width * size

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, the first of equals, and its squared distance."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        at = 0
        for words, codes in zip(self.words, self.codes, strict=True):
            part = centroids[:, at : at + words.shape[1]]
            distances = sum((words[:, d, None] - part[None, :, d]) ** 2 for d in range(words.shape[1]))
            total += distances.take(codes, 0)
            at += words.shape[1]
        cluster = total.argmin(1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of each cluster's vectors."""
        out = []
        for words, codes in zip(self.words, self.codes, strict=True):
            counts = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
            out.append(counts @ words)
        return np.hstack(out)


def _round(chunks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each non-empty cluster."""
    k, dims = centroids.shape
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for row in b.to_pylist():
                part = _Chunk(row)
                cluster, _ = part.nearest(centroids)
                n += np.bincount(cluster, minlength=k)
                sums += part.sums(cluster, k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=schema.names)

    parts = chunks.select(*(f.name for f in _CODES)).mapInArrow(run, schema).filter("n > 0")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)))
    return {r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(dims)]) for r in total.collect()}


def centroid_clusters(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(assignments, centroids): a row (id, cluster, distance) for each valid vector, and the final centroids.

    Components become floor(scale * x). The first centroids are the k vectors with the smallest sha256 of "seed:id"; rows
    that share an id are told apart by their components, a null id comes last. Each round assigns every vector to its
    nearest centroid, the smaller number of equals, and puts the floor of the componentwise mean in place of every
    centroid that has vectors. Fewer than k vectors make as many centroids; no vector gives no row. Vectors of another
    length, null ones and those with a null or non-finite component are left out. Other columns are not read.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    firsts = vectors.filter(valid(vec_col, dims)).select(key.alias("key"), whole.alias("vec")).orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    chunks = encode(vectors, id_col, vec_col, dims, scale)
    centroids = np.array([r["vec"] for r in firsts], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        new = centroids.copy()
        for c, (n, sums) in _round(chunks, centroids).items():
            new[c] = [s // n for s in sums]
        if np.array_equal(new, centroids):  # later rounds would give the same
            break
        centroids = new

    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                cluster, distance = _Chunk(row.select([f.name for f in _CODES]).to_pylist()[0]).nearest(centroids)
                yield pa.RecordBatch.from_arrays([row.column(row.schema.get_field_index("ids")).flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], names=schema.names)
        give_back()

    return stored(chunks.mapInArrow(run, schema), "assigned"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    totals = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())  # one row a centroid
    digest = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    rows = [(c, n, sum(totals.values()), digest[c]) for c, n in totals.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds as one statement: each is an assignment and new means."""
    near = "select v.vec_id, v.v, arg_min(c.cluster, (d, c.cluster)) as cluster, min(d) as distance from v, {c} c, lateral (select list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i]))) as d) group by all"
    steps = [
        "v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "c0 as materialized (select cast(row_number() over (order by h) - 1 as integer) as cluster, v as c from (select v, sha256('3:' || vec_id) as h from v order by h limit 8))",
    ]
    for r in range(ROUNDS):
        steps.append(f"a{r} as materialized ({near.format(c=f'c{r}')})")
        means = f"select cluster, list(cast(floor_mean as bigint) order by i) as c from (select cluster, i, (s - ((s % n) + n) % n) // n as floor_mean from (select cluster, i, sum(v[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by all)) group by cluster"
        steps.append(f"c{r + 1} as materialized (select o.cluster, coalesce(m.c, o.c) as c from c{r} o left join ({means}) m using (cluster))")
    steps.append(f"f as materialized ({near.format(c=f'c{ROUNDS}')})")
    return f"""with {", ".join(steps)}
select f.vec_id, cast(f.cluster as integer) as cluster, cast(f.distance as bigint) as distance, cast(sum(f.distance) over (partition by f.cluster) as bigint) as cluster_inertia,
  cast(sum(f.distance) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from f join c{ROUNDS} c on f.cluster = c.cluster"""


SQL = _sql()
