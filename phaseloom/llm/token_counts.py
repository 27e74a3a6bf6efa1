"""Token counts of documents in flat token files without an index.

A flat file holds the ids of many documents, as little-endian integers of fixed width, an end-of-document id after each.
Spark deals out byte ranges of the files and cuts them wherever the bytes of the end id stand; of each range's pieces
only the lengths are needed, which numpy takes from the offsets of whole Arrow batches at once. The bytes may also stand
across two ids, and whether they do depends on how many bytes lie before the range, so each range is counted for every
alignment that its start may have. A prefix scan over the ranges of a file then tells which of them holds, and stitches
the documents that lie across ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.llm.bpe import tokenize
from phaseloom.llm.common import give_back, shared_dir, stored, table

#: The end-of-document id and the bytes of an id in the files that are written here.
END_ID, WIDTH = 50256, 2


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, width: int = WIDTH, text_col: str = "text") -> None:
    """Write the ids of every row of docs, in the order of its partitions, to flat files under path.

    Strings of special tokens are encoded as ordinary text, so that the end id stands only at ends. A null text is a
    document without tokens. Ids of the vocabulary that do not fit into width bytes are an error.
    """
    if end_id >= 1 << 8 * width:
        raise ValueError(f"the end id {end_id} does not fit into {width} bytes")
    ids = tokenize(docs.select(F.col(text_col).alias("text")), vocabulary, special=False).select("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            if len(flat) and flat.max() >= 1 << 8 * width:
                raise ValueError(f"the id {flat.max()} does not fit into {width} bytes")
            raw = flat.astype(f"<u{width}").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[x * width : y * width] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["raw"])

    end = end_id.to_bytes(width, "little").decode("latin-1")
    ids.mapInArrow(run, "raw binary").select(F.col("raw").cast("string")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def _summary(lengths: np.ndarray, width: int) -> list[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """For each alignment: (number of ends, bytes before the first, bytes after the last, all bytes, tokens of the documents
    between, bytes before each of those)."""
    stops = np.cumsum(lengths + width)  # after each piece and the end bytes that follow it
    total = int(stops[-1]) if len(stops) else 0
    out = []
    for shift in range(width):
        true = np.flatnonzero((shift + stops) % width == 0)
        if not len(true):
            out.append((0, total, total, total, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        at = stops[true]
        out.append((len(true), int(at[0]) - width, total - int(at[-1]), total, (np.diff(at) - width) // width, at[:-1]))
    return out


def token_counts(spark: SparkSession, path: str, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """One row for each document of each file under path: file, doc_index, start_token and n_tokens.

    start_token counts from the beginning of the file and includes ends. Ids after the last end of a file are a document
    of their own, if there are any. Empty files give no rows. The end id's bytes must not overlap themselves (0x5050).
    """
    end = end_id.to_bytes(width, "little")
    if any(end[k:] == end[:-k] for k in range(1, width)):
        raise ValueError(f"the bytes of end id {end_id} overlap themselves")
    raw = spark.read.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done() -> pa.RecordBatch:
            found = _summary(np.concatenate(parts), width)
            cols = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(cols, kinds, strict=True))], names=["file", "block", "n", "head", "tail", "total", "inner", "offsets"])

        for b in batches:
            lengths = np.diff(np.frombuffer(b.column("piece").buffers()[1], np.int32 if b.column("piece").type == pa.binary() else np.int64)[b.column("piece").offset : b.column("piece").offset + b.num_rows + 1]).astype(np.int64)
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            cuts = [0, *(i for i in range(1, b.num_rows) if (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if key is not None and key != (files[lo], blocks[lo]):
                        yield done()
                        parts = []
                    key = (files[lo], blocks[lo])
                    parts.append(lengths[lo:hi])
        if key is not None:
            yield done()

    ranges = pieces.mapInArrow(run, "file string, block long, n array<long>, head array<long>, tail array<long>, total array<long>, inner array<array<long>>, offsets array<array<long>>")
    ranges = stored(ranges, "ranges")
    # the prefix scan moves a few numbers a range; the documents' lengths stay where they are until it is done
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file").orderBy("block")
    at = ranges.drop("inner", "offsets").withColumn("start", F.coalesce(F.sum(F.get("total", F.lit(0))).over(before), F.lit(0)))
    shift = F.pmod(F.col("start"), F.lit(width)).cast("int")
    at = at.select("file", "block", "start", *(F.get(c, shift).alias(c) for c in ("n", "head", "tail", "total")))
    # tails since the last range that holds an end are carried into the next one that does
    at = at.withColumn("run", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = at.withColumn("last", F.lead("block").over(upto).isNull())
    carried = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opened = F.lag(F.when(F.col("n") > 0, F.col("tail"))).over(upto)
    at = at.withColumn("opened", F.coalesce(opened, F.lit(0)))
    at = at.withColumn("carry", F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("total")).otherwise(0)).over(carried), F.lit(0)) + F.coalesce(F.first("opened").over(W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    doc = lambda index, start, size: F.struct(index.alias("doc_index"), (start / width).cast("long").alias("start_token"), (size / width).cast("long").alias("n_tokens"))
    none = F.array().cast("array<struct<doc_index:bigint,start_token:bigint,n_tokens:bigint>>")
    has_end, carried_from = F.col("n") > 0, F.col("start") - F.col("carry")
    first = F.when(has_end, F.array(doc(F.col("docs_before"), carried_from, F.col("carry") + F.col("head")))).otherwise(none)
    # Spark's reader does not tell whether the file's last piece had an end after it; without one its bytes are no multiple
    # of an end, but the count is the same
    left = F.when(has_end, F.col("tail")).otherwise(F.col("carry") + F.col("total"))
    left_from = F.when(has_end, F.col("start") + F.col("total") - F.col("tail")).otherwise(carried_from)
    rest = F.when(F.col("last") & (left > width), F.array(doc(F.col("docs_before") + F.col("n"), left_from, left - width))).otherwise(none)
    edges = at.select("file", F.explode(F.concat(first, rest)).alias("d")).select("file", "d.*")
    places = at.filter("n > 1").select("file", "block", "start", "docs_before")
    own = F.pmod(F.col("start"), F.lit(width)).cast("int")
    pairs = ranges.select("file", "block", "inner", "offsets").join(places, ["file", "block"]).select("file", "start", "docs_before", F.posexplode(F.arrays_zip(F.get("inner", own).alias("inner"), F.get("offsets", own).alias("offsets"))).alias("i", "d"))
    inner = pairs.select("file", (F.col("docs_before") + 1 + F.col("i")).alias("doc_index"), ((F.col("start") + F.col("d.offsets")) / width).cast("long").alias("start_token"), F.col("d.inner").alias("n_tokens"))
    return edges.unionByName(inner)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    counts = token_counts(spark, path)
    return counts.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("file_number"), "doc_index", "start_token", "n_tokens")
