"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits once, and stored as (hash, id, position) rows; documents are
counted per hash; lines whose hash is found in too many documents are dropped from every document but the one with the
smallest id; the rest is joined again by position. The lines of a hash are dealt to several places by their documents, so
a line that all documents share loads no task. Texts move once, when the dropped positions come back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import ASCII_SPACE, ascii_lower, spread_join, stored, table, unused


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, one row for each row of docs.

    Lines whose key has at least min_chars code points and is found in at least min_docs documents stay only in the
    document with the smallest id. A null or empty text is one empty line. Rows with the same id are one document: all
    of them keep or lose a line together. A row with a null id is no document of its own, so it is never counted; it
    loses the lines that other documents share. Columns of docs that are named n_lines, n_dropped or kept_text are
    replaced.
    """
    out_cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    mark, own_id, own_mark, gone, parts = unused([*docs.columns, "n_lines", "n_dropped", "kept_text"], "mark", "own_id", "own_mark", "gone", "parts")
    base = docs.select(*out_cols).withColumn(mark, F.xxhash64(F.col(text_col)))
    lines = (
        base.select(F.col(id_col).alias("id"), F.col(mark).alias("mark"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
        .select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = stored(lines, "lines")
    shared = lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs).drop("n")
    dropped = spread_join(lines, shared, ["h1", "h2"], F.struct("id", "pos")).filter(~F.col("id").eqNullSafe(F.col("first")))
    dropped = dropped.groupBy(F.col("id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set("pos").alias(gone))
    joined = base.join(dropped, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)), "left")
    kept = joined.withColumn(parts, _lines(F.col(text_col))).withColumn("n_lines", F.size(parts).cast("long"))
    kept = kept.withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return kept.withColumn("kept_text", text).select(*out_cols, "n_lines", "n_dropped", "kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND s.first_doc <> k.doc_id) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
