"""Benchmark decontamination with DataFrame functions only.

The benchmark's n-grams form a small table that is broadcast when its size has been checked, else joined by shuffle.
Training texts are scanned once. A window of L words holds a shorter gram of g = (L+1)//2 words that starts at a
multiple of L-g+1, so only those aligned grams are looked up; each carries the few words around it, and the full windows
there are then verified word by word. No text is shuffled: only hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import ascii_lower, spread_join, stored, table, unused

#: Separators of words: ASCII characters that are no digits and, after lower-casing, no letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmarks with up to so many distinct windows, of so many bytes with their item ids, are broadcast; larger ones are
#: joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 100_000_000


def words(text: Column) -> Column:
    """Array of normalised words; empty for a null text."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def _trimmed(parts: Column) -> Column:
    """split() leaves an empty string where a text starts or ends with separators."""
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    trail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - trail)


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("__parts", words(F.col(text_col))).withColumn("__words", _trimmed(F.col("__parts"))).drop("__parts", text_col)


def benchmark_windows(bench: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, gram, items): each distinct window of the benchmark and the ids, as strings, of the items that have it."""
    b = _with_words(bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("__t")), "__t")
    b = b.withColumn("len", F.least(F.size("__words"), F.lit(n))).filter(F.col("len") > 0)
    grams = F.transform(F.sequence(F.lit(1), F.size("__words") - F.col("len") + 1), lambda i: F.array_join(F.slice("__words", i, F.col("len")), " "))
    return b.select("item", "len", F.explode(grams).alias("gram")).groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def _lookup(many: DataFrame, few: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Left join of many with few, which has one row a key: broadcast if it is small, else with hot keys dealt to several places."""
    return many.join(F.broadcast(few), keys, "left") if small else spread_join(many, few, keys, F.struct("id", "mark", "p"), "left")


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, text_hash, n_words, hit_words and items.

    hit_words: sorted positions of the words that windows of the benchmark cover; items: sorted ids of the items they
    come from. Rows that repeat another row's id and text each get a row. Null texts have no words;
    null ids stay null; benchmark items without words have no windows. Other columns of docs are not read.
    """
    windows = stored(benchmark_windows(bench, n), "windows")
    weight = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    size = {r["len"]: (r["n"], r["bytes"]) for r in windows.groupBy("len").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).collect()}  # n rows at most
    small = sum(k for k, _ in size.values()) <= BROADCAST_WINDOWS and sum(b for _, b in size.values()) <= BROADCAST_BYTES
    base = _with_words(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("__t")), "__t")
    base = base.withColumn("n_words", F.size("__words"))

    def anchors(length: int) -> Column:
        g = (length + 1) // 2
        step = length - g + 1
        gram = lambda p: F.struct(
            F.lit(length).alias("len"),
            p.alias("p"),
            F.xxhash64(F.lit(length), F.slice("__words", p + 1, F.lit(g))).alias("anchor"),
            F.slice("__words", F.greatest(p - step + 2, F.lit(1)), F.lit(length + step - 1)).alias("near"),
        )
        starts = F.when(F.col("n_words") >= length, F.sequence(F.lit(0), F.col("n_words") - g, F.lit(step)))
        return F.coalesce(F.transform(starts, gram), F.array().cast("array<struct<len:int,p:int,anchor:bigint,near:array<string>>>"))

    row = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("p"), F.xxhash64("id", "mark").alias("anchor"), F.lit(None).cast("array<string>").alias("near")))
    scan = base.select("id", "mark", "n_words", F.explode(F.concat(row, *[anchors(k) for k in sorted(size)])).alias("a")).select("id", "mark", "n_words", "a.*")
    known = None
    for k in sorted(size):
        g, w = (k + 1) // 2, F.split("gram", " ")
        own = windows.filter(F.col("len") == k).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k - g + 1)), lambda i: F.xxhash64(F.lit(k), F.slice(w, i, F.lit(g))))).alias("anchor"), F.lit(True).alias("known"))  # noqa: B023
        known = own if known is None else known.unionByName(own)
    if known is None:
        scan = scan.filter(F.col("p") == -1)
        hits = scan.select("id", "mark", "n_words", F.lit(True).alias("self"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("array<string>").alias("items"))
    else:
        found = _lookup(scan, known.distinct(), ["anchor"], small).filter((F.col("p") == -1) | F.col("known"))
        # the aligned gram at p lies inside the windows that start at p-step+1 .. p
        step = F.col("len") - F.floor((F.col("len") + 1) / 2).cast("int") + 1
        first = F.greatest(F.col("p") - step + 1, F.lit(0))
        last = F.least(F.col("p"), F.col("n_words") - F.col("len"))
        starts = F.when(F.col("p") == -1, F.array(F.lit(-1))).otherwise(F.when(first <= last, F.sequence(first, last)))
        tries = found.withColumn("first", first).withColumn("start", F.explode(starts))
        # a document's own row has length 0 and a gram of its own, so that it finds nothing and is dealt evenly
        gram = F.when(F.col("p") >= 0, F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, F.greatest("len", F.lit(1))), " ")).otherwise(F.col("anchor").cast("string"))
        tries = tries.select("id", "mark", "p", "n_words", "len", "start", gram.alias("gram"), (F.col("p") == -1).alias("self"))
        hits = _lookup(tries, windows, ["len", "gram"], small).filter(F.col("self") | F.col("items").isNotNull())
        hits = hits.select("id", "mark", "n_words", "self", F.when(~F.col("self"), F.col("start")).alias("start"), F.when(~F.col("self"), F.col("start") + F.col("len")).alias("end"), "items")
    span = F.when(F.col("start").isNotNull(), F.sequence(F.col("start"), F.col("end") - 1))
    per_doc = hits.groupBy("id", "mark").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("self").cast("int").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(span)))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    return per_doc.select(F.col("id").alias(id_col), F.col("mark").alias("text_hash"), "n_words", "hit_words", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents") -> DataFrame:
    """docs without what the benchmark's windows cover; same columns.

    remove="documents" drops each document with a hit; "spans" drops the hit words, keeping the other words of those
    documents in normalised form, one space between them.
    """
    own_id, own_mark, mark, hit, all_words, parts = unused(docs.columns, "own_id", "own_mark", "mark", "hit_words", "words", "parts")
    found = contamination(docs, bench, n, id_col, text_col).filter(F.size("hit_words") > 0)
    found = found.select(F.col(id_col).alias(own_id), F.col("text_hash").alias(own_mark), F.col("hit_words").alias(hit)).distinct()
    keyed = docs.withColumn(mark, F.xxhash64(text_col))
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark))
    if remove == "documents":
        return keyed.join(found, on, "left_anti").select(*docs.columns)
    both = keyed.join(found, on, "left").withColumn(parts, words(F.col(text_col))).withColumn(all_words, _trimmed(F.col(parts)))
    every = F.sequence(F.lit(0), F.size(all_words) - 1)
    rest = F.array_join(F.transform(F.array_except(every, hit), lambda i: F.get(all_words, i)), " ")
    return both.withColumn(text_col, F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, d.n, item_id FROM dwin d JOIN win USING (n, gram)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
