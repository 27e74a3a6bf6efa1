"""A corpus pipeline from raw documents to token ids, one Parquet table after each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from phaseloom.llm.common import shared_dir, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay, unchanged.

    A null text is scored as an empty one, equal texts alike; rows that repeat stay or go together. Labels teach only
    where crc32 of the id leaves a remainder by 5. Without labels every document stays.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id", 5)))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; lines that a document with a smaller id has go from its text, and n_chars follows.

    A null text stays null. Rows with one id are one document; a row with a null id is none, and loses lines that two
    documents share. Further columns pass through.
    """
    out = line_dedup.line_dedup(docs)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Texts without words are linked with nothing and stay. Rows that repeat an id and a text stay or go together; null ids
    are never the smallest of a group that has others.
    """
    return near_dedup.deduplicate(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark stay, unchanged; a null text has no words and stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, one row for each row; a null text has none. Columns named n_tokens or ids are replaced."""
    return bpe.tokenize(docs).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]

#: A trained model decides in the first stage, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again. An empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
