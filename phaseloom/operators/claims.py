"""Claim lines of documents: categories of words, safety tiers, and the rule tables of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions.exprs import collapse

# Fixed values of the claim scan: the words of each category, and for each tier, in the order in which tiers are tried, its
# words, level, status, whether a claim needs a rewrite, and the reason. A claim that no tier names takes the last one.
CATEGORIES = {
    "doctrine": ["dukkha", "taṇhā", "tanha", "upādāna", "upadana", "anattā", "anatta", "anicca", "paṭiccasamuppāda", "jhāna", "arūpa", "nibbāna", "vimutti", "fetters", "hindrances"],
    "constraint": ["exit cost", "lock-in", "rigidity", "cheap exits", "permeability", "state-grasping", "attractor", "hysteresis", "fragmentation", "residue", "defect load"],
    "science": ["q", "qabs", "fdress", "pci", "pcist", "lzc", "entropy", "eeg", "meg", "lfp", "phase field", "anesthesia", "propofol", "ketamine", "meditation", "criticality", "topology"],
    "speculation": ["soul", "braid", "immortal", "validated", "proves", "karmic deletion", "instant", "arhat state", "vacuum", "cosmic", "transceiver", "grand-parent fossil", "phase conjugate trauma deletion"],
}
TIERS = [
    (["phase conjugate trauma deletion", "trauma deletion", "guaranteed healing", "proof of immortality", "instant arhat", "clinical bypass", "theory validated", "proves language"], "unsafe_or_requires_rewrite", "unsafe_until_rewritten", True, "unsafe"),
    (["soul is real", "proves", "karmic deletion", "immortal", "vacuum", "topological braid", "topological afterlife", "kl1", "quantum-vacuum"], "speculative_quarantined", "quarantine_only", True, "speculative"),
    (["qabs", "fdress", " pci", "pcist", "lzc", "entropy", "anesthesia", "eeg", "meg", "lfp", "criticality", "q "], "research_hypothesis", "research_hypothesis", False, None),
    (["dukkha", "exit cost", "cheap exits", "taṇhā", "upādāna", "anattā", "anatta", "anicca", "lock-in", "state-grasping"], "book_safe_core", "book_safe", False, None),
]
OTHERWISE = ("book_safe_core", "metaphor_only", False, None)


def _any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def claims(docs: DataFrame, id_col: str, text_col: str, categories: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    """(id, claim_no, claim_id, text, normalized, categories): trimmed lines that hold a word of some category, numbered from 0 in each document.

    Words are sought anywhere in the lower-cased line. A null text has no lines; rows that repeat an id are one document,
    whose equal lines are numbered in any order.
    """
    whole = F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r", ""), "\n", -1)
    bare = F.transform(whole, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    both = F.transform(bare, lambda x: F.struct(x.alias("text"), F.lower(x).alias("low")))  # before the lines are rows: a filter on them would repeat it for each word
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(both).alias("pos", "line")).select("id", "pos", "line.text", "line.low")
    of = F.array_compact(F.array(*(F.when(_any(F.col("low"), ws), F.lit(name)) for name, ws in categories.items())))
    lines = lines.withColumn("categories", of).filter(F.size("categories") > 0)
    no = F.row_number().over(W.partitionBy("id").orderBy("pos", "text")) - 1  # lines of one document
    lines = lines.withColumn("claim_no", no.cast("long"))
    claim_id = F.concat(F.col("id").cast("string"), F.lit("_c"), F.lpad(F.col("claim_no").cast("string"), F.greatest(F.lit(4), F.length(F.col("claim_no").cast("string"))), F.lit("0")))
    return lines.select("id", "claim_no", claim_id.alias("claim_id"), "text", collapse(F.col("text")).alias("normalized"), "categories")


def tiered(found: DataFrame, text_col: str = "text", tiers: list[tuple] = TIERS, otherwise: tuple = OTHERWISE) -> DataFrame:
    """found with tier, status, needs_rewrite and flags of the first tier that has a word in the lower-cased text."""
    def first(low: Column) -> Column:
        at = F.lit(len(tiers))
        for k, (words, *_) in reversed(list(enumerate(tiers))):
            at = F.when(_any(low, words), F.lit(k)).otherwise(at)
        return at

    out = found.withColumn("__tier", F.transform(F.array(F.lower(text_col)), first)[0])
    rows = [*(tuple(result) for _, *result in tiers), otherwise]
    for k, (name, kind) in enumerate((("tier", "string"), ("status", "string"), ("needs_rewrite", "boolean"), ("reason", "string"))):
        out = out.withColumn(name, F.get(F.array(*(F.lit(r[k]).cast(kind) for r in rows)), F.col("__tier")))
    return out.withColumn("flags", F.array_compact(F.array("reason"))).drop("reason", "__tier")
