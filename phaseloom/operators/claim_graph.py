"""Claims over a graph of scopes and bridges: what evidence allows, what is blocked by what, and the ledger of claims.

Rules are small tables: scopes(scope, level, needs_real), needs(scope, evidence), bridges(bridge, source, target, needs_real,
needs_review, quarantined) and bridge_needs(bridge, evidence). Subjects and their evidence are tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.operators import contracts as ct
from phaseloom.operators.relational import ranked

REVIEW = "review"


def _missing(subjects: DataFrame, subject: str, rules: DataFrame, needs: DataFrame, rule: str, have: DataFrame) -> DataFrame:
    """subjects beside every rule, with held, the subject's evidence, and missing: what the rule needs of it and the subject has not, sorted.

    Evidence is gathered by subject once; each rule then looks into it within the row.
    """
    held = have.groupBy(subject).agg(F.collect_set("evidence").alias("held"))
    rules = rules.join(needs.groupBy(rule).agg(F.collect_set("evidence").alias("__needs")), rule, "left")
    none = F.array().cast("array<string>")
    grid = subjects.join(held, subject, "left").withColumn("held", F.coalesce("held", none)).crossJoin(F.broadcast(rules))  # rules are a fixed, small table
    return grid.withColumn("missing", F.array_sort(F.array_except(F.coalesce("__needs", none), "held"))).drop("__needs")


def bridge_statuses(subjects: DataFrame, subject: str, have: DataFrame, bridges: DataFrame, bridge_needs: DataFrame) -> DataFrame:
    """(subject, bridge, source, target, status, missing) of every bridge for every subject; subjects(subject, mock).

    The first that holds counts: quarantined for good, a mock run where a real one is needed, missing evidence, a missing
    review; else the bridge is promotable.
    """
    m = _missing(subjects, subject, bridges, bridge_needs, "bridge", have)
    status = (
        F.when(F.col("quarantined"), "quarantined").when(F.col("mock") & F.col("needs_real"), "blocked_pending_real_execution").when(F.size("missing") > 0, "blocked_pending_evidence")
        .when(F.col("needs_review") & ~F.array_contains("held", REVIEW), "blocked_pending_review").otherwise("promotable")
    )
    return m.select(subject, "bridge", "source", "target", status.alias("status"), "missing")


def reachable_scopes(allowed: DataFrame, subject: str, statuses: DataFrame, base: str, rounds: int) -> DataFrame:
    """(subject, reached, max_scope): the scopes that promotable bridges connect to the base, one after the other, each of them allowed, and that of the highest level.

    A subject has as many scopes and bridges as there are rules, so it goes from scope to scope within its row; rounds: the
    number of scopes.
    """
    ok = allowed.groupBy(subject).agg(F.collect_set(F.when(F.col("allowed"), F.struct("level", "scope"))).alias("ok"))
    promotable = F.when(F.col("status") == "promotable", F.struct("source", "target"))
    open_ = statuses.groupBy(subject).agg(F.collect_set(promotable).alias("open"))
    s = ok.join(open_, subject, "left").withColumn("may", F.transform("ok", lambda x: x["scope"]))
    s = s.withColumn("open", F.filter(F.coalesce("open", F.array().cast(s.schema["open"].dataType)), lambda o: F.array_contains("may", o["target"])))
    step = lambda seen, _: F.array_union(seen, F.transform(F.filter("open", lambda o: F.array_contains(seen, o["source"])), lambda o: o["target"]))
    s = s.withColumn("reached", F.aggregate(F.sequence(F.lit(1), F.lit(max(rounds, 1))), F.filter("may", lambda x: x == base), step))
    return s.select(subject, "reached", F.array_max(F.filter("ok", lambda x: F.array_contains("reached", x["scope"])))["scope"].alias("max_scope"))


def claim_matrix(subjects: DataFrame, subject: str, have: DataFrame, scopes: DataFrame, needs: DataFrame, statuses: DataFrame, base: str) -> DataFrame:
    """(subject, scope, allowed, reached, blockers, max_scope): every scope for every subject.

    A scope is allowed where no evidence is missing and the run is real if it must be; it is reached where bridges lead to
    it from the base over allowed scopes. max_scope is the reached one of the highest level.
    """
    m = _missing(subjects, subject, scopes, needs, "scope", have)
    mocked = F.when(F.col("mock") & F.col("needs_real"), F.array(F.lit("real_execution"))).otherwise(F.array().cast("array<string>"))
    m = m.withColumn("blockers", F.concat(mocked, "missing")).withColumn("allowed", F.size("blockers") == 0).select(subject, "scope", "level", "allowed", "blockers")
    far = reachable_scopes(m, subject, statuses, base, scopes.count())
    m = m.join(far, subject, "left").withColumn("reached", F.coalesce(F.array_contains("reached", F.col("scope")), F.lit(False)))
    return m.select(subject, "scope", "allowed", "blockers", "reached", "max_scope")


def promotion_state(subjects: DataFrame, subject: str, have: DataFrame, labels: str, controls: list[str], mechanism: str, replication: str) -> DataFrame:
    """(subject, promotion_state): the first gate that a subject does not pass, or what it may be called beyond them."""
    e = have.groupBy(subject).agg(F.collect_set("evidence").alias("e"))
    s = subjects.join(e, subject, "left").withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    has = lambda *x: F.size(F.array_except(F.array(*map(F.lit, x)), "e")) == 0
    state = (
        F.when(F.col("mock"), "engineering_validated").when(~has(labels), "blocked_pending_real_execution").when(~has(*controls), "blocked_pending_controls").when(~has(REVIEW), "blocked_pending_review")
        .when(has(mechanism, replication), "mechanism_candidate").otherwise("empirical_candidate")
    )
    return s.select(subject, state.alias("promotion_state"))


def ledger(claims: DataFrame, claim: str, key: str, weights: dict[str, float], rejected: str, ceilings: DataFrame, links: DataFrame, falsifiers: DataFrame) -> DataFrame:
    """(claim, composite, status, gate_reasons, source_ids, n_falsifiers, event_id, resulting_status): every claim with its score, evidence and review event.

    links(claim, source) and falsifiers(claim, falsifier) are tables of any size; events are numbered in the order of the
    claims. A status is that of the score under the key's ceiling: links and falsifiers are listed and never change it.
    """
    s = ct.weighted_status(claims, weights, F.col(rejected), ceilings, key).select(claim, "composite", "status", "gate_reasons")
    sources = links.groupBy(claim).agg(F.array_sort(F.collect_set(F.col("source").cast("string"))).alias("source_ids"))
    against = falsifiers.groupBy(claim).agg(F.countDistinct("falsifier").alias("n_falsifiers"))
    out = s.join(sources, claim, "left").join(against, claim, "left").na.fill(0, ["n_falsifiers"])
    out = ranked(out.withColumn("__down", -F.col(claim)), "__down", claim, "__no").drop("__down")
    number = F.col("__no").cast("string")
    event = F.concat(F.lit("SEED-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    return out.withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))).withColumn("event_id", event).withColumn("resulting_status", F.col("status")).drop("__no")
