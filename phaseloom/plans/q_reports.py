"""Queries of manifests, ingestion packs, scores with ceilings, contracts and the smaller functions in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import claim_graph as cg
from phaseloom.operators import contracts as ct
from phaseloom.operators import relational as rel
from phaseloom.operators import retrieval as rt
from phaseloom.plans.q_text import _FLAT, _PHRASES, _phrases
from phaseloom.plans.views import rounded, table
from phaseloom.sources.readers import checkpointed, shared_path

QUERIES = {}


def query(name: str, statement: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


# --- documents as files: their paths and the rule tables that classify them ----------------------------------------------

#: File names that the documents take in turn.
_FILES = ["report.md", "metrics.csv", "config.yaml", "notes.txt", "runbook.md", "claims_draft.md", "labels.json", "blocks.csv"]
_STAGES = [("labels", ["label"]), ("blocks", ["blocks"]), ("docs", ["runbook", "report"]), ("configs", [".yaml"]), ("metrics", ["metric"]), ("claims", ["claim"])]
_EVIDENCE = [("mock", ["mock", "fixture", "src0/"]), ("review_required", ["src1/", "claims"]), ("blocked", ["blocked"]), ("pending", ["pending", ".yaml"])]
_MODES = [("explainer", ["runbook", "notes"]), ("outline", ["report", "plan"]), ("status", ["label"]), ("metric", ["metric", "blocks"])]
_LANES = [("governance", ["claim", "runbook"]), ("publication", ["report"]), ("engineering", ["config", "metrics", "blocks", "labels"])]
_ROLES = [("runbook", ["runbook"]), ("summary", ["report.md"]), ("config", [".yaml"]), ("metrics", ["metric", ".csv"]), ("status", ["label"]), ("governance", ["claim"])]
#: Phrases that quarantine a text.
_UNSAFE = ["idiot", "scum", "trash"]
_PRIORITY = {"docs": 1, "labels": 2, "metrics": 2, "claims": 2, "blocks": 3, "configs": 3}

_PATH_SQL = "source || '/' || lang || '/' || doc_id || '_' || ([" + ", ".join(f"'{f}'" for f in _FILES) + f"])[CAST(doc_id % {len(_FILES)} AS INTEGER) + 1]"
_FLAT_SQL = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_FILES_SQL = f"""files AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, {_PATH_SQL} AS path FROM documents),
  f1 AS (SELECT *, {ct.first_match_sql('path', _STAGES, 'unknown')} AS stage, {ct.first_match_sql('path', _EVIDENCE, 'operational')} AS evidence_state,
         {ct.first_match_sql('path', _MODES, 'explainer')} AS mode, {ct.first_match_sql('path', _LANES, 'internal')} AS lane, {ct.first_match_sql('path', _ROLES, 'unknown')} AS role,
         array_to_string(list_filter({_UNSAFE}, lambda p: contains({_FLAT_SQL}, p)), ';') AS forbidden FROM files),
  f2 AS (SELECT *, CASE WHEN forbidden <> '' THEN 'quarantined' ELSE 'safe' END AS safety FROM f1),
  f3 AS (SELECT *, CASE WHEN safety <> 'safe' THEN 5 {' '.join(f"WHEN stage = '{s}' THEN {p}" for s, p in _PRIORITY.items())} ELSE 5 END AS priority FROM f2)"""


def _files(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents")
    name = F.get(F.array(*[F.lit(f) for f in _FILES]), (F.col("doc_id") % len(_FILES)).cast("int"))
    f = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), name).alias("path"))
    for col, rules, otherwise in (("stage", _STAGES, "unknown"), ("evidence_state", _EVIDENCE, "operational"), ("mode", _MODES, "explainer"), ("lane", _LANES, "internal"), ("role", _ROLES, "unknown")):
        f = f.withColumn(col, ct.first_match(F.col("path"), rules, otherwise))
    f = f.withColumn("forbidden", F.array_join(x.phrase_hits(F.col("text"), _UNSAFE), ";")).withColumn("safety", F.when(F.col("forbidden") != "", "quarantined").otherwise("safe"))
    priority = F.when(F.col("safety") != "safe", 5)
    for s, p in _PRIORITY.items():
        priority = priority.when(F.col("stage") == s, p)
    return f.withColumn("priority", priority.otherwise(5))


@query("p2_rule_tables", f"WITH {_FILES_SQL} SELECT doc_id, stage, evidence_state, mode, lane, role, priority FROM f3")
def _p2(spark, d):  # noqa: ANN001, ANN202
    return _files(spark, d).select("doc_id", "stage", "evidence_state", "mode", "lane", "role", "priority")


_CONTEXT_SQL = (
        "CASE WHEN safety <> 'safe' THEN 'human_review_before_indexing' WHEN evidence_state = 'mock' THEN 'mock_data_only' WHEN evidence_state IN ('pending', "
        "'review_required') THEN 'validation_pending' WHEN priority = 1 THEN 'ready_for_priority_indexing' ELSE 'standard' END"
)
_NEXT_SQL = (
        "CASE WHEN safety <> 'safe' THEN 'quarantine' WHEN evidence_state = 'mock' THEN 'index_with_provenance_label' WHEN evidence_state IN ('pending', "
        "'review_required') THEN 'await_review_then_index' WHEN priority = 1 THEN 'index_first' ELSE 'index_in_batch' END"
)


@query(
    "x3_manifest_records",
    f"""WITH {_FILES_SQL} SELECT 'art_' || sha256(path)[1:16] AS artifact_id, path, regexp_replace(path, '^[^/]*/', '') AS relative_path, regexp_extract(path, '\\.([a-z]+)$', 1) AS file_type, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
    stage, source AS dataset_id, evidence_state, safety AS claim_safety_status, priority AS index_priority, string_split(text, chr(10))[1][1:80] AS title, sha256(text) AS content_hash, length(text) AS n_chars, forbidden AS forbidden_claims_found,
    mode AS recommended_mode, {_CONTEXT_SQL} AS required_context, {_NEXT_SQL} AS next_action FROM f3""",
)
def _x3(spark, d):  # noqa: ANN001, ANN202
    f = _files(spark, d)
    safe, waiting = F.col("safety") == "safe", F.col("evidence_state").isin("pending", "review_required")
    said = lambda a, b, c, e, o: F.when(~safe, a).when(F.col("evidence_state") == "mock", b).when(waiting, c).when(F.col("priority") == 1, e).otherwise(o)
    return f.select(
        x.stable_id(F.col("path"), prefix="art_").alias("artifact_id"), "path", F.regexp_replace("path", "^[^/]*/", "").alias("relative_path"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("file_type"),
        F.octet_length("text").cast("long").alias("size_bytes"), "stage", F.col("source").alias("dataset_id"), "evidence_state", F.col("safety").alias("claim_safety_status"), F.col("priority").alias("index_priority"),
        F.substring(F.get(F.split("text", "\n", -1), F.lit(0)), 1, 80).alias("title"), F.sha2("text", 256).alias("content_hash"), F.char_length("text").cast("long").alias("n_chars"), F.col("forbidden").alias("forbidden_claims_found"),
        F.col("mode").alias("recommended_mode"),
        said("human_review_before_indexing", "mock_data_only", "validation_pending", "ready_for_priority_indexing", "standard").alias("required_context"),
        said("quarantine", "index_with_provenance_label", "await_review_then_index", "index_first", "index_in_batch").alias("next_action"),
    )


_PACK_SQL = f"""WITH {_FILES_SQL}, c AS (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1800 THEN 1 ELSE CAST(ceil((length(text) - 1800) / 1600) AS BIGINT) + 1 END)) AS part FROM f3),
  s AS (SELECT *, regexp_replace(substring(text, part * 1600 + 1, 1800), '^\\s+|\\s+$', '', 'g') AS chunk FROM c),
  k AS (SELECT *, CASE WHEN safety <> 'safe' THEN 'quarantine_notice' ELSE role END AS chunk_role, CASE WHEN safety <> 'safe' THEN 'quarantined' WHEN priority > 3 THEN 'priority_excluded' ELSE 'included' END AS reason FROM s WHERE chunk <> '')"""


def _pack(spark, d):  # noqa: ANN001, ANN202
    f = _files(spark, d)
    c = rt.chunks(f, "doc_id", "text", 1800, 200).withColumnRenamed("id", "doc_id").join(f.drop("text"), "doc_id")
    reason = F.when(F.col("safety") != "safe", "quarantined").when(F.col("priority") > 3, "priority_excluded").otherwise("included")
    return c.withColumn("chunk_role", F.when(F.col("safety") != "safe", "quarantine_notice").otherwise(F.col("role"))).withColumn("reason", reason)


_TAGS = {"dataset": "source", "stage": "stage", "evidence_state": "evidence_state", "mode": "mode", "chunk_role": "chunk_role", "claim_safety": "safety"}


@query("x4_pack_chunks",
        f"{_PACK_SQL} SELECT 'chk_' || sha256(doc_id || '|' || part)[1:16] AS chunk_id, CAST(part AS INTEGER) AS part, sha256(chunk) AS content_hash, "
        f"length(chunk) AS n_chars, chunk_role, concat_ws(',', "
     + ", ".join(f"'{t}:' || {c}" for t, c in _TAGS.items()) + ", 'priority:' || priority) AS tags, reason FROM k")
def _x4(spark, d):  # noqa: ANN001, ANN202
    tags = F.concat_ws(",", *[F.concat(F.lit(f"{t}:"), c) for t, c in _TAGS.items()], F.concat(F.lit("priority:"), F.col("priority").cast("string")))
    return _pack(spark, d).select("chunk_id", "part", F.sha2("chunk", 256).alias("content_hash"), F.char_length("chunk").cast("long").alias("n_chars"), "chunk_role", tags.alias("tags"), "reason")


@query("a13_pack_counts",
        f"{_PACK_SQL} SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_artifacts, count(*) FILTER (WHERE reason = 'included') AS n_included, "
        f"count(*) FILTER (WHERE reason = 'quarantined') AS n_quarantined, count(*) FILTER (WHERE reason = 'priority_excluded') AS n_excluded FROM k GROUP BY "
        f"source"
    )
def _a13(spark, d):  # noqa: ANN001, ANN202
    n = lambda r: F.count_if(F.col("reason") == r)
    return _pack(spark, d).groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_artifacts"), n("included").alias("n_included"), n("quarantined").alias("n_quarantined"), n("priority_excluded").alias("n_excluded"))


_WORDS = ["license", "copyright", "idiot", "the"]


@query("x13_registry_rows",
        f"WITH {_FILES_SQL} SELECT doc_id, path, lane, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256, array_to_string(list_filter({_WORDS}, "
        f"lambda p: contains(lower(text), p)), ';') AS keywords, CASE WHEN forbidden <> '' THEN 'replace ' || chr(39) || string_split(forbidden, ';')[1] || "
        f"chr(39) ELSE '' END AS safe_rewrite FROM f3"
    )
def _x13(spark, d):  # noqa: ANN001, ANN202
    words = F.array_join(F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: F.contains(F.lower("text"), w)), ";")
    rewrite = F.when(F.col("forbidden") != "", F.concat(F.lit("replace '"), F.get(F.split("forbidden", ";"), F.lit(0)), F.lit("'"))).otherwise("")
    return _files(spark, d).select("doc_id", "path", "lane", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), words.alias("keywords"), rewrite.alias("safe_rewrite"))


@query("x13_lane_matrix",
        f"WITH {_FILES_SQL} SELECT lane, stage, count(*) AS n_files, count(*) FILTER (WHERE safety <> 'safe') AS n_risky, count(DISTINCT sha256(text)) AS "
        f"n_distinct FROM f3 GROUP BY ALL"
    )
def _x13b(spark, d):  # noqa: ANN001, ANN202
    return _files(spark, d).groupBy("lane", "stage").agg(F.count("*").alias("n_files"), F.count_if(F.col("safety") != "safe").alias("n_risky"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"))


@query("x14_manifest_with_excludes",
        f"WITH {_FILES_SQL} SELECT path, sha256(text) AS sha256 FROM files WHERE NOT (path LIKE 'src0/%' OR path LIKE '%.yaml' OR path LIKE "
        f"'%/en/%\\_notes.txt' ESCAPE '\\')"
    )
def _x14(spark, d):  # noqa: ANN001, ANN202
    return ct.hash_manifest(_files(spark, d), "path", "text", [r"^src0/", r"\.yaml$", r"/en/[^/]*_notes\.txt$"])


@query("x15_cited_sources",
        "WITH a AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 = 0 THEN '' ELSE chr(10) || '## Sources used' || chr(10) || '- `chk_' || conv_id || '` "
        "and `doc_' || turn || '`' || CASE WHEN conv_id % 5 = 0 THEN chr(10) || '## Notes' || chr(10) || '`not cited`' ELSE '' END END AS text FROM "
        "conversations WHERE role = 'assistant') SELECT conv_id, turn, array_to_string(regexp_extract_all(string_split(split_part(text, '## Sources used' || "
        "chr(10), 2), chr(10) || '##')[1], '`([^`]+)`', 1), ',') AS cited FROM a"
    )
def _x15(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    listed = F.concat(F.lit("\n## Sources used\n- `chk_"), F.col("conv_id").cast("string"), F.lit("` and `doc_"), F.col("turn").cast("string"), F.lit("`"), F.when(F.col("conv_id") % 5 == 0, "\n## Notes\n`not cited`").otherwise(""))
    text = F.concat("text", F.when(F.col("conv_id") % 3 == 0, "").otherwise(listed))
    return c.select("conv_id", "turn", F.array_join(rt.cited_sources(text), ",").alias("cited"))


# --- scores, lookups and small functions ---------------------------------------------------------------------------------

# Fixed values of the score: weights of its dimensions.
_WEIGHTS = {"support": 0.30, "depth": 0.20, "coherence": 0.15, "falsifiable": 0.20, "relevance": 0.15, "overclaim": -0.25}
_CEILINGS = [("Brand#1", "C"), ("Brand#2", "B"), ("Brand#3", "B")]
_INPUTS = {"support": 1, "depth": 3, "coherence": 7, "falsifiable": 11, "relevance": 13, "overclaim": 29}


_LEDGER = (
    "WITH c AS (SELECT p_partkey, p_brand, " + ", ".join(f"5 - (p_partkey // {k}) % {6 if n != 'overclaim' else 5} * 0.5 AS {n}" if n != "overclaim" else f"CAST((p_partkey // {k}) % 6 AS DOUBLE) AS {n}" for n, k in _INPUTS.items())
    + " FROM part), s AS (SELECT *, " + "round(" + " + ".join(f"{n} * ({w})" for n, w in _WEIGHTS.items()) + """, 9) AS composite, p_partkey % 41 = 0 AS rejected FROM c),
    g AS (SELECT *, CASE WHEN rejected OR (overclaim >= 5 AND support < 4) THEN 'X' WHEN composite >= 3.8 AND support >= 4 AND falsifiable >= 4 THEN 'A' WHEN composite >= 3.0 AND falsifiable >= 3 THEN 'B' ELSE 'C' END AS gate FROM s),
    h AS (SELECT g.*, ceiling, gate <> 'X' AND ceiling IS NOT NULL AND CASE gate WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END > CASE ceiling WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END AS held FROM g LEFT JOIN (VALUES """ + ", ".join(str(c) for c in _CEILINGS) + """) t(b, ceiling) ON b = p_brand)"""
)


def _claims(spark, d):  # noqa: ANN001, ANN202
    key = F.col("p_partkey")
    step = {n: F.floor(key / k) for n, k in _INPUTS.items()}
    rows = table(spark, d, "part").select("p_partkey", "p_brand", *((5 - v % 6 * 0.5 if n != "overclaim" else (v % 6).cast("double")).alias(n) for n, v in step.items()), (key % 41 == 0).alias("no_go"))
    return rows, spark.createDataFrame(_CEILINGS, "p_brand string, ceiling string")


@query("p11_ceilings", _LEDGER + " SELECT p_partkey, round(composite, 4) + 0.0 AS composite, CASE WHEN held THEN ceiling ELSE gate END AS status, concat_ws(';', CASE WHEN held THEN 'ceiling:' || ceiling END, CASE WHEN rejected THEN 'rejected' END) AS gate_reasons FROM h")
def _p11(spark, d):  # noqa: ANN001, ANN202
    rows, ceilings = _claims(spark, d)
    s = ct.weighted_status(rows, _WEIGHTS, F.col("no_go"), ceilings, "p_brand")
    return s.select("p_partkey", rounded(F.col("composite"), 4).alias("composite"), "status", "gate_reasons")


@query(
    "d8_ledger_report",
    _LEDGER + """, l AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS ids, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n FROM lineitem GROUP BY l_partkey), e AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey)::VARCHAR AS no FROM part)
    SELECT p_partkey, round(composite, 4) + 0.0 AS composite, CASE WHEN held THEN ceiling ELSE gate END AS status, concat_ws(';', CASE WHEN held THEN 'ceiling:' || ceiling END, CASE WHEN rejected THEN 'rejected' END) AS gate_reasons,
    coalesce(array_to_string(ids, ','), '') AS source_ids, coalesce(n, 0) AS n_falsifiers, 'SEED-' || CASE WHEN length(no) < 3 THEN lpad(no, 3, '0') ELSE no END AS event_id, CASE WHEN held THEN ceiling ELSE gate END AS resulting_status FROM h JOIN e USING (p_partkey) LEFT JOIN l ON l_partkey = p_partkey""",
)
def _d8(spark, d):  # noqa: ANN001, ANN202
    rows, ceilings = _claims(spark, d)
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    out = cg.ledger(rows, "p_partkey", "p_brand", _WEIGHTS, "no_go", ceilings, li.select("p_partkey", F.col("l_suppkey").alias("source")), li.filter("l_returnflag = 'R'").select("p_partkey", F.col("l_orderkey").alias("falsifier")))
    return out.withColumn("composite", rounded(F.col("composite"), 4)).withColumn("source_ids", F.array_join("source_ids", ","))


@query(
    "p12_change_requests",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 1 END AS newer, o_orderkey % 3 = 0 AS empty, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 1 END AS own FROM orders)
    SELECT o_orderkey, CASE WHEN status = 'closed' THEN 'no_action_closed' WHEN newer IS NOT NULL THEN 'close_as_superseded_by_' || newer WHEN empty AND own = false THEN 'close_as_noop' WHEN own THEN 'keep_open_has_own_changes' ELSE 'manual_review_required' END AS action FROM r""",
)
def _p12(spark, d):  # noqa: ANN001, ANN202
    k = F.col("o_orderkey")
    own = F.when(k % 5 != 0, k % 2 == 1)
    newer = F.when(k % 9 == 0, k + 1)
    action = (
        F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), "no_action_closed").when(newer.isNotNull(), F.concat(F.lit("close_as_superseded_by_"), newer.cast("string")))
        .when((k % 3 == 0) & ~own, "close_as_noop").when(own, "keep_open_has_own_changes").otherwise("manual_review_required")
    )
    return table(spark, d, "orders").select("o_orderkey", action.alias("action"))


_LICENCES = [("MIT", "safe_to_adapt"), ("ISC", "safe_to_adapt"), ("MPL-2.0", "manual_review"), ("GPL", "blocked")]


@query("p12_licences", "WITH l AS (SELECT * FROM (VALUES " + ", ".join(str(v) for v in _LICENCES) +
        ") t(name, status)), s AS (SELECT s_suppkey, (['MIT', 'ISC', 'MPL-2.0', 'GPL', 'other'])[CAST(s_suppkey % 5 AS INTEGER) + 1] AS name FROM supplier) "
        "SELECT s_suppkey, coalesce(status, 'blocked') AS status, coalesce(status, 'blocked') = 'safe_to_adapt' AS can_copy, coalesce(status, 'blocked') <> "
        "'safe_to_adapt' AS needs_review FROM s LEFT JOIN l USING (name)"
    )
def _p12b(spark, d):  # noqa: ANN001, ANN202
    name = F.get(F.array(*[F.lit(n) for n in ("MIT", "ISC", "MPL-2.0", "GPL", "other")]), (F.col("s_suppkey") % 5).cast("int"))
    s = table(spark, d, "supplier").select("s_suppkey", name.alias("name")).join(F.broadcast(spark.createDataFrame(_LICENCES, "name string, status string")), "name", "left")
    status = F.coalesce("status", F.lit("blocked"))
    return s.select("s_suppkey", status.alias("status"), (status == "safe_to_adapt").alias("can_copy"), (status != "safe_to_adapt").alias("needs_review"))


#: Electrode names of the 10-20 system that suppliers' names are mapped to.
_ELECTRODES = ["Fp1", "AF4", "FC3", "Cz", "CP2", "T7", "FT8", "TP9", "P3", "POz", "O1", "Iz", "Tz", "X1"]


@query(
    "p6_scalp_zones",
    "WITH c AS (SELECT s_suppkey, ([" + ", ".join(f"'{e}'" for e in _ELECTRODES) + f"])[CAST(s_suppkey % {len(_ELECTRODES)} AS INTEGER) + 1] AS channel FROM supplier)" + """ SELECT s_suppkey, channel, CASE WHEN regexp_matches(upper(channel), '^(T|FT|TP)') THEN
    CASE WHEN regexp_matches(channel, '[13579][^0-9]*$') THEN 'temporal_left' WHEN regexp_matches(channel, '[02468][^0-9]*$') THEN 'temporal_right' ELSE 'temporal_middle' END
    WHEN regexp_matches(upper(channel), '^[OI]') THEN 'occipital' WHEN regexp_matches(upper(channel), '^P') THEN 'parietal' WHEN regexp_matches(upper(channel), '^(C|FC)') THEN 'central' WHEN regexp_matches(upper(channel), '^(F|AF)') THEN 'frontal' END AS zone FROM c""",
)
def _p6(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(e) for e in _ELECTRODES]), (F.col("s_suppkey") % len(_ELECTRODES)).cast("int")).alias("channel"))
    return c.select("s_suppkey", "channel", x.scalp_zone(F.col("channel")).alias("zone"))


@query("f2_all_variants",
        "WITH q AS (SELECT p_brand, p_size % 5 - 2 AS q, p_partkey FROM part), m AS (SELECT p_brand, abs(avg(q)) AS net, avg(abs(q)) AS absolute, avg((abs(q) "
        "+ 1 - abs(q)) / (abs(q) + 1e-6)) AS rows_ FROM q GROUP BY ALL) SELECT p_brand, round((absolute - net) / (net + 1e-12), 3) AS over_means, round(rows_, "
        "1) AS per_row, round(CASE WHEN absolute = 0 THEN 0 ELSE (absolute - net) / absolute END, 6) AS share FROM m WHERE net > 1e-9"
    )
def _f2(spark, d):  # noqa: ANN001, ANN202
    q = table(spark, d, "part").select("p_brand", (F.col("p_size") % 5 - 2).alias("q"))
    m = q.groupBy("p_brand").agg(F.abs(F.avg("q")).alias("net"), F.avg(F.abs("q")).alias("absolute"), F.avg(x.excess_winding(F.abs("q") + 1, F.col("q"), 1e-6)).alias("per_row")).filter("net > 1e-9")
    return m.select("p_brand", rounded(x.excess_winding(F.col("absolute"), F.col("net")), 3).alias("over_means"), rounded(F.col("per_row"), 1).alias("per_row"), rounded(x.excess_share(F.col("absolute"), F.col("net"))).alias("share"))


@query("f8_path_parts",
        f"WITH {_FILES_SQL} SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/.]*)\\.[^/]*$', 1) AS stem, "
        f"regexp_extract(path, '(\\.[a-z]+)$', 1) AS extension, regexp_extract(path, '_([a-z]+)(_[a-z]+)?\\.', 1) AS suffix FROM files"
    )
def _f8(spark, d):  # noqa: ANN001, ANN202
    part = lambda p: F.regexp_extract("path", p, 1)
    return _files(spark, d).select("doc_id", part("([^/]*)$").alias("name"), part(r"([^/.]*)\.[^/]*$").alias("stem"), part(r"(\.[a-z]+)$").alias("extension"), part(r"_([a-z]+)(_[a-z]+)?\.").alias("suffix"))


@query("f9_nested_strings", """SELECT event_id, CAST(list_sum([CASE WHEN contains(s, 'view') OR contains(s, 'err') THEN 1 ELSE 0 END FOR s IN [event_type, 'x' || user_id, event_type || '!']]) AS INTEGER) AS n_found FROM events""")
def _f9(spark, d):  # noqa: ANN001, ANN202
    nested = F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("b"), F.array(F.concat("event_type", F.lit("!"))).alias("c")).alias("n")))
    return table(spark, d, "events").select("event_id", x.count_json_strings(nested, ["view", "err"]).alias("n_found"))


@query("f11_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events")
def _f11(spark, d):  # noqa: ANN001, ANN202
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", iso.alias("iso")).withColumn("seconds", F.unix_timestamp(F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss'Z'")))


_MARKS, _CERTAIN = ["the ", "we "], ["certain", "proven"]


@query(
    "f12_all_scores",

            "WITH s AS (SELECT conv_id, turn, text, [trim(p) FOR p IN string_split(text, '.') IF trim(p) <> ''] AS parts FROM conversations WHERE role = "
            "'assistant') SELECT conv_id, turn, CASE WHEN len(parts) = 0 THEN 0.0 ELSE round(len(list_filter(parts, lambda p: contains(p, 'the ') OR contains(p, "
            "'we '))) / len(parts), 6) END AS labelled, CASE WHEN contains(text, 'http') THEN 1.0 ELSE 0.0 END AS sources_present, CASE WHEN contains(lower(text), "
            "'certain') OR contains(lower(text), 'proven') THEN 0.0 ELSE 1.0 END AS no_certainty_leak FROM s"
,
)
def _f12(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", rounded(x.labelled_share(F.col("text"), _MARKS)).alias("labelled"), x.holds(F.col("text"), ["http"]).cast("double").alias("sources_present"), (~x.holds(F.lower("text"), _CERTAIN)).cast("double").alias("no_certainty_leak"))


@query("f13_whole_vectors",
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM embeddings), p AS (SELECT vec_id, avg(abs(v[i] - v[j])) AS gap FROM (SELECT vec_id, v, n, unnest(range(1, n + 1)) AS i FROM e), LATERAL (SELECT unnest(range(i + 1, n + 1)) AS j) GROUP BY vec_id) "
        "SELECT vec_id, round(list_sum(list_transform(range(1, n + 1), lambda i: abs(v[i] - v[i % n + 1]))), 4) AS ring, round(gap, 5) AS mean_gap, CAST(n * (n - 1) * (n - 2) // 6 AS BIGINT) AS n_triples FROM e JOIN p USING (vec_id)"
    )
def _f13(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return e.select("vec_id", rounded(x.ring_sum("v"), 4).alias("ring"), rounded(x.mean_pair_gap("v"), 5).alias("mean_gap"), x.choose_three(F.size("v")).alias("n_triples"))


@query("f15_even_grid",
        "WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL) SELECT event_type, CAST(i AS INTEGER) AS i, round(lo + (hi "
        "- lo) * i / 9, 6) AS point FROM r, range(10) g(i)"
    )
def _f15(spark, d):  # noqa: ANN001, ANN202
    r = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return r.select("event_type", F.posexplode(x.even_grid(F.col("lo"), F.col("hi"), 10)).alias("i", "point")).withColumn("point", rounded(F.col("point")))


@query("a20_alignment_counts",
        "WITH s AS (SELECT event_type AS file, user_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL), m AS (SELECT file, max(n) AS "
        "full_ FROM s GROUP BY ALL) SELECT file, count(*) AS n_channels, count(*) FILTER (WHERE n = full_) AS n_full, count(*) FILTER (WHERE n < 0.5 * full_) "
        "AS n_short, CASE WHEN count(*) FILTER (WHERE n < 0.5 * full_) > 0 THEN 'misaligned' ELSE 'aligned' END AS status FROM s JOIN m USING (file) GROUP BY "
        "file"
    )
def _a20(spark, d):  # noqa: ANN001, ANN202
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("file"), "user_id").agg(F.count("*").alias("n"))
    s = s.join(s.groupBy("file").agg(F.max("n").alias("most")), "file")
    short = F.count_if(F.col("n") < 0.5 * F.col("most"))
    return s.groupBy("file").agg(F.count("*").alias("n_channels"), F.count_if(F.col("n") == F.col("most")).alias("n_full"), short.alias("n_short"), F.when(short > 0, "misaligned").otherwise("aligned").alias("status"))


# --- contracts -----------------------------------------------------------------------------------------------------------

_D1_COLUMNS = [("documents", "doc_id"), ("documents", "text"), ("documents", "license"), ("labels", "toxic"), ("pages", "url"), ("benchmark", "answer")]
_D1_KEYS = [("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("conversations", "conv_id")]
_D1_TEXTS = [("documents", "text", "idiot"), ("pages", "html", "password"), ("benchmark", "text", "idiot")]


def _d1_sql() -> str:
    parts = []
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        checks = ["CASE WHEN count(*) = 0 THEN 'no rows' END"]
        checks += [f"CASE WHEN (SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}' AND column_name = '{c}') = 0 THEN 'missing column {c}' END" for n, c in _D1_COLUMNS if n == t]
        for n, k in _D1_KEYS:
            if n == t:
                checks += [f"CASE WHEN count(*) > count({k}) THEN 'null key {k}' END", f"CASE WHEN count({k}) > count(DISTINCT {k}) THEN 'repeated key {k}' END"]
        checks += [f"CASE WHEN count(*) FILTER (WHERE contains(lower({c}), '{p}')) > 0 THEN 'unsafe text {p}' END" for n, c, p in _D1_TEXTS if n == t]
        parts.append(f"SELECT '{t}' AS stage, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS e FROM {t}")
    return "SELECT stage, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, '; ') AS errors FROM (" + " UNION ALL ".join(parts) + ")"


@query("d1_contract_checks", _d1_sql())
def _d1(spark, d):  # noqa: ANN001, ANN202
    return ct.contract_checks({t: table(spark, d, t) for t in ("documents", "labels", "pages", "benchmark", "conversations")}, _D1_COLUMNS, _D1_KEYS, _D1_TEXTS)


_D2_SQL = """u AS (SELECT source, 'lang' AS col, lang AS v FROM documents UNION ALL SELECT source, 'parity', CASE WHEN source <> 'src1' THEN CAST(doc_id % 2 AS VARCHAR) END FROM documents UNION ALL SELECT source, 'shard', CAST(doc_id % 40 AS VARCHAR) FROM documents),
  p AS (SELECT source, col, count(DISTINCT v) AS n, string_agg(DISTINCT v, '|' ORDER BY v) AS vals FROM u GROUP BY ALL), c AS (SELECT * FROM p WHERE n BETWEEN 1 AND 20),
  g AS (SELECT s.source, count(c.col) AS n_candidates, min(c.col) AS first_col, count(*) FILTER (WHERE c.n = 2) AS n_binary, arg_min(c.vals, c.col) AS vals FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN c USING (source) GROUP BY s.source)"""


def _profiles(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents").select("source", "lang", F.when(F.col("source") != "src1", (F.col("doc_id") % 2).cast("string")).alias("parity"), (F.col("doc_id") % 40).cast("string").alias("shard"))
    u = docs.unpivot(["source"], ["lang", "parity", "shard"], "col", "v")
    return ct.label_profiles(u, "source", 20)


@query(
    "d2_contract_drafts",

            f"WITH {_D2_SQL} SELECT source, first_col AS explicit_label_column, CASE WHEN n_candidates = 0 THEN 'blocked_no_candidate_column' WHEN n_binary = 0 "
            f"THEN 'blocked_needs_explicit_mapping' ELSE 'inactive_review_required' END AS status, coalesce(vals, '') AS unresolved_values, concat_ws(';', CASE "
            f"WHEN n_candidates = 0 THEN 'explicit_label_column_required' END, CASE WHEN n_candidates > 1 THEN 'choose_label_column' END, CASE WHEN vals IS NOT "
            f"NULL THEN 'declare_positive_and_negative_values' END, 'verify_join_keys') AS blockers FROM g"
,
)
def _d2(spark, d):  # noqa: ANN001, ANN202
    return ct.contract_drafts(_profiles(spark, d), "source")


@query("d9_readiness_and_drafts",
        f"WITH {_D2_SQL} SELECT source, n_candidates, n_binary, CASE WHEN n_candidates = 0 THEN 'no_candidate_label_column' WHEN n_binary = 0 THEN "
        f"'needs_explicit_mapping' ELSE 'adapter_ready' END AS readiness, CASE WHEN n_candidates > 0 AND n_binary > 0 THEN 'draft for ' || source || ' on ' || "
        f"first_col END AS draft FROM g"
    )
def _d9(spark, d):  # noqa: ANN001, ANN202
    g = _profiles(spark, d)
    ready = F.when(F.col("n_candidates") == 0, "no_candidate_label_column").when(F.col("n_binary") == 0, "needs_explicit_mapping").otherwise("adapter_ready")
    return g.select("source", "n_candidates", "n_binary", ready.alias("readiness"), F.when((F.col("n_candidates") > 0) & (F.col("n_binary") > 0), F.concat(F.lit("draft for "), "source", F.lit(" on "), "first_col")).alias("draft"))


_D3_SQL = """dec AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_mktsegment END AS label_column, CASE WHEN c_custkey % 11 = 0 THEN 'O' ELSE 'F' END AS positive, 'O' AS negative, (['window', 'recording', 'subject', 'galaxy'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS scope, CASE WHEN c_custkey % 13 = 0 THEN 'Unknown' ELSE 'given' END AS provenance, c_comment_len FROM (SELECT *, c_custkey % 60 AS c_comment_len FROM customer)),
  seen AS (SELECT o_custkey AS c_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY ALL)"""


@query(
    "d3_declarations",

            f"WITH {_D3_SQL} SELECT c_custkey, concat_ws('; ', CASE WHEN trim(label_column) = '' THEN 'label column is empty' END, CASE WHEN positive = negative "
            f"THEN 'values overlap' END, CASE WHEN scope = 'galaxy' THEN 'unsupported scope' END, CASE WHEN lower(trim(provenance)) = 'unknown' THEN 'provenance is "
            f"unknown' END, CASE WHEN c_comment_len < 20 THEN 'justification is short' END) AS errors, CASE WHEN statuses IS NULL THEN 'no proposal' WHEN NOT "
            f"contains(statuses, positive) THEN 'positive value not in data' ELSE 'consistent' END AS cross_check FROM dec LEFT JOIN seen USING (c_custkey)"
,
)
def _d3(spark, d):  # noqa: ANN001, ANN202
    k = F.col("c_custkey")
    dec = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 17 == 0, " ").otherwise(F.col("c_mktsegment")).alias("label_column"), F.when(k % 11 == 0, "O").otherwise("F").alias("positive"), F.lit("O").alias("negative"),
        F.get(F.array(*[F.lit(s) for s in ("window", "recording", "subject", "galaxy")]), (k % 4).cast("int")).alias("scope"), F.when(k % 13 == 0, "Unknown").otherwise(F.lit("given")).alias("provenance"), (k % 60).alias("justified"),
    )
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("statuses"))
    errors = x.all_blockers(
        (F.trim("label_column") == "", "label column is empty"), (F.col("positive") == F.col("negative"), "values overlap"), (~F.col("scope").isin("window", "recording", "subject"), "unsupported scope"),
        (F.lower(F.trim("provenance")) == "unknown", "provenance is unknown"), (F.col("justified") < 20, "justification is short"),
    )
    cross = F.when(F.col("statuses").isNull(), "no proposal").when(~F.contains("statuses", "positive"), "positive value not in data").otherwise("consistent")
    return dec.join(seen, "c_custkey", "left").select("c_custkey", F.array_join(errors, "; ").alias("errors"), cross.alias("cross_check"))


_D4_SQL = f"""{_FILES_SQL}, st AS (SELECT source, count(*) AS n_files, count(DISTINCT stage) AS n_stages, count(*) FILTER (WHERE safety <> 'safe') AS n_unsafe, count(*) FILTER (WHERE stage = 'configs') AS n_contracts, count(*) FILTER (WHERE stage = 'metrics') AS n_metrics FROM f3 GROUP BY source), lb AS (SELECT source, count(*) AS n_labels, count(DISTINCT toxic) AS classes FROM labels JOIN documents USING (doc_id) GROUP BY source)"""


@query(
    "d4_execution_matrix",

            f"WITH {_D4_SQL} SELECT source, n_files > 0 AS has_data, n_contracts > 0 AS has_contract, n_metrics > 0 AS has_metrics, coalesce(classes, 0) = 2 AS "
            f"has_targets, CASE WHEN n_contracts = 0 THEN 'write contract' WHEN coalesce(n_labels, 0) = 0 THEN 'collect labels' WHEN classes < 2 THEN 'add the "
            f"other class' WHEN n_unsafe > 0.1 * n_files THEN 'review unsafe texts' WHEN n_metrics = 0 THEN 'compute metrics' ELSE 'run benchmark' END AS "
            f"next_action FROM st LEFT JOIN lb USING (source)"
,
)
def _d4(spark, d):  # noqa: ANN001, ANN202
    n = lambda c: F.count_if(c)
    st = _files(spark, d).groupBy("source").agg(F.count("*").alias("n_files"), n(F.col("safety") != "safe").alias("n_unsafe"), n(F.col("stage") == "configs").alias("n_contracts"), n(F.col("stage") == "metrics").alias("n_metrics"))
    lb = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_labels"), F.countDistinct("toxic").alias("classes"))
    j = st.join(lb, "source", "left").na.fill(0, ["n_labels", "classes"])
    action = x.first_blocker(
        (F.col("n_contracts") == 0, "write contract"), (F.col("n_labels") == 0, "collect labels"), (F.col("classes") < 2, "add the other class"), (F.col("n_unsafe") > 0.1 * F.col("n_files"), "review unsafe texts"),
        (F.col("n_metrics") == 0, "compute metrics"), otherwise="run benchmark",
    )
    return j.select("source", (F.col("n_files") > 0).alias("has_data"), (F.col("n_contracts") > 0).alias("has_contract"), (F.col("n_metrics") > 0).alias("has_metrics"), (F.col("classes") == 2).alias("has_targets"), action.alias("next_action"))


@query("d5_evidence_packet",
        f"WITH {_FILES_SQL} SELECT stage AS artifact_type, regexp_extract(path, '(\\.[a-z]+)$', 1) AS extension, count(*) AS n, "
        f"CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(DISTINCT sha256(text)) AS n_distinct, count(*) FILTER (WHERE safety = 'safe') AS "
        f"n_safe, min(path) AS first_path FROM f3 GROUP BY ALL"
    )
def _d5(spark, d):  # noqa: ANN001, ANN202
    g = _files(spark, d).groupBy(F.col("stage").alias("artifact_type"), F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("extension"))
    return g.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"), F.count_if(F.col("safety") == "safe").alias("n_safe"), F.min("path").alias("first_path"))


_D7_SQL = (
        "SELECT source, 'has_rows' AS check_name, count(*) >= 5 AS ok FROM documents GROUP BY source UNION ALL SELECT source, 'texts_filled', count(*) FILTER "
        "(WHERE coalesce(trim(text), '') = '') <= 0.1 * count(*) FROM documents GROUP BY source UNION ALL SELECT source, 'labels_cover', count(l.doc_id) >= "
        "0.2 * count(*) FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source UNION ALL SELECT source, 'two_classes', count(DISTINCT toxic) = 2 "
        "FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source UNION ALL SELECT source, 'sizes_agree', count(*) FILTER (WHERE n_chars <> "
        "length(text)) = 0 FROM documents GROUP BY source"
)


def _checks(spark, d):  # noqa: ANN001, ANN202
    la = table(spark, d, "labels").select("doc_id", "toxic", F.lit(1).alias("has"))
    n = F.count("*")
    g = table(spark, d, "documents").join(la, "doc_id", "left").groupBy("source").agg(
        (n >= 5).alias("has_rows"), (F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "") <= 0.1 * n).alias("texts_filled"), (F.count("has") >= 0.2 * n).alias("labels_cover"), (F.countDistinct("toxic") == 2).alias("two_classes"),
        (F.count_if(F.col("n_chars") != F.char_length("text")) == 0).alias("sizes_agree"),
    )
    return g.unpivot(["source"], ["has_rows", "texts_filled", "labels_cover", "two_classes", "sizes_agree"], "check_name", "ok")


@query("d7_inspections", _D7_SQL)
def _d7(spark, d):  # noqa: ANN001, ANN202
    return _checks(spark, d)


@query("d7_gate", f"WITH c AS ({_D7_SQL}) SELECT source, bool_and(ok) AS allowed, coalesce(string_agg(check_name, ';' ORDER BY check_name) FILTER (WHERE NOT ok), '') AS failed FROM c GROUP BY source")
def _d7b(spark, d):  # noqa: ANN001, ANN202
    return _checks(spark, d).groupBy("source").agg(F.bool_and("ok").alias("allowed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check_name")))), ";").alias("failed"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------


@query("s4_page_files",
        r"SELECT page_id, 'doc_' || sha256('page-' || page_id || '.md')[1:16] AS doc_key, coalesce(nullif(trim(url), ''), 'page-' || page_id) AS title, "
        r"len(regexp_extract_all(coalesce(html, ''), '<h[1-6][ >]')) AS n_headings, length(coalesce(html, '')) AS n_chars, CASE WHEN contains(url, '/en/') THEN "
        r"'english' WHEN contains(url, 'blog') THEN 'blog' ELSE 'other' END AS kind FROM pages"
    )
def _s4(spark, d):  # noqa: ANN001, ANN202
    path = shared_path(spark, "pages")
    body = F.concat(F.lit("# "), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), body.alias("text")).write.parquet(path)
    t = spark.read.parquet(path)  # the name and the whole text of each file: a few large files hold what would be one file each
    title = F.trim(F.regexp_extract("text", r"^# ([^\n]*)", 1))
    stem, html = F.regexp_extract("name", r"^(.*)\.md$", 1), F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1)
    kind = F.when(F.contains(title, F.lit("/en/")), "english").when(F.contains(title, F.lit("blog")), "blog").otherwise("other")
    return t.select(
        F.regexp_extract("name", r"page-([0-9]+)", 1).cast("long").alias("page_id"), x.stable_id(F.col("name"), prefix="doc_").alias("doc_key"), F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit("<h[1-6][ >]"), 0)).cast("long").alias("n_headings"), F.char_length(html).cast("long").alias("n_chars"), kind.alias("kind"),
    )


@query("s8_run_log",
        "SELECT 'run' AS kind, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL UNION ALL SELECT 'metric', event_type "
        "|| '.max', count(*), round(max(value), 4) FROM events GROUP BY event_type UNION ALL SELECT 'artifact', source, count(*), CAST(sum(n_chars) AS DOUBLE) "
        "FROM documents GROUP BY source UNION ALL SELECT 'sensor', CAST(user_id AS VARCHAR), count(*), round(sum(value), 4) FROM events GROUP BY user_id"
    )
def _s8(spark, d):  # noqa: ANN001, ANN202
    path, e = shared_path(spark, "runs"), table(spark, d, "events")
    log = lambda kind, df, name, total: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(kind).alias("kind"), "name", "n", "total")
    parts = [
        log("run", e, F.col("event_type"), rounded(F.sum("value"), 4)), log("metric", e, F.concat("event_type", F.lit(".max")), rounded(F.max("value"), 4)),
        log("artifact", table(spark, d, "documents"), F.col("source"), F.sum("n_chars").cast("double")), log("sensor", e, F.col("user_id").cast("string"), rounded(F.sum("value"), 4)),
    ]
    for p in parts:  # runs, metrics, artifacts and sensor records are appended to one log as they come
        p.write.mode("append").partitionBy("kind").parquet(path)
    return spark.read.schema("name string, n long, total double, kind string").parquet(path)


_TWO = "a AS (SELECT doc_id, lang AS v FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang || '!' ELSE lang END AS v FROM documents WHERE doc_id % 10 <> 5)"


@query("s9_upsert",
        f"WITH {_TWO} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS v, CASE WHEN b.doc_id IS NULL THEN 'untouched' WHEN a.doc_id IS NULL "
        f"THEN 'insert' WHEN a.v <> b.v THEN 'update' ELSE 'unchanged' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id"
    )
def _s9(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents")
    path = shared_path(spark, "upsert")
    docs.filter("doc_id % 10 <> 3").select("doc_id", F.col("lang").alias("v")).write.parquet(path)
    incoming = docs.filter("doc_id % 10 <> 5").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")).alias("v"))
    return checkpointed(ct.upsert(spark.read.parquet(path), incoming, "doc_id", "v"), "upserted")


@query("s10_resumed_batch",
        "SELECT user_id AS subject, count(*) AS n_rows, round(sum(value), 4) AS total, CASE WHEN count(*) < 50 THEN 'error: too few rows' ELSE 'done' END AS "
        "status, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM events GROUP BY user_id"
    )
def _s10(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "value")
    path = shared_path(spark, "batch")
    ct.run_batch(e.filter("subject % 3 = 0"), path, "subject", 50, 1)  # a first run that got through a third of the subjects
    ct.run_batch(e, path, "subject", 50, 2)  # the second one takes up the rest
    return spark.read.parquet(path).select("subject", "n_rows", rounded(F.col("total"), 4).alias("total"), "status", "run")


def _total_job(part):  # noqa: ANN001, ANN202
    if len(part) < 50:
        raise ValueError("too few rows")
    return {"total": part["value"].sum(), "spread": (part["value"] - part["value"].mean()).abs().max()}


@query("s10_isolated_jobs",
        "WITH u AS (SELECT user_id AS subject, count(*) AS n_rows, sum(value) AS total, max(abs(value - m)) AS spread FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id) "
        "SELECT subject, n_rows, CASE WHEN n_rows >= 50 THEN round(total, 4) END AS total, CASE WHEN n_rows >= 50 THEN round(spread, 2) END AS spread, CASE WHEN n_rows < 50 THEN 'error: too few rows' ELSE 'done' END AS status, run FROM u, (VALUES (1), (2)) t(run) "
        "WHERE CASE WHEN run = 1 THEN subject % 3 = 0 ELSE subject % 3 <> 0 OR n_rows < 50 END"
    )
def _s10b(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), "value")
    path = shared_path(spark, "jobs")
    for rows in (e.filter("subject % 3 = 0"), e):  # a first run saw a third of the subjects; failed ones are taken up again
        ct.run_jobs(rows, path, "subject", _total_job, ["total", "spread"])
    return spark.read.parquet(path).select("subject", "n_rows", rounded(F.col("total"), 4).alias("total"), rounded(F.col("spread"), 2).alias("spread"), "status", "run")


@query("s13_stage_inventory",
        "SELECT 'documents' AS stage, count(*) AS n_rows, count(*) FILTER (WHERE doc_id IS NULL OR text IS NULL) AS n_incomplete FROM documents UNION ALL "
        "SELECT 'labels', count(*), count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) FROM labels UNION ALL SELECT 'pages', count(*), count(*) FILTER "
        "(WHERE html IS NULL) FROM pages UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE ts IS NULL OR value IS NULL) FROM events"
    )
def _s13(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.sources.readers import checked

    out = None
    for stage, needed in {"documents": ["doc_id", "text"], "labels": ["quality", "toxic"], "pages": ["html"], "events": ["ts", "value"]}.items():
        df, lost = checked(table(spark, d, stage), needed), F.lit(False)
        for c in needed:
            lost = lost | F.col(c).isNull()
        row = df.agg(F.count("*").alias("n_rows"), F.count_if(lost).alias("n_incomplete")).select(F.lit(stage).alias("stage"), "n_rows", "n_incomplete")
        out = row if out is None else out.unionByName(row)
    return out


_ASOF_SQL = """probes AS (SELECT user_id, event_id, value AS rating, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase'),
  pr AS (SELECT * FROM probes WHERE p IS NOT NULL AND t - p >= 1)"""


@query(
    "j16_rated_epochs",

            f"WITH {_ASOF_SQL} SELECT pr.event_id, any_value(c_mktsegment) AS group_, round(any_value(rating), 6) AS rating, count(e.event_id) AS n, "
            f"round(avg(e.value), 6) AS mean_v FROM pr LEFT JOIN customer ON c_custkey = pr.user_id LEFT JOIN events e ON e.user_id = pr.user_id AND e.event_type = "
            f"'click' AND epoch(e.ts) > pr.p AND epoch(e.ts) <= pr.t GROUP BY pr.event_id"
,
)
def _j16(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    pr, clicks = rel.probe_epochs(e, "user_id", "t", F.col("event_type") == "purchase", F.col("event_type") == "click", "event_id", "value")
    group = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group_"))
    out = pr.join(group, "user_id", "left").join(clicks, "event_id", "left")
    return out.select("event_id", "group_", rounded(F.col("value")).alias("rating"), F.coalesce("n", F.lit(0)).alias("n"), rounded(F.col("total") / F.col("n")).alias("mean_v"))


_MARKED = "marked AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10))) AS line, generate_subscripts(string_split(CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10)), 1) AS line_no FROM documents)"


@query(
    "x6_new_line_hits",
    f"""WITH {_PHRASES}, {_MARKED}, d AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM marked),
    h AS (SELECT doc_id, line_no, phrase, line[1:240] AS excerpt FROM d JOIN phrases ON contains({_FLAT.replace('text', 'line')}, phrase) WHERE depth % 2 = 0 AND NOT starts_with(ltrim(line), '```') AND NOT regexp_matches(line, '^\\s*#'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, phrase, excerpt FROM h WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.doc_id % 20 = 1 AND m.line[1:240] = h.excerpt)""",
)
def _x6(spark, d):  # noqa: ANN001, ANN202
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", fenced.alias("text"))
    known = docs.filter("doc_id % 20 = 1").select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.substring("line", 1, 240).alias("excerpt"))  # findings that are known
    return rt.new_line_hits(docs, _phrases(spark, d), "doc_id", "text", known, r"^\s*#").withColumnRenamed("id", "doc_id").select("doc_id", "line_no", "phrase", "excerpt")
