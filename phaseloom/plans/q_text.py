"""Queries of the text, retrieval and contract operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import exprs as x
from phaseloom.operators import claim_graph as cg
from phaseloom.operators import claims as cm
from phaseloom.operators import contracts as ct
from phaseloom.operators import retrieval as rt
from phaseloom.plans.views import rounded, table, texts
from phaseloom.sources.readers import checkpointed

QUERIES = {}


def query(name: str, statement: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = (f, statement)
        return f

    return put


_FLAT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
#: Whole benchmark texts and each of their sentences, down to single letters.
_PHRASES = f"flat AS (SELECT {_FLAT} AS whole FROM benchmark), phrases AS (SELECT DISTINCT phrase FROM (SELECT whole AS phrase FROM flat UNION ALL SELECT trim(unnest(string_split(whole, '.'))) FROM flat) WHERE phrase <> '')"


def _phrases(spark, d):  # noqa: ANN001, ANN202
    whole = table(spark, d, "benchmark").select(x.collapse(F.col("text")).alias("whole"))
    sentences = whole.select(F.explode(F.split("whole", r"\.", -1)).alias("phrase")).select(F.trim("phrase").alias("phrase"))
    return whole.select(F.col("whole").alias("phrase")).unionByName(sentences).filter("phrase <> ''").distinct()


@query("x2_chunks",
        r"WITH c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1050) AS BIGINT) + 1 "
        r"END)) AS part FROM documents), s AS (SELECT doc_id, CAST(part AS INTEGER) AS part, regexp_replace(substring(text, part * 1050 + 1, 1200), "
        r"'^\s+|\s+$', '', 'g') AS chunk FROM c) SELECT doc_id, part, 'chk_' || sha256(doc_id || '|' || part)[1:16] AS chunk_id, length(chunk) AS n_chars FROM "
        r"s WHERE chunk <> ''"
    )
def _x2(spark, d):  # noqa: ANN001, ANN202
    c = rt.chunks(texts(spark, d), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "part", "chunk_id", F.char_length("chunk").cast("long").alias("n_chars"))


@query("x5_phrase_scan",
        f"WITH {_PHRASES}, t AS MATERIALIZED (SELECT doc_id, {_FLAT} AS flat FROM documents), h AS (SELECT doc_id, string_agg(phrase, ';' ORDER BY phrase) AS hits FROM t JOIN phrases ON contains(flat, phrase) GROUP "
        f"BY doc_id) SELECT d.doc_id, CASE WHEN hits IS NULL THEN 'clean' ELSE 'flagged' END AS status, coalesce(hits, '') AS hits FROM documents d LEFT JOIN h "
        f"USING (doc_id)"
    )
def _x5(spark, d):  # noqa: ANN001, ANN202
    s = rt.phrase_scan(texts(spark, d), _phrases(spark, d), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), "status", F.array_join("hits", ";").alias("hits"))


@query("x6_line_hits",
        f"WITH {_PHRASES}, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line "
        f"FROM documents), t AS MATERIALIZED (SELECT doc_id, line_no, line, {_FLAT.replace('text', 'line')} AS flat FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, phrase, line[1:240] AS excerpt FROM t JOIN phrases ON contains(flat, phrase)"
    )
def _x6(spark, d):  # noqa: ANN001, ANN202
    return rt.line_hits(texts(spark, d), _phrases(spark, d), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _has(text: str, words: list[str]) -> str:
    return f"len(list_filter({words!r}, lambda k: contains({text}, k))) > 0"


def _tier(k: int) -> str:
    value = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).lower()
    return "CASE " + " ".join(f"WHEN {_has('lower(line)', words)} THEN {value(result[k])}" for words, *result in cm.TIERS) + f" ELSE {value(cm.OTHERWISE[k])} END"


@query("x7_numbered_claims",
        r"WITH l AS (SELECT doc_id, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i, regexp_replace(unnest(string_split(replace(text, chr(13), ''), chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents), c AS (SELECT *, list_filter(["
        + ", ".join(f"CASE WHEN {_has('lower(line)', words)} THEN '{name}' END" for name, words in cm.CATEGORIES.items())
        + r"], lambda x: x IS NOT NULL) AS categories FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS claim_no FROM c WHERE len(categories) > 0) "
        r"SELECT doc_id, claim_no, doc_id || '_c' || CASE WHEN claim_no < 10000 THEN lpad(claim_no::VARCHAR, 4, '0') ELSE claim_no::VARCHAR END AS claim_id, sha256(lower(trim(regexp_replace(line, '\s+', ' ', 'g')))) AS claim_hash, array_to_string(categories, ',') AS categories, "
        f"{_tier(0)} AS tier, {_tier(1)} AS status, {_tier(2)} AS needs_rewrite, coalesce({_tier(3)}, '') AS flags FROM n"
    )
def _x7(spark, d):  # noqa: ANN001, ANN202
    c = cm.tiered(cm.claims(table(spark, d, "documents"), "doc_id", "text"))
    return c.select(F.col("id").alias("doc_id"), "claim_no", "claim_id", F.sha2("normalized", 256).alias("claim_hash"), F.array_join("categories", ",").alias("categories"), "tier", "status", "needs_rewrite", F.array_join("flags", ",").alias("flags"))


_TOK = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\wÀ-ɏ]+')"
_POSTS = (
    f"tok AS (SELECT doc_id, unnest(list_filter({_TOK}, lambda t: length(t) > 1)) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), "
    "posts AS (SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS dl FROM tf), nd AS (SELECT count(*) AS n FROM documents), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "

            "stats AS (SELECT term, df, ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) AS idf FROM dfs, nd), tot AS (SELECT sum(tf) AS total "
            "FROM tf), len_ AS (SELECT total / n AS avg_dl FROM tot, nd)"

)


@query("x8_corpus_statistics", f"WITH {_POSTS} SELECT term, df, round(idf, 6) AS idf FROM stats")
def _x8(spark, d):  # noqa: ANN001, ANN202
    docs = texts(spark, d)
    stats = rt.term_statistics(rt.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))
    return stats.select("term", "df", rounded(F.col("idf")).alias("idf"))


_QUERIES = (
        "q AS (SELECT conv_id AS query_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0 GROUP BY "
        "conv_id), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter("
 + _TOK + ", lambda t: length(t) > 1)) AS term FROM q) GROUP BY ALL)"
)
_SCORES = (
        f"WITH {_POSTS}, {_QUERIES}, s AS (SELECT query_id, doc_id, sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS "
        f"DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avg_dl))) AS score FROM posts JOIN qt USING (term) JOIN stats USING (term), len_ GROUP BY ALL), r AS (SELECT *, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s)"
)


def _questions(spark, d):  # noqa: ANN001, ANN202
    """The user's turns of every conversation whose id is divisible by 50."""
    c = table(spark, d, "conversations").filter("role = 'user' AND conv_id % 50 = 0")
    return c.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("text"))


def _bm25(spark, d):  # noqa: ANN001, ANN202
    s = rt.search(texts(spark, d), _questions(spark, d), "doc_id", "text", best=5)
    return rt.top_k(s.withColumn("by", F.round("score", 8)), "query_id", "by", "id", 5)


@query("x9_bm25_scores", f"{_SCORES} SELECT query_id, doc_id, round(score, 5) AS score FROM s")
def _x9(spark, d):  # noqa: ANN001, ANN202
    s = rt.search(texts(spark, d), _questions(spark, d), "doc_id", "text")
    return s.select("query_id", F.col("id").alias("doc_id"), rounded(F.col("score"), 5).alias("score"))


@query("t1_bm25_top_k", f"{_SCORES} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5 AND score > 0")
def _t1(spark, d):  # noqa: ANN001, ANN202
    return _bm25(spark, d).filter("score > 0").select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long"), rounded(F.col("score"), 5).alias("score"))


_LEVELS = range(1, 7)
_X1 = (
        r"WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[ >].*?</(script|style)>', ' ', 'g'), "
        r"'(?i)<h([1-6])([ >])', chr(1) || '\1\2', 'g'), chr(1)) AS parts FROM pages), s AS (SELECT page_id, generate_subscripts(parts, 1) - 1 AS section, "
        r"unnest(parts) AS part FROM p), t AS (SELECT page_id, section, CASE WHEN section > 0 THEN CAST(part[1:1] AS INTEGER) ELSE 0 END AS level, CASE WHEN "
        r"section > 0 THEN trim(regexp_replace(regexp_replace(regexp_extract(part, '(?is)^[1-6][^>]*>(.*?)</h', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) END "
        r"AS heading, trim(regexp_replace(regexp_replace(CASE WHEN section > 0 THEN regexp_extract(part, '(?is)</h[1-6]>(.*)$', 1) ELSE part END, '<[^>]*>', ' "
        r"', 'g'), '\s+', ' ', 'g')) AS body FROM s), w AS (SELECT *, "
     + ", ".join(
        f"max(CASE WHEN level = {k} THEN section END) OVER u AS p{k}, max(CASE WHEN level BETWEEN 1 AND {k} - 1 THEN section END) OVER u AS q{k}, "
        f"arg_max(heading, section) FILTER (WHERE level = {k}) OVER u AS h{k}"
     for k in _LEVELS) +
        " FROM t WINDOW u AS (PARTITION BY page_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT page_id AS id, CAST(section AS "
        "INTEGER) AS section, level, CASE WHEN level = 0 THEN '(root)' ELSE array_to_string(list_filter(["
     + ", ".join(f"CASE WHEN p{k} > coalesce(q{k}, 0) THEN h{k} END" for k in _LEVELS) + "], lambda x: x IS NOT NULL), ' > ') END AS heading_path, body FROM w WHERE body <> ''"
)

# Chunks of the sections of pages, each with the headings it lies under.
_CHUNKS = (
        f"sec AS ({_X1}), chunk AS (SELECT * FROM (SELECT id, section, heading_path, part, regexp_replace(substring(body, part * 1050 + 1, 1200), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT *, unnest(range(0, CASE WHEN length(body) <= 1200 THEN 1 ELSE "
        f"CAST(ceil((length(body) - 1200) / 1050) AS BIGINT) + 1 END)) AS part FROM sec)) WHERE text <> ''), piece AS MATERIALIZED (SELECT id || '/' || section || '/' || part AS doc_id, url AS source, CAST(id AS VARCHAR) AS path, heading_path, text, "
        f"'chk_' || sha256(id || '|' || section || '|' || heading_path || '|' || part)[1:16] AS chunk_id FROM chunk JOIN pages ON page_id = id)"
)
_PIECES = f"WITH {_CHUNKS}, {_SCORES.removeprefix('WITH ').replace('documents', 'piece')}, k AS (SELECT query_id, rank, piece.* FROM r JOIN piece USING (doc_id) WHERE rank <= 5 AND score > 0)"


def _retrieved(spark, d):  # noqa: ANN001, ANN202
    """The five best chunks of each question among the sections of all pages, with their texts and headings."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    c = rt.section_chunks(rt.heading_sections(table(spark, d, "pages"), "page_id", "html"), ["id", "section"]).join(pages, "id")
    c = checkpointed(c.select(F.concat_ws("/", "id", "section", "part").alias("doc_id"), F.col("url").alias("source"), F.col("id").cast("string").alias("path"), "heading_path", "chunk_id", "text"), "chunks")
    s = rt.search(c, _questions(spark, d), "doc_id", "text", best=5)
    best = rt.top_k(s.withColumn("by", F.round("score", 8)), "query_id", "by", "id", 5).filter("score > 0")
    best = checkpointed(best.select("query_id", "rank", F.col("id").alias("doc_id")), "best")
    return c.join(F.broadcast(best) if best.count() <= rt.SMALL else best, "doc_id")  # five rows a question


#: The line above each chunk of a prompt.
_HEADER = "--- [page] {source} | {heading_path} ---"
#: The system part of all prompts, and a template for each mode.
_SYSTEM = "You answer from the passages below.\nLabel every statement [Source] or [Inference].\nEnd every answer with a '## Sources used' section."
_MODES = {
    "explain": "Explain in plain words, step by step.\n\nQuestion: {question}\n\nPassages:\n{context}",
    "compare": "Compare what the passages say and name where they differ.\n\nPassages:\n{context}\n\nQuestion: {question}",
    "list": "Answer as a numbered list.\n\n{question}\n\n{context}",
}
_MODE = "CASE query_id // 50 % 3 WHEN 0 THEN 'explain' WHEN 1 THEN 'compare' ELSE 'list' END"
#: What a prompt of each mode must hold, and what the system part must not.
_MUST = {"explain": ["[Source]", "step by step"], "compare": ["differ", "[Inference]", "the"], "list": ["## Sources used", "numbered list", "certainty"]}
_MUST_NOT = ["guaranteed", "passages below"]
_USER = "CASE mode " + " ".join("WHEN '" + m + "' THEN '" + t.replace("'", "''").replace("{question}", "' || question || '").replace("{context}", "' || context || '") + "'" for m, t in _MODES.items()) + " END"
_CONTEXT = "string_agg('--- [page] ' || source || ' | ' || heading_path || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"


def _prompts(spark, d):  # noqa: ANN001, ANN202
    k = checkpointed(_retrieved(spark, d), "retrieved")
    n = k.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.countDistinct("source").alias("n_distinct"))
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (F.floor(F.col("query_id") / 50) % 3 + 1).cast("int"))
    q = _questions(spark, d).withColumnRenamed("text", "question").withColumn("mode", mode)
    return k, rt.chat_prompts(rt.context(k, "query_id", "rank", _HEADER, "text").join(n, "query_id").join(q, "query_id"), "mode", "question", "context", _SYSTEM, _MODES)


@query("x11_retrieval_coverage",
        f"{_PIECES}, c AS (SELECT query_id, count(*) AS retrieved, count(DISTINCT source) AS n_distinct, {_CONTEXT} AS context FROM k GROUP BY query_id), m AS (SELECT c.*, q.text AS question, {_MODE} AS mode FROM c JOIN q USING (query_id)), "
        f"u AS (SELECT *, '{_SYSTEM.replace(chr(39), chr(39) * 2)}' AS system, {_USER} AS user_ FROM m), f AS (SELECT query_id, mode, retrieved, n_distinct, length(system || chr(10) || user_) AS n_chars, list_concat("
        f"CASE WHEN retrieved < 5 THEN ['min_sources not met: need 5, got ' || retrieved] ELSE [] END, list_transform(list_filter(CASE mode "
        + " ".join(f"WHEN '{m}' THEN {t!r}" for m, t in _MUST.items())
        + f" END, lambda t: NOT contains(lower(system || chr(10) || user_), lower(t))), lambda t: 'missing ' || t), list_transform(list_filter({_MUST_NOT!r}, lambda t: contains(lower(system), lower(t))), lambda t: 'forbidden ' || t)) AS failures FROM u) "
        "SELECT query_id, mode, retrieved, n_distinct, n_chars, array_to_string(failures, '; ') AS failures, len(failures) = 0 AS passed FROM f"
    )
def _x11(spark, d):  # noqa: ANN001, ANN202
    _, p = _prompts(spark, d)
    must = F.element_at(F.create_map(*(y for m, t in _MUST.items() for y in (F.lit(m), F.array(*map(F.lit, t))))), F.col("mode"))
    p = p.withColumn("min_sources", F.lit(5)).withColumn("must", must).withColumn("must_not", F.array(*map(F.lit, _MUST_NOT)))
    c = rt.prompt_checks(p, "retrieved", "min_sources", "must", "must_not")
    n_chars = F.char_length(F.concat("system", F.lit("\n"), "user")).cast("long")
    return c.select("query_id", "mode", "retrieved", "n_distinct", n_chars.alias("n_chars"), F.array_join("failures", "; ").alias("failures"), "passed")


@query("x12_context",
        f"{_PIECES}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, path ORDER BY rank) = 1 AS first_ FROM k) SELECT query_id, {_CONTEXT} AS context, '## Sources used' || chr(10) || string_agg(CASE WHEN first_ THEN "
        f"'- **' || source || '** (`' || path || '`)' || chr(10) ELSE '' END || '  - chunk `' || chunk_id || '` — ' || heading_path, chr(10) ORDER BY rank) AS sources FROM l GROUP BY query_id"
    )
def _x12(spark, d):  # noqa: ANN001, ANN202
    k, _ = _prompts(spark, d)
    return rt.context(k, "query_id", "rank", _HEADER, "text").join(rt.source_list(k, "query_id", "rank"), "query_id")


@query("x10_cosine",
        "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id, "
        "round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) + 0.0 AS similarity FROM embeddings, q"
    )
def _x10(spark, d):  # noqa: ANN001, ANN202
    s = rt.cosine_scores(table(spark, d, "embeddings"), "vec_id", "embedding", "vec_id % 50 = 0")
    return s.select("query_id", "vec_id", rounded(F.col("similarity"), 5).alias("similarity"))


@query("t2_cosine_top_k",
        "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, "
        "round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS s FROM embeddings, q WHERE vec_id <> query_id), r AS (SELECT *, "
        "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, s AS similarity FROM r WHERE rank <= "
        "10"
    )
def _t2(spark, d):  # noqa: ANN001, ANN202
    s = rt.cosine_scores(table(spark, d, "embeddings"), "vec_id", "embedding", "vec_id % 50 = 0", best=10, digits=6)
    s = s.filter("vec_id <> query_id").select("query_id", "vec_id", F.round("similarity", 6).alias("s"))
    return rt.top_k(s, "query_id", "s", "vec_id", 10).select("query_id", "vec_id", F.col("rank").cast("long"), F.col("s").alias("similarity"))


@query("x1_heading_sections", _X1)
def _x1(spark, d):  # noqa: ANN001, ANN202
    return rt.heading_sections(table(spark, d, "pages"), "page_id", "html")


@query("x3_artifact_manifest",
        "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, n_chars AS size, sha256(text) AS sha256, CASE WHEN n_chars > 5000 THEN "
        "'large' WHEN n_chars > 500 THEN 'medium' ELSE 'small' END AS class, CASE WHEN text LIKE '%@%' THEN 'review' ELSE 'index' END AS action FROM documents"
    )
def _x3(spark, d):  # noqa: ANN001, ANN202
    return ct.manifest(table(spark, d, "documents"))


@query("x13_source_registry",
        "SELECT source, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_distinct, CAST(sum(n_chars) AS BIGINT) AS n_chars, bool_or(text LIKE '%idiot%') "
        "AS flagged FROM documents GROUP BY source"
    )
def _x13(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"), F.sum("n_chars").alias("n_chars"), F.bool_or(F.contains("text", F.lit("idiot"))).alias("flagged"))


_TWO = (
        "a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') "
        "ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 5)"
)


def _two(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents")
    a = docs.filter("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("h"))
    b = docs.filter("doc_id % 10 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return a, b


@query("x14_sync_plan",
        f"WITH {_TWO} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'delete' WHEN a.doc_id IS NULL THEN 'add' WHEN a.h <> b.h "
        f"THEN 'change' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id"
    )
def _x14(spark, d):  # noqa: ANN001, ANN202
    return ct.sync_plan(*_two(spark, d), "doc_id", "h", {"left": "delete", "right": "add", "changed": "change", "same": "keep"})


@query("s9_upsert_plan",
        f"WITH {_TWO} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'untouched' WHEN a.doc_id IS NULL THEN 'insert' WHEN a.h "
        f"<> b.h THEN 'update' ELSE 'unchanged' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id"
    )
def _s9(spark, d):  # noqa: ANN001, ANN202
    return ct.sync_plan(*_two(spark, d), "doc_id", "h", {"left": "untouched", "right": "insert", "changed": "update", "same": "unchanged"})


@query("s10_resumable_batch",
        "SELECT user_id AS subject_id, count(*) AS n_rows, CASE WHEN count(*) < 50 THEN 'error: too few rows' ELSE 'done' END AS status FROM events WHERE "
        "user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90) GROUP BY user_id"
    )
def _s10(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").withColumnRenamed("user_id", "subject_id")
    done = e.filter("event_type = 'signup' AND value > 90").select("subject_id")
    return ct.resume(e, done, "subject_id", 50)


@query("x15_triggers",
        r"SELECT doc_id, regexp_matches(lower(text), '(license|copyright|https?://)') AS triggered, CAST(len(regexp_extract_all(text, 'https?://[^\s)]+')) AS "
        r"INTEGER) AS n_links FROM documents"
    )
def _x15(spark, d):  # noqa: ANN001, ANN202
    t = F.coalesce("text", F.lit(""))
    return texts(spark, d).select("doc_id", F.rlike(F.lower(t), F.lit("(license|copyright|https?://)")).alias("triggered"), F.size(F.regexp_extract_all(t, F.lit(r"https?://[^\s)]+"), 0)).alias("n_links"))


@query("x4_ingestion_pack",
        r"WITH c AS (SELECT doc_id, source, lang, text, unnest(range(0, CASE WHEN length(text) <= 1800 THEN 1 ELSE CAST(ceil((length(text) - 1800) / 1600) AS "
        r"BIGINT) + 1 END)) AS part FROM documents), s AS (SELECT doc_id, source, lang, part, regexp_replace(substring(text, part * 1600 + 1, 1800), "
        r"'^\s+|\s+$', '', 'g') AS chunk FROM c) SELECT source, count(*) AS n_chunks, count(*) FILTER (WHERE length(chunk) >= 100) AS n_included, count(*) "
        r"FILTER (WHERE length(chunk) < 100) AS n_withheld, count(DISTINCT lang) AS n_tags FROM s WHERE chunk <> '' GROUP BY source"
    )
def _x4(spark, d):  # noqa: ANN001, ANN202
    docs = texts(spark, d)
    c = rt.chunks(docs, "doc_id", "text", 1800, 200).join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    size = F.char_length("chunk")
    return c.groupBy("source").agg(F.count("*").alias("n_chunks"), F.count_if(size >= 100).alias("n_included"), F.count_if(size < 100).alias("n_withheld"), F.countDistinct("lang").alias("n_tags"))


@query("d1_stage_contracts",
        "WITH r AS (SELECT * FROM (VALUES ('documents', 'doc_id'), ('documents', 'text'), ('documents', 'license'), ('labels', 'quality'), ('labels', "
        "'toxic')) t(stage, col)), p AS (SELECT table_name AS stage, column_name AS col FROM duckdb_columns() WHERE table_name IN ('documents', 'labels')) "
        "SELECT r.stage, count(*) AS n_required, count(*) FILTER (WHERE p.col IS NULL) AS n_missing, CASE WHEN count(*) FILTER (WHERE p.col IS NULL) = 0 THEN "
        "'ok' ELSE 'error' END AS status FROM r LEFT JOIN p ON p.stage = r.stage AND p.col = r.col GROUP BY r.stage"
    )
def _d1(spark, d):  # noqa: ANN001, ANN202
    required = [("documents", "doc_id"), ("documents", "text"), ("documents", "license"), ("labels", "quality"), ("labels", "toxic")]
    return ct.stage_contracts(spark, {t: table(spark, d, t) for t in ("documents", "labels")}, required)


@query("d2_contract_draft",
        "WITH g AS (SELECT source, count(DISTINCT lang) AS n, min(lang) AS lo, max(lang) AS hi FROM documents GROUP BY source) SELECT source, n AS n_values, "
        "CASE WHEN n = 2 THEN 'ready' WHEN n = 1 THEN 'blocked: one value' ELSE 'needs_review' END AS status, lo AS first_value FROM g"
    )
def _d2(spark, d):  # noqa: ANN001, ANN202
    g = table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n_values"), F.min("lang").alias("first_value"))
    return g.withColumn("status", F.when(F.col("n_values") == 2, "ready").when(F.col("n_values") == 1, "blocked: one value").otherwise("needs_review"))


@query("d3_cross_check",
        "SELECT n_nationkey, CASE WHEN n_regionkey <> n_nationkey % 5 THEN 'mismatch' ELSE 'ok' END AS status, coalesce(c.n, 0) AS n_customers FROM nation "
        "LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey"
    )
def _d3(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = table(spark, d, "nation").join(c, "n_nationkey", "left")
    return n.select("n_nationkey", F.when(F.col("n_regionkey") != F.col("n_nationkey") % 5, "mismatch").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n_customers"))


@query("d4_readiness_matrix",
        "WITH g AS (SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labels, count(DISTINCT lang) AS n_langs FROM documents LEFT JOIN labels l USING "
        "(doc_id) GROUP BY source) SELECT source, n_docs, n_labels, CASE WHEN n_labels = 0 THEN 'collect labels' WHEN n_langs < 2 THEN 'add languages' WHEN "
        "n_docs < 20 THEN 'add documents' ELSE 'run benchmark' END AS next_action FROM g"
    )
def _d4(spark, d):  # noqa: ANN001, ANN202
    la = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    g = table(spark, d, "documents").join(la, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("has").alias("n_labels"), F.countDistinct("lang").alias("n_langs"))
    return g.select("source", "n_docs", "n_labels", x.first_blocker((F.col("n_labels") == 0, "collect labels"), (F.col("n_langs") < 2, "add languages"), (F.col("n_docs") < 20, "add documents"), otherwise="run benchmark").alias("next_action"))


@query("d5_evidence_counts", "SELECT p_brand AS artifact_type, count(*) AS n, round(sum(p_retailprice), 2) AS total, max(p_size) AS largest FROM part GROUP BY ALL")
def _d5(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("artifact_type")).agg(F.count("*").alias("n"), rounded(F.sum("p_retailprice"), 2).alias("total"), F.max("p_size").alias("largest"))


# Rule tables of the claim graph. Subjects are parts; their evidence is named by the line numbers of their larger items.
_EVIDENCE = ["labels", "metrics", "nulls", "ablations", "leakage", "artifacts", "mechanism"]
_SCOPES = [("runtime", 0, False), ("marker", 1, True), ("residual", 2, True), ("consistency", 3, True), ("mechanism", 4, True), ("candidate", 5, True)]
_NEEDS = [("marker", "labels"), ("marker", "metrics"), *(("residual", e) for e in _EVIDENCE[:6]), ("consistency", "metrics"), *(("mechanism", e) for e in _EVIDENCE), *(("candidate", e) for e in (*_EVIDENCE, "replication", "review"))]
_BRIDGES = [
    ("B1", "runtime", "marker", True, False, False), ("B2", "marker", "residual", True, False, False), ("B3", "residual", "mechanism", True, True, False), ("B4", "mechanism", "candidate", True, True, False),
    ("B5", "residual", "candidate", True, False, True), ("B6", "marker", "consistency", False, False, False), ("B7", "consistency", "mechanism", True, False, False),
]
_BRIDGE_NEEDS = [("B1", "labels"), ("B2", "nulls"), ("B2", "leakage"), ("B3", "mechanism"), ("B4", "replication"), ("B6", "metrics"), ("B7", "mechanism"), ("B7", "replication")]
_GRAPH = (
    f"subject AS (SELECT p_partkey, p_partkey % 10 = 0 AS mock FROM part), have AS (SELECT DISTINCT l_partkey AS p_partkey, ({_EVIDENCE!r})[l_linenumber] AS evidence FROM lineitem WHERE l_quantity >= 15 UNION SELECT p_partkey, 'replication' FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, 'review' FROM part WHERE p_partkey % 4 <> 0), "
    + ", ".join(f"{name} AS (SELECT * FROM (VALUES {', '.join(map(str, rows))}) t({columns}))" for name, columns, rows in (("scopes", "scope, level, needs_real", _SCOPES), ("needs", "scope, evidence", _NEEDS), ("bridges", "bridge, source, target, needs_real, needs_review, quarantined", _BRIDGES), ("bridge_needs", "bridge, evidence", _BRIDGE_NEEDS)))
    + """, bm AS (SELECT s.p_partkey, mock, b.*, list_sort(coalesce(list(n.evidence) FILTER (WHERE n.evidence IS NOT NULL AND h.evidence IS NULL), [])) AS missing FROM subject s CROSS JOIN bridges b LEFT JOIN bridge_needs n USING (bridge) LEFT JOIN have h ON h.p_partkey = s.p_partkey AND h.evidence = n.evidence GROUP BY ALL),
    status AS (SELECT bm.*, CASE WHEN quarantined THEN 'quarantined' WHEN mock AND needs_real THEN 'blocked_pending_real_execution' WHEN len(missing) > 0 THEN 'blocked_pending_evidence' WHEN needs_review AND r.evidence IS NULL THEN 'blocked_pending_review' ELSE 'promotable' END AS status FROM bm LEFT JOIN have r ON r.p_partkey = bm.p_partkey AND r.evidence = 'review')"""
)


def _claim_graph(spark, d):  # noqa: ANN001, ANN202
    k = F.col("p_partkey")
    subjects = table(spark, d, "part").select("p_partkey", (k % 10 == 0).alias("mock"))
    items = table(spark, d, "lineitem").filter("l_quantity >= 15").select(F.col("l_partkey").alias("p_partkey"), F.get(F.array(*map(F.lit, _EVIDENCE)), F.col("l_linenumber") - 1).alias("evidence"))
    have = items.unionByName(subjects.filter(k % 3 == 0).select("p_partkey", F.lit("replication").alias("evidence"))).unionByName(subjects.filter(k % 4 != 0).select("p_partkey", F.lit("review").alias("evidence")))
    rules = [
        spark.createDataFrame(_SCOPES, "scope string, level int, needs_real boolean"), spark.createDataFrame(_NEEDS, "scope string, evidence string"),
        spark.createDataFrame(_BRIDGES, "bridge string, source string, target string, needs_real boolean, needs_review boolean, quarantined boolean"), spark.createDataFrame(_BRIDGE_NEEDS, "bridge string, evidence string"),
    ]
    return subjects, checkpointed(have.distinct(), "evidence"), rules


@query("d6_claim_matrix",
        f"""WITH RECURSIVE {_GRAPH}, m AS (SELECT p_partkey, scope, level, list_concat(CASE WHEN mock AND needs_real THEN ['real_execution'] ELSE [] END, missing) AS blockers FROM (SELECT s.p_partkey, mock, c.*, list_sort(coalesce(list(n.evidence) FILTER (WHERE n.evidence IS NOT NULL AND h.evidence IS NULL), [])) AS missing
        FROM subject s CROSS JOIN scopes c LEFT JOIN needs n USING (scope) LEFT JOIN have h ON h.p_partkey = s.p_partkey AND h.evidence = n.evidence GROUP BY ALL)),
        reach AS (SELECT p_partkey, scope FROM m WHERE scope = 'runtime' AND len(blockers) = 0 UNION SELECT r.p_partkey, t.target FROM reach r JOIN status t ON t.p_partkey = r.p_partkey AND t.source = r.scope AND t.status = 'promotable' JOIN m ON m.p_partkey = r.p_partkey AND m.scope = t.target AND len(m.blockers) = 0),
        best AS (SELECT p_partkey, arg_max(scope, level) AS max_scope FROM reach JOIN scopes USING (scope) GROUP BY p_partkey),
        e AS (SELECT p_partkey, coalesce(list(evidence) FILTER (WHERE evidence IS NOT NULL), []) AS e FROM subject LEFT JOIN have USING (p_partkey) GROUP BY p_partkey),
        p AS (SELECT p_partkey, CASE WHEN mock THEN 'engineering_validated' WHEN NOT list_contains(e, 'labels') THEN 'blocked_pending_real_execution' WHEN NOT list_has_all(e, ['nulls', 'ablations', 'leakage', 'artifacts']) THEN 'blocked_pending_controls' WHEN NOT list_contains(e, 'review') THEN 'blocked_pending_review'
        WHEN list_has_all(e, ['mechanism', 'replication']) THEN 'mechanism_candidate' ELSE 'empirical_candidate' END AS promotion_state FROM subject JOIN e USING (p_partkey))
        SELECT m.p_partkey, m.scope, len(blockers) = 0 AS allowed, r.scope IS NOT NULL AS reached, array_to_string(blockers, ';') AS blockers, max_scope, promotion_state FROM m LEFT JOIN reach r ON r.p_partkey = m.p_partkey AND r.scope = m.scope LEFT JOIN best ON best.p_partkey = m.p_partkey JOIN p ON p.p_partkey = m.p_partkey"""
    )
def _d6(spark, d):  # noqa: ANN001, ANN202
    subjects, have, (scopes, needs, bridges, bridge_needs) = _claim_graph(spark, d)
    m = cg.claim_matrix(subjects, "p_partkey", have, scopes, needs, cg.bridge_statuses(subjects, "p_partkey", have, bridges, bridge_needs), "runtime")
    state = cg.promotion_state(subjects, "p_partkey", have, "labels", ["nulls", "ablations", "leakage", "artifacts"], "mechanism", "replication")
    return m.withColumn("blockers", F.array_join("blockers", ";")).join(state, "p_partkey")


@query("d6_bridges", f"WITH {_GRAPH} SELECT p_partkey, bridge, source, target, status, array_to_string(missing, ';') AS missing FROM status")
def _d6b(spark, d):  # noqa: ANN001, ANN202
    subjects, have, (_, _, bridges, bridge_needs) = _claim_graph(spark, d)
    return cg.bridge_statuses(subjects, "p_partkey", have, bridges, bridge_needs).withColumn("missing", F.array_join("missing", ";"))


@query("d7_check_table",
        "SELECT 'rows' AS check_name, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT doc_id) FROM documents UNION "
        "ALL SELECT 'no_null_text', count(*) FILTER (WHERE text IS NULL) = 0 FROM documents"
    )
def _d7(spark, d):  # noqa: ANN001, ANN202
    docs = table(spark, d, "documents")
    a = docs.agg((F.count("*") > 0).alias("rows"), (F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"), (F.count_if(F.col("text").isNull()) == 0).alias("no_null_text"))
    return a.unpivot([], ["rows", "unique_ids", "no_null_text"], "check_name", "ok")


@query("f8_titles", r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INTEGER) AS n_headings FROM pages")
def _f8(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<h[1-6][ >]"), 0)).alias("n_headings"))


@query("f14_phrase_array", "SELECT doc_id, array_to_string(list_filter(['idiot', 'scum', 'trash'], lambda p: contains(" + _FLAT + ", p)), ';') AS hits FROM documents")
def _f14(spark, d):  # noqa: ANN001, ANN202
    return texts(spark, d).select("doc_id", F.array_join(x.phrase_hits(F.coalesce("text", F.lit("")), ["idiot", "scum", "trash"]), ";").alias("hits"))


@query("f12_response_scores",
        r"SELECT conv_id, turn, round(len(list_filter(string_split(text, '.'), lambda s: contains(lower(s), 'the'))) / len(string_split(text, '.')), 6) AS "
        r"labelled_share FROM conversations WHERE role = 'assistant'"
    )
def _f12(spark, d):  # noqa: ANN001, ANN202
    s = F.split("text", r"\.", -1)
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", rounded(F.size(F.filter(s, lambda p: F.contains(F.lower(p), F.lit("the")))) / F.size(s)).alias("labelled_share"))


_DIAGRAM = (
        "diagram AS (SELECT p_brand AS id, p_size % 2 AS dim, p_retailprice / 1000 AS birth, CASE WHEN p_partkey % 97 = 0 THEN CAST('inf' AS DOUBLE) ELSE "
        "p_retailprice / 1000 + p_size / 50 END AS death FROM part)"
)


def _diagram(spark, d):  # noqa: ANN001, ANN202
    death = F.when(F.col("p_partkey") % 97 == 0, float("inf")).otherwise(F.col("p_retailprice") / 1000 + F.col("p_size") / 50)
    return table(spark, d, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") % 2).alias("dim"), (F.col("p_retailprice") / 1000).alias("birth"), death.alias("death"))


@query("g11_betti_curve",
        f"WITH {_DIAGRAM} SELECT id, dim, CAST(g AS INTEGER) AS g, count(*) FILTER (WHERE birth <= 0.8 + g * 0.1 AND death > 0.8 + g * 0.1) AS alive FROM "
        f"diagram, range(0, 20) r(g) GROUP BY ALL"
    )
def _g11(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.operators.diagrams import betti_curve

    return betti_curve(_diagram(spark, d), ["id", "dim"], 0.8, 0.1, 20)


@query("g12_diagram_summary",
        f"WITH {_DIAGRAM} SELECT id, dim, count(*) AS n_bars, count(*) FILTER (WHERE isinf(death)) AS n_open, round(sum(death - birth) FILTER (WHERE NOT "
        f"isinf(death)), 6) AS total_persistence, round(avg(death - birth) FILTER (WHERE NOT isinf(death)), 6) AS mean_lifetime FROM diagram GROUP BY ALL"
    )
def _g12(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.operators.diagrams import summary

    s = summary(_diagram(spark, d), ["id", "dim"])
    return s.select("id", "dim", "n_bars", "n_open", rounded(F.col("total_persistence")).alias("total_persistence"), rounded(F.col("mean_lifetime")).alias("mean_lifetime"))


@query("g11_landscape",
        f"WITH {_DIAGRAM}, t AS (SELECT id, dim, CAST(g AS INTEGER) AS g, greatest(0, least(0.8 + g * 0.1 - birth, death - (0.8 + g * 0.1))) AS tent FROM "
        f"diagram, range(0, 20) r(g)), k AS (SELECT *, row_number() OVER (PARTITION BY id, dim, g ORDER BY tent DESC) AS layer FROM t) SELECT id, dim, g, "
        f"CAST(layer AS INTEGER) AS layer, round(tent, 6) AS height FROM k WHERE layer <= 2"
    )
def _g11b(spark, d):  # noqa: ANN001, ANN202
    from phaseloom.operators.diagrams import landscape

    return landscape(_diagram(spark, d), ["id", "dim"], 0.8, 0.1, 20, 2).withColumn("height", rounded(F.col("height")))


_ = W
