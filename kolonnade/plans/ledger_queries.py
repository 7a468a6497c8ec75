"""Queries on vectors, proposals, ledger and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kolonnade.operators import ledger, lexical, proposals, vectors
from kolonnade.plans import columns as C
from kolonnade.plans.core_queries import _BLANKS, query
from kolonnade.plans.profile_queries import ALL, _collisions
from kolonnade.session import table

VEC = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.id AS q, c.id AS c, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM e q JOIN e c ON q.id <> c.id WHERE q.id % 100 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM s)"""


def _search(spark, d, k=None, floor=None):
    every = vectors.usable(table(spark, d, "embeddings"), "vec_id", "embedding")
    return vectors.search(every.where("id % 100 = 0"), every, k, floor)


@query("vector_topk", f"{VEC} SELECT * FROM rk WHERE rank <= 5")
def vector_topk(spark, d):
    return _search(spark, d, k=5).select("q", "c", "cosine", F.col("rank").cast("long").alias("rank"))


@query("vector_threshold_pairs", f"{VEC} SELECT least(q, c) AS l, greatest(q, c) AS r, max(cosine) AS cosine FROM rk WHERE cosine >= 0.3 GROUP BY 1, 2")
def vector_threshold_pairs(spark, d):
    return vectors.symmetric(_search(spark, d, floor=0.3)).drop("rank")


@query("vector_hybrid_pairs", f"{VEC} SELECT q, c, cosine, rank FROM rk WHERE rank <= 10 AND cosine >= 0.25")
def vector_hybrid_pairs(spark, d):
    return vectors.hybrid(_search(spark, d, k=10), 10, 0.25).select("q", "c", "cosine", F.col("rank").cast("long").alias("rank"))


@query("vector_norms", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.norm(F.col("embedding").cast("array<double>")), 6).alias("norm"))


_T = r"nullif(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), '')"
DOCS = rf"""WITH r AS (SELECT DISTINCT db_id, column_ref, tab, col, descriptive_name, column_description FROM column_profiles WHERE column_ref IS NOT NULL),
docs AS (SELECT DISTINCT db_id, column_ref AS column_id, 'rich' AS view, concat_ws(chr(10), 'table name: ' || {_T.format("tab")}, 'column name: ' || {_T.format("col")}, 'column descriptive name: ' || {_T.format("descriptive_name")}, 'column description: ' || {_T.format("column_description")}) AS text FROM r
UNION SELECT db_id, column_ref, 'descriptive_name', coalesce({_T.format("descriptive_name")}, '') FROM r UNION SELECT db_id, column_ref, 'surface_name', coalesce({_T.format("col")}, '') FROM r)"""


@query("embedding_docs", f"{DOCS} SELECT db_id, column_id, view, text, sha256(text) AS digest FROM docs")
def embedding_docs(spark, d):
    return vectors.embedding_documents(table(spark, d, "column_profiles"))


@query(
    "embedding_audit",
    f"""{DOCS}, tw AS (SELECT view, count(*) FILTER (WHERE n > 1) AS n_duplicate_ids FROM (SELECT view, db_id, column_id, count(*) AS n FROM docs GROUP BY ALL) GROUP BY view)
SELECT view, count(*) AS n, count(*) FILTER (WHERE text = '') AS n_empty, any_value(n_duplicate_ids) AS n_duplicate_ids, count(*) FILTER (WHERE contains(lower(text), 'value:') OR contains(lower(text), 'sample:')) AS n_forbidden, count(*) FILTER (WHERE length(text) > 2000) AS n_long, max(length(text)) AS max_length FROM docs JOIN tw USING (view) GROUP BY view""",
)
def embedding_audit(spark, d):
    return vectors.audit(vectors.embedding_documents(table(spark, d, "column_profiles"))).withColumn("max_length", F.col("max_length").cast("long"))


CACHE = """k AS (SELECT DISTINCT db_id, column_id FROM column_vectors WHERE record_version = 'v3' AND embedding_view = 'schema_semantic' AND embedding IS NOT NULL)"""


def _cache(spark, d):
    return table(spark, d, "column_vectors").where("record_version = 'v3' and embedding_view = 'schema_semantic' and embedding is not null")


@query("embedding_cache_missing", f"{DOCS}, {CACHE} SELECT db_id, column_id, sha256(text) AS digest FROM docs WHERE view = 'rich' AND NOT EXISTS (SELECT 1 FROM k WHERE k.db_id = docs.db_id AND k.column_id = docs.column_id)")
def embedding_cache_missing(spark, d):
    docs = vectors.embedding_documents(table(spark, d, "column_profiles")).where("view = 'rich'")
    return vectors.missing_from_cache(docs, _cache(spark, d), ("db_id", "column_id")).select("db_id", "column_id", "digest")


@query("embedding_cache_valid", f"{DOCS}, {CACHE} SELECT c.db_id, c.column_id, max(vec_id) AS vec_id FROM column_vectors c WHERE record_version = 'v3' AND embedding_view = 'schema_semantic' AND embedding IS NOT NULL AND EXISTS (SELECT 1 FROM docs d WHERE d.db_id = c.db_id AND d.column_id = c.column_id) GROUP BY ALL")
def embedding_cache_valid(spark, d):
    docs = vectors.embedding_documents(table(spark, d, "column_profiles"))
    return vectors.valid_cache(_cache(spark, d), ("db_id", "column_id"), docs).select("db_id", "column_id", "vec_id")


# -- proposals ---------------------------------------------------------------------------------------

LEXT = r"""lt0 AS (SELECT ref, tab, list_distinct(list_transform(regexp_extract_all(regexp_replace(col, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z]+|[0-9]+'), lambda x: lower(x))) AS ts FROM cols),
lt1 AS (SELECT a.ref AS l, b.ref AS r, len(list_intersect(a.ts, b.ts)) AS i, len(a.ts) AS n, len(b.ts) AS m FROM lt0 a JOIN lt0 b ON a.ref < b.ref),
lx AS (SELECT l, r, i / (n + m - i) AS s FROM lt1 WHERE i > 0),
pr AS (SELECT 'lexical' AS channel, 1 AS o, l, r, round(s, 6) AS score FROM lx UNION ALL SELECT 'value_collision', 4, l, r, overlap FROM co)"""
BUN = """SELECT 'cand_' || lpad(CAST(row_number() OVER (ORDER BY l, r) AS VARCHAR), 6, '0') AS candidate_id, row_number() OVER (ORDER BY l, r) AS queue_position, l, r, count(*) AS n_proposals, string_agg(channel, ',' ORDER BY o) AS channels, round(max(score), 6) AS best_score FROM {0} GROUP BY l, r"""


def _proposals(spark, d):
    p = lexical.profiles(C.columns(spark, d).withColumn("db_id", F.lit(C.DB)))
    lex = lexical.scored(lexical.token_pairs(p), p).withColumn("candidate_id", F.concat("l", F.lit("|"), "r"))
    return proposals.united([proposals.channel(lex, "lexical", "token_jaccard"), proposals.channel(_collisions(spark, d), "value_collision", "overlap")])


@query("proposal_union", f"{ALL}, {LEXT} {BUN.format('pr')}")
def proposal_union(spark, d):
    return proposals.bundles(_proposals(spark, d)).withColumn("queue_position", F.col("queue_position").cast("long"))


@query("proposal_ablation", f"{ALL}, {LEXT} {BUN.format('''(SELECT * FROM pr WHERE channel <> 'lexical')''')}")
def proposal_ablation(spark, d):
    return proposals.bundles(proposals.without_view(_proposals(spark, d), "surface")).withColumn("queue_position", F.col("queue_position").cast("long"))


@query("proposal_context", f"{ALL} SELECT l, r, a.tab AS l_tab, a.data_type AS l_type, a.primary_key AS l_primary_key, b.tab AS r_tab, b.data_type AS r_type, b.primary_key AS r_primary_key FROM co JOIN cols a ON a.ref = l JOIN cols b ON b.ref = r")
def proposal_context(spark, d):
    return proposals.with_context(_collisions(spark, d).select("l", "r"), C.columns(spark, d))


@query("fk_facts", f"{ALL} SELECT l, r, c.ref AS child, c.fk_ref AS parent FROM co JOIN cols c ON (c.ref = l AND c.fk_ref = r) OR (c.ref = r AND c.fk_ref = l)")
def fk_facts(spark, d):
    return proposals.key_facts(_collisions(spark, d), C.columns(spark, d))


@query("all_pairs_count", "SELECT db_id, count(DISTINCT column_ref) AS n_columns, count(DISTINCT column_ref) * (count(DISTINCT column_ref) - 1) // 2 AS n_pairs FROM column_profiles GROUP BY db_id")
def all_pairs_count(spark, d):
    return proposals.pair_counts(table(spark, d, "column_profiles").withColumnRenamed("column_ref", "ref"))


@query("table_pairs", f"WITH cols AS ({C.columns_sql()}) SELECT a.ref AS l, b.ref AS r FROM cols a JOIN cols b ON a.tab = b.tab AND a.ref < b.ref")
def table_pairs(spark, d):
    return proposals.pairs_of_table(C.columns(spark, d))


# -- ledger ------------------------------------------------------------------------------------------

_ID = f"nullif(lower(trim({{0}}, {_BLANKS})), '')"
LED = f"""WITH l AS (SELECT {_ID.format("candidate_id")} AS candidate, ingest_seq AS seq, status, parsed_payload.decision AS decision, parsed_payload.confidence AS confidence, error_class, error FROM verifier_decisions WHERE {_ID.format("candidate_id")} IS NOT NULL)"""
_LAST = "SELECT candidate, any_value(n) AS n_rows, any_value(seq) AS seq, any_value(status) AS status, any_value(decision) AS decision, any_value(confidence) AS confidence, any_value(error_class) AS error_class, any_value(error) AS error FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS n, row_number() OVER (PARTITION BY candidate ORDER BY seq DESC) AS rn FROM l {0}) WHERE rn = 1 GROUP BY candidate"
API = "CASE WHEN coalesce(error_class, '') <> '' THEN upper(error_class) LIKE 'API\\_%' ESCAPE '\\' OR upper(error_class) IN ('HTTP', 'TIMEOUT') ELSE regexp_matches(lower(coalesce(error, '')), 'timeout|urlerror|http error|connection refused|connection reset|quota') END"


@query("ledger_latest_ok", f"{LED} {_LAST.format('''WHERE status = 'OK' ''')}")
def ledger_latest_ok(spark, d):
    return ledger.latest(table(spark, d, "verifier_decisions"), True)


@query("ledger_latest_any", f"{LED} {_LAST.format('')}")
def ledger_latest_any(spark, d):
    return ledger.latest(table(spark, d, "verifier_decisions"), False)


def _queue(spark, d):
    from kolonnade.functions.keys import ident

    return table(spark, d, "verifier_decisions").select(ident(F.col("candidate_id")).alias("candidate")).where("candidate is not null").distinct()


@query("ledger_pending", f"{LED}, la AS ({_LAST.format('')}) SELECT candidate FROM la WHERE candidate NOT IN (SELECT candidate FROM l WHERE status = 'OK') AND {API}")
def ledger_pending(spark, d):
    return ledger.pending(_queue(spark, d), table(spark, d, "verifier_decisions"), "primary_sweep")


_REF = "parsed_payload.{0}.tab || '.' || parsed_payload.{0}.col"


@query(
    "verifier_validation",
    f"""SELECT DISTINCT ingest_seq AS seq, CASE WHEN parsed_payload IS NULL THEN 'missing payload' ELSE concat_ws('; ',
CASE WHEN NOT coalesce({_ID.format("parsed_payload.candidate_id")} = {_ID.format("candidate_id")}, false) THEN 'candidate_id mismatch' END,
CASE WHEN coalesce(parsed_payload.decision, '') NOT IN ('ADD_EDGE', 'REJECT') THEN 'invalid decision' END,
CASE WHEN NOT coalesce(list_sort([{_REF.format("col1")}, {_REF.format("col2")}]) = list_sort(pair_key), false) THEN 'unordered pair mismatch' END,
CASE WHEN NOT coalesce(parsed_payload.confidence BETWEEN 0 AND 1, false) THEN 'confidence must be a number in [0, 1]' END,
CASE WHEN coalesce(trim(parsed_payload.reason_summary), '') = '' THEN 'reason_summary must be a non-empty string' END,
CASE WHEN parsed_payload.decision = 'ADD_EDGE' AND coalesce(trim(parsed_payload.ambiguity_trigger_context), '') = '' THEN 'ADD_EDGE requires non-empty ambiguity_trigger_context' END,
CASE WHEN parsed_payload.decision = 'REJECT' AND parsed_payload.ambiguity_trigger_context IS NOT NULL THEN 'REJECT requires ambiguity_trigger_context = null' END) END AS errors FROM verifier_decisions""",
)
def verifier_validation(spark, d):
    return ledger.validation(table(spark, d, "verifier_decisions"))


@query(
    "verifier_json",
    r"""WITH b AS (SELECT DISTINCT ingest_seq, content, regexp_extract(content, '```(?:json)?\s*(\{.*?\})\s*```', 1, 's') AS f, regexp_extract(content, '(\{.*\})', 1, 's') AS g FROM batch_responses WHERE content IS NOT NULL),
j AS (SELECT ingest_seq, CASE WHEN f <> '' THEN f ELSE g END AS o FROM b) SELECT ingest_seq, length(o) AS n_chars FROM j WHERE o <> '' AND json_valid(o)""",
)
def verifier_json(spark, d):
    r = table(spark, d, "batch_responses").where("content is not null").select("ingest_seq", "content").distinct()
    return r.select("ingest_seq", F.length(ledger.json_object(F.col("content"))).cast("long").alias("n_chars")).where("n_chars is not null")


@query(
    "error_streaks",
    f"""WITH b AS (SELECT batch_id, count(*) AS n_rows, count(*) FILTER (WHERE {API}) AS n_api_errors FROM verifier_decisions WHERE batch_id IS NOT NULL GROUP BY batch_id),
g AS (SELECT *, split_part(batch_id, '-', 1) AS run, n_rows = n_api_errors AS f, sum(CASE WHEN n_rows = n_api_errors THEN 0 ELSE 1 END) OVER (PARTITION BY split_part(batch_id, '-', 1) ORDER BY batch_id) AS grp FROM b)
SELECT batch_id, n_rows, n_api_errors, CASE WHEN f THEN row_number() OVER (PARTITION BY run, grp, f ORDER BY batch_id) ELSE 0 END AS streak FROM g""",
)
def error_streaks(spark, d):
    return ledger.error_streaks(table(spark, d, "verifier_decisions")).withColumn("streak", F.col("streak").cast("long"))


@query(
    "graph_compile",
    f"""{LED}, ok AS ({_LAST.format('''WHERE status = 'OK' ''')}), q AS (SELECT DISTINCT candidate FROM l)
SELECT q.candidate, CASE WHEN ok.candidate IS NULL THEN 'unresolved:no_terminal_decision' WHEN decision = 'ADD_EDGE' THEN 'accepted' WHEN decision = 'REJECT' THEN 'rejected' ELSE 'unresolved:invalid_terminal_payload' END AS outcome, decision, confidence FROM q LEFT JOIN ok USING (candidate)""",
)
def graph_compile(spark, d):
    return ledger.compiled(_queue(spark, d), table(spark, d, "verifier_decisions"))


GRA = """WITH e AS (SELECT db_id, col1.tab || '.' || col1.col AS a, col2.tab || '.' || col2.col AS b, confidence FROM accepted_edges),
g AS (SELECT db_id, least(a, b) AS l, greatest(a, b) AS r, count(*) AS n_edges, max(confidence) AS confidence FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND lower(a) <> lower(b) GROUP BY ALL),
gr AS (SELECT db_id, 'group_' || lpad(CAST(row_number() OVER (PARTITION BY db_id ORDER BY l, r) - 1 AS VARCHAR), 6, '0') AS group_id, l, r, n_edges, confidence FROM g)"""


@query("graph_groups", f"{GRA} SELECT * FROM gr")
def graph_groups(spark, d):
    return ledger.graph_groups(table(spark, d, "accepted_edges"))


def _parts(x):
    return f"substr({x}, 1, strpos({x}, '.') - 1)", f"lower(substr({x}, strpos({x}, '.') + 1))"


_OT, _OC = _parts("option")
_AT, _AC = _parts("anchor")


@query(
    "graph_lookup",
    f"""{GRA}, a AS (SELECT DISTINCT db_id, column_ref AS anchor FROM column_profiles), s AS (SELECT db_id, group_id, l AS anchor, l, r FROM gr UNION ALL SELECT db_id, group_id, r, l, r FROM gr),
h AS (SELECT s.db_id, s.anchor, group_id, unnest([l, r]) AS option FROM s JOIN a ON a.db_id = s.db_id AND a.anchor = s.anchor)
SELECT db_id, anchor, option, group_id, row_number() OVER (PARTITION BY db_id, anchor, group_id ORDER BY CASE WHEN option = anchor THEN 0 WHEN {_OC} = {_AC} THEN 1 WHEN {_OT} = {_AT} THEN 2 ELSE 3 END, lower(option), option) AS rank FROM h""",
)
def graph_lookup(spark, d):
    anchors = table(spark, d, "column_profiles").select("db_id", F.col("column_ref").alias("anchor"))
    return ledger.graph_lookup(ledger.graph_groups(table(spark, d, "accepted_edges")), anchors).withColumn("rank", F.col("rank").cast("long"))


