"""Queries on value search, SQL texts, schema parts, results, telemetry, streams, and plain user SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kolonnade.operators import compare, ledger, retrieval, search, sqlanalysis, telemetry
from kolonnade.plans import columns as C
from kolonnade.plans.core_queries import _BLANKS, query
from kolonnade.plans.profile_queries import U
from kolonnade.session import cut, table
from kolonnade.streaming import streams

#: Stated probes and literals.
PROBES = ("red widget", "small rng", "nation_1", "Customer#00000001", "5-low", "high")
LITERALS = (("part.p_name", "red"), ("part.p_name", "red widget"), ("nation.n_name", "nation_2"), ("nation.n_name", "NATION_2"), ("orders.o_orderpriority", "low"), ("events.event_type", "error"), ("nowhere.x", "y"), ("customer.c_mktsegment", "BUILD"))
_PV = "(VALUES " + ", ".join(f"('{p}')" for p in PROBES) + ") AS p(probe)"
_LV = "(VALUES " + ", ".join(f"('{r}', '{x}')" for r, x in LITERALS) + ") AS l(ref, literal)"


def _probes(spark):
    return spark.createDataFrame([(p,) for p in PROBES], "probe string")


def _literals(spark):
    return spark.createDataFrame(list(LITERALS), "ref string, literal string")


IDX = f"""idx AS (SELECT ref, n_values, n_chars FROM (SELECT * FROM cols WHERE data_type = 'text' AND NOT regexp_matches(lower(col), '_id| id|url|email|web|time|phone|date|address') AND NOT col LIKE '%Id' AND lower(col) NOT IN (SELECT lower(col) FROM cols WHERE primary_key)) c
JOIN (SELECT ref, count(*) AS n_values, sum(length(v))::BIGINT AS n_chars FROM (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL) GROUP BY ref) USING (ref)
WHERE n_chars > 0 AND ((lower(col) LIKE '%name%' AND n_chars < 5000000) OR (n_chars < 2000000 AND n_chars / n_values < 25) OR n_values < 100))"""
VALS = "vals AS (SELECT DISTINCT u.ref, v FROM u JOIN idx USING (ref) WHERE v IS NOT NULL AND v <> '')"


def _indexed(spark, d):
    u = cut(C.values(spark, d).where("v is not null").distinct())
    keep = search.indexed_columns(u, C.columns(spark, d)).select("ref")
    return u.where("v <> ''").join(keep, "ref", "left_semi")


@query("lsh_value_selection", f"{U}, {IDX} SELECT * FROM idx")
def lsh_value_selection(spark, d):
    return search.indexed_columns(C.values(spark, d), C.columns(spark, d))


SHI = "CASE WHEN length({0}) <= 3 THEN [lower({0})] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring(lower({0}), i, 3))) END"
SEA = f"""sv AS (SELECT ref, v, unnest({SHI.format("v")}) AS x, len({SHI.format("v")}) AS n FROM vals), sp AS (SELECT probe, unnest({SHI.format("probe")}) AS x, len({SHI.format("probe")}) AS pn FROM {_PV}),
hit AS (SELECT probe, ref, v, pn, n, count(*) AS i FROM sv JOIN sp USING (x) GROUP BY ALL), sc AS (SELECT probe, ref, v, round(i / (pn + n - i), 6) AS jaccard FROM hit),
found AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY jaccard DESC, ref, v) AS rank FROM sc QUALIFY rank <= 20)"""


@query("value_search_jaccard", f"{U}, {IDX}, {VALS}, {SEA} SELECT * FROM found")
def value_search_jaccard(spark, d):
    return search.search_exact(_probes(spark), _indexed(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("value_search_minhash")
def value_search_minhash(spark, d):
    return search.search_minhash(_probes(spark), _indexed(spark, d))


@query(
    "similar_values",
    f"""{U}, {IDX}, {VALS}, {SEA} SELECT probe, ref, v, jaccard FROM found WHERE lower(trim(probe)) = lower(trim(v)) OR (contains(lower(trim(v)), lower(trim(probe))) AND length(trim(probe)) >= 3) OR (contains(lower(trim(probe)), lower(trim(v))) AND length(trim(v)) >= 3)
QUALIFY row_number() OVER (PARTITION BY probe, ref ORDER BY rank) = 1""",
)
def similar_values(spark, d):
    return search.similar_values(search.search_exact(_probes(spark), _indexed(spark, d)))


EXI = f"""exi AS (SELECT ref, literal, CASE WHEN ref IN (SELECT ref FROM u) THEN EXISTS (SELECT 1 FROM u WHERE u.ref = l.ref AND u.v = l.literal) END AS existence FROM {_LV})"""


@query("literal_existence", f"{U}, {EXI} SELECT * FROM exi")
def literal_existence(spark, d):
    return search.literal_existence(_literals(spark), C.values(spark, d))


@query(
    "substring_candidates",
    f"""{U} SELECT l.ref, literal, v, levenshtein(lower(v), lower(literal)) AS distance, row_number() OVER (PARTITION BY l.ref, literal ORDER BY levenshtein(lower(v), lower(literal)), v) AS rank
FROM {_LV} JOIN (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL AND v <> '') x ON x.ref = l.ref AND contains(lower(v), lower(literal)) AND v <> literal QUALIFY rank <= 3""",
)
def substring_candidates(spark, d):
    return search.substring_candidates(_literals(spark), C.values(spark, d)).withColumns({"rank": F.col("rank").cast("long"), "distance": F.col("distance").cast("long")})


@query(
    "value_options",
    f"""{U}, {IDX}, {VALS}, {EXI}, {SEA.replace(_PV, f"(SELECT DISTINCT literal AS probe FROM {_LV})")}, o AS (SELECT literal AS probe, ref, literal AS v, CASE WHEN existence THEN 'anchor' WHEN NOT existence THEN 'anchor_missing' ELSE 'anchor_unverified' END AS source, 0 AS o FROM exi
UNION ALL SELECT probe, ref, v, 'search', rank FROM found), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY probe, lower(ref), v ORDER BY o) = 1)
SELECT probe, ref, v, source, row_number() OVER (PARTITION BY probe ORDER BY o, ref, v) AS pos FROM f QUALIFY pos <= 5""",
)
def value_options(spark, d):
    probes = _literals(spark).select(F.col("literal").alias("probe")).distinct()
    found = search.search_exact(probes, _indexed(spark, d))
    return search.value_options(found, search.literal_existence(_literals(spark), C.values(spark, d))).withColumn("pos", F.col("pos").cast("long"))


# -- SQL texts ---------------------------------------------------------------------------------------


@query("sql_tables", r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(gold_sql, '(?i)\b(?:from|join)\s+([a-z_][a-z0-9_]*)', 1), lambda x: lower(x)))), ',') AS tables,
array_to_string(list_sort(list_distinct(regexp_extract_all(gold_sql, '''([^'']*)''', 1))), ',') AS literals FROM eval_items""")
def sql_tables(spark, d):
    e = table(spark, d, "eval_items")
    return e.select("item_id", F.array_join(sqlanalysis.tables_in(F.col("gold_sql")), ",").alias("tables"), F.array_join(sqlanalysis.quoted_literals(F.col("gold_sql")), ",").alias("literals"))


@query(
    "sql_clean",
    r"""WITH b AS (SELECT DISTINCT ingest_seq, content, regexp_extract(content, '```(?:sql)?\s*(.*?)\s*```', 1, 'is') AS f FROM batch_responses WHERE stage IN ('sql_gen', 'sql_fix') AND content IS NOT NULL)
SELECT ingest_seq, nullif(regexp_replace(regexp_extract(CASE WHEN f <> '' THEN f ELSE content END, '((?:select|with)\s.*)', 1, 'is'), '[;\s]+$', ''), '') AS statement FROM b""",
)
def sql_clean(spark, d):
    r = table(spark, d, "batch_responses").where("stage in ('sql_gen', 'sql_fix') and content is not null").select("ingest_seq", "content").distinct()
    return r.select("ingest_seq", sqlanalysis.clean_answer(F.col("content")).alias("statement"))


#: Stated statements of a user.
STATEMENTS = (
    "SELECT c_name FROM customer AS c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_1' AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
    'SELECT count(*) FROM orders WHERE o_orderstatus = "F" AND o_orderpriority LIKE \'%LOW%\';',
    "SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "SELECT FROM WHERE",
)


@query(
    "sql_anchors",
    """SELECT * FROM (VALUES (0, 'customer.c_mktsegment', 'BUILDING'), (0, 'customer.c_mktsegment', 'MACHINERY'), (0, 'nation.n_name', 'NATION_1'), (1, 'orders.o_orderpriority', 'LOW'), (1, 'orders.o_orderstatus', 'F'), (2, 'lineitem.l_returnflag', 'R')) AS t(sql_id, ref, literal)""",
)
def sql_anchors(spark, d):
    cols = {t: list(c) for t, c in C.STUDIED.items()}
    rows = [(i, ref, lit) for i, s in enumerate(STATEMENTS) if sqlanalysis.valid(spark, s) for ref, _, lit in sqlanalysis.anchors(spark, s, cols).literals]
    return spark.createDataFrame(rows, "sql_id int, ref string, literal string")


# -- schema parts ------------------------------------------------------------------------------------


@query(
    "schema_filter",
    f"""WITH cols AS ({C.columns_sql()}), k AS (SELECT unnest(['customer.c_name', 'nation.n_name']) AS ref), s AS (SELECT ref FROM cols WHERE primary_key OR uniq OR fk_ref IS NOT NULL UNION SELECT fk_ref FROM cols WHERE fk_ref IS NOT NULL)
SELECT ref, tab, data_type FROM cols WHERE tab IN (SELECT tab FROM cols JOIN k USING (ref)) AND (ref IN (SELECT ref FROM k) OR ref IN (SELECT ref FROM s))""",
)
def schema_filter(spark, d):
    cols = C.columns(spark, d)
    texts = spark.createDataFrame([(1, "Name of the customer (customer.c_name) and `nation`.`n_name`.")], "id int, text string")
    return retrieval.filtered_schema(cols, [retrieval.mentioned(texts, cols)]).select("ref", "tab", "data_type")


@query(
    "schema_connections",
    f"""WITH cols AS ({C.columns_sql()}), t AS (SELECT unnest(['customer', 'nation', 'orders']) AS tab) SELECT ref FROM cols JOIN t USING (tab) WHERE primary_key
UNION SELECT ref FROM cols JOIN t USING (tab) WHERE split_part(fk_ref, '.', 1) IN (SELECT tab FROM t) UNION SELECT fk_ref FROM cols JOIN t USING (tab) WHERE split_part(fk_ref, '.', 1) IN (SELECT tab FROM t)""",
)
def schema_connections(spark, d):
    return retrieval.connections(C.columns(spark, d), spark.createDataFrame([("customer",), ("nation",), ("orders",)], "tab string"))


EDG = "WITH e AS (SELECT DISTINCT db_id, col1.tab || '.' || col1.col AS a, col2.tab || '.' || col2.col AS b, confidence FROM accepted_edges WHERE col1.tab IS NOT NULL AND col1.col IS NOT NULL AND col2.tab IS NOT NULL AND col2.col IS NOT NULL)"


def _options(spark, d):
    ref = lambda s: F.concat(F.col(f"{s}.tab"), F.lit("."), F.col(f"{s}.col"))
    return table(spark, d, "accepted_edges").select("db_id", ref("col1").alias("anchor"), F.coalesce(F.round(F.col("confidence") * 1000).cast("int"), F.lit(0)).alias("idx"), ref("col2").alias("option")).where("anchor is not null and option is not null").distinct()


@query(
    "detection_slices",
    f"""{EDG}, o AS (SELECT db_id, a AS anchor, b AS option, min(coalesce(CAST(round(confidence * 1000) AS INT), 0)) AS idx FROM e GROUP BY ALL)
SELECT db_id, anchor, row_number() OVER (PARTITION BY db_id ORDER BY min(idx), anchor) AS slice, count(*) AS n_options, string_agg(option, ',' ORDER BY idx, option) AS options FROM o GROUP BY db_id, anchor""",
)
def detection_slices(spark, d):
    return retrieval.slices(_options(spark, d)).withColumn("slice", F.col("slice").cast("long"))


@query(
    "retrieval_audit",
    f"""{EDG}, o AS (SELECT DISTINCT db_id || '/' || a AS anchor, db_id || '/' || b AS ref, coalesce(CAST(round(confidence * 1000) AS INT), 0) AS pos FROM e), k AS (SELECT DISTINCT lower(db_id || '/' || column_ref) AS k FROM column_profiles),
r AS (SELECT anchor, lower(ref) AS x, lower(ref) = lower(anchor) AS own, row_number() OVER (PARTITION BY anchor, lower(ref) ORDER BY pos) AS nth, lower(ref) IN (SELECT k FROM k) AS known FROM o)
SELECT anchor, count(*) AS n, count(*) FILTER (WHERE own) AS n_self, count(*) FILTER (WHERE NOT own AND nth > 1) AS n_duplicate, count(*) FILTER (WHERE NOT own AND nth = 1 AND NOT known) AS n_unknown, count(*) FILTER (WHERE NOT own AND nth = 1 AND known) AS n_kept FROM r GROUP BY anchor""",
)
def retrieval_audit(spark, d):
    named = lambda c: F.concat("db_id", F.lit("/"), c)
    answers = _options(spark, d).select(named("anchor").alias("anchor"), F.col("idx").alias("pos"), named("option").alias("ref")).distinct()
    return retrieval.retrieval_audit(answers, table(spark, d, "column_profiles").select(named("column_ref").alias("ref")))


@query("detection_dedup", r"""SELECT min(ingest_seq) AS ingest_seq, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS norm FROM batch_responses WHERE content IS NOT NULL AND stage = 'module_a_detection' GROUP BY 2""")
def detection_dedup(spark, d):
    r = table(spark, d, "batch_responses").where("stage = 'module_a_detection'")
    return retrieval.deduplicated(r, "content", "ingest_seq").select("ingest_seq", F.trim(F.regexp_replace("content", "\\s+", " ")).alias("norm"))


@query(
    "detection_choices",
    r"""WITH b AS (SELECT DISTINCT ingest_seq, regexp_extract(content, '(\{.*\})', 1, 's') AS o FROM batch_responses WHERE stage = 'module_a_detection' AND content IS NOT NULL), v AS (SELECT * FROM b WHERE o <> '' AND json_valid(o)),
c AS (SELECT ingest_seq, unnest(range(CAST(json_array_length(o, '$.choices') AS BIGINT))) AS i, o FROM v)
SELECT 'moda_' || lpad(CAST(ingest_seq AS VARCHAR), 6, '0') || '_' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS entry_id, ingest_seq, CAST(i AS INT) AS choice_index, json_extract_string(o, '$.choices[' || i || '].nl_description') AS description, json_extract_string(o, '$.choices[' || i || '].sql_snippet') AS snippet FROM c""",
)
def detection_choices(spark, d):
    r = table(spark, d, "batch_responses").where("stage = 'module_a_detection' and content is not null").select("ingest_seq", "content").distinct()
    return retrieval.choices(r.select("ingest_seq", ledger.json_object(F.col("content")).alias("object")))


@query("collit_components", "SELECT * FROM (VALUES ('e1', 2::BIGINT, 1::BIGINT, false), ('missing:part.p_type', 1::BIGINT, 1::BIGINT, true)) AS t(component, n_values, n_columns, missing)")
def collit_components(spark, d):
    vals = spark.createDataFrame([("red", "part.p_name"), ("blue", "part.p_name"), ("ECONOMY", "part.p_type")], "value string, ref string")
    return retrieval.components(vals, spark.createDataFrame([("e1", "part.p_name"), ("e2", "nation.n_name")], "entry string, ref string"))


@query("collit_prune", "SELECT * FROM (VALUES ('c1', 'a.x', 'a.x'), ('c1', 'b.y', 'a.x'), ('c2', 'a.z', 'a.z'), ('c2', 'b.w', 'a.z')) AS t(component, ref, source_ref)")
def collit_prune(spark, d):
    cand = spark.createDataFrame([("c1", "a.x", "a.x"), ("c1", "b.y", "a.x"), ("c1", "b.q", "a.x"), ("c2", "a.z", "a.z"), ("c2", "b.w", "a.z")], "component string, ref string, source_ref string")
    vals = spark.createDataFrame([("c1", "a.x", True), ("c1", "b.y", True), ("c2", "a.z", False)], "component string, ref string, existence boolean")
    return retrieval.pruned(cand, vals)


# -- results -----------------------------------------------------------------------------------------

#: Stated pairs of statements with the verdict that follows from their texts.
RESULT_PAIRS = (
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation", True),
    ("SELECT n_name FROM nation", "SELECT r_name FROM region", False),
    ("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT count(*) AS n, l_returnflag FROM lineitem GROUP BY l_returnflag ORDER BY 1", True),
    ("SELECT c_custkey FROM customer WHERE c_nationkey = 1", "SELECT o_custkey FROM orders WHERE o_custkey < 0", False),
    ("SELECT 1 AS x", "SELECT 1.0 AS y", True),
    ("SELECT c_custkey FROM customer WHERE c_custkey < 0", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 0", True),
)


@query("ex_col_compare", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(v).lower()})" for i, (_, _, v) in enumerate(RESULT_PAIRS)) + ") AS t(pair_id, equal)")
def ex_col_compare(spark, d):
    for t in C.STUDIED:
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.createDataFrame([(i, compare.equal_results(spark.sql(a), spark.sql(b))) for i, (a, b, _) in enumerate(RESULT_PAIRS)], "pair_id int, equal boolean")


@query("ex_accuracy", f"SELECT {len(RESULT_PAIRS)}::BIGINT AS n, {sum(v for *_, v in RESULT_PAIRS)}::BIGINT AS n_correct, round({sum(v for *_, v in RESULT_PAIRS)} / {len(RESULT_PAIRS)}, 6) AS accuracy")
def ex_accuracy(spark, d):
    return compare.accuracy(ex_col_compare(spark, d).withColumnRenamed("equal", "correct"))


@query("sql_clusters", "SELECT * FROM (VALUES (0, 3, 2, 'SELECT n_regionkey, n_name FROM nation'), (1, 1, 3, 'SELECT r_name FROM region')) AS t(cluster, n, chosen_id, chosen_sql)")
def sql_clusters(spark, d):
    for t in C.STUDIED:
        table(spark, d, t).createOrReplaceTempView(t)
    sqls = ["SELECT n_name, n_regionkey FROM nation ORDER BY 1", "SELECT n.n_name, n.n_regionkey FROM nation AS n", "SELECT n_regionkey, n_name FROM nation", "SELECT r_name FROM region", "SELECT nothing FROM nowhere"]
    return compare.clusters(spark, list(enumerate(sqls)))


# -- telemetry ---------------------------------------------------------------------------------------

_SUMS = "count(*) AS request_count, count(*) FILTER (WHERE coalesce(ok, false)) AS ok_count, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS failed_count, count(*) FILTER (WHERE token_usage IS NULL) AS missing_usage_count, sum(coalesce(token_usage.prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(token_usage.completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(token_usage.total_tokens, 0))::BIGINT AS total_tokens"
STAGES = ("sql_gen", "sql_fix", "pair_verification", "descriptive_names", "module_a_detection", "cq_gen", "feedback")


@query("usage_rollup", " UNION ALL ".join(f"SELECT '{k}' AS \"by\", coalesce(CAST({k} AS VARCHAR), 'unknown') AS key, {_SUMS} FROM batch_responses GROUP BY 2" for k in ("stage", "model", "turn")))
def usage_rollup(spark, d):
    return telemetry.usage(table(spark, d, "batch_responses"))


@query(
    "clarification_transcript",
    rf"""WITH o AS (SELECT DISTINCT question_id, turn, nullif(lower(trim(request_id, {_BLANKS})), '') AS id, regexp_replace(prompt, '\s+', ' ', 'g') AS p FROM batch_requests WHERE question_id IS NOT NULL AND prompt IS NOT NULL)
SELECT question_id, count(*) AS n_turns, string_agg('Turn ' || coalesce(CAST(turn AS VARCHAR), '?') || ': ' || p, chr(10) ORDER BY turn, id, p) AS transcript FROM o GROUP BY question_id""",
)
def clarification_transcript(spark, d):
    return telemetry.transcripts(table(spark, d, "batch_requests"))


_CASE = "CASE stage " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(STAGES)) + " ELSE 0 END"


@query("dialogue_latest_stage", f"SELECT question_id, turn, stage FROM (SELECT DISTINCT question_id, turn, stage FROM batch_responses WHERE ok AND question_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY turn DESC, {_CASE} DESC, stage DESC) = 1")
def dialogue_latest_stage(spark, d):
    return telemetry.latest_stage(table(spark, d, "batch_responses"), STAGES)


@query("call_times", "SELECT coalesce(status, 'unknown') AS status, count(*) AS n, round(sum(elapsed_seconds), 3) AS total_s, round(quantile_cont(elapsed_seconds, 0.5), 6) AS p50_s FROM verifier_decisions GROUP BY 1")
def call_times(spark, d):
    return telemetry.elapsed(table(spark, d, "verifier_decisions"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    shape = table(spark, d, "events").schema
    events = streams.follow(spark, f"{d}/events.parquet", shape).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.finished(streams.windowed(events, "ts", "event_type", "value")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "event_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id AS key, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", watermark=False)


# -- user SQL ----------------------------------------------------------------------------------------

USER_SQL = {
    "user_sql_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "user_sql_top_customers": "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_custkey LIMIT 20",
    "user_sql_region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "user_sql_semi": "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY o_orderpriority",
    "user_sql_anti": "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment",
    "user_sql_window": "SELECT s_suppkey, s_nationkey, rk FROM (SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rk FROM supplier) t WHERE rk <= 2",
    "user_sql_set_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "user_sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "user_sql_cte": "WITH x AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT s_name, q FROM x JOIN supplier ON s_suppkey = l_suppkey WHERE q > (SELECT avg(q) FROM x)",
}


def _user(sql: str):
    def call(spark, d):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            table(spark, d, t).createOrReplaceTempView(t)
        return compare.run(spark, sql)

    return call


for _name, _sql in USER_SQL.items():
    query(_name, _sql)(_user(_sql))

