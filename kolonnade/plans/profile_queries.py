"""Queries on catalog, profiles, names and values of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kolonnade.operators import lexical, profile, values
from kolonnade.plans import columns as C
from kolonnade.plans.core_queries import query
from kolonnade.session import cut, table
from kolonnade.sources import catalog as cat

U = f"WITH u AS ({C.values_sql()}), cols AS ({C.columns_sql()})"
BOOL = "(bool_and(lower(trim(v)) IN ('0','1','')) OR bool_and(lower(trim(v)) IN ('true','false','')) OR bool_and(lower(trim(v)) IN ('yes','no','')) OR bool_and(lower(trim(v)) IN ('y','n','')))"
CNT = """cnt AS (SELECT ref, count(*) AS row_count, count(v) AS non_null_count, count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*), 6) AS null_fraction,
count(DISTINCT v) AS distinct_count, round(CASE WHEN count(v) > 0 THEN count(DISTINCT v) / count(v) ELSE 0 END, 6) AS distinct_ratio FROM u GROUP BY ref)"""
LEN = "len AS (SELECT ref, round(quantile_cont(length(v), 0.1), 6) AS p10, round(quantile_cont(length(v), 0.5), 6) AS p50, round(quantile_cont(length(v), 0.9), 6) AS p90 FROM u GROUP BY ref)"
BOO = f"boo AS (SELECT ref, count(*) <= 20 AND count(*) FILTER (WHERE trim(v) <> '') > 0 AND {BOOL} AS b FROM (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL) GROUP BY ref)"
MODE = """modes AS (SELECT c.ref, CASE WHEN coalesce(b, false) THEN 'BOOLEAN_LIKE'
WHEN regexp_matches(lower(col), 'uuid| id|_id|code|key|id$') THEN 'CODE_OR_IDENTIFIER'
WHEN contains(lower(col), 'date') OR contains(data_type, 'date') OR contains(data_type, 'time') THEN 'DATE_LIKE'
WHEN regexp_matches(data_type, 'int|real|numeric|double|float|decimal') THEN 'NUMERIC_MEASURE'
WHEN coalesce(distinct_count, 0) BETWEEN 2 AND 10 THEN 'LOW_CARD_DOMAIN'
WHEN coalesce(distinct_ratio, 0) >= 0.95 AND coalesce(distinct_count, 0) >= 20 THEN 'CODE_OR_IDENTIFIER'
WHEN contains(data_type, 'text') OR contains(data_type, 'char') OR data_type = '' THEN 'LABEL_TEXT' ELSE 'OTHER' END AS value_mode
FROM cols c LEFT JOIN cnt USING (ref) LEFT JOIN boo USING (ref))"""


@query("catalog_columns", f"WITH cols AS ({C.columns_sql()}) SELECT * FROM cols")
def catalog_columns(spark, d):
    return C.columns(spark, d)


@query(
    "catalog_ddl",
    f"""WITH cols AS ({C.columns_sql()}) SELECT tab, 'CREATE TABLE "' || tab || '" (' || chr(10) || string_agg('  "' || col || '" ' || data_type || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END, ',' || chr(10) ORDER BY ordinal)
|| coalesce(',' || chr(10) || '  PRIMARY KEY (' || string_agg(CASE WHEN primary_key THEN '"' || col || '"' END, ', ' ORDER BY ordinal) || ')', '')
|| coalesce(',' || chr(10) || string_agg(CASE WHEN fk_ref IS NOT NULL THEN '  FOREIGN KEY ("' || col || '") REFERENCES "' || split_part(fk_ref, '.', 1) || '" ("' || split_part(fk_ref, '.', 2) || '")' END, ',' || chr(10) ORDER BY ordinal), '') || chr(10) || ')' AS ddl
FROM cols GROUP BY tab""",
)
def catalog_ddl(spark, d):
    return cat.ddl(C.columns(spark, d))


@query("schema_map", f"WITH cols AS ({C.columns_sql()}) SELECT lower(ref) AS key, min(ref) AS ref FROM cols GROUP BY 1")
def schema_map(spark, d):
    return cat.schema_map(C.columns(spark, d))


@query("profile_counts", f"{U}, {CNT} SELECT * FROM cnt")
def profile_counts(spark, d):
    return profile.counts(C.values(spark, d))


@query("profile_lengths", f"{U}, {LEN} SELECT * FROM len")
def profile_lengths(spark, d):
    return profile.lengths(C.values(spark, d))


@query("profile_value_mode", f"{U}, {CNT}, {BOO}, {MODE} SELECT * FROM modes")
def profile_value_mode(spark, d):
    return profile.modes(C.values(spark, d), C.columns(spark, d))


SAMP = r"""samp AS (SELECT ref, row_number() OVER (PARTITION BY ref ORDER BY rn) AS pos, value FROM (
SELECT ref, trim(regexp_replace(v, '\s+', ' ', 'g')) AS value, min(rn) AS rn FROM (SELECT ref, v, row_number() OVER (PARTITION BY ref ORDER BY v) AS rn FROM (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL)) WHERE rn <= 40
GROUP BY 1, 2) WHERE value <> '' AND length(value) <= 120 QUALIFY pos <= 5)"""


@query("profile_samples", f"{U}, {SAMP} SELECT * FROM samp")
def profile_samples(spark, d):
    return profile.samples(C.values(spark, d)).withColumn("pos", F.col("pos").cast("long"))


SEM = """sem AS (SELECT c.ref, concat_ws('; ', CASE value_mode WHEN 'BOOLEAN_LIKE' THEN 'boolean-like categorical value' WHEN 'CODE_OR_IDENTIFIER' THEN 'code or identifier' WHEN 'DATE_LIKE' THEN 'date or time value' WHEN 'NUMERIC_MEASURE' THEN 'numeric measure'
WHEN 'LOW_CARD_DOMAIN' THEN 'low-cardinality categorical label' WHEN 'LABEL_TEXT' THEN 'text label' ELSE 'other schema value' END,
CASE WHEN primary_key THEN 'primary key' END, CASE WHEN uniq THEN 'unique column' END, CASE WHEN fk_ref IS NOT NULL THEN 'foreign key column' END,
CASE WHEN distinct_ratio >= 0.95 THEN 'mostly unique values' WHEN distinct_ratio > 0 AND distinct_ratio <= 0.05 THEN 'many repeated values' END,
CASE WHEN null_fraction >= 0.9 THEN 'high-null column' WHEN null_fraction <= 0.01 THEN 'mostly populated column' END,
CASE WHEN value_mode = 'LABEL_TEXT' AND p50 >= 80 THEN 'long free-form text' WHEN value_mode = 'LABEL_TEXT' AND p50 BETWEEN 0 AND 32 THEN 'short text label' END) AS semantics
FROM cols c JOIN modes USING (ref) JOIN cnt USING (ref) JOIN len USING (ref))"""


@query("profile_semantics", f"{U}, {CNT}, {LEN}, {BOO}, {MODE}, {SEM} SELECT * FROM sem")
def profile_semantics(spark, d):
    return profile.profile(C.values(spark, d), C.columns(spark, d)).select("ref", "semantics")


@query(
    "table_profiles",
    f"""{U}, {CNT}, {LEN}, {BOO}, {MODE}, {SEM}, {SAMP}, ex AS (SELECT ref, string_agg(value, ', ' ORDER BY pos) AS e FROM samp GROUP BY ref)
SELECT tab, string_agg(c.ref || ' (' || data_type || '): ' || semantics || coalesce('; examples: ' || e, ''), chr(10) ORDER BY ordinal) AS profile FROM cols c JOIN sem USING (ref) LEFT JOIN ex USING (ref) GROUP BY tab""",
)
def table_profiles(spark, d):
    return profile.rendered(profile.profile(C.values(spark, d), C.columns(spark, d)))


@query("table_counts", f"{U}, {CNT} SELECT tab, max(row_count) AS row_count, count(*) AS column_count FROM cols JOIN cnt USING (ref) GROUP BY tab")
def table_counts(spark, d):
    return profile.counts(C.values(spark, d)).join(C.columns(spark, d), "ref").groupBy("tab").agg(F.max("row_count").alias("row_count"), F.count("*").alias("column_count"))


@query("live_value_stats", f"{U}, {CNT} SELECT ref, distinct_count + CASE WHEN null_count > 0 THEN 1 ELSE 0 END < 20 AS is_categorical, 'Total count ' || row_count || ' - Distinct count ' || distinct_count || ' - Null count ' || null_count AS statistics FROM cnt")
def live_value_stats(spark, d):
    return profile.live_stats(C.values(spark, d))


@query(
    "example_budget",
    f"""{U}, f AS (SELECT ref, v, row_number() OVER (PARTITION BY ref ORDER BY v) AS rn FROM (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL) QUALIFY rn <= 5),
t AS (SELECT *, sum(length(v)) OVER (PARTITION BY ref ORDER BY rn) AS total FROM f) SELECT ref, count(*) AS n_examples, string_agg(v, ' | ' ORDER BY rn) AS examples FROM t WHERE total <= 100 GROUP BY ref""",
)
def example_budget(spark, d):
    return profile.example_budget(C.values(spark, d))


@query("key_roles", f"WITH cols AS ({C.columns_sql()}) SELECT c.ref, c.primary_key, c.fk_ref IS NOT NULL AS foreign_key, count(b.ref) AS referenced_by FROM cols c LEFT JOIN cols b ON b.fk_ref = c.ref GROUP BY ALL")
def key_roles(spark, d):
    return profile.key_roles(C.columns(spark, d))


@query("inferred_unique_keys", f"{U}, {CNT} SELECT ref, row_count FROM cnt WHERE non_null_count = row_count AND distinct_count = row_count")
def inferred_unique_keys(spark, d):
    return cat.unique_keys(profile.counts(C.values(spark, d)))


@query(
    "inferred_inclusion_deps",
    f"""{U}, {CNT}, dv AS (SELECT DISTINCT ref, v FROM u WHERE v IS NOT NULL), k AS (SELECT ref FROM cnt WHERE non_null_count = row_count AND distinct_count = row_count),
h AS (SELECT c.ref AS child_ref, p.ref AS parent_ref, count(*) AS n_values FROM dv c JOIN dv p ON c.v = p.v AND c.ref <> p.ref JOIN k ON k.ref = p.ref GROUP BY 1, 2)
SELECT h.* FROM h JOIN (SELECT ref, count(*) AS n FROM dv GROUP BY ref) z ON z.ref = child_ref AND z.n = n_values""",
)
def inferred_inclusion_deps(spark, d):
    tally = _tally(spark, d)
    return cat.inclusion_dependencies(tally.where("v is not null").select("ref", "v"), cat.unique_keys(profile.counts(tally)))


# -- names ------------------------------------------------------------------------------------------


def _names(spark, d):
    # Names as they are; a reference is unique within its database.
    return table(spark, d, "column_profiles").select("db_id", F.col("column_ref").alias("ref"), "tab", "col")


LEX = r"""WITH c AS (SELECT DISTINCT db_id, column_ref AS ref, tab, col FROM column_profiles WHERE column_ref IS NOT NULL),
t AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(coalesce(col, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z]+|[0-9]+'), lambda x: lower(x)) AS tokens FROM c),
s AS (SELECT *, array_to_string(tokens, ' ') AS surface, list_sort(list_distinct(tokens)) AS token_set FROM t),
x AS (SELECT *, CASE WHEN length(surface) = 0 THEN [] WHEN length(surface) < 3 THEN [surface] ELSE list_distinct(list_transform(range(1, length(surface) - 1), lambda i: substring(surface, i, 3))) END AS grams,
CASE WHEN len(tokens) > 1 AND regexp_matches(tokens[-1], '^[0-9]+$') THEN array_to_string(tokens[:-2], ' ') END AS slot_base,
CASE WHEN len(tokens) > 1 AND regexp_matches(tokens[-1], '^[0-9]+$') THEN tokens[-1] END AS slot_suffix FROM s)"""
PAIRS = """, p AS (SELECT a.db_id, a.ref AS l, b.ref AS r, a.tab AS lt, b.tab AS rt, a.surface AS ls, b.surface AS rs, a.slot_base AS lb, b.slot_base AS rb, a.slot_suffix AS lx, b.slot_suffix AS rx, a.token_set AS la, b.token_set AS ra,
len(list_intersect(a.token_set, b.token_set)) AS i, len(a.token_set) AS n, len(b.token_set) AS m, len(list_intersect(a.grams, b.grams)) AS gi, len(a.grams) AS gn, len(b.grams) AS gm FROM x a JOIN x b ON a.db_id = b.db_id AND a.ref < b.ref),
sc AS (SELECT *, round(CASE WHEN n + m - i = 0 THEN 0 ELSE i / (n + m - i) END, 6) AS token_jaccard, round(CASE WHEN least(n, m) = 0 THEN 0 ELSE i / least(n, m) END, 6) AS token_overlap, round(CASE WHEN gn + gm = 0 THEN 0 ELSE 2 * gi / (gn + gm) END, 6) AS char_ngram_dice FROM p)"""


@query("lexical_profiles", LEX + " SELECT db_id, ref, array_to_string(tokens, ' ') AS surface, array_to_string(token_set, ' ') AS token_set, len(grams) AS n_grams, slot_base, slot_suffix FROM x")
def lexical_profiles(spark, d):
    p = lexical.profiles(_names(spark, d))
    return p.select("db_id", "ref", "surface", F.array_join("token_set", " ").alias("token_set"), F.size("grams").cast("long").alias("n_grams"), "slot_base", "slot_suffix")


@query("lexical_token_scores", LEX + PAIRS + " SELECT db_id, l, r, token_jaccard, token_overlap, char_ngram_dice FROM sc WHERE i > 0")
def lexical_token_scores(spark, d):
    p = lexical.profiles(_names(spark, d))
    return lexical.scored(lexical.token_pairs(p), p).select("db_id", "l", "r", "token_jaccard", "token_overlap", "char_ngram_dice")


@query(
    "lexical_candidates_no_edit",
    LEX + PAIRS + """, ru AS (SELECT *, concat_ws(',', CASE WHEN lb = rb AND lx <> rx THEN 'NUMERIC_SLOT_PATTERN' END,
CASE WHEN len(list_filter(list_intersect(la, ra), lambda t: length(t) >= 3)) > 0 AND (token_overlap >= 0.5 OR token_jaccard >= 0.3) THEN 'EXACT_TOKEN_OVERLAP' END,
CASE WHEN greatest(length(ls), length(rs)) >= 5 AND char_ngram_dice >= 0.6 THEN 'CHAR_SIMILARITY' END) AS rules FROM sc)
SELECT db_id, 'lexical_' || lpad(CAST(row_number() OVER (PARTITION BY db_id ORDER BY l, r) AS VARCHAR), 6, '0') AS candidate_id, l, r, rules,
CASE WHEN contains(rules, 'NUMERIC_SLOT_PATTERN') THEN 'NUMERIC_SLOT_PATTERN' WHEN contains(rules, 'CHAR_SIMILARITY') AND i = 0 THEN 'CHAR_ONLY_MATCH' WHEN i = 1 THEN 'SINGLE_SHARED_TOKEN' WHEN lt <> rt THEN 'CROSS_TABLE_SURFACE_MATCH' WHEN i >= 2 THEN 'MULTI_TOKEN_OVERLAP' ELSE 'OTHER_LEXICAL_SURFACE' END AS hint,
token_jaccard, token_overlap, char_ngram_dice, 0.0::DOUBLE AS edit_similarity, round(greatest(token_jaccard, 0.7 * token_overlap, 0.8 * char_ngram_dice, 0.0), 6) AS lexical_similarity FROM ru WHERE rules <> ''""",
)
def lexical_candidates_no_edit(spark, d):
    return lexical.candidates(_names(spark, d))


@query("lexical_candidates")
def lexical_candidates(spark, d):
    return lexical.candidates(_names(spark, d), edit=True)


# -- values -----------------------------------------------------------------------------------------

MISS = "('', 'null', 'none', 'n/a', 'na', 'nan', 'unknown', 'not available')"
DOM = rf"""dom AS (SELECT DISTINCT ref, v FROM (SELECT ref, trim(regexp_replace(lower(v), '\s+', ' ', 'g')) AS v FROM u WHERE v IS NOT NULL) WHERE v NOT IN {MISS})"""
PAT = r"""pat AS (SELECT ref, v, CASE WHEN v = '' THEN 'empty' WHEN regexp_full_match(v, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'uuid_like'
WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([ t].*)?') THEN 'date_like' WHEN regexp_full_match(v, '[-+]?[0-9]+') THEN 'integer_like' WHEN regexp_full_match(v, '[-+]?([0-9]+\.[0-9]*|\.[0-9]+)') THEN 'decimal_like'
WHEN regexp_full_match(v, '[a-z]+') THEN CASE WHEN length(v) <= 32 THEN 'short_text' ELSE 'long_text' END
WHEN regexp_full_match(v, '[a-z0-9][a-z0-9_.:/+-]*') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') THEN 'alnum_code_like' WHEN length(v) >= 80 THEN 'long_text' ELSE 'other_text' END AS pattern FROM dom),
patd AS (SELECT s.ref, n_values, dominant_pattern, length_p50 FROM (SELECT ref, count(*) AS n_values, quantile_cont(length(v), 0.5) AS length_p50 FROM dom GROUP BY ref) s
JOIN (SELECT ref, pattern AS dominant_pattern FROM pat GROUP BY ref, pattern QUALIFY row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, pattern) = 1) t USING (ref))"""
ELI = """el0 AS (SELECT c.ref, coalesce(n_values, 0) AS n_values, coalesce(dominant_pattern, 'empty') AS dominant_pattern, length_p50, value_mode,
value_mode = 'CODE_OR_IDENTIFIER' OR primary_key OR uniq OR fk_ref IS NOT NULL OR lower(col) LIKE '%id' OR len(list_intersect(string_split_regex(lower(regexp_replace(col, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), ['id','uuid','key','code'])) > 0 AS ident,
value_mode = 'DATE_LIKE' OR coalesce(dominant_pattern = 'date_like', false) AS dt, coalesce(bd, false) AS bl FROM cols c JOIN modes USING (ref) LEFT JOIN patd USING (ref)
LEFT JOIN (SELECT ref, bool_and(v IN ('0','1')) OR bool_and(v IN ('true','false')) OR bool_and(v IN ('yes','no')) OR bool_and(v IN ('y','n')) AS bd FROM dom GROUP BY ref) USING (ref)),
el1 AS (SELECT *, value_mode = 'NUMERIC_MEASURE' AND NOT ident AS nm FROM el0),
el AS (SELECT *, ident AND n_values >= 2 AND NOT bl AND NOT dt AS m1, n_values BETWEEN 2 AND 10 AND NOT bl AND NOT dt AND NOT nm AND (length_p50 IS NULL OR length_p50 <= 32) AS m2,
coalesce(value_mode = 'LABEL_TEXT' AND n_values >= 3 AND NOT bl AND NOT dt AND NOT nm AND length_p50 >= 80, false) AS m3,
value_mode IN ('LABEL_TEXT','LOW_CARD_DOMAIN') AND n_values >= 3 AND NOT bl AND NOT dt AND NOT nm AND (length_p50 IS NULL OR length_p50 < 80) AS m4 FROM el1)""".replace("\\\\", "\\")
OVL = """sz AS (SELECT ref, count(*) AS n FROM dom GROUP BY ref), sh AS (SELECT a.ref AS l, b.ref AS r, count(*) AS i FROM dom a JOIN dom b ON a.v = b.v AND a.ref < b.ref GROUP BY ALL),
ov AS (SELECT l, r, x.n AS n_left, y.n AS n_right, i AS n_shared, i / (x.n + y.n - i) AS jaccard, i / least(x.n, y.n) AS overlap, i / x.n AS contained_left, i / y.n AS contained_right FROM sh JOIN sz x ON x.ref = l JOIN sz y ON y.ref = r)"""
GRP = "CASE WHEN {0} IN ('integer_like','decimal_like') THEN 'numeric' WHEN {0} IN ('uuid_like','alnum_code_like') THEN 'code' WHEN {0} = 'date_like' THEN 'date' WHEN {0} IN ('short_text','long_text','other_text') THEN 'text' ELSE 'other' END"
COL = f"""co0 AS (SELECT ov.*, a.m1 AS a1, a.m2 AS a2, a.m3 AS a3, a.m4 AS a4, b.m1 AS b1, b.m2 AS b2, b.m3 AS b3, b.m4 AS b4, {GRP.format("a.dominant_pattern")} AS lg, {GRP.format("b.dominant_pattern")} AS rg FROM ov JOIN el a ON a.ref = l JOIN el b ON b.ref = r),
co1 AS (SELECT *, lg <> 'date' AND rg <> 'date' AND (lg = rg OR lg = 'code' OR rg = 'code') AS alike, lg = 'text' AND rg = 'text' AS txt,
n_shared >= CASE WHEN greatest(n_left, n_right) >= 10000 THEN 30 WHEN greatest(n_left, n_right) >= 1000 THEN 10 ELSE 3 END AND (overlap >= 0.5 OR greatest(contained_left, contained_right) >= 0.8) AS much FROM co0),
co2 AS (SELECT *, CASE WHEN a1 AND b1 AND alike AND much THEN 'CODE_OR_IDENTIFIER' WHEN a2 AND b2 AND alike AND n_shared >= 2 AND overlap >= 1 THEN 'LOW_CARD_DOMAIN' WHEN a3 AND b3 AND txt AND n_shared >= 3 AND overlap >= 0.5 THEN 'LONG_TEXT_HASH' WHEN a4 AND b4 AND txt AND much THEN 'LABEL_TEXT' END AS mode FROM co1),
co AS (SELECT 'value_' || lpad(CAST(row_number() OVER (ORDER BY l, r) AS VARCHAR), 6, '0') AS candidate_id, l, r, mode, CASE mode WHEN 'CODE_OR_IDENTIFIER' THEN 'high' WHEN 'LOW_CARD_DOMAIN' THEN 'low' ELSE 'medium' END AS priority, n_left, n_right, n_shared,
round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap, round(contained_left, 6) AS contained_left, round(contained_right, 6) AS contained_right FROM co2 WHERE mode IS NOT NULL)"""
ALL = f"{U}, {CNT}, {BOO}, {MODE}, {DOM}, {PAT}, {ELI}, {OVL}, {COL}"


def _tally(spark, d):
    """All values of the database, once each with their number; stored, since several parts of a query read them."""
    return cut(profile.tallied(C.values(spark, d)))


def _domain(spark, d, tally=None):
    return values.domains(tally if tally is not None else C.values(spark, d))


def _collisions(spark, d, tally=None, domain=None):
    tally = tally if tally is not None else _tally(spark, d)
    domain = domain if domain is not None else cut(values.domains(tally))
    return values.collisions(domain, C.columns(spark, d), profile.modes(tally, C.columns(spark, d)))


def _all(spark, d):
    tally = _tally(spark, d)
    domain = cut(values.domains(tally))
    return tally, domain, cut(_collisions(spark, d, tally, domain).select("l", "r"))


@query("value_patterns", f"{U}, {DOM}, {PAT} SELECT * FROM patd")
def value_patterns(spark, d):
    return values.patterns(_domain(spark, d))


@query(
    "value_eligibility",
    f"""{U}, {CNT}, {BOO}, {MODE}, {DOM}, {PAT}, {ELI} SELECT ref, n_values, dominant_pattern, length_p50, concat_ws(',', CASE WHEN m1 THEN 'CODE_OR_IDENTIFIER' END, CASE WHEN m2 THEN 'LOW_CARD_DOMAIN' END, CASE WHEN m3 THEN 'LONG_TEXT_HASH' END, CASE WHEN m4 THEN 'LABEL_TEXT' END) AS modes,
concat_ws(',', CASE WHEN bl THEN 'BOOLEAN_LIKE_DOMAIN' END, CASE WHEN dt THEN 'DATE_LIKE_DOMAIN' END, CASE WHEN n_values = 0 THEN 'EMPTY_DOMAIN' END, CASE WHEN nm THEN 'NUMERIC_MEASURE' END, CASE WHEN n_values = 1 THEN 'SINGLE_VALUE_DOMAIN' END) AS reasons FROM el""",
)
def value_eligibility(spark, d):
    tally = _tally(spark, d)
    e = values.eligibility(cut(values.domains(tally)), C.columns(spark, d), profile.modes(tally, C.columns(spark, d)))
    return e.withColumns({"modes": F.array_join("modes", ","), "reasons": F.array_join("reasons", ",")})


@query("value_overlap", f"{U}, {DOM}, {OVL} SELECT l, r, n_left, n_right, n_shared, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap, round(contained_left, 6) AS contained_left, round(contained_right, 6) AS contained_right FROM ov")
def value_overlap(spark, d):
    o = values.overlaps(cut(_domain(spark, d)))
    return o.select("l", "r", "n_left", "n_right", "n_shared", *[F.round(c, 6).alias(c) for c in ("jaccard", "overlap", "contained_left", "contained_right")])


@query("value_collision_candidates", f"{ALL} SELECT * FROM co")
def value_collision_candidates(spark, d):
    return _collisions(spark, d)


@query(
    "value_matched_examples",
    f"""{ALL}, m AS (SELECT l, r, a.v FROM co JOIN dom a ON a.ref = l JOIN dom b ON b.ref = r AND b.v = a.v QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY a.v) <= 5)
SELECT l, r, string_agg(v, ' | ' ORDER BY v) AS examples FROM m GROUP BY l, r""",
)
def value_matched_examples(spark, d):
    _, domain, pairs = _all(spark, d)
    return values.matched_examples(domain, pairs)


REP = rf"reps AS (SELECT ref, trim(regexp_replace(lower(o), '\s+', ' ', 'g')) AS v, min(o) AS original FROM (SELECT ref, trim(v) AS o FROM u WHERE v IS NOT NULL) GROUP BY 1, 2 HAVING trim(regexp_replace(lower(any_value(o)), '\s+', ' ', 'g')) NOT IN {MISS})"


@query("value_representatives", f"{U}, {REP} SELECT * FROM reps")
def value_representatives(spark, d):
    return values.representatives(C.values(spark, d))


@query(
    "overlap_samples",
    f"""{ALL}, {REP}, m AS (SELECT l, r, a.v, least(a.original, b.original) AS o, row_number() OVER (PARTITION BY l, r ORDER BY sha256('{C.DB}|' || l || '|' || r || '|overlap|' || a.v)) AS rn, count(*) OVER (PARTITION BY l, r) AS n_shared
FROM co JOIN reps a ON a.ref = l JOIN reps b ON b.ref = r AND b.v = a.v)
SELECT l, r, n_shared, string_agg(CASE WHEN length(o) > 25 THEN substring(o, 1, 25) || '...(' || (length(o) - 25) || ' more chars)' ELSE o END, ' | ' ORDER BY rn) AS samples FROM m WHERE rn <= 5 GROUP BY ALL""",
)
def overlap_samples(spark, d):
    tally, _, pairs = _all(spark, d)
    return values.overlap_samples(cut(values.representatives(tally)), pairs, C.DB)


@query(
    "endpoint_samples",
    f"""{ALL}, s AS (SELECT l AS ref, r AS other, l, r FROM co UNION ALL SELECT r, l, l, r FROM co),
m AS (SELECT s.ref, s.other, a.v, row_number() OVER (PARTITION BY s.ref, s.other ORDER BY sha256('{C.DB}|' || l || '|' || r || '|' || s.ref || '|endpoint|' || a.v)) AS rn FROM s JOIN dom a ON a.ref = s.ref WHERE NOT EXISTS (SELECT 1 FROM dom b WHERE b.ref = s.other AND b.v = a.v))
SELECT ref, other, string_agg(CASE WHEN length(v) > 25 THEN substring(v, 1, 25) || '...(' || (length(v) - 25) || ' more chars)' ELSE v END, ' | ' ORDER BY rn) AS samples FROM m WHERE rn <= 5 GROUP BY ALL""",
)
def endpoint_samples(spark, d):
    _, domain, pairs = _all(spark, d)
    return values.endpoint_samples(domain, pairs, C.DB)
