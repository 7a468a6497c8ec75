"""Queries of the problems on training data: name -> callable; SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kolonnade.llm import answers, groups, languages, leakage, mixture, neighbours, setjoin, truncation
from kolonnade.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(12288)"


def _ref(side: str) -> str:
    return f"nullif(lower(trim({side}.tab, {_BLANKS})), '') || '.' || nullif(lower(trim({side}.col, {_BLANKS})), '')"


@query(
    "p3_found",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT nullif(lower(trim(db_id, {_BLANKS})), '') AS db_id, {_ref("col1")} AS l, {_ref("col2")} AS r FROM accepted_edges
WHERE db_id IS NOT NULL AND {_ref("col1")} IS NOT NULL AND {_ref("col2")} IS NOT NULL),
b AS (SELECT db_id, l, r FROM e UNION SELECT db_id, r, l FROM e),
w(db_id, column_ref, reached) AS (SELECT db_id, l, l FROM b UNION SELECT w.db_id, w.column_ref, b.r FROM w JOIN b ON b.db_id = w.db_id AND b.l = w.reached)
SELECT db_id, column_ref, min(reached) AS group_ref FROM w GROUP BY db_id, column_ref""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.link_groups(table(spark, sf_dir, "accepted_edges"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf_dir, "column_vectors"))


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_domains(table(spark, sf_dir, "value_domains"))


@query("p6_classes")
def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.domain_classes(table(spark, sf_dir, "value_domains"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.relabelled(table(spark, sf_dir, "documents"))


@query("p9_segments")
def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_stretches(table(spark, sf_dir, "documents")).distinct()


@query("p9_documents")
def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(table(spark, sf_dir, "documents"))


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "batch_responses"), table(spark, sf_dir, "column_profiles"))


@query("p1_rates")
def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "batch_responses"), table(spark, sf_dir, "column_profiles"))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.defective(table(spark, sf_dir, "batch_responses"), table(spark, sf_dir, "batch_requests"), table(spark, sf_dir, "column_profiles"))


@query("p8_selection")
def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]
