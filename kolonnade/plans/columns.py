"""The driver's relational tables as a database under study: columns, declared keys, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kolonnade.session import table
from kolonnade.sources.catalog import Constraints, catalog, unpivoted

#: Columns whose values are studied; floating point, times and long texts have no portable text form.
STUDIED = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
    "events": ("event_id", "user_id", "event_type", "props"),
    "documents": ("doc_id", "lang", "source", "n_chars", "doc_kind", "db_id"),
}
NUMBERS = {"r_regionkey", "n_nationkey", "n_regionkey", "c_custkey", "c_nationkey", "s_suppkey", "s_nationkey", "p_partkey", "p_size", "o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "event_id", "user_id", "doc_id", "n_chars"}
DECLARED = Constraints(
    primary={"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"]},
    foreign={"nation.n_regionkey": "region", "customer.c_nationkey": "nation", "supplier.s_nationkey": "nation", "orders.o_custkey": "customer", "lineitem.l_orderkey": "orders", "lineitem.l_partkey": "part", "lineitem.l_suppkey": "supplier"},
)
DB = "driver"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t).select(*cols) for t, cols in STUDIED.items()}


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(tables(spark, sf_dir), DECLARED)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivoted(tables(spark, sf_dir), STUDIED)


def values_sql() -> str:
    """`u` as SQL: (ref, v)."""
    return " UNION ALL ".join(f"SELECT '{t}.{c}' AS ref, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in sorted(STUDIED.items()) for c in cols)


def _text(x: object) -> str:
    return "NULL" if x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else f"'{x}'"


def columns_sql() -> str:
    """`cols` as SQL: the rows of the catalog."""
    rows = []
    for t, cols in sorted(STUDIED.items()):
        for i, c in enumerate(cols):
            f = DECLARED.facts(t, c)
            rows.append((t, c, f"{t}.{c}", i, "integer" if c in NUMBERS else "text", f["primary_key"], f["not_null"], f["uniq"], f["fk_ref"]))
    body = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS c(tab, col, ref, ordinal, data_type, primary_key, not_null, uniq, fk_ref)"
