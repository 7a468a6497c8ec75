"""Queries of the core: name -> (callable, SQL for the check or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kolonnade.operators.delivery import redelivered
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

_P2_FEED = """SELECT '{t}' AS feed, lower(trim({k}, {b})) AS message_id, coalesce({good}, false) AS good, ingest_seq FROM {t}
WHERE {k} IS NOT NULL AND trim({k}, {b}) <> ''"""


@query(
    "p2_found",
    f"""WITH feed AS ({_P2_FEED.format(t="verifier_decisions", k="candidate_id", good="status = 'OK'", b=_BLANKS)}
UNION ALL {_P2_FEED.format(t="batch_responses", k="request_id", good="ok", b=_BLANKS)})
SELECT feed, message_id, coalesce(max(ingest_seq) FILTER (WHERE good), max(ingest_seq)) AS kept_seq
FROM feed GROUP BY feed, message_id HAVING count(*) > 1""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(table(spark, sf_dir, "verifier_decisions"), table(spark, sf_dir, "batch_responses"))
