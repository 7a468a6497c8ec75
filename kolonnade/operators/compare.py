"""Results of SQL statements compared, whatever the order of columns and rows."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def run(spark: SparkSession, sql: str, limit: int | None = None, timeout_s: float | None = None) -> DataFrame:
    """A user's statement; with a timeout its jobs are tagged and interrupted when they take longer."""
    df = spark.sql(sql)
    df = df if limit is None else df.limit(limit)
    if timeout_s is None:
        return df
    import threading

    tag = f"run-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        rows = df.cache()
        rows.count()
        return rows
    finally:
        timer.cancel()
        spark.removeTag(tag)


def _cell(name: str, kind: str) -> Column:
    """A cell as text, so that 1, 1.0 and true are the same; nulls keep apart.

    Decimals keep all their digits, doubles are equal if they are the same number.
    """
    c = F.col(f"`{name}`")
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint"):
        c = c.cast("bigint")
    elif kind.startswith("decimal"):
        digits = F.regexp_replace(F.translate(F.format_number(c, 38), ",", ""), "\\.?0+$", "")
        return F.when(c.isNull(), "\0").otherwise(F.when(digits == "-0", "0").otherwise(digits))
    elif kind in ("float", "double"):
        # Beyond 2**53 doubles are whole anyway; up to there they are the same text as integers.
        whole = (c == F.floor(c)) & (F.abs(c) < 2.0**53)
        c = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("\0"))


def canonical(df: DataFrame) -> DataFrame:
    """The rows with cells as text, columns named c0, c1, ..."""
    return df.toDF(*[f"x{i}" for i in range(len(df.columns))]).select(*[_cell(f"x{i}", t).alias(f"c{i}") for i, (_, t) in enumerate(df.dtypes)])


def fingerprints(df: DataFrame) -> tuple[int, list[tuple]]:
    """Number of different rows, and for each column what no order of rows changes: one aggregate over the distinct rows."""
    n = len(df.columns)
    aggs = [x for i in range(n) for x in (F.sum(F.xxhash64(f"c{i}").cast("decimal(38,0)")).alias(f"s{i}"), F.bit_xor(F.hash(f"c{i}")).alias(f"b{i}"))]
    row = df.distinct().agg(F.count("*").alias("n"), *aggs).first()
    return row["n"], [(row[f"s{i}"], row[f"b{i}"]) for i in range(n)]


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def equal_results(gold: DataFrame, pred: DataFrame, superset: bool = False, most: int = 720) -> bool:
    """Whether the sets of rows agree under some order of the columns; with `superset` the prediction may have more columns.

    Only orders that match columns by their fingerprints are tried, `most` of them; two empty results are equal.
    """
    a, b = canonical(gold), canonical(pred)
    if not superset and len(a.columns) != len(b.columns) or len(a.columns) > len(b.columns):
        return a.isEmpty() and b.isEmpty()
    na, fa = fingerprints(a)
    if superset and len(a.columns) < len(b.columns):
        options = [[j for j in range(len(b.columns))] for _ in fa]
    else:
        nb, fb = fingerprints(b)
        if na != nb:
            return False
        if na == 0:
            return True
        options = [[j for j, f in enumerate(fb) if f == mine] for mine in fa]
    tried = 0
    for order in itertools.product(*options):
        if len(set(order)) < len(order):
            continue
        if same_rows(a, b.select(*[F.col(f"c{j}").alias(f"c{i}") for i, j in enumerate(order)])):
            return True
        tried += 1
        if tried >= most:
            raise ValueError("more orders of columns than allowed fit the fingerprints")
    return False


def loop_equal(gold_sql: str, gold: DataFrame, pred: DataFrame) -> bool:
    """The looser comparison of the repair loop: as many rows, cells of a row in any order; rows in order only if the gold text sorts."""
    def rows(df: DataFrame) -> DataFrame:
        c = canonical(df)
        return c.select(F.array_sort(F.array(*[F.col(x) for x in c.columns])).alias("r"))

    a, b = rows(gold), rows(pred)
    if a.count() != b.count():
        return False
    if "ORDER BY" in gold_sql.upper():
        return all(x == y for x, y in zip(a.toLocalIterator(), b.toLocalIterator()))
    return same_rows(a, b)


def result_print(df: DataFrame) -> tuple:
    """What identifies a result: number of different rows and, without order, the prints of its columns."""
    n, cols = fingerprints(canonical(df))
    return n, tuple(sorted(map(str, cols)))


def clusters(spark: SparkSession, statements: Sequence[tuple[int, str]]) -> DataFrame:
    """(cluster, n, chosen_id, chosen_sql): statements with equal results, the largest cluster first; of each the shortest statement is chosen. Failing ones are left out."""
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for i, sql in statements:
        try:
            groups.setdefault(result_print(spark.sql(sql)), []).append((i, sql))
        except Exception:  # noqa: BLE001 - a statement that fails has no result
            continue
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(i for i, _ in g)))
    rows = [(k, len(g), *min(g, key=lambda x: (len(x[1]), x[0]))) for k, g in enumerate(ranked)]
    return spark.createDataFrame(rows, "cluster int, n int, chosen_id int, chosen_sql string")


def accuracy(verdicts: DataFrame) -> DataFrame:
    """(n, n_correct, accuracy) of (question_id, correct)."""
    return verdicts.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def validated(spark: SparkSession, sql: str, most: int = 30) -> dict:
    """{SQL, RESULT, STATUS}: the first rows of a statement, or its error."""
    try:
        return {"SQL": sql, "RESULT": [tuple(r) for r in spark.sql(sql).limit(most).collect()], "STATUS": "OK"}
    except Exception as e:  # noqa: BLE001 - the error is the result
        return {"SQL": sql, "RESULT": str(e).split("\n")[0], "STATUS": "ERROR"}


def status(pred: DataFrame, gold: DataFrame) -> str:
    """EMPTY, CORRECT or INCORRECT."""
    return "EMPTY" if pred.isEmpty() else "CORRECT" if equal_results(gold, pred) else "INCORRECT"


class PrintCache:
    """Prints of results by statement; of more than `size` the one not used for longest goes."""

    def __init__(self, size: int = 1000):
        self.size = size
        self.known: dict[str, tuple] = {}

    def get(self, spark: SparkSession, sql: str) -> tuple:
        found = self.known.pop(sql, None) or result_print(spark.sql(sql))
        self.known[sql] = found
        if len(self.known) > self.size:
            self.known.pop(next(iter(self.known)))
        return found
