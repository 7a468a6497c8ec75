"""File sources and sinks: CSV with unknown encoding, JSON lines, embedding and prediction files, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1", "utf-16", "gb18030", "big5")

DOCUMENTATION = T.StructType([T.StructField(n, T.StringType()) for n in ("original_column_name", "column_name", "column_description", "data_format", "value_description")])


@F.udf(T.StringType())
def _decoded(content: bytes) -> str | None:
    """Text under the first encoding that fits; latin-1 fits everything, so UTF-16 is told by its mark."""
    if content is None:
        return None
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    for name in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, row map<string,string>): every row of the CSV files under `path`, by header, whatever the encoding.

    Files are decoded where they lie, one task a file; they are documentation files of a page or two.
    """
    import csv
    import io

    def rows(frames):
        import pandas as pd

        for f in frames:
            out = [(name, {k: v for k, v in r.items() if k is not None and v is not None}) for name, text in zip(f["file"], f["text"]) for r in csv.DictReader(io.StringIO(text, newline=""))]
            yield pd.DataFrame(out, columns=["file", "row"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1).alias("file"), _decoded("content").alias("text"))
    return files.where("text is not null").mapInPandas(rows, "file string, row map<string,string>")


def tidy_description(c: Column) -> Column:
    """Line breaks to blanks, the lead-in of commonsense notes dropped, trimmed; null becomes empty."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")
    return F.trim(F.regexp_replace(flat, "(?i)commonsense evidence:", ""))


def column_documentation(rows: DataFrame) -> DataFrame:
    """(tab, col, column_name, column_description, data_format, value_description) from `read_csv_any`; rows without a column are left out."""
    get = lambda k: F.element_at("row", k)
    return rows.select(
        F.col("file").alias("tab"), F.trim(get("original_column_name")).alias("col"),
        *[tidy_description(get(k)).alias(k) for k in ("column_name", "column_description", "data_format", "value_description")],
    ).where("col is not null and col <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines under an explicit schema. Bad lines fail the read, or are left out if `tolerant`."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append as JSON lines; the committer makes a job's rows visible together."""
    df.write.mode("append").json(path)


def embedding_rows(rows: DataFrame) -> DataFrame:
    """(id, embedding) of embedding files that name the vector `embedding` or `vector`; a missing id or vector is an error."""
    have = [c for c in ("embedding", "vector") if c in rows.columns]
    vector = F.coalesce(*[F.col(c).cast("array<double>") for c in have])
    key = F.coalesce(*[F.col(c).cast("string") for c in ("column_id", "id") if c in rows.columns])
    good = key.isNotNull() & (F.trim(key) != "") & vector.isNotNull() & (F.size(vector) > 0)
    return rows.select(F.when(good, key).otherwise(F.raise_error(F.lit("embedding row without id or vector"))).alias("id"), vector.alias("embedding"))


def predictions(rows: DataFrame) -> DataFrame:
    """(question_id, sqls): predictions by question from rows of {question_id or id, pred or SQL or pred_sql}; other keys than integers are left out."""
    pick = lambda names: F.coalesce(*([F.col(f"`{c}`").cast("string") for c in names if c in rows.columns] or [F.lit(None).cast("string")]))
    flat = rows.select(F.expr("try_cast(k as bigint)").alias("question_id"), "sql") if set(rows.columns) == {"k", "sql"} else rows.select(pick(("question_id", "id")).alias("k"), pick(("pred", "SQL", "pred_sql")).alias("sql")).select(F.expr("try_cast(k as bigint)").alias("question_id"), "sql")
    return flat.where("question_id is not null and sql is not null").groupBy("question_id").agg(F.sort_array(F.collect_set("sql")).alias("sqls"))


def subset(rows: DataFrame, ids: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows named by (pos, question_id), in the order of `pos`, with offset and limit."""
    out = rows.join(ids, "question_id").orderBy("pos").offset(offset)
    return out if limit is None else out.limit(limit)


def sampled(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A seeded sample of rows: each row by a hash of its content, so the choice doesn't depend on partitions."""
    share = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]), F.lit(1_000_000))
    return df.where(share < int(fraction * 1_000_000))


def descriptive_name_audit(names: DataFrame, columns: DataFrame) -> DataFrame:
    """(ref, problem): missing, unexpected, duplicate and empty descriptive names against the catalog; names: (ref, descriptive_name)."""
    key = lambda df: df.select(F.lower("ref").alias("k"), "ref")
    missing = key(columns).join(key(names).select("k"), "k", "left_anti").select("ref", F.lit("missing").alias("problem"))
    unexpected = key(names).join(key(columns).select("k"), "k", "left_anti").select("ref", F.lit("unexpected").alias("problem"))
    duplicate = names.groupBy(F.lower("ref").alias("k")).agg(F.min("ref").alias("ref"), F.count("*").alias("n")).where("n > 1").select("ref", F.lit("duplicate").alias("problem"))
    empty = names.where("descriptive_name is null or trim(descriptive_name) = ''").select("ref", F.lit("empty").alias("problem"))
    return missing.unionByName(unexpected).unionByName(duplicate).unionByName(empty).distinct()


def manifest(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """(name, sha256) of small input texts, for the manifest beside an artifact."""
    return spark.createDataFrame([(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in files], "name string, sha256 string")
