"""A folder of Parquet tables as one database: catalog, declared constraints, unpivoted values, DDL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kolonnade.session import table

#: Types of the relational model for Spark's types.
DECLARED = {"string": "text", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "boolean": "boolean"}

CATALOG = T.StructType([T.StructField(n, t) for n, t in (("tab", T.StringType()), ("col", T.StringType()), ("ref", T.StringType()), ("ordinal", T.IntegerType()), ("data_type", T.StringType()), ("primary_key", T.BooleanType()), ("not_null", T.BooleanType()), ("uniq", T.BooleanType()), ("fk_ref", T.StringType()))])


def declared_type(kind: str) -> str:
    return DECLARED.get(kind, "timestamp" if kind.startswith("timestamp") else "text" if kind.startswith(("varchar", "char")) else kind)


def split_ref(c: Column) -> tuple[Column, Column]:
    """Table and column of `table.column`, split at the first dot (columns may hold dots), both trimmed."""
    parts = F.split(c, "\\.", 2)
    return F.trim(parts[0]), F.trim(F.element_at(parts, 2))


class Constraints:
    """Declared keys: `primary` table -> columns, `foreign` ref -> target table or ref, `unique` refs."""

    def __init__(self, primary: dict[str, Sequence[str]] = {}, foreign: dict[str, str] = {}, unique: Sequence[str] = ()):
        self.primary = {t: tuple(c) for t, c in primary.items()}
        self.foreign, self.unique = dict(foreign), set(unique)

    def single_key(self, tab: str) -> str | None:
        """The one column of a table's primary key; None for composite keys."""
        key = self.primary.get(tab, ())
        return key[0] if len(key) == 1 else None

    def target(self, ref: str) -> str | None:
        """The column a foreign key points to; a bare table means its single primary key."""
        to = self.foreign.get(ref)
        if to is None or "." in to:
            return to
        key = self.single_key(to)
        return f"{to}.{key}" if key else None

    def facts(self, tab: str, col: str) -> dict:
        ref, key = f"{tab}.{col}", self.primary.get(tab, ())
        return {"primary_key": col in key, "not_null": col in key, "uniq": ref in self.unique or (col,) == key, "fk_ref": self.target(ref)}


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder, sorted; hidden and system names are left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n[:-8] for n in names if n.endswith(".parquet") and not n.startswith((".", "_", "sqlite_")))


def load_database(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a folder, registered as temporary views of their names."""
    found = {n: table(spark, folder, n) for n in (names or table_names(spark, folder))}
    for n, df in found.items():
        df.createOrReplaceTempView(n)
    return found


def catalog(tables: dict[str, DataFrame], constraints: Constraints = Constraints()) -> DataFrame:
    """One row per column, in order; see `CATALOG`. Only schemas are read. Without tables the result is empty."""
    rows = [
        {"tab": t, "col": f.name, "ref": f"{t}.{f.name}", "ordinal": i, "data_type": declared_type(f.dataType.simpleString()), **constraints.facts(t, f.name)}
        for t, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    return spark.createDataFrame([tuple(r[f.name] for f in CATALOG) for r in rows], CATALOG)


def unpivot(tab: str, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(ref, v): all values of the columns as text, nulls included, in one scan."""
    pairs = [x for c in cols for x in (F.lit(f"{tab}.{c}"), F.col(f"`{c}`").cast("string"))]
    return df.select(F.stack(F.lit(len(cols)), *pairs).alias("ref", "v"))


def unpivoted(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(ref, v) of several tables."""
    return reduce(DataFrame.unionByName, [unpivot(t, tables[t], cols) for t, cols in sorted(columns.items())])


def schema_map(columns: DataFrame) -> DataFrame:
    """(key, ref): spelled references by their lower-case form; of several spellings the least."""
    return columns.groupBy(F.lower("ref").alias("key")).agg(F.min("ref").alias("ref"))


def ddl(columns: DataFrame) -> DataFrame:
    """(tab, ddl): a CREATE TABLE statement per table from catalog rows, columns in order."""
    line = F.concat(F.lit('  "'), "col", F.lit('" '), "data_type", F.when(F.col("not_null"), " NOT NULL").otherwise(""), F.when(F.col("uniq") & ~F.col("primary_key"), " UNIQUE").otherwise(""))
    tab, col = split_ref(F.col("fk_ref"))
    link = F.when(F.col("fk_ref").isNotNull(), F.concat(F.lit('  FOREIGN KEY ("'), "col", F.lit('") REFERENCES "'), tab, F.lit('" ("'), col, F.lit('")')))
    per = columns.groupBy("tab").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", line.alias("x")))).x.alias("lines"),
        F.array_compact(F.sort_array(F.collect_list(F.struct("ordinal", F.when(F.col("primary_key"), F.concat(F.lit('"'), "col", F.lit('"'))).alias("x")))).x).alias("key"),
        F.array_compact(F.sort_array(F.collect_list(F.struct("ordinal", link.alias("x")))).x).alias("links"),
    )
    key = F.when(F.size("key") > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join("key", ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat("lines", key, "links"), ",\n")
    return per.select("tab", F.concat(F.lit('CREATE TABLE "'), "tab", F.lit('" (\n'), body, F.lit("\n)")).alias("ddl"))


def unique_keys(profile: DataFrame) -> DataFrame:
    """Columns whose values are all different and never null, from profile rows (ref, row_count, non_null_count, distinct_count)."""
    return profile.where("row_count > 0 and non_null_count = row_count and distinct_count = row_count").select("ref", "row_count")


def inclusion_dependencies(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(child_ref, parent_ref, n_values): columns all of whose distinct values stand in a unique column.

    `values`: distinct (ref, v) without nulls; `keys`: unique columns (ref). Joined on the values.
    """
    parents = values.join(keys.select("ref"), "ref", "left_semi").select(F.col("ref").alias("parent_ref"), "v")  # one row a column
    sizes = values.groupBy(F.col("ref").alias("child_ref")).agg(F.count("*").alias("n_values"))
    hits = values.select(F.col("ref").alias("child_ref"), "v").join(parents, "v").where("child_ref <> parent_ref").groupBy("child_ref", "parent_ref").agg(F.count("*").alias("hits"))
    return hits.join(sizes, "child_ref").where("hits = n_values").select("child_ref", "parent_ref", "n_values")


def parse_ddl(text: str) -> list[tuple[str, str | None, str, str]]:
    """(table, column, kind, definition) of the CREATE TABLE statements in a text; kind is `column` or `constraint`.

    Commas and parentheses inside quotes and parentheses don't part definitions.
    """
    out: list[tuple[str, str | None, str, str]] = []
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?(\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[\w.]+)\s*\(", text, re.I):
        depth, quote, start, parts, end = 1, "", m.end(), [], m.end()
        for at in range(m.end(), len(text)):
            ch = text[at]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"`":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if not depth:
                    end = at
                    break
            elif ch == "," and depth == 1:
                parts.append(text[start:at])
                start = at + 1
        if depth:
            continue
        for part in (p.strip() for p in [*parts, text[start:end]]):
            if re.match(r"(?:constraint|primary\s+key|foreign\s+key|unique|check)\b", part, re.I):
                out.append((m[1].strip('"`[]'), None, "constraint", part))
            elif c := re.match(r"(\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|\w+)\s*(.*)\Z", part, re.S):
                out.append((m[1].strip('"`[]'), c[1].strip('"`[]'), "column", c[2].strip()))
    return out
