"""Vector channels: exact search of a stated query set, pair selection, embedding documents and cache.

Exact search takes the queries in blocks: a block of query vectors, of bounded size, is held by every task
while the collection streams past once; each task keeps the best k of a query, the best of all tasks are
merged. For all vectors against all vectors use an approximate search instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null for different lengths or a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in column])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row an id; null, empty, zero and non-finite vectors are left out, of several the least is taken."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine).groupBy("id").agg(F.min("v").alias("v"))


def search(queries: DataFrame, collection: DataFrame, k: int | None = None, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(q, c, cosine): for every query (id, v) the best `k` of the collection (id, v), itself left out, with cosine of at least `floor`.

    Order: cosine rounded to six places, descending, then id. Vectors of another length than the query's take no part.
    """
    counted = queries.withColumn("h", F.xxhash64("id"))
    n = counted.count()
    blocks = max(1, -(-n // block))
    out: DataFrame | None = None
    for b in range(blocks):
        rows = counted.where(F.pmod("h", F.lit(blocks)) == b).select("id", "v").collect()  # about `block` vectors
        sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r["v"]) for r in rows}:
            mine = [r for r in rows if len(r["v"]) == size]
            sizes[size] = (np.array([r["id"] for r in mine]), _matrix(pd.Series([r["v"] for r in mine])))

        def best(frames: Iterator[pd.DataFrame], sizes=sizes) -> Iterator[pd.DataFrame]:
            for f in frames:
                size = f["v"].map(len)
                for s, part in f.groupby(size):
                    if s not in sizes:
                        continue
                    ids, m = sizes[s]
                    sims = np.round(_matrix(part["v"]) @ m.T, 6)
                    keep = sims >= (floor if floor is not None else -2)
                    if k is not None and len(part) > 4 * k:
                        # ties at the edge stay; the exact cut follows after the merge
                        edge = -np.partition(-sims, k, axis=0)[k]
                        keep &= sims >= edge
                    i, j = np.nonzero(keep)
                    yield pd.DataFrame({"q": ids[j], "c": part["id"].to_numpy()[i], "cosine": sims[i, j]})

        id_type = queries.schema["id"].dataType.simpleString()
        found = collection.select("id", "v").mapInPandas(best, f"q {id_type}, c {collection.schema['id'].dataType.simpleString()}, cosine double")
        out = found if out is None else out.unionByName(found)
    out = out.where("q <> c")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "c")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hybrid(ranked: DataFrame, k: int, floor: float) -> DataFrame:
    """Ranked pairs that are among the best `k` and reach `floor`."""
    return ranked.where((F.col("rank") <= k) & (F.col("cosine") >= floor))


def symmetric(ranked: DataFrame) -> DataFrame:
    """(l, r, cosine, rank): unordered pairs with the better of both directions."""
    return ranked.groupBy(F.least("q", "c").alias("l"), F.greatest("q", "c").alias("r")).agg(F.max("cosine").alias("cosine"), F.min("rank").alias("rank"))


# -- documents of embeddings and their cache ---------------------------------------------------------

RECORD_VERSION = "schema_text_v0"


def _tidy(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), F.lit(""))


def embedding_documents(profiles: DataFrame) -> DataFrame:
    """(db_id, column_id, view, text, digest): three texts a column: rich, descriptive name only, raw name only.

    `profiles`: (db_id, column_ref, tab, col, descriptive_name, column_description); repeated rows count once;
    fields without text leave no line; a text without any line is empty.
    """
    rows = profiles.select("db_id", "column_ref", "tab", "col", "descriptive_name", "column_description").where("column_ref is not null").distinct()
    line = lambda label, c: F.concat(F.lit(label + ": "), _tidy(F.col(c)))
    rich = F.concat_ws("\n", line("table name", "tab"), line("column name", "col"), line("column descriptive name", "descriptive_name"), line("column description", "column_description"))
    views = F.map_from_arrays(F.array(F.lit("rich"), F.lit("descriptive_name"), F.lit("surface_name")), F.array(rich, F.coalesce(_tidy(F.col("descriptive_name")), F.lit("")), F.coalesce(_tidy(F.col("col")), F.lit(""))))
    return rows.select("db_id", F.col("column_ref").alias("column_id"), F.explode(views).alias("view", "text")).withColumn("digest", F.sha2("text", 256)).distinct()


def query_text(c: Column, instruction: str) -> Column:
    """A document wrapped into an instruction, as asked of asymmetric models."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), c)


def audit(documents: DataFrame, forbidden: tuple[str, ...] = ("value:", "sample:"), longest: int = 2000) -> DataFrame:
    """(view, n, n_empty, n_duplicate_ids, n_forbidden, n_long, max_length)."""
    twice = documents.groupBy("view", "db_id", "column_id").agg(F.count("*").alias("n")).groupBy("view").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_duplicate_ids"))
    banned = F.lit(False)
    for f in forbidden:
        banned = banned | F.lower("text").contains(f)
    per = documents.groupBy("view").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("n_empty"), F.count_if(banned).alias("n_forbidden"), F.count_if(F.length("text") > longest).alias("n_long"), F.max(F.length("text")).alias("max_length"))
    return per.join(twice, "view").select("view", "n", "n_empty", "n_duplicate_ids", "n_forbidden", "n_long", "max_length")


def valid_cache(cache: DataFrame, keys: tuple[str, ...], records: DataFrame) -> DataFrame:
    """Cached vectors that match a record in all keys; of several the last by `vec_id`."""
    match = cache.join(records.select(*keys).distinct(), list(keys))
    return match.groupBy(*keys).agg(F.max_by("embedding", "vec_id").alias("embedding"), F.max("vec_id").alias("vec_id"))


def missing_from_cache(records: DataFrame, cache: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Records without a cached vector."""
    return records.join(cache.select(*keys), list(keys), "left_anti")


def fill(records: DataFrame, embed, batch: int = 32) -> DataFrame:
    """(column_id, text, embedding): vectors from a provider, `embed(list[str]) -> list[list[float]]`, in batches where the rows lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                got = embed(part["text"].tolist())
                if len(got) != len(part):
                    raise ValueError("the provider returned another number of vectors than texts")
                yield part.assign(embedding=got)

    return records.select("column_id", "text").mapInPandas(run, "column_id string, text string, embedding array<double>")
