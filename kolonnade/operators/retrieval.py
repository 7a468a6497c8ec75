"""Schema parts that a question needs: connections, filters by mention, option lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def special_columns(columns: DataFrame) -> DataFrame:
    """(ref): keys, unique columns, foreign keys and their targets."""
    own = columns.where("primary_key or uniq or fk_ref is not null").select("ref")
    return own.unionByName(columns.where("fk_ref is not null").select(F.col("fk_ref").alias("ref"))).distinct()


def mentioned(texts: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, ref): columns whose reference stands in a text, whatever the case and quotes.

    References in a text are cut out by pattern and joined, so a text meets only the columns it names.
    """
    found = F.regexp_extract_all(F.lower(F.regexp_replace("text", "[`\"\\[\\]]", "")), F.lit("[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*"), F.lit(0))
    keyed = texts.where("text is not null").select("id", F.explode(F.array_distinct(found)).alias("k"))
    return keyed.join(columns.select(F.lower("ref").alias("k"), "ref"), "k").select("id", "ref").distinct()


def filtered_schema(columns: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """Catalog rows whose reference is kept by any of the lists (ref), keys and their targets included; tables without a kept column of a list drop out."""
    named = reduce(DataFrame.unionByName, [k.select("ref") for k in kept]).distinct()
    tabs = columns.join(named, "ref", "left_semi").select("tab").distinct()
    refs = named.unionByName(special_columns(columns)).distinct()
    return columns.join(refs, "ref", "left_semi").join(tabs, "tab", "left_semi")


def schema_counts(columns: DataFrame) -> DataFrame:
    return columns.agg(F.countDistinct("tab").alias("n_tables"), F.count("*").alias("n_columns"))


def connections(columns: DataFrame, selected: DataFrame) -> DataFrame:
    """(ref): columns that connect the selected tables: their keys, foreign keys between them and the targets of those."""
    tabs = columns.join(selected.select("tab").distinct(), "tab", "left_semi")
    keys = tabs.where("primary_key").select("ref")
    links = tabs.where("fk_ref is not null").withColumn("to", F.split("fk_ref", "\\.", 2)[0])
    inside = links.join(selected.select(F.col("tab").alias("to")).distinct(), "to", "left_semi")
    return keys.unionByName(inside.select("ref")).unionByName(inside.select(F.col("fk_ref").alias("ref"))).distinct()


def first_each(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Of the rows that agree in `keys` the first in `order`."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def retrieval_audit(answers: DataFrame, columns: DataFrame) -> DataFrame:
    """(anchor, n, n_self, n_duplicate, n_unknown, n_kept) of proposed columns (anchor, pos, ref): itself, repeated and unknown ones are dropped and counted."""
    known = columns.select(F.lower("ref").alias("k")).distinct().withColumn("known", F.lit(True))
    rows = answers.withColumn("k", F.lower("ref")).join(known, "k", "left")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("anchor", "k").orderBy("pos")))
    own = F.col("k") == F.lower("anchor")
    return rows.groupBy("anchor").agg(
        F.count("*").alias("n"), F.count_if(own).alias("n_self"), F.count_if(~own & (F.col("nth") > 1)).alias("n_duplicate"),
        F.count_if(~own & (F.col("nth") == 1) & F.col("known").isNull()).alias("n_unknown"), F.count_if(~own & (F.col("nth") == 1) & F.col("known")).alias("n_kept"),
    )


def slices(options: DataFrame) -> DataFrame:
    """(db_id, anchor, slice, n_options, options): options (db_id, anchor, idx, option) by anchor, slices in the order of first appearance, each option once."""
    once = options.groupBy("db_id", "anchor", "option").agg(F.min("idx").alias("idx"))
    per = once.groupBy("db_id", "anchor").agg(F.min("idx").alias("first"), F.count("*").alias("n_options"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "option"))), lambda x: x.option), ",").alias("options"))
    return per.withColumn("slice", F.row_number().over(W.partitionBy("db_id").orderBy("first", "anchor"))).select("db_id", "anchor", "slice", "n_options", "options")


def deduplicated(entries: DataFrame, text: str, order: str) -> DataFrame:
    """Entries whose text, white space collapsed, did not come before; the first by `order` stays."""
    key = F.xxhash64(F.trim(F.regexp_replace(F.col(text), "\\s+", " ")))
    second = F.hash(F.trim(F.regexp_replace(F.col(text), "\\s+", " ")))
    return first_each(entries.where(F.col(text).isNotNull()), [key, second], [F.col(order)])


def choices(answers: DataFrame) -> DataFrame:
    """(entry_id, ingest_seq, choice_index, description, snippet): the choices of detection answers in JSON, packed with ids; empty ones are dropped, positions stay raw."""
    shape = "struct<ambiguous:boolean,choices:array<struct<nl_description:string,sql_snippet:string>>>"
    read = F.from_json("object", shape, {"allowUnquotedControlChars": "true"})
    rows = answers.select("ingest_seq", read.alias("x")).where("x.choices is not null").select("ingest_seq", F.posexplode("x.choices").alias("choice_index", "c"))
    kept = rows.where("trim(coalesce(c.nl_description, '')) <> ''")
    return kept.select(F.format_string("moda_%06d_%02d", "ingest_seq", F.col("choice_index") + 1).alias("entry_id"), "ingest_seq", "choice_index", F.col("c.nl_description").alias("description"), F.col("c.sql_snippet").alias("snippet"))


def components(values: DataFrame, columns: DataFrame) -> DataFrame:
    """(component, n_values, n_columns, missing): literals (value, ref) joined to the column entries (entry, ref) that have their column; a literal without an entry is missing."""
    joined = values.join(columns, "ref", "left")
    return joined.groupBy(F.coalesce("entry", F.concat(F.lit("missing:"), "ref")).alias("component")).agg(F.countDistinct("value").alias("n_values"), F.countDistinct("ref").alias("n_columns"), F.bool_or(F.col("entry").isNull()).alias("missing"))


def pruned(candidates: DataFrame, values: DataFrame) -> DataFrame:
    """Candidate columns (component, ref, source_ref) that stay when all literals of a component exist: the source column and those that hold one of the values (component, ref, existence)."""
    settled = values.groupBy("component").agg(F.bool_and(F.coalesce("existence", F.lit(False))).alias("settled"))
    held = values.select("component", "ref").distinct().withColumn("held", F.lit(True))
    rows = candidates.join(settled, "component", "left").join(held, ["component", "ref"], "left")
    keep = ~F.coalesce("settled", F.lit(False)) | (F.col("ref") == F.col("source_ref")) | F.coalesce("held", F.lit(False))
    return rows.where(keep).select("component", "ref", "source_ref")
