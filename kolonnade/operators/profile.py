"""Column profiles: counts, exact length percentiles, samples, semantic modes and labels.

Input everywhere: (ref, v) with all values of all columns as text, nulls included, or the same tallied as
(ref, v, n); one scan a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.session import cut

SAMPLES, SAMPLE_CHARS, FETCHED = 5, 120, 40


def tallied(values: DataFrame) -> DataFrame:
    """(ref, v, n): how often each value occurs. Keyed by the value, so a column with many values is no hot group."""
    return values if "n" in values.columns else values.groupBy("ref", "v").agg(F.count("*").alias("n"))


def counts(values: DataFrame) -> DataFrame:
    """(ref, row_count, non_null_count, null_count, null_fraction, distinct_count, distinct_ratio)."""
    per = tallied(values)
    agg = per.groupBy("ref").agg(F.sum("n").alias("row_count"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"), F.count("v").alias("distinct_count"))
    nulls = F.col("row_count") - F.col("non_null_count")
    return agg.select(
        "ref", "row_count", "non_null_count", nulls.alias("null_count"), F.round(nulls / F.col("row_count"), 6).alias("null_fraction"), "distinct_count",
        F.round(F.when(F.col("non_null_count") > 0, F.col("distinct_count") / F.col("non_null_count")).otherwise(0.0), 6).alias("distinct_ratio"),
    )


def lengths(values: DataFrame) -> DataFrame:
    """(ref, p10, p50, p90): exact length percentiles with linear interpolation; null without values.

    Percentiles are taken of the histogram of lengths, which is as small as the range of lengths.
    """
    times = F.col("n") if "n" in values.columns else F.lit(1)
    histogram = values.groupBy("ref", F.length("v").alias("size")).agg(F.sum(times).alias("f"))
    return histogram.groupBy("ref").agg(F.expr("percentile(size, array(0.1, 0.5, 0.9), f)").alias("p")).select("ref", *[F.round(F.col("p")[i], 6).alias(x) for i, x in enumerate(("p10", "p50", "p90"))])


def samples(values: DataFrame, limit: int = SAMPLES, max_chars: int = SAMPLE_CHARS, fetched: int = FETCHED) -> DataFrame:
    """(ref, pos, value): the first `limit` clean distinct values in order of value, of the first `fetched`.

    Clean: white space collapsed and trimmed, not empty, not longer than `max_chars`, each once. Columns
    without clean values have no rows.
    """
    distinct = values.where("v is not null").select("ref", "v").distinct()
    first = distinct.withColumn("rn", F.row_number().over(W.partitionBy("ref").orderBy("v"))).where(F.col("rn") <= fetched)
    clean = first.withColumn("value", F.trim(F.regexp_replace("v", "\\s+", " "))).where((F.col("value") != "") & (F.length("value") <= max_chars))
    once = clean.groupBy("ref", "value").agg(F.min("rn").alias("rn"))
    return once.withColumn("pos", F.row_number().over(W.partitionBy("ref").orderBy("rn"))).where(F.col("pos") <= limit).select("ref", "pos", "value")


#: Domains that read as yes and no.
BOOLEANS = (("0", "1"), ("true", "false"), ("yes", "no"), ("y", "n"))


def value_mode(name: Column, kind: Column, distinct: Column, ratio: Column, boolean: Column) -> Column:
    """Semantic mode of a column; the first rule that applies."""
    n, t = F.lower(name), F.lower(kind)
    return (
        F.when(boolean, "BOOLEAN_LIKE")
        .when(n.rlike("uuid| id|_id|code|key|id$"), "CODE_OR_IDENTIFIER")
        .when(n.contains("date") | t.contains("date") | t.contains("time"), "DATE_LIKE")
        .when(t.rlike("int|real|numeric|double|float|decimal"), "NUMERIC_MEASURE")
        .when((distinct >= 2) & (distinct <= 10), "LOW_CARD_DOMAIN")
        .when((ratio >= 0.95) & (distinct >= 20), "CODE_OR_IDENTIFIER")
        .when(t.contains("text") | t.contains("char") | (t == ""), "LABEL_TEXT")
        .otherwise("OTHER")
    )


def boolean_columns(values: DataFrame) -> DataFrame:
    """(ref, boolean): whether the non-blank values, at most 20 distinct, all lie in one boolean domain."""
    small = F.lower(F.trim("v"))
    per = tallied(values).where("v is not null")
    tests = [F.bool_and(small.isin(*d) | (small == "")) for d in BOOLEANS]
    flat = per.groupBy("ref").agg(F.count("*").alias("n"), F.count_if(small != "").alias("filled"), *[t.alias(f"b{i}") for i, t in enumerate(tests)])
    return flat.select("ref", ((F.col("n") <= 20) & (F.col("filled") > 0) & (F.col("b0") | F.col("b1") | F.col("b2") | F.col("b3"))).alias("boolean"))


def modes(values: DataFrame, columns: DataFrame) -> DataFrame:
    """(ref, value_mode) for catalog rows (ref, col, data_type)."""
    values = values if "n" in values.columns else cut(tallied(values))
    joined = columns.select("ref", "col", "data_type").join(counts(values), "ref", "left").join(boolean_columns(values), "ref", "left")
    return joined.select("ref", value_mode(F.col("col"), F.col("data_type"), F.coalesce("distinct_count", F.lit(0)), F.coalesce("distinct_ratio", F.lit(0.0)), F.coalesce("boolean", F.lit(False))).alias("value_mode"))


#: Labels of modes.
MODE_LABELS = {
    "BOOLEAN_LIKE": "boolean-like categorical value",
    "CODE_OR_IDENTIFIER": "code or identifier",
    "DATE_LIKE": "date or time value",
    "NUMERIC_MEASURE": "numeric measure",
    "LOW_CARD_DOMAIN": "low-cardinality categorical label",
    "LABEL_TEXT": "text label",
}


def semantics(mode: Column, primary: Column, unique: Column, foreign: Column, ratio: Column, nulls: Column, p50: Column) -> Column:
    """Labels of a column's values, joined by `; `."""
    named = F.lit("other schema value")
    for m, text in MODE_LABELS.items():
        named = F.when(mode == m, text).otherwise(named)
    text = mode == "LABEL_TEXT"
    return F.concat_ws(
        "; ", named, F.when(primary, "primary key"), F.when(unique, "unique column"), F.when(foreign, "foreign key column"),
        F.when(ratio >= 0.95, "mostly unique values").when((ratio > 0) & (ratio <= 0.05), "many repeated values"),
        F.when(nulls >= 0.9, "high-null column").when(nulls <= 0.01, "mostly populated column"),
        F.when(text & (p50 >= 80), "long free-form text").when(text & (p50 >= 0) & (p50 <= 32), "short text label"),
    )


def profile(values: DataFrame, columns: DataFrame) -> DataFrame:
    """The whole profile: catalog rows with counts, percentiles, mode, semantics and samples."""
    values = values if "n" in values.columns else cut(tallied(values))
    listed = samples(values).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).value.alias("sample_values"))
    out = columns.join(counts(values), "ref", "left").join(lengths(values), "ref", "left").join(boolean_columns(values), "ref", "left").join(listed, "ref", "left")
    mode = value_mode(F.col("col"), F.col("data_type"), F.coalesce("distinct_count", F.lit(0)), F.coalesce("distinct_ratio", F.lit(0.0)), F.coalesce("boolean", F.lit(False)))
    out = out.withColumn("value_mode", mode).drop("boolean")
    label = semantics(F.col("value_mode"), F.col("primary_key"), F.col("uniq"), F.col("fk_ref").isNotNull(), F.coalesce("distinct_ratio", F.lit(0.0)), F.coalesce("null_fraction", F.lit(0.0)), F.coalesce("p50", F.lit(-1.0)))
    return out.withColumn("semantics", label)


def live_stats(values: DataFrame) -> DataFrame:
    """(ref, is_categorical, statistics): categorical below 20 distinct values, a null counting as one."""
    c = counts(values)
    return c.select("ref", (F.col("distinct_count") + (F.col("null_count") > 0).cast("int") < 20).alias("is_categorical"), F.format_string("Total count %d - Distinct count %d - Null count %d", "row_count", "distinct_count", "null_count").alias("statistics"))


def example_budget(values: DataFrame, limit: int = 5, budget: int = 100) -> DataFrame:
    """(ref, n_examples, examples): the longest run of the first `limit` values whose lengths add up to `budget` at most."""
    first = values.where("v is not null").select("ref", "v").distinct().withColumn("rn", F.row_number().over(W.partitionBy("ref").orderBy("v"))).where(F.col("rn") <= limit)
    kept = first.withColumn("total", F.sum(F.length("v")).over(W.partitionBy("ref").orderBy("rn"))).where(F.col("total") <= budget)
    return kept.groupBy("ref").agg(F.count("*").alias("n_examples"), F.array_join(F.sort_array(F.collect_list(F.struct("rn", "v"))).v, " | ").alias("examples"))


def key_roles(columns: DataFrame) -> DataFrame:
    """(ref, primary_key, foreign_key, referenced_by): how many columns point at each column."""
    back = columns.where("fk_ref is not null").groupBy(F.col("fk_ref").alias("ref")).agg(F.count("*").alias("referenced_by"))
    return columns.join(back, "ref", "left").select("ref", "primary_key", F.col("fk_ref").isNotNull().alias("foreign_key"), F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"))


def rendered(profile_rows: DataFrame) -> DataFrame:
    """(tab, profile): one text per table, a line per column."""
    line = F.concat("ref", F.lit(" ("), "data_type", F.lit("): "), "semantics", F.when(F.size("sample_values") > 0, F.concat(F.lit("; examples: "), F.array_join("sample_values", ", "))).otherwise(""))
    return profile_rows.groupBy("tab").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("x")))).x, "\n").alias("profile"))
