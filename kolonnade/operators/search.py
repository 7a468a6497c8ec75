"""Value search: which values a literal may mean. Probes are a stated list of literals, small enough to be sent to every task (checked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Parts of column names whose values are not indexed.
SKIPPED = ("_id", " id", "url", "email", "web", "time", "phone", "date", "address")
MOST_PROBES = 10_000
SIGNATURE, NGRAM, TOP = 100, 3, 20


def _probes(probes: DataFrame) -> DataFrame:
    """Sent to every task if they are few; else joined by shuffle like any table."""
    return F.broadcast(probes) if probes.limit(MOST_PROBES + 1).count() <= MOST_PROBES else probes


def indexed_columns(values: DataFrame, columns: DataFrame) -> DataFrame:
    """(ref, n_values, n_chars): text columns worth indexing: no keys, no identifiers, contacts or times by name, and small or short enough."""
    keys = columns.where("primary_key").select(F.lower("col").alias("k")).distinct()
    named = F.lit(False)
    for part in SKIPPED:
        named = named | F.lower("col").contains(part)
    cols = columns.where(F.col("data_type") == "text").where(~named & ~F.col("col").endswith("Id")).withColumn("k", F.lower("col")).join(keys, "k", "left_anti").select("ref", "col")
    size = values.where("v is not null").distinct().groupBy("ref").agg(F.count("*").alias("n_values"), F.sum(F.length("v")).alias("n_chars"))
    fits = (F.lower("col").contains("name") & (F.col("n_chars") < 5_000_000)) | ((F.col("n_chars") < 2_000_000) & (F.col("n_chars") / F.col("n_values") < 25)) | (F.col("n_values") < 100)
    return cols.join(size, "ref").where(fits & (F.col("n_chars") > 0)).select("ref", "n_values", "n_chars")


def shingles(c: Column, n: int = NGRAM) -> Column:
    """Character n-grams of a lower-case text; the whole text if shorter."""
    low = F.lower(c)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
    return F.when(F.length(low) <= n, F.array(low)).otherwise(many)


def search_exact(probes: DataFrame, values: DataFrame, top: int = TOP) -> DataFrame:
    """(probe, ref, v, jaccard, rank): the values most similar to each probe by Jaccard similarity of trigrams.

    Values meet probes over the trigrams they share; `values` are distinct (ref, v), `probes` (probe). Order:
    similarity descending, then ref and value.
    """
    rows = values.where("v is not null and v <> ''").withColumn("g", shingles(F.col("v")))
    asked = probes.distinct().withColumn("pg", shingles(F.col("probe")))
    keyed = asked.select("probe", F.size("pg").alias("pn"), F.explode("pg").alias("x"))
    hits = rows.select("ref", "v", F.size("g").alias("n"), F.explode("g").alias("x")).join(_probes(keyed), "x").groupBy("probe", "ref", "v", "pn", "n").agg(F.count("*").alias("i"))
    scored = hits.withColumn("jaccard", F.round(F.col("i") / (F.col("pn") + F.col("n") - F.col("i")), 6))
    rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("jaccard"), "ref", "v"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("probe", "ref", "v", "jaccard", "rank")


def signature(c: Column, size: int = SIGNATURE) -> Column:
    """MinHash signature of the trigrams of a text."""
    g = shingles(c)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_min(F.transform(g, lambda s: F.xxhash64(i, s))))


def search_minhash(probes: DataFrame, values: DataFrame, top: int = TOP, size: int = SIGNATURE) -> DataFrame:
    """(probe, ref, v, estimate, rank): values that share a minimum with a probe, by the share of minima that agree."""
    rows = values.where("v is not null and v <> ''").select("ref", "v", F.posexplode(signature(F.col("v"), size)).alias("i", "h"))
    asked = probes.distinct().select("probe", F.posexplode(signature(F.col("probe"), size)).alias("i", "h"))
    hits = rows.join(_probes(asked), ["i", "h"]).groupBy("probe", "ref", "v").agg(F.round(F.count("*") / size, 6).alias("estimate"))
    rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("estimate"), "ref", "v"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top)


def similar_values(found: DataFrame) -> DataFrame:
    """(probe, ref, v, jaccard): per probe and column the best found value that equals the probe or where one holds the other, of three characters at least."""
    p, v = F.lower(F.trim("probe")), F.lower(F.trim("v"))
    inside = (p == v) | (v.contains(p) & (F.length(p) >= 3)) | (p.contains(v) & (F.length(v) >= 3))
    first = F.row_number().over(W.partitionBy("probe", "ref").orderBy("rank"))
    return found.where(inside).withColumn("rn", first).where("rn = 1").select("probe", "ref", "v", "jaccard")


def clean_literal(c: Column) -> Column:
    """A literal without one pair of quotes; null unless 2 to 100 characters are left."""
    t = F.regexp_replace(F.trim(c), "^(['\"])(.*)\\1$", "$2")
    return F.when(F.length(t).between(2, 100), t)


def literal_existence(literals: DataFrame, values: DataFrame) -> DataFrame:
    """(ref, literal, existence): whether the column holds the literal exactly; null for columns that are not there."""
    hit = values.select("ref", F.col("v").alias("literal")).join(_probes(literals.select("ref", "literal").distinct()), ["ref", "literal"], "left_semi").distinct().withColumn("hit", F.lit(True))
    known = values.select("ref").distinct().withColumn("known", F.lit(True))
    return literals.distinct().join(hit, ["ref", "literal"], "left").join(known, "ref", "left").select("ref", "literal", F.when(F.col("known"), F.coalesce("hit", F.lit(False))).alias("existence"))


def substring_candidates(literals: DataFrame, values: DataFrame, top: int = 3) -> DataFrame:
    """(ref, literal, v, distance, rank): values of the column that hold the literal, whatever the case, nearest first; the literal itself is left out."""
    rows = values.where("v is not null and v <> ''").distinct().join(_probes(literals.distinct()), "ref")
    hits = rows.where(F.lower("v").contains(F.lower("literal")) & (F.col("v") != F.col("literal")))
    scored = hits.withColumn("distance", F.levenshtein(F.lower("v"), F.lower("literal")))
    rank = F.row_number().over(W.partitionBy("ref", "literal").orderBy("distance", "v"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("ref", "literal", "v", "distance", "rank")


def value_options(found: DataFrame, existence: DataFrame, top: int = 5) -> DataFrame:
    """(probe, ref, v, source, pos): the anchor itself first, then found values; each value of a column once, column names compared without case."""
    anchors = existence.select(F.col("literal").alias("probe"), "ref", F.col("literal").alias("v"), F.when(F.col("existence"), "anchor").when(~F.col("existence"), "anchor_missing").otherwise("anchor_unverified").alias("source"), F.lit(0).alias("o"))
    rows = anchors.unionByName(found.select("probe", "ref", "v", F.lit("search").alias("source"), F.col("rank").alias("o")))
    once = rows.withColumn("rn", F.row_number().over(W.partitionBy("probe", F.lower("ref"), "v").orderBy("o"))).where("rn = 1")
    pos = F.row_number().over(W.partitionBy("probe").orderBy("o", "ref", "v"))
    return once.withColumn("pos", pos).where(F.col("pos") <= top).select("probe", "ref", "v", "source", "pos")


