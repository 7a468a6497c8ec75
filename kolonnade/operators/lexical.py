"""Columns whose names resemble each other.

Pairs are found over an inverted index of tokens, trigrams and slot bases within a database, so no pair is
looked at that shares none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.functions import text

LEAST_TOKEN, LEAST_SURFACE = 3, 5
OVERLAP, JACCARD, DICE, EDIT = 0.5, 0.3, 0.6, 0.7


def profiles(columns: DataFrame) -> DataFrame:
    """(db_id, ref, tab, tokens, token_set, surface, grams, slot_base, slot_suffix) of columns (db_id, ref, tab, col).

    Null names have no tokens; repeated rows count once.
    """
    base = columns.select("db_id", "ref", "tab", "col").where("ref is not null").distinct()
    out = base.withColumn("tokens", text.tokens(F.coalesce("col", F.lit("")))).withColumn("surface", F.array_join("tokens", " "))
    slot = (F.size("tokens") > 1) & F.element_at("tokens", -1).rlike("^[0-9]+$")
    slot = F.coalesce(F.when(F.size("tokens") > 1, slot), F.lit(False))
    return out.select(
        "db_id", "ref", "tab", "tokens", F.array_sort(F.array_distinct("tokens")).alias("token_set"), "surface", text.trigrams(F.col("surface")).alias("grams"),
        F.when(slot, F.array_join(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(1))), " ")).alias("slot_base"), F.when(slot, F.element_at("tokens", -1)).alias("slot_suffix"),
    )


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("db_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "db_id"])


def token_pairs(lexical: DataFrame) -> DataFrame:
    """(db_id, l, r): pairs l < r of one database that share a token."""
    keyed = lexical.select("db_id", "ref", F.explode("token_set").alias("t"))
    return keyed.withColumnRenamed("ref", "l").join(keyed.withColumnRenamed("ref", "r"), ["db_id", "t"]).where("l < r").select("db_id", "l", "r").distinct()


def blocked_pairs(lexical: DataFrame) -> DataFrame:
    """Pairs that share a token or enough trigrams for the Dice threshold.

    Of a set of n trigrams the rarest n - ceil(least shared) + 1 suffice: two sets with Dice of at least d
    share at least d / (2 - d) * n of them.
    """
    share = DICE / (2 - DICE)
    grams = lexical.select("db_id", "ref", F.explode("grams").alias("g"), F.size("grams").alias("n"))
    rare = grams.groupBy("db_id", "g").agg(F.count("*").alias("df"))
    ranked = grams.join(rare, ["db_id", "g"]).withColumn("rn", F.row_number().over(W.partitionBy("db_id", "ref").orderBy("df", "g")))
    prefix = ranked.where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("db_id", "ref", "g")
    by_gram = prefix.withColumnRenamed("ref", "l").join(prefix.withColumnRenamed("ref", "r"), ["db_id", "g"]).where("l < r").select("db_id", "l", "r")
    return by_gram.union(token_pairs(lexical)).distinct()


def scored(pairs: DataFrame, lexical: DataFrame, edit: bool = False) -> DataFrame:
    """Pairs with both profiles and scores, rounded to six places before any rule looks at them."""
    sides = pairs.join(_sided(lexical, "l").withColumnRenamed("l_ref", "l"), ["db_id", "l"]).join(_sided(lexical, "r").withColumnRenamed("r_ref", "r"), ["db_id", "r"])
    out = sides.withColumns(
        {
            "token_jaccard": F.round(text.jaccard(F.col("l_token_set"), F.col("r_token_set")), 6),
            "token_overlap": F.round(text.overlap(F.col("l_token_set"), F.col("r_token_set")), 6),
            "char_ngram_dice": F.round(text.dice(F.col("l_grams"), F.col("r_grams")), 6),
            "edit_similarity": F.round(text.sequence_ratio(F.col("l_surface"), F.col("r_surface")), 6) if edit else F.lit(0.0),
        }
    )
    return out.withColumn("lexical_similarity", F.round(F.greatest("token_jaccard", 0.7 * F.col("token_overlap"), 0.8 * F.col("char_ngram_dice"), "edit_similarity"), 6))


def _rules() -> dict[str, Column]:
    long = F.exists(F.array_intersect("l_token_set", "r_token_set"), lambda t: F.length(t) >= LEAST_TOKEN)
    return {
        "NUMERIC_SLOT_PATTERN": (F.col("l_slot_base") == F.col("r_slot_base")) & (F.col("l_slot_suffix") != F.col("r_slot_suffix")),
        "EXACT_TOKEN_OVERLAP": long & ((F.col("token_overlap") >= OVERLAP) | (F.col("token_jaccard") >= JACCARD)),
        "CHAR_SIMILARITY": (F.greatest(F.length("l_surface"), F.length("r_surface")) >= LEAST_SURFACE) & ((F.col("char_ngram_dice") >= DICE) | (F.col("edit_similarity") >= EDIT)),
    }


def candidates(columns: DataFrame, edit: bool = False) -> DataFrame:
    """(db_id, candidate_id, l, r, rules, hint, scores...): pairs for which a rule holds, numbered by (l, r) in each database.

    With `edit` the Ratcliff-Obershelp ratio counts for pairs that share a token or trigrams; pairs alike by
    that ratio alone, which share neither, are not candidates.
    """
    lexical = profiles(columns)
    rows = scored(blocked_pairs(lexical), lexical, edit)
    rules = F.array_compact(F.array(*[F.when(c, name) for name, c in _rules().items()]))
    common = F.size(F.array_intersect("l_token_set", "r_token_set"))
    hint = (
        F.when(F.array_contains("rules", "NUMERIC_SLOT_PATTERN"), "NUMERIC_SLOT_PATTERN")
        .when(F.array_contains("rules", "CHAR_SIMILARITY") & (common == 0), "CHAR_ONLY_MATCH")
        .when(common == 1, "SINGLE_SHARED_TOKEN")
        .when(F.col("l_tab") != F.col("r_tab"), "CROSS_TABLE_SURFACE_MATCH")
        .when(common >= 2, "MULTI_TOKEN_OVERLAP")
        .otherwise("OTHER_LEXICAL_SURFACE")
    )
    found = rows.withColumn("rules", rules).where(F.size("rules") > 0).withColumn("hint", hint)
    number = F.row_number().over(W.partitionBy("db_id").orderBy("l", "r"))
    return found.select("db_id", F.format_string("lexical_%06d", number).alias("candidate_id"), "l", "r", F.array_join("rules", ",").alias("rules"), "hint", "token_jaccard", "token_overlap", "char_ngram_dice", "edit_similarity", "lexical_similarity")
