"""Columns whose value domains collide, and the evidence for it.

Domains are distinct normalised values (ref, v); overlaps come from an inverted index on the values, so work
follows the postings, not the pairs of columns. A value occurs at most once a column, hence a posting list is
as long as there are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.functions import text
from kolonnade.operators.numbering import numbered
from kolonnade.operators.profile import BOOLEANS
from kolonnade.session import cut

MODES = ("CODE_OR_IDENTIFIER", "LOW_CARD_DOMAIN", "LONG_TEXT_HASH", "LABEL_TEXT")
#: Values looked at for each one shown.
ENOUGH = 16


def normalized(rows: DataFrame, column: str, to: str) -> DataFrame:
    """`rows` with the normal form (NFKC, case folded, white space collapsed) of `column` as `to`; only values beyond ASCII go through Python."""
    ascii_only = F.length(column) == F.octet_length(column)
    return rows.where(ascii_only).withColumn(to, text.ascii_normal(F.col(column))).unionByName(rows.where(~ascii_only).withColumn(to, text.nfkc_casefold(column)))


def domains(values: DataFrame) -> DataFrame:
    """Distinct (ref, v) of normalised values without missing tokens."""
    raw = values.where("v is not null").select("ref", F.col("v").alias("o")).distinct()
    return normalized(raw, "o", "v").where(~text.missing(F.col("v"))).select("ref", "v").distinct()


def patterns(domain: DataFrame) -> DataFrame:
    """(ref, n_values, dominant_pattern, length_p50) of domains; ties of patterns go to the first by name."""
    per = domain.groupBy("ref", text.pattern(F.col("v")).alias("pattern"), F.length("v").alias("n")).agg(F.count("*").alias("f"))
    top = per.groupBy("ref", "pattern").agg(F.sum("f").alias("f")).withColumn("rn", F.row_number().over(W.partitionBy("ref").orderBy(F.desc("f"), "pattern"))).where("rn = 1").select("ref", F.col("pattern").alias("dominant_pattern"))
    size = per.groupBy("ref").agg(F.sum("f").alias("n_values"), F.expr("percentile(n, 0.5, f)").alias("length_p50"))
    return size.join(top, "ref").select("ref", "n_values", "dominant_pattern", "length_p50")


def boolean_domains(domain: DataFrame) -> DataFrame:
    """(ref, boolean): whether all values lie in one boolean domain."""
    return domain.groupBy("ref").agg(*[F.bool_and(F.col("v").isin(*d)).alias(f"b{i}") for i, d in enumerate(BOOLEANS)]).select("ref", (F.col("b0") | F.col("b1") | F.col("b2") | F.col("b3")).alias("boolean"))


def identifier_name(name: Column) -> Column:
    """Whether a name says identifier: ends in id, or has a token id, uuid, key or code (camel case split only)."""
    low = F.lower(name)
    split = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return low.endswith("id") | F.arrays_overlap(split, F.array(*map(F.lit, ("id", "uuid", "key", "code"))))


def eligibility(domain: DataFrame, columns: DataFrame, modes: DataFrame) -> DataFrame:
    """(ref, n_values, dominant_pattern, length_p50, modes array, reasons array) for catalog rows and value modes."""
    rows = columns.join(modes, "ref").join(patterns(domain), "ref", "left").join(boolean_domains(domain), "ref", "left")
    n, p50 = F.coalesce("n_values", F.lit(0)), F.col("length_p50")
    mode = F.col("value_mode")
    ident = (mode == "CODE_OR_IDENTIFIER") | F.col("primary_key") | F.col("uniq") | F.col("fk_ref").isNotNull() | identifier_name(F.col("col"))
    date = (mode == "DATE_LIKE") | F.coalesce(F.col("dominant_pattern") == "date_like", F.lit(False))
    boolean = F.coalesce("boolean", F.lit(False))
    number = (mode == "NUMERIC_MEASURE") & ~ident
    plain = ~boolean & ~date & ~number
    found = {
        "CODE_OR_IDENTIFIER": ident & (n >= 2) & ~boolean & ~date,
        "LOW_CARD_DOMAIN": (n >= 2) & (n <= 10) & plain & (p50.isNull() | (p50 <= 32)),
        "LONG_TEXT_HASH": (mode == "LABEL_TEXT") & (n >= 3) & plain & (p50 >= 80),
        "LABEL_TEXT": mode.isin("LABEL_TEXT", "LOW_CARD_DOMAIN") & (n >= 3) & plain & (p50.isNull() | (p50 < 80)),
    }
    why = {"BOOLEAN_LIKE_DOMAIN": boolean, "DATE_LIKE_DOMAIN": date, "EMPTY_DOMAIN": n == 0, "NUMERIC_MEASURE": number, "SINGLE_VALUE_DOMAIN": n == 1}
    return rows.select(
        "ref", n.alias("n_values"), F.coalesce("dominant_pattern", F.lit("empty")).alias("dominant_pattern"), "length_p50",
        F.array_compact(F.array(*[F.when(found[m], m) for m in MODES])).alias("modes"), F.array_compact(F.array(*[F.when(c, r) for r, c in why.items()])).alias("reasons"),
    )


def overlaps(domain: DataFrame) -> DataFrame:
    """(l, r, n_left, n_right, n_shared, jaccard, overlap, contained_left, contained_right) of pairs l < r that share a value."""
    size = domain.groupBy("ref").agg(F.count("*").alias("n"))
    # Columns of one value as one row: a value's columns travel once, pairs form after the shuffle.
    lists = domain.groupBy("v").agg(F.sort_array(F.collect_list("ref")).alias("refs")).where(F.size("refs") > 1)
    # Values with the same columns are counted before they are unfolded.
    sets = lists.groupBy("refs").agg(F.count("*").alias("n"))
    pairs = sets.select("n", F.col("refs"), F.posexplode("refs").alias("i", "l")).select("n", "l", F.explode(F.slice("refs", F.col("i") + 2, F.size("refs"))).alias("r"))
    shared = pairs.groupBy("l", "r").agg(F.sum("n").alias("n_shared"))
    out = shared.join(size.select(F.col("ref").alias("l"), F.col("n").alias("n_left")), "l").join(size.select(F.col("ref").alias("r"), F.col("n").alias("n_right")), "r")
    i, a, b = F.col("n_shared"), F.col("n_left"), F.col("n_right")
    return out.select("l", "r", "n_left", "n_right", "n_shared", (i / (a + b - i)).alias("jaccard"), (i / F.least(a, b)).alias("overlap"), (i / a).alias("contained_left"), (i / b).alias("contained_right"))


def pattern_group(c: Column) -> Column:
    return F.when(c.isin("integer_like", "decimal_like"), "numeric").when(c.isin("uuid_like", "alnum_code_like"), "code").when(c == "date_like", "date").when(c.isin("short_text", "long_text", "other_text"), "text").otherwise("other")


def collisions(domain: DataFrame, columns: DataFrame, modes: DataFrame) -> DataFrame:
    """(candidate_id, l, r, mode, priority, metrics...): pairs with a shared eligible mode that passes its thresholds; the first mode in order wins."""
    able = eligibility(domain, columns, modes).select("ref", "modes", pattern_group(F.col("dominant_pattern")).alias("g"))
    rows = overlaps(domain).join(able.select(F.col("ref").alias("l"), F.col("modes").alias("lm"), F.col("g").alias("lg")), "l").join(able.select(F.col("ref").alias("r"), F.col("modes").alias("rm"), F.col("g").alias("rg")), "r")
    i, most = F.col("n_shared"), F.greatest("n_left", "n_right")
    dated = (F.col("lg") == "date") | (F.col("rg") == "date")
    alike = ~dated & ((F.col("lg") == F.col("rg")) | (F.col("lg") == "code") | (F.col("rg") == "code"))
    texts = (F.col("lg") == "text") & (F.col("rg") == "text")
    least = F.when(most >= 10000, 30).when(most >= 1000, 10).otherwise(3)
    much = (i >= least) & ((F.col("overlap") >= 0.5) | (F.greatest("contained_left", "contained_right") >= 0.8))
    passes = {"CODE_OR_IDENTIFIER": alike & much, "LOW_CARD_DOMAIN": alike & (i >= 2) & (F.col("overlap") >= 1.0), "LONG_TEXT_HASH": texts & (i >= 3) & (F.col("overlap") >= 0.5), "LABEL_TEXT": texts & much}
    mode = F.coalesce(*[F.when(F.array_contains("lm", m) & F.array_contains("rm", m) & passes[m], F.lit(m)) for m in MODES])
    found = rows.withColumn("mode", mode).where("mode is not null")
    priority = F.when(F.col("mode") == "CODE_OR_IDENTIFIER", "high").when(F.col("mode") == "LOW_CARD_DOMAIN", "low").otherwise("medium")
    return numbered(found, "number", "l", "r").select(F.format_string("value_%06d", "number").alias("candidate_id"), "l", "r", "mode", priority.alias("priority"), "n_left", "n_right", "n_shared", *[F.round(c, 6).alias(c) for c in ("jaccard", "overlap", "contained_left", "contained_right")])


def _shared_values(domain: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l, r, v) of the given pairs."""
    left = pairs.select("l", "r").join(domain.select(F.col("ref").alias("l"), "v"), "l")
    return left.join(domain.select(F.col("ref").alias("r"), "v"), ["r", "v"]).select("l", "r", "v")


def matched_examples(domain: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(l, r, examples): the first `k` shared values of each pair; the limit is applied before values gather."""
    first = _shared_values(domain, pairs).withColumn("rn", F.row_number().over(W.partitionBy("l", "r").orderBy("v"))).where(F.col("rn") <= k)
    return first.groupBy("l", "r").agg(F.array_join(F.sort_array(F.collect_list("v")), " | ").alias("examples"))


def representatives(values: DataFrame) -> DataFrame:
    """(ref, v, original): the least original spelling, trimmed, of each normalised value."""
    rows = values.where("v is not null").select("ref", F.trim("v").alias("o"))
    return normalized(rows, "o", "v").where(~text.missing(F.col("v"))).groupBy("ref", "v").agg(F.min("o").alias("original"))


def shortened(c: Column, n: int = 25) -> Column:
    """The first `n` characters, with the number of those left out."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("...("), (F.length(c) - n).cast("string"), F.lit(" more chars)"))).otherwise(c)


def overlap_samples(reps: DataFrame, pairs: DataFrame, db_id: str, k: int = 5) -> DataFrame:
    """(l, r, n_shared, samples): `k` shared values with the least SHA-256 of `db|l|r|overlap|value`, shown shortened."""
    domain = reps.select("ref", "v")
    seed = F.concat_ws("|", F.lit(db_id), "l", "r", F.lit("overlap"), "v")
    rows = _shared_values(domain, pairs)
    size = rows.groupBy("l", "r").agg(F.count("*").alias("n_shared"))
    first = rows.withColumn("h", F.sha2(seed, 256)).withColumn("rn", F.row_number().over(W.partitionBy("l", "r").orderBy("h"))).where(F.col("rn") <= k)
    shown = first.join(reps.select(F.col("ref").alias("l"), "v", F.col("original").alias("lo")), ["l", "v"]).join(reps.select(F.col("ref").alias("r"), "v", F.col("original").alias("ro")), ["r", "v"])
    listed = shown.groupBy("l", "r").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rn", shortened(F.least("lo", "ro")).alias("x")))).x, " | ").alias("samples"))
    return size.join(listed, ["l", "r"])


def endpoint_samples(domain: DataFrame, pairs: DataFrame, db_id: str, k: int = 5) -> DataFrame:
    """(ref, other, samples): `k` seeded values of a column that the other column of the pair lacks.

    A value travels once, with its columns; what it is to each pair is told in place. Hashes spread evenly, so
    those under a bound that about `ENOUGH * k` values of a side pass hold its first `k`; sides where fewer than `k` pass are taken whole.
    """
    sides = pairs.select(F.col("l").alias("ref"), F.col("r").alias("other"), "l", "r").union(pairs.select("r", "l", "l", "r"))
    lists = domain.groupBy("v").agg(F.sort_array(F.collect_list("ref")).alias("refs"))

    def lacking(of: DataFrame, wanted: DataFrame) -> DataFrame:
        # As many sides as pairs of columns, whatever the size of the tables.
        return of.withColumn("ref", F.explode("refs")).join(F.broadcast(wanted), "ref").where(~F.array_contains("refs", F.col("other")))

    seed = F.sha2(F.concat_ws("|", F.lit(db_id), "l", "r", "ref", F.lit("endpoint"), "v"), 256)

    def hashed(wanted: DataFrame) -> DataFrame:
        return lacking(lists, wanted).withColumn("h", seed).where(F.col("h") < F.col("bound")).select("ref", "other", "v", "h")

    size = lacking(lists.groupBy("refs").agg(F.count("*").alias("n")), sides).groupBy("ref", "other", "l", "r").agg(F.sum("n").alias("n"))
    bound = F.when(F.col("n") > ENOUGH * k, F.lpad(F.lower(F.hex((F.lit(float(2**32 * ENOUGH * k)) / F.col("n")).cast("long"))), 8, "0")).otherwise("g")
    sized = cut(size.withColumn("bound", bound))
    found = cut(hashed(sized))
    few = sized.join(found.groupBy("ref", "other").agg(F.count("*").alias("kept")), ["ref", "other"], "left").where(F.coalesce("kept", F.lit(0)) < F.least(F.col("n"), F.lit(k)))
    few = cut(few.select("ref", "other", "l", "r", F.lit("g").alias("bound")))
    if not few.isEmpty():
        found = found.unionByName(hashed(few)).distinct()
    first = found.withColumn("rn", F.row_number().over(W.partitionBy("ref", "other").orderBy("h"))).where(F.col("rn") <= k)
    return first.groupBy("ref", "other").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rn", shortened(F.col("v")).alias("x")))).x, " | ").alias("samples"))
