"""Text expressions: value normaliser, patterns, tokens, similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Normalised values that stand for a missing one.
MISSING = ("", "null", "none", "n/a", "na", "nan", "unknown", "not available")

#: The ordered patterns of normalised values; a value has the first that matches it whole.
PATTERNS = (
    ("uuid_like", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("date_like", "[0-9]{4}-[0-9]{2}-[0-9]{2}([ t].*)?"),
    ("integer_like", "[-+]?[0-9]+"),
    ("decimal_like", "[-+]?([0-9]+\\.[0-9]*|\\.[0-9]+)"),
)


def ascii_normal(c: Column) -> Column:
    """Normal form of an ASCII value: lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), "[\\s\\x1c-\\x1f]+", " "))


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """NFKC, stripped, case folded, white space collapsed."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).strip().casefold().split()))


def missing(c: Column) -> Column:
    return c.isin(*MISSING)


def pattern(c: Column) -> Column:
    """Pattern of a normalised value."""
    out = F.when(c == "", "empty")
    for name, regex in PATTERNS:
        out = out.when(c.rlike(f"^({regex})$"), name)
    out = out.when(c.rlike("^[a-z]+$") & (F.length(c) <= 32), "short_text")
    out = out.when(c.rlike("^[a-z]+$"), "long_text")
    out = out.when(c.rlike("^[a-z0-9][a-z0-9_.:/+-]*$") & c.rlike("[0-9]") & c.rlike("[a-z]"), "alnum_code_like")
    return out.when(F.length(c) >= 80, "long_text").otherwise("other_text")


def tokens(c: Column) -> Column:
    """Lower-case tokens of an identifier: runs of ASCII letters (camel case split) and runs of digits."""
    apart = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")  # letters and digits part by the patterns below
    return F.transform(F.regexp_extract_all(apart, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.lower)


def trigrams(c: Column) -> Column:
    """Set of character trigrams; the whole text if shorter, nothing if empty."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < 3, F.array(c)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; not symmetric, so pass the smaller reference first."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
