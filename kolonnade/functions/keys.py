"""Comparison forms of identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that Python's str.strip removes.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """`c` without surrounding Unicode white space (Spark's `trim` takes the blank only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def ident(c: Column) -> Column:
    """Comparison form of an identifier: stripped, lower case; null if nothing is left."""
    low = F.lower(stripped(c))
    return F.when(low != "", low)  # nullif would keep Spark from pruning nested columns
