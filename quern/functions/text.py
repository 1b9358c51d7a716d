"""Tokens, bigrams and whitespace as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.split and \\s take for white space.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def tokens(text: Column) -> Column:
    """ASCII words and numbers, matched first and lower-cased then; [] for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), 0), F.lower)


def bigrams(terms: Column) -> Column:
    """Adjacent pairs joined by a space, without a shuffle."""
    n = F.size(terms)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(terms, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    )


def normalised_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))
