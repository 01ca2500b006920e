"""Similarity of vectors, term sets and strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(a: Column) -> Column:
    """A vector of length 1; null for the zero vector."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm))


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_similarity(a: Column, b: Column, terms: list[str]) -> Column:
    """Jaccard of the contained terms; of the characters if neither text contains one."""
    characters = jaccard(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, "")))
    both = F.struct(terms_in(a, terms).alias("l"), terms_in(b, terms).alias("r"))
    return bound(both, lambda x: F.when((F.size(x["l"]) == 0) & (F.size(x["r"]) == 0), characters).otherwise(jaccard(x["l"], x["r"])))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Share of matching characters by longest common blocks (no built-in function has this measure)."""
    return F.pandas_udf(_ratios, DoubleType())(a, b)
