"""Collapse of records that differ only in formatting or field order.

Every distinct value of the compared columns is canonicalised once and gets an
integer; records become tuples of three integers, the first and last in order
of size, and the tuples are grouped.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sizing import broadcast_if_small, written

#: Full- and half-width forms and their ordinary characters, by the compatibility rule of Unicode.
_WIDE = {c: n for c in map(chr, range(0xFF01, 0xFFEF)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c}
WIDE_FROM, WIDE_TO = "".join(_WIDE), "".join(_WIDE.values())


def canonical(value: Column) -> Column:
    """Letters and numerals of a value alone, in lower case and ordinary width; null stays null."""
    return F.regexp_replace(F.lower(F.translate(value, WIDE_FROM, WIDE_TO)), r"[^\p{L}\p{N}]+", "")


def value_dictionary(records: DataFrame, columns: list[str]) -> DataFrame:
    """(raw, code): an integer for each distinct value, equal just for values of one canonical form.

    Values without letter or numeral are left out. Integers are hashes of the
    forms, the same whenever a lost part is computed again; a second hash finds
    forms that share an integer, and all but one of them get another.
    """
    raw = records.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("raw")).where("raw is not null").distinct()
    form = F.col("form")
    coded = raw.withColumn("form", canonical(F.col("raw"))).where("form <> ''").select("raw", F.xxhash64(form).alias("code"), F.xxhash64(form, F.lit("check")).alias("other"))
    found = written(coded)
    for attempt in range(1, 9):
        shared = found.groupBy("code").agg(F.min("other").alias("first"), F.max("other").alias("last")).where("first <> last").select("code", "first")
        if shared.isEmpty():
            return found.select("raw", "code")
        moved = F.when(F.col("other") != F.col("first"), F.xxhash64("code", "other", F.lit(attempt))).otherwise(F.col("code"))
        found = written(found.join(shared, "code", "left").select("raw", moved.alias("code"), "other"))
    raise RuntimeError("values can't be told apart by their integers")


def coded_records(records: DataFrame, id_col: str, columns: list[str], swap: tuple[int, int] | None = None) -> DataFrame:
    """(id, k0, k1, ...): each record as a tuple of value integers; the two columns at ``swap`` in order of size.

    The swapped columns share a dictionary, each other column has its own.
    Records with a null, or with a value without letter or numeral, are left out.
    """
    names = dict.fromkeys([id_col, *columns])
    base = records.select(*[F.col(f"`{c}`") for c in names])
    out = base.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    together = [list(swap)] if swap else []
    groups = [[i] for i in range(len(columns)) if not swap or i not in swap] + together
    for group in groups:
        lookup = broadcast_if_small(value_dictionary(base, [columns[i] for i in group]))
        for i in group:
            out = out.join(lookup.select(F.col("raw").alias(f"v{i}"), F.col("code").alias(f"k{i}")), f"v{i}").drop(f"v{i}")
    if swap:
        a, b = (F.col(f"k{i}") for i in swap)
        out = out.withColumns({f"k{swap[0]}": F.least(a, b), f"k{swap[1]}": F.greatest(a, b)})
    return out.select("id", *[f"k{i}" for i in range(len(columns))])


def collapse(records: DataFrame, id_col: str = "triplet_id", columns: list[str] | None = None, swap: tuple[int, int] | None = (0, 2)) -> tuple[DataFrame, DataFrame]:
    """(groups, copies) of records that agree apart from formatting, or with the ``swap`` columns exchanged.

    groups: ``keep_id`` (the smallest id) and ``copies`` (distinct ids) of each
    group, groups of one included. copies: ``keep_id`` and ``id`` of each other
    member. Repeated rows of one id count once; null ids take no part. Empty
    input gives empty results. Groups are counted before they are shuffled, and
    ids are looked up by their tuple in a join whose skewed partitions adaptive
    execution splits, so that a group of any size is spread over tasks.
    """
    columns = columns or ["head", "relation", "tail"]
    keys = [f"k{i}" for i in range(len(columns))]
    coded = written(coded_records(records.where(F.col(f"`{id_col}`").isNotNull()), id_col, columns, swap))
    smallest = coded.groupBy(*keys).agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id"))
    several = smallest.where("keep_id < last_id").drop("last_id")
    copies = coded.join(several, keys).where("id > keep_id").select("keep_id", "id").distinct()
    more = copies.groupBy("keep_id").agg(F.count(F.lit(1)).alias("more"))
    groups = smallest.select("keep_id").join(more, "keep_id", "left").select("keep_id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
    return groups, copies
