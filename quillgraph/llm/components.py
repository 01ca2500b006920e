"""Groups of records that are linked directly or through others.

Union-find runs inside bounded partitions of edges, each of which keeps only a
spanning forest, as stars. A node that is nowhere the centre of a star links the
centres it is under and is then settled, so the next level has centres alone.
Centres are chosen by a hash that changes with the level, so that no order of
ids (a chain in ascending order, say) keeps levels from shrinking by a constant
factor. When the forest fits into one bounded partition, its components are
global; settled nodes then get their groups level by level, backwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sizing import durable

#: Most edges that one union-find holds in memory.
EDGES_PER_PARTITION = 50_000

_STAR = "root string, node string"


def _stars(left: list[str], right: list[str], level: int) -> pd.DataFrame:
    """Spanning forest of the edges: every node but a centre under the centre of its component."""
    parent: dict[str, str] = {}
    rank: dict[str, tuple[int, str]] = {}

    def find(x: str) -> str:
        if x not in parent:
            parent[x] = x
            rank[x] = (zlib.crc32(f"{level}:{x}".encode()), x)
        while (p := parent[x]) != x:
            parent[x] = parent[p]
            x = p
        return x

    for a, b in zip(left, right):
        a, b = find(a), find(b)
        if a != b:
            if rank[b] < rank[a]:
                a, b = b, a
            parent[b] = a
    stars = [(find(x), x) for x in parent]
    return pd.DataFrame([x for x in stars if x[0] != x[1]], columns=["root", "node"])


def _local_forests(most: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition over the bound (keys don't spread evenly) is worked off in runs of bounded size.
        left: list[str] = []
        right: list[str] = []
        for batch in batches:
            left += batch["a"].tolist()
            right += batch["b"].tolist()
            if len(left) > 2 * most:
                yield _stars(left, right, level)
                left, right = [], []
        if left:
            yield _stars(left, right, level)

    return run


def components(edges: DataFrame, a: str = "src", b: str = "dst", edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(group_id, id): each linked id with the smallest id of its group, compared as strings.

    Edges with a null end are left out; loops and repeated or reversed edges
    have no effect; an id occurs only if it is linked to another. No edges give
    no rows. The levels are materialised in the shared checkpoint folder.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")).where("x is not null and y is not null and x <> y")
    links = durable(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    settled: list[DataFrame] = []
    while True:
        parts = max(1, -(-links.count() // edges_per_partition))
        spread = links.repartition(parts, "a", "b") if parts > 1 else links.coalesce(1)
        forest = durable(spread.mapInPandas(_local_forests(edges_per_partition, len(settled)), _STAR))
        if parts == 1:
            break
        # A node is in one star of a run at most, so its rows are bounded by the number of runs.
        centres = forest.select(F.col("root").alias("node"), F.lit(True).alias("is_centre")).distinct()
        under = durable(forest.groupBy("node").agg(F.min("root").alias("least")).join(centres, "node", "left"))
        settled.append(under.where("is_centre is null").select(F.col("least").alias("root"), "node"))
        kept = forest.join(under, "node").select(F.col("root").alias("x"), F.when(F.col("is_centre"), F.col("node")).otherwise(F.col("least")).alias("y"))
        links = durable(kept.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = forest
    for level in reversed(settled):
        above = found.select(F.col("root").alias("_top"), F.col("node").alias("_node"))
        below = level.join(above, F.col("root") == F.col("_node"), "left").select(F.coalesce("_top", "root").alias("root"), "node")
        found = durable(below.unionByName(found))
    # A centre has no row of its own; a group's smallest id is found before rows are spread over groups.
    names = found.groupBy("root").agg(F.least(F.min("node"), F.first("root")).alias("group_id"))
    centres = found.select("root").distinct().withColumn("node", F.col("root"))
    return found.unionByName(centres).join(names, "root").select("group_id", F.col("node").alias("id"))


def groups_of_matches(pairs: DataFrame, status: str = "status", wanted: str = "MERGE", left: str = "left_id", right: str = "right_id", **how) -> DataFrame:
    """Components of the pairs whose status is ``wanted``, blanks around it and letter case aside."""
    clean = F.upper(F.regexp_replace(F.col(f"`{status}`"), r"^[\s\u3000\u00a0]+|[\s\u3000\u00a0]+$", ""))
    return components(pairs.where(clean == wanted.upper()), left, right, **how)
