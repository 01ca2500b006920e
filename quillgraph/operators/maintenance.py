"""Upkeep of the graph: cleaning, alignment, sinking of properties, restoring, vocabulary, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocab import CLASSES, SINKING, SUNK_AS
from ..sizing import durable
from . import graph as g


def clean_nodes(nodes: DataFrame, edges: DataFrame, longest: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept nodes, kept edges, deleted): nodes with bad names go, and their edges with them; deleted has the reason."""
    judged = nodes.withColumn("reason", t.stop_reason(F.col("name"), longest))
    deleted = judged.where("reason is not null")
    gone = deleted.select("name").distinct()
    kept = edges.join(gone, edges["src"] == gone["name"], "left_anti").join(gone, F.col("dst") == gone["name"], "left_anti")
    return judged.where("reason is null").drop("reason"), kept, deleted


def restore_nodes(nodes: DataFrame, deleted: DataFrame, reason: str = "Length") -> DataFrame:
    """Nodes with those put back whose reason names ``reason``; edges stay deleted."""
    back = deleted.where(F.col("reason").contains(reason)).drop("reason")
    return nodes.unionByName(back, allowMissingColumns=True).distinct()


def align(nodes: DataFrame, pairs: DataFrame, merge: float = 0.92, id_col: str = "id", name: str = "name") -> DataFrame:
    """(group_id, id): nodes to be merged, under the smallest id: equal normalised names, or a similarity of ``merge``.

    pairs: (a, b, cosine). Equal names are tied to the smallest id that bears
    them, so a name of many nodes makes a star and not all pairs.
    """
    named = nodes.select(F.col(id_col).alias("id"), t.normalize_name(F.col(name)).alias("n")).where("n is not null and n <> 'Unknown_Entity' and n <> ''")
    first = named.groupBy("n").agg(F.min("id").alias("a"))
    alike = named.join(first, "n").where("id <> a").select("a", F.col("id").alias("b"))
    near = pairs.where(F.col("cosine") >= merge).select("a", "b")
    return g.groups(alike.unionByName(near))


def review_pairs(pairs: DataFrame, review: float = 0.85, merge: float = 0.92) -> DataFrame:
    """(status, a, b, cosine): the report of pairs to merge and to look at."""
    status = F.when(F.col("cosine") >= merge, "MERGE").when(F.col("cosine") >= review, "REVIEW")
    return pairs.select(status.alias("status"), "a", "b", "cosine").where("status is not null")


def migrate_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups' first ids: each end mapped, loops dropped, equal edges once."""
    lookup = groups.select(F.col("id").alias("_old"), F.col("group_id").alias("_new"))
    one = edges.join(lookup, edges["src"] == F.col("_old"), "left").withColumn("src", F.coalesce("_new", "src")).drop("_old", "_new")
    two = one.join(lookup, F.col("dst") == F.col("_old"), "left").withColumn("dst", F.coalesce("_new", "dst")).drop("_old", "_new")
    return two.where("src <> dst").distinct()


def sink_properties(edges: DataFrame, long: int = 15, very_long: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(properties, kept edges, orphans) after edges to long descriptive names became properties of their sources.

    properties: (name, property, value), values in order of their names, joined
    by ``; ``. orphans: targets left without any edge.
    """
    sinks = (F.char_length("dst") > long) & (F.col("rel").isin(SINKING) | (F.char_length("dst") > very_long))
    lookup = F.create_map(*[F.lit(x) for pair in SUNK_AS.items() for x in pair])
    moved = edges.where(sinks).withColumn("property", F.coalesce(F.try_element_at(lookup, "rel"), F.lit("description")))
    properties = moved.groupBy(F.col("src").alias("name"), "property").agg(F.array_join(F.array_sort(F.collect_set("dst")), "; ").alias("value"))
    kept = edges.where(~sinks)
    ends = kept.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    orphans = moved.select(F.col("dst").alias("name")).distinct().join(ends, "name", "left_anti")
    return properties, kept, orphans


def expand_vocabulary(edges: DataFrame, types: DataFrame, standard: DataFrame, least: int = 3) -> DataFrame:
    """(class, name, degree): well-connected names outside the standard list, by class, 其他 for any other type."""
    known = standard.select(F.col("term").alias("name")).distinct()
    found = g.degrees(edges, least).join(known, "name", "left_anti").join(types, "name", "left")
    return found.select(F.when(F.col("type").isin(CLASSES), F.col("type")).otherwise("其他").alias("class"), "name", "degree")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Match-or-create: rows of ``new`` over those of ``old`` by key, ``created_at`` kept, nulls not written over values."""
    old = old.select(*[F.col(c).alias(f"_o_{c}") if c != key else F.col(c) for c in old.columns])
    both = old.join(new, key, "full_outer")
    cols = [c for c in new.columns if c != key]
    return both.select(key, *[(F.coalesce(f"_o_{c}", c) if c == "created_at" else F.coalesce(c, f"_o_{c}")).alias(c) for c in cols])


def skeleton(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of items: one document for each file hash, its chunks numbered anew in order of id.

    Items without a hash get one of their file name. The order within a file is
    by item; a file's chunks are ranked by a window over that file alone.
    """
    from pyspark.sql import Window as W

    file = F.coalesce("file_hash", F.md5(F.coalesce(F.col("metadata")["file_name"], F.lit(""))))
    rows = durable(items.select("item_id", file.alias("file_hash"), F.col("metadata")["file_name"].alias("file_name"), "created_at", F.char_length("text").alias("n_chars")).dropDuplicates(["item_id"]))
    documents = rows.groupBy("file_hash").agg(F.min("file_name").alias("file_name"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("n_chunks"))
    order = W.partitionBy("file_hash").orderBy("item_id")
    chunks = rows.select("item_id", "file_hash", (F.row_number().over(order) - 1).alias("chunk_index"), F.lag("item_id").over(order).alias("previous_id"))
    return documents, chunks
