"""Queries of the operators of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..sizing import durable
from . import canonical, components, dedup, mixing, neighbours, scans, splitting, tokens, topics


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items with chunks, and those with a chunk that was cut in a stretch over the limit."""
    chunks = splitting.split_oversized(table(spark, folder, "document_index").select("item_id", "text"), with_text=False)
    kinds = F.array_compact(F.array(F.when(F.col("chunk_index") == 0, "oversized"), F.when(F.col("stretch") > splitting.LIMIT, "no_boundary")))
    return chunks.select("item_id", F.explode(kinds).alias("kind")).distinct()


def p1_chunks(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "document_index").select("item_id", "text").dropDuplicates(["item_id"])
    return splitting.split_oversized(items)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = components.groups_of_matches(table(spark, folder, "alignment_pair").select("status", "left_id", "right_id"))
    return found.where("group_id < id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = table(spark, folder, "entity_node").where("source = 'manual'")
    return canonical.map_to_entries(typed, table(spark, folder, "standard_entity"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Names that mean no entry, with the number of ids that bear them."""
    typed = table(spark, folder, "entity_node").where("source = 'manual'")
    none = p3_found(spark, folder).where("term_id = 0").select("id")
    return typed.select("id", "name").distinct().join(none, "id").groupBy("name").agg(F.count(F.lit(1)).alias("n_ids"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(neighbours.nearest(table(spark, folder, "entity_vector")))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "entity_vector"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    _, copies = dedup.collapse(table(spark, folder, "triplet"))
    return copies.select("keep_id", F.col("id").alias("triplet_id"))


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.collapse(table(spark, folder, "triplet"))[0]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise_of_lines(table(spark, folder, "ocr_page")).distinct()


def p7_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired_pages(table(spark, folder, "ocr_page"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), "doc_id", keep=("source",))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which the mix takes all that it may and still has too little."""
    return p9_shares(spark, folder).where("short").select("source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_plan"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, plan = durable(_sized(spark, folder)), table(spark, folder, "mix_plan")
    return mixing.shares_reached(mixing.mix(sized, plan), sized, plan)


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return topics.areas_of(*[table(spark, folder, name) for name in ("documents", "subject_label", "subject_area")])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).select("doc_id", "area").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters of each area; a document of several areas counts its characters by share."""
    found = _areas(spark, folder)
    sizes = table(spark, folder, "documents").select("doc_id", F.char_length("text").alias("chars"))
    return found.join(sizes, "doc_id").groupBy("area").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.sum(F.col("share") * F.col("chars"))).cast("long").alias("n_chars"))


def queries() -> dict:
    names = ("p1_found", "p1_chunks", "p2_found", "p3_found", "p3_unmatched", "p4_found", "p4_neighbours", "p6_found", "p6_records", "p7_found", "p7_pages", "p8_ids", "p9_found", "p9_mix", "p9_shares", "p10_found", "p10_composition")
    return {name: globals()[name] for name in names}
