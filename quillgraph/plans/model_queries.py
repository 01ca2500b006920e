"""Queries through the model hooks, with the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonfix
from ..operators import graph, maintenance, models, retrieval, vectors
from .tables import table


def embedded_names(spark, d):
    n = table(spark, d, "entity_node").select("id", "name").distinct()
    return models.embed(n, "id", "name", models.HashEmbedder()).select("id", F.size("embedding").alias("size"), "error")


def reranked_terms(spark, d):
    """The three best of each reference term's ten nearest terms by name."""
    terms = table(spark, d, "standard_entity").select(F.col("term_id").cast("string").alias("id"), "term")
    e = models.embed(terms, "id", "term", models.HashEmbedder()).select("id", "embedding")
    near = vectors.top_k(e, e, 10).join(terms, "id").withColumnRenamed("term", "text")
    asked = near.join(terms.select(F.col("id").alias("q"), F.col("term").alias("said")), F.col("query") == F.col("q")).drop("q")
    hits = asked.select(F.col("said").alias("query"), "text", "place")
    return models.rerank(hits, models.OverlapReranker(), 3).select("query", "text", F.round("score", 6).alias("score"))


def extracted_triplets(spark, d):
    said = models.extract(table(spark, d, "documents"), "doc_id", "text", models.PatternExtractor(("就", "往往", "依赖")))
    return said.select("doc_id", F.explode(jsonfix.triplets(F.col("said"))).alias("x")).groupBy("x.relation").agg(F.count(F.lit(1)).alias("n"))


def linked_pipeline(spark, d):
    """A whole search for each typed name: intent, rewriting, linking, matching, one line each."""
    asked = table(spark, d, "entity_node").where("source = 'manual' and name is not null").select("id", "name").distinct()
    best = retrieval.intent(F.col("name"))
    put = asked.select("id", "name", best["intent"].alias("intent"), retrieval.rewrite(F.col("name"), best["intent"]).alias("query"))
    linked = retrieval.mentions(put, table(spark, d, "standard_entity"), "id", "query").groupBy("id").agg(F.count(F.lit(1)).alias("n_linked"))
    known = table(spark, d, "triplet").select(F.explode(F.array("head", "tail")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_edges"))
    return put.join(linked, "id", "left").join(known, "name", "left").select("id", "intent", "query", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def model_intents(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return models.classify(docs, "doc_id", "text", models.NameClassifier()).select("doc_id", "intent", "confidence", "by_model")


def low_relevance_nodes(spark, d):
    """Names that the rules of cleaning keep and the reranker finds irrelevant."""
    triplets = table(spark, d, "triplet")
    kept = maintenance.clean_nodes(graph.node_types(triplets), graph.edges_of(triplets))[0]
    return models.low_relevance(kept, models.OverlapReranker())


def queries() -> dict:
    return {n: globals()[n] for n in ("embedded_names", "reranked_terms", "extracted_triplets", "linked_pipeline", "model_intents", "low_relevance_nodes")}


def oracle_sql() -> dict[str, str]:
    return {"embedded_names": "SELECT DISTINCT id, CASE WHEN name IS NOT NULL THEN 64 END AS size, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT id, name FROM entity_node)"}
