"""Writers: graph exports, reports, ledgers, backups, evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes and edges as JSON lines under the path, and a summary of types and relations, which is returned."""
    nodes.distinct().write.mode("overwrite").json(f"{path}/nodes")
    edges.distinct().write.mode("overwrite").json(f"{path}/edges")
    types = nodes.distinct().groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    relations = edges.distinct().groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    summary = types.unionByName(relations)
    summary.orderBy("kind", F.desc("n"), "name").write.mode("overwrite").json(f"{path}/summary")
    return summary


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table in place of the one at the path, by column values if asked; the reader of a relation then skips the others."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def alignment_report(pairs: DataFrame, path: str) -> None:
    """Lines ``[STATUS] a <-> b (sim)``, the most similar first."""
    line = F.concat(F.lit("["), "status", F.lit("] "), "a", F.lit(" <-> "), "b", F.lit(" ("), F.format_number("cosine", 4), F.lit(")"))
    pairs.orderBy(F.desc("cosine"), "a", "b").select(line.alias("value")).write.mode("overwrite").text(path)


def save_ledger(files: DataFrame, path: str) -> None:
    files.select("path", "hash").write.mode("append").json(path)


def save_deleted(deleted: DataFrame, path: str) -> None:
    """The backup that ``restore_nodes`` reads; to be written before nodes are deleted."""
    deleted.write.mode("overwrite").json(path)


def save_evaluation(rows: DataFrame, path: str) -> None:
    """A CSV with header; arrays as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def control_row(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_documents, n_nodes, n_edges): the true counts of a build."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((documents, "n_documents"), (nodes, "n_nodes"), (edges, "n_edges"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
