"""Exact vector operators: top-k of given queries, threshold joins, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of the threshold join; a task holds two blocks.
BLOCK = 4_096


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", per_pass: int = 2_000) -> DataFrame:
    """(query, id, cosine, place): the ``k`` most similar vectors of each query, itself aside.

    Queries are few and are held by every task, ``per_pass`` at a time; vectors
    are read once a pass and never shuffled, only each task's best are.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{vector}`").alias("v")).where("v is not null")
    asked = queries.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{vector}`").alias("v")).where("v is not null")
    passes = max(1, -(-asked.count() // per_pass))
    out = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        rows = part.collect()  # per_pass queries
        held = spark.sparkContext.broadcast(([r["id"] for r in rows], np.array([r["v"] for r in rows], np.float64)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            if not names:
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best: list[list[tuple[float, str]]] = [[] for _ in names]
            for b in batches:
                x = np.stack(b["v"].to_list()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                ids = b["id"].to_numpy()
                close = q @ x.T
                n = min(k + 1, len(ids))
                top = np.argpartition(-close, n - 1, axis=1)[:, :n]
                for j, name in enumerate(names):
                    found = [(-close[j, t], ids[t]) for t in top[j] if ids[t] != name]
                    best[j] = sorted(best[j] + found)[:k]
            yield pd.DataFrame([(names[j], i, -c) for j, own in enumerate(best) for c, i in own], columns=["query", "id", "cosine"])

        one = slim.mapInPandas(run, "query string, id string, cosine double")
        out = one if out is None else out.unionByName(one)
    from .retrieval import top_by

    return top_by(out.withColumn("cosine", F.round("cosine", 6)), ["query"], k, F.desc("cosine"), F.asc("id"))


def similar_pairs(vectors: DataFrame, least: float, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine): all pairs with at least this cosine, a < b, exactly.

    Vectors are cut into blocks, and every two blocks meet in one task as a
    matrix product; only pairs over the threshold leave it.
    """
    slim = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("v is not null")
    n = max(1, -(-slim.count() // block))
    kind = slim.schema[0].dataType.simpleString()
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = slim.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks = spread.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def run(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = key_
        left, right = rows[rows["own"] == x], rows[rows["own"] == y]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        u, w = (np.stack(p["v"].to_list()).astype(np.float64) for p in (left, right))
        u, w = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (u, w))
        i, j = np.nonzero((close := u @ w.T) >= least)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if x == y else a != b
        a, b, c = a[keep], b[keep], close[i, j][keep]
        turned = a > b
        return pd.DataFrame({"a": np.where(turned, b, a), "b": np.where(turned, a, b), "cosine": c})

    return tasks.groupBy("x", "y").applyInPandas(run, f"a {kind}, b {kind}, cosine double")


def mean_pool(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(*by, place, value): the mean of the vectors of each group, by place."""
    flat = vectors.select(*by, F.posexplode(vector).alias("place", "x"))
    return flat.groupBy(*by, "place").agg(F.avg(F.col("x").cast("double")).alias("value"))
