"""Operators on a directed property multigraph: edges (src, rel, dst) and nodes (name, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sizing import durable


def edges_of(triplets: DataFrame) -> DataFrame:
    """Distinct (src, rel, dst) of triplets whose three parts are neither null nor blank."""
    parts = [F.col(c) for c in ("head", "relation", "tail")]
    full = reduce(lambda a, b: a & b, [F.trim(p) != "" for p in parts])
    return triplets.where(full).select(*[p.alias(n) for p, n in zip(parts, ("src", "rel", "dst"))]).distinct()


def node_types(triplets: DataFrame, default: str = "Entity") -> DataFrame:
    """(name, type) of every end of a triplet; the type of the first row that has one."""
    ends = triplets.select("triplet_id", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("head").alias("name"), F.col("head_type").alias("type")), F.struct(F.lit(1).alias("o"), F.col("tail").alias("name"), F.col("tail_type").alias("type")))).alias("e"))
    flat = ends.select("triplet_id", "e.o", "e.name", F.nullif(F.trim("e.type"), F.lit("")).alias("type")).where(F.trim("name") != "")
    first = F.min(F.when(F.col("type").isNotNull(), F.struct("triplet_id", "o", "type")))
    return flat.groupBy("name").agg(F.coalesce(first["type"], F.lit(default)).alias("type"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions as (src, rel, dst, direction), in one pass over them."""
    ways = F.array(
        F.struct("src", "rel", "dst", F.lit("out").alias("direction")),
        F.struct(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), F.lit("in").alias("direction")),
    )
    return edges.select(F.explode(ways).alias("w")).select("w.*")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, rel, dst) to walk along: as they are (out), turned (in) or both."""
    if direction == "out":
        return edges.select("src", "rel", "dst")
    both = both_ways(edges)
    return (both if direction == "both" else both.where("direction = 'in'")).select("src", "rel", "dst")


def neighbours(edges: DataFrame, k: int = 10, relations: list[str] | None = None) -> DataFrame:
    """(name, neighbour, rel, direction, place): up to ``k`` neighbours of each node, by name, then relation."""
    kept = edges.where(F.col("rel").isin(relations)) if relations else edges
    steps = both_ways(kept).distinct()
    order = W.partitionBy("src").orderBy("dst", "rel", "direction")
    ranked = steps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select(F.col("src").alias("name"), F.col("dst").alias("neighbour"), "rel", "direction", "place")


def paths(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", relations: list[str] | None = None) -> DataFrame:
    """(start, nodes, rels, hops): all paths of 1 to ``depth`` edges from the starts without a repeated node.

    Edges are filtered before the first step; every step is one equi-join.
    """
    kept = edges.where(F.col("rel").isin(relations)) if relations else edges
    steps = directed(kept, direction).select(F.col("src").alias("_at"), F.col("rel").alias("_rel"), F.col("dst").alias("_to"))
    at = starts.select(F.col("name").alias("start")).distinct().select("start", F.array("start").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    levels = []
    for _ in range(depth):
        grown = at.join(steps, F.element_at("nodes", -1) == F.col("_at")).where(~F.array_contains("nodes", F.col("_to")))
        at = grown.select("start", F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("rels", F.array("_rel")).alias("rels"))
        levels.append(at)
    return reduce(DataFrame.unionByName, levels).withColumn("hops", F.size("rels"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(source, target, nodes, rels, hops): one shortest path for each pair that ``depth`` edges connect.

    A breadth-first search by levels: the frontier holds each (source, node)
    once, with the least path by names, and a pair stops when it is found.
    """
    kept = edges.where(F.col("rel").isin(relations)) if relations else edges
    steps = durable(directed(kept, direction).where("src <> dst").groupBy("src", "dst").agg(F.min("rel").alias("rel")))
    wanted = pairs.select("source", "target").where("source <> target").distinct()
    front = wanted.select("source").distinct().select("source", F.col("source").alias("at"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    seen = front.select("source", "at")
    found = []
    for level in range(depth):
        grown = front.join(steps, front["at"] == steps["src"]).select("source", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"))
        fresh = grown.join(seen, ["source", "at"], "left_anti").groupBy("source", "at").agg(F.min(F.struct("nodes", "rels")).alias("p"))
        front = durable(fresh.select("source", "at", "p.nodes", "p.rels"))
        hits = front.join(wanted.withColumnRenamed("target", "at"), ["source", "at"])
        found.append(hits.select("source", F.col("at").alias("target"), "nodes", "rels"))
        if level + 1 < depth:
            seen = seen.unionByName(front.select("source", "at"))
    return reduce(DataFrame.unionByName, found).withColumn("hops", F.size("rels"))


def meta_paths(edges: DataFrame, pairs: DataFrame, relations: list[str], depth: int = 3, fallback: bool = True) -> DataFrame:
    """(source, target, nodes, rels, hops, is_meta_path): a shortest path of each pair along ``relations`` alone.

    With ``fallback``, pairs without one get a shortest path along any relation.
    """
    found = durable(shortest_paths(edges, pairs, depth, relations=relations).withColumn("is_meta_path", F.lit(True)))
    if not fallback:
        return found
    rest = pairs.select("source", "target").distinct().join(found, ["source", "target"], "left_anti")
    return found.unionByName(shortest_paths(edges, rest, depth).withColumn("is_meta_path", F.lit(False)))


def degrees(edges: DataFrame, least: int = 1) -> DataFrame:
    """(name, degree): distinct edges out plus distinct edges in; a loop counts twice."""
    ends = both_ways(edges.distinct())
    return ends.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def density(edges: DataFrame, types: DataFrame, direction: str = "out") -> DataFrame:
    """(name, rel, type, n): connections of each node by relation and by the neighbour's type."""
    steps = directed(edges, direction)
    typed = steps.join(types.select(F.col("name").alias("dst"), "type"), "dst", "left")
    return typed.groupBy(F.col("src").alias("name"), "rel", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """(name, total, n_rels, top_rel, top_type) of ``density``; ties go to the smaller name."""
    by_rel = counts.groupBy("name", "rel").agg(F.sum("n").alias("n"))
    by_type = counts.groupBy("name", "type").agg(F.sum("n").alias("n"))

    def top(df: DataFrame, col: str) -> DataFrame:
        best = df.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("m"), col)).alias("b"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        return best.select("name", F.col(f"b.{col}").alias(f"top_{col}"), "total", "kinds")

    rels = top(by_rel, "rel").withColumnRenamed("kinds", "n_rels")
    return rels.join(top(by_type, "type").select("name", "top_type"), "name")


def connected_within(edges: DataFrame, members: DataFrame, hops: int = 2) -> DataFrame:
    """(a, b), a < b: distinct pairs of members that at most ``hops`` (1 or 2) undirected edges connect."""
    steps = both_ways(edges).select("src", "dst").where("src <> dst").distinct()
    names = members.select("name").distinct()
    first = steps.join(names, F.col("src") == F.col("name"), "left_semi")
    direct = first.join(names, F.col("dst") == F.col("name"), "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out = direct
    if hops > 1:
        # Middle nodes that two members touch; members are few against the nodes, so the middle is filtered on both sides.
        half = first.select(F.col("src").alias("a"), F.col("dst").alias("mid"))
        other = first.select(F.col("src").alias("b"), F.col("dst").alias("mid"))
        out = out.unionByName(half.join(other, "mid").where("a <> b").select("a", "b"))
    return out.where("a < b").distinct()


def community(edges: DataFrame, members: DataFrame, hops: int = 2, least: float = 0.3, core: int = 5) -> DataFrame:
    """(n_members, n_pairs, density, is_community, core): how closely the members are connected, and the best connected."""
    pairs = connected_within(edges, members, hops)
    n = members.select("name").distinct().agg(F.count(F.lit(1)).alias("n_members"))
    total = pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d"))
    best = ends.orderBy(F.desc("d"), "name").limit(core).agg(F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("m"), "name"))).alias("c"))
    value = F.coalesce(F.try_divide(F.col("n_pairs"), F.col("n_members") * (F.col("n_members") - 1) / 2), F.lit(0.0))
    one = n.crossJoin(total).crossJoin(best)  # one row each
    return one.select("n_members", "n_pairs", F.round(value, 6).alias("density"), ((F.col("n_members") >= 3) & (value >= least)).alias("is_community"), F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("core"))


def community_paths(edges: DataFrame, members: DataFrame, hops: int = 2, least: float = 0.3, core: int = 5, most: int = 10) -> DataFrame:
    """(source, target, nodes, rels, place): the connected pairs of a community's ``core`` best connected members as paths.

    Pairs come in order of the members' places, ``most`` at most; members that
    are no community have none.
    """
    pairs = durable(connected_within(edges, members, hops))
    tight = community(edges, members, hops, least, core).where("is_community").select("is_community")  # one row at most
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("d"))
    best = ends.orderBy(F.desc("d"), "name").limit(core).withColumn("p", F.row_number().over(W.orderBy(F.desc("d"), "name")))  # ``core`` rows
    two = best.select(F.col("p").alias("p1"), F.col("name").alias("source")).join(best.select(F.col("p").alias("p2"), F.col("name").alias("target")), F.col("p1") < F.col("p2"))
    linked = two.join(pairs, (F.least("source", "target") == F.col("a")) & (F.greatest("source", "target") == F.col("b")), "left_semi").crossJoin(tight)
    ranked = linked.withColumn("place", F.row_number().over(W.orderBy("p1", "p2"))).where(F.col("place") <= most)
    return ranked.select("source", "target", F.array("source", "target").alias("nodes"), F.array(F.lit("关联")).alias("rels"), "place")


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(group_id, id): connected ids under the smallest of their group, by stars of smaller neighbours.

    Each round ties every node to its smallest neighbour and every neighbour to
    that one; rounds, materialised, end when every group is a star.
    """
    links = links.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).where("x is not null and y is not null and x <> y")
    now = durable(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while True:
        both = now.select("x", "y").unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.distinct()
        small = down.groupBy("x").agg(F.min("y").alias("m"))
        linked = down.join(small, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        then = durable(linked.where("x <> y").distinct())
        if then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty():
            break
        now = then
    return now.select(F.col("y").alias("group_id"), F.col("x").alias("id"))


def path_text(nodes: Column, rels: Column) -> Column:
    """``a->r->b->…`` of a path's nodes and relations."""
    steps = F.zip_with(rels, F.slice(nodes, 2, F.size(rels)), lambda r, n: F.concat(F.lit("->"), r, F.lit("->"), n))
    return F.concat(F.element_at(nodes, 1), F.array_join(steps, ""))
