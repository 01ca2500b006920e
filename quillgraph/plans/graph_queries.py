"""Queries on the graph of extracted triplets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from .tables import spaces_only, table

#: Relations that count as meaning that one thing brings about another.
CAUSES = ["导致", "并发", "影响因素"]
CLINICAL = ["治疗方式", "检查方法", "观察指标", "REQUIRES"]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.edges_of(table(spark, d, "triplet"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return g.node_types(table(spark, d, "triplet"))


def _busiest(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The n nodes with most edges."""
    return g.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "name").limit(n)


def one_hop_neighbors(spark, d):
    return g.neighbours(_edges(spark, d))


def neighbors_by_relation(spark, d):
    return g.neighbours(_edges(spark, d), 5, CAUSES)


def two_hop_limit(spark, d):
    found = g.paths(_edges(spark, d), _busiest(spark, d, 1), 2, relations=CLINICAL).where("hops = 2")
    rows = found.select("start", F.col("rels")[0].alias("rel_1"), F.col("nodes")[1].alias("middle"), F.col("rels")[1].alias("rel_2"), F.col("nodes")[2].alias("target"))
    return rows.orderBy("rel_1", "middle", "rel_2", "target").limit(50)


def _asked(spark, d):
    """The query set: heads of the triplets whose id is divisible by 50, against all edges."""
    return table(spark, d, "triplet").where("triplet_id % 50 = 0 and trim(head) <> ''").select(F.col("head").alias("name")).distinct()


def variable_length_paths(spark, d):
    """Paths of one to three edges of the clinical relations from each node of the query set, by length."""
    found = g.paths(_edges(spark, d), _asked(spark, d), 3, relations=CLINICAL)
    return found.groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n_paths"))


def path_strings(spark, d):
    """Paths of one edge of a causal relation, in either direction, from each node of the query set."""
    found = g.paths(_edges(spark, d), _asked(spark, d), 1, direction="both", relations=CAUSES)
    return found.select("start", g.path_text(F.col("nodes"), F.col("rels")).alias("path"))


def _pairs(spark, d):
    """Pairs of the first ten entities, as a search makes them."""
    top = _busiest(spark, d, 10).select("name")
    return top.select(F.col("name").alias("source")).join(top.select(F.col("name").alias("target")), F.col("source") < F.col("target"))


def shortest_path_hops(spark, d):
    return g.shortest_paths(_edges(spark, d), _pairs(spark, d), 3).select("source", "target", "hops")


def meta_path_hops(spark, d):
    return g.shortest_paths(_edges(spark, d), _pairs(spark, d), 3, relations=CAUSES).select("source", "target", "hops")


def meta_path_or_shortest(spark, d):
    return g.meta_paths(_edges(spark, d), _pairs(spark, d), CAUSES).select("source", "target", "hops", "is_meta_path")


def shortest_path_text(spark, d):
    return g.shortest_paths(_edges(spark, d), _pairs(spark, d), 3).select("source", "target", g.path_text(F.col("nodes"), F.col("rels")).alias("path"))


def degree_having(spark, d):
    return g.degrees(_edges(spark, d), 3)


def density_profile(spark, d):
    return g.density(_edges(spark, d), _types(spark, d))


def dominant_relation(spark, d):
    return g.profile(g.density(_edges(spark, d), _types(spark, d)))


def graph_counts(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    return nodes.crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("rel").alias("n_relations")))  # one row each


def type_distribution(spark, d):
    return _types(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def relation_distribution(spark, d):
    return _edges(spark, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def schema_catalogue(spark, d):
    labels = _types(spark, d).select(F.lit("label").alias("kind"), F.col("type").alias("name")).distinct()
    return labels.unionByName(_edges(spark, d).select(F.lit("relation").alias("kind"), F.col("rel").alias("name")).distinct())


def typed_edges(spark, d):
    e, t = _edges(spark, d), _types(spark, d)
    one = e.join(t.select(F.col("name").alias("src"), F.col("type").alias("src_type")), "src")
    return one.join(t.select(F.col("name").alias("dst"), F.col("type").alias("dst_type")), "dst").groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n"))


def merge_stats(spark, d):
    """Rows, sources, targets and relations that one-hop paths of each relation reach."""
    return _edges(spark, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


def pairs_within_two_hops(spark, d):
    return g.connected_within(_edges(spark, d), _busiest(spark, d, 40), 2)


def community_density(spark, d):
    return g.community(_edges(spark, d), _busiest(spark, d, 40), 2)


def community_paths(spark, d):
    return g.community_paths(_edges(spark, d), _busiest(spark, d, 40)).select("source", "target", g.path_text(F.col("nodes"), F.col("rels")).alias("path"), "place")


def isolated_nodes(spark, d):
    ends = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    named = table(spark, d, "entity_node").where("name is not null").select("name").distinct()
    return named.join(ends, "name", "left_anti")


def node_projection(spark, d):
    n = table(spark, d, "entity_node").select("id", "name", "label", "props").where("name is not null").dropDuplicates(["id"])
    shown = F.map_filter("props", lambda k, v: ~k.startswith("embedding") & ~k.startswith("__") & v.isNotNull())
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Unknown"))
    return n.select(F.concat(F.lit("node_"), "id").alias("node_id"), "name", label.alias("label"), F.coalesce(F.size(F.map_keys(shown)), F.lit(0)).alias("n_props"))


def edge_scan(spark, d):
    e, t = _edges(spark, d), _types(spark, d)
    hidden = F.col("rel").contains("EMBEDDING") | F.col("rel").contains("embedding")
    seen = t.where(~F.col("type").isin("Embedding", "__Embedding__")).select("name")
    kept = e.where(~hidden).join(seen, F.col("src") == F.col("name"), "left_semi").join(seen, F.col("dst") == F.col("name"), "left_semi")
    return kept.orderBy("src", "rel", "dst").limit(1000)


def export_graph(spark, d):
    """The exported nodes and edges as one list of lines, trimmed and distinct."""
    t = _types(spark, d).select(F.lit("node").alias("kind"), F.trim("name").alias("a"), F.col("type").alias("b"), F.lit("").alias("c")).distinct()
    e = _edges(spark, d).select(F.lit("edge").alias("kind"), F.trim("src").alias("a"), F.trim("rel").alias("b"), F.trim("dst").alias("c")).distinct()
    return t.unionByName(e)


def table_graph_expand(spark, d):
    """One hop around nations in the graph of the relational tables: customers and suppliers by nation."""
    customers = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.lit("IN_NATION").alias("rel"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.lit("IN_NATION").alias("rel"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst"))
    regions = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.lit("IN_REGION").alias("rel"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"))
    e = customers.unionByName(suppliers).unionByName(regions)
    return g.degrees(e).join(e.select(F.col("dst").alias("name")).distinct(), "name", "left_semi")


def event_transitions(spark, d):
    """Edges between consecutive event types of a user."""
    from pyspark.sql import Window as W

    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = table(spark, d, "events").select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null")
    return moves.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(spark, d):
    """Pairs of types whose entities are named in the same item; types are few, where pairs of a large item's entities would be without bound."""
    t = table(spark, d, "triplet").where("item_id is not null")
    ends = t.select("item_id", F.explode(F.array(F.struct(F.trim("head_type").alias("k")), F.struct(F.trim("tail_type").alias("k")))).alias("e")).select("item_id", "e.k").where("k <> ''").distinct()
    return ends.select("item_id", F.col("k").alias("a")).join(ends.select("item_id", F.col("k").alias("b")), "item_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_items"))


_E = "e AS (SELECT DISTINCT head AS src, relation AS rel, tail AS dst FROM triplet WHERE trim(head) <> '' AND trim(relation) <> '' AND trim(tail) <> '')"
_T = """x AS (SELECT triplet_id, 0 AS o, head AS name, nullif(trim(head_type), '') AS type FROM triplet UNION ALL SELECT triplet_id, 1, tail, nullif(trim(tail_type), '') FROM triplet),
t AS (SELECT name, coalesce(arg_min(type, (triplet_id, o)) FILTER (type IS NOT NULL), 'Entity') AS type FROM x WHERE trim(name) <> '' GROUP BY name)"""
_B = "b AS (SELECT src, rel, dst, 'out' AS direction FROM e UNION ALL SELECT dst, rel, src, 'in' FROM e)"
_D = "dg AS (SELECT src AS name, count(*) AS degree FROM b GROUP BY src)"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _neighbours(k: int, relations: list[str] | None = None) -> str:
    only = f"WHERE rel IN {_in(relations)}" if relations else ""
    return f"WITH {_E}, {_B} SELECT src AS name, dst AS neighbour, rel, direction, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, rel, direction) AS place FROM b {only}) WHERE place <= {k}"


def _hops(relations: list[str] | None = None) -> str:
    only = f"WHERE rel IN {_in(relations)}" if relations else ""
    return f"""WITH {_E}, {_B}, {_D}, top AS (SELECT name FROM dg ORDER BY degree DESC, name LIMIT 10),
s AS (SELECT DISTINCT src, dst FROM b {only}),
l1 AS (SELECT DISTINCT t.name AS source, s.dst AS node FROM top t JOIN s ON s.src = t.name),
l2 AS (SELECT DISTINCT l.source, s.dst AS node FROM l1 l JOIN s ON s.src = l.node),
l3 AS (SELECT DISTINCT l.source, s.dst AS node FROM l2 l JOIN s ON s.src = l.node),
h AS (SELECT *, 1 AS hops FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)
SELECT source, node AS target, min(hops) AS hops FROM h JOIN top ON top.name = h.node WHERE source < node GROUP BY 1, 2"""


_WITHIN = f"""WITH {_E}, {_B}, {_D}, m AS (SELECT name FROM dg ORDER BY degree DESC, name LIMIT 40),
s AS (SELECT DISTINCT src, dst FROM b WHERE src <> dst), f AS (SELECT s.* FROM s JOIN m ON m.name = s.src),
p AS (SELECT src AS a, dst AS b FROM f JOIN m ON m.name = f.dst UNION SELECT x.src, y.src FROM f x JOIN f y ON x.dst = y.dst),
q AS (SELECT DISTINCT a, b FROM p WHERE a < b)"""


def queries() -> dict:
    names = """one_hop_neighbors neighbors_by_relation two_hop_limit variable_length_paths path_strings shortest_path_hops meta_path_hops meta_path_or_shortest shortest_path_text degree_having
    density_profile dominant_relation graph_counts type_distribution relation_distribution schema_catalogue typed_edges merge_stats pairs_within_two_hops
    community_density community_paths isolated_nodes node_projection edge_scan export_graph table_graph_expand event_transitions cooccurrence""".split()
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {name: spaces_only(sql) for name, sql in _sql().items()}


def _sql() -> dict[str, str]:
    clinical = _in(CLINICAL)
    steps = f"k AS (SELECT * FROM e WHERE rel IN {clinical})"
    return {
        "one_hop_neighbors": _neighbours(10),
        "neighbors_by_relation": _neighbours(5, CAUSES),
        "two_hop_limit": f"""WITH {_E}, {_B}, {_D}, {steps}, top AS (SELECT name FROM dg ORDER BY degree DESC, name LIMIT 1)
SELECT a.src AS start, a.rel AS rel_1, a.dst AS middle, c.rel AS rel_2, c.dst AS target FROM top JOIN k a ON a.src = top.name JOIN k c ON c.src = a.dst
WHERE a.dst <> a.src AND c.dst <> a.src AND c.dst <> a.dst ORDER BY 2, 3, 4, 5 LIMIT 50""",
        "variable_length_paths": f"""WITH RECURSIVE {_E}, {steps}, st AS (SELECT DISTINCT head AS src FROM triplet WHERE triplet_id % 50 = 0 AND trim(head) <> ''),
p(start, last, nodes, hops) AS (SELECT st.src, k.dst, [k.src, k.dst], 1 FROM st JOIN k ON k.src = st.src WHERE k.dst <> k.src
UNION ALL SELECT p.start, k.dst, list_append(p.nodes, k.dst), p.hops + 1 FROM p JOIN k ON k.src = p.last WHERE p.hops < 3 AND NOT list_contains(p.nodes, k.dst))
SELECT start, hops, count(*) AS n_paths FROM p GROUP BY 1, 2""",
        "path_strings": f"""WITH {_E}, {_B}, top AS (SELECT DISTINCT head AS name FROM triplet WHERE triplet_id % 50 = 0 AND trim(head) <> '')
SELECT src AS start, src || '->' || rel || '->' || dst AS path FROM b JOIN top ON top.name = b.src WHERE rel IN {_in(CAUSES)} AND src <> dst""",
        "shortest_path_hops": _hops(),
        "meta_path_hops": _hops(CAUSES),
        "degree_having": f"WITH {_E}, {_B}, {_D} SELECT * FROM dg WHERE degree >= 3",
        "density_profile": f"WITH {_E}, {_T} SELECT src AS name, rel, coalesce(type, 'unknown') AS type, count(*) AS n FROM e LEFT JOIN t ON t.name = e.dst GROUP BY 1, 2, 3",
        "dominant_relation": f"""WITH {_E}, {_T}, c AS (SELECT src AS name, rel, coalesce(type, 'unknown') AS type FROM e LEFT JOIN t ON t.name = e.dst),
r AS (SELECT name, rel, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT name, type, count(*) AS n FROM c GROUP BY 1, 2)
SELECT name, top_rel, total, n_rels, top_type FROM (SELECT name, arg_min(rel, (-n, rel)) AS top_rel, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_rels FROM r GROUP BY name)
JOIN (SELECT name, arg_min(type, (-n, type)) AS top_type FROM y GROUP BY name) USING (name)""",
        "graph_counts": f"WITH {_E} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_nodes, count(*) AS n_edges, count(DISTINCT rel) AS n_relations FROM e",
        "type_distribution": f"WITH {_T} SELECT type, count(*) AS n FROM t GROUP BY type",
        "relation_distribution": f"WITH {_E} SELECT rel, count(*) AS n FROM e GROUP BY rel",
        "schema_catalogue": f"WITH {_E}, {_T} SELECT DISTINCT 'label' AS kind, type AS name FROM t UNION ALL SELECT DISTINCT 'relation', rel FROM e",
        "typed_edges": f"WITH {_E}, {_T} SELECT a.type AS src_type, rel, c.type AS dst_type, count(*) AS n FROM e JOIN t a ON a.name = src JOIN t c ON c.name = dst GROUP BY 1, 2, 3",
        "merge_stats": f"WITH {_E} SELECT rel, count(*) AS n_rows, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM e GROUP BY rel",
        "pairs_within_two_hops": _WITHIN + " SELECT a, b FROM q",
        "community_density": _WITHIN + """, n AS (SELECT count(*) AS n FROM m), k AS (SELECT count(*) AS k FROM q),
d AS (SELECT name, count(*) AS d FROM (SELECT a AS name FROM q UNION ALL SELECT b FROM q) GROUP BY name ORDER BY d DESC, name LIMIT 5)
SELECT n AS n_members, k AS n_pairs, round(k / (n * (n - 1) / 2), 6) AS density, n >= 3 AND k / (n * (n - 1) / 2) >= 0.3 AS is_community,
(SELECT coalesce(string_agg(name, ',' ORDER BY d DESC, name), '') FROM d) AS core FROM n, k""",
        "isolated_nodes": f"WITH {_E} SELECT DISTINCT name FROM entity_node WHERE name IS NOT NULL AND name NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
        "node_projection": """SELECT DISTINCT 'node_' || id AS node_id, name, coalesce(nullif(trim(label), ''), 'Unknown') AS label,
CAST(coalesce(len(list_filter(map_entries(props), lambda x: x.key NOT LIKE 'embedding%' AND NOT starts_with(x.key, '__') AND x.value IS NOT NULL)), 0) AS INT) AS n_props FROM entity_node WHERE name IS NOT NULL""",
        "edge_scan": f"""WITH {_E}, {_T}, v AS (SELECT name FROM t WHERE type NOT IN ('Embedding', '__Embedding__'))
SELECT * FROM e WHERE rel NOT LIKE '%EMBEDDING%' AND rel NOT LIKE '%embedding%' AND src IN (SELECT name FROM v) AND dst IN (SELECT name FROM v) ORDER BY src, rel, dst LIMIT 1000""",
        "export_graph": f"WITH {_E}, {_T} SELECT DISTINCT 'node' AS kind, trim(name) AS a, type AS b, '' AS c FROM t UNION ALL SELECT DISTINCT 'edge', trim(src), trim(rel), trim(dst) FROM e",
        "table_graph_expand": """WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation), z AS (SELECT src AS name FROM e UNION ALL SELECT dst FROM e)
SELECT name, count(*) AS degree FROM z WHERE name IN (SELECT dst FROM e) GROUP BY name""",
        "event_transitions": "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2",
        "cooccurrence": """WITH k AS (SELECT DISTINCT item_id, k FROM (SELECT item_id, trim(head_type) AS k FROM triplet UNION ALL SELECT item_id, trim(tail_type) FROM triplet) WHERE item_id IS NOT NULL AND k <> '')
SELECT x.k AS a, y.k AS b, count(*) AS n_items FROM k x JOIN k y ON x.item_id = y.item_id AND x.k < y.k GROUP BY 1, 2""",
    }
