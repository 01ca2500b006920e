"""Queries of graph upkeep and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import maintenance as m
from ..operators import vectors as v
from ..streaming import progress as p
from .tables import spaces_only, table


def _edges(spark, d):
    return g.edges_of(table(spark, d, "triplet"))


def _nodes(spark, d):
    return g.node_types(table(spark, d, "triplet"))


def cleaned_edges(spark, d):
    return m.clean_nodes(_nodes(spark, d), _edges(spark, d))[1].groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def deleted_nodes(spark, d):
    return m.clean_nodes(_nodes(spark, d), _edges(spark, d))[2].select("name", "reason")


def restored_nodes(spark, d):
    kept, _, deleted = m.clean_nodes(_nodes(spark, d), _edges(spark, d))
    return m.restore_nodes(kept, deleted).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, d):
    """Pairs of entities with a recorded similarity; the stronger value of a pair counts."""
    a = table(spark, d, "alignment_pair").where("left_id is not null and right_id is not null and left_id <> right_id and sim is not null and not isnan(sim)")
    return a.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.max("sim").alias("cosine"))


def alignment_report(spark, d):
    return m.review_pairs(_pairs(spark, d))


def aligned_groups(spark, d):
    return m.align(table(spark, d, "entity_node").select("id", "name").distinct(), _pairs(spark, d))


def vector_groups(spark, d):
    """Vectors tied by a cosine of 0.4, as groups."""
    near = v.similar_pairs(table(spark, d, "embeddings"), 0.4, "vec_id")
    return g.groups(near.select(F.lpad(F.col("a").cast("string"), 9, "0").alias("a"), F.lpad(F.col("b").cast("string"), 9, "0").alias("b")))


def migrated_edges(spark, d):
    """Edges after entities of one normalised name were merged."""
    e = _edges(spark, d)
    names = e.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("id", F.col("name"))
    none = spark.createDataFrame([], "a string, b string, cosine double")
    return m.migrate_edges(e, m.align(names, none)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_sources"))


def sunk_properties(spark, d):
    return m.sink_properties(_edges(spark, d), 15, 18)[0]


def sunk_edges(spark, d):
    return m.sink_properties(_edges(spark, d), 15, 18)[1].groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def orphaned_nodes(spark, d):
    return m.sink_properties(_edges(spark, d), 15, 18)[2]


def vocabulary(spark, d):
    return m.expand_vocabulary(_edges(spark, d), _nodes(spark, d), table(spark, d, "standard_entity"))


def upserted_nodes(spark, d):
    """Nodes of the first source over those of the second: match or create by id."""
    n = table(spark, d, "entity_node").select("id", "name", "label", "source", "created_at").distinct()
    old = n.where("source = 'import'").select("id", "name", F.lit(None).cast("string").alias("label"), "created_at")
    new = n.where("source is null or source = 'extract' or source = 'import'").select("id", "name", "label", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return m.upsert(old, new, "id")


def seed_edges(spark, d):
    """Seed edges whose source exists; targets are made."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("source"), F.lit("IN").alias("rel"), F.col("n_regionkey").alias("k"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("target"))
    have = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source")).distinct()
    return nation.join(region, "k").join(have, "source", "left_semi").select("source", "rel", "target").dropDuplicates()


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, d):
    return p.event_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def latest_progress(spark, d):
    found = p.drained(p.latest(_stream(spark, d), "user_id", "ts", "value"), "complete")
    return found.select("client", F.col("at").cast("timestamp_ntz").alias("at"), "value")


def windowed_events(spark, d):
    found = p.drained(p.windowed(_stream(spark, d), "ts", "event_type"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def running_max_progress(spark, d):
    return p.monotone(_events(spark, d), "user_id", "ts", "value", "event_id").select("event_id", "shown")


def running_max_stream(spark, d):
    found = p.drained(p.monotone_stream(_stream(spark, d), "user_id", "ts", "value", "event_id", forget=30 * 86_400), "append")
    return found.select(F.col("seq").alias("event_id"), "shown")


def activity_sessions(spark, d):
    found = p.sessions(_events(spark, d), "user_id", "ts")
    return found.select("client", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def ttl_eviction(spark, d):
    return p.alive(_events(spark, d), "user_id", "ts", 6 * 3600).select("client", F.col("at").cast("timestamp_ntz").alias("at"))


def remaining_time(spark, d):
    return p.remaining(_events(spark, d).where("value > 0"), "user_id", "ts", "value").select("event_id", "eta")


def new_texts_stream(spark, d):
    """Distinct texts among documents that arrive as files: equal texts are taken in once."""
    docs = p.event_stream(spark, f"{d}/documents.parquet", table(spark, d, "documents").schema).where("text is not null")
    fresh = docs.select(F.md5("text").alias("hash")).dropDuplicates(["hash"])
    return p.drained(fresh, "append")


def _sql() -> dict[str, str]:
    from ..functions import text as t
    from ..functions.vocab import CLASSES, SINKING, SUNK_AS
    from .text_queries import _sql as text_sql

    q = lambda x: "'" + x.replace("'", "''") + "'"
    e = "e AS (SELECT DISTINCT head AS src, relation AS rel, tail AS dst FROM triplet WHERE trim(head) <> '' AND trim(relation) <> '' AND trim(tail) <> '')"
    y = """x AS (SELECT triplet_id, 0 AS o, head AS name, nullif(trim(head_type), '') AS type FROM triplet UNION ALL SELECT triplet_id, 1, tail, nullif(trim(tail_type), '') FROM triplet),
t AS (SELECT name, coalesce(arg_min(type, (triplet_id, o)) FILTER (type IS NOT NULL), 'Entity') AS type FROM x WHERE trim(name) <> '' GROUP BY name)"""
    stops = q("|".join(f"(?:{s})" for s in t.STOP_PATTERNS))
    judged = f"j AS (SELECT *, CASE WHEN length(name) > 15 THEN 'Length > 15' WHEN regexp_matches(name, {stops}) THEN 'Matches Stop Pattern' END AS reason FROM t)"
    pairs = "p AS (SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, max(sim) AS cosine FROM alignment_pair WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id AND sim IS NOT NULL AND NOT isnan(sim) GROUP BY 1, 2)"
    walk = "r(id, seen) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen) SELECT min(seen) AS group_id, id FROM r GROUP BY id HAVING min(seen) < id"
    names = text_sql()["normalize_names"]
    norm_names = names.replace("SELECT id, CASE", "SELECT id, name AS raw, CASE", 1)
    norm_edges = norm_names.replace("SELECT DISTINCT id, name,", "SELECT DISTINCT name AS id, name,").replace("FROM entity_node", "FROM (SELECT src AS name FROM e UNION SELECT dst FROM e)")
    sinks = f"length(dst) > 15 AND (rel IN ({', '.join(map(q, SINKING))}) OR length(dst) > 18)"
    prop = "CASE rel " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SUNK_AS.items()) + " ELSE 'description' END"
    node = "(SELECT DISTINCT id, name, label, source, created_at FROM entity_node)"
    return {
        "cleaned_edges": f"WITH {e}, {y}, {judged}, b AS (SELECT name FROM j WHERE reason IS NOT NULL) SELECT rel, count(*) AS n FROM e WHERE src NOT IN (SELECT name FROM b) AND dst NOT IN (SELECT name FROM b) GROUP BY rel",
        "deleted_nodes": f"WITH {y}, {judged} SELECT name, reason FROM j WHERE reason IS NOT NULL",
        "restored_nodes": f"WITH {y}, {judged} SELECT type, count(*) AS n FROM j WHERE reason IS NULL OR reason LIKE '%Length%' GROUP BY type",
        "alignment_report": f"WITH {pairs} SELECT CASE WHEN cosine >= 0.92 THEN 'MERGE' ELSE 'REVIEW' END AS status, a, b, cosine FROM p WHERE cosine >= 0.85",
        "aligned_groups": f"""WITH RECURSIVE {pairs}, n AS ({norm_names}), k AS (SELECT id, name, min(id) OVER (PARTITION BY name) AS a FROM n WHERE name <> '' AND name <> 'Unknown_Entity'),
l AS (SELECT a, id AS b FROM k WHERE id <> a UNION SELECT a, b FROM p WHERE cosine >= 0.92), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {walk}""",
        "vector_groups": f"""WITH RECURSIVE l AS (SELECT lpad(CAST(x.vec_id AS VARCHAR), 9, '0') AS a, lpad(CAST(z.vec_id AS VARCHAR), 9, '0') AS b FROM embeddings x JOIN embeddings z ON x.vec_id < z.vec_id
WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) >= 0.4), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {walk}""",
        "migrated_edges": f"""WITH {e}, n AS ({norm_edges}), k AS (SELECT id, CASE WHEN name <> '' AND name <> 'Unknown_Entity' THEN min(id) OVER (PARTITION BY name) ELSE id END AS a FROM n),
m AS (SELECT DISTINCT coalesce(x.a, src) AS src, rel, coalesce(z.a, dst) AS dst FROM e LEFT JOIN k x ON x.id = src LEFT JOIN k z ON z.id = dst)
SELECT rel, count(*) AS n, count(DISTINCT src) AS n_sources FROM m WHERE src <> dst GROUP BY rel""",
        "sunk_properties": f"WITH {e} SELECT src AS name, {prop} AS property, string_agg(DISTINCT dst, '; ' ORDER BY dst) AS value FROM e WHERE {sinks} GROUP BY 1, 2",
        "sunk_edges": f"WITH {e} SELECT rel, count(*) AS n FROM e WHERE NOT ({sinks}) GROUP BY rel",
        "orphaned_nodes": f"WITH {e}, k AS (SELECT * FROM e WHERE NOT ({sinks})) SELECT DISTINCT dst AS name FROM e WHERE {sinks} AND dst NOT IN (SELECT src FROM k UNION SELECT dst FROM k)",
        "vocabulary": f"""WITH {e}, {y}, g AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY name HAVING count(*) >= 3)
SELECT CASE WHEN type IN ({', '.join(map(q, CLASSES))}) THEN type ELSE '其他' END AS class, g.name, degree FROM g LEFT JOIN t USING (name) WHERE g.name NOT IN (SELECT term FROM standard_entity)""",
        "upserted_nodes": f"""WITH o AS (SELECT id, name, created_at FROM {node} WHERE source = 'import'), n AS (SELECT id, name, label, created_at + INTERVAL 1 DAY AS created_at FROM {node} WHERE source IS NULL OR source IN ('extract', 'import'))
SELECT id, coalesce(n.name, o.name) AS name, n.label AS label, coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n USING (id)""",
        "seed_edges": "SELECT DISTINCT n_name AS source, 'IN' AS rel, r_name AS target FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
        "latest_progress": "SELECT user_id AS client, max(ts) AS \"at\", arg_max(value, (ts, value)) AS value FROM events GROUP BY 1",
        "windowed_events": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "running_max_progress": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events",
        "running_max_stream": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events",
        "activity_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id AS client, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
        "ttl_eviction": "WITH s AS (SELECT user_id AS client, max(ts) AS t FROM events GROUP BY 1) SELECT client, t AS \"at\" FROM s WHERE floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(t)) <= 21600 ORDER BY t DESC, client LIMIT 1000",
        "remaining_time": "WITH s AS (SELECT event_id, value, floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY user_id))) AS s FROM events WHERE value > 0) SELECT event_id, greatest(round(s / (value / 100) - s), 0.0) AS eta FROM s",
        "new_texts_stream": "SELECT DISTINCT md5(text) AS hash FROM documents WHERE text IS NOT NULL",
    }


def queries() -> dict:
    names = """cleaned_edges deleted_nodes restored_nodes alignment_report aligned_groups vector_groups migrated_edges sunk_properties sunk_edges orphaned_nodes vocabulary upserted_nodes
    seed_edges latest_progress windowed_events running_max_progress running_max_stream activity_sessions ttl_eviction remaining_time new_texts_stream""".split()
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {name: spaces_only(sql) for name, sql in _sql().items()}
