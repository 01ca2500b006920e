"""Queries of chunking, retrieval and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from ..functions.similarity import text_similarity
from ..operators import chunking as c
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import vectors as v
from .tables import spaces_only, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


def _paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(t.paragraphs(F.col("text"), "\n")).alias("para_idx", "text"))


def paragraph_rows(spark, d):
    return _paragraphs(spark, d).select("doc_id", "para_idx", F.md5("text").alias("digest"))


def dynamic_sizes(spark, d):
    return _docs(spark, d).select("doc_id", c.dynamic_size(F.col("text")).alias("size"), F.round(c.keyword_density(F.col("text")), 6).alias("density"))


def adjacent_similarity(spark, d):
    follow = F.lead("text").over(W.partitionBy("doc_id").orderBy("para_idx"))
    pairs = _paragraphs(spark, d).withColumn("after", follow).where("after is not null")
    return pairs.select("doc_id", "para_idx", F.round(text_similarity(F.col("text"), F.col("after"), vocab.TERMS), 6).alias("similarity"))


def fold_chunks(spark, d):
    folded = c.fold(t.paragraphs(F.col("text"), "\n"), "\n", 120, 400)
    return _docs(spark, d).select("doc_id", F.posexplode(folded).alias("chunk_index", "text"))


def overlap_chunks(spark, d):
    folded = c.with_overlap(t.paragraphs(F.col("text"), "\n"), F.lit(40), "\n\n")
    return _docs(spark, d).select("doc_id", F.posexplode(folded).alias("chunk_index", "text")).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


def small_chunk_merge(spark, d):
    merged = c.merge_small(t.paragraphs(F.col("text"), "\n"), 120, 400)
    return _docs(spark, d).select("doc_id", F.posexplode(merged).alias("chunk_index", "text"))


def long_items_split(spark, d):
    items = table(spark, d, "document_index").select("item_id", "text").where("text is not null").dropDuplicates(["item_id"])
    return c.split_long(items, ["item_id"], "text", 1400, 100)


def chunks(spark, d):
    return c.chunk_documents(table(spark, d, "documents"), letters=r"[\p{L}]")


def cut_terms(spark, d):
    cut = F.left("text", F.char_length("text") - F.pmod(F.char_length("text"), F.lit(5)))
    return _docs(spark, d).select("doc_id", F.char_length(c.trim_cut_term(cut)).alias("n"))


def chunk_index(spark, d):
    from ..operators.maintenance import skeleton

    return skeleton(table(spark, d, "document_index"))[1]


def document_nodes(spark, d):
    from ..operators.maintenance import skeleton

    return skeleton(table(spark, d, "document_index"))[0]


def next_edges(spark, d):
    return c.next_chain(_paragraphs(spark, d), "doc_id", "para_idx").withColumnRenamed("next_index", "next_idx")


def line_runs_limited(spark, d):
    pages = table(spark, d, "ocr_page").select("page_id", "text").where("text is not null").distinct()
    return pages.select("page_id", F.size(c.limit_runs(F.split("text", "\n"))).alias("n_lines"), F.md5(F.array_join(c.limit_runs(F.split("text", "\n")), "\n")).alias("digest"))


def chunk_metrics(spark, d):
    return _paragraphs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.char_length("text")), 6).alias("mean_chars"))


def _names(spark, d):
    """Names of all entities, of two characters at least, and the terms of the domain."""
    own = table(spark, d, "entity_node").where(F.char_length("name") >= 2).select(F.col("name").alias("term"))
    return own.unionByName(spark.createDataFrame([(x,) for x in vocab.TERMS], "term string")).distinct()


def mentions(spark, d):
    """The entities that each document names."""
    terms = _names(spark, d)
    return r.mentions(table(spark, d, "documents"), terms, "doc_id", "text").select("doc_id", "term")


def inverted_index(spark, d):
    """Postings (term, doc_id, n) of all terms of the reference list, their aliases and the terms of the domain."""
    own = table(spark, d, "standard_entity").select(F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    terms = own.unionByName(spark.createDataFrame([(x,) for x in vocab.TERMS], "term string")).where("term <> ''").distinct()
    return r.mentions(table(spark, d, "documents"), terms, "doc_id", "text").select("term", "doc_id", "n")


def keyword_counts(spark, d):
    """How often each document names each entity keyword."""
    terms = spark.createDataFrame([(x,) for x in vocab.ENTITY_KEYWORDS], "term string")
    return r.mentions(table(spark, d, "documents"), terms, "doc_id", "text")


def intent_scores(spark, d):
    return _docs(spark, d).select("doc_id", r.intent(F.col("text")).alias("b")).select("doc_id", "b.intent", F.coalesce("b.score", F.lit(0)).alias("score"))


def intent_fallback(spark, d):
    return _docs(spark, d).select("doc_id", r.simple_intent(F.col("text")).alias("b")).select("doc_id", "b.intent", "b.confidence")


def query_rewrite(spark, d):
    asked = table(spark, d, "entity_node").select("id", "name").distinct().where("name is not null")
    return asked.select("id", r.rewrite(F.col("name"), r.intent(F.col("name"))["intent"]).alias("query"))


def keyword_entities(spark, d):
    found = r.keyword_entities(F.col("text"))
    return _docs(spark, d).select("doc_id", F.array_join(found, ",").alias("entities")).where("entities <> ''")


def entity_linking(spark, d):
    """The ten longest entity names of the reference list that each name contains."""
    asked = table(spark, d, "entity_node").select("id", "name").distinct()
    terms = table(spark, d, "standard_entity").select("term").where(F.char_length("term") >= 2)
    found = r.mentions(asked, terms, "id", "name")
    return r.top_by(found.select("id", "term"), ["id"], 10, F.desc(F.char_length("term")), F.asc("term"))


def _described(spark, d):
    n = table(spark, d, "entity_node").where("name is not null and id is not null")
    one = n.groupBy("name").agg(F.min(F.struct("id", F.coalesce("label", F.lit("Entity")).alias("type"), F.coalesce(F.col("props")["description"], F.lit("")).alias("description"))).alias("b"))
    return one.select("name", "b.type", "b.description")


def hard_match(spark, d):
    wanted = table(spark, d, "triplet").select(F.explode(F.array("head", "tail")).alias("name")).where("name is not null")
    return r.hard_match(wanted, _described(spark, d))


def hard_match_injected(spark, d):
    matched = hard_match(spark, d)
    hits = _described(spark, d).where("type = '指标'").select(F.concat("name", F.lit("（"), "type", F.lit("）")).alias("text"), F.lit(0.5).alias("score"))
    return r.inject(matched, hits)


def enrichment(spark, d):
    """Neighbours of each entity as sentences; a (neighbour, relation) once across all entities, with the first of them by name."""
    near = g.neighbours(g.edges_of(table(spark, d, "triplet")), 10)
    near = near.groupBy("neighbour", "rel").agg(F.min("name").alias("name"))
    types = g.node_types(table(spark, d, "triplet"))
    named = near.join(types.select(F.col("name").alias("neighbour"), F.col("type").alias("label")), "neighbour")
    return named.select("name", r.enrichment_text(F.col("neighbour"), F.col("label"), F.col("name"), F.col("rel")).alias("text"), F.lit(0.3).alias("score")).distinct()


def merged_hits(spark, d):
    """Semantic and graph hits as one list, the better stage of a node first."""
    a = table(spark, d, "entity_vector").where("id is not null").select("id", F.lit(1).alias("stage"))
    b = table(spark, d, "alignment_pair").select(F.explode(F.array("left_id", "right_id")).alias("id")).where("id is not null").select("id", F.lit(0).alias("stage"))
    return a.unionByName(b).groupBy("id").agg(F.min("stage").alias("stage"))


def _with_intent(spark, d):
    """Heads of triplets, each with the intent that its first type stands for."""
    kinds = {"疾病": "TREATMENT", "体征": "SYMPTOM", "Symptom": "SYMPTOM", "检查": "DIAGNOSIS", "Risk": "RISK_FACTOR"}
    lookup = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return g.node_types(table(spark, d, "triplet")).select("name", F.coalesce(F.try_element_at(lookup, "type"), F.lit("GENERAL")).alias("intent"))


def path_plan(spark, d):
    edges, types = g.edges_of(table(spark, d, "triplet")), g.node_types(table(spark, d, "triplet"))
    return r.plan_paths(_with_intent(spark, d), g.density(edges, types), spark).groupBy("name", "direction", "priority").agg(F.count(F.lit(1)).alias("n_paths"))


def intent_relations(spark, d):
    """Edges that each intent's neighbour filter lets through."""
    edges = g.edges_of(table(spark, d, "triplet"))
    return edges.join(F.broadcast(r.relation_rules(spark, "neighbours")), "rel").groupBy("intent", "rel").agg(F.count(F.lit(1)).alias("n"))


def hit_entities(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source")
    return r.entities_of_hits(docs, "doc_id", "text", "source").select(F.col("key").alias("doc_id"), "entity", "place")


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0")


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return v.top_k(_asked(spark, d), e, 10, "vec_id")


def rerank_funnel(spark, d):
    """Fifty candidates by vector, rescored by label agreement, three kept."""
    e = table(spark, d, "embeddings")
    near = v.top_k(_asked(spark, d), e, 50, "vec_id").withColumnRenamed("place", "place_1")
    labels = e.select(F.col("vec_id").cast("string").alias("id"), "label")
    own = labels.select(F.col("id").alias("query"), F.col("label").alias("own"))
    scored = near.join(labels, "id").join(own, "query").withColumn("score", F.when(F.col("label") == F.col("own"), 1).otherwise(0))
    return r.top_by(scored, ["query"], 3, F.desc("score"), F.asc("place_1")).select("query", "id", "score", "place")


def rank_fusion(spark, d):
    """Customers by balance and by number of orders, fused by reciprocal ranks."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    by_nation = W.partitionBy("c_nationkey")
    one = a.withColumn("place", F.row_number().over(by_nation.orderBy(F.desc("c_acctbal"), "id"))).select("id", "place")
    two = a.join(counts, "id").withColumn("place", F.row_number().over(by_nation.orderBy(F.desc("n"), "id"))).select("id", "place")
    return r.fuse(one, two)


def similar_pairs(spark, d):
    return v.similar_pairs(table(spark, d, "embeddings"), 0.4, "vec_id").select("a", "b", F.round("cosine", 5).alias("cosine"))


def mean_pooled(spark, d):
    return v.mean_pool(table(spark, d, "embeddings"), ["label"]).select("label", "place", F.round("value", 6).alias("value"))


def missing_embeddings(spark, d):
    """Named nodes without a vector that were typed in or have no source."""
    n = table(spark, d, "entity_node").where("name is not null and (source is null or source = 'manual')").select("id").distinct()
    have = table(spark, d, "entity_vector").where("embedding is not null and size(embedding) > 0").select("id").distinct()
    return n.join(have, "id", "left_anti")


def retrieval_quality(spark, d):
    """Share of the ten nearest vectors that have their query's label: precision at ten, for each label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    near = cosine_topk(spark, d).join(e, "id").join(e.select(F.col("id").alias("query"), F.col("label").alias("own")), "query")
    return near.groupBy("own").agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("precision"), F.count(F.lit(1)).alias("n"))


def _sql() -> dict[str, str]:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    lst = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    terms = lst(vocab.TERMS)
    para = """p AS (SELECT doc_id, CAST(i - 1 AS INT) AS para_idx, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id,
list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)))"""
    density = f"list_sum(list_transform({terms}, lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) / length(text)"
    has = lambda words, col: f"len(list_filter({lst(words)}, lambda w: contains({col}, w)))"

    def score(name: str, col: str) -> str:
        boost, raising = vocab.INTENT_BOOSTS.get(name, (0, []))
        extra = f" + CASE WHEN {has(raising, col)} > 0 THEN {boost} ELSE 0 END" if boost else ""
        return has(vocab.INTENT_KEYWORDS[name], col) + extra

    def best(col: str) -> str:
        rows = ", ".join(f"{{'s': {score(n, col)}, 'p': {-i}, 'i': {q(n)}}}" for i, n in enumerate(vocab.INTENT_KEYWORDS, 1))
        return f"list_max([{rows}])"

    simple = "list_max([" + ", ".join(f"{{'s': {has(words, 'text')}, 'p': {-i}, 'i': {q(n)}}}" for i, (n, words) in enumerate(vocab.FALLBACK_KEYWORDS.items())) + "])"
    pick = lambda i: " ".join(f"WHEN {q(n)} THEN {q(w[i])}" for n, w in vocab.REWRITES.items())
    e = "e AS (SELECT DISTINCT head AS src, relation AS rel, tail AS dst FROM triplet WHERE trim(head) <> '' AND trim(relation) <> '' AND trim(tail) <> '')"
    named = "d AS (SELECT name, arg_min(coalesce(label, 'Entity'), (id, coalesce(label, 'Entity'), coalesce(props['description'], ''))) AS type, arg_min(coalesce(props['description'], ''), (id, coalesce(label, 'Entity'), coalesce(props['description'], ''))) AS description FROM entity_node WHERE name IS NOT NULL AND id IS NOT NULL GROUP BY name)"
    hard = f"{named}, w AS (SELECT head AS name FROM triplet UNION SELECT tail FROM triplet), m AS (SELECT name, name || '（' || type || '）' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS text, 1.0::DOUBLE AS score FROM d WHERE name IN (SELECT name FROM w WHERE name IS NOT NULL))"
    near = """s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query, CAST(b.vec_id AS VARCHAR) AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM s)"""
    items = "i AS (SELECT DISTINCT item_id, coalesce(file_hash, md5(coalesce(metadata['file_name'], ''))) AS file_hash, metadata['file_name'] AS file_name, created_at FROM document_index)"
    keep = "list_filter(ls, lambda x, i: NOT (i > 2 AND ls[i - 1] = x AND ls[i - 2] = x))"
    stop = "[。！？!?\\n]"
    return {
        "paragraph_rows": f"WITH {para} SELECT doc_id, para_idx, md5(text) AS digest FROM p",
        "dynamic_sizes": f"SELECT doc_id, CASE WHEN coalesce(d, 0) > 0.005 THEN 960 ELSE 1200 END AS size, coalesce(round(d, 6), 0) AS density FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN {density} END AS d FROM documents WHERE text IS NOT NULL)",
        "overlap_chunks": f"""WITH {para}, a AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS f FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx)),
f AS (SELECT *, CASE WHEN length(b) <= 40 THEN b ELSE coalesce(nullif(regexp_extract(right(b, 40), '(?s)^(.*?{stop})', 1), ''), right(b, 40)) END AS x,
CASE WHEN length(f) <= 40 THEN f ELSE coalesce(nullif(regexp_extract(left(f, 40), '(?s)^(.*{stop})', 1), ''), left(f, 40)) END AS y FROM a)
SELECT doc_id, para_idx AS chunk_index, md5(concat_ws(chr(10) || chr(10), x, text, y)) AS digest FROM f""",
        "cut_terms": None,
        "chunk_index": f"WITH {items} SELECT item_id, file_hash, CAST(row_number() OVER w - 1 AS INT) AS chunk_index, lag(item_id) OVER w AS previous_id FROM i WINDOW w AS (PARTITION BY file_hash ORDER BY item_id)",
        "document_nodes": f"WITH {items} SELECT file_hash, min(file_name) AS file_name, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_chunks FROM i GROUP BY file_hash",
        "next_edges": f"WITH {para} SELECT doc_id, para_idx, next_idx FROM (SELECT doc_id, para_idx, lead(para_idx) OVER (PARTITION BY doc_id ORDER BY para_idx) AS next_idx FROM p) WHERE next_idx IS NOT NULL",
        "line_runs_limited": f"SELECT page_id, CAST(len({keep}) AS INT) AS n_lines, md5(array_to_string({keep}, chr(10))) AS digest FROM (SELECT DISTINCT page_id, string_split(text, chr(10)) AS ls FROM ocr_page WHERE text IS NOT NULL)",
        "chunk_metrics": f"WITH {para} SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(avg(length(text)), 6) AS mean_chars FROM p",
        "mentions": f"SELECT doc_id, term FROM documents, (SELECT unnest({terms}) AS term UNION SELECT name FROM entity_node WHERE length(name) >= 2) WHERE contains(text, term)",
        "inverted_index": f"""WITH k AS (SELECT unnest({terms}) AS term UNION SELECT term FROM standard_entity WHERE term <> '' UNION SELECT unnest(aliases) FROM standard_entity)
SELECT term, doc_id, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents, k WHERE term <> '' AND contains(text, term)""",
        "keyword_counts": f"SELECT doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents, (SELECT DISTINCT unnest({lst(vocab.ENTITY_KEYWORDS)}) AS term) WHERE contains(text, term)",
        "intent_scores": f"SELECT doc_id, CASE WHEN b.s > 0 THEN b.i ELSE 'GENERAL' END AS intent, CAST(b.s AS INT) AS score FROM (SELECT doc_id, {best('text')} AS b FROM documents WHERE text IS NOT NULL)",
        "intent_fallback": f"SELECT doc_id, CASE WHEN b.s > 0 THEN b.i ELSE 'GENERAL' END AS intent, CASE WHEN b.s > 0 THEN round(least(0.3::DOUBLE + 0.15::DOUBLE * b.s, 0.9), 6) ELSE 0.3 END AS confidence FROM (SELECT doc_id, {simple} AS b FROM documents WHERE text IS NOT NULL)",
        "query_rewrite": f"""SELECT id, CASE WHEN {has(vocab.COMPARISONS, 'name')} > 0 THEN name ELSE concat_ws(' ', name, CASE WHEN w1 IS NOT NULL AND NOT contains(name, w1) THEN w1 WHEN w2 IS NOT NULL AND NOT contains(name, w2) THEN w2 END) END AS query
FROM (SELECT id, name, CASE i {pick(0)} END AS w1, CASE i {pick(1)} END AS w2 FROM (SELECT id, name, CASE WHEN b.s > 0 THEN b.i END AS i FROM (SELECT DISTINCT id, name, {best('name')} AS b FROM entity_node WHERE name IS NOT NULL)))""",
        "entity_linking": """SELECT id, term, place FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS place FROM (SELECT DISTINCT id, name FROM entity_node) n, (SELECT DISTINCT term FROM standard_entity) s WHERE contains(name, term)) WHERE place <= 10""",
        "hard_match": f"WITH {hard} SELECT name, text, score FROM m",
        "hard_match_injected": f"WITH {hard}, h AS (SELECT name || '（' || type || '）' AS text, 0.5::DOUBLE AS score FROM d WHERE type = '指标') SELECT text, max(score) AS score, 0 AS stage FROM m WHERE text NOT IN (SELECT text FROM h) GROUP BY text UNION ALL SELECT text, score, 1 FROM h",
        "path_plan": f"""WITH {e}, x AS (SELECT triplet_id, 0 AS o, head AS name, nullif(trim(head_type), '') AS type FROM triplet UNION ALL SELECT triplet_id, 1, tail, nullif(trim(tail_type), '') FROM triplet),
t AS (SELECT name, coalesce(arg_min(type, (triplet_id, o)) FILTER (type IS NOT NULL), 'Entity') AS type FROM x WHERE trim(name) <> '' GROUP BY name),
a AS (SELECT name, CASE type WHEN '疾病' THEN 'TREATMENT' WHEN '体征' THEN 'SYMPTOM' WHEN 'Symptom' THEN 'SYMPTOM' WHEN '检查' THEN 'DIAGNOSIS' WHEN 'Risk' THEN 'RISK_FACTOR' ELSE 'GENERAL' END AS intent FROM t),
r(intent, rel) AS (VALUES {", ".join(f"({q(i)}, {q(x)})" for i, rels in vocab.RELATIONS["paths"].items() for x in rels)}),
c AS (SELECT src AS name, rel, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT name, arg_min(rel, (-n, rel)) AS rel FROM c GROUP BY name),
p AS (SELECT a.name, r.rel, 'out' AS direction, CASE WHEN c.n IS NOT NULL THEN 0.9 ELSE 0.6 END AS priority FROM a JOIN r USING (intent) LEFT JOIN c ON c.name = a.name AND c.rel = r.rel
UNION ALL SELECT a.name, rel, CASE WHEN rel IN ({", ".join(map(q, vocab.RELATIONS["paths"]["TREATMENT"] + vocab.RELATIONS["paths"]["MECHANISM"] + vocab.RELATIONS["paths"]["SYMPTOM"]))}) THEN 'out' ELSE 'both' END,
CASE WHEN rel IN ({", ".join(map(q, vocab.RELATIONS["paths"]["TREATMENT"] + vocab.RELATIONS["paths"]["MECHANISM"]))}) THEN 0.8 WHEN rel IN ({", ".join(map(q, vocab.RELATIONS["paths"]["SYMPTOM"]))}) THEN 0.7 ELSE 0.5 END FROM a JOIN b USING (name) WHERE intent = 'GENERAL')
SELECT name, direction, CAST(priority AS DOUBLE) AS priority, count(*) AS n_paths FROM p GROUP BY 1, 2, 3""",
        "intent_relations": f"""WITH {e}, r(intent, rel) AS (VALUES {", ".join(f"({q(i)}, {q(x)})" for i, rels in vocab.RELATIONS["neighbours"].items() for x in rels)})
SELECT intent, rel, count(*) AS n FROM e JOIN r USING (rel) GROUP BY 1, 2""",
        "hit_entities": f"""SELECT doc_id, l[i] AS entity, CAST(i - 1 AS INT) AS place FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id,
list_concat(CASE WHEN source <> '' THEN [source] ELSE [] END, list_filter({lst(vocab.ENTITY_KEYWORDS)}, lambda w: contains(text, w))) AS l FROM documents WHERE text IS NOT NULL))""",
        "merged_hits": "SELECT id, min(stage) AS stage FROM (SELECT id, 1 AS stage FROM entity_vector UNION ALL SELECT left_id, 0 FROM alignment_pair UNION ALL SELECT right_id, 0 FROM alignment_pair) WHERE id IS NOT NULL GROUP BY id",
        "enrichment": f"""WITH {e}, b AS (SELECT src, rel, dst, 'out' AS d FROM e UNION SELECT dst, rel, src, 'in' FROM e), n AS (SELECT src, dst, rel, row_number() OVER (PARTITION BY src ORDER BY dst, rel, d) AS r FROM b), o AS (SELECT dst, rel, min(src) AS src FROM n WHERE r <= 10 GROUP BY dst, rel),
x AS (SELECT triplet_id, 0 AS o, head AS name, nullif(trim(head_type), '') AS type FROM triplet UNION ALL SELECT triplet_id, 1, tail, nullif(trim(tail_type), '') FROM triplet),
t AS (SELECT name, coalesce(arg_min(type, (triplet_id, o)) FILTER (type IS NOT NULL), 'Entity') AS type FROM x WHERE trim(name) <> '' GROUP BY name)
SELECT DISTINCT src AS name, dst || ' （' || type || '） 与' || src || '存在' || rel || '关系' AS text, 0.3::DOUBLE AS score FROM o JOIN t ON t.name = o.dst""",
        "cosine_topk": f"WITH {near} SELECT query, id, cosine, place FROM n WHERE place <= 10",
        "rerank_funnel": f"""WITH {near}, k AS (SELECT n.query, n.id, n.place AS p, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS score FROM n JOIN embeddings a ON CAST(a.vec_id AS VARCHAR) = n.id JOIN embeddings b ON CAST(b.vec_id AS VARCHAR) = n.query WHERE n.place <= 50)
SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p) AS place FROM k) WHERE place <= 3""",
        "rank_fusion": """WITH a AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer),
n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS p FROM customer JOIN n ON n.id = c_custkey)
SELECT id, round(sum(1.0::DOUBLE / (60 + p)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""",
        "similar_pairs": "SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE cosine >= 0.4",
        "mean_pooled": "SELECT label, CAST(i - 1 AS INT) AS place, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2",
        "missing_embeddings": "SELECT DISTINCT id FROM entity_node WHERE name IS NOT NULL AND (source IS NULL OR source = 'manual') AND id NOT IN (SELECT id FROM entity_vector WHERE len(embedding) > 0 AND id IS NOT NULL)",
        "retrieval_quality": f"WITH {near} SELECT b.label AS own, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS n FROM n JOIN embeddings a ON CAST(a.vec_id AS VARCHAR) = n.id JOIN embeddings b ON CAST(b.vec_id AS VARCHAR) = n.query WHERE n.place <= 10 GROUP BY 1",
    }


def queries() -> dict:
    names = """paragraph_rows dynamic_sizes adjacent_similarity fold_chunks overlap_chunks small_chunk_merge long_items_split chunks cut_terms chunk_index document_nodes next_edges
    line_runs_limited chunk_metrics mentions inverted_index keyword_counts intent_scores intent_fallback query_rewrite keyword_entities entity_linking hard_match hard_match_injected
    enrichment path_plan intent_relations hit_entities merged_hits cosine_topk rerank_funnel rank_fusion similar_pairs mean_pooled missing_embeddings retrieval_quality""".split()
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {name: spaces_only(sql) for name, sql in _sql().items() if sql}
