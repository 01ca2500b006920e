"""Queries of the text and JSON functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfix as j
from ..functions import text as t
from ..operators import retrieval
from .tables import spaces_only, table


def _names(spark, d):
    return table(spark, d, "triplet").select("triplet_id", "head", "relation", "tail", "head_type", "tail_type")


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.clean_text(F.col("text"))).alias("digest"))


def escape_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.escape_text(F.col("text"))).alias("digest"))


def sanitize_names(spark, d):
    return _names(spark, d).select("triplet_id", t.sanitize_name(F.col("head")).alias("head"), t.sanitize_name(F.col("tail")).alias("tail"))


def sanitize_relations(spark, d):
    return _names(spark, d).select("triplet_id", t.sanitize_relation(F.col("relation")).alias("relation"), t.sanitize_type(F.col("head_type")).alias("head_type"))


def default_types(spark, d):
    return _names(spark, d).groupBy(t.default_type(F.col("head_type")).alias("head_type")).agg(F.count(F.lit(1)).alias("n"))


def punctuation_names(spark, d):
    """Triplets with a head, relation or tail that is null or of marks alone; a bare mark stands in for one of the three in every 37th to 39th."""
    parts = {n: F.when(F.pmod("triplet_id", F.lit(37 + i)) == 0, F.lit(mark)).otherwise(F.col(n)) for i, (n, mark) in enumerate((("head", " -"), ("relation", "℃"), ("tail", "（）")))}
    n = _names(spark, d).withColumns(parts)
    return n.where(t.is_punctuation(F.col("head")) | t.is_punctuation(F.col("relation")) | t.is_punctuation(F.col("tail"))).select("triplet_id")


def stop_names(spark, d):
    n = table(spark, d, "entity_node").where("name is not null and name <> ''").select("id", "name").distinct()
    return n.select("id", t.stop_reason(F.col("name")).alias("reason")).where("reason is not null")


def valid_entities(spark, d):
    """Ids whose name can be an entity's; names with words that mustn't be in one are planted beside the real ones."""
    n = table(spark, d, "entity_node").select("id", "name").distinct()
    planted = F.array(*[F.concat("name", F.lit(x)) for x in ("", "眼科中心一部", "EMR", "系统", "APP.pdf", "门诊")], F.lit("中心凹"), F.lit("患者"), F.lit("眼"), F.lit(""))
    tried = n.select("id", F.posexplode(planted).alias("form", "name"))
    return tried.where(t.is_valid_entity(F.col("name"))).select("id", "form", F.char_length("name").alias("n_chars"))


def complete_triplets(spark, d):
    """Triplets with three non-blank parts and two different ends."""
    ok = (F.trim("head") != "") & (F.trim("relation") != "") & (F.trim("tail") != "") & (F.trim("head") != F.trim("tail"))
    return _names(spark, d).where(ok).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def remove_modifiers(spark, d):
    return _names(spark, d).select("triplet_id", t.remove_modifiers(F.col("tail")).alias("tail"))


def normalize_names(spark, d):
    return table(spark, d, "entity_node").select("id", "name").distinct().select("id", t.normalize_name(F.col("name")).alias("name"))


def strip_fences(spark, d):
    return table(spark, d, "ocr_page").select("page_id", "text").distinct().select("page_id", F.md5(t.strip_fences(F.col("text"))).alias("digest"))


def noise_chunks(spark, d):
    items = table(spark, d, "document_index").select("item_id", "text").distinct()
    return items.where(t.is_noise(F.col("text"))).select("item_id")


def injection_suspects(spark, d):
    """Documents with a piece of a query that changes something; such pieces, and harmless ones, are put after their texts."""
    ends = F.array(*map(F.lit, ("; DROP TABLE x", ";delete  from x", "x;\nCREATE (n)", "exec (1)", "EXECUTE('x')", "; dropping x", "DELETE FROM x", "executed (1)", "http://a.b/c")))
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.element_at(ends, (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))).alias("text"))
    return docs.where(t.injection_suspect(F.col("text"))).select("doc_id")


def file_kinds(spark, d):
    name = F.col("metadata")["file_name"]
    items = table(spark, d, "document_index").select("item_id", "metadata").dropDuplicates(["item_id"])
    return items.groupBy(t.file_kind(name).alias("kind"), t.extension(t.repair_suffix(name)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def url_stems(spark, d):
    url = F.concat(F.lit("https://bucket.cos.example/a/"), F.url_encode("file_name"), F.lit("?sign=1"))
    return table(spark, d, "documents").where("file_name is not null").select(t.url_stem(url).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def object_keys(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.object_key(F.lit("uploads"), F.col("created_at"), F.col("text")).alias("object_key"))


def file_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def duplicate_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def changed_files(spark, d):
    """Documents whose (path, hash) the ledger doesn't have; the ledger knows all but every third as they are."""
    now = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    ledger = now.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash")).alias("hash"))
    return now.join(ledger, ["doc_id", "hash"], "left_anti")


def embedding_texts(spark, d):
    n = table(spark, d, "entity_node").select("id", "name", "label").distinct().where("name is not null")
    return n.select("id", t.embedding_text(F.col("name"), F.col("label")).alias("text"))


def clean_scans(spark, d):
    pages = table(spark, d, "ocr_page").select("page_id", "text").distinct()
    return pages.select("page_id", F.md5(t.clean_scan(F.col("text"))).alias("digest"), t.needs_rescan(F.col("text")).alias("rescan"))


def scan_statistics(spark, d):
    pages = table(spark, d, "ocr_page").select("page_id", "file_hash", "text").distinct()
    return pages.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))


def rate_spacing(spark, d):
    """Spacing of requests at a few rates, as seconds."""
    per = table(spark, d, "nation").select((F.col("n_nationkey") * 100 + 1).alias("per_minute"))
    return per.select("per_minute", F.round(t.request_spacing(F.col("per_minute")), 6).alias("seconds"))


def formatted_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch_s"))


def props_parsed(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


def json_repaired(spark, d):
    """Properties broken in four ways and read all the same."""
    e = table(spark, d, "events").select("event_id", "props")
    way = F.col("event_id") % 4
    broken = F.when(way == 0, F.replace("props", F.lit('"'), F.lit("'"))).when(way == 1, F.regexp_replace("props", "[}]$", "")).when(way == 2, F.regexp_replace("props", "[}]$", ",}")).otherwise(F.regexp_replace("props", '"(\\w+)":', "$1:"))
    return e.select("event_id", F.try_variant_get(j.safe_parse(broken), "$.k", "int").alias("k"))


def json_extracted(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("The answer is: "), "props", F.lit(" as asked.")).alias("said"))
    return j.extract(e, "event_id", "said")


def json_validated(spark, d):
    """Events by whether their properties have the key, and a number or a string under it."""
    e = table(spark, d, "events").select("props")
    kinds = [j.has_keys(F.col("props"), ["k"]).alias("ok"), j.has_fields(F.col("props"), {"k": "number"}).alias("number"), j.has_fields(F.col("props"), {"k": "string"}).alias("text")]
    return e.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))


def json_lines(spark, d):
    """Entities from output of one a line: nations of a region as objects, bare words and objects without quotes."""
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    form = F.pmod("n_nationkey", F.lit(3))
    line = F.when(form == 0, F.to_json(F.struct(F.col("n_name").alias("entity"), F.lit("nation").alias("category")))).when(form == 1, F.col("n_name")).otherwise(F.concat(F.lit("{name: '"), "n_name", F.lit("', key: "), "n_nationkey", F.lit(",}")))
    said = n.withColumn("line", line).groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("said"))
    return said.select("n_regionkey", F.explode(j.entities(F.concat(F.lit("\n"), "said"))).alias("e")).select("n_regionkey", "e.name", "e.type", F.col("e.other")["key"].alias("key"))


def json_fallback(spark, d):
    """Properties inside words, cut off, in the wrong order of brackets, with comments and with apostrophes."""
    e = table(spark, d, "events").select("event_id", "props")
    way = F.pmod("event_id", F.lit(5))
    body = F.regexp_replace("props", "[}]$", "")
    broken = (
        F.when(way == 0, F.concat(F.lit("Here it is {unclosed: "), "props"))
        .when(way == 1, F.concat(F.lit("```json\n[1, "), body, F.lit("]\n``` and more")))
        .when(way == 2, F.concat(F.lit("// as asked\n"), body, F.lit(", 'it': 'it's here', list: [1, 2}")))
        .when(way == 3, F.concat(F.lit("/* so */ "), body, F.lit(", note: \"see http://a.b\"")))
        .otherwise(F.lit("nothing to say"))
    )
    v = j.safe_parse(broken)
    k = F.coalesce(*[F.try_variant_get(v, path, "int") for path in ("$.k", "$[1].k", "$.unclosed.k")])
    return e.select("event_id", k.alias("k"))


def _model_output(spark, d):
    """Each item's triplets as a model would write them: a fenced list with words around it."""
    rows = table(spark, d, "triplet").where("item_id is not null").select("item_id", F.struct("triplet_id", "head", "head_type", "relation", "tail", "tail_type").alias("r"))
    listed = rows.groupBy("item_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda x: x.dropFields("triplet_id"))).alias("body"))
    return listed.select("item_id", F.concat(F.lit("Here they are:\n```json\n"), "body", F.lit("\n```")).alias("said"))


def triplet_rows(spark, d):
    """Triplets read from model output, cleaned, punctuation and incomplete ones dropped, types defaulted."""
    found = _model_output(spark, d).select("item_id", F.explode(j.triplets(F.col("said"))).alias("x"))
    parts = found.select("item_id", *[t.clean_text(F.col(f"x.{c}")).alias(c) for c in ("head", "relation", "tail")], t.default_type(F.col("x.head_type")).alias("head_type"))
    good = parts.where(~t.is_punctuation(F.col("head")) & ~t.is_punctuation(F.col("relation")) & ~t.is_punctuation(F.col("tail")))
    return good.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("head").alias("n_heads"), F.countDistinct("head_type").alias("n_types"))


def model_entities(spark, d):
    """Entities read from three forms of model output."""
    n = table(spark, d, "entity_node").where("name is not null").select("id", "name", F.coalesce("label", F.lit("")).alias("label")).distinct()
    one = F.to_json(F.struct("name", F.col("label").alias("type")))
    form = F.pmod(F.char_length("name"), F.lit(3))
    said = F.when(form == 0, one).when(form == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"entities": ['), one, F.lit("]}")))
    return n.select("id", F.explode(j.entities(said)).alias("e")).select("id", "e.name", "e.type")


def path_json(spark, d):
    t3 = _names(spark, d).where("head is not null and relation is not null and tail is not null")
    text = F.to_json(F.struct(F.array("head", "tail").alias("entities"), F.array("relation").alias("relations")))
    back = F.from_json(text, "struct<entities:array<string>,relations:array<string>>")
    return t3.select("triplet_id", back["entities"][1].alias("target"), back["relations"][0].alias("relation"))


def rows_to_csv(spark, d):
    """Nations of each region as comma-separated text."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.create_map(F.lit("name"), x["n_name"], F.lit("key"), x["n_nationkey"].cast("string")))
    return n.select("n_regionkey", t.csv_of(rows, ["name", "key"]).alias("csv"))


def csv_to_rows(spark, d):
    rows = rows_to_csv(spark, d).select("n_regionkey", F.explode(t.rows_of_csv(F.col("csv"))).alias("m"))
    return rows.select("n_regionkey", F.col("m")["key"].alias("key"), F.col("m")["name"].alias("name"))


def label_distribution(spark, d):
    n = table(spark, d, "entity_node").select("id", "label").distinct()
    return n.groupBy(F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("__Entity__")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def fuzzy_standard_terms(spark, d):
    """Best entry of the reference list by block ratio, over 0.80, for each name of nearly its length, of whatever source."""
    names = table(spark, d, "entity_node").select(F.trim("name").alias("name"))
    return retrieval.closest_terms(names, table(spark, d, "standard_entity")).select("name", "term_id", "ratio")


def standard_triplets(spark, d):
    """Triplets with standard ends; the aliases of the reference list are the synonyms."""
    terms = table(spark, d, "standard_entity")
    return retrieval.standard_triplets(table(spark, d, "triplet").select("triplet_id", "head", "relation", "tail"), terms, terms.select(F.explode("aliases").alias("alias"), "term"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chain(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {old}, {new})"
    return column


def _any(template: str, parts) -> str:
    return "(" + " OR ".join(template.format(_lit(p)) for p in parts) + ")"


def _sql() -> dict[str, str]:
    def controls(c: str) -> str:
        gone = _chain(f"trim({c}, ' ')", [("chr(10)", "''"), ("chr(13)", "''"), ("chr(0)", "''"), ("chr(65533)", "''"), ("chr(9)", "' '")])
        return f"trim({gone}, ' ')"

    def name(c: str) -> str:
        symbols = f"translate({_chain(f'trim({c}, {_lit(chr(32))})', [('chr(10)', _lit('')), ('chr(13)', _lit('')), ('chr(0)', _lit('')), ('chr(65533)', _lit('')), ('chr(9)', _lit(' '))])}, {_lit(t.NAME_FROM)}, {_lit(t.NAME_TO)})"
        return f"coalesce(nullif(trim({symbols}, ' '), ''), 'Unknown_Entity')"

    def clean(c: str, gone: str = "[_`\"'']") -> str:
        return f"regexp_replace(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '{gone}', '', 'g'), '\\s+', ' ', 'g')"

    def labelled(c: str, prefix: str, default: str) -> str:
        words = ", ".join(map(_lit, t.KEYWORDS))
        return f"coalesce(nullif(CASE WHEN upper({controls(c)}) IN ({words}) THEN '{prefix}' || {controls(c)} ELSE {controls(c)} END, ''), '{default}')"

    stops = "|".join(f"(?:{p})" for p in t.STOP_PATTERNS)
    def marks(c: str) -> str:
        """Nothing is left of a value without the marks of which alone no name is made."""
        return f"translate({c}, ',.。，、 \\/;:?!''\"()[]{{}}-_+=*&^%$#@~`<>|', '') = ''"

    mods = "tail"
    for p in t.MODIFIERS:
        mods = f"regexp_replace({mods}, {_lit(p)}, '')"
    synonyms = " ".join(f"WHEN {_lit(a)} THEN {_lit(b)}" for a, b in t.SYNONYMS.items())
    lens = "regexp_extract(c, '^([+-]?[0-9]+\\.?[0-9]*)\\s*[Dd][Ss]?$', 1)"
    cjk = "len(regexp_extract_all(text, '[一-鿿]'))"
    valid = f"""length(n) BETWEEN 1 AND 50 AND n NOT IN ({", ".join(map(_lit, t.FORBIDDEN))}) AND NOT regexp_matches(n, '[/\\\\{{}}\\[\\]<>|`~]')
AND NOT regexp_matches(n, '(?i)^(http|https|ftp|www|file:|mailto:)') AND NOT regexp_matches(n, '(?i)\\.(pdf|txt|doc|docx|jpg|png|json|xml|html)$')
AND (trim(n) IN ('中心凹', '黄斑中心凹') OR NOT regexp_matches(trim(n), '(中心|医院|门诊|科室|机构|公司|集团|学校|大学|学院|研究所|实验室)$|视光中心|眼视光中心|眼科中心|眼视光机构'))
AND NOT regexp_matches(trim(n), '(系统|平台|软件|客户端|服务端|APP)$|电子病历系统|EMR|HIS|LIS|PACS|RIS|挂号系统|收费系统|就诊平台|预约平台|管理系统|医院信息系统|医疗信息系统')"""
    esc = _chain("left(text, 1000)", [("'\\'", "'\\\\'"), ("''''", "'\\'''"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"), ("chr(12)", "'\\f'")])
    think = "regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '')"
    pages = "(SELECT DISTINCT page_id, text FROM ocr_page)"
    tri = "(SELECT * FROM triplet WHERE item_id IS NOT NULL)"
    return {
        "clean_text": f"SELECT doc_id, md5({clean('text')}) AS digest FROM documents",
        "escape_text": f"SELECT doc_id, md5({esc}) AS digest FROM documents",
        "sanitize_names": f"SELECT triplet_id, {name('head')} AS head, {name('tail')} AS tail FROM triplet",
        "sanitize_relations": f"SELECT triplet_id, {labelled('relation', 'REL_', '关联')} AS relation, {labelled('head_type', 'Type_', 'Entity')} AS head_type FROM triplet",
        "default_types": "SELECT coalesce(nullif(trim(head_type), ''), '概念') AS head_type, count(*) AS n FROM triplet GROUP BY 1",
        "punctuation_names": f"""WITH p AS (SELECT triplet_id, CASE WHEN triplet_id % 37 = 0 THEN ' -' ELSE head END AS h, CASE WHEN triplet_id % 38 = 0 THEN '℃' ELSE relation END AS r, CASE WHEN triplet_id % 39 = 0 THEN '（）' ELSE tail END AS t FROM triplet)
SELECT triplet_id FROM p WHERE coalesce({marks('h')}, true) OR coalesce({marks('r')}, true) OR coalesce({marks('t')}, true)""",
        "stop_names": f"""SELECT id, reason FROM (SELECT DISTINCT id, name, CASE WHEN length(name) > 15 THEN 'Length > 15' WHEN regexp_matches(name, {_lit(stops)}) THEN 'Matches Stop Pattern' END AS reason
FROM entity_node WHERE name <> '') WHERE reason IS NOT NULL""",
        "valid_entities": f"""SELECT id, form, length(n) AS n_chars FROM (SELECT id, unnest(range(10)) AS form, unnest([name, name || '眼科中心一部', name || 'EMR', name || '系统', name || 'APP.pdf', name || '门诊', '中心凹', '患者', '眼', '']) AS n
FROM (SELECT DISTINCT id, name FROM entity_node)) WHERE {valid}""",
        "complete_triplets": "SELECT relation, count(*) AS n FROM triplet WHERE trim(head) <> '' AND trim(relation) <> '' AND trim(tail) <> '' AND trim(head) <> trim(tail) GROUP BY relation",
        "remove_modifiers": f"SELECT triplet_id, {mods} AS tail FROM triplet",
        "normalize_names": f"""SELECT id, CASE WHEN name <> '' THEN coalesce(CASE c {synonyms} END, CASE WHEN {lens} <> '' THEN CAST(CAST(trunc(CAST({lens} AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) || '度' END, c) ELSE name END AS name
FROM (SELECT DISTINCT id, name, {name('name')} AS c FROM entity_node)""",
        "strip_fences": f"""SELECT page_id, md5(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(o, '(?s)```[a-zA-Z]*\\s*\\n?(.*?)```', 1), ''), o), '(?m)^[ \\t]*//.*$\\n?', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest
FROM (SELECT page_id, {think} AS o FROM {pages})""",
        "noise_chunks": f"""SELECT DISTINCT item_id FROM document_index WHERE length(text) < 50 OR {cjk} / greatest(length(text), 1) < CASE WHEN length(text) <= 200 THEN 0.30 ELSE 0.20 END""",
        "injection_suspects": r"""SELECT doc_id FROM (SELECT doc_id, text || ['; DROP TABLE x', ';delete  from x', 'x;' || chr(10) || 'CREATE (n)', 'exec (1)', 'EXECUTE(''x'')', '; dropping x', 'DELETE FROM x', 'executed (1)', 'http://a.b/c'][doc_id % 9 + 1] AS s FROM documents)
WHERE regexp_matches(upper(s), ';\s*(DROP|DELETE|CREATE)\s|EXEC(UTE)?\s*\(')""",
        "file_kinds": """SELECT coalesce(nullif(lower(regexp_extract(n, '(?i)[._](pdf|docx|doc|txt|md)$', 1)), ''), 'other') AS kind, lower(regexp_extract(regexp_replace(n, '_(pdf|docx|txt)$', '.\\1'), '\\.([^./\\\\]+)$', 1)) AS suffix, count(*) AS n
FROM (SELECT item_id, any_value(metadata['file_name']) AS n FROM document_index GROUP BY item_id) GROUP BY 1, 2""",
        "url_stems": "SELECT regexp_replace(file_name, '\\.[^.]*$', '') AS stem, count(*) AS n FROM documents WHERE file_name IS NOT NULL GROUP BY 1",
        "object_keys": "SELECT doc_id, 'uploads/' || strftime(created_at, '%Y-%m-%d') || '/' || left(md5(text), 16) AS object_key FROM documents WHERE text IS NOT NULL",
        "file_hashes": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
        "duplicate_texts": "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "changed_files": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 3 = 0",
        "embedding_texts": "SELECT DISTINCT id, CASE WHEN coalesce(label, '') IN ('', 'Entity') THEN name ELSE name || ' ' || label END AS text FROM entity_node WHERE name IS NOT NULL",
        "scan_statistics": "SELECT file_hash, count(*) AS n_pages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM (SELECT DISTINCT page_id, file_hash, text FROM ocr_page) GROUP BY file_hash",
        "rate_spacing": "SELECT n_nationkey * 100 + 1 AS per_minute, round(greatest(0.01, 60.0::DOUBLE / (n_nationkey * 100 + 1) * 1.1::DOUBLE), 6) AS seconds FROM nation",
        "formatted_times": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"at\", CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events",
        "props_parsed": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
        "json_repaired": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
        "json_extracted": "SELECT event_id, props AS found FROM events",
        "clean_scans": f"""WITH q AS (SELECT page_id, regexp_replace(regexp_replace(text, '^```(?i:markdown)?\\s*', ''), '\\s*```$', '') AS b, text FROM {pages})
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split_regex(b, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest,
coalesce({cjk} < 30 AND NOT (regexp_matches(text, '\\|[^\\n]*\\|') AND contains(text, '|---')), true) AS rescan FROM q""",
        "json_validated": "SELECT json_exists(props, '$.k') AS ok, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS number, json_type(props, '$.k') = 'VARCHAR' AS text, count(*) AS n FROM events GROUP BY 1, 2, 3",
        "json_lines": "SELECT n_regionkey, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'nation' ELSE 'unknown' END AS type, CASE WHEN n_nationkey % 3 = 2 THEN CAST(n_nationkey AS VARCHAR) END AS key FROM nation",
        "json_fallback": "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events",
        "triplet_rows": f"""WITH c AS (SELECT item_id, {clean('head')} AS h, {clean('relation')} AS r, {clean('tail')} AS t, coalesce(nullif(trim(head_type, ' '), ''), '概念') AS k FROM {tri})
SELECT item_id, count(*) AS n, count(DISTINCT h) AS n_heads, count(DISTINCT k) AS n_types FROM c WHERE h <> '' AND r <> '' AND t <> '' AND NOT {marks('h')} AND NOT {marks('r')} AND NOT {marks('t')} GROUP BY item_id""",
        "model_entities": "SELECT DISTINCT id, name, coalesce(label, '') AS type FROM entity_node WHERE name IS NOT NULL",
        "path_json": "SELECT triplet_id, tail AS target, relation FROM triplet WHERE head IS NOT NULL AND relation IS NOT NULL AND tail IS NOT NULL",
        "rows_to_csv": "SELECT n_regionkey, 'key,name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1",
        "csv_to_rows": "SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation",
        "label_distribution": "SELECT coalesce(nullif(trim(label), ''), '__Entity__') AS label, count(*) AS n FROM (SELECT DISTINCT id, label FROM entity_node) GROUP BY 1",
    }


def queries() -> dict:
    names = """clean_text escape_text sanitize_names sanitize_relations default_types punctuation_names stop_names valid_entities complete_triplets remove_modifiers normalize_names
    strip_fences noise_chunks injection_suspects file_kinds url_stems object_keys file_hashes duplicate_texts changed_files embedding_texts clean_scans scan_statistics rate_spacing
    formatted_times props_parsed json_repaired json_extracted json_validated json_lines json_fallback triplet_rows model_entities path_json rows_to_csv csv_to_rows label_distribution fuzzy_standard_terms
    standard_triplets""".split()
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {name: spaces_only(sql) for name, sql in _sql().items()}
