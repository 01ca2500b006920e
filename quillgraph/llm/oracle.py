"""SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import dedup

#: An edge list of the MERGE rows, both ways.
_P2 = """
WITH RECURSIVE e AS (
  SELECT DISTINCT left_id AS a, right_id AS b FROM alignment_pair
  WHERE upper(trim(status, E' \\t\\n\\r　')) = 'MERGE' AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, seen) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen)
SELECT min(seen) AS group_id, id FROM r GROUP BY id HAVING min(seen) < id
"""

_P1 = """
WITH t AS (SELECT DISTINCT item_id, text FROM document_index WHERE length(text) > 1400),
c AS (
  SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text,
    '(\\.["''”’」』）)\\]】》]*)(\\s|\\z)', '\\1' || chr(57344) || '\\2', 'g'),
    '([。！？!?；;…]["''”’」』）)\\]】》]*)', '\\1' || chr(57344), 'g'),
    '(\\n)', '\\1' || chr(57344), 'g') AS marked FROM t)
SELECT item_id, 'oversized' AS kind FROM t
UNION
SELECT item_id, 'no_boundary' FROM c WHERE list_max(list_transform(string_split(marked, chr(57344)), lambda x: length(x))) > 1400
"""


#: Brute force over all pairs; fit for small tables.
_P4 = """
WITH v AS (SELECT id, CAST(min(embedding) AS DOUBLE[64]) AS e FROM entity_vector
  WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
s AS (SELECT a.id, b.id AS neighbour, array_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS place FROM s)
"""


def _canonical(column: str) -> str:
    wide = dedup.WIDE_FROM.replace("'", "''"), dedup.WIDE_TO.replace("'", "''")
    return f"regexp_replace(lower(translate({column}, '{wide[0]}', '{wide[1]}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def oracle_sql() -> dict[str, str]:
    coded = f"""
WITH c AS (SELECT DISTINCT triplet_id, {_canonical("head")} AS h, {_canonical("relation")} AS r, {_canonical("tail")} AS t FROM triplet),
g AS (SELECT triplet_id, min(triplet_id) OVER (PARTITION BY least(h, t), r, greatest(h, t)) AS keep_id FROM c WHERE h <> '' AND r <> '' AND t <> '')
"""
    return {
        "p1_found": _P1,
        "p2_found": _P2,
        "p4_found": _P4 + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM r WHERE place <= 10 AND cosine >= 0.9",
        "p6_found": coded + "SELECT keep_id, triplet_id FROM g WHERE triplet_id > keep_id",
        "p6_records": coded + "SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
    }
