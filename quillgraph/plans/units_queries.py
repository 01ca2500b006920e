"""Queries on measured quantities, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from .tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.measured_quantities(table(spark, folder, "entity_node").where("id is not null"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    found = p5_found(spark, folder)
    return found.groupBy("quantity").agg(F.count(F.lit(1)).alias("n"), F.min("value_int").alias("least"), F.max("value_int").alias("most"))


def _sql() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pattern(p: str) -> str:
        return lit(p.replace(r" ", " "))

    rows = ", ".join(f"({lit(u)}, {lit(q)}, {f!r}, {o!r})" for q, f, o, names in units.UNITS for u in names)
    digits = "一二三四五六七八九"
    num = "CAST(replace(CASE WHEN regexp_matches({0}, ',[0-9]{{3}}([^0-9]|$)') THEN replace({0}, ',', '') ELSE {0} END, ',', '.') AS DOUBLE)"
    place = "CASE WHEN {0} LIKE '%{1}%' THEN {2} * coalesce(nullif(instr('" + digits + "', nullif(regexp_extract({0}, '([" + digits + "]){1}', 1), '')), 0), 1) ELSE 0 END"
    words = " + ".join(place.format("w", m, n) for m, n in (("千", 1000), ("百", 100), ("十", 10)))
    words += f" + coalesce(instr('{digits}', nullif(regexp_extract(w, '([{digits}])半?$', 1), '')), 0) + CASE WHEN w LIKE '%半%' THEN 0.5 ELSE 0 END"
    D, W, R = (pattern(p) for p in (units.DIGITS_PATTERN, units.WORDS_PATTERN, units.FRACTION_PATTERN))
    plain = "trim(regexp_replace(lower(translate({0}, " + lit(units.FROM) + ", " + lit(units.TO) + ")), '[\\s ]+', ' ', 'g'))"
    # The same words as in the operator, without a look behind: a letter before the word is kept as it is.
    amounts = (("half", "0.5"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"), ("ten", "10"))
    name = plain.replace("{0}", "name")
    for word, digits in amounts:
        name = f"regexp_replace({name}, '(^|[^a-z])(?:{'a ' if word == 'half' else ''}{'|' if word == 'half' else ''}){word} (?:an? )?(hour|day|week|minute)', '\\1{digits} \\2', 'g')"
    name = f"regexp_replace(regexp_replace({name}, '(^|[^a-z])(?:a |)quarter (?:of an?|an?) (hour)', '\\10.25 \\2', 'g'), '(^|[^a-z])(?:an?|one) (hour|day|week|minute)', '\\11 \\2', 'g')"
    return f"""
WITH u(alias, quantity, factor, "offset") AS (VALUES {rows}),
s AS (SELECT DISTINCT id, {name} AS s, {plain.replace("{0}", "props['unit']")} AS g FROM entity_node WHERE id IS NOT NULL AND name IS NOT NULL),
d AS (SELECT id, regexp_extract(s, {D}, 1) AS label, regexp_extract(s, {D}, 2) AS n, regexp_extract(s, {D}, 4) AS m,
             replace(coalesce(nullif(regexp_extract(s, {D}, 3), ''), g), ' ', '') AS alias FROM s WHERE regexp_matches(s, {D})),
w0 AS (SELECT id, regexp_extract(s, {W}, 1) AS label, translate(regexp_extract(s, {W}, 2), '两〇', '二零') AS w, regexp_extract(s, {W}, 3) AS a
       FROM s WHERE regexp_matches(s, {W}) AND NOT regexp_matches(s, {D})),
r AS (SELECT id, regexp_extract(s, {R}, 1) AS label, regexp_extract(s, {R}, 2) AS per, regexp_extract(s, {R}, 3) AS x
      FROM s WHERE regexp_matches(s, {R}) AND NOT regexp_matches(s, {D}) AND NOT regexp_matches(s, {W})),
f AS (SELECT id, label, per, CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN x END AS x, translate(x, '两〇', '二零') AS w FROM r),
p AS (
  SELECT id, label, {num.format("n")} AS n, coalesce(CAST(nullif(m, '') AS DOUBLE), 0) AS more, m <> '' AS two, alias FROM d
  UNION ALL
  SELECT id, label, (CASE WHEN regexp_matches(w, '^[-负]') THEN -1 ELSE 1 END) * ({words}) + CASE WHEN a = '个半小时' THEN 0.5 ELSE 0 END, 0, false,
         replace(replace(a, '个半小时', '小时'), ' ', '') FROM w0
  UNION ALL
  SELECT id, label, coalesce(CAST(x AS DOUBLE), {words}) * 100 / CASE per WHEN '百' THEN 100 WHEN '千' THEN 1000 ELSE 10000 END, 0, false, '%' FROM f)
SELECT DISTINCT id, quantity, CAST(round(n * factor + u."offset" + more) AS BIGINT) AS value_int
FROM p JOIN u USING (alias)
WHERE NOT regexp_matches(label, {lit(units.OTHER_LABELS)}) AND (NOT two OR quantity = 'duration')
"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_totals": p5_totals}


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    return {"p5_found": sql, "p5_totals": f"SELECT quantity, count(*) AS n, min(value_int) AS least, max(value_int) AS most FROM ({sql}) GROUP BY quantity"}
