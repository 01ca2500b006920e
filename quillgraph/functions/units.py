"""Measured quantities stated in text, in common units. Built-in expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common units: hundredths of a dioptre, tenths of mmHg, micrometres, micrograms a millilitre, minutes.
_MMHG_PA = 133.322387415

#: Quantity, factor and offset to the common unit, accepted names of the unit (lower case, without blanks).
#: value = number * factor + offset; none of these units has an offset, scales with another zero (temperatures) do.
UNITS = (
    ("refraction", 100.0, 0.0, ("d", "ds", "dpt", "diopter", "diopters", "dioptre", "dioptres", "屈光度")),
    ("refraction", 1.0, 0.0, ("度",)),
    ("pressure", 10.0, 0.0, ("mmhg", "毫米汞柱", "torr")),
    ("pressure", 10.0 / _MMHG_PA, 0.0, ("pa", "帕")),
    ("pressure", 1e4 / _MMHG_PA, 0.0, ("kpa", "千帕")),
    ("length", 1e3, 0.0, ("mm", "毫米")),
    ("length", 1e4, 0.0, ("cm", "厘米")),
    ("length", 1.0, 0.0, ("μm", "um", "微米", "micron", "microns")),
    ("concentration", 1e4, 0.0, ("%",)),
    ("concentration", 1e3, 0.0, ("mg/ml", "毫克/毫升", "mg·ml-1", "g/l", "克/升")),
    ("concentration", 1.0, 0.0, ("μg/ml", "ug/ml", "微克/毫升", "mg/l", "毫克/升")),
    ("duration", 1.0, 0.0, ("min", "mins", "minute", "minutes", "分", "分钟")),
    ("duration", 60.0, 0.0, ("h", "hr", "hrs", "hour", "hours", "小时", "个小时", "钟头", "个钟头")),
    ("duration", 1440.0, 0.0, ("day", "days", "天", "日")),
    ("duration", 10080.0, 0.0, ("week", "weeks", "周", "星期", "个星期")),
)

#: Labels whose number is an angle, temperature, rate or score although its unit looks like one above.
#: A label of such a kind that isn't listed passes: 度, 分 and % alone don't tell what they measure.
OTHER_LABELS = "体温|温度|气温|temperature|轴位|轴向|axis|倾斜|角度|满意度|评分|得分|分数|score|率|比例|占比|顺应性|依从性|灵敏度|敏感度|特异度|rate|ratio"

_WIDE = {c: n for c in [*map(chr, range(0xFF01, 0xFF5F)), "　", "％", "µ", "㎜", "℃"] if len(n := unicodedata.normalize("NFKC", c)) == 1}
_DASHES = "−–—‒﹣"
FROM, TO = "".join(_WIDE) + _DASHES, "".join(_WIDE.values()) + "-" * len(_DASHES)

_BLANK = r"[\s ]*"
_DIGITS = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?|\.[0-9]+)"
_WORDS = "[一二两三四五六七八九十百千零〇半]+"
_UNIT = "|".join(sorted({u.replace("mmhg", "mm ?hg") for _, _, _, names in UNITS for u in names}, key=lambda u: (-len(u), u)))
_TAIL = r"(?:溶液|/次|\([^()]*\)|[\s。.,，;；]+)*"
_LABEL = r"([^0-9+\-]*?)[\s:=]*(?:约|大约|about|approx\.?)?\s*"
#: label, number, unit, and the second number and unit of such as 1 h 15 min.
DIGITS_PATTERN = rf"^{_LABEL}({_DIGITS})\s*({_UNIT})?(?:\s*([0-9]+)\s*(min|mins|minutes|分钟|分))?{_TAIL}$"
WORDS_PATTERN = rf"^{_LABEL}((?:[-+负])?{_WORDS})\s*(个半小时|{_UNIT}){_TAIL}$"
FRACTION_PATTERN = rf"^{_LABEL}(百|千|万)分之({_WORDS}|[0-9.]+){_TAIL}$"


#: Numbers in English words before a unit of time, and the same in digits.
ENGLISH = (
    (r"(?<![a-z])(?:a )?half (?:an? )?(?=hour|day|week|minute)", "0.5 "), (r"(?<![a-z])(?:a )?quarter (?:of an?|an?) (?=hour)", "0.25 "), (r"(?<![a-z])(?:an?|one) (?=hour|day|week|minute)", "1 "),
    (r"(?<![a-z])two (?=hour|day|week|minute)", "2 "), (r"(?<![a-z])three (?=hour|day|week|minute)", "3 "), (r"(?<![a-z])four (?=hour|day|week|minute)", "4 "), (r"(?<![a-z])five (?=hour|day|week|minute)", "5 "),
    (r"(?<![a-z])six (?=hour|day|week|minute)", "6 "), (r"(?<![a-z])seven (?=hour|day|week|minute)", "7 "), (r"(?<![a-z])eight (?=hour|day|week|minute)", "8 "), (r"(?<![a-z])nine (?=hour|day|week|minute)", "9 "),
    (r"(?<![a-z])ten (?=hour|day|week|minute)", "10 "),
)

#: Stands between the groups of a match.
_MARK = "\x01"


def plain(text: Column) -> Column:
    """Ordinary width, lower case, one kind of minus, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, FROM, TO)), r"[\s ]+", " "))


def _in_digits(text: Column) -> Column:
    """English number words before units of time as digits."""
    out = text
    for words, digits in ENGLISH:
        out = F.regexp_replace(out, words, digits)
    return F.when(text.rlike("(?:hour|day|week|minute)s?"), out).otherwise(text)


def number_of_digits(text: Column) -> Column:
    """Value of a number in digits; a comma before three digits groups them, any other is a decimal comma."""
    grouped = F.regexp_replace(text, ",(?=[0-9]{3}(?:[^0-9]|$))", "")
    return F.regexp_replace(grouped, ",", ".").try_cast("double")


def number_of_words(text: Column) -> Column:
    """Value of a Chinese numeral up to 9999; 半 alone or at the end is a half."""
    value = F.create_map(*[F.lit(x) for pair in {"一": 1.0, "二": 2.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0, "七": 7.0, "八": 8.0, "九": 9.0, "零": 0.0, "〇": 0.0}.items() for x in pair])
    size = F.create_map(*[F.lit(x) for pair in {"十": 10.0, "百": 100.0, "千": 1000.0}.items() for x in pair])

    def step(done: Column, mark: Column) -> Column:
        # total: what is settled; digit: the digit that waits for its place, null if none does.
        placed = done["total"] + F.coalesce(done["digit"], F.lit(1.0)) * F.try_element_at(size, mark)
        return (
            F.when(mark == "半", F.struct((done["total"] + 0.5).alias("total"), done["digit"].alias("digit")))
            .when(F.map_contains_key(size, mark), F.struct(placed.alias("total"), F.lit(None).cast("double").alias("digit")))
            .otherwise(F.struct(done["total"].alias("total"), F.try_element_at(value, mark).alias("digit")))
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("digit"))
    marks = F.filter(F.split(text, ""), lambda x: x != "")
    return F.aggregate(marks, start, step, lambda done: done["total"] + F.coalesce(done["digit"], F.lit(0.0)))


def _unit_table(spark) -> DataFrame:
    return spark.createDataFrame([(u, q, f, o) for q, f, o, names in UNITS for u in names], "alias string, quantity string, factor double, offset double")


def measured_quantities(nodes: DataFrame, key: str = "id", name: str = "name", props: str = "props", unit_key: str = "unit", source: str = "source", source_units: dict[str, str] | None = None) -> DataFrame:
    """(key, quantity, value_int) of each row whose text states one measured quantity.

    The unit is that of the field (``props`` under ``unit_key``), else that of
    the text, else the one that ``source_units`` gives for the row's source
    (none unless given). The whole text must be a label, one
    number, a unit and remarks; texts with other words around the number, with
    an unknown unit or with a label for angles, temperatures, rates or scores
    give no row, as do null and empty texts. Repeated rows give one row. The
    alias table, of fixed size, is joined by broadcast; the only shuffle drops
    repeated rows.
    """
    text = _in_digits(F.translate(plain(F.col(f"`{name}`")), _MARK, ""))
    preset = F.create_map(*[F.lit(x) for pair in (source_units or {"": ""}).items() for x in pair])
    default = F.try_element_at(preset, F.col(f"`{source}`")) if source_units else F.lit(None).cast("string")
    slim = nodes.select(F.col(f"`{key}`").alias("_k"), text.alias("_s"), F.col(f"`{props}`")[unit_key].alias("_u"), default.alias("_p")).where("_s is not null and _s <> ''")

    def groups(pattern: str, n: int) -> Column:
        """All groups of a pattern in one pass; null if it doesn't match."""
        found = F.split(F.regexp_replace("_s", pattern, _MARK.join(f"${i}" for i in range(1, n + 1))), _MARK)
        return F.when(F.size(found) == n, F.transform(found, lambda x: F.nullif(x, F.lit(""))))

    field = F.nullif(plain(F.col("_u")), F.lit(""))
    parts = slim.select("_k", field.alias("_u"), plain(F.col("_p")).alias("_p"), groups(DIGITS_PATTERN, 5).alias("_d"), groups(WORDS_PATTERN, 3).alias("_w"), groups(FRACTION_PATTERN, 3).alias("_f"))
    parts = parts.where(F.coalesce("_d", "_w", "_f").isNotNull())
    d, w, f = (F.col(c) for c in ("_d", "_w", "_f"))
    with_half = F.when(w[2] == "个半小时", 0.5).otherwise(0.0)
    spoken = F.when(w[1].rlike("^[-负]"), -1.0).otherwise(1.0) * number_of_words(F.regexp_replace(w[1], "^[-+负]", "")) + with_half
    per = F.when(f[1] == "百", 1e2).when(f[1] == "千", 1e3).otherwise(1e4)
    shared = F.coalesce(number_of_digits(f[2]), number_of_words(f[2])) * 100 / per
    stated = F.when(d.isNotNull(), d[2]).when(w.isNotNull(), F.regexp_replace(w[2], "个半小时", "小时")).otherwise(F.lit("%"))
    parsed = parts.select(
        "_k",
        F.coalesce(F.when(d.isNotNull(), d[0]).when(w.isNotNull(), w[0]).otherwise(f[0]), F.lit("")).alias("_label"),
        F.when(d.isNotNull(), number_of_digits(d[1])).when(w.isNotNull(), spoken).otherwise(shared).alias("_n"),
        F.coalesce(number_of_digits(d[3]), F.lit(0.0)).alias("_more"),
        F.coalesce(d[3].isNotNull(), F.lit(False)).alias("_two"),
        *[F.regexp_replace(x, " ", "").alias(n) for x, n in ((F.col("_u"), "_field"), (stated, "_stated"), (F.col("_p"), "_preset"))],
    )
    parsed = parsed.where(~F.col("_label").rlike(OTHER_LABELS))
    parsed = parsed.withColumn("alias", F.coalesce("_field", "_stated", "_preset"))
    units = F.broadcast(_unit_table(nodes.sparkSession))  # fixed size
    value = F.col("_n") * F.col("factor") + F.col("offset") + F.col("_more")
    return (
        parsed.join(units, "alias")
        .where(~F.col("_two") | (F.col("quantity") == "duration"))
        .where("_n is not null")
        .select(F.col("_k").alias(key), "quantity", F.round(value).cast("long").alias("value_int"))
        .distinct()
    )
