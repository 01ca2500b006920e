"""Text functions as Column expressions; null in, null out unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of the query language and their stand-ins in node names.
NAME_FROM = "`\\:*?[]{}|;()"
NAME_TO = "ˋ＼：＊？［］｛｝｜；（）"

# Reserved words of the query language.
KEYWORDS = (
    "MATCH", "WHERE", "RETURN", "CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "WITH", "UNION", "UNWIND",
    "ORDER", "SKIP", "LIMIT", "OPTIONAL", "CALL", "YIELD", "FOREACH", "CASE", "WHEN", "THEN", "ELSE", "END",
    "AND", "OR", "XOR", "NOT", "IN", "STARTS", "ENDS", "CONTAINS", "IS", "NULL", "TRUE", "FALSE",
    "AS", "DISTINCT", "ASC", "DESC",
)

# Names that are fragments of sentences.
STOP_PATTERNS = (
    "^在.*下$", ".*的时候$", "^如果", "^当.*时$", "^为了", "^使得", "^随着", "^通过", "^由于", ".*的影像$", ".*的样子$", "^通俗易懂$", "^客观中肯$",
    "^歪曲和模糊的影像$", "^简单来说$", "^换句话说$",
)

# Names that are no entities, and parts that entity names don't have.
FORBIDDEN = (
    "青少年", "家长", "儿童", "学生", "患者", "医生", "专家", "老师", "学校", "医院", "机构", "我们",
    "你们", "他们", "眼睛", "眼部", "眼球", "视力表", "检查", "治疗", "手术", "问题", "原因", "方法",
    "措施", "情况", "结果", "影响", "建议", "提示", "注意", "可能", "可以", "需要", "Entity", "type",
)
BAD_CHARACTERS = ("/", "\\", "{", "}", "[", "]", "<", ">", "|", "`", "~")
BAD_PREFIXES = ("http", "https", "ftp", "www", "file:", "mailto:")
BAD_SUFFIXES = (".pdf", ".txt", ".doc", ".docx", ".jpg", ".png", ".json", ".xml", ".html")
INSTITUTION_SUFFIXES = ("中心", "医院", "门诊", "科室", "机构", "公司", "集团", "学校", "大学", "学院", "研究所", "实验室")
INSTITUTION_ALLOWED = ("中心凹", "黄斑中心凹")
INSTITUTION_WORDS = ("视光中心", "眼视光中心", "眼科中心", "眼视光机构")
SYSTEM_SUFFIXES = ("系统", "平台", "软件", "客户端", "服务端", "APP")
SYSTEM_WORDS = (
    "电子病历系统", "EMR", "HIS", "LIS", "PACS", "RIS", "挂号系统", "收费系统", "就诊平台", "预约平台", "管理系统", "医院信息系统", "医疗信息系统",
)
LONGEST_NAME = 50

# Marks of which alone no name or relation is made.
EMPTY_MARKS = (
    ",", ".", "。", "，", "、", " ", "\\", "/", ";", ":", "?", "!", "'", '"', "(", ")", "[", "]", "{", "}", "-", "_", "+", "=", "*", "&", "^", "%", "$", "#", "@", "~", "`", "<",
    ">", "|",
)

# Pieces of a query that changes something.
INJECTIONS = (r";\s*DROP\s+", r";\s*DELETE\s+", r";\s*CREATE\s+", r"EXEC\s*\(", r"EXECUTE\s*\(")

# Modifiers taken off names, in this order, once each.
MODIFIERS = (
    "^严重的", "^轻度的", "^早期的", "^晚期的", "^急性的", "^慢性的", "^原发性", "^继发性", "^先天性", "^后天性", "^进行性", "^明显的", "^显著的", "^可能的",
    "^疑似的", "^高度的", "^低度的", "^伴有", "^合并", "^引起", "^导致", "的$",
)

# Other names of the same thing.
SYNONYMS = {
    "OK镜": "角膜塑形镜", "ok镜": "角膜塑形镜", "Ortho-K": "角膜塑形镜", "全飞秒": "全飞秒激光手术", "全飞秒手术": "全飞秒激光手术", "SMILE": "全飞秒激光手术",
    "ICL": "ICL植入术", "AL": "眼轴长度", "IOP": "眼压", "K值": "角膜曲率",
}

PUNCTUATION_ONLY = "^[" + "".join("\\" + m for m in EMPTY_MARKS) + r"]*\z"
_CJK = r"[\x{4e00}-\x{9fff}]"
_BLANKS = r"[ \t\n\f\r]+"


def clean_text(text: Column, remove_special: bool = True) -> Column:
    """Without outer blanks, runs of blanks as one; ``_ ` " '`` removed if asked. Blanks are those of SQL's ``\\s``, without the vertical tab."""
    out = F.regexp_replace(text, rf"^{_BLANKS}|{_BLANKS}\z", "")
    if remove_special:
        out = F.regexp_replace(out, "[_`\"']", "")
    return F.regexp_replace(out, _BLANKS, " ")


def escape_text(text: Column, longest: int = 1000) -> Column:
    """Cut to ``longest`` characters, then with the characters special in string literals escaped."""
    out = F.left(text, F.lit(longest))
    for raw, safe in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def sanitize_name(name: Column) -> Column:
    """A node name without control characters, symbols replaced; ``Unknown_Entity`` for null or nothing left."""
    out = F.translate(F.trim(name), "\n\r\0�", "")
    out = F.translate(F.replace(out, F.lit("\t"), F.lit(" ")), NAME_FROM, NAME_TO)
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), F.lit("Unknown_Entity"))


def _no_controls(text: Column) -> Column:
    return F.trim(F.replace(F.translate(F.trim(text), "\n\r\0�", ""), F.lit("\t"), F.lit(" ")))


def sanitize_relation(relation: Column) -> Column:
    """A relation label; ``REL_`` before a reserved word, 关联 for null or nothing left."""
    out = _no_controls(relation)
    named = F.when(F.upper(out).isin(list(KEYWORDS)), F.concat(F.lit("REL_"), out)).otherwise(out)
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("关联"))


def sanitize_type(kind: Column) -> Column:
    """An entity type; ``Type_`` before a reserved word, ``Entity`` for null or nothing left."""
    out = _no_controls(kind)
    named = F.when(F.upper(out).isin(list(KEYWORDS)), F.concat(F.lit("Type_"), out)).otherwise(out)
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("Entity"))


def sanitize_as(kind: str, value: Column) -> Column:
    """The rule for a label or type, else that for a name."""
    return {"label": sanitize_relation, "type": sanitize_type}.get(kind, sanitize_name)(value)


def default_type(kind: Column, default: str = "概念") -> Column:
    return F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(default))


def is_punctuation(text: Column) -> Column:
    """Whether a name or relation is null, empty or made of EMPTY_MARKS alone."""
    return F.coalesce(text.rlike(PUNCTUATION_ONLY), F.lit(True))


def stop_reason(name: Column, longest: int = 15) -> Column:
    """Why a name should be deleted; null if it should stay."""
    stops = "|".join(f"(?:{p})" for p in STOP_PATTERNS)
    return F.when(F.char_length(name) > longest, f"Length > {longest}").when(name.rlike(stops), "Matches Stop Pattern")


def is_valid_entity(name: Column) -> Column:
    """Whether a name can be one of an entity: length, forbidden words and characters, institutions and systems."""

    def any_of(test, parts) -> Column:
        return reduce(lambda a, b: a | b, [test(F.lit(p)) for p in parts])

    clean = F.trim(name)
    return F.coalesce(
        (F.char_length(name) >= 1)
        & (F.char_length(name) <= LONGEST_NAME)
        & ~name.isin(list(FORBIDDEN))
        & ~any_of(name.contains, BAD_CHARACTERS)
        & ~any_of(F.lower(name).startswith, BAD_PREFIXES)
        & ~any_of(F.lower(name).endswith, BAD_SUFFIXES)
        & (clean.isin(list(INSTITUTION_ALLOWED)) | ~(any_of(clean.endswith, INSTITUTION_SUFFIXES) | any_of(clean.contains, INSTITUTION_WORDS)))
        & ~any_of(clean.endswith, SYSTEM_SUFFIXES)
        & ~any_of(clean.contains, SYSTEM_WORDS),
        F.lit(False),
    )


def remove_modifiers(name: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), MODIFIERS, name)


def normalize_name(name: Column) -> Column:
    """A sanitised name, by its main synonym; dioptres (``+3.5D``) as whole degrees, cut towards zero."""
    clean = sanitize_name(name)
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    lens = F.nullif(F.regexp_extract(clean, r"^([+-]?[0-9]+\.?[0-9]*)\s*[Dd][Ss]?$", 1), F.lit(""))
    degrees = F.concat((lens.cast("double") * 100).cast("long").cast("string"), F.lit("度"))
    return F.when(name.isNotNull() & (name != ""), F.coalesce(F.try_element_at(known, clean), degrees, clean)).otherwise(name)


def strip_fences(text: Column) -> Column:
    """Without thinking tags, closed or not; the first fenced block if there is one; without ``//`` lines."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)<think>.*$", "")
    fenced = F.nullif(F.regexp_extract(out, r"(?s)```[a-zA-Z]*\s*\n?(.*?)```", 1), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.coalesce(fenced, out), r"(?m)^[ \t]*//.*$\n?", ""), r"^\s+|\s+$", "")


def is_noise(text: Column, shortest: int = 50, letters: str = _CJK, short: int = 200, least_short: float = 0.30, least_long: float = 0.20) -> Column:
    """Whether a chunk is too short or has too few of the given letters."""
    n = F.char_length(text)
    ratio = F.regexp_count(text, F.lit(letters)) / F.greatest(n, F.lit(1))
    return (n < shortest) | (ratio < F.when(n <= short, least_short).otherwise(least_long))


def injection_suspect(text: Column) -> Column:
    """Whether a text holds one of INJECTIONS, in any case; null and empty texts don't."""
    return F.coalesce(text.rlike("(?i)" + "|".join(INJECTIONS)), F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    """pdf, docx, doc, txt or md by the suffix, also one written ``_pdf``; ``other`` else."""
    kind = F.lower(F.regexp_extract(path, r"(?i)[._](pdf|docx|doc|txt|md)$", 1))
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("other"))


def repair_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"_(pdf|docx|txt)$", ".$1")


def url_stem(url: Column) -> Column:
    """The file name of an address without its suffix, percent signs decoded."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(last), last), r"\.[^.]*$", "")


def object_key(path: Column, day: Column, content: Column) -> Column:
    return F.concat_ws("/", path, F.date_format(day, "yyyy-MM-dd"), F.left(F.md5(content), F.lit(16)))


def clean_scan(text: Column) -> Column:
    """Scanned text without a fence at its very start and end, outer blanks of lines and blank lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(markdown)?\s*", ""), r"\s*```$", "")
    lines = F.transform(F.split(bare, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def needs_rescan(text: Column) -> Column:
    """Fewer than 30 CJK characters and no table, that is no line with two bars or no ``|---``; null texts need it."""
    table = text.rlike(r"\|.*\|") & text.contains("|---")
    return F.coalesce((F.regexp_count(text, F.lit(_CJK)) < 30) & ~table, F.lit(True))


def embedding_text(name: Column, label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")).isin("", "Entity"), name).otherwise(F.concat_ws(" ", name, label))


def short_description(text: Column, longest: int = 200) -> Column:
    out = F.regexp_replace(text, "^[\"'“”]+|[\"'“”]+$", "")
    return F.when(F.char_length(out) > longest, F.concat(F.left(out, F.lit(longest)), F.lit("..."))).otherwise(out)


def request_spacing(per_minute: Column) -> Column:
    return F.greatest(F.lit(0.01), 60.0 / per_minute * 1.1)


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """The parts between separators, without outer blanks and empty parts."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def csv_of(rows: Column, names: list[str]) -> Column:
    """Comma-separated text of an array of maps, header first, columns in order of name, nothing quoted."""
    order = sorted(names)
    body = F.transform(rows, lambda r: F.array_join(F.array(*[F.coalesce(r[n], F.lit("")) for n in order]), ","))
    return F.array_join(F.concat(F.array(F.lit(",".join(order))), body), "\n")


def rows_of_csv(text: Column) -> Column:
    """Maps of the rows of comma-separated text; rows of another number of fields than the header are dropped."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    header = F.transform(F.split(lines[0], ","), lambda x: F.trim(x))
    fields = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))
    return F.transform(F.filter(fields, lambda f: F.size(f) == F.size(header)), lambda f: F.map_from_arrays(header, f))
