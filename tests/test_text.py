import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import jsonfix as j
from quillgraph.functions import text as t


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("given_", "wanted"), [("_test_text_", "testtext"), ("  test  ", "test"), ("", ""), (None, None), ("a \n\t b", "a b")])
def test_clean_text(spark, given_, wanted):
    assert one(spark, given_, t.clean_text) == wanted


@pytest.mark.parametrize(("given_", "wanted"), [("test's name", "test\\'s name"), ('test"quote', 'test\\"quote'), ("test\nnewline", "test\\nnewline"), ("a\\b", "a\\\\b")])
def test_escape_text(spark, given_, wanted):
    assert one(spark, given_, t.escape_text) == wanted


def test_escape_cuts_first(spark):
    assert len(one(spark, "a" * 2000, lambda c: t.escape_text(c, 100))) == 100


@pytest.mark.parametrize(("given_", "wanted"), [("a(b)", "a（b）"), ("a\tb", "a b"), (" \n ", "Unknown_Entity"), (None, "Unknown_Entity"), ("it's", "it's"), ("a:b*c?", "a：b＊c？")])
def test_sanitize_name(spark, given_, wanted):
    assert one(spark, given_, t.sanitize_name) == wanted


def test_sanitize_labels(spark):
    assert one(spark, "match", t.sanitize_relation) == "REL_match"
    assert one(spark, None, t.sanitize_relation) == "关联"
    assert one(spark, "RETURN", t.sanitize_type) == "Type_RETURN"
    assert one(spark, "  ", t.sanitize_type) == "Entity"


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_sanitize_name_is_idempotent(spark, value):
    once = one(spark, value, t.sanitize_name)
    assert one(spark, once, t.sanitize_name) == once


@pytest.mark.parametrize(("given_", "wanted"), [("+3.5D", "350度"), ("0.29 ds", "28度"), ("-1.25D", "-125度"), ("OK镜", "角膜塑形镜"), ("AL", "眼轴长度"), ("近视", "近视"), ("", ""), (None, None)])
def test_normalize_name(spark, given_, wanted):
    assert one(spark, given_, t.normalize_name) == wanted


def test_stop_reason(spark):
    assert one(spark, "在强光下", t.stop_reason) == "Matches Stop Pattern"
    assert one(spark, "长" * 16, t.stop_reason) == "Length > 15"
    assert one(spark, "近视", t.stop_reason) is None


@pytest.mark.parametrize(("given_", "wanted"), [("近视", True), ("患者", False), ("某某医院", False), ("黄斑中心凹", True), ("http近视", False), ("a/b", False), ("眼", True), (None, False), ("挂号系统", False)])
def test_valid_entity(spark, given_, wanted):
    assert one(spark, given_, t.is_valid_entity) is wanted


def test_strip_fences(spark):
    assert one(spark, "<think>x</think>```cypher\nMATCH (n)\n```", t.strip_fences) == "MATCH (n)"
    assert one(spark, "plain <think> never closed", t.strip_fences) == "plain"


def test_csv_round_trip(spark):
    rows = spark.createDataFrame([([{"name": "Alice", "age": "30"}, {"name": "Bob", "age": "25"}],)], "r array<map<string,string>>")
    text = rows.select(t.csv_of(F.col("r"), ["name", "age"])).first()[0]
    assert text == "age,name\n30,Alice\n25,Bob"
    assert one(spark, "name,age\nAlice,30\nBob,25\nbad", t.rows_of_csv) == [{"name": "Alice", "age": "30"}, {"name": "Bob", "age": "25"}]


@pytest.mark.parametrize("raw", ["{'k': 1}", '{"k": 1', '{k: 1}', '{"k": 1,}', '{"k": 1} // note', '/* c */{"k": 1}'])
def test_repair(spark, raw):
    assert one(spark, raw, lambda c: F.try_variant_get(j.safe_parse(c), "$.k", "int")) == 1


def test_parse_of_no_json(spark):
    assert one(spark, "invalid", lambda c: F.try_variant_get(j.safe_parse(c), "$.k", "int")) is None


def test_extract_balanced(spark):
    df = spark.createDataFrame([(1, 'Some text {"a": {"b": "}"}} more'), (2, "none"), (3, None), (4, "see [1, 2]")], "id int, s string")
    assert {r[0]: r[1] for r in j.extract(df, "id", "s").collect()} == {1: '{"a": {"b": "}"}}', 2: None, 3: None, 4: "[1, 2]"}


@pytest.mark.parametrize("raw", ['[{"name": "test", "type": "disease"}]', '{"entities": [{"name": "test", "type": "disease"}]}', '{"name": "test", "type": "disease"}', '{"entity": "test", "category": "disease", "label": "x"}'])
def test_entities(spark, raw):
    assert [(r["name"], r["type"]) for r in one(spark, raw, j.entities)] == [("test", "disease")]


def test_entities_of_any_form(spark):
    assert j.entities_of("near\nfar") == [("near", "unknown", {}), ("far", "unknown", {})]
    assert j.entities_of('[{"text": "a", "category": "b", "page": 3}, "c", 4]') == [("a", "b", {"page": "3"}), ("c", "unknown", {})]
    assert j.entities_of('{"head": "a", "relation": "r", "tail": "b", "n": 1}') == [(None, None, {"head": "a", "relation": "r", "tail": "b", "n": "1"})]
    assert j.entities_of("Sure:\n```json\n{'entities': [{name: 'it's', type: 'x'},]\n```") == [("it's", "x", {})]
    assert j.entities_of("") == j.entities_of(None) == []


REPAIRS = {
    '{"a": 1': {"a": 1}, "{'a': 'b'}": {"a": "b"}, '{a: 1, "b": [1, 2,], }': {"a": 1, "b": [1, 2]}, '{"a": [1, 2}': {"a": [1, 2]}, '{"a": 1}]': {"a": 1}, "[1, [2, 3]": [1, [2, 3]],
    '{"u": "http://x.y"} // so': {"u": "http://x.y"}, '/* a */ {"a": 1 /* b */}': {"a": 1}, '{"a": "it\'s"}': {"a": "it's"}, "{'a': 'it's', 'b': None}": {"a": "it's", "b": None},
    'so: {"a": {"b": 2}} done': {"a": {"b": 2}}, "{近视: True}": {"近视": True}, '{"a": "x\ny"}': {"a": "x\ny"}, "nothing": None, "": None, "3": 3, "{": {}, "[" * 5_000: None, "[{(": [{"": None}],
}


def test_repairs():
    for raw, wanted in REPAIRS.items():
        if wanted is None and raw.startswith("["):
            assert isinstance(j.read(raw), list)
        elif raw != "[{(":
            assert j.read(raw) == wanted, raw
    assert isinstance(j.read("[{("), list)


def test_long_open_text_is_read_once():
    import time

    began = time.perf_counter()
    assert j.balanced('{"a": [' * 60_000) is None and j.read("{" * 20_000 + "x") is not None
    assert time.perf_counter() - began < 5


def test_fields(spark):
    assert one(spark, '{"k": 1, "s": "x"}', lambda c: j.has_fields(c, {"k": "number", "s": "string"})) is True
    assert one(spark, '{"k": "1"}', lambda c: j.has_fields(c, {"k": "number"})) is False
    assert one(spark, "[1]", lambda c: j.has_fields(c, {"k": "number"})) is False


def test_rules_of_names(spark):
    for name, good in {"眼": True, "EMR接口": False, "眼科中心一部": False, "中心凹": True, "患者": False, " 患者": True, "a" * 51: False, "": False}.items():
        assert one(spark, name, t.is_valid_entity) is good, name
    for name, bad in {" -": True, "℃": False, "→": False, "（）": False, "，。": True, "": True}.items():
        assert one(spark, name, t.is_punctuation) is bad, name
    for raw, hit in {"; DROP x": True, ";drop x": True, "exec (1)": True, "; dropping": False, "DELETE FROM x": False, "http://a": False}.items():
        assert one(spark, raw, t.injection_suspect) is hit, raw
    assert one(spark, "```markdown\n a \n\n b ```", t.clean_scan) == "a\nb" and one(spark, "a\n```\nb", t.clean_scan) == "a\n```\nb"
    assert one(spark, "|a|b|\n|---|---|", t.needs_rescan) is False and one(spark, "a | b", t.needs_rescan) is True


def test_triplets(spark):
    raw = 'Sure:\n[{"head": "a", "relation": "r", "tail": "b", "head_type": "x", "tail_type": "y"},]'
    assert [tuple(r) for r in one(spark, raw, j.triplets)] == [("a", "x", "r", "b", "y")]
    assert one(spark, "nothing here", j.triplets) is None


def test_triplet_rows_without_marks_alone(spark, tmp_path):
    import __spark_entry__

    tried = ["-", "，", "、。", "_ '", " ", "", None, "-\n", "r", "℃", "-\u2028", "a\x0bb", "\x0b", "a \u2028"]
    rows = [(i, *(tried[i % 14] if i // 14 == k else f"{n}{i}" for k, n in enumerate("hrt")), None if i % 2 else "x", "y", i // 14) for i in range(42)]
    rows.append((42, "h", "-", "t", "x", "y", 3))
    spark.createDataFrame(rows, "triplet_id long, head string, relation string, tail string, head_type string, tail_type string, item_id long").write.parquet(f"{tmp_path}/triplet.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["triplet_rows"](spark, str(tmp_path)).collect()}
    assert got == {(0, 6, 6, 2), (1, 6, 6, 2), (2, 6, 6, 2)}
    db = duckdb.connect()
    db.sql(f"create view triplet as select * from '{tmp_path}/triplet.parquet/*.parquet'")
    assert got == set(db.sql(__spark_entry__.oracle_sql()["triplet_rows"]).fetchall())


def test_rates(spark):
    assert one(spark, 120, t.request_spacing, "int") == pytest.approx(0.55)
    assert one(spark, 1_000_000, t.request_spacing, "int") == 0.01


def test_file_names(spark):
    assert one(spark, "a_pdf", t.file_kind) == "pdf"
    assert one(spark, "a.jpeg", t.file_kind) == "other"
    assert one(spark, "https://x/y/%E8%BF%91.pdf?s=1", t.url_stem) == "近"


def test_standard_triplets(spark):
    from quillgraph.operators import retrieval

    terms = spark.createDataFrame([(1, "视网膜脱离"), (2, "青光眼")], "term_id int, term string")
    synonyms = spark.createDataFrame([("网脱", "视网膜脱离")], "alias string, term string")
    rows = [(1, "网脱", "r", "青光眼"), (2, "视网膜脱落离", "r", "角膜移植"), (3, "网脱", "r", "视网膜脱离"), (4, None, "r", "青光眼"), (5, "青光眼", " ", "网脱")]
    got = {tuple(r) for r in retrieval.standard_triplets(spark.createDataFrame(rows, "id int, head string, relation string, tail string"), terms, synonyms).collect()}
    assert got == {(1, "视网膜脱离", "r", "青光眼", "网脱", None), (2, "视网膜脱离", "r", "角膜移植", "视网膜脱落离", None)}
    same = spark.createDataFrame([("啊啊啊啊啊啊啊啊",)], "name string")
    assert retrieval.closest_terms(same, spark.createDataFrame([(3, "啊啊啊啊啊啊啊")], "term_id int, term string")).first()["term_id"] == 3


def test_fuzzy_terms_of_all_sources(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([("视网膜脱落离", "extract"), ("青光眼病", None), ("角膜", "manual")], "name string, source string").write.parquet(f"{tmp_path}/entity_node.parquet")
    spark.createDataFrame([(1, "视网膜脱离"), (2, "青光眼")], "term_id int, term string").write.parquet(f"{tmp_path}/standard_entity.parquet")
    got = {(r["name"], r["term_id"]) for r in __spark_entry__.queries()["fuzzy_standard_terms"](spark, str(tmp_path)).collect()}
    assert got == {("视网膜脱落离", 1), ("青光眼病", 2)}
