from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions.vocab import TERMS
from quillgraph.operators import chunking as c
from quillgraph.operators import retrieval as r

PARAGRAPHS = [["近视很常见。" * 3, "近视要防控。", "远视不同！" * 9, "角膜", "完"], [], ["x" * 30], ["眼压" * 40, "眼压" * 40, "a"], ["", "b"]]


def alike(a: str, b: str) -> float:
    x, y = ({w for w in TERMS if w in s} for s in (a, b))
    if not x and not y:
        x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def folded(parts, shortest, longest):
    out, cur, n = [], None, 0
    for p in parts:
        if cur is None:
            cur, n = p, len(p)
        elif n + len(p) <= longest and (n < shortest or alike(cur, p) >= 0.7):
            cur, n = cur + "|" + p, n + len(p)
        else:
            out.append(cur)
            cur, n = p, len(p)
    return out if cur is None else [*out, cur]


def test_fold_matches_a_plain_loop(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PARAGRAPHS)], "i int, p array<string>")
    got = {x[0]: x[1] for x in df.select("i", c.fold(F.col("p"), "|", 20, 60)).collect()}
    assert got == {i: folded(p, 20, 60) for i, p in enumerate(PARAGRAPHS)}


def test_merge_small_matches_a_plain_loop(spark):
    def merged(parts):
        out = []
        for p in parts:
            if out and len(p) < 10 and len(out[-1]) + len(p) <= 40:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    df = spark.createDataFrame([(i, p) for i, p in enumerate(PARAGRAPHS)], "i int, p array<string>")
    got = {x[0]: x[1] for x in df.select("i", c.merge_small(F.col("p"), 10, 40)).collect()}
    assert got == {i: merged(p) for i, p in enumerate(PARAGRAPHS)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。！? ", max_size=200), st.integers(5, 40))
def test_cuts_cover_the_text(text, longest):
    assert "".join(c.cuts_by_priority(text, longest)) == text
    assert all(len(p) <= longest for p in c.cuts_by_priority(text, longest)[:-1])


def test_fragments(spark):
    df = spark.createDataFrame([("甲乙。丙丁。戊己",)], "x string")
    row = df.select(c.head_fragment(F.col("x"), F.lit(6)), c.lead_fragment(F.col("x"), F.lit(7)), c.lead_fragment(F.col("x"), F.lit(2)), c.head_fragment(F.col("x"), F.lit(99))).first()
    assert tuple(row) == ("。", "甲乙。丙丁。", "甲乙", "甲乙。丙丁。戊己")


def test_trim_cut_term(spark):
    df = spark.createDataFrame([("戴角膜塑",), ("看角膜",), ("好",), (None,)], "x string")
    assert [x[0] for x in df.select(c.trim_cut_term(F.col("x"))).collect()] == ["戴", "看角膜", "好", None]


def test_limit_runs(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b", "a", "a", "a", "a"],), ([],)], "x array<string>")
    assert [x[0] for x in df.select(c.limit_runs(F.col("x"))).collect()] == [["a", "a", "b", "a", "a"], []]


def test_chunk_documents_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "眼" * 600, 1), (4, "短", 1)], "doc_id int, text string, chunk_index int")
    got = c.chunk_documents(df).collect()
    assert [(x["doc_id"], x["chunk_index"], x["chunk_total"]) for x in got] == [(3, 0, 1)]


def test_mentions_nested_and_empty(spark):
    texts = spark.createDataFrame([(1, "病理性近视和近视"), (2, None), (3, "")], "id int, body string")
    terms = spark.createDataFrame([("近视",), ("病理性近视",), ("",), (None,)], "term string")
    assert {tuple(x) for x in r.mentions(texts, terms, "id", "body").collect()} == {(1, "近视", 2), (1, "病理性近视", 1)}
    assert {tuple(x) for x in r.mentions(texts, terms, "id", "body", per_pass=1).collect()} == {(1, "近视", 2), (1, "病理性近视", 1)}
    assert r.mentions(texts, terms.limit(0), "id", "body").isEmpty()


def test_intents(spark):
    df = spark.createDataFrame([("阿托品的副作用和风险",), ("你好",), ("近视怎么治疗",), (None,)], "x string")
    best, simple = r.intent(F.col("x")), r.simple_intent(F.col("x"))
    got = df.select(best["intent"], simple["intent"], simple["confidence"]).collect()
    assert [x[0] for x in got[:3]] == ["TREATMENT", "GENERAL", "TREATMENT"]
    assert [x[1] for x in got[:3]] == ["COMPLICATION", "GENERAL", "TREATMENT"]
    assert got[0][2] == 0.6 and got[1][2] == 0.3


def test_keyword_entities_prefer_the_longest(spark):
    df = spark.createDataFrame([("病理性近视与散光",)], "x string")
    assert df.select(r.keyword_entities(F.col("x"))).first()[0] == ["病理性近视", "散光"]


def test_sequence_ratio(spark):
    from quillgraph.functions.similarity import sequence_ratio

    df = spark.createDataFrame([("近视眼", "近视"), (None, "a")], "a string, b string")
    assert [x[0] for x in df.select(sequence_ratio("a", "b")).collect()] == [SequenceMatcher(None, "近视眼", "近视").ratio(), None]
