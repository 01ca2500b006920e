import json

from quillgraph.operators import models
from quillgraph.sources import readers, sinks
from quillgraph.streaming import progress


def test_files_and_ledger(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("甲", encoding="utf-8")
    (tmp_path / "in" / "sub" / "b.md").write_bytes(b"\xff ok")
    (tmp_path / "in" / "c.exe").write_text("no")
    found = readers.text_documents(spark, str(tmp_path / "in"))
    assert sorted(r["file_name"] for r in found.collect()) == ["a.txt", "b.md"]
    book = str(tmp_path / "ledger")
    assert readers.new_files(found, readers.ledger(spark, book)).count() == 2
    sinks.save_ledger(found.where("file_name = 'a.txt'"), book)
    assert [r["file_name"] for r in readers.new_files(found, readers.ledger(spark, book)).collect()] == ["b.md"]


def test_backup_and_map_ledger(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "name": "x", "reason": "Length > 15"}]))
    (tmp_path / "l.json").write_text(json.dumps({"p": "h"}))
    assert [tuple(r) for r in readers.backup(spark, str(tmp_path / "b.json")).collect()] == [("1", "x", "Length > 15")]
    assert [tuple(r) for r in readers.ledger_of_map(spark, str(tmp_path / "l.json")).collect()] == [("p", "h")]


def test_questions(spark):
    text = "1. 问题：甲？\n上下文：乙\n正确答案：丙\n2. 问题：丁？ 上下文：戊 正确答案：己"
    got = readers.questions(spark.createDataFrame([(text,)], "value string")).collect()
    assert [tuple(r) for r in got] == [(1, "甲？", "乙", "丙"), (2, "丁？", "戊", "己")]


def test_export_and_report(spark, tmp_path):
    nodes, edges = readers.literal_graph(spark, [("a", "T")], [("a", "r", "b"), ("a", "r", "b")])
    summary = sinks.export_graph(nodes, edges, str(tmp_path / "out"))
    assert {tuple(r) for r in summary.collect()} == {("type", "T", 1), ("type", "Entity", 1), ("relation", "r", 1)}
    pairs = spark.createDataFrame([("MERGE", "a", "b", 0.95)], "status string, a string, b string, cosine double")
    sinks.alignment_report(pairs, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "[MERGE] a <-> b (0.9500)"
    sinks.save_evaluation(spark.createDataFrame([("q", ["c"])], "q string, c array<string>"), str(tmp_path / "e"))
    assert readers.sheet(spark, str(tmp_path / "e")).first()["c"] == '["c"]'
    assert tuple(sinks.control_row(nodes, nodes, edges).first()) == (2, 2, 1)


def test_embedding_hooks(spark):
    class Small:
        size = 2

        def embed(self, texts):
            if len(texts) > 1 or len(texts[0]) > 2:
                raise models.TooLarge
            return [[float(len(texts[0])), 1.0]]

    class Broken:
        size = 2

        def embed(self, texts):
            raise ValueError("down")

    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "a")], "id int, s string")
    got = {r["id"]: r["embedding"] for r in models.embed(df, "id", "s", Small()).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [1.0, 1.0]}
    bad = models.embed(df, "id", "s", Broken(), tries=1).where("error is not null")
    assert {r["id"] for r in bad.collect()} == {1, 3}


def test_ask(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert models.ask(spark, "?", lambda q, c: "```sql\nSELECT name, n FROM t_ask WHERE n > 1\n```", {"t_ask": df}) == ["b | 2"]


def test_streams(spark, tmp_path):
    rows = [("c1", "2024-01-01 00:00:00", 5.0, 1), ("c1", "2024-01-01 00:01:00", 3.0, 2), ("c2", "2024-01-01 09:00:00", 1.0, 3)]
    df = spark.createDataFrame(rows, "client string, at string, v double, n long").selectExpr("client", "timestamp(at) as at", "v", "n")
    df.write.parquet(str(tmp_path / "ev"))
    stream = progress.event_stream(spark, str(tmp_path / "ev"), df.schema)
    assert {r["client"]: r["value"] for r in progress.drained(progress.latest(stream, "client", "at", "v"), "complete").collect()} == {"c1": 3.0, "c2": 1.0}
    shown = progress.drained(progress.monotone_stream(stream, "client", "at", "v", "n"), "append")
    assert {r["seq"]: r["shown"] for r in shown.collect()} == {1: 5.0, 2: 5.0, 3: 1.0}
    assert [r["client"] for r in progress.alive(df, "client", "at").collect()] == ["c2"]


def moody():
    class Moody:
        def classify(self, text):
            if "x" in text:
                raise ValueError("no")
            return {"a": '```json\n{"intent": "发病机制", "confidence": 0.7}\n```', "b": "{broken", "c": '{"intent": "?"}'}.get(text, "")

        def score(self, query, texts):
            if "x" in texts:
                raise ValueError("no")
            return [0.15 if t == "a" else 0.1 for t in texts]

    return Moody()


def test_classified_intents(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x治疗"), (5, None), (6, "治疗方案")], "id int, s string")
    got = {r["id"]: (r["intent"], r["confidence"], r["by_model"], r["error"] is None) for r in models.classify(df, "id", "s", moody(), tries=1).collect()}
    assert got == {
        1: ("MECHANISM", 0.7, True, True), 2: ("GENERAL", 0.3, False, True), 3: ("GENERAL", 0.5, True, True),
        4: ("TREATMENT", 0.45, False, False), 5: (None, None, False, True), 6: ("TREATMENT", 0.6, False, True),
    }
    assert {r["intent"] for r in models.classify(df, "id", "s", None).where("id in (1, 6)").collect()} == {"GENERAL", "TREATMENT"}


def test_low_relevance_is_reported(spark):
    names = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "name string").coalesce(1)
    assert [tuple(r) for r in models.low_relevance(names, moody()).collect()] == [("b", 0.1, "Low Semantic Score (0.1000)", None)]
    failed = models.low_relevance(spark.createDataFrame([("x",)], "name string"), moody()).first()
    assert failed["score"] is None and "no" in failed["error"]
