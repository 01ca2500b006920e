import math
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillgraph.llm import canonical, components, dedup, mixing, neighbours, queries, scans, splitting, tokens, topics

QUERIES = queries.queries()

# ---- splitting

TEXTS = ["", "a" * 3000, "句子。" * 1000, "\n\n".join(["段落" * 50 + "。"] * 40), "# 题\n" + "行一行。\n" * 600, "他说：“好。”" * 500, "x. y " * 900, "长" * 1300 + "。" + "长" * 1500 + "！" + "短。" * 300]


def brute_boundaries(text):
    out = {0, len(text)}
    closers = "\"'”’」』）)]】》"
    for i, c in enumerate(text):
        if c == "\n":
            out.add(i + 1)
        elif c in "。！？!?；;….":
            e = i + 1
            while e < len(text) and text[e] in closers:
                e += 1
            if c != "." or e == len(text) or text[e].isspace():
                out.add(e)
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_boundaries(text):
    assert set(splitting.boundaries(text)) == brute_boundaries(text)


def check_chunks(text, limit, overlap):
    """The rules of a text's chunks, by a plain scan for boundaries."""
    chunks, marks, end = splitting.split_text(text, limit, overlap), brute_boundaries(text), 0
    for k, (s, e, stretch) in enumerate(chunks):
        assert e - s <= limit and s == (max(0, end - overlap) if k else 0) and (e > end or not text)
        assert (stretch == 0) == (e in marks)
        if stretch:  # then none was in reach
            assert not any(end < m <= s + limit for m in marks)
            assert stretch == min(m for m in marks if m > e) - max(m for m in marks if m < e)
        end = e
    assert end == len(text)
    return chunks


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="ab。.！\n ”)，#-|`1", max_size=400), st.integers(12, 40))
@example("aa\n\n aaaaaaaa", 12)
@example("aa\naaaaaaaaaa", 12)
def test_chunks_hold_the_rules(text, limit):
    check_chunks(text, limit, limit // 4)


BOOK = "# 一\n引言。\n## 二\n" + "甲。" * 30 + "\n### 三\n" + "乙。" * 30 + "\n## 四\n丙。\n\n- a\n  - b\n  - c\n- d\n\n| x |\n|---|\n\n```\n# no\n```\n# 五\n丁。"


def outline(node):
    return (node.kind, [outline(x) for x in node.children]) if node.children and node.kind != "paragraph" else node.kind


def test_structure_nests():
    line = "line"
    items = ("list", [("item", [line, ("item", [line]), ("item", [line])]), ("item", [line]), line])
    four = ("section", ["heading", "paragraph", items, ("table", [line, line, line]), ("fence", [line, line, line])])
    two = ("section", ["heading", "paragraph", ("section", ["heading", "paragraph"])])
    assert outline(splitting.structure(BOOK)) == ("section", [("section", ["heading", "paragraph", two, four]), ("section", ["heading", "paragraph"])])


def test_siblings_are_merged_whole():
    texts = [BOOK[s:e] for s, e, _ in splitting.split_text(BOOK, 80, 0)]
    # The first section is over the limit and opened, so is the second level; whole sections are left together.
    assert [x.split("\n")[0] for x in texts] == ["# 一", "## 二", "### 三", "## 四", "# 五"]


def test_chunks_of_the_tables(spark, sf):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/document_index.parquet").collect() if r["text"] and len(r["text"]) > 1400}
    got, kinds = {}, set()
    for r in QUERIES["p1_chunks"](spark, sf).collect():
        got.setdefault(r["item_id"], []).append((r["chunk_index"], r["start"], r["end"], r["stretch"], r["chunk"]))
    assert set(got) == set(items)
    for item, chunks in got.items():
        text, marks = items[item], sorted(brute_boundaries(items[item]))
        wanted = [(i, *c, text[c[0] : c[1]]) for i, c in enumerate(check_chunks(text, 1400, 200))]
        assert sorted(chunks) == wanted
        kinds |= {(item, "oversized")} | ({(item, "no_boundary")} if max(b - a for a, b in zip(marks, marks[1:])) > 1400 else set())
    assert {tuple(r) for r in QUERIES["p1_found"](spark, sf).collect()} == kinds


def test_split_oversized_cases(spark):
    rows = [(1, "句。" * 1000, 0), (2, None, 0), (3, "", 1), (4, "短。", 1), (5, "a" * 2000, 1), (1, "句。" * 1000, 0), (6, " " * 2000, 2)]
    df = spark.createDataFrame(rows, "item_id long, text string, chunk_index int")
    got = splitting.split_oversized(df).collect()
    assert {r["item_id"] for r in got} == {1, 5, 6}
    assert all(len(r["chunk"]) <= 1400 for r in got)
    assert splitting.split_oversized(df.limit(0)).isEmpty()


# ---- components


def closure(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    least = {}
    for x in parent:
        least[find(x)] = min(x, least.get(find(x), x))
    return {(least[find(x)], x) for x in parent}


@pytest.mark.parametrize("bound", [7, 40, 10_000])
def test_components(spark, bound):
    rng = random.Random(3)
    links = [(f"{rng.randrange(400):03}", f"{rng.randrange(400):03}") for _ in range(220)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"h{i}") for i in range(80)] + [(None, "x"), ("y", "y"), ("z", None)]
    df = spark.createDataFrame(links, "src string, dst string").repartition(3)
    assert {tuple(r) for r in components.components(df, edges_per_partition=bound).collect()} == closure(links)


def test_matches_by_status(spark):
    rows = [(" merge\n", "a", "b"), ("MERGE", "b", "c"), ("REVIEW", "c", "d"), (None, "d", "e"), ("MERGE", None, "e")]
    df = spark.createDataFrame(rows, "status string, left_id string, right_id string")
    assert {tuple(r) for r in components.groups_of_matches(df).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    assert components.groups_of_matches(df.limit(0)).isEmpty()


# ---- canonical names

ENTRIES = [(1, "混合性视神经血管闭塞", ["LKVIMX"]), (2, "混合性视神经剥脱综合征", []), (3, "云杉台式眼压计", ["HML-ISR", None]), (4, None, ["XBFEBS"]), (5, "云杉台式", None), (6, "Opticlear Drops", []), (7, "近视镜", []), (8, "屈光参差", None), (9, "视网膜病", None)]
NAMES = {
    "混合性视神经血管闭塞": 1, "混合性视神经血管闭一": 1, "混合性視神经血管闭 塞": 1, "混性合视神经剥脱综合征": 2, "旧云杉台式眼压计": 3, "【云杉 台式眼压计】": 3, "hml-isr": 3, "HMLISR": 3, "HMLISX": 0,
    "Opticlaer drops": 6, "opticler-drops": 6, "Optical drum": 0, "近镜视": 7, "近视": 7, "视网膜病屈光参差": 9, "屈光参差视网膜病": 8,
    "ＬＫＶＩＭＸ": 1, "xbfebs": 4, "云杉台式眼": 5, "同上": 0, "??": 0, "": 0, None: 0, "云杉眶骨膜细胞稀疏量表": 0,
}


@pytest.mark.parametrize("per_pass", [1, 100])
def test_mapping(spark, per_pass):
    rows = [(str(i), n, 7) for i, n in enumerate(NAMES)] * 2
    values = spark.createDataFrame(rows, "id string, name string, term_id int")
    entries = spark.createDataFrame(ENTRIES, "term_id int, term string, aliases array<string>")
    got = {r["id"]: r["term_id"] for r in canonical.map_to_entries(values, entries, per_pass=per_pass).collect()}
    assert {n: got[str(i)] for i, n in enumerate(NAMES)} == NAMES
    assert {r["term_id"] for r in canonical.map_to_entries(values, entries.limit(0)).collect()} == {0}
    assert canonical.map_to_entries(values.limit(0), entries).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="甲乙丙丁", min_size=1, max_size=6), max_size=12), st.text(alphabet="甲乙丙丁", min_size=1, max_size=7))
def test_most_alike(names, text):
    matcher = canonical.Matcher([(i, [x]) for i, x in enumerate(names)])
    own = canonical.tokens(text)
    best = min(((-2 * len(own & canonical.tokens(x)) / (len(own) + len(canonical.tokens(x))), t, x) for x, t in matcher.names.items()), default=None)
    wanted = None
    if best and -best[0] >= canonical.LEAST_SIMILARITY:
        most = int(canonical.MOST_EDITS * max(len(best[2]), len(text)))
        wanted = best[1] if canonical.edits(text, best[2], most) <= most else None
    found = matcher.similar(text)
    assert (found and found[3]) == wanted


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
def test_edits(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert canonical.edits(a, b, 9) == d[len(a), len(b)]
    assert canonical.edits(a, b, 2) == min(3, d[len(a), len(b)])


# ---- neighbours


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(40, size=3000)] + 0.8 * rng.normal(size=(3000, 64))) * rng.uniform(0.1, 9, size=(3000, 1))
    df = spark.createDataFrame([(f"{i:05}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id string, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["id"], set()).add(int(r["neighbour"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T
    np.fill_diagonal(close, -2)
    best = np.argsort(-close, axis=1)[:, :10]
    hits = sum(len(got[f"{i:05}"] & set(best[i].tolist())) for i in range(3000))
    assert len(got) == 3000 and all(len(v) == 10 for v in got.values())
    assert hits / 30_000 >= 0.9


def test_recall_on_the_tables(spark, sf):
    rows = {r["id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/entity_vector.parquet").collect()}
    good = {i: np.array(v) for i, v in rows.items() if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    close = u @ u.T
    np.fill_diagonal(close, -2)
    wanted = {(ids[i], ids[j]) for i, row in enumerate(np.argsort(-close, axis=1, kind="stable")[:, :10]) for j in row}
    got = [tuple(r) for r in QUERIES["p4_neighbours"](spark, sf).collect()]
    assert len({(a, b) for a, b, _, _ in got} & wanted) >= 0.9 * len(wanted) and len(got) == len(wanted)
    at = {x: i for i, x in enumerate(ids)}
    assert all(abs(close[at[a], at[b]] - c) < 1e-6 for a, b, c, _ in got)


def test_lists_of_copies_and_of_few():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=64), (500, 1)), rng.normal(size=(900, 64))]).astype(np.float32)
    own = neighbours.fit_lists(x, 40, len(x), 10)
    at, far = own.search(neighbours._unit(x))
    assert own.members(at, far).any(1).all() and own.queries(at, far).any(1).all()
    exact = np.argsort(-(neighbours._unit(x) @ own.c.T), axis=1)[:, :3]
    assert np.mean([set(a) <= set(b) for a, b in zip(exact.tolist(), at.tolist())]) > 0.99
    for few in (x[:1], x[:7], x[500:503]):
        lists = neighbours.fit_lists(few, 1, len(few), 10)
        assert lists.queries(*lists.search(neighbours._unit(few))).all()


def test_unusable_vectors_and_copies(spark, monkeypatch):
    v = [1.0] + [0.0] * 63
    w = [0.9, 0.1] + [0.0] * 62
    rows = [("a", v), ("a", v), ("b", [2 * x for x in v]), ("c", w), ("n", None), ("e", []), ("s", v[:10]), ("z", [0.0] * 64), ("q", [math.nan] + v[1:]), ("i", [math.inf] + v[1:]), (None, v)]
    rows += [(f"x{i:02}", v) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").selectExpr("id", "embedding", "id as place", "1 as v")
    got = neighbours.nearest(df)
    pairs = {tuple(r) for r in neighbours.close_pairs(got).collect()}
    ids = {r["id"] for r in got.collect()}
    assert ids == {"a", "b", "c"} | {f"x{i:02}" for i in range(30)}
    assert ("a", "b") in pairs and all(a < b for a, b in pairs)
    assert {r["neighbour"] for r in got.where("id = 'x29'").collect()} == {"a", "b"} | {f"x{i:02}" for i in range(8)}  # ties by id
    assert neighbours.nearest(df.limit(0)).isEmpty()
    assert neighbours.nearest(df.where("id = 'c'")).isEmpty()


# ---- dedup


def test_collapse(spark):
    rows = [(1, "近视", "导致", "A b"), (2, "「近 视」", "导致。", "ab"), (3, "Ａ-Ｂ", "导致", "近视！"), (4, "近视", "导致", None), (5, "…", "导致", "x"), (6, "近视", "预防", "ab"), (2, "「近 视」", "导致。", "ab"), (None, "近视", "导致", "ab"), (7, "", "", "")]
    df = spark.createDataFrame(rows, "triplet_id long, head string, relation string, tail string").selectExpr("*", "1 as id", "2 as k0")
    groups, copies = dedup.collapse(df)
    assert {tuple(r) for r in copies.collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in groups.collect()} == {(1, 3), (6, 1)}
    groups, copies = dedup.collapse(df.limit(0))
    assert groups.isEmpty() and copies.isEmpty()


# ---- tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.ByteEncoder(tokens.read_ranks(tokens.vocabulary_path()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_matches_the_library(encoder, text):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ids, special_tokens={})
    assert encoder.encode(text) == own.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text


def test_long_and_empty_texts(spark, encoder):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "ab" * 50_000), (5, "<|endoftext|>"), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_column(df).collect()}
    assert got[1] == got[2] == [] and encoder.decode(got[3]) == "  "
    assert encoder.decode(got[4]) == "ab" * 50_000 and 50256 not in got[5] and encoder.decode(got[5]) == "<|endoftext|>"
    assert len(got) == 6 and tokens.encode_column(df.limit(0)).isEmpty()


# ---- mixing


def test_mix_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(20, 200)) for i in range(6000)] + [(9001, None, 50), (9002, "other", 50), (9003, "big", None)]
    rows += [(10_000 + i, "tiny", rng.randrange(20, 200)) for i in range(150)]
    records = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    plan = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 2), ("tiny", 0.2, 3), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    budget = {r["source"]: r for r in mixing.source_budget(records.selectExpr("source", "tokens as size"), plan).collect()}
    assert {n for n, b in budget.items() if b["short"]} == {"none", "tiny"}
    mixed = mixing.mix(records, plan, block=500)
    report = {r["source"]: r for r in mixing.shares_reached(mixed, records, plan).collect()}
    assert {n for n, r in report.items() if r["short"]} == {"none", "tiny"}
    assert report["tiny"]["mixed_tokens"] == 3 * budget["tiny"]["own"]  # complete
    for name, b in budget.items():
        assert abs(report[name]["mixed_tokens"] - b["reached"]) <= 700
        assert report[name]["most_repeats"] <= b["max_repeats"]
        assert abs(report[name]["share_of_total"] - report[name]["mixed_tokens"] / b["total"]) < 1e-12
    assert abs(report["big"]["share_of_total"] - 0.3) < 0.002 < report["big"]["share_of_mix"] - 0.3
    counts = mixed.groupBy("doc_id", "repeat").count()
    assert counts.where("count > 1").isEmpty() and counts.where("doc_id >= 10000").count() == 450
    # Any stretch of the mix has about the shares of the whole.
    order = [r["source"] for r in mixed.orderBy("slot").select("source").collect()]
    part, own = order[len(order) // 3 : 2 * len(order) // 3].count("big"), order.count("big")
    assert abs(3 * part - own) < 0.1 * own
    assert mixing.mix(records.limit(0), plan).isEmpty()
    assert mixing.mix(records, plan.limit(0)).isEmpty()


@pytest.mark.parametrize("quotas", [[("a", 1)], [("a", 7), ("b", 1), ("c", 0)], [("a", 40_000), ("b", 3), ("c", 777)], [(f"s{i}", i + 1) for i in range(40)]])
def test_quotas_are_met(spark, quotas):
    got = mixing.slots_of(spark, quotas).groupBy("source").agg({"rank": "max", "slot": "count"}).collect()
    assert sorted((r["source"], r["count(slot)"]) for r in got) == sorted((n, q) for n, q in quotas if q) and all(r["max(rank)"] + 1 == r["count(slot)"] for r in got)


# ---- topics

WORDS = {"law": ["条例", "诉讼", "仲裁", "许可证"], "food": ["维生素", "粗粮", "菠菜", "蛋白质"], "code": ["cache", "thread pool", "deployment", "rollback"]}


def sentence(rng, area):
    w = rng.choice(WORDS[area])
    return rng.choice([f"关于{w}，目前只有零散的材料。", f"{w}应由专人负责。", f"Opinions differ on {w} here. ", f"把{w}放到之后再谈。"])


def test_held_out_accuracy():
    rng = random.Random(2)
    names = sorted(WORDS)
    texts, labels = [], []
    for _ in range(500):
        own = rng.sample(names, rng.choice([1, 1, 2]))
        texts.append("".join(sentence(rng, a) for a in own for _ in range(4)) + "下面逐条说明。")
        labels.append({names.index(a) for a in own} if rng.random() > 0.03 else {0})
    model = topics.train(texts[:400], labels[:400], 3)
    hit = 0
    for text, own in zip(texts[400:], labels[400:]):
        parts = topics.sentences(text)
        p = topics._scores(model["weights"], model["bias"], *topics._by_sentence(*topics.Features().of(parts)), len(parts))
        share = topics._shares(p, np.array([len(x) for x in parts], float), np.zeros(len(parts), int), 1, model["cut"])[0]
        hit += set(np.flatnonzero(share >= model["least"]).tolist()) == own
    assert hit >= 90


def test_areas_of_edges(spark):
    rng = random.Random(4)
    names = sorted(WORDS)
    rows = [(i, "".join(sentence(rng, names[i % 3]) for _ in range(5)), i) for i in range(120)] + [(900, None, 0), (901, "", 0), (902, "  ", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, area int")
    labels = spark.createDataFrame([(i, f" {names[i % 3].upper()} ") for i in range(90)] + [(5, None), (None, "law"), (6, "unknown"), (7777, "law")], "doc_id long, area string")
    areas = spark.createDataFrame([(n,) for n in names] + [(None,)], "area string")
    got = {}
    for r in topics.areas_of(docs, labels, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    assert sum(got.get(i) == {names[i % 3]} for i in range(120)) >= 110
    assert not {900, 901, 902} & set(got)
    assert topics.areas_of(docs, labels.limit(0), areas).isEmpty() and topics.areas_of(docs.limit(0), labels, areas).isEmpty() and topics.areas_of(docs, labels, areas.limit(0)).isEmpty()


# ---- scanned pages

BODY = [
    "People often confuse the sample with the outcome of the", "group and the measurement is rather short. The cross-", "sectional note mentions gonioscopy and photorecep-", "tor again. The sample has been registered here.",
    "这一部分暂时没有补充。上一版写于前月，本版略有增删。", "参加人员共11名，其余从略。下面逐条说明。",
]


def test_noise_of_pages(spark):
    rows = []
    for n in range(1, 41):
        body = list(BODY)
        if n == 5:
            body[0] = body[0].replace("sample", "samp1e")
        if n == 6:
            body[4] = body[4].replace("增删", "憎删")
        if n == 7:
            body[5] = body[5].replace("11", "ll")
        body.insert(0, "This is how a page begins.")
        body.append("A plain line about the photoreceptor and the cross-sectional sample.")
        head = "Handbook of Samples" if n != 9 else "Handbok of Samples"
        rows.append((n, "f", n, "\n".join([head, *body, f"- {n + 10} -" if n != 11 else "- 2l -"]), "x"))
    rows += [rows[0], (100, None, None, "lonely", "x"), (101, "f", 41, None, "x"), (102, "f", 42, "", "x"), (None, "f", 1, "a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, file_hash string, page_number int, text string, kind string")
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in scans.noise_of_lines(pages).collect()}
    assert {(n, 1, "header") for n in range(1, 41)} <= got
    assert {(n, 10, "page_no") for n in range(1, 41)} == {x for x in got if x[2] == "page_no"}
    assert {(n, 5, "hyphen") for n in range(1, 41)} == {x for x in got if x[2] == "hyphen"}
    assert {x for x in got if x[2] == "misread"} == {(5, 3, "misread"), (6, 7, "misread"), (7, 8, "misread")}
    fixed = {r["page_id"]: r["text"] for r in scans.repaired_pages(pages).collect()}
    assert "Handbook" not in fixed[1] and "photoreceptor again" in fixed[1] and "cross-sectional note" in fixed[1]
    assert "samp1e" not in fixed[5] and "增删" in fixed[6] and "共11名" in fixed[7]
    assert scans.noise_of_lines(pages.limit(0)).isEmpty()


def test_running_lines_of_a_long_file(spark):
    rows = []
    for n in range(1, 601):
        chapter = "".join(chr(97 + n // 5 // b % 25) * 4 for b in (1, 25))
        number = ("i", "ii", "iii", "iv", "v", "vi")[n - 1] if n <= 6 else str(n - 6 if n <= 300 else n - 300)
        rows.append((n, "f", n, f"chapter {chapter}\n这一部分暂时没有补充。\n下面逐条说明。\n其余从略。\n{number}"))
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in scans.noise_of_lines(spark.createDataFrame(rows, "page_id long, file_hash string, page_number int, text string")).collect()}
    assert got == {(n, *line) for n in range(1, 601) for line in ((1, "header"), (5, "page_no"))}


def test_word_broken_at_the_end_of_the_last_page(spark):
    pages = spark.createDataFrame([(1, "f", 1, "The sample and the out-"), (2, "f", 3, "The sample.")], "page_id long, file_hash string, page_number int, text string")
    assert {(r["page_id"], r["line_no"], r["kind"]) for r in scans.noise_of_lines(pages).collect()} == {(1, 1, "hyphen")}


@pytest.mark.parametrize(("line", "wanted"), [("- l2 -", ("-#-", 12)), ("xiv", ("roman", 14)), ("Page 7", ("p#", 7)), ("3 / 25", ("#/", 3)), ("第 4O 页", ("第#页", 40)), ("| a | 3 |", None), ("第3章", None), ("", None)])
def test_page_numbers(line, wanted):
    assert scans.page_number(line) == wanted


def test_edges_of_many_running_lines(spark):
    rows = []
    for n in range(1, 31):
        body = [f"The {w} of the sample was registered here, and nothing has been added to this part." for w in ("group", "lens", "record")]
        rows.append((n, "f", n, "\n".join(["Handbook of Samples", "Second Edition", "Chapter on Lenses", "Draft for Review", *body, "Printed in Town", "All for Nothing", f"- {n} -"])))
    pages = spark.createDataFrame(rows, "page_id long, file_hash string, page_number int, text string")
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in scans.noise_of_lines(pages).collect()}
    assert got == {(n, i, "header") for n in range(1, 31) for i in (1, 2, 3, 4, 8, 9)} | {(n, 10, "page_no") for n in range(1, 31)}


def test_counts_and_confusions(spark):
    lines = ["the sample of the market"] * 300 + ["the samp1e of the markct"] * 3 + ["科目"] * 50 + ["材料"] * 400 + ["材科"] * 8
    pages = spark.createDataFrame([(x,) for x in lines], "text string")
    grams = scans.corpus_grams(pages)
    counts = {r["gram"]: r["n"] for r in grams.collect()}
    assert counts["sample"] == 300 and counts["the"] == 606 and counts["材\x01科"] == 8 and counts["科"] == 58
    table = scans.corpus_counts(grams)
    own = scans.Counts(*table)
    assert all(own(g) == n for g, n in counts.items()) and own("nothing") == 0
    chances = scans.confusions(grams, table)
    assert abs(chances["料", "科"] - (8 + 200 * 0.03) / (408 + 200)) < 1e-9
    assert chances["e", "c"] < chances["z", "2"] == 0.03  # seen, and never seen
    channel = scans.Channel(own, chances)
    assert channel.decode(["The", "samp1e", "of", "the", "markct"]) == {1: "sample", 4: "market"}
    assert channel.decode(["材", "科"]) == {1: "料"} and channel.decode(["科", "目"]) == {}


def test_copies_of_a_page_that_differ(spark):
    rows = [(1, "f", 1, "b text here."), (1, "f", 1, "a text here."), (1, None, 1, "c text.")]
    frame = spark.createDataFrame(rows, "page_id long, file_hash string, page_number int, text string")
    found = {tuple(r) for r in scans.repaired_pages(frame).collect()}
    assert found == {tuple(r) for r in scans.repaired_pages(frame.orderBy(frame["text"].desc())).collect()} and len(found) == 1


def test_labelling_functions_are_measured(spark):
    rng = random.Random(6)
    names = sorted(WORDS)
    rows = [(i, "".join(sentence(rng, names[i % 3]) for _ in range(5)), f"/{names[i % 3]}-files/notes_{i}.txt", rng.choice(["a", "b"])) for i in range(150)] + [(900, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file_name string, source string")
    labelled = spark.createDataFrame([(i, [i % 3]) for i in range(60)], "_k long, _a array<int>").withColumnRenamed("_a", "_areas")
    found = {(r["value"], r["_a"]): r for r in topics.labelling_functions(docs, labelled, "doc_id", ["file_name", "source"]).collect()}
    assert all((found[f"file_name={n}", i]["hits"], found[f"file_name={n}", i]["n"]) == (20, 20) for i, n in enumerate(names))
    precise = {k for k, r in found.items() if r["precision"] >= topics.PRECISE}
    assert precise == {(f"file_name={n}", i) for i, n in enumerate(names)}  # "notes", "txt" and the sources are switched off
    weak = {r["_k"]: list(r["_areas"]) for r in topics.weak_labels(docs, labelled, "doc_id", ["file_name", "source"]).collect()}
    assert weak == {i: [i % 3] for i in range(60, 150)}
    areas = spark.createDataFrame([(n,) for n in names], "area string")
    people = spark.createDataFrame([(i, names[i % 3]) for i in range(60)], "doc_id long, area string")
    model = topics.fit_areas(docs, people, names)
    assert model["held_out"] == 150 and model["f1"] > 0.9


def test_model_is_saved_and_loaded(spark, tmp_path):
    rng = random.Random(7)
    names = sorted(WORDS)
    docs = spark.createDataFrame([(i, "".join(sentence(rng, names[i % 3]) for _ in range(5))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, names[i % 3]) for i in range(60)], "doc_id long, area string")
    areas = spark.createDataFrame([(n,) for n in names], "area string")
    model = topics.fit_areas(docs, labels, names)
    topics.save_model(spark, model, f"file://{tmp_path}/model")
    again = topics.areas_of(docs, labels, areas, model=topics.load_model(spark, f"file://{tmp_path}/model"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, topics.areas_of(docs, labels, areas).collect()))


def test_cuts_by_area():
    rng = np.random.default_rng(3)
    truth = (rng.random((600, 2)) < 0.4).astype(np.float32)
    own = np.where(truth > 0, 0.3, 0.08) + rng.normal(0, 0.02, truth.shape)
    own[:, 1] = truth[:, 1] * 0.12 + 0.01  # lower shares
    shares = np.stack([own] * len(topics.CUTS))
    cut, least = topics.calibrate(shares, truth)
    assert 0.1 < least[0] < 0.28 and 0.04 < least[1] <= min(0.125, least[0])
    assert topics.calibrated(shares, truth)["f1"] > 0.99
    assert topics.calibrate(shares[:, :0], truth[:0])[1].tolist() == [topics.LEAST_SHARE] * 2


# ---- queries over the tables against plain models


def test_tokens_and_mix_of_the_tables(spark, sf, encoder):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ids, special_tokens={})
    docs = {r["doc_id"]: (r["source"], own.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in QUERIES["p8_ids"](spark, sf).collect()} == {k: ids for k, (_, ids) in docs.items()}
    plan = {r["source"]: r for r in spark.read.parquet(f"{sf}/mix_plan.parquet").collect()}
    size = {name: sum(len(ids) for s, ids in docs.values() if s == name) for name in plan}
    short = {n for n, r in plan.items() if size[n] * r["max_repeats"] < r["target_share"] * sum(size.values())}
    assert {r["source"] for r in QUERIES["p9_found"](spark, sf).collect()} == short
    shares = {r["source"]: r for r in QUERIES["p9_shares"](spark, sf).collect()}
    for name, r in plan.items():
        wanted = min(size[name] * r["max_repeats"], r["target_share"] * sum(size.values()))
        longest = max((len(ids) for s, ids in docs.values() if s == name), default=0)
        assert shares[name]["own_tokens"] == size[name] and abs(shares[name]["mixed_tokens"] - wanted) <= (0 if name in short else 2_000 + longest)
    taken = {}
    for r in QUERIES["p9_mix"](spark, sf).collect():
        assert docs[r["doc_id"]][0] == r["source"] and r["tokens"] == len(docs[r["doc_id"]][1])
        taken.setdefault((r["doc_id"], r["repeat"]), []).append(r["slot"])
    assert all(len(x) == 1 for x in taken.values())


def test_names_of_the_tables(spark, sf):
    entries = spark.read.parquet(f"{sf}/standard_entity.parquet").collect()
    matcher = canonical.Matcher([(r["term_id"], [r["term"], *(r["aliases"] or [])]) for r in entries])
    names = {r["id"]: r["name"] for r in spark.read.parquet(f"{sf}/entity_node.parquet").where("source = 'manual'").collect()}
    wanted = {i: (matcher.match(n) or (9, 0.0, 0, 0))[3] for i, n in names.items()}
    assert {r["id"]: r["term_id"] for r in QUERIES["p3_found"](spark, sf).collect()} == wanted
    plain = {canonical.plain(x): r["term_id"] for r in entries for x in [r["term"], *(r["aliases"] or [])]}
    exact = {i: plain[canonical.plain(n)] for i, n in names.items() if n and canonical.plain(n) in plain}
    assert exact and all(wanted[i] == t for i, t in exact.items())
    unmatched = {r["name"]: r["n_ids"] for r in QUERIES["p3_unmatched"](spark, sf).collect()}
    assert sum(unmatched.values()) == sum(t == 0 for t in wanted.values())


def test_composition_of_the_tables(spark, sf):
    found = {}
    for r in QUERIES["p10_found"](spark, sf).collect():
        found.setdefault(r["area"], set()).add(r["doc_id"])
    assert {r["area"]: r["n_docs"] for r in QUERIES["p10_composition"](spark, sf).collect()} == {a: len(d) for a, d in found.items()}
