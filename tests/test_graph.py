import random

from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.operators import maintenance as m
from quillgraph.operators import vectors as v

EDGES = [("a", "r", "b"), ("b", "r", "c"), ("c", "s", "d"), ("a", "s", "c"), ("d", "r", "a"), ("e", "r", "e")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, rel string, dst string")


def test_neighbours(spark):
    rows = {(r["name"], r["neighbour"], r["direction"]) for r in g.neighbours(edges(spark), 2).collect()}
    assert ("a", "b", "out") in rows and ("e", "e", "in") in rows
    assert all(r["place"] <= 2 for r in g.neighbours(edges(spark), 2).collect())


def test_paths_have_no_repeated_node(spark):
    starts = spark.createDataFrame([("a",)], "name string")
    found = g.paths(edges(spark), starts, 3).collect()
    assert all(len(set(r["nodes"])) == len(r["nodes"]) and r["hops"] == len(r["rels"]) for r in found)
    assert sorted("".join(r["nodes"]) for r in found) == ["ab", "abc", "abcd", "ac", "acd"]


def test_shortest(spark):
    pairs = spark.createDataFrame([("a", "d"), ("b", "d"), ("a", "e")], "source string, target string")
    found = {(r["source"], r["target"]): r["hops"] for r in g.shortest_paths(edges(spark), pairs, 3, "out").collect()}
    assert found == {("a", "d"): 2, ("b", "d"): 2}


def test_degrees_count_loops_twice(spark):
    assert {r["name"]: r["degree"] for r in g.degrees(edges(spark)).collect()} == {"a": 3, "b": 2, "c": 3, "d": 2, "e": 2}


def test_community(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    row = g.community(edges(spark), members, 1).first()
    assert (row["n_members"], row["n_pairs"], row["density"], row["is_community"]) == (3, 3, 1.0, True)


def test_groups_are_the_closure(spark):
    rng = random.Random(5)
    links = [(f"{rng.randrange(300):03}", f"{rng.randrange(300):03}") for _ in range(200)] + [(f"9{i:02}", f"9{i + 1:02}") for i in range(40)] + [(None, "x"), ("y", "y")]
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    wanted = {(find(x), x) for x in parent if find(x) != x}
    df = spark.createDataFrame(links, "a string, b string")
    assert {tuple(r) for r in g.groups(df).collect()} == wanted


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, rel string, dst string")
    assert g.neighbours(none).isEmpty() and g.degrees(none).isEmpty()
    assert g.groups(none.select(F.col("src").alias("a"), F.col("dst").alias("b"))).isEmpty()
    assert m.sink_properties(none)[0].isEmpty()


def test_align_and_migrate(spark):
    nodes = spark.createDataFrame([("1", "OK镜"), ("2", "角膜塑形镜"), ("3", "近视"), ("4", None), ("5", "近视 "), ("6", "远视")], "id string, name string")
    pairs = spark.createDataFrame([("3", "6", 0.95), ("1", "6", 0.5)], "a string, b string, cosine double")
    assert {tuple(r) for r in m.align(nodes, pairs).collect()} == {("1", "2"), ("3", "5"), ("3", "6")}
    moved = m.migrate_edges(edges(spark, [("1", "r", "3"), ("2", "r", "3"), ("3", "r", "6")]), m.align(nodes, pairs))
    assert [tuple(r) for r in moved.collect()] == [("1", "r", "3")]


def test_clean_and_restore(spark):
    nodes = spark.createDataFrame([("长" * 16, "x"), ("如果", "x"), ("近视", "x")], "name string, type string")
    kept, left, deleted = m.clean_nodes(nodes, edges(spark, [("近视", "r", "如果"), ("近视", "r", "眼")]))
    assert [r["name"] for r in kept.collect()] == ["近视"]
    assert [r["dst"] for r in left.collect()] == ["眼"]
    assert {r["name"] for r in m.restore_nodes(kept, deleted).collect()} == {"近视", "长" * 16}


def test_similar_pairs_over_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    wanted = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.9}
    assert {(r["a"], r["b"]) for r in v.similar_pairs(df, 0.9, block=16).collect()} == wanted


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, name string, created_at int")
    new = spark.createDataFrame([(2, None, 20), (3, "c", 20)], "id int, name string, created_at int")
    assert sorted(tuple(r) for r in m.upsert(old, new, "id").collect()) == [(1, "a", 10), (2, "b", 10), (3, "c", 20)]


def test_meta_paths_fall_back(spark):
    e = edges(spark, [("a", "r", "b"), ("b", "s", "c"), ("c", "r", "d")])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "source string, target string")
    got = {(r["source"], r["target"], r["hops"], r["is_meta_path"]) for r in g.meta_paths(e, pairs, ["r"]).collect()}
    assert got == {("a", "b", 1, True), ("a", "c", 2, False)}
    assert [r["target"] for r in g.meta_paths(e, pairs, ["r"], fallback=False).collect()] == ["b"]


def test_community_paths(spark):
    e = edges(spark, [(a, "r", b) for a, b in ("ab", "bc", "cd", "ad", "xy")])
    members = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    got = [(r["source"], r["target"], r["place"]) for r in g.community_paths(e, members, 1).orderBy("place").collect()]
    assert got == [("a", "b", 1), ("a", "d", 2), ("b", "c", 3), ("c", "d", 4)]
    assert g.community_paths(e, members, 1, most=3).count() == 3
    assert g.community_paths(e, spark.createDataFrame([("a",), ("c",), ("x",)], "name string"), 1).isEmpty()
