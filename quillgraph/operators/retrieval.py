"""Linking, intents, ranking and enrichment: what a search does with a question."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from ..functions.similarity import bound, sequence_ratio
from ..sizing import broadcast_if_small

#: Terms of a dictionary that one pass of ``mentions`` holds in memory.
TERMS_PER_PASS = 50_000


def mentions(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term", per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """(key, term, n): the terms that each text contains and how often; overlapping and nested ones all count.

    A dictionary of any length is worked off in passes of ``per_pass`` terms;
    each compiles its terms to one automaton, so a text is read once a pass.
    Null texts and null or empty terms match nothing.
    """
    import ahocorasick

    spark = texts.sparkSession
    listed = terms.select(F.col(f"`{term}`").alias("t")).where("t <> ''").distinct()
    passes = max(1, -(-listed.count() // per_pass))
    slim = texts.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t")).where("_t is not null")
    kind = slim.schema[0].dataType.simpleString()
    out = None
    for i in range(passes):
        part = listed if passes == 1 else listed.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == i)
        held = spark.sparkContext.broadcast([r[0] for r in part.collect()])  # per_pass terms at most

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            found = ahocorasick.Automaton()
            for x in held.value:
                found.add_word(x, x)
            if held.value:
                found.make_automaton()
            for b in batches:
                rows = []
                for k, body in zip(b.iloc[:, 0], b["_t"]):
                    counts: dict[str, int] = {}
                    for _, x in found.iter(body) if held.value else ():
                        counts[x] = counts.get(x, 0) + 1
                    rows += [(k, x, n) for x, n in counts.items()]
                yield pd.DataFrame(rows, columns=[key, "term", "n"])

        one = slim.mapInPandas(run, f"`{key}` {kind}, term string, n long")
        out = one if out is None else out.unionByName(one)
    return out


def closest_terms(names: DataFrame, terms: DataFrame, least: float = 0.8, slack: int = 4) -> DataFrame:
    """(name, term_id, term, ratio): each name's term of nearly its length with the highest block ratio over ``least``.

    Ties go to the smaller id. Only names and terms with a character in common
    meet, and only those with enough of them are compared.
    """
    listed = terms.select("term_id", "term", F.split("term", "").alias("_t"))
    own = names.select("name", F.split("name", "").alias("_n")).where("name <> ''").distinct()
    met = own.withColumn("_c", F.explode(F.array_distinct("_n"))).join(broadcast_if_small(listed.withColumn("_c", F.explode(F.array_distinct("_t")))), "_c")
    both = F.char_length("name") + F.char_length("term")
    common = F.least(F.size(F.expr("filter(_n, c -> array_contains(_t, c))")), F.size(F.expr("filter(_t, c -> array_contains(_n, c))")))
    close = met.where((F.abs(F.char_length("name") - F.char_length("term")) <= slack) & (2 * common >= least * both)).select("name", "term_id", "term").distinct()
    rated = close.withColumn("ratio", F.round(sequence_ratio("name", "term"), 6)).where(F.col("ratio") > least)
    best = rated.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("m"), "term_id", "term")).alias("b"))
    return best.select("name", "b.term_id", "b.term", (-F.col("b.m")).alias("ratio"))


def standard_names(names: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, standard): names without modifiers, as their own term, their synonym's, the closest one, or as they are.

    terms: (term_id, term); synonyms: (alias, term), the smaller term on ties.
    """
    bare = reduce(lambda c, p: F.trim(F.regexp_replace(c, p, "")), t.MODIFIERS, F.trim("name"))
    clean = names.select("name").where("name is not null").distinct().withColumn("_c", bare)
    exact = terms.select(F.col("term").alias("_c"), F.col("term").alias("_own")).where("_c is not null").distinct()
    known = synonyms.where("alias is not null").groupBy(F.col("alias").alias("_c")).agg(F.min("term").alias("_said"))
    found = clean.join(broadcast_if_small(exact), "_c", "left").join(broadcast_if_small(known), "_c", "left")
    best = closest_terms(found.where("_own is null and _said is null").select(F.col("_c").alias("name")), terms).select(F.col("name").alias("_c"), F.col("term").alias("_near"))
    return found.join(best, "_c", "left").select("name", F.coalesce("_own", "_said", "_near", "_c").alias("standard"))


def standard_triplets(triplets: DataFrame, terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Triplets with standard heads and tails, and ``original_head`` and ``original_tail`` where they were others.

    Those without three parts, of one name with itself, or with an end that
    can't be an entity's name are left out.
    """
    names = standard_names(triplets.select(F.explode(F.array("head", "tail")).alias("name")), terms, synonyms)
    out = triplets
    for end in ("head", "tail"):
        own = names.select(F.col("name").alias(end), F.col("standard").alias(f"_{end}"))
        out = out.join(own, end).withColumn(f"original_{end}", F.when(F.col(f"_{end}") != F.col(end), F.col(end))).withColumn(end, F.col(f"_{end}")).drop(f"_{end}")
    whole = (F.trim("head") != "") & (F.trim("relation") != "") & (F.trim("tail") != "") & (F.col("head") != F.col("tail"))
    return out.where(whole & t.is_valid_entity(F.col("head")) & t.is_valid_entity(F.col("tail"))).select(*triplets.columns, "original_head", "original_tail")


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def intent(text: Column) -> Column:
    """(intent, score): the intent with most keywords in the text, boosts added once; the first by priority on ties; GENERAL at 0."""
    scored = []
    for priority, (name, words) in enumerate(vocab.INTENT_KEYWORDS.items(), 1):
        boost, raising = vocab.INTENT_BOOSTS.get(name, (0, []))
        score = _hits(text, words)
        if boost:
            score = score + F.when(_hits(text, raising) > 0, boost).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-priority).alias("p"), F.lit(name).alias("intent")))
    none = F.struct(F.lit("GENERAL").alias("intent"), F.lit(0).alias("score"))
    return bound(F.array_max(F.array(*scored)), lambda b: F.when(b["score"] > 0, F.struct(b["intent"].alias("intent"), b["score"].alias("score"))).otherwise(none))


def simple_intent(text: Column) -> Column:
    """(intent, confidence) by the fewer keywords, the first of the list on ties; GENERAL at 0.3."""
    scored = [F.struct(_hits(text, words).alias("score"), F.lit(-i).alias("p"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(vocab.FALLBACK_KEYWORDS.items())]
    none = F.struct(F.lit("GENERAL").alias("intent"), F.lit(0.3).alias("confidence"))

    def sure(b: Column) -> Column:
        return F.round(F.least(0.3 + 0.15 * b["score"], F.lit(0.9)), 6)

    return bound(F.array_max(F.array(*scored)), lambda b: F.when(b["score"] > 0, F.struct(b["intent"].alias("intent"), sure(b).alias("confidence"))).otherwise(none))


def rewrite(text: Column, intent_name: Column) -> Column:
    """The query with the first of its intent's two words that it lacks, unless it compares things."""
    words = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in vocab.REWRITES.items() for x in pair])
    lacking = F.get(F.filter(F.try_element_at(words, intent_name), lambda w: ~F.contains(text, w)), F.lit(0))
    return F.when(_hits(text, vocab.COMPARISONS) > 0, text).otherwise(F.concat_ws(" ", text, lacking))


def keyword_entities(text: Column, words: list[str] = vocab.ENTITY_KEYWORDS) -> Column:
    """Keywords in the text, the longest first (in the order of ``words`` among equals), each once, at its first place that no other has taken.

    A place that is taken is blanked out at its length, so a shorter keyword
    counts only where it stands by itself.
    """
    order = sorted(dict.fromkeys(words), key=len, reverse=True)
    start = F.struct(F.array().cast("array<string>").alias("found"), text.alias("rest"))

    def step(acc: Column, w: Column) -> Column:
        at, size = F.instr(acc["rest"], w), F.char_length(w)
        blank = F.overlay(acc["rest"], F.repeat(F.lit("\x01"), size), at, size)
        met = at > 0
        return F.struct(F.when(met, F.concat(acc["found"], F.array(w))).otherwise(acc["found"]).alias("found"), F.when(met, blank).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(F.array(*map(F.lit, order)), start, step, lambda acc: acc["found"])


def top_by(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def hard_match(names: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """(name, text, score): nodes of exactly these names, as ``name（type）`` with their description, at score 1."""
    shown = F.concat(F.col("name"), F.lit("（"), F.col("type"), F.lit("）"), F.coalesce(F.concat(F.lit(": "), F.nullif("description", F.lit(""))), F.lit("")))
    return nodes.join(names.select(name).distinct(), name, "left_semi").select("name", shown.alias("text"), F.lit(1.0).alias("score"))


def inject(matched: DataFrame, hits: DataFrame) -> DataFrame:
    """(text, score, stage): matched texts not among the hits, once each, ahead of the hits."""
    fresh = matched.groupBy("text").agg(F.max("score").alias("score")).join(hits.select("text").distinct(), "text", "left_anti")
    return fresh.select("text", "score", F.lit(0).alias("stage")).unionByName(hits.select("text", "score", F.lit(1).alias("stage")))


def fuse(*rankings: DataFrame, key: str = "id", place: str = "place", k: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of rankings of (key, place)."""
    both = None
    for r in rankings:
        one = r.select(key, (1.0 / (k + F.col(place))).alias("s"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"))


def enrichment_text(name: Column, label: Column, source: Column, relation: Column) -> Column:
    return F.concat(name, F.lit(" （"), label, F.lit("） 与"), source, F.lit("存在"), relation, F.lit("关系"))


def relation_rules(spark, purpose: str) -> DataFrame:
    """(intent, rel): the relations that an intent allows for a purpose; GENERAL has none, which means all."""
    rows = [(name, rel) for name, rels in vocab.RELATIONS[purpose].items() for rel in rels]
    return spark.createDataFrame(rows, "intent string, rel string")


def plan_paths(entities: DataFrame, counts: DataFrame, spark) -> DataFrame:
    """(name, rel, direction, depth, priority) of the paths to follow for (name, intent), by ``density`` counts.

    An intent has a path for each of its relations, at 0.9 where the entity has
    the relation and at 0.6 else. GENERAL has one path by the relation that the
    entity has most: 0.8 for treatments and causes, 0.7 for symptoms, 0.5 both
    ways for any other.
    """
    rules = F.broadcast(relation_rules(spark, "paths"))  # fixed size
    asked = entities.select("name", "intent").distinct()
    have = counts.select("name", "rel").distinct().withColumn("_has", F.lit(True))
    special = asked.join(rules, "intent").join(have, ["name", "rel"], "left")
    named = special.select("name", "rel", F.lit("out").alias("direction"), F.lit(2).alias("depth"), F.when(F.col("_has"), 0.9).otherwise(0.6).alias("priority"))
    by_rel = counts.groupBy("name", "rel").agg(F.sum("n").alias("n"))
    top = by_rel.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("m"), "rel")).alias("b")).select("name", F.col("b.rel").alias("rel"))
    paths = vocab.RELATIONS["paths"]
    strong, mild = F.col("rel").isin(paths["TREATMENT"] + paths["MECHANISM"]), F.col("rel").isin(paths["SYMPTOM"])
    general = asked.where("intent = 'GENERAL'").join(top, "name").select(
        "name", "rel", F.when(strong | mild, "out").otherwise("both").alias("direction"), F.lit(2).alias("depth"), F.when(strong, 0.8).when(mild, 0.7).otherwise(0.5).alias("priority")
    )
    return named.unionByName(general)


def entities_of_hits(hits: DataFrame, key: str, text: str, named: str, words: list[str] = vocab.ENTITY_KEYWORDS) -> DataFrame:
    """(key, entity, place): the name that a hit carries, then the keywords in its text, in the order of the list, once each."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(f"`{text}`"), w))
    all_ = F.array_distinct(F.filter(F.concat(F.array(F.col(f"`{named}`")), F.coalesce(found, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    return hits.select(F.col(f"`{key}`").alias("key"), F.posexplode(all_).alias("place", "entity")).select("key", "entity", "place")


def by_index(candidates: DataFrame, scored: DataFrame, group: str, index: str = "place") -> DataFrame:
    """Candidates with the scores that a ranker gave by their index; indexes out of range are dropped."""
    return candidates.join(scored.select(group, index, "score"), [group, index])


def prompt(question: Column, examples: list[tuple[str, str]], descriptions: dict[str, str], most: int = 8) -> Column:
    """A classification prompt: what the classes are, up to ``most`` examples, the question."""
    lines = [f"{name}: {text}" for name, text in descriptions.items()] + [f"Q: {q}\nA: {a}" for q, a in examples[:most]]
    return F.concat(F.lit("\n".join(lines) + "\nQ: "), question, F.lit("\nA:"))
