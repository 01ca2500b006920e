"""Mapping of freely typed values to the entries of a reference list.

A multi-pattern automaton over the accepted names finds mentions inside a
value; the longest of them that don't overlap win. Values without a mention go
to token-set similarity (characters and pairs of characters): the entry most
alike wins, if it is alike enough and an edit distance confirms it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the reference list that one pass holds in memory; longer lists take several passes.
ENTRIES_PER_PASS = 20_000

#: Least token-set similarity, most edits a character of the longer of the two names (ASCII names: near codes are other
#: codes, so only long ones may differ), shortest embedded name.
LEAST_SIMILARITY, MOST_EDITS, MOST_ASCII_EDITS, SHORTEST = 0.55, 0.4, 0.15, 4

#: A mention counts if it makes up this share of the value's letters and numerals.
LEAST_SHARE = 0.5


def plain(value: str | None) -> str:
    """Letters and numerals alone, in compatibility form and without case."""
    folded = unicodedata.normalize("NFKC", value or "").casefold()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            least = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, before[j - 2] + 1)
            row.append(least)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def tokens(name: str) -> frozenset[str]:
    return frozenset(name) | {name[i : i + 2] for i in range(len(name) - 1)}


class Matcher:
    """Finds the entry that a value means. entries: (term_id, names)."""

    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.names: dict[str, int] = {}
        for term, names in entries:
            for name in map(plain, names):
                if name:
                    self.names[name] = min(term, self.names.get(name, term))
        self.automaton = ahocorasick.Automaton()
        for name, term in self.names.items():
            self.automaton.add_word(name, (name, term))
        if self.names:
            self.automaton.make_automaton()
        self.fuzzy = [(name, term, tokens(name)) for name, term in self.names.items()]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, (_, _, parts) in enumerate(self.fuzzy):
            for part in parts:
                self.by_token[part].append(i)
        self.known: dict[str | None, tuple[int, float, int, int] | None] = {}

    def mention(self, text: str) -> tuple[int, float, int, int] | None:
        """(0, minus its length, its start, term) of the best of the longest mentions that don't overlap."""
        if not self.names:
            return None
        found = []
        for end, (name, term) in self.automaton.iter(text):
            start = end - len(name) + 1
            whole = len(name) == len(text)
            if name.isascii():
                sides = text[start - 1 : start] + text[end + 1 : end + 2]
                if any(c.isascii() for c in sides) or len(name) < 3 and not whole:
                    continue
            elif len(name) < SHORTEST and not whole:
                continue
            found.append((-len(name), start, end, term))
        taken: list[tuple[int, int, int, int]] = []
        for size, start, end, term in sorted(found):
            if all(end < s or start > e for _, s, e, _ in taken):
                taken.append((size, start, end, term))
        if not taken or -taken[0][0] < LEAST_SHARE * len(text):
            return None
        return 0, float(taken[0][0]), taken[0][1], taken[0][3]

    def similar(self, text: str) -> tuple[int, float, int, int] | None:
        """(1, minus the similarity, 0, term) of the entry most alike by its set of tokens, if it is alike enough.

        An entry that is shares one of the text's rarest tokens; so many of the
        commonest that even all of them wouldn't do aren't looked up.
        """
        own = sorted(tokens(text), key=lambda part: (len(self.by_token.get(part, ())), part))
        n = len(own)
        needed = max(1, ceil(n * LEAST_SIMILARITY / (2 - LEAST_SIMILARITY) - 1e-9))
        best = None
        for i in {i for part in own[: n - needed + 1] for i in self.by_token.get(part, ())}:
            name, term, parts = self.fuzzy[i]
            alike = 2 * sum(part in parts for part in own) / (n + len(parts))
            if alike >= LEAST_SIMILARITY and (best is None or (-alike, term) < best[:2]):
                best = (-alike, term, name)
        if best is None:
            return None
        name = best[2]
        most = int((MOST_ASCII_EDITS if name.isascii() else MOST_EDITS) * max(len(name), len(text)))
        return (1, best[0], 0, best[1]) if edits(text, name, most) <= most else None

    def match(self, value: str | None) -> tuple[int, float, int, int] | None:
        """Rank (less is better) and term of the entry that a value means; None if it means none."""
        if value not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            text = plain(value)
            self.known[value] = (self.mention(text) or self.similar(text)) if text else None
        return self.known[value]


def map_to_entries(values: DataFrame, entries: DataFrame, key: str = "id", name: str = "name", term: str = "term_id", main: str = "term", aliases: str = "aliases", per_pass: int = ENTRIES_PER_PASS) -> DataFrame:
    """(key, term): one row for each key with the term that its name means, or 0 for none.

    A null, empty or blank name means none. Repeated rows count once; if a key
    bears several names, the best match wins, then the smallest term. Entries
    with null names or aliases are used as far as they go; an empty list maps
    everything to 0. Values are read once for each ``per_pass`` entries, in
    place; only the best match by key is shuffled. Matches rank alike in one pass
    and in several: mentions by length, place and term, then the most alike.
    """
    spark = values.sparkSession
    slim = values.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{name}`").alias("_n")).where("_k is not null")
    kind = slim.schema[0].dataType.simpleString()
    listed = entries.where(F.col(f"`{term}`").isNotNull()).select(
        F.col(f"`{term}`").cast("long").alias("t"), F.filter(F.concat(F.array(F.col(f"`{main}`")), F.coalesce(F.col(f"`{aliases}`"), F.array().cast("array<string>"))), lambda x: x.isNotNull()).alias("names")
    )
    passes = max(1, -(-listed.count() // per_pass))
    results = []
    for i in range(passes):
        part = listed if passes == 1 else listed.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == i)
        held = spark.sparkContext.broadcast([(r["t"], list(r["names"])) for r in part.collect()])  # bounded by per_pass

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value)
            for batch in batches:
                found = [matcher.match(x) or (9, 0.0, 0, 0) for x in batch["_n"]]
                yield pd.DataFrame({"_k": batch["_k"], "how": [f[0] for f in found], "less": [f[1] for f in found], "start": [f[2] for f in found], "t": [f[3] for f in found]})

        results.append(slim.mapInPandas(run, f"_k {kind}, how int, less double, start int, t long"))
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    best = found.groupBy("_k").agg(F.min(F.struct("how", "less", "start", "t")).alias("best"))
    return best.select(F.col("_k").alias(key), F.col("best.t").cast("int").alias(term))
