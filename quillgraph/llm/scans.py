"""Repair of text from scanned pages.

Running lines and page numbers are found by what recurs at the heads and feet
of a file's pages. Broken words are joined where the corpus knows the joined
word better than the one with its mark. Misrecognised characters are found by
noisy-channel decoding: the words of a page and their likely originals form a
lattice, weighed by confusion probabilities and corpus n-gram counts, and the
best path is found by Viterbi over the words of a page, across its lines. The
probability of each confusion is estimated from the corpus, with a common prior.
Counts are exact; what is broadcast is bounded by leaving out n-grams that make
up less than a fixed share of all, at every size of the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sizing import broadcast_if_small, written
from .canonical import edits

#: Pages of a stretch; what runs near a page is looked for in its stretch and the two beside it.
NEAR = 50

#: Least share of all n-grams of the corpus that a counted one makes up; so at most 1 / RAREST are broadcast (4 M, 12 bytes each).
RAREST = 2.0**-22

#: Characters and what a recogniser takes them for.
LATIN = (("e", "c"), ("i", "!"), ("o", "0"), ("s", "5"), ("l", "1"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("g", "9"), ("b", "6"), ("z", "2"))
DIGITS = (("1", "l"), ("0", "O"), ("5", "S"), ("1", "I"), ("1", "|"), ("0", "o"), ("8", "B"), ("2", "Z"))
CJK = (
    ("项", "顶"), ("记", "汜"), ("登", "凳"), ("视", "祝"), ("料", "科"), ("离", "禽"), ("部", "郜"), ("关", "夫"), ("明", "朋"), ("访", "仿"),
    ("膜", "腊"), ("诊", "疹"), ("照", "煦"), ("据", "锯"), ("果", "杲"), ("眼", "跟"), ("标", "杆"), ("童", "章"), ("网", "岡"), ("录", "泉"),
    ("数", "敉"), ("样", "祥"), ("镜", "锐"), ("学", "字"), ("近", "迈"), ("轴", "铀"), ("变", "奕"), ("补", "朴"), ("晶", "品"), ("增", "憎"),
    ("光", "先"), ("角", "甬"), ("未", "末"), ("己", "已"), ("日", "曰"), ("土", "士"), ("大", "太"), ("人", "入"), ("干", "千"), ("天", "夭"),
    ("治", "冶"), ("体", "休"), ("析", "折"), ("晴", "睛"), ("侯", "候"), ("拔", "拨"), ("折", "拆"), ("处", "外"), ("间", "问"), ("门", "们"),
    ("病", "丙"), ("广", "厂"), ("验", "险"), ("疗", "疔"), ("术", "木"), ("球", "求"), ("症", "证"), ("清", "请"), ("没", "设"), ("提", "是"),
    ("第", "弟"), ("他", "她"), ("白", "自"), ("察", "寨"), ("综", "棕"), ("材", "村"), ("光", "尤"),
)

#: Prior probability of a confusion and its weight in occurrences, the share of a count that may be noise of a likelier
#: neighbour, and how many times as frequent an original must be.
CONFUSED, PRIOR, NOISE, LIKELIER = 0.03, 200.0, 0.08, 5.0
#: Weight of single words against pairs of words.
BACKOFF = 2.0
#: Log weight of a word with a digit or mark among its letters against any other.
MIXED = log(0.02)

_HYPHENS = "-‐‑­"
_TOKEN = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[A-Za-z0-9!|À-ɏ]+(?:[-‐‑­][A-Za-z0-9!|À-ɏ]+)*|[⺀-鿿豈-﫿]|[^\s]")
_MIXED = re.compile(r"[a-z][0-9!|]+[a-z]")
_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*\Z")
_ROMAN = re.compile(r"(?=[ivxlc]+\Z)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\Z")
_PAGE_NUMBER = re.compile(r"^\s*(?P<pre>page|p\.|第|[-–—−·•\[(（【]*)\s*(?P<n>[0-9lIOoSBZ|]{1,6}|[ivxlcIVXLC]{1,9})\s*(?:/\s*(?P<of>[0-9lIOoSBZ|]{1,6})|(?P<post>页|[-–—−·•\])）】]*))?\s*$", re.I)
_TABLE = re.compile(r"^\s*(?:\|.*\||\|?\s*:?-{3,}.*|.*\t.*\t.*)\s*$")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|[0-9]+(?:\.[0-9]+)+\s+\S.*\s[0-9lIOoSB]+\s*$|[0-9]+(?:\.[0-9]+)+\s+\S{1,40}$)")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_ENDS = re.compile(r"[。！？!?；;…，,、.：:]\s*[\"'”’」』）)\]】》]*\s*$")

_OF_DIGIT = str.maketrans({seen: true for true, seen in DIGITS})
_CJK_OF = {}
for _pair in CJK:
    _CJK_OF.setdefault(_pair[1], []).append(_pair[0])
_CJK_ALL = {c for pair in CJK for c in pair}


def page_number(line: str) -> tuple[str, int] | None:
    """(style, number) of a line that could hold a printed page number and nothing else."""
    m = _PAGE_NUMBER.match(line)
    if not m:
        return None
    text = m["n"]
    if _ROMAN.match(text.lower()) and not any(c.isdigit() for c in text) and not (m["pre"] or m["of"] or m["post"]):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        n = [value[c] for c in text.lower()]
        return "roman", sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    digits = text.translate(_OF_DIGIT)
    if not digits.isdigit():
        return None
    return f"{(m['pre'] or '').strip().lower()[:1]}#{'/' if m['of'] else (m['post'] or '')[:1]}", int(digits)


def line_key(line: str) -> str:
    """A line without digits, blanks and marks, in lower case."""
    return "".join(c for c in line.lower() if c.isalpha())


def _edges(lines: list[str]) -> list[int]:
    """Places of the lines at the head and foot of a page, fences and blank lines aside.

    Two each, and further ones for as long as they and the line outside of them are short for the page.
    """
    full = [i for i, x in enumerate(lines) if x.strip() and not _FENCE.match(x)]
    short = 0.6 * max((len(lines[i]) for i in full), default=0)
    out = {*full[:2], *full[-2:]}
    for side in (full, full[::-1]):
        for before, i in zip(side[1:], side[2:]):
            if len(lines[before]) >= short or len(lines[i]) >= short:
                break
            out.add(i)
    return sorted(out)


def _stretch() -> Column:
    """The stretch of a page in its file; pages without a number have stretches of their own, by id."""
    return F.coalesce(F.floor(F.col("page_number") / NEAR), F.lit(-10) - F.abs(F.floor(F.col("page_id") / NEAR)))


def edge_lines(pages: DataFrame) -> DataFrame:
    """(file_hash, stretch, page_id, key, style, offset) of the lines at heads and feet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, file, stretch, number, text in zip(b["page_id"], b["file_hash"], b["stretch"], b["page_number"], b["text"]):
                lines = text.split("\n")
                for i in _edges(lines):
                    found = page_number(lines[i])
                    if found and not pd.isna(number):
                        rows.append((file, stretch, page, None, found[0], int(found[1] - number)))
                    elif not _ENDS.search(lines[i]) and not _TABLE.match(lines[i]) and 3 <= len(line_key(lines[i])) <= 80:
                        rows.append((file, stretch, page, line_key(lines[i]), None, None))
            yield pd.DataFrame(rows, columns=["file_hash", "stretch", "page_id", "key", "style", "offset"]).astype({"offset": "Int64"})

    return pages.where("file_hash is not null").withColumn("stretch", _stretch()).mapInPandas(run, "file_hash string, stretch long, page_id long, key string, style string, offset long")


def running_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of files, of stretches): the running lines and how pages are numbered, (file_hash, keys, style, offset) and
    (file_hash, stretch, near_keys, runs).

    A key or a numbering (style, offset) runs near a page if at least two pages
    nearby bear it, however long the file is; for a page without a number, two
    pages of the file. Of a whole file come the keys on two of its pages and on
    one in fifty, 200 at most, and the numbering of most pages.
    """
    edges = written(edge_lines(pages))
    counts = pages.where("file_hash is not null").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"))
    borne = edges.where("key is not null").select("file_hash", "stretch", "key", "page_id").distinct()
    twice = written(borne.groupBy("file_hash", "key").agg(F.count(F.lit(1)).alias("c")).where("c >= 2"))
    keys = twice.join(counts, "file_hash").where("c * 50 >= n").groupBy("file_hash").agg(F.collect_list("key").alias("keys"))
    styles = edges.where("style is not null").groupBy("file_hash", "style", "offset").agg(F.count(F.lit(1)).alias("c"))
    top = styles.groupBy("file_hash").agg(F.max(F.struct("c", "style", "offset")).alias("t")).where("t.c >= 2").select("file_hash", F.col("t.style").alias("style"), F.col("t.offset").alias("offset"))
    beside = F.explode(F.array(*[F.col("stretch") + i for i in (-1, 0, 1)])).alias("stretch")
    near = borne.join(twice, ["file_hash", "key"], "left_semi").select("file_hash", beside, "key").groupBy("file_hash", "stretch", "key").agg(F.count(F.lit(1)).alias("c"))
    near = near.where("c >= 2 or stretch < 0").groupBy("file_hash", "stretch").agg(F.collect_list("key").alias("near_keys"))
    runs = edges.where("style is not null").select("file_hash", beside, "style", "offset", "page_id").distinct().groupBy("file_hash", "stretch", "style", "offset").agg(F.count(F.lit(1)).alias("c"))
    runs = runs.where("c >= 2").groupBy("file_hash", "stretch").agg(F.collect_list(F.struct("style", "offset")).alias("runs"))
    return keys.join(top, "file_hash", "full_outer"), near.join(runs, ["file_hash", "stretch"], "full_outer")


def kinds_of_lines(lines: list[str], number: int | None, keys: set[str], style: str | None, runs: set[tuple[str, int]]) -> list[str]:
    """The kind of each line: header, page_no, other (blank, heading, table, fence) or body.

    style: the numbering of most pages of the file, whose marks tell a number even if it is misread.
    """
    out = []
    edges = set(_edges(lines))
    numbered = False
    for i, line in enumerate(lines):
        if not line.strip() or _FENCE.match(line) or _TABLE.match(line):
            out.append("other")
            continue
        if i in edges:
            found = page_number(line)
            if found:
                right = number is not None and (found[0], found[1] - number) in runs
                if right or (found[0] == style and style not in ("#", "roman") and not numbered):
                    numbered = True
                    out.append("page_no")
                    continue
            key = line_key(line)
            if not _ENDS.search(line) and len(key) >= 3 and (key in keys or any(_alike(key, k) for k in keys)):
                out.append("header")
                continue
        alone = line.strip()
        out.append("other" if _HEADING.match(line) or _NUMBER.match(alone) else "body")
    return out


#: Comparisons already made in this process.
_ALIKE: dict[tuple[str, str], bool] = {}


def _alike(a: str, b: str) -> bool:
    if (known := _ALIKE.get((a, b))) is None:
        if len(_ALIKE) > 100_000:
            _ALIKE.clear()
        longest = max(len(a), len(b))
        known = _ALIKE[a, b] = a == b or min(len(a), len(b)) >= 3 and edits(a, b, int(0.4 * longest)) <= 0.4 * longest
    return known


def _class(token: str) -> str:
    return "#" if _NUMBER.match(token) else token


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Counts:
    """Exact counts of the n-grams that aren't too rare; 0 for the others."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.known: dict[str, int] = {}

    def __call__(self, gram: str) -> int:
        if (n := self.known.get(gram)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            key = _hash(gram)
            at = int(self.keys.searchsorted(key))
            n = self.known[gram] = int(self.n[at]) if at < len(self.keys) and self.keys[at] == key else 0
        return n


class _Cached(dict):
    """Values of a function, forgotten when there are many."""

    def __init__(self, make, most: int = 300_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _plain(raw: str) -> str:
    """The form of a token that is counted."""
    return _class(raw.lower())


def _counted(tokens: list[str]) -> list[str]:
    """Grams that are counted: words, and pairs of neighbours with a letter or a confusable character."""
    out = [t for t in tokens if len(t) > 1 or t.isalpha() or t == "#"]
    rich = [len(t) > 1 or t in _CJK_ALL or t == "#" for t in tokens]
    return out + [f"{a}\x01{b}" for a, b, x, y in zip(tokens, tokens[1:], rich, rich[1:]) if x or y]


def body_text(lines: list[str]) -> list[str]:
    """The lines that may be counted as text, words broken at line ends left apart."""
    return [x for x in lines if not (_FENCE.match(x) or _TABLE.match(x))]


def corpus_grams(pages: DataFrame) -> DataFrame:
    """(gram, n): how often each word and each pair of words stands in the pages, if it makes up RAREST of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = _Cached(_plain)
        grams: Counter[str] = Counter()
        for b in batches:
            for text in b["text"]:
                for line in body_text(text.split("\n")):
                    grams.update(_counted([plain[t] for t in _TOKEN.findall(line)]))
            if len(grams) > 200_000:
                yield pd.DataFrame(grams.items(), columns=["gram", "n"])
                grams.clear()
        yield pd.DataFrame(grams.items(), columns=["gram", "n"])

    grams = written(pages.select("text").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    return grams.where(F.col("n") >= RAREST * total)


def corpus_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams in order, and their counts; 1 / RAREST at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": [_hash(x) for x in b["gram"]], "n": b["n"]})

    found = grams.mapInPandas(run, "h long, n long").toArrow()
    keys, n = found["h"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.minimum(n[order], 2**31 - 1).astype(np.int32)


def _evidence(gram: str, n: int, counts: Counts) -> Iterator[tuple[str, str, int, int]]:
    """(true, seen, misread, read): how often a frequent gram stands as it is, and with one character confused."""
    a, _, b = gram.rpartition("\x01")
    if a and b in _CJK_ALL:
        for true, seen in CJK:
            if true == b and (m := counts(f"{a}\x01{seen}")) <= NOISE * n:
                yield true, seen, m, n
    elif not a and len(b) > 2 and b.isalpha():
        for true, seen in LATIN:
            at = b.find(true)
            while at >= 0:
                if (m := counts(b[:at] + seen + b[at + len(true) :])) <= NOISE * n:
                    yield true, seen, m, n
                at = b.find(true, at + 1)


def confusions(grams: DataFrame, table: tuple[np.ndarray, np.ndarray], least: int = 20) -> dict[tuple[str, str], float]:
    """The probability of each listed confusion, by the frequent grams and what they look like when misread."""
    shared = grams.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(*shared.value)
        sums: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            for gram, n in zip(b["gram"], b["n"]):
                for true, seen, misread, read in _evidence(gram, n, counts):
                    own = sums.setdefault((true, seen), [0, 0])
                    own[0] += misread
                    own[1] += read
        yield pd.DataFrame([(*pair, *own) for pair, own in sums.items()], columns=["true", "seen", "misread", "read"])

    found = grams.where(F.col("n") >= least).mapInPandas(run, "true string, seen string, misread long, read long").groupBy("true", "seen").agg(F.sum("misread").alias("m"), F.sum("read").alias("r"))
    seen = {(r["true"], r["seen"]): (r["m"], r["r"]) for r in found.collect()}  # a row for each listed confusion
    out = {}
    for pair in (*LATIN, *DIGITS, *CJK):
        m, r = seen.get(pair, (0, 0))
        out[pair] = (m + PRIOR * CONFUSED) / (m + r + PRIOR)
    return out


class Channel:
    """Likely originals of tokens, and decoding of token sequences."""

    def __init__(self, counts: Counts, chances: dict[tuple[str, str], float] | None = None):
        self.n = counts
        chances = chances or {}
        self.cost = {pair: log(chances.get(pair, CONFUSED)) for pair in (*LATIN, *DIGITS, *CJK)}
        self.of_digit = min(self.cost[pair] for pair in DIGITS)
        self.options = _Cached(self._originals)
        self.plain = _Cached(_plain)

    def _originals(self, raw: str) -> list[tuple[str, float]]:
        """(original, log probability of the misreading) of what the corpus knows far better than the token, misread once or twice."""
        token = raw.lower()
        if len(token) == 1 and "⺀" <= token:
            return [(true, self.cost[true, token]) for true in _CJK_OF.get(token, ())]
        if any(c in "lIOoSBZ|" for c in raw) and len(raw) <= 4 and raw.translate(_OF_DIGIT).isdigit() and not raw.isdigit():
            return [("#", self.of_digit)]
        if len(token) < 3 or not any(c.isalpha() for c in token):
            return []
        least = max(3.0, self.n(token) * LIKELIER)
        first = self._once(token)
        out = {w: c for w, c in first.items() if self.n(w) > least}
        if not out and any(not c.isalpha() and c not in _HYPHENS for c in token):
            for x, cost in first.items():
                for w, more in self._once(x).items():
                    if self.n(w) > least:
                        out[w] = max(cost + more, out.get(w, -1e9))
        return sorted(out.items())

    def _once(self, token: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for true, seen in LATIN:
            at = token.find(seen)
            while at >= 0:
                word = token[:at] + true + token[at + len(seen) :]
                out[word] = max(self.cost[true, seen], out.get(word, -1e9))
                at = token.find(seen, at + 1)
        return out

    def count(self, gram: str, rivals: list[str]) -> float:
        """A count without what is likely noise of the rivals' counts."""
        return max(0.0, self.n(gram) - NOISE * sum(self.n(r) for r in rivals))

    def _pair(self, a: str, b: str, others_a: list[str], others_b: list[str]) -> float:
        """Log likelihood of b after a, from pair counts backed off to single ones."""
        rivals = [f"{x}\x01{y}" for x in [a, *others_a] for y in [b, *others_b] if (x, y) != (a, b)]
        pair = self.count(f"{a}\x01{b}", rivals)
        single = self.count(b, others_b)
        return log(pair + BACKOFF * single / (single + 1000.0) + 1e-3)

    def decode(self, raws: list[str]) -> dict[int, str]:
        """The places of tokens that were misread and their originals, by Viterbi over runs of tokens that have candidates."""
        options = list(map(self.options.__getitem__, raws))
        out: dict[int, str] = {}
        i, end = 0, len(raws)
        for i in (k for k, o in enumerate(options) if o and not (k and options[k - 1])):
            j = i
            while j < end and options[j]:
                j += 1
            stay = [self.plain[raw] for raw in raws[max(0, i - 1) : j + 1]]
            before, run, after = (stay[0] if i else ""), stay[1 if i else 0 :][: j - i], (stay[-1] if j < end else "")
            # States of a place: the token as it stands and its originals; rivals of a state are the likelier originals.
            paths: list[tuple[float, list[str]]] = [(0.0, [before])]
            others_before: list[str] = []
            for k, own in enumerate(run):
                originals = [w for w, _ in options[i + k]]
                grown = []
                for state, cost in [(own, log(1 - CONFUSED)), *options[i + k]]:
                    others = originals if state == own else []
                    if len(state) > 1:
                        cost += log(self.count(state, others) + 0.05) + (MIXED if _MIXED.search(state) else 0.0)
                    grown.append(max((p + cost + (self._pair(path[-1], state, others_before if k and path[-1] == run[k - 1] else [], others) if path[-1] else 0.0), [*path, state]) for p, path in paths))
                paths, others_before = grown, originals
            if after:
                paths = [(p + self._pair(path[-1], after, others_before if path[-1] == run[-1] else [], []), path) for p, path in paths]
            out |= {i + k: word for k, (word, own) in enumerate(zip(max(paths)[1][1:], run)) if word != own}
        return out


def _joins(last: str, first: str, counts: Counts, channel: Channel) -> bool:
    """Whether a word broken by a mark goes on without it: the corpus knows the joined word at least as well."""
    whole, marked = last + first, f"{last}-{first}"

    def best(word: str) -> float:
        return max([counts(word), *(counts(w) for w, _ in channel.options[word])])

    return best(whole) >= best(marked) if best(whole) or best(marked) else first[:1].islower()


_BROKEN = re.compile(rf"([A-Za-z0-9!|À-ɏ]+(?:[-‐‑][A-Za-z0-9!|À-ɏ]+)*)([{_HYPHENS}])\s*$")
_GOES_ON = re.compile(r"^\s*([A-Za-z0-9!|À-ɏ]+(?:[-‐‑][A-Za-z0-9!|À-ɏ]+)*)")


def read_page(text: str, kinds: list[str], following: str | None, counts: Counts, channel: Channel) -> tuple[list[tuple[int, str]], list[str]]:
    """Marks of a page's lines, (line from 1, hyphen or misread), and its body lines put right.

    following: the first body line of the next page.
    """
    lines = text.split("\n")
    body = [i for i, k in enumerate(kinds) if k == "body"]
    raws: list[str] = []
    runs: list[tuple[int, int, int, int]] = []  # (first token, line, begin, end) of stretches of lines
    joined: dict[int, list[tuple[int, int, int]]] = {}  # (line, start, end) of the parts of tokens over two lines
    marks: set[tuple[int, str]] = set()
    carried: tuple[str, list[tuple[int, int, int]]] | None = None
    for at, i in enumerate(body):
        line = lines[i]
        begin, end = 0, len(line)
        if carried and line.strip():
            rest = _GOES_ON.match(line)
            joined[len(raws)] = [*carried[1], (i, rest.start(1), rest.end())] if rest else carried[1]
            raws.append(carried[0] + (rest.group(1) if rest else ""))
            begin = rest.end() if rest else 0
            carried = None
        broken = _BROKEN.search(line) if line.rstrip()[-1:] in _HYPHENS else None
        if broken and broken.start(1) >= begin:
            after = lines[body[at + 1]] if at + 1 < len(body) else following
            on = _GOES_ON.match(after) if after is not None else None
            if on or after is None:
                last, first = broken.group(1), on.group(1) if on else ""
                goes_on = not on or broken.group(2) == "\xad" or _joins(last.lower(), first.lower(), counts, channel)
                if goes_on:
                    marks.add((i + 1, "hyphen"))
                if at + 1 < len(body):
                    carried = (last if goes_on else f"{last}-", [(i, broken.start(1), broken.end(2))])
                if at + 1 < len(body) or goes_on:
                    end = broken.start(1)
        runs.append((len(raws), i, begin, end))
        raws += _TOKEN.findall(line, begin, end)
    fixed = channel.decode(raws)
    firsts = [r[0] for r in runs]
    repaired = {i: list(lines[i]) for i in {runs[bisect_right(firsts, k) - 1][1] for k in fixed if k not in joined} | {i for parts in joined.values() for i, _, _ in parts}}
    for k in sorted({*fixed, *joined}):
        raw, new = raws[k], fixed.get(k)
        if not (parts := joined.get(k)):
            first, i, begin, end = runs[bisect_right(firsts, k) - 1]
            match = next(m for at, m in enumerate(_TOKEN.finditer(lines[i], begin, end)) if at == k - first)
            parts = [(i, match.start(), match.end())]
        if new is None:
            if len(parts) == 1:
                continue
            shown = raw
        else:
            shown = raw.translate(_OF_DIGIT) if new == "#" else _as_written(raw, new)
            marks.add((_line_of_change(raw.lower(), new, parts, lines) + 1, "misread"))
        for at, (i, start, end) in enumerate(parts):
            repaired[i][start:end] = ["" for _ in range(end - start)]
            if at == 0:
                repaired[i][start] = shown
    return sorted(marks), ["".join(repaired.get(i, lines[i])).strip() for i in body]


def _as_written(raw: str, new: str) -> str:
    return new.upper() if raw.isupper() and len(raw) > 1 else new.capitalize() if raw[:1].isupper() else new


def _line_of_change(token: str, new: str, parts: list[tuple[int, int, int]], lines: list[str]) -> int:
    """The line in which a token in several parts differs from its original."""
    first = parts[0]
    if len(parts) == 1:
        return first[0]
    same = next((k for k, (a, b) in enumerate(zip(token, new)) if a != b), min(len(token), len(new)))
    size = len(lines[first[0]][first[1] : first[2]].rstrip().rstrip(_HYPHENS))
    return first[0] if same < size else parts[1][0]


def prepared(pages: DataFrame) -> DataFrame:
    """Distinct usable pages with the running lines of their file and the first body line of the next page."""
    slim = pages.select("page_id", "file_hash", "page_number", "text").where("page_id is not null and text is not null and text <> ''")
    # Of rows of one page that differ, the least by file, number and text counts.
    base = written(slim.groupBy("page_id").agg(F.min(F.struct("file_hash", "page_number", "text")).alias("r")).select("page_id", "r.*"))
    of_file, of_stretch = (written(x) for x in running_lines(base))
    known = base.withColumn("stretch", _stretch()).join(broadcast_if_small(of_file), "file_hash", "left").join(broadcast_if_small(of_stretch), ["file_hash", "stretch"], "left")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                lines = r.text.split("\n")
                kinds = _kinds(r, lines)
                out.append(next((x for x, k in zip(lines, kinds) if k == "body"), None))
            yield pd.DataFrame({"file_hash": b["file_hash"], "page_number": b["page_number"].astype("Int64") - 1, "following": out})

    heads = known.where("file_hash is not null and page_number is not null").mapInPandas(first, "file_hash string, page_number int, following string")
    heads = heads.where("following is not null").groupBy("file_hash", "page_number").agg(F.min("following").alias("following"))
    return known.join(heads, ["file_hash", "page_number"], "left")


def _kinds(r, lines: list[str]) -> list[str]:
    number = None if pd.isna(r.page_number) else int(r.page_number)
    keys = {k for own in (r.keys, r.near_keys) if own is not None for k in own}
    runs = set() if r.runs is None else {(x["style"], x["offset"]) for x in r.runs}
    if not pd.isna(r.offset):
        runs.add((r.style, int(r.offset)))
    return kinds_of_lines(lines, number, keys, r.style, runs)


def _over_pages(pages: DataFrame, schema: str, make) -> DataFrame:
    ready = prepared(pages)
    grams = corpus_grams(ready.select("text"))
    table = corpus_counts(grams)
    shared = pages.sparkSession.sparkContext.broadcast((table, confusions(grams, table)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counts(*shared.value[0])
        channel = Channel(n, shared.value[1])
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                kinds = _kinds(r, r.text.split("\n"))
                marks, body = read_page(r.text, kinds, r.following, n, channel)
                rows += make(r, kinds, marks, body)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return ready.mapInPandas(run, schema)


def noise_of_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind): header, page_no, hyphen and misread lines of each page.

    Pages without a text have no rows; repeated pages count once. A page of a
    null file has no running lines, one without a number no printed one.
    """

    def make(r, kinds, marks, body):
        edge = [(r.page_id, i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_no")]
        return edge + [(r.page_id, i, k) for i, k in marks]

    return _over_pages(pages, "page_id long, line_no int, kind string", make)


def repaired_pages(pages: DataFrame) -> DataFrame:
    """(page_id, file_hash, page_number, text): the body of each page as paragraphs, one to a line."""

    def make(r, kinds, marks, body):
        width = max((len(x) for x in body), default=0)
        out, held = [], ""
        for line in body:
            glue = "" if not held or ord(held[-1]) > 0x2E80 or line[:1] > "⺀" else " "
            held = held + glue + line if held else line
            if _ENDS.search(line) and len(line) < 0.85 * width:
                out.append(held)
                held = ""
        number = None if pd.isna(r.page_number) else int(r.page_number)
        return [(r.page_id, r.file_hash, number, "\n".join([*out, held] if held else out))]

    return _over_pages(pages, "page_id long, file_hash string, page_number int, text string", make)
