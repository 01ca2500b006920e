"""Cutting of oversized texts into overlapping chunks at natural boundaries.

A text is read as a tree: sections nested by the depth of their headings, and
in them blocks (paragraphs, tables, code fences, lists whose items nest by
indentation), lines and sentences. Siblings are merged while they fit into a
chunk, a node is opened only if it is over the limit itself, and what comes
out of an opened node is merged with nothing outside of it, its heading aside,
which goes with what it heads. A sentence over the limit has no boundary inside
and is cut by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1400, 200

#: Marks that end a sentence, and closing characters that stay with them.
MARKS, CLOSERS = "。！？!?；;…", "\"'”’」』）)]】》"

_CLOSE = f"[{re.escape(CLOSERS)}]*"
_SENTENCE = re.compile(rf"[{MARKS}]{_CLOSE}|\.{_CLOSE}(?=\s|\Z)|\n")
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_HASHES = re.compile(r" {0,3}(#{1,6})\s")
_TAG = re.compile(r"\s*<h([1-6])[ >]", re.I)
_CHAPTER = re.compile(r"\s*第[0-9一二三四五六七八九十百]+([编章节篇])")
_DECIMAL = re.compile(r"\s*[0-9]+((?:\.[0-9]+)+)\.?\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|[0-9]{1,3}[.)、]|[(（][0-9一二三四五六七八九十]{1,3}[)）])\s*\S")
#: Depth of the two divisions of books; headings of unnumbered markup lie by their own numbers.
_BOOK = {"编": 1, "篇": 1, "章": 1, "节": 2}
#: Places for a cut where no boundary is in reach, best first.
_SOFT = (re.compile(r"[，、,：:]|——"), re.compile(r"\s+"))


def boundaries(text: str) -> list[int]:
    """Offsets of all boundaries, 0 and the end included."""
    return sorted({0, len(text), *(m.end() for m in _SENTENCE.finditer(text))})


@dataclass(slots=True)
class Node:
    """A stretch of the text; without children it is a line, which opens into sentences."""

    start: int
    end: int
    kind: str
    depth: int = 0
    children: list[Node] = field(default_factory=list)


def heading_depth(line: str) -> int:
    """Depth of a heading line, 1 the highest; 0 for any other line."""
    if m := _HASHES.match(line):
        return len(m[1])
    if m := _TAG.match(line):
        return int(m[1])
    if len(line) <= 80 and (m := _CHAPTER.match(line)):
        return _BOOK[m[1]]
    if len(line) <= 80 and (m := _DECIMAL.match(line)):
        return 1 + m[1].count(".")
    return 0


def structure(text: str) -> Node:
    """The tree of a text. Every node but a line ends after a line feed or with the text, so all its ends are boundaries."""
    root = Node(0, len(text), "section")
    sections = [root]
    block: Node | None = None  # the open paragraph, table, fence or list
    items: list[Node] = []  # the open items of a list, outermost first
    fence, start = "", 0
    for line in _LINE.findall(text):
        end = start + len(line)
        leaf = Node(start, end, "line")
        mark = _FENCE.match(line)
        if fence or mark:
            if not fence:
                fence, block = mark[1], Node(start, end, "fence")
                sections[-1].children.append(block)
            elif mark and mark[1] == fence:
                fence = ""
            block.children.append(leaf)
            block.end = end
            if not fence:
                block = None
        elif not line.strip():
            # Blank lines end a block and stay with it; before any they are a block of their own.
            last = sections[-1].children[-1:] or [sections[-1]]
            if last[0].kind in ("section", "heading"):
                sections[-1].children.append(Node(start, end, "blank"))
            else:
                last[0].children.append(leaf)
                last[0].end = end
            block = None
        elif depth := heading_depth(line):
            while len(sections) > 1 and sections[-1].depth >= depth:
                sections.pop()
            section = Node(start, end, "section", depth, [Node(start, end, "heading")])
            sections[-1].children.append(section)
            sections.append(section)
            block = None
        else:
            item = _ITEM.match(line)
            kind = "table" if line.lstrip().startswith("|") else "list" if item else "paragraph"
            if block is None or block.kind != kind and not (block.kind == "list" and line[0] in " \t"):
                block, items = Node(start, end, kind), []
                sections[-1].children.append(block)
            block.end = end
            if block.kind == "list":
                indent = len(line) - len(line.lstrip())
                if item:
                    while items and items[-1].depth >= indent:
                        items.pop()
                    own = Node(start, end, "item", indent, [leaf])
                    (items[-1] if items else block).children.append(own)
                    items.append(own)
                else:
                    items[-1].children.append(leaf)
                for above in items:
                    above.end = end
            else:
                block.children.append(leaf)
        for section in sections[1:]:
            section.end = end
        start = end
    return root


@dataclass(slots=True)
class Pack:
    """A piece of the text to be; ``stretch`` is the length of the sentence that it was cut off in, 0 at a boundary."""

    start: int
    end: int
    stretch: int = 0
    heading: bool = False


class _Packer:
    def __init__(self, text: str, limit: int, overlap: int, marks: list[int]):
        self.text, self.limit, self.overlap, self.marks = text, limit, overlap, marks
        self.out: list[Pack] = []

    def fits(self, start: int, end: int) -> bool:
        """Whether a chunk with its overlap can hold this."""
        return end - start <= self.limit - min(self.overlap, start)

    def children(self, node: Node) -> list[Node]:
        if node.children:
            return node.children
        if node.kind == "sentence":
            return []
        from bisect import bisect_left, bisect_right

        inner = self.marks[bisect_right(self.marks, node.start) : bisect_left(self.marks, node.end)]
        return [Node(a, b, "sentence") for a, b in zip([node.start, *inner], [*inner, node.end])]

    def add(self, node: Node) -> None:
        """Lays the children of an oversized node: whole ones merged with the siblings before, oversized ones opened."""
        floor = len(self.out)
        for child in self.children(node):
            if self.fits(child.start, child.end):
                last = self.out[-1] if self.out else None
                # Out of the node itself, only headings are taken along.
                near = last and (len(self.out) > floor or last.heading)
                if near and not last.stretch and self.fits(last.start, child.end):
                    last.heading &= child.kind == "heading"
                    last.end = child.end
                else:
                    self.out.append(Pack(child.start, child.end, 0, child.kind == "heading"))
            elif child.kind == "sentence":
                self.by_length(child)
            else:
                self.add(child)
                floor = len(self.out)

    def by_length(self, node: Node) -> None:
        """A sentence over the limit; its last piece, which ends at a boundary, is a sibling of the next sentence."""
        start, stretch = node.start, node.end - node.start
        while not self.fits(start, node.end):
            room = self.limit - min(self.overlap, start)
            cut = start + room
            for soft in _SOFT:
                if places := [m.end() for m in soft.finditer(self.text, cut - room // 4, cut)]:
                    cut = places[-1]
                    break
            self.out.append(Pack(start, cut, stretch))
            start = cut
        self.out.append(Pack(start, node.end))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, stretch) of the chunks of a text.

    A chunk starts ``overlap`` before the last one's end (at 0 if there is less
    before it). stretch is 0 if the chunk ends at a boundary; else no boundary
    was in reach, and it is the length of the boundary-free stretch that the
    end lies in. A text up to the limit is one chunk.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    packer = _Packer(text, limit, overlap, boundaries(text))
    packer.add(structure(text))
    return [(max(0, p.start - overlap) if k else p.start, p.end, p.stretch) for k, p in enumerate(packer.out)]


def split_oversized(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, chunk_index, start, end, at_boundary, stretch[, chunk]) of items longer than ``limit``.

    Lengths are in code points. stretch is 0 where the chunk ends at a boundary,
    else the length of the boundary-free stretch that it was cut in. Null and empty
    texts and texts up to the limit give no rows; blanks count as characters. Repeated rows of an
    item give its chunks again; drop duplicates of the key beforehand or after.
    One pass without a shuffle: short items are filtered out before Python sees
    them.
    """
    slim = items.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")).where(F.char_length("_text") > limit)
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch.iloc[:, 0], batch["_text"]):
                for i, (s, e, stretch) in enumerate(split_text(body, limit, overlap)):
                    rows.append((k, i, s, e, stretch == 0, stretch, *[body[s:e]] * with_text))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start", "end", "at_boundary", "stretch", *["chunk"] * with_text])

    return slim.mapInPandas(run, f"`{key}` {kind}, chunk_index int, start int, end int, at_boundary boolean, stretch int" + ", chunk string" * with_text)
