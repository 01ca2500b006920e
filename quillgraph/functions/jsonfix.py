"""Tolerant reading of JSON that a model wrote.

What the built-in parser takes goes no further. The rest is read by a small
tokenizer (strings in either kind of quotes, bare words, brackets, comments) and
a reader that keeps its open brackets on a stack, so every text is read once
from left to right, whatever is missing or wrong in it. Both need memory of
what came before, so they run in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLET = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>"
ENTITY = "struct<name:string,type:string,other:map<string,string>>"

#: Keys under which models put an entity's name and type, the first that is there counts.
NAME_KEYS = ("name", "entity", "text", "value", "label")
TYPE_KEYS = ("type", "category", "class", "entity_type")
TRIPLET_KEYS = ("head", "relation", "tail")

_BLANK = re.compile(r"(?:[\s\x00-\x1f\x7f-\x9f﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_BARE = re.compile(r"[^\s{}\[\],:\"'\x00-\x1f]+")
_FENCED = re.compile(r"```[a-zA-Z0-9]*\s*\n?(.*?)```", re.S)
_WORDS = {"true": True, "false": False, "null": None, "None": None, "True": True, "False": False, "undefined": None}
_CLOSES = {"{": "}", "[": "]"}


def _string(text: str, at: int) -> tuple[str, int]:
    """The string whose opening quote is at ``at``, and the place after it.

    A quote inside that isn't followed by what may follow a string (a comma,
    colon, closing bracket or the end) belongs to the string.
    """
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            pair = text[i : i + (6 if text[i + 1] == "u" else 2)]
            try:
                out.append(json.loads(f'"{pair}"'))
            except ValueError:
                out.append(pair[1:2])
                pair = pair[:2]
            i += len(pair)
        elif c == quote and (not (rest := text[i + 1 : i + 64].lstrip()) or rest[0] in ",:}]/"):
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), i


def _tokens(text: str) -> Iterator[tuple[str, object]]:
    """(kind, value): the bracket, comma or colon itself, or ``value`` with what it is."""
    at = 0
    while at < len(text):
        if blank := _BLANK.match(text, at):
            at = blank.end()
        elif text[at] in "{}[],:":
            yield text[at], None
            at += 1
        elif text[at] in "\"'":
            value, at = _string(text, at)
            yield "value", value
        else:
            word = _BARE.match(text, at)
            raw = word.group() if word else text[at]
            at += len(raw)
            try:
                yield "value", _WORDS[raw] if raw in _WORDS else json.loads(raw)
            except ValueError:
                yield "value", raw


class _Open:
    """A bracket that isn't closed yet, with what it holds so far."""

    def __init__(self, bracket: str):
        self.bracket, self.items, self.key, self.has_key = bracket, {} if bracket == "{" else [], None, False

    def put(self, value: object) -> None:
        if self.bracket == "[":
            self.items.append(value)
        elif self.has_key:
            self.items[self.key], self.has_key = value, False
        elif isinstance(value, (dict, list)):
            self.items.setdefault("", value)
        else:
            self.key = value if isinstance(value, str) else json.dumps(value)


def lenient(text: str) -> object:
    """The first value of a text that is meant as JSON; a ValueError if there is none.

    Missing brackets are closed at the end; one that closes an outer bracket
    closes those inside too, one that closes nothing is passed over. Keys and
    words may be bare, commas too many or missing.
    """
    stack: list[_Open] = []
    for kind, value in _tokens(text):
        if kind in _CLOSES:
            stack.append(_Open(kind))
        elif kind in ("}", "]"):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if _CLOSES[stack[i].bracket] == kind), None)
            while depth is not None and len(stack) > depth:
                done = stack.pop().items
                if not stack:
                    return done
                stack[-1].put(done)
        elif kind == ":":
            if stack and stack[-1].bracket == "{" and stack[-1].key is not None:
                stack[-1].has_key = True
        elif kind == "value":
            if not stack:
                return value
            stack[-1].put(value)
        elif stack:
            stack[-1].key, stack[-1].has_key = None, False
    if not stack:
        raise ValueError("no value")
    while len(stack) > 1:
        done = stack.pop().items
        stack[-1].put(done)
    return stack[0].items


def balanced(text: str | None) -> str | None:
    """The first outermost object, else array, whose brackets are all closed; strings inside brackets respected."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    i, text = 0, text or ""
    while i < len(text):
        c = text[i]
        if c == '"' and stack:
            i += 1
            while i < len(text) and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
        elif c in _CLOSES:
            stack.append((c, i))
        elif c in "}]":
            depth = next((k for k in range(len(stack) - 1, -1, -1) if _CLOSES[stack[k][0]] == c), None)
            if depth is not None:
                found.append((stack[depth][1], i + 1))
                del stack[depth:]
        i += 1
    outer = [(s, e) for s, e in sorted(found, key=lambda x: (x[0], -x[1]))]
    for bracket in "{[":
        for s, e in outer:
            if text[s] == bracket:
                return text[s:e]
    return None


def read(text: str | None) -> object:
    """What a text says as JSON: as it stands, else in its first fenced block, else repaired, else its first balanced part. None if nothing."""
    if not text or not text.strip():
        return None
    fenced = _FENCED.search(text)
    for part in (text, fenced and fenced[1]):
        if part:
            try:
                return json.loads(part)
            except ValueError:
                pass
    for part in (fenced and fenced[1], text, balanced(text)):
        if part and part.lstrip()[:1] in ("{", "[", "/"):
            try:
                if isinstance(found := lenient(part), (dict, list)):
                    return found
            except ValueError:
                pass
    return None


def _entity(item: dict) -> tuple[str | None, str | None, dict[str, str]]:
    shown = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in item.items()}
    if any(k in item for k in TRIPLET_KEYS):
        return None, None, shown
    name, kind = next((shown[k] for k in NAME_KEYS if k in shown), ""), next((shown[k] for k in TYPE_KEYS if k in shown), "unknown")
    return name, kind, {k: v for k, v in shown.items() if k not in NAME_KEYS and k not in TYPE_KEYS}


def entities_of(text: str | None) -> list[tuple[str | None, str | None, dict[str, str]]]:
    """(name, type, other fields) of a list of entities, of an object's ``entities``, of a single one, or of each line.

    Lines count each for itself if nothing can be read from the text, or if each
    of several is a whole object or has no bracket.
    """
    lines = list(filter(None, map(str.strip, (text or "").split("\n"))))
    by_line = len(lines) > 1 and all(balanced(x) == x if set("{[") & set(x) else set("}]`").isdisjoint(x) for x in lines)
    found = None if by_line else read(text)
    if isinstance(found, dict):
        found = found["entities"] if isinstance(found.get("entities"), list) else [found]
    if not isinstance(found, list):
        found = []
        for line in lines:
            own = read(line)
            found.append(own if isinstance(own, dict) else line)
    return [_entity(x) if isinstance(x, dict) else (x, "unknown", {}) for x in found if isinstance(x, (dict, str))]


def _repaired(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            found = read(x)
            return None if found is None else json.dumps(found, ensure_ascii=False)
        except RecursionError:  # nested deeper than anything that is meant
            return None

    return text.map(one)


def _entities(text: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "type": k, "other": o} for n, k, o in entities_of(x)] if isinstance(x, str) else None for x in text], dtype=object)


def repair(text: Column) -> Column:
    """A JSON text of what a text says, however it is written; null if it says nothing."""
    return F.pandas_udf(_repaired, "string")(text)


def safe_parse(text: Column) -> Column:
    """A text as VARIANT: as it stands, else repaired, else null. Only texts that need it are repaired."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(repair(F.when(F.try_parse_json(text).isNull(), text))))


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): the first fenced or balanced object, else array, in each text."""
    slim = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t"))

    def one(x: str | None) -> str | None:
        fenced = _FENCED.search(x) if x else None
        return (balanced(fenced[1]) if fenced else None) or balanced(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b.iloc[:, 0], "found": [one(x) for x in b["_t"]]})

    return slim.mapInPandas(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, found string")


def entities(text: Column) -> Column:
    """(name, type, other) of the entities that a model wrote, as JSON of any form or one a line; null for null."""
    return F.pandas_udf(_entities, f"array<{ENTITY}>")(text)


def triplets(text: Column) -> Column:
    """Triplets from the first ``[`` to the last ``]``; null if that is no array."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    good = F.from_json(body, f"array<{TRIPLET}>")
    return F.coalesce(good, F.from_json(repair(F.when(good.isNull(), body)), f"array<{TRIPLET}>"))


def has_keys(text: Column, keys: list[str]) -> Column:
    """Whether a text is a JSON object with all the keys."""
    found = F.json_object_keys(text)
    return F.coalesce(F.size(F.array_intersect(found, F.array(*map(F.lit, keys)))) == len(keys), F.lit(False))


#: What ``has_fields`` calls the kinds of values, and how their schemas are written.
KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "bool": "BOOLEAN", "list": "ARRAY.*", "object": "OBJECT.*"}


def has_fields(text: Column, kinds: dict[str, str]) -> Column:
    """Whether a text is a JSON object that has each key with a value of its kind, one of KINDS."""
    parsed = F.try_parse_json(text)
    good = [F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")).rlike(f"^(?:{KINDS[kind]})$") for key, kind in kinds.items()]
    out = F.lit(True)
    for one in good:
        out = out & F.coalesce(one, F.lit(False))
    return has_keys(text, list(kinds)) & out
