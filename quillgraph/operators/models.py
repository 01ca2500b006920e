"""Hooks for models, with deterministic stand-ins that need none.

A hook is any object with the method of its protocol that can be pickled. Calls
are made in Arrow batches inside ``mapInPandas``, retried with growing pauses;
what fails for good becomes an error column, never a silent default.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Extractor(Protocol):
    def extract(self, text: str) -> str: ...


class Classifier(Protocol):
    def classify(self, text: str) -> str: ...


class Ocr(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class TooLarge(Exception):
    """Raised by an embedder for a request over its limit."""


class HashEmbedder:
    """Counts of hashed character pairs, at length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for i in range(len(text)):
                v[zlib.crc32(text[i : i + 2].encode("utf-8", "replace")) % self.size] += 1
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return out


class OverlapReranker:
    """Share of the query's characters that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        own = set(query)
        return [len(own & set(x)) / max(1, len(own)) for x in texts]


class PatternExtractor:
    """Triplets of ``A<relation>B`` in each sentence, as a model would write them."""

    def __init__(self, relations: tuple[str, ...] = ("导致", "引起", "治疗", "预防")):
        self.cut = re.compile(rf"([^\W\d_]{{2,12}}?)({'|'.join(relations)})([^\W\d_]{{2,12}})")

    def extract(self, text: str) -> str:
        found = [{"head": a, "head_type": "", "relation": r, "tail": b, "tail_type": ""} for a, r, b in self.cut.findall(text or "")]
        return json.dumps(found, ensure_ascii=False)


#: What a classifier calls the intents.
INTENT_NAMES = {"治疗防控": "TREATMENT", "发病机制": "MECHANISM", "症状表现": "SYMPTOM", "诊断检查": "DIAGNOSIS", "预防保健": "PREVENTION", "并发症": "COMPLICATION", "风险因素": "RISK_FACTOR", "综合查询": "GENERAL"}


class NameClassifier:
    """The first intent whose name begins with two characters of the text, as a model would write it; nothing if there is none."""

    def classify(self, text: str) -> str:
        name = next((x for x in INTENT_NAMES if x[:2] in text), None)
        return json.dumps({"intent": name, "confidence": 0.8, "reasoning": name[:2]}, ensure_ascii=False) if name else ""


class PlainOcr:
    """Pages of text files, separated by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


def retried(call: Callable, tries: int = 3, pause: float = 0.5, growth: float = 2.0, told: Callable | None = None) -> Callable:
    """``call`` with repeated attempts; the last error is raised. A request that is too large isn't repeated."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except TooLarge:
                raise
            except Exception as error:
                if i + 1 == tries:
                    raise
                if told:
                    told(i, error)
                time.sleep(pause * growth**i)

    return run


def embed_fitting(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of texts; a batch too large is halved, a text too large too, and its halves' vectors averaged."""
    try:
        return embedder.embed(texts)
    except TooLarge:
        if len(texts) > 1:
            half = len(texts) // 2
            return embed_fitting(embedder, texts[:half]) + embed_fitting(embedder, texts[half:])
        text = texts[0]
        if len(text) < 2:
            raise
        half = len(text) // 2
        return [np.mean(embed_fitting(embedder, [text[:half]]) + embed_fitting(embedder, [text[half:]]), axis=0).tolist()]


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 32, tries: int = 3) -> DataFrame:
    """(key, embedding, error): vectors of the texts; null texts have neither, failed ones the error."""
    slim = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(lambda texts: embed_fitting(embedder, texts), tries)
        for b in batches:
            vectors: list = [None] * len(b)
            errors: list = [None] * len(b)
            full = [i for i, x in enumerate(b["_t"]) if isinstance(x, str)]
            for s in range(0, len(full), batch):
                part = full[s : s + batch]
                try:
                    for i, v in zip(part, call([b["_t"].iloc[i] for i in part])):
                        vectors[i] = v
                except Exception as error:
                    for i in part:
                        errors[i] = f"{type(error).__name__}: {error}"[:200]
            yield pd.DataFrame({key: b.iloc[:, 0], "embedding": vectors, "error": errors})

    return slim.mapInPandas(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, embedding array<float>, error string")


def rerank(hits: DataFrame, reranker: Reranker, n: int, query: str = "query", text: str = "text", place: str = "place") -> DataFrame:
    """The best ``n`` hits of each query by the reranker, with ``score``; a query whose scoring fails keeps its first n at null.

    The hits of a query are few (a top-k), so each query is one group.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place, kind="stable")
        try:
            rows = rows.assign(score=reranker.score(rows[query].iloc[0], rows[text].tolist()))
            return rows.sort_values(["score", place], ascending=[False, True], kind="stable").head(n)
        except Exception:
            return rows.assign(score=None).head(n)

    return hits.groupBy(query).applyInPandas(run, f"{fields}, score double")


def extract(df: DataFrame, key: str, text: str, extractor: Extractor, tries: int = 3) -> DataFrame:
    """(key, said, error): what the extractor says of each text, to be read by ``jsonfix.triplets``."""
    slim = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(extractor.extract, tries)
        for b in batches:
            said, errors = [], []
            for x in b["_t"]:
                try:
                    said.append(None if x is None else call(x))
                    errors.append(None)
                except Exception as error:
                    said.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:200])
            yield pd.DataFrame({key: b.iloc[:, 0], "said": said, "error": errors})

    return slim.mapInPandas(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, said string, error string")


def classify(df: DataFrame, key: str, text: str, classifier: Classifier | None, tries: int = 3) -> DataFrame:
    """(key, intent, confidence, reasoning, by_model, error): the classifier's intent of each text; by keywords where it fails.

    It fails if it raises or says no JSON object; an unknown intent is GENERAL,
    a missing confidence 0.5. Null texts have no intent.
    """
    from .retrieval import simple_intent

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(classifier.classify, tries) if classifier else None
        for b in batches:
            rows = []
            for x in b["_t"]:
                row = (None, None, None, None)
                try:
                    said = re.search(r"(?s)\{.*\}", call(x) or "") if call and x is not None else None
                    if said:
                        found = json.loads(said.group())
                        row = (INTENT_NAMES.get(found.get("intent", "综合查询"), "GENERAL"), float(found.get("confidence", 0.5)), str(found.get("reasoning", "")), None)
                except Exception as error:
                    row = (None, None, None, f"{type(error).__name__}: {error}"[:200])
                rows.append(row)
            out = pd.DataFrame(rows, columns=["intent", "confidence", "reasoning", "error"])
            yield pd.concat([b.reset_index(drop=True), out], axis=1)

    said = slim.mapInPandas(run, f"`{key}` {kind}, _t string, intent string, confidence double, reasoning string, error string")
    plain = F.when(F.col("_t").isNotNull(), simple_intent(F.col("_t")))
    both = said.withColumn("_p", plain)
    return both.select(f"`{key}`", F.coalesce("intent", "_p.intent").alias("intent"), F.coalesce("confidence", "_p.confidence").alias("confidence"), "reasoning", F.col("intent").isNotNull().alias("by_model"), "error")


def low_relevance(nodes: DataFrame, reranker: Reranker, query: str = "医学实体", least: float = 0.15, batch: int = 50) -> DataFrame:
    """(name, score, reason, error): names that a reranker finds of less than ``least`` relevance, a report that deletes nothing.

    Names are scored ``batch`` at a time; those of a batch that fails have the error and no score.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = b["name"].tolist()
            rows = []
            for s in range(0, len(names), batch):
                part = names[s : s + batch]
                try:
                    scores = [0.0 if x is None else float(x) for x in reranker.score(query, part)]
                    rows += [(n, x, f"Low Semantic Score ({x:.4f})", None) for n, x in zip(part, scores, strict=True) if x < least]
                except Exception as error:
                    rows += [(n, None, None, f"{type(error).__name__}: {error}"[:200]) for n in part]
            yield pd.DataFrame(rows, columns=["name", "score", "reason", "error"])

    return nodes.select("name").where("name <> ''").distinct().mapInPandas(run, "name string, score double, reason string, error string")


def read_scans(files: DataFrame, ocr: Ocr, key: str = "path", content: str = "content") -> DataFrame:
    """(key, text, n_pages): the pages of each file in order, joined by blank lines."""
    slim = files.select(F.col(f"`{key}`"), F.col(f"`{content}`").alias("_c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = [ocr.pages(bytes(x)) for x in b["_c"]]
            yield pd.DataFrame({key: b.iloc[:, 0], "text": ["\n\n".join(p) for p in pages], "n_pages": [len(p) for p in pages]})

    return slim.mapInPandas(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, text string, n_pages int")


def ask(spark, question: str, generate: Callable[[str, str], str], tables: dict[str, DataFrame], most: int = 50) -> list[str]:
    """Rows that answer a question, each joined by `` | ``, distinct, ``most`` at most.

    ``generate`` writes SQL from the question and the tables' columns; they are
    registered as views for it. Only a single SELECT is run.
    """
    from ..functions.text import strip_fences

    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    columns = "; ".join(f"{name}({', '.join(df.columns)})" for name, df in tables.items())
    said = generate(question, columns)
    sql = spark.createDataFrame([(said,)], "s string").select(strip_fences(F.col("s"))).first()[0].rstrip("; \n")
    if not re.match(r"(?is)^\s*(select|with)\b", sql) or ";" in sql:
        raise ValueError("only one SELECT is run")
    found = spark.sql(sql)
    shown = F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in found.columns])
    return [r[0] for r in found.select(shown.alias("row")).distinct().orderBy("row").limit(most).collect()]
