"""Chunking of documents: paragraphs, a similarity fold, overlaps, splits of what is too long, noise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as s
from ..functions import text as t
from ..functions.vocab import CRITICAL_TERMS, TERMS, VALID_PARTS

#: Default sizes in characters.
SHORTEST, LONGEST, ALIKE, OVERLAP = 500, 1400, 0.70, 0.12
_STOPS = "[。！？!?\n]"


def dynamic_size(text: Column, target: int = 1200, shortest: int = SHORTEST, longest: int = LONGEST, terms: list[str] = TERMS) -> Column:
    """The chunk size for a text: the target within bounds, a fifth less (but not under the least) where terms are dense."""
    base = max(shortest, min(target, longest))
    return F.when(keyword_density(text, terms) > 0.005, max(int(base * 0.8), shortest)).otherwise(base)


def keyword_density(text: Column, terms: list[str] = TERMS) -> Column:
    """Occurrences of the terms for each character."""
    hits = F.aggregate(F.array(*map(F.lit, terms)), F.lit(0), lambda n, x: n + ((F.char_length(text) - F.char_length(F.replace(text, x, F.lit("")))) / F.char_length(x)).cast("int"))
    return F.coalesce(F.try_divide(hits, F.char_length(text)), F.lit(0.0))


def fold(parts: Column, separator: str, shortest: int = SHORTEST, longest: int = LONGEST, alike: float = ALIKE, terms: list[str] = TERMS) -> Column:
    """Paragraphs folded from the left into chunks.

    The next paragraph joins the chunk if the chunk is short or resembles it,
    but never beyond ``longest``; separators don't count as length.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        grown = acc["n"] + F.char_length(p)
        joins = (grown <= longest) & ((acc["n"] < shortest) | (s.text_similarity(acc["cur"], p, terms) >= alike))
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), p.alias("cur"), F.char_length(p).alias("n")))
            .when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(separator), p).alias("cur"), grown.alias("n")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur"), F.char_length(p).alias("n")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def head_fragment(text: Column, n: Column) -> Column:
    """Of the last ``n`` characters, what ends with the first terminator; all of them if there is none."""
    tail = F.right(text, n)
    cut = F.nullif(F.regexp_extract(tail, f"(?s)^(.*?{_STOPS})", 1), F.lit(""))
    return F.when(F.char_length(text) <= n, text).otherwise(F.coalesce(cut, tail))


def lead_fragment(text: Column, n: Column) -> Column:
    """Of the first ``n`` characters, what ends with the last terminator; all of them if there is none."""
    lead = F.left(text, n)
    cut = F.nullif(F.regexp_extract(lead, f"(?s)^(.*{_STOPS})", 1), F.lit(""))
    return F.when(F.char_length(text) <= n, text).otherwise(F.coalesce(cut, lead))


def with_overlap(chunks: Column, n: Column, joint: str = "\n\n") -> Column:
    """Each chunk between a fragment of the one before and one of the one after."""

    def around(chunk: Column, i: Column) -> Column:
        before = F.when(i > 0, head_fragment(F.get(chunks, i - 1), n))
        after = F.when(i < F.size(chunks) - 1, lead_fragment(F.get(chunks, i + 1), n))
        return F.concat_ws(joint, before, chunk, after)

    return F.when(F.size(chunks) > 1, F.transform(chunks, around)).otherwise(chunks)


def merge_small(chunks: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Chunks under the least size added to the one before, with a blank, where the sum stays within the bound."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.char_length(c) < shortest) & (F.char_length(F.when(F.size(acc) > 0, last)) + F.char_length(c) <= longest)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), c)))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), lambda acc, c: step(acc, c))


def cuts_by_priority(text: str, longest: int = LONGEST, overlap: int = 0, separators: str = "。！？!?") -> list[str]:
    """Pieces of a text cut at the separator of highest priority in reach, else by length.

    The separators are tried in their order, not by place; every piece starts
    ``overlap`` characters before the last cut, so the last may be longer.
    """
    at = start = 0
    out = []
    while at < len(text) - longest:
        found = next((p for p in (text.rfind(c, at, min(at + longest, len(text))) for c in separators) if p > at), None)
        at = found + 1 if found is not None else at + longest
        out.append(text[start:at])
        start = max(at - overlap, 0)
    return [*out, text[start:]]


def split_long(df: DataFrame, key: list[str], text: str, longest: int = LONGEST, overlap: int = 0) -> DataFrame:
    """(*key, piece, text): the rows with texts over ``longest`` in pieces, the others whole; null texts give no rows.

    All rows pass through the one Python stage, so that what made them isn't
    computed once for the short ones and again for the long ones.
    """
    slim = df.select(*[F.col(f"`{k}`") for k in key], F.col(f"`{text}`").alias("text")).where("text is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [cuts_by_priority(x, longest, overlap) if len(x) > longest else [x] for x in b["text"]]
            out = b.loc[b.index.repeat([len(c) for c in cut])].drop(columns="text")
            yield out.assign(piece=[i for c in cut for i in range(len(c))], text=[x for c in cut for x in c])

    return slim.mapInPandas(run, f"{kinds}, piece int, text string")


def trim_cut_term(text: Column, terms: list[str] = CRITICAL_TERMS, valid: list[str] = VALID_PARTS) -> Column:
    """Without the beginning of a critical term that the end of the text cuts off, unless it is a word of its own."""
    out = None
    for term in terms:
        for i in range(2, len(term)):
            if term[:i] not in valid:
                test, cut = text.endswith(term[:i]), F.left(text, F.char_length(text) - i)
                out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(text)


def limit_runs(lines: Column, most: int = 2) -> Column:
    """Lines with at most ``most`` equal ones in a row."""

    def keep(x: Column, i: Column) -> Column:
        same = F.forall(F.sequence(F.lit(1), F.lit(most)), lambda k: F.coalesce(F.get(lines, i - k) == x, F.lit(False)))
        return ~((i >= most) & same)

    return F.filter(lines, keep)


def chunk_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n\n", letters: str | None = None, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(key, chunk_index, chunk_total, text): the chunks of each document.

    Texts under the least size stay whole. Chunks over the bound, overlaps
    included, are split; the rest lose a term cut off at their end; noise is
    dropped (``letters`` is the class of characters that counts against it), and
    the index is counted anew. Null and empty texts give no rows.
    """
    slim = documents.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where("_t is not null and _t <> ''")
    body = F.col("_t")
    parts = t.paragraphs(body, separator)
    overlap = (dynamic_size(body) * OVERLAP).cast("int")
    folded = F.when((F.char_length(body) < shortest) | (F.size("_p") <= 1), F.array(body)).otherwise(fold(F.col("_p"), separator, shortest, longest))
    chunks = slim.withColumn("_p", parts).withColumn("_o", overlap).withColumn("_c", folded).select("_k", F.posexplode(with_overlap(F.col("_c"), F.col("_o"))).alias("_i", "text"))
    pieces = split_long(chunks, ["_k", "_i"], "text", longest)
    fit = pieces.withColumn("text", trim_cut_term(F.col("text")))
    kept = fit.where(~t.is_noise(F.col("text"), letters=letters) if letters else ~t.is_noise(F.col("text")))
    order = W.partitionBy("_k").orderBy("_i", "piece")
    return kept.select(F.col("_k").alias(key), (F.row_number().over(order) - 1).alias("chunk_index"), F.count(F.lit(1)).over(W.partitionBy("_k")).alias("chunk_total"), "text")


def next_chain(chunks: DataFrame, key: str, index: str = "chunk_index") -> DataFrame:
    """(key, chunk_index, next_index): edges between consecutive chunks of a document."""
    follow = F.lead(index).over(W.partitionBy(key).orderBy(index))
    return chunks.select(key, index, follow.alias("next_index")).where("next_index is not null")
