"""Encoding of texts with a public byte-pair vocabulary.

A piece of text is encoded without running its merges: the longest tokens that
start at each byte are found by an Aho-Corasick automaton, and tokens are laid
from left to right, each only if it is compatible with the one before (the
merges of the two tokens' bytes give just these two tokens). Where no
compatible token fits, the encoder goes back to the next shorter token. A
sequence whose neighbours are all compatible is the one that the merges give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of a text, as the vocabulary's own pattern cuts it. Fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids a worker remembers, and longest piece (in bytes) that is remembered.
REMEMBERED, REMEMBERED_BYTES = 150_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@cache
def read_ranks(path: str) -> bytes:
    return Path(path).read_bytes()


class ByteEncoder:
    """Encoder and decoder for one file of ranks (a token in base64 and its id a line)."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ids: dict[bytes, int] = {base64.b64decode(token): int(i) for token, i in pairs}
        # Bytes are matched as the characters of the same number.
        self.matcher = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self.matcher.make_automaton()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.token: dict[int, bytes] = {i: token for token, i in self.ids.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.cut = regex.compile(PATTERN)
        # Offset table for decoding: token i is blob[offset[i]:offset[i + 1]].
        sizes = np.zeros(max(self.token) + 2, np.int64)
        for i, token in self.token.items():
            sizes[i + 1] = len(token)
        self.offset = np.cumsum(sizes)
        self.blob = b"".join(self.token.get(i, b"") for i in range(len(sizes) - 1))

    def merged(self, data: bytes) -> list[int]:
        """Ids by the merges themselves; used on the bytes of token pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Entry of the pair-compatibility table, computed when first asked for."""
        if (known := self.compatible.get((left, right))) is None:
            known = self.compatible[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        n = len(data)
        # starts[i]: tokens from byte i, the shortest first, as the automaton's matches end in ascending order.
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.matcher.iter(data.decode("latin-1")):
            starts[end - match[1] + 1].append(match)
        out: list[int] = []
        tried: list[int] = []  # index into starts of the token last laid, by place in out
        dead = bytearray(n + 1)  # byte offsets from which no compatible rest was found
        at, k, fits, pairs = 0, len(starts[0]) - 1, self.fits, self.compatible
        while at < n:
            options = starts[at]
            while k >= 0:
                i, size = options[k]
                if not dead[at + size]:
                    if not out:
                        break
                    good = pairs.get((out[-1], i))
                    if good if good is not None else fits(out[-1], i):
                        break
                k -= 1
            if k >= 0:
                out.append(i)
                tried.append(k)
                at += size
                k = len(starts[at]) - 1 if at < n else -1
            else:
                # Whether a rest can follow depends on the token before only through this pair, so the offset is given up.
                dead[at] = 1
                k = tried.pop() - 1
                at -= len(self.token[out.pop()])
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one. Special tokens in a text are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.cut.findall(text):
            if (ids := known.get(piece)) is None:
                data = piece.encode("utf-8", "replace")
                ids = self.piece(data)
                if len(data) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids, by the offset table."""
        offset, blob = self.offset, self.blob
        return b"".join(blob[offset[i] : offset[i + 1]] for i in ids).decode("utf-8", "replace")


def _kept_encoder(ranks: bytes) -> ByteEncoder:
    """The encoder of these ranks, made once in each worker process.

    It is kept with an imported module, as functions sent to workers bring new
    globals with every task.
    """
    kept = ahocorasick.__dict__.setdefault("_encoders", {})
    if (encoder := kept.get(ranks)) is None:
        kept.clear()
        encoder = kept[ranks] = ByteEncoder(ranks)
    return encoder


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids, *keep): the token ids of each row's text, in one pass without a shuffle.

    A null or empty text has an empty list, a blank one the ids of its blanks;
    special tokens written in a text are ordinary characters. Rows stay as many
    as they are; other columns are dropped unless named in ``keep``. The
    vocabulary, of fixed size, is broadcast.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path or vocabulary_path()))
    names = [key, text, *[c for c in keep if c not in (key, text)]]
    slim = df.select(*[F.col(f"`{c}`") for c in names])
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _kept_encoder(ranks.value)
        for batch in batches:
            done = batch.drop(columns=[c for c in (text,) if c not in (key, *keep)])
            done.insert(1, "ids", [encoder.encode(x) for x in batch[text]])
            yield done

    out = [f"`{key}` {kinds[key]}", "`ids` array<int>", *[f"`{c}` {kinds[c]}" for c in keep if c != key]]
    return slim.mapInPandas(run, ", ".join(out))


def count_tokens(df: DataFrame, key: str, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, tokens): the number of token ids of each row's text."""
    coded = encode_column(df, key, text, path, keep)
    return coded.select(key, *[c for c in keep if c != key], F.size("ids").cast("long").alias("tokens"))
