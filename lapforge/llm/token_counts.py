"""Token counts of whole texts without token ids.

The merges of a tokenizer never cross its pre-tokens, so a text has as many tokens as its
pre-tokens have. Every block of texts keeps its distinct pre-tokens and how often each text
holds them; the merges run once for each distinct pre-token of the whole table; the counts are
joined back to the frequencies and summed. No id is ever written.

Normalising, pre-tokenizing and merging are the library's own (``tokenizers``); its special strings
are cut out of a text first, as it does by default, and count as one token each. Before that a
text is cut at ASCII white space, so that a repeated chunk is pre-tokenized once a block. That is
right where the tokenizer drops white space, which is checked when it is loaded; other tokenizers
raise a ValueError, as do added tokens with settings of their own (stripping, single words, normalised).

Edge cases: a null or empty text has 0 bytes and 0 tokens; bytes that are no UTF-8 count as
U+FFFD; rows of equal id or text stay apart; ids may be null and of any type; an empty table gives an
empty result; columns of the input that are not kept play no part, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .wordhash import utf8_parts

CACHED = 1 << 18  # chunks whose pre-tokens a worker remembers from block to block
JOINED = 512  # chunks that are pre-tokenized in one call
MARK = "\0"  # ahead of a special string; no pre-token of a byte-level tokenizer holds it


class _Ids(dict):
    """Numbers of keys in order of their first sight."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


class PreTokens:
    """The pre-tokens of chunks, by the library; one for each worker and tokenizer."""

    held: dict[str, PreTokens] = {}

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        added = json.loads(source).get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        parts = ["a", "b1", "'s", "é"]
        for white in " \t\n\r\v\f":
            if any([p for p, _ in self._pre(white.join(parts) + end)] != [p for part in parts for p, _ in self._pre(part)] for end in ("", white)):
                raise ValueError("the tokenizer does not drop white space")
        self.cache: dict[bytes, list[str]] = {}

    @classmethod
    def of(cls, source: str) -> PreTokens:
        if source not in cls.held:
            cls.held = {source: cls(source)}
        return cls.held[source]

    def _pre(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer else [(text, (0, len(text)))] * bool(text)

    def _whole(self, chunk: str) -> list[str]:
        pieces = self.special.split(chunk) if self.special else [chunk]
        return [p for i, piece in enumerate(pieces) for p in ([MARK + piece] if i % 2 else [x for x, _ in self._pre(piece)] if piece else [])]

    def _many(self, chunks: list[str]) -> list[list[str]]:
        """The pre-tokens of chunks that hold neither white space nor special strings."""
        t = self.tokenizer
        text = " ".join(chunks)
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spaces = np.flatnonzero(codes == 32)
        if len(spaces) != len(chunks) - 1 or not t.pre_tokenizer:
            return [self._whole(c) for c in chunks]
        out: list[list[str]] = [[] for _ in chunks]
        found = t.pre_tokenizer.pre_tokenize_str(text)
        for (piece, _), at in zip(found, np.searchsorted(spaces, [start for _, (start, _) in found]).tolist()):
            out[at].append(piece)
        return out

    def __call__(self, chunks: list[bytes]) -> list[list[str]]:
        """The pre-tokens of every chunk."""
        new = {c: c.decode("utf-8", "replace") for c in chunks if c not in self.cache}
        plain = [c for c, s in new.items() if s.split() == [s] and not (self.special and self.special.search(s))]
        known = dict(zip(plain, chain.from_iterable(self._many([new[c] for c in plain[i : i + JOINED]]) for i in range(0, len(plain), JOINED))))
        known |= {c: self._whole(s) for c, s in new.items() if c not in known}
        out = [known[c] if c in known else self.cache[c] for c in chunks]
        if len(self.cache) > CACHED:
            self.cache.clear()
        self.cache |= known
        return out

    def count(self, piece: str) -> int:
        return 1 if piece.startswith(MARK) else len(self.tokenizer.model.tokenize(piece))


def _splitter(source: str) -> blocks.Split:
    def split(column: pa.Array):
        pre = PreTokens.of(source)
        data, offsets = utf8_parts(column)
        raw, chunk_ids, row_chunks = data.tobytes(), _Ids(), []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            row_chunks.append(np.fromiter(map(chunk_ids.__getitem__, raw[a:b].split()), np.int64))
        rows = np.repeat(np.arange(len(row_chunks)), [len(c) for c in row_chunks])
        size, chunk, n = blocks.postings(rows, np.concatenate([*row_chunks, np.zeros(0, np.int64)]), np.ones(len(rows)), len(row_chunks), len(chunk_ids))
        pieces = pre(list(chunk_ids))
        ids, of_chunk = _Ids(), np.array([len(p) for p in pieces], np.int64)
        piece = np.fromiter(map(ids.__getitem__, chain.from_iterable(pieces)), np.int64)
        first, each = np.cumsum(of_chunk) - of_chunk, of_chunk[chunk]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        row, at, n = np.repeat(np.repeat(np.arange(len(row_chunks)), size), each), piece[np.repeat(first[chunk], each) + nth], np.repeat(n, each)
        often = np.argsort(-np.bincount(at, minlength=len(ids)), kind="stable")  # frequent pieces first, which packs better
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        return pa.array(list(ids), pa.string()).take(pa.array(often)), *blocks.postings(row, place[at], n, len(row_chunks), len(ids)), []

    return split


def piece_frequencies(df: DataFrame, source: str, text: Column, keep: list[Column]) -> DataFrame:
    """Staged blocks of the pre-token frequencies of every text by the tokenizer whose JSON is ``source``."""
    return blocks.factor(df, text, keep, _splitter(source), T.StringType(), label="piece-blocks")


def piece_counts(frequencies: DataFrame, source: str) -> DataFrame:
    """The number of tokens of every pre-token of every block, merged once for each distinct pre-token."""
    return blocks.counted_back(frequencies, lambda pieces: list(map(PreTokens.of(source).count, pieces)))


def load(path: str) -> str:
    """The JSON of a tokenizer file (a few megabytes, whatever the table), which is sent to the workers."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    PreTokens(source)  # raises here rather than in a task
    return source


def count_tokens(df: DataFrame, source: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 2048) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    frequencies = piece_frequencies(df, source, F.col(text_col), [*[F.col(c) for c in keep], n_bytes])
    out = blocks.sums(frequencies, piece_counts(frequencies, source), [*[df.schema[c] for c in keep], T.StructField("n_bytes", T.LongType())], ["n_tokens"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
