"""Exact byte-pair encoding of a corpus by a backtracking encoder, and decoding.

The vocabulary is a public rank file (base64 token, rank), whose path is a
parameter. Nothing is trained.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits a text before the merges of these vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers, and the longest piece it does so for.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48
#: Texts longer than this are split lazily rather than into one list of pieces.
LAZY_LENGTH = 1 << 20


class _Known(dict):
    """Ids of pieces met before; forgets all when full, so its memory is bounded."""

    def __init__(self, encoder: "BacktrackingEncoder") -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.encode_piece(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BacktrackingEncoder:
    """Byte-pair encoding in linear time.

    A sequence of tokens is what the merges give exactly if each neighbouring
    pair is: so tokens are laid down greedily, longest match first, each checked
    against its left neighbour; on failure the next shorter prefix is tried, then
    the last token is taken back. Positions from which no way leads on are
    remembered, so none is tried twice.
    """

    def __init__(self, ranks: bytes) -> None:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in ranks.splitlines() if line))
        self.tokens = [t for _, t in pairs]
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must be 0, 1, 2, ... without a hole")
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        self.shorter = [next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1) for s in self.ids]
        self.left, self.right = list(range(len(pairs))), list(range(len(pairs)))
        self.merged: dict[tuple[int, int], int] = {}
        for s, i in self.ids.items():
            self._find_split(s, i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._pattern = regex.compile(PATTERN)
        self._known = _Known(self)

    def _find_split(self, s: str, i: int) -> None:
        """The last merge that makes token ``i``; a single byte has none."""
        for k in range(len(s) - 1, 0, -1):
            a, b = self.ids.get(s[:k], -1), self.ids.get(s[k:], -1)
            if 0 <= a < i and 0 <= b < i and self.compatible(a, b):
                self.merged[a, b] = i
                self.left[i], self.right[i] = a, b
                return
        if len(s) > 1:
            raise ValueError(f"token {i} is the result of no merge")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        The merges are undone around the boundary, latest first; if at any point a
        pair across it would have merged before the merges undone so far, it would
        not have stayed.
        """
        bound = len(self.tokens) + 1
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < bound:
                return False
            # undo the later of the two merges that touch the boundary
            if a > b:
                bound, inner = a, self.right[a]
                if inner != a:
                    a = inner
                    continue
                bound, inner = b + 1, self.left[b]
                if inner == b:
                    return True
                b = inner
            else:
                bound, inner = b + 1, self.left[b]
                if inner != b:
                    b = inner
                    continue
                bound, inner = a, self.right[a]
                if inner == a:
                    return True
                a = inner

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of text (the merges never cross pieces)."""
        s = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return (whole,)
        longest = [-1] * len(s)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, i in self.automaton.iter(s):  # later matches at an end are shorter, so lengths decide
            at = end - length[i] + 1
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, token = 0, longest[0]
        while at < len(s):
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(s) else -1
            else:
                dead[at] = 1
                back = out.pop()
                at -= length[back]
                token = shorter[back]
        return tuple(out)

    def encode(self, text: str, into: array) -> None:
        """Appends the ids of a text."""
        pieces = self._pattern.findall(text) if len(text) <= LAZY_LENGTH else (m[0] for m in self._pattern.finditer(text))
        into.extend(chain.from_iterable(map(self._known.__getitem__, pieces)))


class OffsetDecoder:
    """Bytes of id sequences by one table of all tokens and their offsets."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        first = np.cumsum(size) - size
        return self.table[np.arange(int(size.sum())) + np.repeat(start - first, size)].tobytes()


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> BacktrackingEncoder:
    return BacktrackingEncoder(ranks)


@lru_cache(maxsize=2)
def _decoder(ranks: bytes) -> OffsetDecoder:
    return OffsetDecoder(_encoder(ranks).tokens)


def _ranks(df: DataFrame, vocabulary: str):
    """The rank file, read by the driver and sent once to each executor (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of every text, without special tokens.

    One row for every row of ``df``, in no order; a null and an empty text give
    the empty list. Texts are taken as they stand, whole, however long. Strings
    that spell special tokens are ordinary text. Repeated and null keys pass
    through. Nothing is shuffled.
    """
    sent = _ranks(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            flat, ends = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                if t:
                    encoder.encode(t, flat)
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text: str, *, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids of every text; 0 for a null or empty one."""
    sent = _ranks(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(0)):
                t = t.as_py()
                if t:
                    flat = array("i")
                    encoder.encode(t, flat)
                    sizes[i] = len(flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes)], names=[*keep, "n_tokens"])

    schema = StructType([*df.select(*keep).schema.fields, StructField("n_tokens", LongType())])
    return df.select(text, *keep).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of every id list; the empty list and null give the empty text.

    Bytes that are no UTF-8 (possible only for ids that no text encodes to)
    become U+FFFD. Ids outside the vocabulary are an error.
    """
    sent = _ranks(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(sent.value)
        for batch in batches:
            texts = [decoder.decode(np.asarray(x.as_py() or (), np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
