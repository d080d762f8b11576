"""Byte-pair encoding from a public rank file (problem 8), without the tokenizer libraries.

A text is split by the vocabulary's pattern; each piece is a doubly linked list of byte symbols whose adjacent pairs
wait in a priority queue by merge rank.  A popped pair that no longer stands there is stale and skipped.  A piece of n
bytes takes O(n log n), so one very long run of a single character does no harm.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabulary files lie, and how many pieces a worker remembers (a matter of speed only).
FOLDER, KEEP = "/opt/tokenizers", 400_000


class Bpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
        ranks = self.ranks
        queue = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue  # stale: one of its sides has grown since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                far = after[end]
                r = ranks.get(piece[i:far])
                if r is not None:
                    heapq.heappush(queue, (r, i, far))
            p = before[i]
            if p >= 0:
                r = ranks.get(piece[p:end])
                if r is not None:
                    heapq.heappush(queue, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for the empty text and for null."""
        if not text:
            return []
        kept, out = self.kept, []
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(kept) >= KEEP:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", errors="replace")


_made: dict[str, Bpe] = {}


def encoder(path: str) -> Bpe:
    """The worker's encoder for a file, made once."""
    if path not in _made:
        _made[path] = Bpe(path)
    return _made[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a rank file; the folder is a parameter, or LEAFMILL_TOKENIZERS, or FOLDER."""
    return f"{folder or os.environ.get('LEAFMILL_TOKENIZERS', FOLDER)}/{name}.tiktoken"


def encode_column(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, whole texts. Null and empty texts have the empty list."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(off[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, size BIGINT): the number of ids of every row."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "size"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, size long")
