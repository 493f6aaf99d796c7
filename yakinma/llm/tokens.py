"""Encode texts with a public byte-level BPE vocabulary by a monoid tree reduction.

A text is halved until its pieces are small, the pieces are encoded, and neighbours are joined by encoding
a window around the seam again. The window grows until both of its ends lie at a change from a non-blank to a
blank character with something left outside. The vocabulary's splitting pattern never lets a piece that holds
a non-blank continue over such a change and looks ahead one character only, so the split before and behind the
window is the same with and without the neighbour: the outside tokens are final. If no such place
exists, the window is the whole text. Decoding concatenates bytes up the same tree.

Defined results: null and empty texts have the empty list of ids; strings that look like control tokens are
ordinary text; repeated rows give repeated results; extra columns do not matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Folder of the vocabulary files; a parameter everywhere.
VOCABULARIES = "/opt/tokenizers"
#: The splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks as the splitting pattern's \s has them; a place (?<=non-blank)(?=blank) is a certain border.
_BORDER = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])")


_shipped: dict[tuple[str, str], bytes] = {}


def ship(spark: SparkSession, name: str, folder: str) -> Broadcast:
    """The vocabulary file, read where the query is planned and sent along: workers need no folder. Its size is fixed."""
    return spark.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def receive(shared: Broadcast, name: str, folder: str) -> None:
    if (name, folder) not in _shipped:
        _shipped[name, folder] = shared.value


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """The vocabulary of ``folder/name.tiktoken``, loaded once in each Python worker."""
    import tiktoken

    lines = (_shipped.get((name, folder)) or Path(folder, f"{name}.tiktoken").read_bytes()).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> list[bytes]:
    enc = encoding(name, folder)
    return [enc.decode_single_token_bytes(i) if i in _known(name, folder) else b"" for i in range(enc.max_token_value + 1)]


@lru_cache(maxsize=4)
def token_sizes(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(name, folder)], dtype=np.int64)


@lru_cache(maxsize=4)
def _known(name: str, folder: str) -> frozenset[int]:
    return frozenset(encoding(name, folder)._mergeable_ranks.values())


def _drop_bytes(ids: list[int], n: int, sizes: list[bytes], last: bool) -> list[int] | None:
    """``ids`` without the last (or first) tokens that make up ``n`` bytes; null where the cut is inside a token."""
    k = 0
    step = reversed(ids) if last else iter(ids)
    while n > 0:
        n -= len(sizes[next(step)])
        k += 1
    if n:
        return None
    return ids[: len(ids) - k] if last else ids[k:]


def encode_tree(text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = 512, window: int = 64) -> list[int]:
    enc = encoding(name, folder)
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    sizes = token_bytes(name, folder)

    def join(a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:m] and text[m:b]."""
        w, p, q = window, a, b
        while True:  # the last border before the seam, a few characters away from it
            lo = max(a, m - w)
            at = [x.start() for x in _BORDER.finditer(text, lo, max(lo, m - 4))]
            if at or lo == a:
                p = at[-1] if at else a
                break
            w *= 2
        w = window
        while True:  # the first border behind it
            hi = min(b, m + w)
            x = _BORDER.search(text, min(m + 1, hi), hi)
            if x or hi == b:
                q = x.start() if x else b
                break
            w *= 2
        size = lambda s: len(s.encode())
        head, tail = _drop_bytes(left, size(text[p:m]), sizes, True), _drop_bytes(right, size(text[m:q]), sizes, False)
        if head is None or tail is None:  # no certain border after all: the whole text is the window
            return enc.encode_ordinary(text[a:b])
        return head + enc.encode_ordinary(text[p:q]) + tail

    def build(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return enc.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return join(a, m, b, build(a, m), build(m, b))

    return build(0, len(text))


def decode_tree(ids: list[int], name: str = "byte_bpe_50k", folder: str = VOCABULARIES, leaf: int = 4096) -> str:
    """The text of ``ids``: bytes are concatenated up the tree and decoded at its root."""
    sizes = token_bytes(name, folder)

    def build(a: int, b: int) -> bytes:
        if b - a <= leaf:
            return b"".join(sizes[i] for i in ids[a:b])
        m = (a + b) // 2
        return build(a, m) + build(m, b)

    return build(0, len(ids)).decode("utf-8", "replace")


def encode(df: DataFrame, text: str, id_col: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, as_name: str = "ids") -> DataFrame:
    """(id_col, ids) for every row. One pass, no shuffle."""

    shared = ship(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(shared, name, folder)
        for b in batches:
            lists = [encode_tree(t, name, folder) if t else [] for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, as_name])

    return df.select(df[id_col].cast("bigint").alias(id_col), df[text].alias("_text")).mapInArrow(run, f"{id_col} bigint, {as_name} array<int>")


def count_tokens(df: DataFrame, text: str, id_col: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id_col, n_tokens) for every row."""

    shared = ship(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(shared, name, folder)
        for b in batches:
            sizes = [len(encode_tree(t, name, folder)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [id_col, "n_tokens"])

    return df.select(df[id_col].cast("bigint").alias(id_col), df[text].alias("_text")).mapInArrow(run, f"{id_col} bigint, n_tokens bigint")


def decode(df: DataFrame, ids: str, id_col: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id_col, text) of every row of lists of ids; null and empty lists give the empty text."""
    shared = ship(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(shared, name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_tree(x, name, folder) if x else "" for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(df[id_col].cast("bigint").alias(id_col), df[ids].alias("_ids")).mapInArrow(run, f"{id_col} bigint, text string")
