"""Cut texts above a token limit into overlapping pieces at natural boundaries, content-defined.

A rolling hash over the token ids marks landmarks; from the cut before, the first landmark within the
smallest and largest size is snapped to the nearest boundary of the best kind around it: blank line, line,
sentence, word; where there is none, the piece ends at the last such boundary before its smallest size, and only where
the text has none of these since the cut before at a border between characters. Landmarks and
boundaries depend on nearby text alone, so cuts fall into step again behind an edit and only the pieces around
it change. Each piece starts ``overlap`` tokens before its cut, moved back to the start of a word, and is
encoded again, so that its own token count, not an estimate, keeps the limit.

Defined results: a null text has no pieces; an empty text and one within the limit is one piece, unchanged;
pieces without their overlap concatenate to the text; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from yakinma.llm.tokens import VOCABULARIES, encode_tree, encoding, receive, ship, token_sizes

_BLANK_LINE = re.compile(r"\n[^\S\n]*\n+")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’)\]]*+(?=\s)")
#: Radius, as a part of the largest size, in which a better kind of boundary is preferred.
RADIUS = 6
_ROLL = 8


def _blanks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Which characters are blanks, as in str.isspace, and which of them are plain ones."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = ((c >= 9) & (c <= 13)) | ((c >= 28) & (c <= 32)) | (c == 0x85) | (c == 0xA0)
    if c.size and c.max() >= 0x1680:
        out |= (c == 0x1680) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029) | (c == 0x202F) | (c == 0x205F) | (c == 0x3000)
    return out, (c == 32) | (c == 9) | (c == 10) | (c == 13)


def boundaries(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character position, kind, certain) at each token border; kind 4 blank line, 3 line, 2 sentence, 1 word, 0 none, -1
    inside a character; at a certain border a non-blank meets a plain blank, so the tokens of either side do not
    depend on the other. ``sizes`` has the bytes of each token id."""
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    if text.isascii():
        at, kind = ends, np.zeros(len(ends), dtype=np.int8)
    else:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        first = (raw & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(first)])[ends]
        kind = np.where(np.concatenate([first, [True]])[ends], 0, -1).astype(np.int8)
    level = np.zeros(len(text) + 1, dtype=np.int8)
    blank, plain = _blanks(text)
    level[1 + np.flatnonzero(~blank[:-1] & blank[1:])] = 1
    level[[m.end() for m in _SENTENCE.finditer(text)]] = 2
    level[[m.end() for m in _LINE.finditer(text)]] = 3
    level[[m.end() for m in _BLANK_LINE.finditer(text)]] = 4
    sure = np.ones(len(text) + 1, dtype=bool)
    sure[1:-1] = ~blank[:-1] & plain[1:]
    return at, np.where(kind < 0, kind, level[at]), sure[at] & (kind >= 0)


def landmarks(ids: np.ndarray, spacing: int) -> np.ndarray:
    """Token borders where the rolling hash of the ids before them marks a landmark, about one in ``spacing``."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x) + 1, dtype=np.uint64)
    for k in range(_ROLL):
        h[k + 1 :] += x[: len(x) - k] * np.uint64(pow(0x100000001B3, k + 1, 2**64))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) % np.uint64(spacing) == 0


def cuts(kind: np.ndarray, marks: np.ndarray, least: int, most: int) -> list[int]:
    """Token borders of the cuts, the ends included."""
    n, at, out = len(kind) - 1, 0, [0]
    while n - at > most:
        lo, hi = at + least, at + most
        hit = np.flatnonzero(marks[lo : hi + 1])
        mark = lo + int(hit[0]) if len(hit) else hi
        r = most // RADIUS
        a, b = max(lo, mark - r), min(hi, mark + r)
        near = kind[a : b + 1]
        best = near.max()
        if best <= 0:  # nothing around the landmark: anywhere in the allowed sizes, else the last before them, else a border of characters
            a, b, near = lo, hi, kind[lo : hi + 1]
            best = 1 if near.max() >= 1 else 0
            early = at + 1 + np.flatnonzero(kind[at + 1 : lo] >= 1)
            if best == 0 and len(early):
                at = int(early[-1])
                out.append(at)
                continue
        ok = a + np.flatnonzero(near >= best if best else near == 0)
        if not len(ok):  # one character of very many tokens cannot be cut
            ok = np.array([hi])
            while kind[ok[0]] < 0:
                ok[0] -= 1
        at = int(ok[np.argmin(np.abs(ok - mark))])
        out.append(at)
    return [*out, n]


def pieces(text: str, limit: int = 512, overlap: int = 32, least: int | None = None, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> list[tuple[int, int, int, int]]:
    """(start, cut, stop, tokens) of each piece in characters; text[start:cut] repeats the piece before."""
    ids = encode_tree(text, name, folder)
    if len(ids) <= limit:
        return [(0, 0, len(text), len(ids))]
    enc, sizes, ids = encoding(name, folder), token_sizes(name, folder), np.asarray(ids, dtype=np.int64)
    slack = max(4, overlap // 2)
    most = limit - overlap - slack
    least = min(least or most // 4, most - 1)
    if least < 1:
        raise ValueError("the limit leaves no room beside the overlap")
    at, kind, sure = boundaries(text, ids, sizes)
    todo = cuts(kind, landmarks(ids, max(1, (most - least) // 4)), least, most)

    def tokens_of(i: int, j: int) -> int:
        """Tokens of the piece between borders i and j, on its own: those of the text where both are certain borders."""
        return j - i if sure[i] and sure[j] else len(enc.encode_ordinary(text[at[i] : at[j]]))

    out, k = [], 0
    begin, end = todo[0], todo[1]
    while True:
        first = begin
        if begin and overlap:
            first = max(0, begin - overlap)
            back = [x for x in range(first, max(-1, first - slack - 1), -1) if kind[x] >= 1]
            first = back[0] if back else next(x for x in range(first, -1, -1) if kind[x] >= 0)
        count = tokens_of(first, end)
        while count > limit and first < begin:  # only where a word had to be cut: a shorter overlap, a few tokens at a time
            first = next((x for x in range(first + max(1, min(4, count - limit)), begin) if kind[x] >= 0), begin)
            count = tokens_of(first, end)
        while count > limit:  # then a shorter piece
            end = next(x for x in range(end - max(1, (end - begin) // 16), begin, -1) if kind[x] >= 0)
            count = tokens_of(first, end)
        out.append((int(at[first]), int(at[begin]), int(at[end]), count))
        if end == todo[-1]:
            return out
        begin = end
        while todo[k] <= begin:
            k += 1
        end = todo[k]


def split(df: DataFrame, text: str, id_col: str, limit: int = 512, overlap: int = 32, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, piece, start, cut, stop, n_tokens, text) of every piece. One pass, no shuffle."""
    schema = f"{id_col} bigint, piece int, start bigint, cut bigint, stop bigint, n_tokens int, text string"
    names = [id_col, "piece", "start", "cut", "stop", "n_tokens", "text"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    shared = ship(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        receive(shared, name, folder)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is not None:
                    rows += [(i, k, s, c, e, n, t[s:e]) for k, (s, c, e, n) in enumerate(pieces(t, limit, overlap, name=name, folder=folder))]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names)

    return df.select(df[id_col].cast("bigint").alias(id_col), df[text].alias("_text")).mapInArrow(run, schema)
