"""Percentiles of numeric columns per group from mergeable dyadic Count-sketches.

Values are encoded, in order, as integers of 25 bits (11 of the exponent, so any finite value has its place, and 14 of
the mantissa). Each binary resolution of the code has a signed Count-sketch of 3 x 256 counters; the resolutions of at
most 65 536 nodes share one exact counter per node of the finest of them, of which a group has those its values fall
in. Sketches are linear: those of separate partitions or days are merged by adding counters, and a row of weight -1
takes a value out again. A rank is inverted by descending the resolutions from the root.

A group of few values is kept as what its counters would be made of, one row for each code with its count, since
counters would be many times its data. Such rows are as linear as counters: both are added up, and where a
group has counters or more than ``SPARSE`` codes, its codes are expanded to counters and added to the rest.

Stated error: a percentile of a group of at most ``SPARSE`` codes has the exact rank and is 1/16384 of its value off
at most. Of a larger group it is never farther from the true value than the width of its exact node, 1/32 of
the value (plus 0.001), around a rank that is off by less than 2 % of the group in all but a share of 10^-4 of the
ranks asked (``p6_rank_error`` counts those beyond both).

Map tasks keep a bounded table of codes and emit it when full, rows are summed by (group, counter), so
a hot group is spread over its counters; the task that reads its percentiles meets its counters and, of each map task
that saw few of its values, at most ``SPARSE`` codes. Defined results: only finite values of at least zero count; a
group without any has no row; null keys are a group; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, MANTISSA, EXACT_BITS = 25, 14, 16
DEPTH, WIDTH = 3, 256
LEVELS = BITS - EXACT_BITS
EXACT = 1 << EXACT_BITS
CELLS = EXACT + LEVELS * DEPTH * WIDTH
#: Codes up to which a group is kept as codes; cells from CELLS on are codes.
SPARSE = 320
CELL_BITS = (CELLS + (1 << BITS)).bit_length()
OFFSET = 2.0**-10
_ZERO = int(np.float64(OFFSET).view(np.int64))
_SHIFT = 52 - MANTISSA
#: Codes a map task holds before it emits them.
TABLE = 1_000_000


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of finite values of at least zero, in their order."""
    bits = (np.asarray(values, dtype=np.float64) + OFFSET).view(np.int64)
    return (bits - _ZERO) >> _SHIFT


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of a code's values; exactly 0 for code 0."""
    codes = np.asarray(codes, dtype=np.int64)
    mid = ((codes << _SHIFT) + _ZERO + (1 << (_SHIFT - 1))).view(np.float64) - OFFSET
    return np.where(codes == 0, 0.0, mid)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(counter, sign) of nodes of a sketched level."""
    h = _mix(nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 64 + row + 1))
    bucket = (h & np.uint64(WIDTH - 1)).astype(np.int64)
    sign = 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return EXACT + (level * DEPTH + row) * WIDTH + bucket, sign


def counters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 1 + LEVELS * DEPTH) counters and signs of codes."""
    cell = [codes >> LEVELS]
    sign = [np.ones(len(codes), dtype=np.int64)]
    for level in range(LEVELS):
        for row in range(DEPTH):
            c, s = _place(codes >> level, level, row)
            cell.append(c)
            sign.append(s)
    return np.stack(cell, 1), np.stack(sign, 1)


def expand(group: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group * CELLS + cell, value) of the counters of codes, summed and sorted."""
    cell, sign = counters(code)
    key = (group.astype(np.int64)[:, None] * CELLS + cell).ravel()
    return _summed(key, (sign * value[:, None]).ravel())


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(value, at)


def invert(group: np.ndarray, cell: np.ndarray, value: np.ndarray, n_groups: int, probabilities: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(n, quantiles[groups, probabilities]) of sketches whose cells are sorted by (group, cell). Quantiles are
    linear between the two closest ranks."""
    group = group.astype(np.int64)
    leaf = cell >= CELLS
    dense = np.zeros(n_groups, dtype=bool)
    dense[group[~leaf]] = True
    dense |= np.bincount(group[leaf], minlength=n_groups) > SPARSE
    n, q = np.zeros(n_groups, dtype=np.int64), np.zeros((n_groups, len(probabilities)))
    thin = leaf & ~dense[group]
    if thin.any():
        n_thin, q_thin = _invert_codes(group[thin], cell[thin] - CELLS, value[thin], n_groups, probabilities)
        n, q = np.where(dense, n, n_thin), np.where(dense[:, None], q, q_thin)
    if dense.any():
        some = leaf & dense[group]
        key, total = expand(group[some], cell[some] - CELLS, value[some])
        key, total = _summed(np.concatenate([key, (group * CELLS + cell)[~leaf]]), np.concatenate([total, value[~leaf]]))
        n_dense, q_dense = _invert_counters(key // CELLS, key % CELLS, total, n_groups, probabilities)
        n, q = np.where(dense, n_dense, n), np.where(dense[:, None], q_dense, q)
    return n, q


def _ranks(n: np.ndarray, probabilities: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact place, lower rank, the two ranks of each) of the probabilities in groups of n values."""
    at = np.asarray(probabilities)[None, :] * np.maximum(n - 1, 0)[:, None]
    low = np.floor(at).astype(np.int64)
    return at, low, np.stack([low, np.minimum(low + 1, np.maximum(n - 1, 0)[:, None])], 2).reshape(len(n), -1)


def _between(codes: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    found = decode(codes).reshape(*at.shape, 2)
    lo, hi = found[..., 0], np.maximum(found[..., 0], found[..., 1])
    return lo + (hi - lo) * (at - low)


def _invert_codes(group: np.ndarray, code: np.ndarray, value: np.ndarray, n_groups: int, probabilities: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Exact ranks of groups kept as codes."""
    upto = np.cumsum(value)
    n = np.bincount(group, weights=value, minlength=n_groups).astype(np.int64)
    base = np.cumsum(n) - n
    at, low, rank = _ranks(n, probabilities)
    k = np.minimum(np.searchsorted(upto, (base[:, None] + rank).ravel(), side="right"), len(upto) - 1)
    return n, _between(code[k], at, low)


def _invert_counters(group: np.ndarray, cell: np.ndarray, value: np.ndarray, n_groups: int, probabilities: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from counters: all ranks of all groups descend the resolutions together."""
    key = group * CELLS + cell
    top = cell < EXACT
    t_group, t_cell, t_value = group[top], cell[top].astype(np.int64), value[top]
    upto = np.cumsum(t_value)
    n = np.bincount(t_group, weights=t_value, minlength=n_groups).astype(np.int64)
    base = np.cumsum(n) - n
    at, low, rank = _ranks(n, probabilities)
    who = np.repeat(np.arange(n_groups), rank.shape[1])
    k = np.minimum(np.searchsorted(upto, base[who] + rank.ravel(), side="right"), max(0, len(upto) - 1))
    node, here = t_cell[k], t_value[k]
    left_over = base[who] + rank.ravel() - (upto[k] - here)
    for level in reversed(range(LEVELS)):
        seen = []
        for row in range(DEPTH):
            c, sign = _place(2 * node, level, row)
            want = who * CELLS + c
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            seen.append(np.where(key[i] == want, value[i] * sign, 0))
        left = np.clip(np.median(np.stack(seen), axis=0).astype(np.int64), 0, here)
        right = left_over >= left
        node = 2 * node + right
        left_over = np.where(right, left_over - left, left_over)
        here = np.where(right, here - left, left)
    return n, _between(node, at, low)


def sketch(df: DataFrame, keys: Sequence[str], measures: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, measure, cell, value): the summed counters of each group and measure."""
    keys, measures = list(keys), list(measures)
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("measure", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("value", T.LongType())])
    nk, names = len(keys), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, types = 0, None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

        def rows(which: np.ndarray, cell: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            known = list(groups)
            names_of = [pa.array([g[i] for g in known], types[i] if i < nk else pa.string()) for i in range(nk + 1)]
            for a in range(0, len(cell), 200_000):
                g, c, v = which[a : a + 200_000], cell[a : a + 200_000], value[a : a + 200_000]
                g, c, v = g[v != 0], c[v != 0], v[v != 0]
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(g)) for x in names_of], pa.array(c, pa.int32()), pa.array(v, pa.int64())], names)

        def out(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            g, code = key >> BITS, key & ((1 << BITS) - 1)
            many = np.bincount(g, minlength=len(groups))[g] > SPARSE
            yield from rows(g[~many], code[~many] + CELLS, value[~many])
            g, code, value = g[many], code[many], value[many]
            starts = np.searchsorted(g, np.unique(g))
            for a in range(0, len(starts), 64):  # a few groups at a time: a code has 28 counters
                s, e = starts[a], starts[a + 64] if a + 64 < len(starts) else len(g)
                cells, total = expand(g[s:e], code[s:e], value[s:e])
                yield from rows(cells // CELLS, cells % CELLS, total)

        for b in batches:
            types = [c.type for c in b.columns[:nk]]
            who = list(zip(*(c.to_pylist() for c in b.columns[:nk]), strict=True)) if nk else [()] * b.num_rows
            times = b.column(nk + len(measures)).to_numpy(zero_copy_only=False)
            for m, name in enumerate(measures):
                v = b.column(nk + m).to_numpy(zero_copy_only=False)
                ok = np.flatnonzero(np.isfinite(v) & (v >= 0) & (times != 0))
                if not len(ok):
                    continue
                g = np.fromiter((groups.setdefault((*who[i], name), len(groups)) for i in ok), np.int64, len(ok))
                held.append(((g << BITS) | encode(v[ok]), times[ok]))
                size += len(ok)
            if size > TABLE:
                held = [merged()]
                size = len(held[0][0])
                if size > TABLE // 2:
                    yield from out(*held[0])
                    held, size = [], 0
                    groups.clear()
        if held:
            yield from out(*merged())

    times = F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")) if weight else F.lit(1).cast("long")
    cols = [*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.col(m).cast("double"), F.lit(-1.0)).alias(f"m{i}") for i, m in enumerate(measures)], times.alias("times")]
    parts = df.select(*cols).mapInArrow(run, schema)
    return _add(parts, names[: nk + 1]).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _add(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by, "cell").agg(F.sum("value").alias("value")).where("value <> 0")


def merge(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One sketch table of several, regrouped by ``keys`` (a subset of theirs)."""
    all_cells = sketches[0]
    for s in sketches[1:]:
        all_cells = all_cells.unionByName(s)
    return _add(all_cells.select(*keys, "measure", "cell", "value"), [*keys, "measure"])


def percentiles(cells: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(keys, measure, n, p50, ...) of a sketch table."""
    keys, probabilities = list(keys), list(probabilities)
    names = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("measure", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names]])
    order = [*keys, "measure", "n", *names]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not t.num_rows:
                return
            order_key = t.column(-1).to_numpy() >> CELL_BITS
            new = np.concatenate([[True], order_key[1:] != order_key[:-1]])
            starts = np.flatnonzero(new)
            end = t.num_rows if last else int(starts[-1])
            if end < t.num_rows:  # the last group may go on in the next batch
                held.extend(t.slice(end).to_batches())
                t, new, starts = t.slice(0, end), new[:end], starts[:-1]
            if not end:
                return
            codes = []
            for i in range(len(keys) + 1):
                code = t.column(i).combine_chunks().dictionary_encode()
                codes.append((code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False))
            apart = np.zeros(end, dtype=bool)
            for code in codes:
                apart[1:] |= code[1:] != code[:-1]
            cell, value = t.column(-3).to_numpy(), t.column(-2).to_numpy()
            if (apart & ~new).any():  # groups whose hashes collide stand mixed
                at = np.lexsort([cell, *codes[::-1], np.cumsum(new)])
                t, cell, value = t.take(pa.array(at)), cell[at], value[at]
                new[1:] = np.cumsum(new)[at][1:] != np.cumsum(new)[at][:-1]
                for code in codes:
                    new[1:] |= code[at][1:] != code[at][:-1]
                starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            n, q = invert(group, cell, value, len(starts), probabilities)
            ok = pa.array(np.flatnonzero(n > 0))
            heads = [t.column(i).take(pa.array(starts)).take(ok).combine_chunks() for i in range(len(keys) + 1)]
            heads = [h.chunk(0) if isinstance(h, pa.ChunkedArray) else h for h in heads]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(n[n > 0]), *[pa.array(q[n > 0, j]) for j in range(len(probabilities))]], order)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > 300_000:
                yield from block(False)
        if held:
            yield from block(True)

    # the rows of a group meet in a partition; one long, the group's hash with the counter's place in its
    # low bits, sorts them without comparing keys
    low = (1 << CELL_BITS) - 1
    place = F.xxhash64(*keys, "measure").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("cell").cast("long"))
    ordered = cells.select(*keys, "measure", "cell", "value").repartition(*keys, "measure").withColumn("_place", place).sortWithinPartitions("_place")
    return ordered.mapInArrow(ask, schema)
