"""Fill containers of fixed capacity with items of varying length.

Non-negative least squares over the histogram of lengths: the combinations of at most three lengths that fill
a container exactly (or up to a window) are enumerated, their repeat counts are solved for against the
histogram, rounded down to what the histogram holds, and the residual lengths are packed greedily, longest
first into the fullest container they fit. Planning works on counts of lengths, at most ``capacity`` rows,
whatever the number of items. Items then find their container by their rank among the items of
their length. Ranks are two-level: within (length, hash bucket of the id), plus the buckets before, so a
length that most items share is still ranked by many tasks.

Defined results: an item over the capacity is cut into full pieces and one rest, and only such an item is cut;
null and negative sizes count as 0; items of size 0 take no room and are spread over the containers (over
container 0 if there is no other); repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yakinma.session import materialise


def combinations(lengths: np.ndarray, capacity: int, window: int = 0, depth: int = 3) -> np.ndarray:
    """Rows of up to ``depth`` present lengths, ascending and filled with 0, that sum to within ``window`` of the capacity."""
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    out = [np.array([[0, 0, c] for c in lengths if capacity - window <= c], dtype=np.int64).reshape(-1, 3)]
    for total in range(capacity - window, capacity + 1):
        if depth >= 2:
            a = lengths[lengths <= total - lengths]
            a = a[present[total - a]]
            out.append(np.stack([np.zeros_like(a), a, total - a], 1))
        if depth >= 3:
            for a in lengths[lengths * 3 <= total]:
                b = lengths[(lengths >= a) & (lengths <= (total - a) - lengths)]
                b = b[present[total - a - b]]
                out.append(np.stack([np.full_like(b, a), b, total - a - b], 1))
    return np.concatenate(out)


def nnls(rows: np.ndarray, histogram: np.ndarray, weights: np.ndarray, steps: int = 400) -> np.ndarray:
    """min ||W(Ax - h)|| with x >= 0 by accelerated projected gradients; A has the lengths of each combination."""
    n = len(histogram)
    flat, k = rows.ravel(), rows.shape[1]
    w2 = weights.astype(float) ** 2
    w2[0] = 0.0
    forward = lambda x: np.bincount(flat, weights=np.repeat(x, k), minlength=n)
    back = lambda r: (w2 * r)[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - histogram) / (norm * 1.01))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


@dataclass
class Plan:
    """Patterns of lengths with their repeat counts; containers are numbered pattern by pattern."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each length: first ranks, ascending, and the container of each first rank."""
        ranks: dict[int, list] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        base = 0
        for pattern, n in self.patterns:
            for length in pattern:
                ranks[length].append((used[length], base))
                used[length] += n
            base += n
        return {k: (np.array([r for r, _ in v], dtype=np.int64), np.array([c for _, c in v], dtype=np.int64)) for k, v in ranks.items()}


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, into the fullest open container that has room; containers alike are kept as counts."""
    room: dict[int, list[list]] = defaultdict(list)  # free space: [pattern, count]
    for length in sorted((x for x, n in left.items() if n > 0), reverse=True):
        n = left[length]
        for free in range(length, capacity + 1):
            k = free // length
            stack = room.get(free, [])
            keep = []
            while stack and n >= 1:
                pattern, count = stack.pop()
                full = min(count, n // k)
                if full:
                    room[free - k * length].append([pattern + (length,) * k, full])
                    n -= full * k
                    count -= full
                if count and 0 < n < k:
                    room[free - n * length].append([pattern + (length,) * n, 1])
                    count, n = count - 1, 0
                if count:
                    keep.append([pattern, count])
            stack += keep
        k = capacity // length
        if n >= k:
            room[capacity - k * length].append([(length,) * k, n // k])
        if n % k:
            room[capacity - (n % k) * length].append([(length,) * (n % k), 1])
    return [(tuple(p), c) for _, groups in sorted(room.items()) for p, c in groups if c]


def plan(histogram: dict[int, int], capacity: int, window: int = 0, depth: int = 3, most_rows: int = 4_000_000) -> Plan:
    """Combinations have up to ``depth`` lengths, or fewer where that would be more than ``most_rows`` unknowns, which the
    squares of the lengths present bound; what no combination takes is packed greedily, so every item is placed either way."""
    left = {k: n for k, n in histogram.items() if 0 < k <= capacity and n > 0}
    if not left:
        return Plan(capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.array(sorted(left), dtype=np.int64)
    while depth > 1 and len(lengths) ** (depth - 1) * (window + 1) // (2, 12)[depth > 2] > most_rows:
        depth -= 1
    rows = combinations(lengths, capacity, window, depth)
    if len(rows):
        h = np.zeros(capacity + 1)
        h[lengths] = [left[int(k)] for k in lengths]
        weights = np.where(np.arange(capacity + 1) <= capacity // 16, 0.1, 1.0)  # short rests are easy to place
        x = np.floor(nnls(rows, h, weights) + 0.5).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if not x[i]:
                break
            pattern = tuple(int(v) for v in rows[i] if v)
            need = {v: pattern.count(v) for v in pattern}
            n = min(int(x[i]), *(left[v] // c for v, c in need.items()))
            if n > 0:
                out.append((pattern, n))
                for v, c in need.items():
                    left[v] -= n * c
    return Plan(capacity, out + _greedy(left, capacity))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, window: int = 0, buckets: int | None = None) -> DataFrame:
    """(id, piece, size, container) of every item."""
    spark = sizes.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    items = sizes.select(F.col(id_col).cast("bigint").alias("id"), size.alias("_n"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1))))
    items = items.select("id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("piece") * capacity).alias("size"))
    items = items.withColumn("_b", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    items = materialise(items, "items")  # read twice, and counting tokens twice would cost more
    counts = items.groupBy("size", "_b").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity + 1 rows reach the driver
    histogram = {int(r["size"]): int(r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity, window)
    slots, containers = made.slots(), max(1, made.containers)
    # a length has at most ``buckets`` rows here
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("size").orderBy("_b")) - F.col("n")).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            out = rank % containers
            for v in np.unique(length):
                if v:
                    at = length == v
                    first, base = slots[int(v)]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    out[at] = base[k] + rank[at] - first[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], ["id", "piece", "size", "container"])

    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy("size", "_b").orderBy("id", "piece")))
    ranked = ranked.join(before, ["size", "_b"])  # both sides lie by (size, bucket) already
    return ranked.select("id", "piece", "size", (F.col("_before") + F.col("_r") - 1).alias("_rank")).mapInArrow(place, "id bigint, piece int, size bigint, container bigint")
