"""Near-duplicate records: DartMinHash signatures, banded join, exact check.

Each element owns a region of the (weight, rank) plane into which hashed darts are thrown, one on average in
each unit of area. A record sees the darts below its elements' weights, up to a rank at which it holds about
k ln k + 2k of them; every dart belongs to one of k coordinates, and the earliest dart of each coordinate is
the signature (records with an empty coordinate look twice as far). Two records agree in a coordinate with the
probability of their weighted Jaccard similarity; here all weights are 1. Signatures are cut into bands; records
that share a band are candidates if a lossless bound allows it: the number of different bits of two 112-bit
occupancy maps is at most the size of the symmetric difference. Candidates are then checked exactly.

Identical element sets are collapsed to their smallest id before banding, so a group of copies costs one row,
and the copies are expanded only in the result. Records are sorted by their 64-bit band values, and each run of one
value is paired in blocks of array operations, within the sizes that the threshold allows. A run of more than
``BLOCK`` records is cut into blocks, and each pair of blocks becomes a cell of its own in a second shuffle, so a
value that a third of all records share is spread over many tasks; nothing is capped. With 4 rows and 32 bands a pair at
similarity 0.7 is missed with probability 0.00015, at 0.75 with 0.000005. A larger collection holds more
unrelated pairs that agree by chance, so one more row is used for each 20-fold growth beyond 200 000 records
(``rows_for``), with as many bands as keep that probability (``bands_for``).

Defined results: null texts count as empty; records without an id and those with fewer than ``least`` distinct terms take no part;
texts are read whole; repeated rows of one id give no pair; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yakinma.llm.terms import terms_of
from yakinma.session import materialise

U = np.uint64
EMPTY = U(2**64 - 1)
_POISSON = np.array([int(2**64 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(16)], dtype=object)
#: Sizes from here on are not told apart by the bound, which then lets the pair through: it drops nothing.
SIZE_CAP = 2**16 - 1
#: Records of one band value that one task pairs; longer runs are paired block by block.
BLOCK = 32_768
#: Pairs looked at in one step.
STEP = 2_000_000
POISSON = np.array([min(x, 2**64 - 1) for x in _POISSON], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _segments(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lens[i] - 1 of all i, one behind the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) signatures of weighted sets. ``rows`` gives the record of each element and ascends."""
    sig = np.full(n_rows * k, EMPTY, dtype=np.uint64)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    reach = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n_rows), where=total > 0)
    todo = total > 0
    # a cell is a unit square: (element, whole part of the weight, whole part of the rank)
    cells = np.ceil(weights).astype(np.int64)
    elem = np.repeat(np.arange(len(elements)), cells)
    floor = _segments(np.zeros(len(elements), np.int64), cells)
    known, which = np.unique(mix(elements[elem] + floor.astype(np.uint64) * U(0xD1342543DE82EF95)), return_inverse=True)
    row, limit = rows[elem], weights[elem] - floor
    while todo.any():
        far = int(math.ceil(reach[todo].max()))
        use = todo[row]
        # throw the darts of every cell in reach, cell by cell along the rank
        base = mix(known[:, None] ^ mix(np.arange(1, far + 1, dtype=np.uint64))[None, :])
        count = np.searchsorted(POISSON, base.ravel(), side="right")
        first = np.concatenate([[0], np.cumsum(count)])
        cell = np.repeat(np.arange(base.size), count)
        dart = mix(base.ravel()[cell] + (_segments(np.ones(base.size, np.int64), count)).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        rank = (cell % far) * 65536 + (dart & U(0xFFFF)).astype(np.int64)
        place = ((dart >> U(16)) % U(k)).astype(np.int64)
        value = (rank.astype(np.uint64) << U(32)) | (mix(dart) >> U(32))
        height = (mix(dart ^ U(0xA5A5A5A5A5A5A5A5)) >> U(11)).astype(np.float64) / 2**53 if (limit < 1).any() else None
        # what each record sees of them
        mine, owner = which[use], row[use]
        begin = first[mine * far]
        n = first[mine * far + np.minimum(far, np.ceil(reach[owner])).astype(np.int64)] - begin
        at, owner = _segments(begin, n), np.repeat(owner, n)
        seen = rank[at] < reach[owner] * 65536
        if height is not None:
            seen &= height[at] < np.repeat(limit[use], n)
        at, owner = at[seen], owner[seen]
        np.minimum.at(sig, owner * k + place[at], value[at])
        todo &= (sig.reshape(n_rows, k) == EMPTY).any(axis=1)
        reach = reach * 2
    return sig.reshape(n_rows, k)


def term_hash(term: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term)


def _sets(batch: pa.RecordBatch, fields: int, least: int) -> tuple[list[int], list[set[str]]]:
    ids, sets = [], []
    for i, *texts in zip(*(c.to_pylist() for c in batch.columns[: fields + 1]), strict=True):
        s = set(terms_of(" ".join(t or "" for t in texts)))
        if len(s) >= least:
            ids.append(i)
            sets.append(s)
    return ids, sets


def sketch(df: DataFrame, id_col: str, fields: Sequence[str], least: int, rows: int, bands: int) -> DataFrame:
    """(id, s1, s2, b1, b2, keys): identity of the set, 112-bit occupancy map with the size behind it, band values."""
    k = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            all_ids, all_sets = _sets(batch, len(fields), least)
            for a in range(0, len(all_ids), 1000):
                ids, sets = all_ids[a : a + 1000], all_sets[a : a + 1000]
                if len(known) > 300_000:
                    known.clear()
                known.update((t, term_hash(t)) for t in set().union(*sets) if t not in known)
                lens = np.array([len(s) for s in sets], dtype=np.int64)
                h = np.fromiter((known[t] for s in sets for t in s), np.uint64, int(lens.sum()))
                row = np.repeat(np.arange(len(sets)), lens)
                sig = signatures(h, np.ones(len(h)), row, len(sets), k).reshape(len(sets), bands, rows)
                start = np.cumsum(lens) - lens
                bit = mix(h) % U(112)
                key = np.zeros((len(sets), bands), dtype=np.uint64)
                for r in range(rows):
                    key = mix(key ^ sig[:, :, r])
                flat = pa.array(mix(key + np.arange(bands, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15)).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(np.add.reduceat(mix(h), start).view(np.int64)),
                        pa.array(np.bitwise_xor.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), start).view(np.int64)),
                        pa.array(np.bitwise_or.reduceat(np.where(bit < 64, U(1) << (bit & U(63)), U(0)), start).view(np.int64)),
                        pa.array((np.bitwise_or.reduceat(np.where(bit < 64, U(0), U(1) << (bit & U(63))), start) << U(16) | np.minimum(lens, SIZE_CAP).astype(np.uint64)).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), flat),
                    ],
                    ["id", "s1", "s2", "b1", "b2", "keys"],
                )

    cols = [F.col(id_col).cast("bigint").alias("id"), *[F.col(f).cast("string").alias(f"_t{i}") for i, f in enumerate(fields)]]
    return df.select(*cols).mapInArrow(run, "id bigint, s1 bigint, s2 bigint, b1 bigint, b2 bigint, keys array<bigint>")


def term_sets(df: DataFrame, id_col: str, fields: Sequence[str], least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = _sets(batch, len(fields), least)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([list(s) for s in sets], pa.list_(pa.string()))], ["id", "terms"])

    cols = [F.col(id_col).cast("bigint").alias("id"), *[F.col(f).cast("string").alias(f"_t{i}") for i, f in enumerate(fields)]]
    return df.select(*cols).mapInArrow(run, "id bigint, terms array<string>")


def rows_for(n: int) -> int:
    """Rows of a band for a collection of n records."""
    return 4 + max(0, int(math.log(max(1, n) / 200_000) / math.log(20)))


def bands_for(rows: int, similarity: float, miss: float = 1.55e-4) -> int:
    """Bands with which a pair at ``similarity`` is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _possible_pairs(run: np.ndarray, size: np.ndarray, b1: np.ndarray, b2: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of rows of one run that the bounds allow. ``run`` ascends, ``size`` ascends within a run. Sizes
    within t = num/den; symmetric difference at most (1 - 2t/(1+t)) (|A| + |B|), and at least the number of different bits."""
    code = run * (SIZE_CAP + 1) + size
    until = np.searchsorted(code, run * (SIZE_CAP + 1) + np.minimum(size * den // num, SIZE_CAP), side="right")
    at = np.arange(len(run))
    count = until - at - 1
    ends = np.cumsum(count)
    start = 0
    while start < len(run):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, side="right")))
        n = count[start:stop]
        i = np.repeat(at[start:stop], n)
        j = _segments(at[start:stop] + 1, n)
        apart = np.bitwise_count(b1[i] ^ b1[j]) + np.bitwise_count((b2[i] ^ b2[j]) >> U(16)).astype(np.int64)
        near = (apart * (num + den) <= (size[i] + size[j]) * (den - num)) | (size[j] == SIZE_CAP)
        yield i[near], j[near]
        start = stop


_RUNS = "a bigint, b bigint, key bigint, block int, b1 bigint, b2 bigint"


def _pair_runs(num: int, den: int, block: int):
    """Pairs (a, b) of each run of equal keys; the records of a run longer than ``block`` come out as they are, with the
    number of their block."""

    def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort([high, low])
            low, high = low[order], high[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            nothing = [pa.nulls(int(new.sum()), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), *nothing], ["a", "b", "key", "block", "b1", "b2"])

    def crowded(key: np.ndarray, ids: np.ndarray, b1: np.ndarray, b2: np.ndarray, from_row: int) -> Iterator[pa.RecordBatch]:
        number = ((from_row + np.arange(len(ids))) // block).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(key), pa.array(number), pa.array(b1), pa.array(b2)], ["a", "b", "key", "block", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, spilled, open_key = 0, 0, None  # rows of the open run that already came out as crowded

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, spilled, open_key
            key, ids, b1, b2 = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            keep = len(key) if last else int(starts[-1])
            if spilled and open_key == key[0]:  # the run began in what was let go of
                yield from crowded(key[: ends[0]], ids[: ends[0]], b1[: ends[0]], b2[: ends[0]], spilled)
                spilled = spilled + int(ends[0]) if ends[0] == len(key) and not last else 0
                done = int(ends[0])
            else:
                spilled, done = 0, 0
            if not last and done <= keep and len(key) - keep > block:  # the open run is crowded already
                yield from crowded(key[keep:], ids[keep:], b1[keep:], b2[keep:], 0)
                spilled, open_key, rest = len(key) - keep, key[-1], len(key)
            else:
                rest = max(keep, done)
            for s, e in zip(starts, ends, strict=True):
                if e - s > block and done <= s and e <= keep:
                    yield from crowded(key[s:e], ids[s:e], b1[s:e], b2[s:e], 0)
            n = ends - starts
            small = np.repeat((n <= block) & (n > 1) & (starts >= done) & (ends <= keep), n)
            which = np.repeat(np.arange(len(n)), n)[small]
            use, u1, u2 = ids[small], b1[small].view(np.uint64), b2[small].view(np.uint64)
            size = (u2 & U(SIZE_CAP)).astype(np.int64)
            order = np.lexsort([size, which])
            use, u1, u2, size, which = use[order], u1[order], u2[order], size[order], which[order]
            for i, j in _possible_pairs(which, size, u1, u2, num, den):
                different = use[i] != use[j]
                yield from out(use[i[different]], use[j[different]])
            held = [(key[rest:], ids[rest:], b1[rest:], b2[rest:])] if rest < len(key) else []
            rows = len(key) - rest

        for b in batches:
            if b.num_rows:
                held.append(tuple(c.to_numpy() for c in b.columns))
                rows += b.num_rows
                if rows > 4 * block:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _pair_cells(num: int, den: int):
    """Pairs of the records of different blocks in each cell (key, lo, hi), or of one block where lo = hi."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cell = t.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            end = t.num_rows if last else int(starts[-1])
            if end < t.num_rows:
                held.extend(t.slice(end).to_batches())
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                if e > end:
                    break
                ids, b1, b2, block = (t.column(k).to_numpy()[s:e] for k in range(1, 5))
                same = block.min() == block.max()
                u1, u2 = b1.view(np.uint64), b2.view(np.uint64)
                size = (u2 & U(SIZE_CAP)).astype(np.int64)
                o = np.argsort(size, kind="stable")
                for i, j in _possible_pairs(np.zeros(e - s, np.int64), size[o], u1[o], u2[o], num, den):
                    x, y = o[i], o[j]
                    ok = (ids[x] != ids[y]) & (same | (block[x] != block[y]))
                    low, high = np.minimum(ids[x[ok]], ids[y[ok]]), np.maximum(ids[x[ok]], ids[y[ok]])
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) > 4 * BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def candidates(banded: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of records (key, id, b1, b2) that share a key and that the bounds allow."""
    runs = banded.select("key", "id", "b1", "b2").repartition("key").sortWithinPartitions("key").mapInArrow(_pair_runs(num, den, block), _RUNS)
    runs = materialise(runs, "runs")  # read for its pairs and for its crowded runs
    pairs, crowded = runs.where("block IS NULL").select("a", "b"), runs.where("block IS NOT NULL")
    if not crowded.isEmpty():
        blocks = crowded.groupBy("key").agg(F.max("block").alias("m"))
        cells = crowded.join(blocks, "key").select("key", F.col("a").alias("id"), "b1", "b2", "block", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("o"))
        cell = F.xxhash64("key", F.least("block", "o"), F.greatest("block", "o"))
        cells = cells.select(cell.alias("cell"), "id", "b1", "b2", "block").repartition("cell").sortWithinPartitions("cell")
        pairs = pairs.unionByName(cells.mapInArrow(_pair_cells(num, den), "a bigint, b bigint"))
    return pairs.distinct()


def similar(
    df: DataFrame, id_col: str, fields: Sequence[str], least: int = 25, num: int = 7, den: int = 10, rows: int | None = None, bands: int | None = None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(links, copies). Links are pairs (a, b), a < b, of representatives at least num/den similar; copies are
    (rep, id) of every id whose term set another id shares, the representative included."""
    rows = rows or rows_for(df.count())
    names = [f"_t{i}" for i in range(len(fields))]
    df = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(f).cast("string").alias(x) for f, x in zip(fields, names, strict=True)]).where("id IS NOT NULL")
    id_col, fields = "id", names
    bands = bands or bands_for(rows, num / den)
    sig = materialise(sketch(df, id_col, fields, least, rows, bands), "sketch")
    who = sig.select("id", "s1", "s2")
    groups = who.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("_last")).where("rep < _last").drop("_last")
    copies = materialise(who.join(groups, ["s1", "s2"]).select("rep", "id").distinct(), "copies")
    base = sig.join(copies.where("id <> rep").select("id"), "id", "left_anti")
    pairs = materialise(candidates(base.select(F.explode("keys").alias("key"), "id", "b1", "b2"), num, den, block), "candidates")
    # written, so that its real size decides between a broadcast and a shuffle of the texts
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "wanted")
    chosen = df.join(wanted, F.col(id_col).cast("bigint") == F.col("_id"), "left_semi")
    sets = materialise(term_sets(chosen, id_col, fields, least).dropDuplicates(["id"]), "sets")
    checked = pairs.join(sets.select(F.col("id").alias("a"), F.col("terms").alias("_ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("terms").alias("_tb")), "b")
    common = F.size(F.array_intersect("_ta", "_tb"))
    exact = common * (num + den) >= (F.size("_ta") + F.size("_tb")) * num
    return materialise(checked.where(exact).select("a", "b"), "links"), copies


def all_pairs(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids, copies expanded."""
    x, y = copies.select(F.col("rep").alias("a"), F.col("id").alias("_x")), copies.select(F.col("rep").alias("b"), F.col("id").alias("_y"))
    wide = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("_x", "a").alias("_x"), F.coalesce("_y", "b").alias("_y"))
    inner = x.join(y, (F.col("a") == F.col("b")) & (F.col("_x") < F.col("_y"))).select("_x", "_y")
    return wide.unionByName(inner).select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("b", "a"))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = e.join(least, "a")
        if large:
            return moved.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    e = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        e = materialise(star(star(e, True), False), "stars")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def groups(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, group_id, n_links): one row for each id with a near duplicate or copy. ``n_links`` counts the
    different texts its own text is linked to; copies share those of their representative."""
    reps = copies.select("rep").distinct()
    edges = links.union(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    named = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.select("rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return named.join(copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "group_id", "n_links")
