"""Occurrences and record counts of every distinct term of a collection.

Range-partitioned external sort: map tasks emit (term, record id, occurrences) once for each pair, each pair goes
to its range of the total order of pairs, the ranges are sorted (spilling when they must), and a run-length
scan of the sorted pairs counts occurrences and distinct records. A frequent term is split over several
ranges by record id, so no task holds all of its records; the partial runs at range borders are added up in
a last, small aggregation of one row for each term and range. A bounded sample only places the borders:
whatever they are, every pair of every record is counted.

Defined results: null and empty texts have no terms; a repeated row (same id, same text) adds occurrences
but not records; rows without an id count as one record; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = re.compile("[a-zçğıöşü]{2,}")
NO_ID = -(2**63)


def terms_of(text: str) -> list[str]:
    """The terms of a text in order, with repeats."""
    nfc = unicodedata.normalize
    return TERM.findall(nfc("NFC", nfc("NFC", text).replace("I", "ı").replace("İ", "i").lower()))


def _pairs(ids: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted terms, sorted distinct ids, key = term rank * ids + id rank, sorted, occurrences of each key)."""
    flat: list[str] = []
    lens = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        if text:
            found = terms_of(text)
            flat += found
            lens[k] = len(found)
    known, rank = np.unique(ids, return_inverse=True)
    if not flat:
        return [], known, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(flat, pa.string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    key = place[coded.indices.to_numpy()] * len(known) + np.repeat(rank, lens)
    key, times = np.unique(key, return_counts=True)
    return [names[i] for i in order], known, key, times


def _probe(docs: DataFrame, n_rows: int, ranges: int, sample_docs: int, per_doc: int = 64) -> tuple[int, list[tuple[str, int]]]:
    """(number of texts, borders of about equal ranges) in one pass: every text is counted, and pairs are taken of at
    most about ``sample_docs`` of them, chosen by hashed id."""
    share = min(1 << 30, int((1 << 30) * sample_docs / max(1, n_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms, ids = 0, [], []
        for b in batches:
            n += b.num_rows - b.column(1).null_count
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    found = sorted(set(terms_of(text)))
                    found = found[i % max(1, len(found) // per_doc) :: max(1, len(found) // per_doc)][:per_doc]
                    terms += found
                    ids += [i] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array([*ids, n], pa.int64())], ["term", "id"])

    # only sampled texts cross to Python, of the others whether they are there
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    looked = docs.select("id", F.when(place < share, F.col("text")).otherwise(F.when(F.col("text").isNotNull(), F.lit(""))).alias("text"))
    got = looked.mapInArrow(run, "term string, id bigint").toArrow()
    rows = list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    pairs = sorted(r for r in rows if r[0] is not None)
    at = [pairs[len(pairs) * k // ranges] for k in range(1, ranges)] if len(pairs) >= ranges else []
    return sum(n for term, n in rows if term is None), sorted(set(at))


def term_counts(df: DataFrame, text: str, id_col: str, ranges: int | None = None, sample_docs: int = 2000) -> DataFrame:
    """(term, n_total, n_records) of every term of ``text``."""
    return _counted(df, text, id_col, ranges, sample_docs)[0]


def _counted(df: DataFrame, text: str, id_col: str, ranges: int | None = None, sample_docs: int = 2000) -> tuple[DataFrame, int]:
    """The counts, and the number of texts. The rows are counted without reading them where a file format allows it."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    n_docs, borders = _probe(docs, df.count(), ranges, sample_docs)
    docs = docs.where("text IS NOT NULL")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, known, key, times = _pairs(b.column(0).to_numpy(), b.column(1).to_pylist())
            if not len(key):
                continue
            cuts = []
            for term, i in borders:
                r = bisect_left(terms, term)
                same = r < len(terms) and terms[r] == term
                cuts.append(np.searchsorted(key, r * len(known) + (np.searchsorted(known, i) if same else 0)))
            part = np.repeat(np.arange(len(cuts) + 1), np.diff([0, *cuts, len(key)]))
            names = pa.DictionaryArray.from_arrays(pa.array(key // len(known), pa.int32()), pa.array(terms, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), names, pa.array(known[key % len(known)]), pa.array(times, pa.int32())], ["part", "term", "id", "times"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # the open run: term, occurrences, records, last id

        def out(terms: list, total: list, records: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(total, pa.int64()), pa.array(records, pa.int64())], ["term", "n_total", "n_records"])

        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(0))
            terms, ends = runs.values.to_pylist(), runs.run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            ids, times = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            fresh = np.ones(len(ids), dtype=np.int64)
            fresh[1:] = ids[1:] != ids[:-1]
            fresh[starts] = 1
            total, records = np.add.reduceat(times, starts).tolist(), np.add.reduceat(fresh, starts).tolist()
            if last and last[0] == terms[0]:
                total[0] += last[1]
                records[0] += last[2] - int(last[3] == ids[0])
            elif last:
                yield out([last[0]], [last[1]], [last[2]])
            last = [terms[-1], total[-1], records[-1], ids[-1]]
            if len(terms) > 1:
                yield out(terms[:-1], total[:-1], records[:-1])
        if last:
            yield out([last[0]], [last[1]], [last[2]])

    pairs = docs.mapInArrow(emit, "part int, term string, id bigint, times int")
    ordered = pairs.repartitionById(max(1, len(borders) + 1), F.col("part")).select("term", "id", "times").sortWithinPartitions("term", "id")
    runs = ordered.mapInArrow(scan, "term string, n_total bigint, n_records bigint")
    return runs.groupBy("term").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records")), n_docs


def mark_terms(counts: DataFrame, n_docs: int, rare_up_to: int = 2, common_one_in: int = 5) -> DataFrame:
    """Add ``mark``: rare, common or null."""
    common = F.col("n_records") * common_one_in >= n_docs
    return counts.withColumn("mark", F.when(F.col("n_records") <= rare_up_to, "rare").when(common, "common"))


def marked_terms(df: DataFrame, text: str, id_col: str, **kw: int) -> DataFrame:
    return mark_terms(*_counted(df, text, id_col, **kw))
