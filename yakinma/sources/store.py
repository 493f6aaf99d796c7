"""Storage of the three tables: bucketed Parquet under versions, one pointer, upsert, repair, deletion, statistics.

Every table is split into buckets by a hash of its key. A write makes new files for the buckets it touches, and then
one pointer file, which names the current files of all tables, is renamed over the old one: readers see whole
states of all tables, and a job that dies leaves the old state. Replaced files stay for running readers until
``vacuum`` removes them. There is one writer at a time. Nothing is collected but counts and bucket numbers.

A stored number is never NaN: what is no number is stored as null, and so loses to any number in ties.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yakinma import schema as S
from yakinma.functions.text import company_slug, is_boilerplate, normalize_space, sanitize_body
from yakinma.operators.kpi import company_stats
from yakinma.session import materialise

#: What the buckets of each table are made of.
BUCKET_KEYS = {"complaints": "complaint_url", "sentiment_results": "complaint_id", "aspect_sentiment": "complaint_id"}


def latest_items(items: DataFrame, order: str = "scraped_at") -> DataFrame:
    """One row per ``complaint_url``: the last state, with the last body that is not null. Both are aggregates, so
    many events of one page combine map-side. Ties in time fall to the greatest row, column by column in the order of
    the table, where null and NaN (which becomes null) are the lowest."""
    items = S.without_nan(items)
    rest = [c for c in items.columns if c not in ("complaint_url",)]
    at = F.struct(F.col(order), *[F.col(c) for c in rest if c != order])
    first = F.struct(F.col(order), F.col("company"))
    g = items.where(F.col("complaint_url").isNotNull()).groupBy("complaint_url")
    got = g.agg(
        F.max(at).alias("_last"),
        F.max(F.when(F.col("complaint_text").isNotNull(), F.struct(F.col(order), F.col("complaint_text")))).alias("_body"),
        F.min(first).alias("_first"),
    )
    cols = [F.col(f"_last.{c}").alias(c) for c in rest if c not in ("company", "complaint_text")]
    return got.select("complaint_url", F.col("_first.company").alias("company"), F.col("_body.complaint_text").alias("complaint_text"), *cols)


def clean_items(items: DataFrame, order: str = "scraped_at") -> DataFrame:
    """The latest items as rows of the store without ids, bodies sanitised."""
    new = S.migrate(latest_items(items, order), S.COMPLAINTS).drop("id")
    return new.withColumn("complaint_text", F.nullif(sanitize_body(F.col("complaint_text"), F.col("company_response_text")), F.lit("")))


def merge_items(target: DataFrame, new: DataFrame, top: Column) -> DataFrame:
    """MERGE of ``clean_items`` on ``complaint_url``. A known page keeps its id and company and takes every other value
    of the item, nulls included, but a null body never erases one. New pages get ids above ``top``, in URL order."""
    t, n = S.migrate(target, S.COMPLAINTS).alias("t"), new.alias("n")
    same = F.col("t.complaint_url") == F.col("n.complaint_url")
    hit = F.col("n.complaint_url").isNotNull()

    def pick(c: str) -> Column:
        if c in ("id", "company", "complaint_url"):
            return F.col(f"t.{c}")
        return F.when(hit, F.coalesce(f"n.{c}", f"t.{c}") if c == "complaint_text" else F.col(f"n.{c}")).otherwise(F.col(f"t.{c}"))

    known = t.join(n, same, "left").select(*[pick(c).alias(c) for c in S.COLUMNS])
    fresh = new.join(target.select("complaint_url"), "complaint_url", "left_anti")
    return known.unionByName(number_new(fresh, top))


def upsert(target: DataFrame, items: DataFrame, order: str = "scraped_at") -> DataFrame:
    """``target`` with the items merged into it (see ``merge_items``)."""
    new = materialise(clean_items(items, order), "items")  # read twice; its real size decides how it is joined
    return merge_items(target, new, target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())


def number_new(fresh: DataFrame, top: Column) -> DataFrame:
    """Ids above ``top``: dense in URL order, by counts per range of URLs, never by one global window."""
    parts = max(1, int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = fresh.repartitionByRange(parts, "complaint_url").sortWithinPartitions("complaint_url").withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged, "new")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row a partition
    ids = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("complaint_url"))).join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return ids.select((top + F.col("_b") + F.col("_r")).cast("long").alias("id"), *[c for c in S.COLUMNS if c != "id"])


def repair(complaints: DataFrame, results: DataFrame, aspects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sanitise stored bodies again; where that changes more than blanks, write it and drop cached results."""
    clean = sanitize_body(F.col("complaint_text"), F.col("company_response_text"))
    changed = F.col("complaint_text").isNotNull() & (clean != normalize_space(F.col("complaint_text")))
    fixed = complaints.withColumn("_c", F.when(changed, F.struct(F.nullif(clean, F.lit("")).alias("v"))))
    gone = fixed.where("_c IS NOT NULL").select(F.col("id").alias("complaint_id")).distinct()
    body = F.when(F.col("_c").isNotNull(), F.col("_c.v")).otherwise(F.col("complaint_text"))
    out = fixed.withColumn("complaint_text", body).drop("_c")
    return out, results.join(gone, "complaint_id", "left_anti"), aspects.join(gone, "complaint_id", "left_anti")


def boilerplate_rows(complaints: DataFrame) -> DataFrame:
    return complaints.where(is_boilerplate(F.col("complaint_text")))


def without_company(complaints: DataFrame, results: DataFrame, aspects: DataFrame, company: str, hosts: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """The tables after deleting a company and its cached results, and how many rows that takes."""
    slug = company_slug(company, hosts)
    ids = complaints.where(F.col("company") == slug).select(F.col("id").alias("complaint_id"))
    keep = lambda t: t.join(ids, "complaint_id", "left_anti")
    n = lambda t: t.join(ids, "complaint_id", "left_semi").count()
    counts = {"complaints": ids.count(), "sentiment_results": n(results), "aspect_sentiment": n(aspects)}
    return complaints.where(~F.col("company").eqNullSafe(slug)), keep(results), keep(aspects), counts


def store_path(spark: SparkSession, explicit: str | None = None) -> str:
    """Where the tables are: the given folder, that of ``spark.yakinma.store``, or ``yakinma-store`` where the job runs."""
    return explicit or spark.conf.get("spark.yakinma.store", None) or f"file://{Path.cwd() / 'yakinma-store'}"


class Store:
    """The tables under one directory. ``buckets`` holds for a new store; an existing one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _state(self) -> dict | None:
        """``{buckets, top_id, tables: {name: {bucket: folder}}}``, null before ``create``."""
        fs, p = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, state: dict) -> None:
        jvm = self.spark._jvm
        fs, tmp = self._fs(f"{self.path}/CURRENT-{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT"), how)

    def exists(self, table: str) -> bool:
        state = self._state()
        return state is not None and table in state["tables"]

    def create(self) -> Store:
        """Create the missing tables, empty."""
        state = self._state() or {"buckets": self.buckets, "top_id": 0, "tables": {}}
        missing = [t for t in S.TABLES if t not in state["tables"]]
        if missing:
            state["tables"] |= {t: {} for t in missing}
            self._swap(state)
        return self

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows, of some buckets or of all; columns that older files lack come as nulls."""
        files = self._state()["tables"][table]
        paths = [f"{self.path}/{p}" for b, p in files.items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(S.TABLES[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], S.TABLES[table])

    def commit(self, tables: Mapping[str, DataFrame], touched: Sequence[int] | None = None, top_id: int | None = None) -> None:
        """New contents of tables, of the ``touched`` buckets only or of all, visible together."""
        state = self._state()
        n = state["buckets"]
        for name, df in tables.items():
            version = f"{name}/v-{uuid.uuid4().hex}"
            rows = S.migrate(df, S.TABLES[name]).withColumn("_b", F.pmod(F.xxhash64(BUCKET_KEYS[name]), F.lit(n)).cast("int"))
            # rebalanced, so that files are of even size and a crowded bucket is written by several tasks
            rows.hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{self.path}/{version}")
            fs, p = self._fs(f"{self.path}/{version}")
            made = [x.getPath().getName() for x in fs.listStatus(p)]
            made = {x[3:]: f"{version}/{x}" for x in made if x.startswith("_b=")}
            kept = {} if touched is None else {b: x for b, x in state["tables"][name].items() if int(b) not in touched}
            state["tables"][name] = kept | made
            if name == "complaints" and made:
                top = self.spark.read.schema(S.COMPLAINTS).parquet(f"{self.path}/{version}").agg(F.max("id")).first()[0]
                state["top_id"] = max(state["top_id"], top or 0)
        if top_id is not None:
            state["top_id"] = top_id
        self._swap(state)

    def write(self, table: str, df: DataFrame) -> None:
        self.commit({table: df})

    def upsert(self, items: DataFrame) -> None:
        """Merge items; only the buckets of their pages are read and written. Ids are never given twice."""
        state = self._state()
        new = materialise(clean_items(items), "items")
        of = F.pmod(F.xxhash64("complaint_url"), F.lit(state["buckets"])).cast("int")
        touched = sorted(r[0] for r in new.select(of).distinct().collect())  # at most one row a bucket
        if touched:
            self.commit({"complaints": merge_items(self.read("complaints", touched), new, F.lit(state["top_id"]))}, touched)

    def repair(self) -> None:
        self.commit(dict(zip(S.TABLES, repair(*(self.read(t) for t in S.TABLES)), strict=True)))

    def delete_company(self, company: str, hosts: tuple[str, ...] = ()) -> dict[str, int]:
        *tables, counts = without_company(*(self.read(t) for t in S.TABLES), company, hosts)
        self.commit(dict(zip(S.TABLES, tables, strict=True)))
        return counts

    def reset(self) -> dict[str, int]:
        """Empty all tables; ids start again."""
        counts = {t: self.read(t).count() for t in S.TABLES}
        self.commit({t: self.spark.createDataFrame([], schema) for t, schema in S.TABLES.items()}, top_id=0)
        return counts

    def compact(self, keep_hours: float = 1.0) -> None:
        """Rewrite every table in files of even size, and remove what readers of ``keep_hours`` ago no longer need."""
        self.commit({t: self.read(t) for t in S.TABLES})
        self.vacuum(keep_hours)

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Remove files that are not current and older than ``keep_hours``; the number of folders removed."""
        current, before, removed = {p for files in self._state()["tables"].values() for p in files.values()}, (time.time() - keep_hours * 3600) * 1000, 0
        for table in S.TABLES:
            fs, p = self._fs(f"{self.path}/{table}")
            for version in fs.listStatus(p) if fs.exists(p) else ():
                name = f"{table}/{version.getPath().getName()}"
                parts = list(fs.listStatus(version.getPath()))
                old = [x for x in parts if f"{name}/{x.getPath().getName()}" not in current and x.getModificationTime() <= before]
                for x in [version] if len(old) == len(parts) and version.getModificationTime() <= before else old:
                    removed += int(fs.delete(x.getPath(), True))
        return removed

    def size(self) -> int:
        """Bytes of the current files."""
        total = 0
        for files in self._state()["tables"].values():
            for path in files.values():
                fs, p = self._fs(f"{self.path}/{path}")
                total += int(fs.getContentSummary(p).getLength())
        return total

    def statistics(self) -> DataFrame:
        return company_stats(self.read("complaints"), self.read("sentiment_results")).orderBy(F.desc("complaint_count"), "company")
