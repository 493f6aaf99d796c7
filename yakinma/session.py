"""Session helpers: table loading, a default session, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


#: Settings the engine is tested with; whatever the submitter sets wins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
LOCAL_DEFAULTS = {"spark.ui.enabled": "false"}


def _submitted() -> SparkConf | None:
    """The submitter's settings where this process was started by spark-submit, else None."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return None
    SparkContext._ensure_initialized()
    return SparkConf(loadDefaults=True, _jvm=SparkContext._jvm)


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session. Under spark-submit master, partitions and every other setting of the submitter stay as they are, and
    only what is unset takes the engine's value; elsewhere the master is local with 8 shuffle partitions unless given."""
    wanted = {k.replace("__", "."): v for k, v in conf.items()}
    given = _submitted()
    if given is None:
        wanted = LOCAL_DEFAULTS | {"spark.master": master or "local[*]", "spark.sql.shuffle.partitions": str(shuffle_partitions or 8)} | wanted
    else:
        wanted |= {k: str(v) for k, v in {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions}.items() if v is not None}
    b = SparkSession.builder.appName("yakinma")
    for k, v in (DEFAULTS | wanted).items():
        if given is None or not given.contains(k):
            b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least one partition per core: a few small files (or one row group) would leave most cores idle
    under text work. Scans of many files pass unchanged, so large tables are never shuffled by this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session of one machine (``local[...]``) may go without it and then
    gets a temporary folder, as in tests; on a cluster a missing setting is an error, since executors share no disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(shared_dir, "_own", None)
    if path is None:
        path = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="yakinma-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession) -> str:
    """The application's own folder under the shared one; it is removed when the driver ends, or by ``release``."""
    path = f"{shared_dir(spark)}/yakinma/{spark.sparkContext.applicationId}"
    if path not in _known:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _known.add(path)
    return path


_known: set[str] = set()


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that still read them must be written before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage is cut, and the
    files outlive any executor. Used only for results that several later stages read."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
