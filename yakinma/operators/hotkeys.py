"""Per-key figures when a few keys hold most rows.

Every figure is an algebraic aggregate (count, sum, min, max, sum of squares), so Spark's partial
hash aggregation combines each map task's rows into one state per key before the shuffle: a key with
a third of all rows sends one compact row per map task, and no reducer sees its raw rows. The map-side
hash table is bounded by the task's memory and falls back to sorting and spilling.

Null keys form a group of their own in ``key_figures`` and are never heavy in ``heavy_keys``; NaN,
infinite and negative measures are left out of sums; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_measure(col: str) -> Column:
    """The measure where it is finite and not negative, else null."""
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c) & (c >= 0) & (c < F.lit(float("inf"))), c)


def heavy_keys(df: DataFrame, key: str, one_in: int = 20) -> DataFrame:
    """Keys that hold more than one ``one_in``-th of all rows, null keys excluded."""
    counts = df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)).alias("total"))
    return counts.where(F.col(key).isNotNull() & (F.col("n") * one_in > total.scalar())).select(key)


def key_figures(df: DataFrame, key: str, flags: Sequence[str] = (), measures: Sequence[str] = ()) -> DataFrame:
    """Complete figures per key: rows, sums of 0/1 flags, and n, sum, mean, sd, min, max of measures. Figures are
    doubles: they hold for any magnitude, to the rounding of the order in which states merge, and a sum beyond the
    largest double is infinite; the deviation of a single value is null."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0).cast("long"))).alias(f"n_{f}") for f in flags]
    for m in measures:
        v = valid_measure(m)
        aggs += [
            F.count(v).alias(f"{m}_n"),
            F.sum(v).alias(f"{m}_sum"),
            F.avg(v).alias(f"{m}_mean"),
            F.stddev_samp(v).alias(f"{m}_sd"),  # central moments, merged without cancellation
            F.min(v).alias(f"{m}_min"),
            F.max(v).alias(f"{m}_max"),
        ]
    return df.groupBy(F.col(key)).agg(*aggs)


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct non-null values per key in two levels: the first spreads a hot key over its values."""
    once = df.where(F.col(value).isNotNull()).select(key, value).distinct()
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("n_distinct"))
