"""Order, latency and rollups within threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thread_positions(rows: DataFrame, thread: list[str], ts: str, key: str) -> DataFrame:
    """Adds ``position`` (from 1, by time and key) and ``latency_s`` to the message before."""
    w = Window.partitionBy(*thread).orderBy(F.col(ts), F.col(key))
    return rows.withColumn("position", F.row_number().over(w)).withColumn("latency_s", F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)))


def upper_median(c: Column) -> Column:
    """Element n div 2 of the sorted non-null values; null if there is none."""
    s = F.sort_array(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def thread_rollup(rows: DataFrame, thread: list[str], ts: str, key: str) -> DataFrame:
    """Per thread: messages, first and last time, root, upper median of the gaps."""
    return (
        thread_positions(rows, thread, ts, key)
        .groupBy(*thread)
        .agg(F.count("*").alias("messages"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.min_by(key, F.struct(ts, key)).alias("root"), upper_median(F.col("latency_s")).alias("median_gap_s"))
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by a max over a struct: partial on the map side, no sort, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def rate_limited(rows: DataFrame, key: str, ts: str, unit: str, cap: int, tie: str) -> DataFrame:
    """Adds ``accepted``: the first ``cap`` rows of each key in each fixed window."""
    w = Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(ts, tie)
    return rows.withColumn("accepted", F.row_number().over(w) <= cap)
