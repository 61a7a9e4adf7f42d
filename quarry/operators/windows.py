"""Ordered views: top-k, runs, order violations, lost writes, suppression replay, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups before the shuffle (window group limit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, value, first order value, length) of runs of equal values."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(group, "_run", value).agg(F.min(order[0]).alias("first"), F.count("*").alias("length")).drop("_run")


def order_violations(rows: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """Rows whose rank is below one that came before."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("highest", F.max(rank).over(w)).where(F.col(rank) < F.col("highest"))


def lost_writes(rows: DataFrame, group: str, order: list[str], kind: str, write: str) -> DataFrame:
    """Writes followed by another write before anything else."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("next", F.lead(kind).over(w)).where((F.col(kind) == write) & (F.col("next") == write))


def suppressed(issues: Column, directives: Column, at: list[str], group: str, rows: DataFrame) -> DataFrame:
    """Issue rows with the state of the last directive before them (null: none)."""
    w = Window.partitionBy(group).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("state", F.last(directives, ignorenulls=True).over(w)).where(issues)


def debounced(rows: DataFrame, group: str, ts: str, gap: str) -> DataFrame:
    """Bursts of a group with pauses below ``gap``: (group, start, end, n)."""
    s = F.session_window(ts, gap)
    return rows.groupBy(group, s.alias("s")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end")).drop("s")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): Added, Deleted, Modified or Same from one full join."""
    a, b = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "Added").when(F.col("_b").isNull(), "Deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "Same").otherwise("Modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))
