"""Reading a log: newest version of each key, lookups, scans, membership. All pure DataFrame to DataFrame.

Filters on ``key`` stand below the aggregation in the optimised plan and reach the Parquet scan, as the key is what is
grouped by; filters on tombstones stay above it, so a delete always hides older values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a lookup up to which they travel as an IN list or a broadcast.
BROADCAST_KEYS = 100_000


def committed(log: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Rows outside batches, and rows of batches that ``batches`` (batch_id) lists as committed."""
    if batches is None:
        return log
    inside = log.where("batch_id is not null").join(batches.select("batch_id"), "batch_id", "left_semi")
    return inside.unionByName(log.where("batch_id is null"))


def latest(log: DataFrame, *extra: str) -> DataFrame:
    """key, value, is_tombstone, seq (and ``extra`` columns) of the newest row of each key.

    A partial arg-max runs before the shuffle, so a hot key moves one row for each task.
    """
    held = F.struct("value", (F.col("op") == "del").alias("is_tombstone"), *extra)
    newest = log.groupBy("key").agg(F.max_by(held, F.col("seq")).alias("e"), F.max("seq").alias("seq"))
    return newest.select("key", "e.value", "e.is_tombstone", "seq", *[f"e.{c}" for c in extra])


def live(log: DataFrame, *extra: str) -> DataFrame:
    """The newest version of each key that is not deleted."""
    return latest(log, *extra).where(~F.col("is_tombstone")).drop("is_tombstone")


def get(log: DataFrame, key: str) -> DataFrame:
    """The live row of one key, or none; a tombstone ends the search."""
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame | Sequence[str]) -> DataFrame:
    """The live rows of many keys: pushed down as a list while they are few, else by a semi-join before aggregation."""
    return live(_only(log, keys))


def _only(log: DataFrame, keys: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(keys, DataFrame):
        return log.join(keys.select("key").distinct(), "key", "left_semi")
    listed = list(dict.fromkeys(keys))
    if len(listed) <= 1000:
        return log.where(F.col("key").isin(listed)) if listed else log.where(F.lit(False))
    frame = log.sparkSession.createDataFrame([(k,) for k in listed], "key string")
    return log.join(F.broadcast(frame) if len(listed) <= BROADCAST_KEYS else frame, "key", "left_semi")


def provenance(log: DataFrame, memtable: Column) -> DataFrame:
    """Live rows with ``origin``: memtable or segment. ``memtable`` is a condition on ``file_no``."""
    return live(log, "file_no").withColumn("origin", F.when(memtable, "memtable").otherwise("segment")).drop("file_no")


def contains(log: DataFrame, keys: DataFrame | Sequence[str]) -> DataFrame:
    """Those of ``keys`` that have any version, deleted ones included."""
    return _only(log, keys).select("key").distinct()


def scan(log: DataFrame, start: str, end: str) -> DataFrame:
    """Live rows with start <= key <= end (bytewise) in key order; none if start > end."""
    return live(log.where(F.col("key").between(start, end))).orderBy("key")


def for_each(log: DataFrame, tombstones: bool = False) -> DataFrame:
    """All newest rows in key order."""
    return (latest(log) if tombstones else live(log)).orderBy("key")


def count_keys(log: DataFrame) -> DataFrame:
    """One row: the number of distinct keys, deleted ones included."""
    return log.agg(F.count_distinct("key").alias("keys"))


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return latest(log).where("is_tombstone").select("key", "seq")


def merge(sources: Sequence[DataFrame], drop_deleted: bool = True) -> DataFrame:
    """Newest-wins merge of logs given newest first: age decides, then seq within one source."""
    tagged = [s.withColumn("age", F.lit(k)) for k, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    held = F.struct("value", (F.col("op") == "del").alias("is_tombstone"), "seq")
    newest = both.groupBy("key").agg(F.max_by(held, F.struct(-F.col("age"), F.col("seq"))).alias("e")).select("key", "e.value", "e.is_tombstone", "e.seq")
    return newest.where(~F.col("is_tombstone")) if drop_deleted else newest
