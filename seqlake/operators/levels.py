"""Levels: statistics, key-range overlap, the choice of what to compact, islands, and newest-wins compaction."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.model import LIMITS, Limits
from seqlake.operators.reads import latest

#: Catalog rows (some 100 bytes each) that are broadcast at a time.
CATALOG_ROWS = 200_000


def limits_frame(log: DataFrame, limits: Limits = LIMITS, levels: int | None = None) -> DataFrame:
    """level, limit_bytes of all levels."""
    n = levels or len(limits.levels)
    return log.sparkSession.createDataFrame([(k, limits.level(k)) for k in range(n)], "level int, limit_bytes long")


def statistics(catalog: DataFrame, limits: DataFrame) -> DataFrame:
    """level, files, bytes, limit_bytes, exceeds for every level, empty ones included; the last level never exceeds."""
    sums = catalog.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    joined = limits.join(sums, "level", "left").select("level", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "limit_bytes")
    return joined.withColumn("exceeds", F.col("bytes") > F.col("limit_bytes"))


def meets(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Whether the key ranges [a, b] and [start, end] share a key."""
    return (a <= end) & (start <= b)


def overlapping(catalog: DataFrame, level: int, start: str, end: str) -> DataFrame:
    """Files of ``level`` whose range meets [start, end]."""
    return catalog.where((F.col("level") == level) & meets(F.col("first_key"), F.col("last_key"), F.lit(start), F.lit(end)))


def find(catalog: DataFrame, key: str) -> DataFrame:
    """Files, of all levels, that can hold ``key``."""
    return catalog.where((F.col("first_key") <= key) & (F.col("last_key") >= key))


def meeting(ranges: DataFrame, catalog: DataFrame, at_once: int = CATALOG_ROWS) -> DataFrame:
    """file_no, name for each of ``ranges`` (name, first_key, last_key) and each file of ``catalog`` that shares a key with it.

    The catalog is handed to the tasks in parts of at most ``at_once`` rows, ordered by first key, and each range is looked
    up in it by bisection: ranges and files never meet in pairs.
    """
    spark, kind = ranges.sparkSession, ranges.schema["name"].dataType.simpleString()
    ordered = catalog.select("first_key", "last_key", F.col("file_no").cast("long").alias("file_no")).orderBy("first_key", "file_no").toLocalIterator()
    ranges = ranges.select("name", "first_key", "last_key")
    found = spark.createDataFrame([], f"file_no long, name {kind}")
    while part := list(islice(ordered, at_once)):
        firsts, lasts = ([r[c].encode() for r in part] for c in ("first_key", "last_key"))
        # the farthest key that a file up to this one reaches: where that is behind, no file before can meet the range
        shared = spark.sparkContext.broadcast((firsts, lasts, list(accumulate(lasts, max)), [r["file_no"] for r in part]))

        def look(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            firsts, lasts, reach, numbers = shared.value
            for batch in batches:
                rows, files = [], []
                for row, (first, last) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    first, at = first.encode(), bisect_right(firsts, last.encode()) - 1
                    while at >= 0 and reach[at] >= first:
                        if lasts[at] >= first:
                            rows.append(row)
                            files.append(numbers[at])
                        at -= 1
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["file_no", "name"])

        found = found.unionByName(ranges.mapInArrow(look, f"file_no long, name {kind}"))
    return found


def overlaps(catalog: DataFrame, upper: int = 0, lower: int = 1) -> DataFrame:
    """upper_file, lower_file for each pair of files of two levels whose ranges meet."""
    above = catalog.where(F.col("level") == upper).select(F.col("file_no").alias("name"), "first_key", "last_key")
    return meeting(above, catalog.where(F.col("level") == lower)).select(F.col("name").alias("upper_file"), F.col("file_no").alias("lower_file"))


def overlap_counts(catalog: DataFrame) -> DataFrame:
    """file_no, n_overlaps of each level-0 file with level 1."""
    first = catalog.where("level = 0").select("file_no")
    counts = overlaps(catalog).groupBy("upper_file").agg(F.count(F.lit(1)).alias("n"))
    return first.join(counts, F.col("file_no") == F.col("upper_file"), "left").select("file_no", F.coalesce("n", F.lit(0)).cast("long").alias("n_overlaps"))


def pick(catalog: DataFrame) -> DataFrame:
    """The level-0 file with the most overlaps, the lowest number on ties."""
    return overlap_counts(catalog).orderBy(F.desc("n_overlaps"), "file_no").limit(1)


def islands(catalog: DataFrame, level: int = 1) -> DataFrame:
    """file_no, first_key, last_key, island: files of a level in chains of overlapping ranges, numbered by key from 0."""
    by_key = Window.partitionBy("level").orderBy("first_key", "last_key", "file_no")
    reach = F.max("last_key").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    marked = catalog.where(F.col("level") == level).withColumn("break", F.when(reach >= F.col("first_key"), 0).otherwise(1))
    return marked.withColumn("island", (F.sum("break").over(by_key) - 1).cast("long")).select("file_no", "first_key", "last_key", "island")


def merge_islands(entries: DataFrame, catalog: DataFrame, level: int = 1) -> DataFrame:
    """island, files, key, value, is_tombstone, seq: newest-wins merge of the files of each island of ``level``.

    ``entries`` has file_no, key, value, op and seq. An island's files share keys with no other island, so each island is
    merged by itself, and what lies in one file only is merged with nothing.
    """
    placed = islands(catalog, level).withColumn("files", F.count(F.lit(1)).over(Window.partitionBy("island"))).select("file_no", "island", "files")
    held = F.struct("value", (F.col("op") == "del").alias("is_tombstone"))
    newest = entries.join(placed, "file_no").groupBy("island", "files", "key").agg(F.max_by(held, F.col("seq")).alias("e"), F.max("seq").alias("seq"))
    return newest.select("island", "files", "key", "e.value", "e.is_tombstone", "seq")


def compact(log: DataFrame, merged: Column, older: Column | None = None) -> DataFrame:
    """The rows that compacting the files of condition ``merged`` writes: newest version of each key.

    A tombstone is dropped unless a file of condition ``older``, outside the merge and older than it, holds its key;
    without ``older`` nothing lies below and all tombstones go.
    """
    newest = latest(log.where(merged))
    alive, dead = newest.where(~F.col("is_tombstone")), newest.where("is_tombstone")
    if older is None:
        return alive
    return alive.unionByName(dead.join(log.where(older).select("key").distinct(), "key", "left_semi"))
