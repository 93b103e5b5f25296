"""The log before it is flushed: record sizes, checksums, the valid prefix, batches, replay and flush points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions.kv import checksum, log_bytes, within_limits
from seqlake.model import LIMITS
from seqlake.operators.reads import committed, latest


def record_sizes(log: DataFrame) -> DataFrame:
    return log.withColumn("record_bytes", log_bytes(F.col("op"), F.col("key"), F.col("value")))


def checksums(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", checksum(F.col("op"), F.col("key"), F.col("value")))


def valid(log: DataFrame, intact: Column | None = None) -> Column:
    """Whether a record can be replayed: sizes within limits and, if given, its checksum ``intact``."""
    fine = within_limits(F.col("key"), F.col("value"))
    return fine if intact is None else fine & intact


def valid_prefix(log: DataFrame, intact: Column | None = None) -> DataFrame:
    """The rows before the first bad one, by seq.

    The first bad seq is one aggregate, so no global order is needed.
    """
    first = log.where(~F.coalesce(valid(log, intact), F.lit(False))).agg(F.min("seq").alias("first_bad"))
    return log.where(F.coalesce(F.col("seq") < first.scalar(), F.lit(True)))


def quarantine(log: DataFrame, intact: Column | None = None) -> DataFrame:
    """The rows that ``valid_prefix`` leaves out."""
    first = log.where(~F.coalesce(valid(log, intact), F.lit(False))).agg(F.min("seq").alias("first_bad"))
    return log.where(F.coalesce(F.col("seq") >= first.scalar(), F.lit(False)))


def replay(log: DataFrame, batches: DataFrame | None = None, intact: Column | None = None) -> DataFrame:
    """What recovery finds: the newest rows of the valid prefix, committed batches only, deletes included."""
    return latest(committed(valid_prefix(log, intact), batches))


def running_sum(rows: DataFrame, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` up to and including each row by ``order`` (a whole number).

    Sums of blocks of ``width`` orders meet in one window; rows only meet those of their block.
    """
    blocked = rows.withColumn("_block", F.expr(f"`{order}` div {width}"))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.join(offsets, "_block").withColumn(out, F.col("_before") + F.sum(value).over(within))
    return joined.drop("_block", "_before")


def checkpoint_segments(log: DataFrame, limit: int = LIMITS.flush_bytes) -> DataFrame:
    """The segment that each row falls into when the log is cut every ``limit`` bytes.

    This form has no memory of where the last cut fell, so it needs no sequential pass; ``Store`` cuts exactly.
    """
    summed = running_sum(record_sizes(log), "seq", "record_bytes", "log_bytes")
    return summed.withColumn("segment_no", F.expr(f"(log_bytes - record_bytes) div {limit}"))
