"""Schemas and rules that every part of the engine shares.

A *log* is a DataFrame with LOG's columns: one row for each put or delete, ``seq`` unique and rising with age. A row with
``file_no`` null has not been flushed (the fixtures mark the memtable by the highest file number instead). ``value`` is
null for deletes and never for puts; the empty value is a live value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

LOG = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("batch_id", LongType()),
        StructField("op", StringType(), False),
        StructField("key", StringType(), False),
        StructField("value", StringType()),
        StructField("file_no", LongType()),
    ]
)
ENTRY = StructType([StructField("key", StringType(), False), StructField("value", StringType()), StructField("is_tombstone", BooleanType(), False), StructField("seq", LongType(), False)])
CATALOG = StructType(
    [
        StructField("level", IntegerType(), False),
        StructField("filename", StringType(), False),
        StructField("file_size", LongType(), False),
        StructField("first_key", StringType(), False),
        StructField("last_key", StringType(), False),
        StructField("version", LongType(), False),
        StructField("entries", LongType(), False),
    ]
)

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Sizes that steer writing and maintenance."""

    # fixed values: limits of the store whose behaviour this one has

    levels: tuple[int, ...] = (8 * MIB, 32 * MIB, 256 * MIB, 1024 * MIB)
    default_level: int = 64 * MIB
    flush_entries: int = 100_000
    flush_bytes: int = MIB
    key_bytes: int = MIB
    value_bytes: int = MIB
    bloom_bits_per_key: int = 10
    kept_snapshots: int = 3
    #: About how large a segment may become; what a flush or a compaction writes beyond it is cut by key range.
    segment_bytes: int = 256 * MIB

    def level(self, k: int) -> int:
        """The most bytes of level ``k``; levels without a limit of their own have the default."""
        return self.levels[k] if k < len(self.levels) else self.default_level


LIMITS = Limits()
