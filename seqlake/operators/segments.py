"""Segments: their entries, index offsets, sizes, metadata and Bloom filters, as queries over a log with ``file_no``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions.kv import bloom_bits, bloom_has, bloom_hashes, bloom_position, entry_bytes, size
from seqlake.operators.levels import CATALOG_ROWS, meeting


def entries(log: DataFrame) -> DataFrame:
    """file_no, key, value, is_tombstone, seq: the newest row of each key within each segment."""
    held = F.struct("value", (F.col("op") == "del").alias("is_tombstone"))
    newest = log.groupBy("file_no", "key").agg(F.max_by(held, F.col("seq")).alias("e"), F.max("seq").alias("seq"))
    return newest.select("file_no", "key", "e.value", "e.is_tombstone", "seq")


def index_offsets(log: DataFrame) -> DataFrame:
    """file_no, key, offset: the bytes of the entries before each key. A segment's size is bounded when it is flushed."""
    before = Window.partitionBy("file_no").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sized = entries(log).select("file_no", "key", entry_bytes(F.col("is_tombstone"), F.col("key"), F.col("value")).alias("entry_bytes"))
    return sized.withColumn("offset", F.coalesce(F.sum("entry_bytes").over(before), F.lit(0)))


def file_sizes(log: DataFrame) -> DataFrame:
    """file_no, entries, file_size: entries, index, Bloom filter and footer."""
    sums = entries(log).groupBy("file_no").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(entry_bytes(F.col("is_tombstone"), F.col("key"), F.col("value"))).alias("data_bytes"),
        F.sum(12 + size(F.col("key"))).alias("index_bytes"),
    )
    bloom = F.lit(16) + F.ceil(bloom_bits(F.col("entries")) / 8)
    return sums.select("file_no", "entries", (F.col("data_bytes") + 4 + F.col("index_bytes") + bloom + 16).cast("long").alias("file_size"))


def metadata(log: DataFrame) -> DataFrame:
    """file_no, first_key, last_key, entries, live_entries of each segment."""
    return entries(log).groupBy("file_no").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.sum((~F.col("is_tombstone")).cast("long")).alias("live_entries")
    )


def next_number(catalog: DataFrame, column: str = "file_no") -> DataFrame:
    """One row: the number of the next segment, 0 for an empty catalog."""
    return catalog.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).cast("long").alias("next_file_no"))


def bloom_params(log: DataFrame) -> DataFrame:
    """file_no, entries, bits, hashes of each segment's filter."""
    counted = log.groupBy("file_no").agg(F.count_distinct("key").alias("entries"))
    return counted.select("file_no", "entries", bloom_bits(F.col("entries")).alias("bits"), bloom_hashes(F.col("entries")).alias("hashes"))


def _positions(keyed: DataFrame) -> DataFrame:
    """``keyed`` (file_no, key, bits, hashes) with one row for each hash: position."""
    each = keyed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hashes") - 1)))
    return each.withColumn("position", bloom_position(F.col("key"), F.col("i"), F.col("bits"))).drop("i")


def bloom_filters(log: DataFrame) -> DataFrame:
    """file_no, position: the bits that are set. Deleted keys count, as a tombstone has to be found."""
    keyed = log.select("file_no", "key").distinct().join(bloom_params(log), "file_no")
    return _positions(keyed).select("file_no", "position").distinct()


def bloom_packed(log: DataFrame) -> DataFrame:
    """file_no, hashes, bits, packed: each filter as bytes, the least significant bit first."""
    params = bloom_params(log)
    held = bloom_filters(log).groupBy("file_no", F.expr("position div 8").alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(position % 8 as int))")).alias("value"))
    every = params.select("file_no", "hashes", "bits", F.explode(F.expr("sequence(0L, (bits + 7) div 8 - 1)")).alias("byte"))
    digits = F.lpad(F.hex(F.coalesce("value", F.lit(0))), 2, "0")
    rows = every.join(held, ["file_no", "byte"], "left").select("file_no", "hashes", "bits", "byte", digits.alias("digits"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("byte", "digits"))), lambda b: b["digits"])
    return rows.groupBy("file_no", "hashes", "bits").agg(F.unhex(F.array_join(packed, "")).alias("packed"))


def bloom_unpacked(packed: DataFrame) -> DataFrame:
    """file_no, position: the bits that are set in filters of ``bloom_packed``."""
    byte = F.conv(F.hex(F.substring("packed", F.expr("cast(position div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    each = packed.select("file_no", "packed", F.explode(F.expr("sequence(0L, bits - 1)")).alias("position"))
    return each.where(F.getbit(byte, (F.col("position") % 8).cast("int")) == 1).select("file_no", "position")


def candidates(keys: DataFrame, catalog: DataFrame, at_once: int = CATALOG_ROWS) -> DataFrame:
    """file_no, key for each of ``keys`` (key) and each file of ``catalog`` (file_no, first_key, last_key) whose range holds it."""
    points = keys.select(F.col("key").alias("name"), F.col("key").alias("first_key"), F.col("key").alias("last_key")).where("name is not null").distinct()
    return meeting(points, catalog, at_once).select("file_no", F.col("name").alias("key"))


def bloom_probe(log: DataFrame, keys: DataFrame, block: int = 4096) -> DataFrame:
    """file_no, key, may_contain for each of ``keys`` and each segment whose key range holds it.

    Key ranges prune first; then a filter meets ``block`` keys at a time, and bits are tested in it, where they are.
    """
    asked = candidates(keys, metadata(log))
    sizes = asked.groupBy("file_no").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = asked.join(sizes, "file_no").groupBy("file_no", F.pmod(F.xxhash64("key"), "blocks").alias("block")).agg(F.collect_list("key").alias("keys"))
    met = dealt.join(bloom_packed(log), "file_no")
    return met.select("file_no", F.explode(bloom_has(F.col("packed"), F.col("keys"), F.col("bits"), F.col("hashes"))).alias("e")).select("file_no", "e.key", "e.may_contain")
