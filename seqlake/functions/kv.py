"""Column functions over keys, values and records. Lengths are bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.model import LIMITS


def size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def log_bytes(op: Column, key: Column, value: Column) -> Column:
    """Size of one log record: kind, two lengths, key, value and checksum."""
    return F.lit(13) + size(key) + F.when(op == "put", size(value)).otherwise(0)


def entry_bytes(is_tombstone: Column, key: Column, value: Column) -> Column:
    """Size of one segment entry: flags, key length, key and, if live, value length and value."""
    return F.lit(5) + size(key) + F.when(is_tombstone, 0).otherwise(4 + size(value))


def little_endian(n: Column) -> Column:
    """Four bytes of a number below 2^32, least significant first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))


def log_record(op: Column, key: Column, value: Column) -> Column:
    """A log record up to its checksum, as bytes."""
    put = op == "put"
    held = F.when(put, F.coalesce(value, F.lit(""))).otherwise("")
    kind = F.when(put, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    return F.concat(kind, little_endian(size(key)), key.cast("binary"), little_endian(size(held)), held.cast("binary"))


def checksum(op: Column, key: Column, value: Column) -> Column:
    """CRC-32 of a log record."""
    return F.crc32(log_record(op, key, value))


def within_limits(key: Column, value: Column) -> Column:
    """Whether a record may be written: key of 1 byte to 1 MiB, value of up to 1 MiB."""
    return (size(key) >= 1) & (size(key) <= LIMITS.key_bytes) & (size(value) <= LIMITS.value_bytes)


def bloom_bits(n: Column) -> Column:
    """Bits of a filter for ``n`` keys."""
    return F.greatest(F.lit(64).cast("long"), F.lit(LIMITS.bloom_bits_per_key) * n.cast("long"))


def bloom_hashes(n: Column) -> Column:
    """Hash functions of a filter for ``n`` keys: ln 2 times bits per key, 1 to 30."""
    k = F.floor(F.lit(0.6931471805599453) * bloom_bits(n) / n).cast("int")
    return F.when(n == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(30), k))).cast("int")


def _halves(digest: Column, bits: Column) -> Column:
    """Two halves of an MD5, reduced."""
    half = lambda at: F.pmod(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"), bits)
    return F.struct(half(1).alias("first"), half(16).alias("step"))


def bloom_position(key: Column, i: Column, bits: Column) -> Column:
    """The ``i``-th bit of ``key``: double hashing with two halves of its MD5, reduced before they are multiplied."""
    halves = _halves(F.md5(key.cast("binary")), bits)
    return F.pmod(halves["first"] + i.cast("long") * halves["step"], bits)


def bloom_has(packed: Column, keys: Column, bits: Column, hashes: Column) -> Column:
    """Of each of the array ``keys`` whether the packed filter may contain it: array of (key, may_contain)."""

    # as the variable of a lambda a value is computed once, and a filter is not copied at each use
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def has(filter_: Column, halves: Column) -> Column:
        def bit(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(filter_, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0).cast("long"), (hashes - 1).cast("long")), lambda i: let(F.pmod(halves["first"] + i * halves["step"], bits), bit))

    def ask(filter_: Column, key: Column) -> Column:
        return F.struct(key.alias("key"), let(F.md5(key.cast("binary")), lambda digest: let(_halves(digest, bits), lambda h: has(filter_, h))).alias("may_contain"))

    return let(packed, lambda f: F.transform(keys, lambda key: ask(f, key)))
