"""Binary logs, segments and manifests of a classic log-structured store, read and written on any path that Spark reads.

    read_log(spark, "hdfs:///old/wal.log"); read_segments(spark, "s3a://old/data"); read_manifest(spark, "hdfs:///old/data")

Formats (numbers little-endian; a string is a u32 length and its bytes):

* log: put = u8 0, key, value, u32 CRC-32 of all before it in the record; delete = u8 1, key, u32 0, CRC; a batch stands
  between u8 2 and u8 3. Keys have 1 byte to 1 MiB, values up to 1 MiB. Reading ends at the first bad record.
* segment: entries (u8 flags, bit 0 for a tombstone; key; value if live), then the index (u32 n, n times key and u64
  offset), a Bloom filter (u32 size; i32 hashes, u64 bits, packed bits) and a footer (u64 index offset, u64 Bloom offset).
* manifest: u64 magic, u32 version 1, u32 levels; each level: u32 number, u32 files; each file: name, u64 size, first
  key, last key, u64 version.

Keys and values are bytes, as such files are 8-bit clean. A segment or manifest comes through Spark's ``binaryFile`` reader,
so it is one row (up to 2 GB), since a segment begins with its end. A log is read by as many tasks as Spark cuts it for, but
decoded by one, from pieces of 1 MB, since a record can only be found from the one before. Many files are decoded by many
tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seqlake.model import LIMITS
from seqlake.store import Files

# Fixed values of the formats.
PUT, DELETE, BEGIN, COMMIT = 0, 1, 2, 3
MANIFEST_MAGIC, MANIFEST_VERSION = 0x4C534D4D414E4946, 1
TOMBSTONE = 1

_U32, _U64 = struct.Struct("<I"), struct.Struct("<Q")


def _string(content: bytes) -> bytes:
    return _U32.pack(len(content)) + content


class _Cursor:
    """Reads from bytes; EOFError where they end too soon."""

    def __init__(self, content: bytes, at: int = 0, end: int | None = None):
        self.content, self.at, self.end = content, at, len(content) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise EOFError
        self.at += n
        return self.content[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def u32(self) -> int:
        return _U32.unpack(self.take(4))[0]

    def u64(self) -> int:
        return _U64.unpack(self.take(8))[0]

    def string(self) -> bytes:
        return self.take(self.u32())


def encode_op(op: str, key: bytes, value: bytes = b"") -> bytes:
    """One log record."""
    if not 1 <= len(key) <= LIMITS.key_bytes or len(value) > LIMITS.value_bytes:
        raise ValueError("keys have 1 byte to 1 MiB, values up to 1 MiB")
    body = bytes([PUT if op == "put" else DELETE]) + _string(key) + _string(value if op == "put" else b"")
    return body + _U32.pack(zlib.crc32(body))


def encode_batch(ops: list[tuple[str, bytes, bytes]]) -> bytes:
    return bytes([BEGIN]) + b"".join(encode_op(*op) for op in ops) + bytes([COMMIT])


def _gathered(parts: Iterable[bytes], least: int) -> Iterator[bytes]:
    """``parts`` in larger ones, of ``least`` bytes or more; the last may be smaller."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= least:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


#: The longest record of a log.
RECORD = 13 + LIMITS.key_bytes + LIMITS.value_bytes


def _records(content: bytes | Iterable[bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(end, kind, key, value) of each record up to the first bad one. Of ``content`` in parts, few are held at a time."""
    parts = _gathered([content] if isinstance(content, bytes) else content, RECORD)
    held, at, gone, more = b"", 0, 0, True
    while True:
        while more and len(held) - at < RECORD:  # the next record may go beyond what is held
            part = next(parts, None)
            more = part is not None
            if more:
                held, gone, at = held[at:] + part, gone + at, 0
        if at == len(held):
            return
        start, key, value = at, b"", b""
        try:
            kind = held[at]
            at += 1
            if kind in (PUT, DELETE):
                n = _U32.unpack_from(held, at)[0]
                if not 1 <= n <= LIMITS.key_bytes:
                    return
                key, at = held[at + 4 : at + 4 + n], at + 4 + n
                n = _U32.unpack_from(held, at)[0]
                if n > LIMITS.value_bytes:
                    return
                value, at = held[at + 4 : at + 4 + n], at + 4 + n
                if zlib.crc32(held[start:at]) != _U32.unpack_from(held, at)[0]:
                    return
                at += 4
            elif kind not in (BEGIN, COMMIT):
                return
        except struct.error:  # cut short
            return
        yield gone + at, kind, key, value


def decode_log(content: bytes | Iterable[bytes]) -> Iterator[tuple[int, int | None, str, bytes, bytes | None]]:
    """(seq, batch_id, op, key, value) of the longest valid prefix, operations of committed batches only.

    seq counts all operations, so it stays the same when a batch turns out to be unfinished. A batch that begins inside
    another ends that one without effect.
    """
    seq, batches, batch, waiting = 0, 0, None, []
    for _, kind, key, value in _records(content):
        if kind == BEGIN:
            batch, waiting, batches = batches, [], batches + 1
        elif kind == COMMIT:
            yield from waiting
            batch, waiting = None, []
        else:
            row = (seq, batch, "put" if kind == PUT else "del", key, value if kind == PUT else None)
            seq += 1
            if batch is None:
                yield row
            else:
                waiting.append(row)


def valid_bytes(content: bytes | Iterable[bytes]) -> int:
    """Where a log can be cut so that only whole records remain and no batch stays open."""
    end, inside = 0, False
    for at, kind, _, _ in _records(content):
        inside = kind == BEGIN or inside and kind != COMMIT
        end = end if inside else at
    return end


def encode_segment(entries: list[tuple[bytes, bytes | None]]) -> bytes:
    """A segment of (key, value), value None for a tombstone. All bits of its Bloom filter are set: "maybe" for every key."""
    data, index = bytearray(), []
    for key, value in sorted(entries, key=lambda e: e[0]):
        index.append(_string(key) + _U64.pack(len(data)))
        data += bytes([TOMBSTONE if value is None else 0]) + _string(key) + (b"" if value is None else _string(value))
    bits = max(64, LIMITS.bloom_bits_per_key * len(index))
    bloom = struct.pack("<iQ", 1, bits) + b"\xff" * -(-bits // 8)
    index_bytes = _U32.pack(len(index)) + b"".join(index)
    return bytes(data) + index_bytes + _U32.pack(len(bloom)) + bloom + _U64.pack(len(data)) + _U64.pack(len(data) + len(index_bytes))


def decode_segment(content: bytes) -> Iterator[tuple[bytes, bytes | None, bool, int]]:
    """(key, value, is_tombstone, offset) by the index, in key order."""
    if len(content) < 16:
        raise ValueError("too short for a footer")
    index_at, bloom_at = struct.unpack("<QQ", content[-16:])
    if not index_at <= bloom_at <= len(content) - 16:
        raise ValueError("offsets beyond the file")
    index = _Cursor(content, index_at, bloom_at)
    for _ in range(index.u32()):
        key, offset = index.string(), index.u64()
        entry = _Cursor(content, offset, index_at)
        gone = bool(entry.u8() & TOMBSTONE)
        if entry.string() != key:
            raise ValueError("index and data differ")
        yield key, None if gone else entry.string(), gone, offset


def encode_manifest(levels: dict[int, list[tuple[str, int, bytes, bytes, int]]]) -> bytes:
    out = [_U64.pack(MANIFEST_MAGIC), _U32.pack(MANIFEST_VERSION), _U32.pack(len(levels))]
    for level, files in sorted(levels.items()):
        out += [_U32.pack(level), _U32.pack(len(files))]
        out += [_string(name.encode()) + _U64.pack(size) + _string(first) + _string(last) + _U64.pack(version) for name, size, first, last, version in files]
    return b"".join(out)


def decode_manifest(content: bytes) -> Iterator[tuple[int, str, int, bytes, bytes, int]]:
    """(level, filename, file_size, first_key, last_key, version); ValueError if it is of another kind or cut short."""
    cursor = _Cursor(content)
    try:
        if cursor.u64() != MANIFEST_MAGIC or cursor.u32() != MANIFEST_VERSION:
            raise ValueError("no manifest of version 1")
        for _ in range(cursor.u32()):
            level = cursor.u32()
            for _ in range(cursor.u32()):
                yield level, cursor.string().decode(), cursor.u64(), cursor.string(), cursor.string(), cursor.u64()
    except EOFError:
        raise ValueError("cut short") from None


def as_log(frame: DataFrame) -> DataFrame:
    """Rows of ``read_segments`` as a log: larger file numbers are newer, and offsets tell a file's entries apart."""
    return frame.select(
        F.expr("file_no * 1099511627776 + offset").alias("seq"),  # files are far below 2^40 bytes
        F.lit(None).cast("long").alias("batch_id"),
        F.when(F.col("is_tombstone"), "del").otherwise("put").alias("op"),
        F.decode("key", "UTF-8").alias("key"),
        F.decode("value", "UTF-8").alias("value"),
        "file_no",
    )


def _decoded(spark: SparkSession, path: str, names: str, schema: str, decode: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """What ``decode`` (of path and content) yields, for each file of ``path``, a file or a directory (then those called ``names``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = iter(decode(name.as_py(), content.as_py()))
                while part := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for field, c in zip(kinds, zip(*part))], names=kinds.names)

    return files.mapInArrow(run, schema)


#: Decoded rows, and bytes of a file, that a task hands on at a time.
ROWS, PIECE = 1 << 14, 1 << 20


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """seq, batch_id, op, key, value of the valid prefix of a log.

    The reader of text takes any bytes, and cuts a file. Lines end at the first byte of a byte order mark, as it would drop
    such a mark from the start of a file. Without that byte a log is one line, and a row as long as a file at most.
    """
    schema, end = "seq long, batch_id long, op string, key binary, value binary", b"\xef"
    kinds, read = to_arrow_schema(StructType.fromDDL(schema)), spark.read.option("pathGlobFilter", "*.log")
    lines = read.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, size, start), some in groupby(rows(batches), itemgetter(0, 1, 2)):
            for place, piece in enumerate(_gathered((line + end for *_, line in some), PIECE)):
                yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "start": [start], "place": [place], "piece": [piece]})

    def content(size: int, some: Iterable[tuple]) -> Iterator[bytes]:
        for *_, piece in some:
            yield piece[:size]  # the last line may have had no end
            size -= len(piece)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, size), some in groupby(rows(batches), itemgetter(0, 1)):
            part, held = [], 0
            for row in decode_log(content(size, some)):
                part.append(row)
                held += len(row[3]) + len(row[4] or b"")
                if len(part) == ROWS or held >= 16 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for field, c in zip(kinds, zip(*part))], names=kinds.names)
                    part, held = [], 0
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for field, c in zip(kinds, zip(*part))], names=kinds.names)

    named = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = named.mapInArrow(gather, "path string, size long, start long, place long, piece binary")
    return pieces.repartition("path").sortWithinPartitions("path", "start", "place").mapInArrow(decode, schema)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """file_no, key, value, is_tombstone, offset of all segments of a directory; file_no is null where a name is no number."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        stem = PurePosixPath(name).stem
        number = int(stem) if stem.isdigit() else None
        return ((number, *row) for row in decode_segment(content))

    return _decoded(spark, path, "*.sst", "file_no long, key binary, value binary, is_tombstone boolean, offset long", rows)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """level, filename, file_size, first_key, last_key, version of the manifest that CURRENT names."""
    name = Files(spark, folder).read(f"{folder}/CURRENT").strip()
    return _decoded(spark, f"{folder}/{name}", name, "level int, filename string, file_size long, first_key binary, last_key binary, version long", lambda _, content: decode_manifest(content))


#: The most bytes that a task holds while it looks for a file's last byte.
HELD = 1 << 28
_RARE = "the last byte is too rare"


def _lines(pieces: Iterable[bytes], last: bytes, held: int | None = None) -> Iterator[bytes]:
    """What ``pieces`` are together, as lines that each lack ``last``, the byte at their end; ValueError if more than ``held``
    bytes come without it."""
    kept, size = [], 0
    for piece in pieces:
        at = piece.rfind(last)
        if at >= 0:
            yield b"".join([*kept, piece[:at]])
            piece, kept, size = piece[at + 1 :], [], 0
        kept.append(piece)
        size += len(piece)
        if held is not None and size > held:
            raise ValueError(_RARE)
    if size:
        raise ValueError("the last byte is another")


def _write_lines(lines: DataFrame, folder: str, last: bytes, *by: str) -> None:
    """One file of ``folder`` (for each value of ``by``) from each task.

    The writer of text is Spark's only one that adds no format of its own. It takes any bytes, but ends each line with a
    separator; so this is the byte that the files end with anyhow, and lines are cut where it stands.
    """
    writer = lines.withColumn("line", F.col("line").cast("string")).write.mode("overwrite").partitionBy(*by)
    writer.option("lineSep", last.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 0).text(folder)


def write_log(log: DataFrame, path: str, committed: DataFrame | None = None) -> None:
    """``log`` as one binary log, in order of seq; a batch stands between its marks, the closing one only if ``committed``
    (batch_id) lists it or is None.

    Tasks encode blocks of seq; one task puts them into the file one after another, as a log is one file. The driver gets
    the newest row alone.
    """
    width, held = 1 << 14, HELD
    files = Files(log.sparkSession, path)
    done = log.select("batch_id").where("batch_id is not null").distinct() if committed is None else committed
    newest = log.agg(F.max_by(F.struct("batch_id", "op", "key", "value"), "seq").alias("row")).first()["row"]
    if newest is None:
        files.write(path, [])
        return
    closed = newest["batch_id"] is not None and not done.where(F.col("batch_id") == newest["batch_id"]).isEmpty()
    last = bytes([COMMIT]) if closed else encode_op(newest["op"], newest["key"].encode(), (newest["value"] or "").encode())[-1:]
    known = log.join(done.select(F.col("batch_id").alias("done_id")), F.col("batch_id") == F.col("done_id"), "left")
    # a mark stands where the batch changes: before the first row of a batch, and after its last
    whole = log.where("batch_id is not null").groupBy("batch_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    marked = known.join(whole, "batch_id", "left").select("seq", "op", "key", "value", (F.col("seq") == F.col("first")).alias("opens"), ((F.col("seq") == F.col("last")) & F.col("done_id").isNotNull()).alias("closes"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = lambda at, out: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bytes(out)], pa.binary())], names=["seq", "content"])
        block, at, out = None, None, bytearray()
        for batch in batches:
            for now, seq, op, key, value, opens, closes in zip(*(c.to_pylist() for c in batch.columns)):
                if out and (now != block or len(out) >= PIECE):  # the next block of the task need not be the next of the log
                    yield piece(at, out)
                    out = bytearray()
                if not out:
                    block, at = now, seq
                out += bytes([BEGIN]) * bool(opens) + encode_op(op, key.encode(), (value or "").encode()) + bytes([COMMIT]) * bool(closes)
        if out:
            yield piece(at, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines((c.as_py() for batch in batches for c in batch.column(0)), last, held):
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["line"])

    blocks = marked.select(F.expr(f"seq div {width}").alias("block"), "*").repartition("block").sortWithinPartitions("seq").mapInArrow(encode, "seq long, content binary")
    folder = path + ".parts"
    try:
        _write_lines(blocks.repartition(1).sortWithinPartitions("seq").select("content").mapInArrow(cut, "line binary"), folder, last)
        part = next(n for n in files.names(folder) if n.startswith("part-"))
        files.replace(f"{folder}/{part}", path)
    except PythonException as e:
        if _RARE not in str(e):
            raise
        # a line would be too long for a row: the driver puts the pieces together
        files.write(path, (bytes(r["content"]) for r in blocks.orderBy("seq").toLocalIterator()))
    finally:
        files.remove(folder)


def write_segments(entries: DataFrame, folder: str) -> None:
    """One file of ``folder`` for each file_no of ``entries`` (file_no, key, value, is_tombstone); a segment must fit in memory.

    Tasks write them; the driver gives them their names.
    """
    last = b"\0"  # a segment ends with the high byte of an offset

    def encode(number: tuple, table: pa.Table) -> pa.Table:
        content = encode_segment([(r["key"].encode(), None if r["is_tombstone"] else r["value"].encode()) for r in table.to_pylist()])
        lines = list(_lines((content[at : at + PIECE] for at in range(0, len(content), PIECE)), last))
        return pa.table({"file_no": pa.array([number[0].as_py()] * len(lines), pa.int64()), "place": pa.array(range(len(lines)), pa.int64()), "line": pa.array(lines, pa.binary())})

    files, parts = Files(entries.sparkSession, folder), f"{folder}/parts.tmp"
    lines = entries.groupBy("file_no").applyInArrow(encode, "file_no long, place long, line binary")
    try:
        _write_lines(lines.sortWithinPartitions("file_no", "place").select("file_no", "line"), parts, last, "file_no")
        for name in files.names(parts):
            if name.startswith("file_no="):
                part = next(n for n in files.names(f"{parts}/{name}") if n.startswith("part-"))
                number = name.partition("=")[2]
                files.replace(f"{parts}/{name}/{part}", f"{folder}/{number if number.lstrip('-').isdigit() else None}.sst")
    finally:
        files.remove(parts)


def write_manifest(spark: SparkSession, folder: str, levels: dict[int, list[tuple[str, int, bytes, bytes, int]]], number: int = 1) -> None:
    """A manifest of ``levels``, and CURRENT, which names it."""
    files = Files(spark, folder)
    files.write(f"{folder}/MANIFEST-{number}", [encode_manifest(levels)])
    files.write(f"{folder}/CURRENT", f"MANIFEST-{number}\n")
