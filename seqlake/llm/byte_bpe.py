"""Byte-level BPE encoding and decoding through a sentencepiece model serialised straight from a rank file.

Every token of the rank file becomes a piece: its bytes as printable characters, scored by its negative rank. With
identity normalisation and BPE as the model type, sentencepiece then merges the pair of lowest rank first, as the rank
file asks. Texts are cut to pre-tokens, each distinct one is encoded once while it stays in a bounded memory, and ids are decoded by the inverse of the byte mapping. A pre-token that is a token itself gets that id at once.

Defined results: a null or empty text has no ids and decodes to empty bytes; special strings are ordinary text; very long
pre-tokens take n log n; rows may repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqlake.llm.common import col
from seqlake.llm.pretokens import UNIT_PATTERN, Memory, byte_characters, split_all, splitter, units

#: Distinct units of text (of up to LONG characters) that a worker remembers.
REMEMBERED, LONG = 400_000, 64
#: The piece for unknown characters; no token can look like it, as the byte characters end at U+01FF.
UNKNOWN = "\ufffd"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, content.splitlines()))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece i + 1 is the token of i-th lowest rank.

    Fields by number, as in the public schema: 1 pieces (1 piece, 2 score, 3 type: 2 unknown), 2 trainer (3 model type:
    2 BPE, 4 vocabulary size, 40-43 ids of unknown and of the absent begin, end and padding), 3 normalizer (1 name,
    3 dummy prefix, 4 extra white space, 5 escaping: all off).
    """
    chars = byte_characters()
    pieces = [_block(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_block(1, "".join(map(chars.__getitem__, token)).encode()) + b"\x15" + struct.pack("<f", -float(rank)))
    absent = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, absent) + _number(42, absent) + _number(43, absent)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normalizer)


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece
        import tiktoken

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.by_piece = np.array([0, *sorted(ranks.values())], np.uint32)
        chars = byte_characters()
        self.mapped = {b: c for b, c in enumerate(chars)}
        back = {ord(c): b for b, c in enumerate(chars)}
        self.token = {rank: bytes(back[ord(c)] for c in self.model.id_to_piece(i + 1)) for i, rank in enumerate(self.by_piece[1:].tolist())}
        bytes_only = {bytes([b]): b for b in range(256)}

        def members(cls: str, characters: str) -> str:
            own = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=bytes_only, special_tokens={})
            return bytes(own.encode_ordinary(characters)).decode()

        self.split = splitter(pattern, members)
        self.by_units = pattern == UNIT_PATTERN
        self.memory = Memory(REMEMBERED, LONG, self._learn)

    def _learn(self, wanted: list[str]) -> list[bytes]:
        """Packed ids of each of the ``wanted`` units, all their distinct pre-tokens encoded in one call."""
        flat, counts = split_all(self.split, wanted) if self.by_units else self._split_texts(wanted)
        distinct = list(set(flat))
        raw = [p.encode() for p in distinct]
        found = list(map(self.ranks.get, raw))
        mapped = [r.decode("latin-1").translate(self.mapped) for r, rank in zip(raw, found) if rank is None]
        encoded = self.model.encode(mapped, num_threads=1) if mapped else []
        ids = self.by_piece[np.fromiter(chain.from_iterable(encoded), np.int64, sum(map(len, encoded)))].tobytes()
        ends = list(accumulate([4 * len(x) for x in encoded], initial=0))
        merged = map(ids.__getitem__, map(slice, ends[:-1], ends[1:]))
        packed = {p: next(merged) if rank is None else rank.to_bytes(4, "little") for p, rank in zip(distinct, found)}
        each = map(packed.__getitem__, flat)
        return [next(each) if n == 1 else b"".join(islice(each, n)) for n in counts]

    def _split_texts(self, texts: list[str]) -> tuple[list[str], list[int]]:
        parts = list(map(self.split, texts))
        return list(chain.from_iterable(parts)), list(map(len, parts))

    def pack_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        groups = [list(units(t)) if self.by_units else [(False, [t])] for t in texts]
        return list(map(b"".join, self.memory.look(groups)))

    def pack(self, text: str) -> bytes:
        return self.pack_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.pack(text)).cast("I"))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))


def bounded(texts: Iterator[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """``texts`` in lists of about ``most`` characters."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> ByteBPE:
    """One codec per worker process and rank file."""
    return ByteBPE(read_ranks(content), pattern)


def encode(df: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and n_tokens of each row, with the ids (array of int) if ``ids``, the decoded bytes if ``decoded``, and with
    ``digests`` the SHA-256 of the packed ids and of the decoded bytes."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(content)  # a vocabulary file, about 1 MB whatever the input
    source = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                packs, backs = [], []
                sums: list[tuple[str, str]] = []
                for pack in chain.from_iterable(map(bpe.pack_all, bounded(t.as_py() or "" for t in batch.column(1)))):
                    back = bpe.decode(pack) if digests or decoded else b""
                    if digests:
                        sums.append((hashlib.sha256(pack).hexdigest(), hashlib.sha256(back).hexdigest()))
                    packs.append(pack if ids else len(pack))
                    backs.append(back if decoded else None)
                sizes = [len(p) // 4 for p in packs] if ids else [p // 4 for p in packs]
                columns = [batch.column(0), pa.array(sizes, pa.int64())]
                if ids:
                    ends = list(accumulate(sizes, initial=0))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packs))])))
                if digests:
                    columns += [pa.array([a for a, _ in sums], pa.string()), pa.array([b for _, b in sums], pa.string())]
                if decoded:
                    columns.append(pa.array(backs, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return source.mapInArrow(run, schema)
