"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch lie one after another in one array of symbols. In each step every sequence finds
its pair of lowest rank, all sequences merge their own pair at once, at each of its places from left to right, and
sequences without a pair drop out. The symbols that survive are the tokens. As no merge makes a pair of lower rank
than its own (checked when the merges are read), this gives what merging one place at a time gives.

A step looks at every symbol that is left, so a sequence of n symbols would take up to n x n. Sequences of more than SHORT
bytes are therefore merged by a queue: places wait by the rank of their pair, the lowest rank of all comes next, its
places merge at once in whichever sequences they are, and only the pairs beside them are looked up anew. That is the same
order for each sequence, and takes n log n whatever the length.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token; a pre-token
of any length is merged whole; rows may repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import col
from seqlake.llm.pretokens import UNIT_PATTERN, Memory, byte_characters, split_all, splitter, units

#: Distinct units of text (of up to LONG characters) that a worker remembers, and symbols merged at a time.
REMEMBERED, LONG, SYMBOLS = 400_000, 64, 1 << 18
#: Bytes up to which pre-tokens are merged step by step; the number of steps is below it.
SHORT = 128


class RankMerger:
    """Counts the tokens that a byte-level BPE model in a tokenizers JSON file gives."""

    def __init__(self, content: str, pattern: str):
        from tokenizers import Regex, pre_tokenizers

        spec = json.loads(content)
        before = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE without a prefix space is counted")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made: dict[int, int] = {}
        left, right, out = (np.empty(len(merges), np.int64) for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            left[rank], right[rank], out[rank] = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(vocab[a], -1), made.get(vocab[b], -1)) >= rank or made.setdefault(vocab[a + b], rank) != rank:
                raise ValueError(f"merge {rank} doesn't follow the merges of its parts")
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.rank, self.out = keys[order], order, out
        self.byte = np.array([vocab[c] for c in byte_characters()], np.int64)
        added = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbours along aren't counted")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None

        def members(cls: str, characters: str) -> str:
            kept = pre_tokenizers.Split(Regex(cls), "removed").pre_tokenize_str(characters)
            return "".join(sorted(set(characters).difference(*(set(part) for part, _ in kept))))

        self.split = splitter(pattern, members)
        self.by_units = pattern == UNIT_PATTERN
        self.memory = Memory(REMEMBERED, LONG, self.learn)

    def _ranks(self, symbols: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; len(merges) where there is none."""
        none = len(self.keys)
        ranks = np.full(len(symbols), none, np.int64)
        at = np.flatnonzero(inner)
        pairs = symbols[at] * self.base + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
        ranks[at] = np.where(self.keys[found] == pairs, self.rank[found], none)
        return ranks

    def merge(self, pretokens: list[bytes]) -> np.ndarray:
        """How many symbols survive in each of the non-empty ``pretokens``."""
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        if not len(self.keys):
            return lengths
        counts = np.empty(len(pretokens), np.int64)
        for where, way in ((lengths <= SHORT, self._step), (lengths > SHORT, self._queue)):
            at = np.flatnonzero(where)
            if len(at):
                counts[at] = way([pretokens[k] for k in at.tolist()], lengths[at])
        return counts

    def _queue(self, pretokens: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """``merge`` by a queue of ranks; after each sequence lies one symbol that has no pair."""
        none = len(self.keys)
        ends = np.cumsum(lengths + 1)
        symbols = np.empty(ends[-1], np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = self.byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        symbols[~inside] = -1
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        ranks = self._ranks(symbols, np.append(inside[:-1] & inside[1:], False))
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            """``places`` join the queue by rank; those without a pair don't."""
            places = places[ranks[places] < none]
            if len(places) == 0:
                return
            places = places[np.argsort(ranks[places], kind="stable")]
            own = ranks[places]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for rank, part in zip(own[starts].tolist(), np.split(places, starts[1:])):
                if rank not in waiting:
                    waiting[rank] = []
                    heappush(queue, rank)
                waiting[rank].append(part)

        wait(np.arange(len(symbols)))
        counts = lengths.copy()
        owner = np.repeat(np.arange(len(pretokens)), lengths + 1)
        while queue:
            rank = heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[ranks[places] == rank]  # others have got another pair meanwhile
            if len(places) == 0:
                continue
            # of overlapping places (a run of one symbol) every other one counts, from the left
            follows = np.append(False, after[places[:-1]] == places[1:])
            if follows.any():
                begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - begin) % 2 == 0]
            gone = after[places]
            symbols[places] = self.out[rank]
            ranks[gone] = none
            after[places] = after[gone]
            before[after[places]] = places
            np.subtract.at(counts, owner[places], 1)
            touched = np.concatenate((places, before[places]))
            touched = touched[touched >= 0]
            right = after[touched]
            paired = (symbols[touched] >= 0) & (symbols[right] >= 0)
            new = np.full(len(touched), none, np.int64)
            pairs = symbols[touched[paired]] * self.base + symbols[right[paired]]
            found = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            new[paired] = np.where(self.keys[found] == pairs, self.rank[found], none)
            ranks[touched] = new
            wait(touched)
        return counts

    def _step(self, pretokens: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """``merge`` step by step over all symbols."""
        counts = lengths.copy()
        symbols = self.byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        none = len(self.keys)
        while len(symbols):
            first = np.empty(len(symbols), bool)
            first[0], first[1:] = True, owner[1:] != owner[:-1]
            inner = np.append(~first[1:], False)
            ranks = self._ranks(symbols, inner)
            starts = np.flatnonzero(first)
            sequence = np.cumsum(first) - 1
            best = np.minimum.reduceat(ranks, starts)[sequence]
            alive = best < none
            hit = alive & (ranks == best)
            # of overlapping places (a run of one symbol) every other one counts, from the left
            places = np.flatnonzero(hit)
            follows = np.append(False, places[1:] == places[:-1] + 1) if len(places) else np.zeros(0, bool)
            if follows.any():
                begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - begin) % 2 == 0]
            symbols[places] = self.out[ranks[places]]
            keep = alive.copy()
            keep[places + 1] = False
            counts -= np.bincount(owner[places], minlength=len(counts))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, wanted: list[str]) -> list[int]:
        """Token counts of the ``wanted`` units; their distinct pre-tokens are merged about SYMBOLS at a time."""
        if self.by_units:
            flat, counts = split_all(self.split, wanted)
        else:
            parts = list(map(self.split, wanted))
            flat, counts = list(chain.from_iterable(parts)), list(map(len, parts))
        sizes: dict[str, int] = {}
        group: list[bytes] = []
        size, distinct = 0, sorted(set(flat), key=len)
        for k, p in enumerate(distinct, 1):
            group.append(p.encode())
            size += len(p)
            if size >= SYMBOLS or k == len(distinct):
                sizes.update(zip(distinct[len(sizes) : k], self.merge(group).tolist()))
                group, size = [], 0
        each = map(sizes.__getitem__, flat)
        return [next(each) if n == 1 else sum(islice(each, n)) for n in counts]

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self.special.split(t) if self.special else [t] for t in texts]
        groups = [[g for piece in ps for g in (units(piece) if self.by_units else [(False, [piece])])] for ps in pieces]
        return [len(ps) - 1 + sum(known) for ps, known in zip(pieces, self.memory.look(groups))]


@lru_cache(maxsize=2)
def merger(content: str, pattern: str) -> RankMerger:
    return RankMerger(content, pattern)


def count_tokens(df: DataFrame, content: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``content`` is the tokenizers JSON."""
    shared = df.sparkSession.sparkContext.broadcast(content)  # a vocabulary file, under 2 MB whatever the input
    source = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(shared.value, pattern)
        for batch in batches:
            counts: list[int] = []
            part: list[str] = []
            size = 0
            for text in batch.column(1):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size >= SYMBOLS:
                    counts += counter.count(part)
                    part, size = [], 0
            counts += counter.count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    source = source.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
