"""Near duplicates by SimHash fingerprints and deletion-variant signatures.

Fingerprints of 64 bits that differ in 3 bits or fewer are linked. Cut into 2 segments, one of the two differs by at
most one bit; so each fingerprint is indexed under each segment itself and under the segment with each one bit made a
wildcard, equal index keys are joined, and full fingerprints are compared. A key that holds many fingerprints is cut
again in the same way over its remaining segment (32, 16, 8, then 4 bits), which loses no link: of at most 3 differing
bits in the rest, again one half holds at most one. The last cut leaves at most 256 fingerprints to a key. Each bucket
reports a spanning forest of its links, never all pairs, and star contraction joins the forests to components.

Defined results: null, empty and white-space-only texts have fingerprint zero and are linked like any other; null
doc_ids take part and a component of null doc_ids only has component_id null; repeated rows are one class; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import col, cut, fresh, nothing
from seqlake.llm.components import connected_components

_LANES = np.uint64(0x0101010101010101)
SEED = 42
#: Buckets up to this size are compared within; larger ones are cut again.
BUCKET = 128
#: Fingerprints whose variants one task makes.
SPREAD = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text; zero if it has no word."""
    tokens = text.lower().split()  # on bytes: only A-Z, and only the six ASCII white-space bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(tokens) - shingle + 1)
    stops = (ends[shingle - 1 :] if len(tokens) >= shingle else ends[-1:]) - 1
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), stops.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    # byte lanes hold up to 255 ones each, so 255 hashes are summed at a time
    rows = -(-n // 255)
    if rows * 255 != n:
        hashes = np.concatenate((hashes, np.zeros(rows * 255 - n, np.uint64)))
    hashes = hashes.reshape(rows, 255)
    ones = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((hashes >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        ones[:, bit] = lanes.view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones.ravel() * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def forest(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest, as places, of the links between ``members`` that differ in ``most`` bits or fewer."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= most
    left, edges = set(range(len(members))), []
    while left:
        front = [left.pop()]
        while front:
            at = front.pop()
            found = [x for x in np.flatnonzero(near[at]).tolist() if x in left]
            left.difference_update(found)
            front += found
            edges += [(at, x) for x in found]
    return edges


def _bucket_links(most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            a, b = values[two], values[two + 1]
            linked = np.bitwise_count(a ^ b) <= most
            left, right = [a[linked]], [b[linked]]
            for k in np.flatnonzero(sizes > 2):
                members = values[offsets[k] : offsets[k + 1]]
                if edges := forest(members, most):
                    x, y = zip(*edges)
                    left.append(members[list(x)])
                    right.append(members[list(y)])
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _variants(rows: DataFrame) -> DataFrame:
    """The index keys of one cut: (path, shift, width) of the key's remaining bits, fp, key and the wildcard's bit."""
    half = rows.select("*", F.expr("width div 2").cast("int").alias("half"))
    # codes 0..half-1: that bit is a wildcard; code half: the segment itself; then the same for the upper segment
    coded = half.select("*", F.explode(F.expr("sequence(0, 2 * half + 1)")).alias("code"))
    coded = coded.select("path", "shift", "half", "fp", "code", F.expr("code div (half + 1)").cast("int").alias("upper"), F.expr("code % (half + 1)").alias("place"))
    coded = coded.select("*", F.expr("shiftrightunsigned(fp, shift + upper * half) & (shiftleft(1L, half) - 1)").alias("segment"))
    wild = "place < half"
    return coded.select(
        "path",
        F.expr("shift + (1 - upper) * half").alias("shift"),
        F.col("half").alias("width"),
        "fp",
        F.expr(f"shiftleft(cast(code as long), 32) | (case when {wild} then segment & ~shiftleft(1L, place) else segment end)").alias("key"),
        F.expr(f"case when {wild} then cast(shiftrightunsigned(segment, place) & 1 as int) end").alias("bit"),
    )


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n``, dealt to tasks by what they grow to: each becomes up to 66 variants."""
    return rows.repartition(min(20_000, n // SPREAD + 1), "fp")


def links(fps: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, long), enough of them to join every component.

    Two fingerprints are in one component if and only if a chain of links of ``most`` (up to 3) differing bits joins them.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments serve up to 3 differing bits")
    rows = fps.select("fp", F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("shift"), F.lit(64).alias("width"))
    out = None
    while True:
        keyed = _variants(rows)
        counts = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high"))
        # members of a wildcard key that all have the same bit there are equal in the segment, whose own key holds them
        live = cut(counts.where("n > 1 and (low is null or low < high)").select("path", "key", "n"))
        last = keyed.select("width").limit(1).where("width <= 4").count() > 0
        small = live if last else live.where(F.col("n") <= bucket)
        lists = keyed.join(small, ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found = cut(lists.select("fps").mapInArrow(_bucket_links(most), "a long, b long").distinct())
        out = found if out is None else out.union(found)
        large = live.where(F.col("n") > bucket)
        if last or nothing(large):
            return out
        again = keyed.join(large, ["path", "key"]).select("fp", F.concat("path", F.array("key")).alias("path"), "shift", "width")
        rows = cut(_spread(again, large.agg(F.sum("n")).first()[0]))


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of ``df``: doc_id, fingerprint, component_id, component_size (rows of the class)."""
    docs = cut(fingerprints(df, id_col, text_col, shingle))
    return cluster_fingerprints(docs, most, bucket)


def cluster_fingerprints(docs: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``cluster`` for given (doc_id, fp)."""
    distinct = cut(_spread(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), docs.count()))
    roots = connected_components(links(distinct, most, bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    # cut, so that AQE can split the joins below on a class of very many fingerprints and on one that many copies share
    classes = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")).where("component_size > 1"))
    labels = cut(rooted.join(classes, "root").select("fp", "component_id", "component_size"))
    joined = docs.join(labels, "fp", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1).cast("long")).alias("component_size"),
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of each class the row whose doc_id is the smallest, once.

    Null doc_ids come after all others; of one doc_id the smaller SHA-256 of the text comes first. Rows that repeat both
    doc_id and text are one document and are reduced to one.
    """
    sha = fresh(df, "sha")
    hashed = df.withColumn(sha, F.unhex(F.sha2(col(df, text_col).cast("binary"), 256)))
    # a document is named by its doc_id and text, so no two classes share a name, and the smallest name of a class is kept
    named = hashed.select(F.struct(col(hashed, id_col).isNull().alias("last"), col(hashed, id_col).alias("id"), F.col(sha).alias("sha")).alias("name"), col(hashed, text_col).alias("text"))
    kept = cut(cluster(named, "name", "text", **options).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    a, b = fresh(df, "keep_id"), fresh(df, "keep_sha")
    keys = kept.select(F.col("doc_id.id").alias(a), F.col("doc_id.sha").alias(b), "n")
    same = col(hashed, id_col).eqNullSafe(F.col(a)) & F.col(sha).eqNullSafe(F.col(b))
    if nothing(kept.where("n > 1")):
        return hashed.join(keys, same, "left_semi").drop(sha)
    once = hashed.join(keys.where("n = 1"), same, "left_semi")
    several = hashed.join(keys.where("n > 1"), same, "left_semi").dropDuplicates([id_col, sha])
    return once.unionByName(several).drop(sha)
