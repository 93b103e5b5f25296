"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids (k-means) split the vectors into lists; within a list each vector is a code of its residual, one byte
for each subspace. A query probes the lists of the best centroids, scores their codes from its own tables of partial
products (asymmetric distances), and the best of each block, with all that are within the quantisation error of them,
are scored again from the original vectors in double precision. Equal vectors are one entry that carries its smallest
ids, so a vector that a third of the rows share costs as much as any other.

Lists grow with the square root of the rows, and so do the entries of a list: as long as the neighbours of a query lie in
a bounded number of lists, the work grows with the rows to the power 1.5. Small lists whose centroids are near each other
share a block, large ones are dealt to several, so blocks hold about ENTRIES entries (fewer of long vectors: 4 MB); queries come in blocks of QUERIES.
A query travels once to each block that it probes, an entry once in all.

Centroids and codebooks are fitted on a sample, chosen by hashed id, of about ``sample`` vectors; without one given, that
is 16 times the square root of the rows, but at least LEAST and at most MOST. The number of lists probed is calibrated on
that sample: the fewest that cover ``coverage`` of the sample's own exact neighbours. Vectors without structure have their
neighbours in most lists, and then most are probed. Every row is indexed.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor
as candidates; null ids neither, nor vectors of another length than most (of two lengths that are as frequent, the longer
counts); fewer candidates than k give all of them; ties go to the smaller id; repeated rows count once for each (id,
vector); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import col, cut, ensure_checkpoint_dir

#: Entries and queries that meet in one block, and queries that are scored at a time.
ENTRIES, QUERIES, AT_ONCE = 1 << 14, 1024, 64
#: Rows of the sample, if none is given.
LEAST, MOST = 1 << 13, 1 << 16
#: Standard deviations of the quantisation error within which candidates are scored again.
MARGIN = 3.0


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x 256 x width
    probes: int
    spread: float  # standard deviation of a product's error for a query of length one

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and residual codes of each row."""
        lists = _nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        m, _, width = self.books.shape
        codes = np.empty((len(x), m), np.uint8)
        for k in range(m):
            codes[:, k] = _nearest(rest[:, k * width : (k + 1) * width], self.books[k])
        return lists, codes

    def probe(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the lists whose centroids have the largest inner product with it: ``probes``, and as many more
        as it takes to hold ``k`` candidates and the query itself (``sizes`` has the candidates of each list)."""
        out = []
        for part in _slices(q, len(self.centroids)):
            order = np.argsort(-(part @ self.centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
            out += [row[: max(self.probes, n)] for row, n in zip(order, enough.tolist())]
        return out


def _slices(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``x`` in slices of rows, for products of ``width`` columns that stay at 32 MB."""
    rows = max(1, (1 << 22) // max(1, width))
    return (x[at : at + rows] for at in range(0, len(x), rows))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    norms = (centers**2).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *((norms - 2 * part @ centers.T).argmin(axis=1) for part in _slices(x, len(centers)))])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled, None]
    return centers


def fit(x: np.ndarray, rows: int, subspaces: int = 16, k: int = 20, coverage: float = 0.98, seed: int = 3) -> Index:
    """An index for ``rows`` vectors, from the sample ``x``."""
    rng = np.random.default_rng(seed)
    lists = int(np.clip(round(np.sqrt(rows) / 4), 1, max(1, len(x) // 4)))
    lists = max(lists, min(48, max(1, len(x) // 8)))
    dim = x.shape[1]
    m = next(m for m in range(min(subspaces, dim), 0, -1) if dim % m == 0)
    centroids = _kmeans(x, lists, rng)
    near = _nearest(x, centroids)
    rest = x - centroids[near]
    width = dim // m
    books = np.stack([_kmeans(rest[:, j * width : (j + 1) * width], 256, rng, 8) for j in range(m)])
    # how deep the lists of the sample's own exact neighbours lie
    asked = x[rng.choice(len(x), min(512, len(x)), replace=False)]
    scores = asked @ x.T
    best = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, : k + 1]
    depth = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(depth, near[best], axis=1).ravel()
    probes = int(np.quantile(at, coverage)) + 1 if len(at) else lists
    index = Index(centroids, books, min(lists, probes), 0.0)
    _, codes = index.assign(x)
    error = rest - np.concatenate([books[j][codes[:, j]] for j in range(m)], axis=1)
    return replace(index, spread=float(np.sqrt((error**2).mean())))


def _clean(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all of them zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


class Blocks:
    """Which blocks hold the entries of each list: neighbouring small lists share one, large lists have several."""

    def __init__(self, centroids: np.ndarray, entries: np.ndarray, size: int):
        groups = int(np.clip(-(-entries.sum() // size), 1, len(centroids)))
        self.group = _nearest(centroids, _kmeans(centroids, groups, np.random.default_rng(5)))
        held = np.bincount(self.group, entries, groups).astype(np.int64)
        self.parts = np.maximum(1, -(-held // size))
        self.first = np.cumsum(self.parts) - self.parts

    def of_entries(self, lists: np.ndarray, salt: np.ndarray) -> np.ndarray:
        groups = self.group[lists]
        return self.first[groups] + salt % self.parts[groups]

    def of_query(self, lists: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each block with the lists of it that are among ``lists``."""
        groups = self.group[lists]
        for g in np.unique(groups).tolist():
            own = np.sort(lists[groups == g])
            for block in range(self.first[g], self.first[g] + self.parts[g]):
                yield block, own


def _meet(index: Index, lists: np.ndarray, codes: np.ndarray, x: np.ndarray, q: np.ndarray, probed: list[np.ndarray], k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, inner product) of the best entries of one block for each query, by place; ties with the last come along."""
    m, _, width = index.books.shape
    local, at = np.unique(lists, return_inverse=True)
    here = index.centroids[local]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(q), AT_ONCE):
        part = q[begin : begin + AT_ONCE]
        tables = np.einsum("jcw,qjw->jqc", index.books, part.reshape(len(part), m, width))
        near = (part @ here.T)[:, at]
        for j in range(m):
            near += tables[j][:, codes[:, j]]
        asked = np.zeros((len(part), len(local)), bool)
        for row, own in enumerate(probed[begin : begin + AT_ONCE]):
            place = np.minimum(np.searchsorted(local, own), len(local) - 1)
            asked[row, place[local[place] == own]] = True
        near[~asked[:, at]] = -np.inf
        least = np.full(len(part), -np.inf)
        if near.shape[1] > rerank:
            best = np.partition(near, (-rerank, -k - 1), axis=1)
            # all that quantisation may have put below the best ones, however many vectors look alike
            least = np.minimum(best[:, -rerank], best[:, -k - 1] - MARGIN * index.spread * np.linalg.norm(part, axis=1))
        for row in range(len(part)):
            few = np.flatnonzero((near[row] >= least[row]) & (near[row] > -np.inf))
            exact = (x[few] * part[row]).sum(axis=1)
            order = np.argsort(-exact, kind="stable")
            if len(order) > k + 1:
                order = order[exact[order] >= exact[order[k]]]
            out.append((np.full(len(order), begin + row), few[order], exact[order]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, sample: int | None = None, rerank: int = 64, coverage: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    vector = col(df, vector_col)
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"  # such vectors travel as they are
    vector = vector if single else F.transform(vector, lambda v: v.cast("double"))
    rows = df.select(col(df, id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & _clean(F.col("v")))
    frequent = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not frequent:
        return spark.createDataFrame([], schema)
    dim, n = frequent[0]["dim"], frequent[0]["n"]
    rows = rows.where(F.size("v") == dim)
    sample = sample or int(np.clip(16 * np.sqrt(n), LEAST, MOST))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "raw"])

    # about ``sample`` rows reach the driver, at most twice as many; a small table comes whole
    place = F.xxhash64("vec_id")
    share = 2 * sample / n
    near = rows if share >= 1 else rows.where(place < int(share * 2**64) - 2**63)
    drawn = near.orderBy(place, "vec_id").limit(sample).mapInArrow(raw, "vec_id long, raw binary").collect()
    if not drawn:  # so few ids, each many times, that no hash is low
        drawn = rows.limit(1).mapInArrow(raw, "vec_id long, raw binary").collect()
    kind = np.float32 if single else np.float64
    drawn.sort(key=lambda r: (r["vec_id"], bytes(r["raw"])))
    index = fit(np.frombuffer(b"".join(bytes(r["raw"]) for r in drawn), kind).reshape(-1, dim).astype(np.float64), n, k=k, coverage=coverage)
    shared = spark.sparkContext.broadcast(index)  # bounded by MOST: a quarter as many centroids, and 256 codes for each subspace

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(v):
                lists, codes = shared.value.assign(v.astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "list", "code", "raw"])

    # equal vectors become one entry with its k + 1 smallest ids, enough for every query
    placed = rows.mapInArrow(place_rows, "vec_id long, list int, code binary, raw binary")
    least = Window.partitionBy("raw").orderBy("vec_id")
    entries = placed.withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= k + 1)
    entries = cut(entries.groupBy("raw").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("list").alias("list"), F.first("code").alias("code")))

    held, candidates = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    for r in entries.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # a row for each list
        held[r["list"]], candidates[r["list"]] = r["n"], r["ids"]
    blocks = Blocks(index.centroids, held, max(256, min(ENTRIES, (1 << 22) // (dim * kind().itemsize))))
    dealt = spark.sparkContext.broadcast(blocks)  # three numbers for each list
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    query_blocks = max(1, -(-n // (every * QUERIES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = np.fromiter(map(zlib.crc32, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            block = dealt.value.of_entries(batch.column(2).to_numpy(), salt)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *batch.columns], names=["block", "raw", "ids", "list", "code"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out = [(block, row, own) for row, lists in enumerate(shared.value.probe(v.astype(np.float64), candidates, k)) for block, own in dealt.value.of_query(lists)]
            for at in range(0, len(out), 4096):
                some = out[at : at + 4096]
                rows_of = [row for _, row, _ in some]
                names = batch.column(0).take(pa.array(rows_of, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int32()), names, pa.array([v[row].tobytes() for row in rows_of], pa.binary()), pa.array([own for _, _, own in some], pa.list_(pa.int32()))], names=["block", "query_id", "raw", "lists"])

    left = entries.mapInArrow(deal, "block int, raw binary, ids array<long>, list int, code binary")
    left = left.groupBy("block").agg(F.collect_list(F.struct("raw", "ids", "list", "code")).alias("entries"))
    right = queries.mapInArrow(ask, "block int, query_id long, raw binary, lists array<int>").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    right = right.groupBy("block", "part").agg(F.collect_list(F.struct("query_id", "raw", "lists")).alias("queries"))
    pairs = left.join(right, "block").select("entries", "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, asking = batch.column(0)[row].values, batch.column(1)[row].values
                codes = np.frombuffer(b"".join(own.field("code").to_pylist()), np.uint8).reshape(len(own), -1)
                x, q = (np.frombuffer(b"".join(side.field("raw").to_pylist()), kind).reshape(-1, dim).astype(np.float64) for side in (own, asking))
                at, entry, score = _meet(shared.value, own.field("list").to_numpy(), codes, x, q, [np.array(p, np.int64) for p in asking.field("lists").to_pylist()], k, rerank)
                ids = own.field("ids").take(pa.array(entry))
                counts = np.diff(ids.offsets.to_numpy())
                names = np.repeat(asking.field("query_id").to_numpy()[at], counts)
                others = ids.flatten().to_numpy()
                other = names != others
                yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(others[other]), pa.array(np.repeat(score, counts)[other])], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
