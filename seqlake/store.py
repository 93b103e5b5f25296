"""A directory-backed store: appends, atomic batches, flush, compaction, snapshots and recovery over Parquet.

One writer, any number of readers. Everything goes through Spark's readers and writers and Hadoop's file system, so the
directory can be in any store that Spark reads.

    log/append-<n>/          records since the last flush, one directory for each append
    segments/<n>/            one segment: (key, value, is_tombstone, seq), ordered by key, with a Bloom filter on key
    manifests/MANIFEST-<n>/  the catalog of segments and the flush point, as JSON
    CURRENT                  the name of the manifest that counts; replaced by renaming, last of all

Readers resolve CURRENT once and then see one snapshot: the segments that it names and the log records above its flush
point. So a crash between any two steps loses nothing and repeats nothing: data is written first, the pointer last, and
log directories that a flush has covered are ignored until they are removed.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.kv import entry_bytes, within_limits
from seqlake.model import CATALOG, LIMITS, LOG, Limits
from seqlake.operators import levels, reads


@dataclass(frozen=True)
class Segment:
    level: int
    filename: str
    file_size: int
    first_key: str
    last_key: str
    version: int
    entries: int

    @property
    def folder(self) -> str:
        """The directory of the write that made it; several segments of one compaction share it."""
        return self.filename.partition("/")[0]


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    flushed: int = -1  # log records up to this seq are in segments
    segments: tuple[Segment, ...] = ()


class Files:
    """The few file operations that the store needs, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, content: str | Iterable[bytes]) -> None:
        """Replaces ``path`` by renaming a finished file over it; of parts, one at a time is held."""
        stream = self._fs.create(self._path(path + ".tmp"), True)
        try:
            for part in [content.encode()] if isinstance(content, str) else content:
                stream.write(bytearray(part))
        finally:
            stream.close()
        self.replace(path + ".tmp", path)

    def replace(self, fresh: str, path: str) -> None:
        """Renames the file ``fresh`` to ``path``, over the file that may be there."""
        fresh, old = self._path(fresh), self._path(path)
        self._fs.mkdirs(old.getParent())
        if not self._fs.rename(fresh, old):
            self._fs.delete(old, False)
            if not self._fs.rename(fresh, old):
                raise OSError(f"can't replace {path}")

    def remove_at_exit(self, path: str) -> None:
        """``path`` goes when the driver's JVM ends."""
        self._fs.deleteOnExit(self._path(path))

    def remove(self, path: str, tries: int = 3, wait: float = 0.1) -> bool:
        for _ in range(tries):
            if not self._fs.exists(self._path(path)) or self._fs.delete(self._path(path), True):
                return True
            time.sleep(wait)
        return False


def scratch(spark: SparkSession, stem: str) -> str:
    """A fresh folder that driver and executors share, in the one that ``spark.checkpoint.dir`` names; it goes at exit.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (context.master or "").startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="seqlake-")
    folder = f"{shared.rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    Files(spark, shared).remove_at_exit(folder)
    return folder


@dataclass
class Batch:
    """Operations that become visible together. They are not seen by reads before the commit."""

    store: Store
    ops: list[tuple[str, str, str | None]] = field(default_factory=list)
    open: bool = True

    def put(self, key: str, value: str) -> Batch:
        return self._add("put", key, value)

    def delete(self, key: str) -> Batch:
        return self._add("del", key, None)

    def _add(self, op: str, key: str, value: str | None) -> Batch:
        if not self.open:
            raise ValueError("the batch is closed")
        self.store._check(key, value)
        self.ops.append((op, key, value))
        return self

    def size(self) -> int:
        return len(self.ops)

    def clear(self) -> None:
        self.ops.clear()

    def commit(self) -> None:
        if not self.open:
            raise ValueError("the batch is closed")
        self.store._end(self)
        if self.ops:
            self.store._write(self.ops, batched=True)

    def rollback(self) -> None:
        self.store._end(self)
        self.ops.clear()

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if self.open:
            self.rollback() if kind else self.commit()


class Store:
    """``put``, ``delete``, ``get``, ``scan``, batches, ``flush``, ``compact``, ``maintain`` and ``stats`` on a directory."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = LIMITS):
        if len(limits.levels) < 2:
            raise ValueError("a store has two levels or more")
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits
        self.files = Files(spark, self.root)
        self._batch: Batch | None = None
        self._cached: tuple[int, DataFrame] | None = None
        self._folders: dict[str, set[str]] = {}  # of each kept manifest, the segment directories that it needs
        self._recover()

    # recovery and snapshots

    def _recover(self) -> None:
        current = f"{self.root}/CURRENT"
        self.snapshot = self._load(self.files.read(current).strip()) if self.files.exists(current) else Snapshot()
        missing = [s.filename for s in self.snapshot.segments if not self.files.exists(f"{self.root}/segments/{s.folder}/_SUCCESS")]
        if missing:
            raise ValueError(f"segments are missing: {missing}")
        self._appends = sorted(int(n.split("-")[1]) for n in self.files.names(f"{self.root}/log") if self.files.exists(f"{self.root}/log/{n}/_SUCCESS"))
        self._next_append = max(self._appends, default=-1) + 1
        self._numbers = max([-1, *(int(n) for n in self.files.names(f"{self.root}/segments") if n.isdigit())]) + 1
        seqs = self.memtable().agg(F.max("seq"), F.count(F.lit(1)), F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 13)).first()
        self._seq = max(seqs[0] if seqs[0] is not None else -1, self.snapshot.flushed) + 1
        self._pending, self._pending_bytes = seqs[1], seqs[2] or 0

    def _load(self, name: str) -> Snapshot:
        body = json.loads(self.files.read(f"{self.root}/manifests/{name}"))
        if body.get("format") != 1:
            raise ValueError(f"{name} is of another format")
        segments = tuple(Segment(**s) for s in body["segments"])
        if any(not 0 <= s.level < len(self.limits.levels) for s in segments):
            raise ValueError(f"{name} names a level that the store does not have")
        return Snapshot(body["number"], body["flushed"], segments)

    def _publish(self, segments: Iterable[Segment], flushed: int) -> None:
        """A new snapshot, then the pointer to it, then only what no kept snapshot needs goes."""
        before = self.snapshot
        new = Snapshot(before.number + 1, flushed, tuple(sorted(segments, key=lambda s: (s.level, s.version))))
        name = f"MANIFEST-{new.number:08d}"
        body = {"format": 1, "number": new.number, "flushed": new.flushed, "segments": [vars(s) for s in new.segments]}
        self.files.write(f"{self.root}/manifests/{name}", json.dumps(body))
        self.files.write(f"{self.root}/CURRENT", name + "\n")
        self.snapshot = new
        self._folders[name] = {s.folder for s in new.segments}
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.startswith("MANIFEST-") and not n.endswith(".tmp")]
        keep = names[-self.limits.kept_snapshots :]
        # only manifests of an earlier session are read again, once
        self._folders = {n: self._folders.get(n) or {s.folder for s in self._load(n).segments} for n in keep}
        needed = set().union(*self._folders.values())
        for n in set(names) - set(keep):
            self.files.remove(f"{self.root}/manifests/{n}")
        for n in self.files.names(f"{self.root}/segments"):
            if n not in needed:
                self.files.remove(f"{self.root}/segments/{n}")

    def rebuild(self) -> None:
        """For a store whose manifests are lost: every complete segment directory goes to level 0, then all is compacted.

        Ages are in the rows, so it doesn't matter in which order segments are found.
        """
        found, flushed = [], -1
        for name in self.files.names(f"{self.root}/segments"):
            if name.isdigit() and self.files.exists(f"{self.root}/segments/{name}/_SUCCESS"):
                rows = self._read([name])
                a, b, n, size, last = rows.agg(F.min("key"), F.max("key"), F.count(F.lit(1)), F.sum(entry_bytes(F.col("is_tombstone"), F.col("key"), F.col("value"))), F.max("seq")).first()
                if n:
                    found.append(Segment(0, name, int(size), a, b, int(name), n))
                    flushed = max(flushed, last)
        # rows of the log that are also in a segment do no harm: they have the same seq
        kept = self.memtable()
        first = kept.agg(F.min("seq")).first()[0]
        self._publish(found, flushed if first is None else min(flushed, first - 1))
        self._recover()
        self.compact()

    def cache(self) -> None:
        """Keeps the segments' rows of this snapshot in the executors' memory (and disk); a new snapshot starts without."""
        self.uncache()
        self._cached = (self.snapshot.number, self._segment_log(self.snapshot.segments).persist())

    def cached_bytes(self) -> int:
        """Bytes of memory and disk that the cached rows hold; they are there once a query has read them."""
        if not self._cached:
            return 0
        held = self.spark._jsparkSession.sharedState().cacheManager().lookupCachedData(self._cached[1]._jdf)
        return held.get().cachedRepresentation().cacheBuilder().sizeInBytesStats().value() if held.isDefined() else 0

    def uncache(self) -> None:
        if self._cached:
            self._cached[1].unpersist()
        self._cached = None

    # writing

    def _check(self, key: str, value: str | None) -> None:
        if not 1 <= len(key.encode()) <= self.limits.key_bytes:
            raise ValueError("keys have 1 byte to 1 MiB")
        if value is not None and len(value.encode()) > self.limits.value_bytes:
            raise ValueError("values have up to 1 MiB")

    def _end(self, batch: Batch) -> None:
        batch.open = False
        if self._batch is batch:
            self._batch = None

    def _write(self, ops: list[tuple[str, str, str | None]], batched: bool = False) -> None:
        rows = [(self._seq + k, self._next_append if batched else None, op, key, value, None) for k, (op, key, value) in enumerate(ops)]
        self.append(self.spark.createDataFrame(rows, LOG).coalesce(1), len(rows), sum(13 + len(k.encode()) + len((v or "").encode()) for _, k, v in ops), last=rows[-1][0])

    def append(self, log: DataFrame, entries: int | None = None, size: int | None = None, last: int | None = None) -> None:
        """Appends rows of LOG, all or nothing: the directory counts once Spark has committed it.

        ``seq`` must be above all before; ``next_seq`` says what is free.
        """
        folder = f"{self.root}/log/append-{self._next_append:012d}"
        checked = log.withColumn("fits", within_limits(F.col("key"), F.col("value")))
        if entries is None:
            bad, entries, first, last, size = checked.agg(F.sum((~F.col("fits")).cast("long")), F.count(F.lit(1)), F.min("seq"), F.max("seq"), F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 13)).first()
            if not entries:
                return
            if bad or first < self._seq:
                raise ValueError("keys or values beyond the limits" if bad else f"seq must start at {self._seq} or above")
        log.select(*LOG.names).write.mode("overwrite").parquet(folder)
        self._appends.append(self._next_append)
        self._next_append += 1
        self._seq = last + 1
        self._pending += entries
        self._pending_bytes += size
        if self._batch is None:
            self.auto_checkpoint()

    @property
    def next_seq(self) -> int:
        return self._seq

    def put(self, key: str, value: str) -> None:
        self._check(key, value)
        self._batch.put(key, value) if self._batch else self._write([("put", key, value)])

    def delete(self, key: str) -> None:
        self._check(key, None)
        self._batch.delete(key) if self._batch else self._write([("del", key, None)])

    def begin(self) -> Batch:
        if self._batch:
            raise ValueError("a batch is open")
        self._batch = Batch(self)
        return self._batch

    def commit(self) -> None:
        if not self._batch:
            raise ValueError("no batch is open")
        self._batch.commit()
        self.auto_checkpoint()

    def rollback(self) -> None:
        if not self._batch:
            raise ValueError("no batch is open")
        self._batch.rollback()

    def auto_checkpoint(self) -> bool:
        """Flushes when more entries or bytes wait than the limits allow."""
        if self._pending > self.limits.flush_entries or self._pending_bytes > self.limits.flush_bytes:
            return self.flush()
        return False

    # reading

    def memtable(self) -> DataFrame:
        """Log rows that are in no segment."""
        if not self._appends:
            return self.spark.createDataFrame([], LOG)
        paths = [f"{self.root}/log/append-{n:012d}" for n in self._appends]
        return self.spark.read.schema(LOG).parquet(*paths).where(F.col("seq") > self.snapshot.flushed)

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/segments/{n}" for n in names]
        return self.spark.read.schema("key string, value string, is_tombstone boolean, seq long").option("recursiveFileLookup", "true").parquet(*paths)

    def _segment_log(self, segments: Iterable[Segment]) -> DataFrame:
        names = [s.filename for s in segments]
        if not names:
            return self.spark.createDataFrame([], LOG).withColumn("origin", F.lit("segment"))
        none = F.lit(None).cast("long")
        return self._read(names).select("seq", none.alias("batch_id"), F.when(F.col("is_tombstone"), "del").otherwise("put").alias("op"), "key", "value", none.alias("file_no"), F.lit("segment").alias("origin"))

    def log(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Memtable and those segments that can hold a key from ``first`` to ``last``; ages are by seq."""
        memtable = self.memtable().withColumn("origin", F.lit("memtable"))
        if self._cached and self._cached[0] == self.snapshot.number:
            return memtable.unionByName(self._cached[1])
        near = [s for s in self.snapshot.segments if (first is None or s.last_key >= first) and (last is None or s.first_key <= last)]
        return memtable.unionByName(self._segment_log(near))

    def get(self, key: str) -> DataFrame:
        """key, value, seq, origin of a live key, or no row."""
        return reads.live(self.log(key, key).where(F.col("key") == key), "origin")

    def value(self, key: str) -> str | None:
        row = self.get(key).first()
        return row["value"] if row else None

    def multi_get(self, keys: list[str]) -> DataFrame:
        near = self.log(min(keys), max(keys)) if keys else self.log()
        return reads.multi_get(near, keys)

    def contains(self, keys: list[str]) -> DataFrame:
        near = self.log(min(keys), max(keys)) if keys else self.log()
        return reads.contains(near, keys)

    def scan(self, start: str, end: str) -> DataFrame:
        return reads.scan(self.log(start, end), start, end)

    def size(self) -> int:
        """Distinct keys of the memtable, deleted ones included."""
        return reads.count_keys(self.memtable()).first()[0]

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame([(s.level, s.filename, s.file_size, s.first_key, s.last_key, s.version, s.entries) for s in self.snapshot.segments], CATALOG)

    def stats(self) -> DataFrame:
        """level, files, bytes, limit_bytes, exceeds."""
        return levels.statistics(self.catalog(), levels.limits_frame(self.memtable(), self.limits))

    # flush and compaction

    def _write_segments(self, rows: DataFrame, level: int, size: int) -> list[Segment]:
        """``rows`` (key, value, is_tombstone, seq), of about ``size`` bytes, as segments of disjoint key ranges."""
        number, files = self._numbers, max(1, -(-size // self.limits.segment_bytes))
        target = f"{self.root}/segments/{number}"
        spread = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "key")
        ordered = spread.sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
        ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(self.limits.flush_entries)).partitionBy("part").parquet(target)
        self._numbers += 1
        written = self.spark.read.schema("key string, value string, is_tombstone boolean, seq long, part int").parquet(target)
        sums = written.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(entry_bytes(F.col("is_tombstone"), F.col("key"), F.col("value"))).alias("size")).collect()
        return [Segment(level, f"{number}/part={r['part']}" if files > 1 else str(number), int(r["size"]), r["a"], r["b"], number, r["n"]) for r in sums]

    def flush(self) -> bool:
        """The memtable, tombstones included, becomes a level-0 segment, or several of disjoint key ranges if it is large; an
        empty one is nothing to do."""
        if self._batch:
            raise ValueError("a batch is open")
        last = self._seq - 1
        rows = reads.latest(self.memtable())
        if not self._pending or rows.limit(1).count() == 0:
            return True
        new = self._write_segments(rows, 0, self._pending_bytes)
        self._publish([*self.snapshot.segments, *new], last)
        for n in self._appends:
            self.files.remove(f"{self.root}/log/append-{n:012d}")
        self._appends, self._pending, self._pending_bytes = [], 0, 0
        return True

    def _merge(self, sources: list[Segment], level: int) -> None:
        """Newest-wins merge of ``sources`` and of what they meet in ``level``, written to ``level``."""
        first, last = min(s.first_key for s in sources), max(s.last_key for s in sources)
        merged = list(sources)
        while True:  # until no file of the target level meets the range
            more = [s for s in self.snapshot.segments if s.level == level and s not in merged and s.first_key <= last and s.last_key >= first]
            if not more:
                break
            merged += more
            first, last = min(first, *(s.first_key for s in more)), max(last, *(s.last_key for s in more))
        rest = [s for s in self.snapshot.segments if s not in merged]
        rows = reads.latest(self._segment_log(merged))
        below = [s for s in rest if s.first_key <= last and s.last_key >= first]
        if below:  # any other file may hold an older version: keep the tombstones whose key is in one
            dead = rows.where("is_tombstone").join(self._segment_log(below).select("key").distinct(), "key", "left_semi")
            rows = rows.where(~F.col("is_tombstone")).unionByName(dead)
        else:
            rows = rows.where(~F.col("is_tombstone"))
        new = self._write_segments(rows, level, sum(s.file_size for s in merged))
        self._publish([*rest, *new], self.snapshot.flushed)

    def compact(self) -> None:
        """All level-0 segments, with what they overlap, go to level 1."""
        if self._batch:
            raise ValueError("a batch is open")
        top = [s for s in self.snapshot.segments if s.level == 0]
        if top:
            self._merge(top, 1)

    def maintain(self, most: int | None = None) -> int:
        """Compacts while a level but the last exceeds its limit, shallowest first; returns the number of merges.

        With ``most``, stops after that many; a return of ``most`` then means that levels may still exceed their limits.
        """
        done = 0
        while most is None or done < most:
            over = [k for k in range(len(self.limits.levels) - 1) if sum(s.file_size for s in self.snapshot.segments if s.level == k) > self.limits.level(k)]
            if not over:
                break
            level = over[0]
            files = [s for s in self.snapshot.segments if s.level == level]
            below = [s for s in self.snapshot.segments if s.level == level + 1]
            overlap = lambda s: sum(t.first_key <= s.last_key and t.last_key >= s.first_key for t in below)
            chosen = max(files, key=lambda s: (overlap(s), -s.version)) if level == 0 else min(files, key=lambda s: s.version)
            # files that meet the chosen one at level 0 go with it, so that no older version stays above a newer one
            group = [s for s in files if s is chosen or level == 0 and s.first_key <= chosen.last_key and s.last_key >= chosen.first_key]
            self._merge(group, level + 1)
            done += 1
        return done

    def close(self) -> None:
        if self._batch:
            raise ValueError("a batch is open")
        self.flush()
