"""Queries over written stores and files: flush, compaction, maintenance, recovery, batches, streams, binary formats.

Each one writes in a folder of its own, in the one that ``spark.checkpoint.dir`` names, and reads back what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.model import LIMITS, LOG, Limits
from seqlake.operators import reads, segments
from seqlake.plans.queries import _ENTRIES, _ENTRY, _LEVEL, _RECORD, _SIZES, EVENTS, _event_catalog, newest, register
from seqlake.shell import run
from seqlake.sources import binary
from seqlake.sources import fixtures as fx
from seqlake.store import Store, scratch
from seqlake.streaming.ingest import into_store

#: Flushes only when it is told to.
MANUAL = Limits(flush_entries=1 << 62, flush_bytes=1 << 62)


def _flushed(spark: SparkSession, sf: str, limits: Limits = MANUAL) -> Store:
    """A store, opened again, that holds the events log: two flushed generations (files 0 to 4, and 5 to 8) and a memtable."""
    store, log = Store(spark, scratch(spark, "store"), limits), fx.kv_events(spark, sf)
    for first, last in ((0, 4), (5, 8)):
        store.append(log.where(F.col("file_no").between(first, last)))
        store.flush()
    store.append(log.where(F.col("file_no") == fx.MEMTABLE))
    return Store(spark, store.root, limits)


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq, CASE WHEN file_no = 9 THEN 'memtable' ELSE 'segment' END AS origin FROM l WHERE NOT is_tombstone")
def store_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Live rows of memtable and segments after two flushes and a restart."""
    return reads.live(_flushed(spark, sf).log(), "origin")


@register(
    f"WITH {EVENTS}, g AS (SELECT *, CASE WHEN file_no <= 4 THEN 0 ELSE 1 END AS version FROM events_log WHERE file_no < 9), "
    f"e AS (SELECT *, op = 'del' AS is_tombstone FROM g QUALIFY row_number() OVER (PARTITION BY version, key ORDER BY seq DESC) = 1) "
    f"SELECT 0 AS level, version::BIGINT AS version, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, sum({_ENTRY})::BIGINT AS file_size FROM e GROUP BY version"
)
def store_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The segments that the manifest names after a restart."""
    return _flushed(spark, sf).catalog().select("level", "version", "first_key", "last_key", "entries", "file_size")


@register(
    f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE file_no < 9')}) "
    f"SELECT 1 AS level, count(*) AS entries, sum({_ENTRY})::BIGINT AS file_size, (SELECT count(DISTINCT key) FROM events_log WHERE file_no = 9) AS waiting FROM l WHERE NOT is_tombstone"
)
def store_compact(spark: SparkSession, sf: str) -> DataFrame:
    """What each level holds once level 0 is compacted; the memtable waits as before."""
    store = _flushed(spark, sf)
    store.compact()
    sums = Store(spark, store.root, MANUAL).catalog().groupBy("level").agg(F.sum("entries").alias("entries"), F.sum("file_size").alias("file_size"))
    return sums.withColumn("waiting", F.lit(store.size()).cast("long"))


@register(
    f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE file_no < 9')}) SELECT level, CASE WHEN level = 1 THEN (SELECT count(*) FROM l WHERE NOT is_tombstone) ELSE 0 END AS entries, false AS exceeds FROM range(4) r(level)"
)
def store_maintain(spark: SparkSession, sf: str) -> DataFrame:
    """Levels after maintenance of a store whose level 0 may hold next to nothing."""
    store = _flushed(spark, sf, Limits(levels=(1, 1 << 40, 1 << 41, 1 << 42), flush_entries=1 << 62, flush_bytes=1 << 62))
    store.maintain()
    held = store.catalog().groupBy("level").agg(F.sum("entries").alias("entries"))
    return store.stats().join(held, "level", "left").select(F.col("level").cast("long").alias("level"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), "exceeds")


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone")
def store_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Live rows of a store that has lost its manifests: segments are found by listing, the log is replayed."""
    store = _flushed(spark, sf)
    store.files.remove(f"{store.root}/CURRENT")
    store.files.remove(f"{store.root}/manifests")
    lost = Store(spark, store.root, MANUAL)
    lost.rebuild()
    return reads.live(lost.log())


@register("SELECT printf('n:%03d', n_nationkey::INT) AS key, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS value FROM nation WHERE n_regionkey <> 0")
def store_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that are committed, one that is rolled back, over the nations."""
    nations = [(f"n:{r['n_nationkey']:03d}", r["n_name"], r["n_regionkey"]) for r in fx.read(spark, sf, "nation").collect()]  # 25 rows
    store = Store(spark, scratch(spark, "store"), MANUAL)
    with store.begin() as batch:
        for key, name, _ in nations:
            batch.put(key, name)
    undone = store.begin()
    for key, _, _ in nations:
        undone.delete(key)
    store.rollback()
    store.begin()
    for key, name, region in nations:
        if region == 0:
            store.delete(key)
        elif region == 1:
            store.put(key, name + "!")
    store.commit()
    return Store(spark, store.root, MANUAL).scan("n:", "n;").select("key", "value")


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}), n AS (SELECT count(*) AS n FROM l WHERE NOT is_tombstone) SELECT n AS keys, true AS held, n AS keys_after, false AS held_after FROM n")
def store_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Live keys that are read through the cache and without it, and whether it held anything."""
    store = _flushed(spark, sf)
    store.cache()
    keys = reads.live(store.log()).count()
    held = store.cached_bytes() > 0
    store.uncache()
    after = reads.live(store.log()).count()
    return spark.createDataFrame([(keys, held, after, store.cached_bytes() > 0)], "keys long, held boolean, keys_after long, held_after boolean")


@register(
    f"""WITH RECURSIVE {EVENTS}, a AS (SELECT file_no AS f, count(*) AS n, sum({_RECORD})::BIGINT AS b FROM events_log GROUP BY file_no),
lim AS (SELECT sum(n) * 3 // 10 AS most_n, sum(b) // 4 AS most_b FROM a),
w AS (
  SELECT 0::BIGINT AS f, n, b, 0::BIGINT AS version FROM a WHERE f = 0
  UNION ALL
  SELECT a.f, CASE WHEN w.n > most_n OR w.b > most_b THEN a.n ELSE w.n + a.n END, CASE WHEN w.n > most_n OR w.b > most_b THEN a.b ELSE w.b + a.b END,
         w.version + CASE WHEN w.n > most_n OR w.b > most_b THEN 1 ELSE 0 END
  FROM w JOIN a ON a.f = w.f + 1, lim
), done AS (SELECT version FROM w, lim GROUP BY version HAVING max(CASE WHEN w.n > most_n OR w.b > most_b THEN 1 ELSE 0 END) = 1)
SELECT version, count(DISTINCT key) AS entries, min(key) AS first_key, max(key) AS last_key
FROM events_log JOIN w ON file_no = f WHERE version IN (SELECT version FROM done) GROUP BY version"""
)
def store_auto_flush(spark: SparkSession, sf: str) -> DataFrame:
    """The segments that ten appends leave when a flush follows each one after which more entries (three tenths) or bytes (a
    quarter of all) wait than the limits allow, and counting then begins anew."""
    log = fx.kv_events(spark, sf)
    n, b = log.agg(F.count(F.lit(1)), F.sum(F.expr("13 + octet_length(key) + coalesce(octet_length(value), 0)"))).first()
    store = Store(spark, scratch(spark, "store"), Limits(flush_entries=n * 3 // 10, flush_bytes=b // 4))
    for k in range(10):
        store.append(log.where(F.col("file_no") == k))
    return store.catalog().select("version", "entries", "first_key", "last_key")


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone")
def store_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Live rows of a store that a stream has filled."""
    folder = scratch(spark, "stream")
    fx.kv_events(spark, sf).write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store", MANUAL)
    into_store(spark.readStream.schema(LOG).parquet(f"{folder}/in"), store, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reads.live(Store(spark, store.root, MANUAL).log())


_SESSION = ["put a 1", "get a", "begin", "put b 2", "get b", "commit", "get b", "del a", "get a", "save", "get b", "scan a z", "begin", "put c 3", "rollback", "scan c z", "quit"]
_SAID = ["ok", "1", "ok", "ok", "not found", "ok", "2", "ok", "not found", "ok", "2 (from segment)", "b:2", "ok", "ok", "ok", "no keys in this range", "ok"]


@register("SELECT line::BIGINT AS line, said FROM (VALUES " + ", ".join(f"({k}, '{said}')" for k, said in enumerate(_SAID)) + ") v(line, said)")
def shell_session(spark: SparkSession, sf: str) -> DataFrame:
    """What the command loop says to a session of every kind of command."""
    said = run(Store(spark, scratch(spark, "store"), MANUAL), _SESSION)
    return spark.createDataFrame(list(enumerate(said)), "line long, said string")


# binary files


@register(
    f"WITH {EVENTS}, l AS (SELECT *, op = 'del' AS is_tombstone FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM events_log) "
    "WHERE batch_id % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value, is_tombstone, place AS seq FROM l"
)
def import_log(spark: SparkSession, sf: str) -> DataFrame:
    """The newest rows of a binary log whose rolled-back batches were never closed."""
    path, log = f"{scratch(spark, 'binary')}/wal.log", fx.kv_events(spark, sf)
    binary.write_log(log, path, fx.committed_batches(log))
    rows = binary.read_log(spark, path)
    return reads.latest(rows.withColumn("key", F.decode("key", "UTF-8")).withColumn("value", F.decode("value", "UTF-8")))


@register(f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE file_no < 9')}) SELECT key, value, file_no FROM l WHERE NOT is_tombstone")
def import_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Live rows of binary segments, larger numbers being newer."""
    folder = scratch(spark, "binary")
    binary.write_segments(segments.entries(fx.kv_events(spark, sf).where(F.col("file_no") < fx.MEMTABLE)), folder)
    return reads.live(binary.as_log(binary.read_segments(spark, folder)), "file_no").select("key", "value", "file_no")


@register(
    f"WITH {EVENTS}, e AS ({_ENTRIES.format(log='events_log')}), {_SIZES}, m AS (SELECT file_no, min(key) AS first_key, max(key) AS last_key FROM events_log GROUP BY file_no) "
    f"SELECT {_LEVEL} AS level, file_no || '.sst' AS filename, file_size, first_key, last_key, file_no AS version FROM sizes JOIN m USING (file_no) WHERE file_no < 9"
)
def import_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog that a binary manifest holds."""
    folder, levels = scratch(spark, "binary"), {k: [] for k in range(len(LIMITS.levels))}
    ranges = segments.metadata(fx.kv_events(spark, sf)).select("file_no", "first_key", "last_key")
    for r in _event_catalog(spark, sf).join(ranges, "file_no").orderBy("file_no").collect():  # nine files
        levels[r["level"]].append((f"{r['file_no']}.sst", r["file_size"], r["first_key"].encode(), r["last_key"].encode(), r["file_no"]))
    binary.write_manifest(spark, folder, levels)
    text = lambda name: F.decode(name, "UTF-8").alias(name)
    return binary.read_manifest(spark, folder).select("level", "filename", "file_size", text("first_key"), text("last_key"), "version")
