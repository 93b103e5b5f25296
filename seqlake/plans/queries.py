"""The registered queries of the key-value engine, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators import levels, reads, segments, wal
from seqlake.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}

EVENTS = """events_log AS (
  SELECT event_id AS seq, event_id // 10 AS batch_id, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op,
         printf('u:%08d', user_id) AS key, CASE WHEN event_type <> 'error' THEN concat_ws('|', event_type, props) END AS value,
         event_id * 10 // (SELECT max(event_id) + 1 FROM events) AS file_no
  FROM events)"""
ORDERS = """orders_log AS (
  SELECT o_orderkey AS seq, 'put' AS op, printf('o:%010d', o_orderkey) AS key,
         concat_ws('|', o_orderstatus, o_orderpriority) AS value, 0::BIGINT AS file_no FROM orders
  UNION ALL
  SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders), CASE WHEN o_orderstatus = 'P' THEN 'del' ELSE 'put' END,
         printf('o:%010d', o_orderkey), CASE WHEN o_orderstatus = 'F' THEN 'F|closed' END, 1::BIGINT
  FROM orders WHERE o_orderstatus IN ('P', 'F'))"""
DOCS = """docs_log AS (
  SELECT d.doc_id AS seq, CASE WHEN l.toxic = 1 THEN 'del' ELSE 'put' END AS op, lang || ':' || printf('%08d', d.doc_id) AS key,
         CASE WHEN l.toxic IS NULL OR l.toxic <> 1 THEN text END AS value, 0::BIGINT AS file_no
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1)"""
CATALOG = """n AS (SELECT max(o_orderkey) + 1 AS n, (max(o_orderkey) + 1) // 10 AS w FROM orders), catalog AS (
  SELECT 1 AS level, f AS file_no, printf('o:%010d', f * w) AS first_key,
         printf('o:%010d', f * w + w - 1 + CASE WHEN f IN (1, 4, 5) THEN w // 10 ELSE 0 END) AS last_key
  FROM n, range(10) r(f)
  UNION ALL
  SELECT 0, f, printf('o:%010d', a * n // 100), printf('o:%010d', b * n // 100)
  FROM n, (VALUES (10::BIGINT, 15, 45), (11, 50, 95), (12, 62, 63)) v(f, a, b))"""
_NEWEST = "SELECT *, op = 'del' AS is_tombstone FROM {log} {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
_ENTRIES = "SELECT *, op = 'del' AS is_tombstone FROM {log} QUALIFY row_number() OVER (PARTITION BY file_no, key ORDER BY seq DESC) = 1"
_RECORD = "13 + strlen(key) + CASE WHEN op = 'put' THEN strlen(value) ELSE 0 END"
_ENTRY = "5 + strlen(key) + CASE WHEN is_tombstone THEN 0 ELSE 4 + strlen(value) END"
_SIZES = f"""sizes AS (SELECT file_no, count(*) AS entries,
  (sum({_ENTRY}) + 4 + sum(12 + strlen(key)) + 16 + ceil(greatest(64, 10 * count(*)) / 8) + 16)::BIGINT AS file_size
  FROM e GROUP BY file_no)"""
_LEVEL = "CASE WHEN file_no BETWEEN 7 AND 8 THEN 0 WHEN file_no BETWEEN 4 AND 6 THEN 1 WHEN file_no BETWEEN 0 AND 3 THEN 2 END"
_BLOOM = """params AS (SELECT *, CASE WHEN entries = 0 THEN 1 ELSE greatest(1, least(30, floor(0.6931471805599453 * bits / entries)::INT)) END::INT AS hashes
  FROM (SELECT file_no, count(DISTINCT key) AS entries, greatest(64, 10 * count(DISTINCT key)) AS bits FROM {log} GROUP BY file_no))"""
_POSITION = "((('0x' || substr(md5(key), 1, 15))::BIGINT % bits) + i * (('0x' || substr(md5(key), 16, 15))::BIGINT % bits)) % bits"


def register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _ORACLE[f.__name__] = sql
        return f

    return add


def newest(log: str, where: str = "") -> str:
    return _NEWEST.format(log=log, where=where)


# lookups and scans


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, is_tombstone, seq FROM l")
def latest_with_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return reads.for_each(fx.kv_events(spark, sf), tombstones=True)


@register(f"WITH {ORDERS}, l AS ({newest('orders_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone")
def live_foreach(spark: SparkSession, sf: str) -> DataFrame:
    return reads.for_each(fx.kv_orders(spark, sf))


@register(f"WITH {DOCS}, l AS ({newest('docs_log')}) SELECT key, md5(value) AS value_md5, strlen(value) AS value_bytes, seq FROM l WHERE NOT is_tombstone")
def live_documents(spark: SparkSession, sf: str) -> DataFrame:
    return reads.live(fx.kv_docs(spark, sf)).select("key", F.md5(F.col("value").cast("binary")).alias("value_md5"), F.octet_length("value").cast("long").alias("value_bytes"), "seq")


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone AND key = 'u:00000011'")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return reads.get(fx.kv_events(spark, sf), "u:00000011")


_ASKED = [f"o:{k:010d}" for k in (0, 7, 42, 99, 500, 1499, 10**9)]


@register(f"WITH {ORDERS}, l AS ({newest('orders_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone AND key IN ({', '.join(map(repr, _ASKED))})")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return reads.multi_get(fx.kv_orders(spark, sf), _ASKED)


@register(
    f"WITH {ORDERS}, l AS ({newest('orders_log')}) SELECT key, value, seq FROM l "
    "WHERE NOT is_tombstone AND key IN (SELECT printf('o:%010d', l_orderkey) FROM lineitem WHERE l_quantity >= 45)"
)
def multi_get_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.read(spark, sf, "lineitem").where("l_quantity >= 45").select(F.format_string("o:%010d", "l_orderkey").alias("key"))
    return reads.multi_get(fx.kv_orders(spark, sf), keys)


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq, CASE WHEN file_no = 9 THEN 'memtable' ELSE 'segment' END AS origin FROM l WHERE NOT is_tombstone")
def get_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return reads.provenance(fx.kv_events(spark, sf), F.col("file_no") == fx.MEMTABLE)


@register(f"WITH {EVENTS} SELECT DISTINCT key FROM events_log WHERE key IN (SELECT printf('u:%08d', c_custkey) FROM customer)")
def contains_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.read(spark, sf, "customer").select(F.format_string("u:%08d", "c_custkey").alias("key"))
    return reads.contains(fx.kv_events(spark, sf), keys)


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone AND key BETWEEN 'u:00000010' AND 'u:00000050'")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return reads.scan(fx.kv_events(spark, sf), "u:00000010", "u:00000050")


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone AND key BETWEEN 'u:00000050' AND 'u:00000010'")
def range_scan_empty(spark: SparkSession, sf: str) -> DataFrame:
    return reads.scan(fx.kv_events(spark, sf), "u:00000050", "u:00000010")


@register(f"WITH {EVENTS} SELECT count(DISTINCT key) AS keys FROM events_log WHERE file_no = 9")
def memtable_size(spark: SparkSession, sf: str) -> DataFrame:
    return reads.count_keys(fx.kv_events(spark, sf).where(F.col("file_no") == fx.MEMTABLE))


@register(f"WITH {EVENTS}, l AS ({newest('events_log')}) SELECT key, seq FROM l WHERE is_tombstone")
def tombstone_report(spark: SparkSession, sf: str) -> DataFrame:
    return reads.tombstones(fx.kv_events(spark, sf))


@register(
    f"WITH {ORDERS}, a AS (SELECT *, CASE WHEN file_no = 1 THEN 0 ELSE 1 END AS age FROM orders_log) "
    "SELECT key, value, op = 'del' AS is_tombstone, seq FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY age, seq DESC) = 1"
)
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_orders(spark, sf)
    return reads.merge([log.where("file_no = 1"), log.where("file_no = 0")], drop_deleted=False)


@register(f"WITH {EVENTS} SELECT key, value, seq FROM events_log WHERE key BETWEEN 'u:00000005' AND 'u:00000090' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND op = 'put'")
def merge_and_scan(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf).where(F.col("key").between("u:00000005", "u:00000090"))
    young, old = log.where("file_no >= 5"), log.where("file_no < 5")
    return reads.merge([young, old]).select("key", "value", "seq")


# batches and the log


@register(f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE batch_id % 7 <> 3')}) SELECT key, value, seq FROM l WHERE NOT is_tombstone")
def batch_commit_view(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    return reads.live(reads.committed(log, fx.committed_batches(log)))


@register(
    f"WITH {EVENTS}, a AS ({newest('events_log')}), b AS ({newest('events_log', 'WHERE batch_id % 7 <> 3')}) "
    "SELECT key, a.seq AS seq_all, b.seq AS seq_committed FROM (SELECT key, seq FROM a WHERE NOT is_tombstone) a "
    "FULL JOIN (SELECT key, seq FROM b WHERE NOT is_tombstone) b USING (key) WHERE a.seq IS DISTINCT FROM b.seq"
)
def batch_rollback_effect(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    everything = reads.live(log).select("key", F.col("seq").alias("seq_all"))
    kept = reads.live(reads.committed(log, fx.committed_batches(log))).select("key", F.col("seq").alias("seq_committed"))
    return everything.join(kept, "key", "full").where(~F.col("seq_all").eqNullSafe(F.col("seq_committed")))


@register(f"WITH {DOCS} SELECT seq, op, key, ({_RECORD})::BIGINT AS record_bytes FROM docs_log")
def wal_record_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return wal.record_sizes(fx.kv_docs(spark, sf)).select("seq", "op", "key", "record_bytes")


@register(f"WITH {DOCS} SELECT op, strlen(key) BETWEEN 1 AND 1048576 AND coalesce(strlen(value), 0) <= 1048576 AS fits, count(*) AS records, sum({_RECORD})::BIGINT AS log_bytes FROM docs_log GROUP BY ALL")
def wal_limits(spark: SparkSession, sf: str) -> DataFrame:
    sized = wal.record_sizes(fx.kv_docs(spark, sf)).withColumn("fits", wal.valid(None))
    return sized.groupBy("op", "fits").agg(F.count(F.lit(1)).alias("records"), F.sum("record_bytes").alias("log_bytes"))


@register(
    f"""WITH {EVENTS}, tbl AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), k AS (SELECT DISTINCT key FROM events_log), b AS (
  SELECT key, list_concat([1::BIGINT, strlen(key), 0, 0, 0], list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT), [0::BIGINT, 0, 0, 0]) AS bytes FROM k
)
SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, tbl"""
)
def wal_crc32(spark: SparkSession, sf: str) -> DataFrame:
    deletes = fx.kv_events(spark, sf).select("key").distinct().select("key", F.lit("del").alias("op"), F.lit(None).cast("string").alias("value"))
    return wal.checksums(deletes).select("key", "crc")


@register(
    f"""WITH {EVENTS}, {DOCS}, tbl AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), records AS (
  SELECT 'events' AS log, seq, op, key, CASE WHEN op = 'put' THEN coalesce(value, '') ELSE '' END AS held FROM events_log
  UNION ALL SELECT 'documents', seq, op, key, CASE WHEN op = 'put' THEN coalesce(value, '') ELSE '' END FROM docs_log
), hexed AS (
  SELECT log, seq, op, key, hex(encode(key)) AS k, strlen(key) AS kn, hex(encode(held)) AS v, strlen(held) AS vn FROM records
), b AS (
  SELECT log, seq, op, key, list_concat(
    [CASE WHEN op = 'put' THEN 0 ELSE 1 END::BIGINT], [(kn >> s) & 255 for s in [0, 8, 16, 24]], list_transform(range(0, kn), lambda i: ('0x' || substr(k, 2 * i + 1, 2))::BIGINT),
    [(vn >> s) & 255 for s in [0, 8, 16, 24]], list_transform(range(0, vn), lambda i: ('0x' || substr(v, 2 * i + 1, 2))::BIGINT)) AS bytes FROM hexed
)
SELECT log, seq, op, key, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, tbl"""
)
def wal_log_crc32(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of both logs, puts with their values; ``wal_crc32`` has each key of one log once, as a delete."""
    logs = [wal.checksums(log(spark, sf)).select(F.lit(name).alias("log"), "seq", "op", "key", "crc") for name, log in (("events", fx.kv_events), ("documents", fx.kv_docs))]
    return logs[0].unionByName(logs[1])


@register(f"WITH {EVENTS} SELECT seq, op, key, value FROM events_log WHERE seq < (SELECT max(seq) * 3 // 4 FROM events_log)")
def wal_valid_prefix(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    return wal.valid_prefix(log, _one_bad(log)).select("seq", "op", "key", "value")


def _one_bad(log: DataFrame) -> F.Column:
    """All records are intact but the one at three quarters."""
    return F.col("seq") != log.agg(F.expr("max(seq) * 3 div 4").alias("bad")).scalar()


@register(f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE seq < (SELECT max(seq) * 3 // 4 FROM events_log) AND batch_id % 7 <> 3')}) SELECT key, value, is_tombstone, seq FROM l")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    return wal.replay(log, fx.committed_batches(log), _one_bad(log))


@register(f"WITH {EVENTS} SELECT count(*) AS records, min(seq) AS first_seq FROM events_log WHERE seq >= (SELECT max(seq) * 3 // 4 FROM events_log)")
def wal_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    return wal.quarantine(log, _one_bad(log)).agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"))


@register(
    f"WITH {EVENTS}, s AS (SELECT seq, ({_RECORD})::BIGINT AS record_bytes, sum({_RECORD}) OVER (ORDER BY seq)::BIGINT AS log_bytes FROM events_log) "
    "SELECT (log_bytes - record_bytes) // 65536 AS segment_no, count(*) AS records, sum(record_bytes)::BIGINT AS segment_bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM s GROUP BY 1"
)
def auto_checkpoint_segments(spark: SparkSession, sf: str) -> DataFrame:
    cut = wal.checkpoint_segments(fx.kv_events(spark, sf), 65536)
    return cut.groupBy("segment_no").agg(F.count(F.lit(1)).alias("records"), F.sum("record_bytes").alias("segment_bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# segments


@register(f"WITH {EVENTS}, e AS ({_ENTRIES.format(log='events_log')}) SELECT file_no, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, count(*) FILTER (NOT is_tombstone) AS live_entries FROM e GROUP BY file_no")
def segment_meta(spark: SparkSession, sf: str) -> DataFrame:
    return segments.metadata(fx.kv_events(spark, sf))


@register(
    f"WITH {ORDERS}, e AS ({_ENTRIES.format(log='orders_log')}) SELECT file_no, key, ({_ENTRY})::BIGINT AS entry_bytes, "
    f"coalesce(sum({_ENTRY}) OVER (PARTITION BY file_no ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM e"
)
def segment_index_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return segments.index_offsets(fx.kv_orders(spark, sf)).select("file_no", "key", F.col("entry_bytes").cast("long").alias("entry_bytes"), "offset")


@register(f"WITH {EVENTS}, e AS ({_ENTRIES.format(log='events_log')}), {_SIZES} SELECT * FROM sizes")
def segment_file_size(spark: SparkSession, sf: str) -> DataFrame:
    return segments.file_sizes(fx.kv_events(spark, sf))


@register(f"WITH {EVENTS} SELECT max(file_no) + 1 AS next_file_no FROM events_log WHERE file_no < 9")
def next_segment_number(spark: SparkSession, sf: str) -> DataFrame:
    return segments.next_number(fx.kv_events(spark, sf).where(F.col("file_no") < fx.MEMTABLE))


@register(f"WITH {EVENTS}, {_BLOOM.format(log='events_log')} SELECT file_no, entries, bits, hashes FROM params")
def bloom_params(spark: SparkSession, sf: str) -> DataFrame:
    return segments.bloom_params(fx.kv_events(spark, sf))


@register(f"WITH {EVENTS}, {_BLOOM.format(log='events_log')} SELECT DISTINCT file_no, {_POSITION} AS position FROM (SELECT DISTINCT file_no, key FROM events_log) JOIN params USING (file_no), range(30) r(i) WHERE i < hashes")
def bloom_bits(spark: SparkSession, sf: str) -> DataFrame:
    return segments.bloom_filters(fx.kv_events(spark, sf))


@register(
    f"""WITH {EVENTS}, {_BLOOM.format(log='events_log')},
bits AS (SELECT DISTINCT file_no, {_POSITION} AS position FROM (SELECT DISTINCT file_no, key FROM events_log) JOIN params USING (file_no), range(30) r(i) WHERE i < hashes),
ranges AS (SELECT file_no, min(key) AS first_key, max(key) AS last_key FROM events_log GROUP BY file_no),
asked AS (
  SELECT file_no, key, hashes, {_POSITION} AS position
  FROM (SELECT DISTINCT printf('u:%08d', c_custkey) AS key FROM customer) JOIN ranges ON key BETWEEN first_key AND last_key JOIN params USING (file_no), range(30) r(i) WHERE i < hashes)
SELECT file_no, key, count(b.position) = any_value(hashes) AS may_contain FROM asked LEFT JOIN bits b USING (file_no, position) GROUP BY file_no, key"""
)
def bloom_probe(spark: SparkSession, sf: str) -> DataFrame:
    keys = fx.read(spark, sf, "customer").select(F.format_string("u:%08d", "c_custkey").alias("key"))
    return segments.bloom_probe(fx.kv_events(spark, sf), keys)


@register(
    f"""WITH {EVENTS}, {_BLOOM.format(log='events_log')},
bits AS (SELECT DISTINCT file_no, {_POSITION} AS position FROM (SELECT DISTINCT file_no, key FROM events_log) JOIN params USING (file_no), range(30) r(i) WHERE i < hashes),
held AS (SELECT file_no, position // 8 AS byte, sum(1 << (position % 8)::INT)::BIGINT AS v FROM bits GROUP BY 1, 2),
every AS (SELECT file_no, hashes, bits, unnest(range((bits + 7) // 8)) AS byte FROM params)
SELECT file_no, hashes, bits, md5(string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY byte)) AS packed_md5 FROM every LEFT JOIN held USING (file_no, byte) GROUP BY file_no, hashes, bits"""
)
def bloom_packed(spark: SparkSession, sf: str) -> DataFrame:
    packed = segments.bloom_packed(fx.kv_events(spark, sf))
    return packed.select("file_no", "hashes", "bits", F.md5(F.hex("packed").cast("binary")).alias("packed_md5"))


# levels


def _event_catalog(spark: SparkSession, sf: str) -> DataFrame:
    sizes = segments.file_sizes(fx.kv_events(spark, sf).where(F.col("file_no") < fx.MEMTABLE))
    return sizes.withColumn("level", fx.event_level(F.col("file_no")))


_STATS = (
    f"WITH {EVENTS}, e AS ({_ENTRIES.format(log='events_log')}), {_SIZES}, c AS (SELECT *, {_LEVEL} AS level FROM sizes WHERE file_no < 9), "
    "lim AS (SELECT * FROM (VALUES (0, {a}::BIGINT), (1, {b}), (2, {c}), (3, {d})) v(level, limit_bytes)) "
    "SELECT lim.level, count(file_no) AS files, coalesce(sum(file_size), 0)::BIGINT AS bytes, limit_bytes, coalesce(sum(file_size), 0) > limit_bytes AS exceeds "
    "FROM lim LEFT JOIN c ON c.level = lim.level GROUP BY lim.level, limit_bytes"
)


@register(_STATS.format(a=8388608, b=33554432, c=268435456, d=1073741824))
def level_stats(spark: SparkSession, sf: str) -> DataFrame:
    catalog = _event_catalog(spark, sf)
    return levels.statistics(catalog, levels.limits_frame(catalog))


@register(f"SELECT level, exceeds FROM ({_STATS.format(a=8192, b=65536, c=262144, d=1073741824)})")
def level_exceeds(spark: SparkSession, sf: str) -> DataFrame:
    catalog = _event_catalog(spark, sf)
    small = levels.Limits(levels=(8192, 65536, 262144, 1073741824))
    return levels.statistics(catalog, levels.limits_frame(catalog, small)).select("level", "exceeds")


@register(f"WITH {CATALOG} SELECT u.file_no AS upper_file, w.file_no AS lower_file FROM catalog u JOIN catalog w ON u.level = 0 AND w.level = 1 AND NOT (w.last_key < u.first_key OR u.last_key < w.first_key)")
def overlapping_files(spark: SparkSession, sf: str) -> DataFrame:
    return levels.overlaps(fx.kv_catalog(spark, sf))


@register(f"WITH {CATALOG} SELECT file_no, first_key, last_key FROM catalog WHERE level = 1 AND NOT (last_key < 'o:0000000120' OR 'o:0000000130' < first_key)")
def overlapping_range(spark: SparkSession, sf: str) -> DataFrame:
    return levels.overlapping(fx.kv_catalog(spark, sf), 1, "o:0000000120", "o:0000000130").select("file_no", "first_key", "last_key")


@register(f"WITH {CATALOG} SELECT level, file_no FROM catalog WHERE first_key <= 'o:0000000777' AND last_key >= 'o:0000000777'")
def find_files(spark: SparkSession, sf: str) -> DataFrame:
    return levels.find(fx.kv_catalog(spark, sf), "o:0000000777").select("level", "file_no")


@register(
    f"WITH {CATALOG} SELECT u.file_no, count(w.file_no) AS n_overlaps FROM (SELECT * FROM catalog WHERE level = 0) u "
    "LEFT JOIN (SELECT * FROM catalog WHERE level = 1) w ON NOT (w.last_key < u.first_key OR u.last_key < w.first_key) GROUP BY u.file_no ORDER BY 2 DESC, 1 LIMIT 1"
)
def pick_l0_file(spark: SparkSession, sf: str) -> DataFrame:
    return levels.pick(fx.kv_catalog(spark, sf))


@register(
    f"WITH {CATALOG}, m AS (SELECT *, CASE WHEN max(last_key) OVER (ORDER BY first_key, last_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= first_key THEN 0 ELSE 1 END AS b FROM catalog WHERE level = 1) "
    "SELECT file_no, first_key, last_key, (sum(b) OVER (ORDER BY first_key, last_key, file_no) - 1)::BIGINT AS island FROM m"
)
def overlap_islands(spark: SparkSession, sf: str) -> DataFrame:
    return levels.islands(fx.kv_catalog(spark, sf))


@register(f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE file_no < 9')}) SELECT key, value, is_tombstone, seq FROM l WHERE NOT is_tombstone")
def compact_full(spark: SparkSession, sf: str) -> DataFrame:
    return levels.compact(fx.kv_events(spark, sf), F.col("file_no") < fx.MEMTABLE)


@register(
    f"WITH {EVENTS}, l AS ({newest('events_log', 'WHERE file_no BETWEEN 4 AND 8')}) SELECT key, value, is_tombstone, seq FROM l "
    "WHERE NOT is_tombstone OR key IN (SELECT key FROM events_log WHERE file_no < 4)"
)
def compact_partial(spark: SparkSession, sf: str) -> DataFrame:
    return levels.compact(fx.kv_events(spark, sf), F.col("file_no").between(4, 8), F.col("file_no") < 4)


@register(
    f"WITH {EVENTS}, l AS ({newest('events_log')}), v AS (SELECT key FROM l WHERE NOT is_tombstone) "
    "SELECT (SELECT count(*) FROM v) AS live_before, (SELECT count(*) FROM v) AS live_after, 0::BIGINT AS missing, 0::BIGINT AS extra"
)
def compaction_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.kv_events(spark, sf)
    before = reads.live(log)
    merged = levels.compact(log, F.col("file_no").between(4, 8), F.col("file_no") < 4)
    written = merged.select("seq", F.when(F.col("is_tombstone"), "del").otherwise("put").alias("op"), "key", "value")
    rest = log.where("file_no < 4 or file_no > 8").select("seq", "op", "key", "value")
    after = reads.live(written.unionByName(rest))
    both = before.withColumn("a", F.lit(1)).join(after.withColumn("b", F.lit(1)), [before["key"] == after["key"], before["seq"] == after["seq"], before["value"].eqNullSafe(after["value"])], "full")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(one(a).alias("live_before"), one(b).alias("live_after"), one(a & ~b).alias("missing"), one(b & ~a).alias("extra"))


@register(
    f"WITH {EVENTS}, e AS (SELECT *, op = 'del' AS is_tombstone FROM events_log WHERE file_no < 9) "
    f"SELECT 8::BIGINT AS snapshot, {_LEVEL} AS level, file_no, min(key) AS first_key, max(key) AS last_key FROM e GROUP BY file_no"
)
def manifest_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of the snapshots that flushing the segments one by one leaves behind."""
    catalog = segments.metadata(fx.kv_events(spark, sf).where(F.col("file_no") < fx.MEMTABLE)).withColumn("level", fx.event_level(F.col("file_no")))
    # snapshot n names the segments 0 to n
    manifests = catalog.withColumn("snapshot", F.explode(F.sequence(F.col("file_no"), F.lit(8).cast("long"))))
    newest_one = manifests.agg(F.max("snapshot").alias("snapshot")).scalar()
    return manifests.where(F.col("snapshot") == newest_one).select("snapshot", "level", "file_no", "first_key", "last_key")


@register(
    f"WITH {EVENTS}, {_BLOOM.format(log='events_log')} SELECT DISTINCT file_no, {_POSITION} AS position FROM (SELECT DISTINCT file_no, key FROM events_log) JOIN params USING (file_no), range(30) r(i) WHERE i < hashes"
)
def bloom_read_back(spark: SparkSession, sf: str) -> DataFrame:
    return segments.bloom_unpacked(segments.bloom_packed(fx.kv_events(spark, sf)))


@register(
    f"""WITH {ORDERS}, {CATALOG}, m AS (SELECT *, CASE WHEN max(last_key) OVER (ORDER BY first_key, last_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= first_key THEN 0 ELSE 1 END AS b FROM catalog WHERE level = 1),
i AS (SELECT file_no, first_key, last_key, sum(b) OVER (ORDER BY first_key, last_key, file_no) - 1 AS island FROM m),
r AS (SELECT i.island, o.key, o.op, o.seq FROM orders_log o JOIN i ON o.key BETWEEN i.first_key AND i.last_key),
w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY island, key ORDER BY seq DESC) = 1)
SELECT island::BIGINT AS island, (SELECT count(*) FROM i WHERE i.island = w.island) AS files, min(key) AS first_key, max(key) AS last_key, count(*) AS entries,
       count(*) FILTER (op = 'put') AS live_entries, sum(seq)::BIGINT AS seq_sum FROM w GROUP BY island"""
)
def merge_by_island(spark: SparkSession, sf: str) -> DataFrame:
    catalog = fx.kv_catalog(spark, sf)
    files = catalog.where("level = 1").select("file_no", "first_key", "last_key")  # ten rows
    entries = fx.kv_orders(spark, sf).drop("file_no").join(F.broadcast(files), F.col("key").between(F.col("first_key"), F.col("last_key")))
    merged = levels.merge_islands(entries.select("file_no", "key", "value", "op", "seq"), catalog)
    live = F.sum((~F.col("is_tombstone")).cast("long")).alias("live_entries")
    return merged.groupBy("island", "files").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), live, F.sum("seq").alias("seq_sum"))


def queries() -> dict[str, Query]:
    """All registered queries, those over written stores too."""
    from seqlake.plans import stored  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)
