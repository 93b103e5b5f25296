"""Edge cases, the store against a dictionary, streaming, and binary formats."""

import random

import pytest
from pyspark.sql import functions as F

from seqlake.functions.kv import checksum, little_endian, within_limits
from seqlake.model import LOG, Limits
from seqlake.operators import levels, reads, segments, wal
from seqlake.sources import binary
from seqlake.store import Store

SMALL = Limits(levels=(200, 400, 1600, 6400), segment_bytes=200)


def log(spark, *ops):
    return spark.createDataFrame([(k, None, op, key, value, None) for k, (op, key, value) in enumerate(ops)], LOG)


def pairs(frame):
    return {r["key"]: r["value"] for r in frame.collect()}


def test_newest_wins_and_deletes_hide(spark):
    frame = log(spark, ("put", "a", "1"), ("put", "b", ""), ("put", "a", "2"), ("del", "b", None), ("put", "c", ""), ("del", "z", None))
    assert pairs(reads.live(frame)) == {"a": "2", "c": ""}
    assert {r["key"] for r in reads.tombstones(frame).collect()} == {"b", "z"}
    assert {r["key"] for r in reads.contains(frame, ["a", "b", "q"]).collect()} == {"a", "b"}
    assert reads.get(frame, "b").count() == 0
    assert reads.count_keys(frame).first()[0] == 4
    assert pairs(reads.live(frame.limit(0))) == {}


def test_scan_is_bytewise_inclusive_and_sorted(spark):
    frame = log(spark, *[("put", k, k) for k in ("b", "Z", "é", "a", "z", "aa")])
    assert [r["key"] for r in reads.scan(frame, "Z", "z").collect()] == ["Z", "a", "aa", "b", "z"]
    assert reads.scan(frame, "z", "a").count() == 0


def test_merge_prefers_the_first_source(spark):
    young, old = log(spark, ("put", "b", "new"), ("del", "d", None)), log(spark, ("put", "a", "1"), ("put", "b", "old"), ("put", "c", "3"), ("put", "d", "4"))
    assert pairs(reads.merge([young, old])) == {"a": "1", "b": "new", "c": "3"}


def test_checksum_and_limits(spark):
    row = spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("v"), F.hex(little_endian(F.lit(0x01020304))).alias("le")).first()
    assert (row["v"], row["le"]) == (0xCBF43926, "04030201")
    frame = spark.createDataFrame([("", ""), ("k", ""), ("k" * (1 << 20), "v"), ("k" * ((1 << 20) + 1), "v"), ("k", "v" * ((1 << 20) + 1)), ("k", None)], "key string, value string")
    assert [r[0] for r in frame.select(within_limits(F.col("key"), F.col("value"))).collect()] == [False, True, True, False, False, True]


def test_records_are_as_the_binary_log_has_them(spark):
    frame = log(spark, ("put", "ké", "välue"), ("del", "k", None), ("put", "k", ""))
    got = wal.record_sizes(wal.checksums(frame)).orderBy("seq").collect()
    for r in got:
        record = binary.encode_op(r["op"], r["key"].encode(), (r["value"] or "").encode())
        assert len(record) == r["record_bytes"] and int.from_bytes(record[-4:], "little") == r["crc"]


def test_prefix_batches_and_running_sum(spark):
    frame = log(spark, *[("put", f"k{k}", str(k)) for k in range(10)])
    assert wal.valid_prefix(frame).count() == 10
    assert wal.valid_prefix(frame, F.col("seq") != 6).count() == 6
    assert wal.quarantine(frame, F.col("seq") != 6).count() == 4
    assert wal.valid_prefix(frame.limit(0)).count() == 0
    tagged = frame.withColumn("batch_id", F.when(F.col("seq") < 8, F.expr("seq div 4")))
    done = spark.createDataFrame([(1,)], "batch_id long")
    assert {r["key"] for r in wal.replay(tagged, done).collect()} == {f"k{k}" for k in range(4, 10)}
    summed = wal.running_sum(frame.withColumn("v", F.lit(2)), "seq", "v", "s", width=3).orderBy("seq")
    assert [r["s"] for r in summed.collect()] == list(range(2, 22, 2))


def test_bloom_never_denies_a_key(spark):
    frame = log(spark, *[("put" if k % 3 else "del", f"key{k}", str(k)) for k in range(300)]).withColumn("file_no", F.col("seq") % 2)
    asked = spark.createDataFrame([(f"key{k}",) for k in range(600)], "key string")
    got = segments.bloom_probe(frame, asked)
    there = {(r["file_no"], r["key"]) for r in frame.collect()}
    found = {(r["file_no"], r["key"]) for r in got.where("may_contain").collect()}
    assert there <= found and len(found - there) < 60


def test_keys_find_the_files_that_can_hold_them(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé", k=rng.randrange(1, 5)))
    files = [(k, *sorted((word(), word()), key=str.encode)) for k in range(40)] + [(40, "a", "zz"), (41, "q", "q")]
    keys = sorted({word() for _ in range(60)} | {"", "q", "zzz", "a"})
    catalog = spark.createDataFrame(files, "file_no long, first_key string, last_key string")
    asked = spark.createDataFrame([(k,) for k in [*keys, keys[3], None]], "key string")
    want = sorted((f, k) for f, a, b in files for k in keys if a.encode() <= k.encode() <= b.encode())
    for at_once in (1000, 7):
        assert sorted(map(tuple, segments.candidates(asked, catalog, at_once).collect())) == want
    assert segments.candidates(asked, catalog.limit(0)).count() == 0


def test_filters_meet_keys_block_by_block(spark):
    frame = log(spark, *[("put", f"key{k:04d}", "") for k in range(200)]).withColumn("file_no", F.lit(3).cast("long"))
    asked = spark.createDataFrame([(f"key{k:04d}",) for k in range(190)] + [("key0005x",)], "key string")
    few, many = (sorted(map(tuple, segments.bloom_probe(frame, asked, block).collect())) for block in (7, 4096))
    assert few == many and len(few) == 191 and all(may for _, key, may in few if len(key) == 7)
    packed = segments.bloom_packed(frame)
    assert sorted(map(tuple, segments.bloom_unpacked(packed).collect())) == sorted(map(tuple, segments.bloom_filters(frame).collect()))


def test_large_flushes_are_cut_by_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Limits(segment_bytes=1000))
    frame = log(spark, *[("put" if k % 5 else "del", f"k{k % 97:03d}", "v" * 20 if k % 5 else None) for k in range(300)])
    store.append(frame)
    store.flush()
    parts = sorted((s.first_key, s.last_key) for s in store.snapshot.segments)
    assert len(parts) > 3 and all(a[1] < b[0] for a, b in zip(parts, parts[1:])) and {s.level for s in store.snapshot.segments} == {0}
    assert pairs(Store(spark, store.root, store.limits).scan("", "z")) == pairs(reads.live(frame))
    store.put("k001", "new")
    store.flush()
    store.compact()
    assert store.value("k001") == "new" and {s.level for s in store.snapshot.segments} == {1}


def test_islands_and_overlaps(spark):
    rows = [(1, 0, "a", "c"), (1, 1, "c", "f"), (1, 2, "g", "h"), (0, 3, "b", "g"), (0, 4, "x", "y")]
    catalog = spark.createDataFrame(rows, "level int, file_no long, first_key string, last_key string")
    assert [r["island"] for r in levels.islands(catalog).orderBy("file_no").collect()] == [0, 0, 1]
    assert {r["file_no"]: r["n_overlaps"] for r in levels.overlap_counts(catalog).collect()} == {3: 3, 4: 0}
    assert levels.pick(catalog).first()["file_no"] == 3
    assert {r["file_no"] for r in levels.overlapping(catalog, 1, "d", "e").collect()} == {1}


def test_store_edges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SMALL)
    store.put("a", "1")
    store.flush()
    store.put("a", "2")
    store.delete("b")
    store.flush()
    assert store.value("a") == "2" and store.get("a").first()["origin"] == "segment"
    store.compact()
    assert store.value("a") == "2" and store.value("b") is None
    store.delete("a")
    store.flush()
    assert store.value("a") is None
    store.compact()
    assert store.value("a") is None and store.scan("", "z").count() == 0
    for bad in ("", "k" * ((1 << 20) + 1)):
        with pytest.raises(ValueError):
            store.put(bad, "v")
    with pytest.raises(ValueError):
        store.put("k", "v" * ((1 << 20) + 1))
    with store.begin() as batch:
        batch.put("x", "1").delete("y")
        store.put("z", "3")
        assert store.value("x") is None
        with pytest.raises(ValueError):
            store.begin()
        with pytest.raises(ValueError):
            store.flush()
    assert store.value("x") == "1" and store.value("z") == "3"
    store.begin().put("lost", "1")
    store.rollback()
    assert store.value("lost") is None
    assert [r["files"] for r in store.stats().orderBy("level").collect()] == [0, 0, 0, 0]
    assert store.flush() and store.flush()


def test_store_is_a_dictionary(spark, tmp_path):
    rng, model = random.Random(5), {}
    root = str(tmp_path / "s")
    store = Store(spark, root, SMALL)
    for step in range(6):
        ops = []
        for _ in range(25):
            key = f"k{rng.randrange(30):02d}"
            ops.append(("del", key, None) if rng.random() < 0.3 else ("put", key, f"v{step}-{rng.randrange(1000)}"))
        with store.begin() as batch:
            for op, key, value in ops:
                batch.put(key, value) if op == "put" else batch.delete(key)
        for op, key, value in ops:
            model.pop(key, None) if op == "del" else model.__setitem__(key, value)
        if step % 2 == 0:
            store.flush()
        if step == 3:
            store.compact()
        if step == 4:
            store.maintain()
        if step == 2:
            store = Store(spark, root, SMALL)  # recovery finds the log and the segments
        assert pairs(store.scan("", "zz")) == model
    store.close()
    again = Store(spark, root, SMALL)
    assert pairs(again.scan("k05", "k20")) == {k: v for k, v in model.items() if "k05" <= k <= "k20"}
    assert pairs(again.multi_get(["k01", "k02", "nope"])) == {k: model[k] for k in ("k01", "k02") if k in model}
    assert again.maintain() >= 0 and pairs(again.scan("", "zz")) == model


def test_shell_cache_and_rebuild(spark, tmp_path):
    from seqlake.shell import run

    store = Store(spark, str(tmp_path / "s"), SMALL)
    said = list(run(store, ["put a 1", "get a", "begin", "begin", "put b 2", "get b", "flush", "commit", "del a", "save", "get a", "get b", "scan a z", "scan x z", "what", "compact", "stats", "quit", "get b"]))
    assert said[:13] == ["ok", "1", "ok", "refused: a batch is open", "ok", "not found", "refused: a batch is open", "ok", "ok", "ok", "not found", "2 (from segment)", "b:2"]
    assert said[13] == "no keys in this range" and said[14].startswith("put KEY") and said[15] == "ok" and said[16].startswith("level 0: 0 files") and said[-1] == "ok" and len(said) == 21
    store.cache()
    assert store.value("b") == "2"
    store.put("c", "3")
    store.flush()
    store.put("b", "4")
    assert pairs(store.scan("", "z")) == {"b": "4", "c": "3"}
    store.uncache()
    store.files.remove(f"{store.root}/CURRENT")
    store.files.remove(f"{store.root}/manifests")
    lost = Store(spark, store.root, SMALL)
    lost.rebuild()
    assert pairs(lost.scan("", "z")) == {"b": "4", "c": "3"}


def test_streams(spark, tmp_path):
    from seqlake.streaming.ingest import into_store, live_view

    frame = log(spark, *[("del" if k % 7 == 3 else "put", f"k{k % 5}", None if k % 7 == 3 else str(k)) for k in range(40)])
    for part in range(4):
        frame.where(F.expr("seq div 10") == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    want = pairs(reads.live(frame))

    def stream(files):
        return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    store = Store(spark, str(tmp_path / "s"), Limits(flush_entries=15))
    # files written within one second have no order, and a store takes rising seq only: one micro-batch
    into_store(stream(9), store, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert pairs(store.scan("", "z")) == want
    query = live_view(stream(1)).writeStream.format("memory").queryName("view").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("view").groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone"), "seq").alias("e")).where("not e.is_tombstone").select("key", "e.value")
    assert pairs(got) == want


def test_binary_formats(spark, tmp_path):
    good = binary.encode_op("put", b"a", b"1") + binary.encode_batch([("put", b"b", b"\xff\x00"), ("del", b"a", b"")])
    torn = bytearray(binary.encode_op("put", b"c", b"3"))
    torn[-1] ^= 1
    (tmp_path / "wal.log").write_bytes(good + bytes(torn) + binary.encode_op("put", b"d", b"4"))
    rows = binary.read_log(spark, str(tmp_path / "wal.log")).orderBy("seq").collect()
    assert [(r["seq"], r["batch_id"], r["op"], bytes(r["key"]), r["value"] and bytes(r["value"])) for r in rows] == [(0, None, "put", b"a", b"1"), (1, 0, "put", b"b", b"\xff\x00"), (2, 0, "del", b"a", None)]
    assert [r[3] for r in binary.decode_log(bytes([2]) + binary.encode_op("put", b"x", b"") + bytes([2]) + binary.encode_op("put", b"y", b"") + bytes([3]))] == [b"y"]
    assert binary.valid_bytes(good + bytes(torn)) == len(good) and binary.valid_bytes(good[:-1]) == len(binary.encode_op("put", b"a", b"1"))
    assert list(binary.decode_log(good[:5])) == [] and list(binary.decode_log(b"")) == []

    (tmp_path / "seg").mkdir()
    content = binary.encode_segment([(b"b", b""), (b"a", None), (b"c", b"33")])
    (tmp_path / "seg/7.sst").write_bytes(content)
    rows = binary.read_segments(spark, str(tmp_path / "seg")).orderBy("key").collect()
    assert [(r["file_no"], bytes(r["key"]), r["is_tombstone"], r["offset"]) for r in rows] == [(7, b"a", True, 0), (7, b"b", False, 6), (7, b"c", False, 16)]
    frame = spark.createDataFrame([(0, None, "put", "b", "", 7), (1, None, "del", "a", None, 7), (2, None, "put", "c", "33", 7)], LOG)
    assert segments.file_sizes(frame).first()["file_size"] == len(content)
    (tmp_path / "seg/12.sst").write_bytes(binary.encode_segment([(b"b", None), (b"a", b"new")]))
    assert pairs(reads.live(binary.as_log(binary.read_segments(spark, str(tmp_path / "seg"))))) == {"a": "new", "c": "33"}
    with pytest.raises(ValueError):
        list(binary.decode_segment(b"short"))

    manifest = binary.encode_manifest({0: [("7.sst", len(content), b"a", b"c", 7)], 1: []})
    (tmp_path / "seg/MANIFEST-1").write_bytes(manifest)
    (tmp_path / "seg/CURRENT").write_text("MANIFEST-1\n")
    row = binary.read_manifest(spark, str(tmp_path / "seg")).first()
    assert (row["level"], row["filename"], row["version"]) == (0, "7.sst", 7)
    with pytest.raises(ValueError):
        list(binary.decode_manifest(manifest[:-3]))


def test_tasks_write_the_binary_files(spark, tmp_path, monkeypatch):
    """The driver puts no content together, and each byte is as the encoders have it."""
    ops = [(k, k // 3 if k % 11 else None, "del" if k % 5 == 0 else "put", f"ké{k % 70}", None if k % 5 == 0 else "\n\r" + chr(k) * (k % 9), k % 4) for k in range(3000)]
    marks = [(op[1] is not None and all(o[1] != op[1] for o in ops[max(0, k - 3) : k]), op[1] is not None and op[1] % 7 != 3 and all(o[1] != op[1] for o in ops[k + 1 : k + 4])) for k, op in enumerate(ops)]
    records = [bytes([2]) * a + binary.encode_op(op[2], op[3].encode(), (op[4] or "").encode()) + bytes([3]) * b for op, (a, b) in zip(ops, marks)]
    frame = spark.createDataFrame(ops, LOG).repartition(5)
    done = frame.select("batch_id").distinct().where("batch_id % 7 <> 3")
    by_driver, write = [], binary.Files.write

    def spy(self, path, content):
        by_driver.append(path)
        write(self, path, content)

    monkeypatch.setattr(binary.Files, "write", spy)
    monkeypatch.setattr(binary, "PIECE", 100, raising=False)
    path = tmp_path / "log/wal.log"
    for n in (3000, 2999, 2998, 12, 1):  # logs that end within a batch, with a mark, and with a checksum
        binary.write_log(frame.where(F.col("seq") < n), str(path), done)
        want = b"".join(records[:n])
        if not marks[n - 1][1] and ops[n - 1][1] is not None and ops[n - 1][1] % 7 != 3:
            want += bytes([3])  # the last of its batch that there is
        assert path.read_bytes() == want and [f.name for f in path.parent.iterdir() if not f.name.startswith(".")] == ["wal.log"]
    newest = segments.entries(frame)
    binary.write_segments(newest, str(tmp_path / "seg"))
    held = {k: [] for k in range(4)}
    for r in newest.collect():
        held[r["file_no"]].append((r["key"].encode(), None if r["is_tombstone"] else r["value"].encode()))
    assert {f.name: f.read_bytes() for f in (tmp_path / "seg").iterdir() if not f.name.startswith(".")} == {f"{k}.sst": binary.encode_segment(v) for k, v in held.items()}
    assert not by_driver

    # with a last byte that is too rare to cut lines by, the driver writes the log
    monkeypatch.setattr(binary, "HELD", 50, raising=False)
    binary.write_log(frame.where(F.col("seq") < 2998), str(path), done)
    assert by_driver == [str(path)] and binary.valid_bytes(path.read_bytes()) > 0 and [r[0] for r in binary.decode_log(path.read_bytes())][:5] == [0, 1, 2, 3, 4]
    binary.write_log(frame.limit(0), str(path))
    assert path.read_bytes() == b""


def test_a_log_is_read_in_pieces(spark, tmp_path, monkeypatch):
    """Logs that Spark cuts anywhere give what the whole content gives; no file is read as one row."""
    dice, logs = random.Random(3), {}
    for k in range(6):
        ops = [("put", dice.randbytes(dice.randint(1, 9)), dice.choice((b"", b"\xef\xbb\xbf", b"\xef", bytes(range(256)), b"\0" * 5000))) for _ in range(300)]
        logs[f"{k}.log"] = b"".join(binary.encode_batch(ops[n : n + 3]) if dice.random() < 0.5 else binary.encode_op(*ops[n]) for n in range(300))
    logs["1.log"] = logs["1.log"][:-1]  # torn
    logs["2.log"] = b"\xef\xbb\xbf" + logs["2.log"]  # not a record, though readers of text leave such bytes out
    logs["3.log"] += bytes([2]) + b"\xef"
    logs["4.log"] = binary.encode_op("put", b"k" * (1 << 20), b"v" * (1 << 20)) + logs["4.log"]
    logs["empty.log"] = b""
    for name, content in logs.items():
        (tmp_path / name).write_bytes(content)
    want = [row for content in logs.values() for row in binary.decode_log(content)]
    formats, reader = [], type(spark.read)
    plain = reader.format
    monkeypatch.setattr(reader, "format", lambda self, name: formats.append(name) or plain(self, name))
    monkeypatch.setattr(binary, "PIECE", 1000, raising=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7777")
    try:
        rows = [(r[0], r[1], r[2], bytes(r[3]), r[4] and bytes(r[4])) for r in binary.read_log(spark, str(tmp_path)).collect()]
        alone = binary.read_log(spark, str(tmp_path / "4.log")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda row: tuple((v is not None, v) for v in row)
    assert len(rows) > 1000 and sorted(rows, key=key) == sorted(want, key=key) and alone == len(list(binary.decode_log(logs["4.log"])))
    assert "binaryFile" not in formats


def test_every_record_of_the_logs_has_a_checksum(spark):
    import zlib

    from seqlake.plans.queries import queries
    from seqlake.sources import fixtures as fx

    sf, sized = "/root/testdata/sf0.001", lambda b: len(b).to_bytes(4, "little") + b
    want = {}
    for name, log in (("events", fx.kv_events(spark, sf)), ("documents", fx.kv_docs(spark, sf))):
        for r in log.collect():
            put = r["op"] == "put"
            want[name, r["seq"]] = zlib.crc32((b"\0" if put else b"\1") + sized(r["key"].encode()) + sized((r["value"] or "").encode() if put else b""))
    got = queries()["wal_log_crc32"](spark, sf).collect()
    assert len(got) == len(want) == 1200 and {(r["log"], r["seq"]): r["crc"] for r in got} == want


def test_maintain_goes_on_until_levels_fit(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    store = Store(spark, str(tmp_path / "m"), SMALL)
    files = [SimpleNamespace(level=0, version=i, first_key=f"k{i:03d}", last_key=f"k{i:03d}", file_size=store.limits.level(0)) for i in range(150)]
    store.snapshot = SimpleNamespace(segments=files)

    def merge(group, level):
        for s in group:
            s.level, s.file_size = level, 0

    monkeypatch.setattr(store, "_merge", merge)
    assert store.maintain(most=10) == 10
    assert store.maintain() == 139 and sum(s.level == 0 for s in files) == 1
