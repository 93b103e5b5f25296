"""Changelogs and catalogs derived from the driver's tables, the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File numbers of the events log: 0 to 8 are segments, 9 is the memtable.
MEMTABLE = 9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many versions of each user's key; an error event deletes it; ten events are a batch."""
    events = read(spark, sf_dir, "events")
    last = events.agg((F.max("event_id") + 1).alias("n")).scalar()
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.expr("event_id div 10").alias("batch_id"),
        F.when(gone, "del").otherwise("put").alias("op"),
        F.format_string("u:%08d", "user_id").alias("key"),
        F.when(~gone, F.concat_ws("|", "event_type", "props")).alias("value"),
        F.floor(F.col("event_id") * 10 / last).cast("long").alias("file_no"),
    )


def committed_batches(log: DataFrame) -> DataFrame:
    """Batches of the events log that were committed: all but every seventh."""
    return log.select("batch_id").distinct().where("batch_id % 7 <> 3")


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys: a first generation puts all orders, a second deletes pending and closes finished ones."""
    orders = read(spark, sf_dir, "orders")
    last = orders.agg((F.max("o_orderkey") + 1).alias("n")).scalar()
    key = F.format_string("o:%010d", "o_orderkey").alias("key")
    none = F.lit(None).cast("long").alias("batch_id")
    first = orders.select(F.col("o_orderkey").alias("seq"), none, F.lit("put").alias("op"), key, F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("value"), F.lit(0).cast("long").alias("file_no"))
    gone = F.col("o_orderstatus") == "P"
    second = orders.where("o_orderstatus in ('P', 'F')").select((F.col("o_orderkey") + last).alias("seq"), none, F.when(gone, "del").otherwise("put").alias("op"), key, F.when(~gone, "F|closed").alias("value"), F.lit(1).cast("long").alias("file_no"))
    return first.unionByName(second)


def kv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long multi-byte values; toxic documents are deleted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    gone = F.coalesce("toxic", F.lit(False))
    return docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.lit(None).cast("long").alias("batch_id"),
        F.when(gone, "del").otherwise("put").alias("op"),
        F.concat_ws(":", "lang", F.format_string("%08d", "doc_id")).alias("key"),
        F.when(~gone, F.col("text")).alias("value"),
        F.lit(0).cast("long").alias("file_no"),
    )


def event_level(file_no: F.Column) -> F.Column:
    """Levels of the events log's segments; the memtable has none."""
    return F.when(file_no.between(7, 8), 0).when(file_no.between(4, 6), 1).when(file_no.between(0, 3), 2)


def kv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, file_no, first_key, last_key of ten level-1 files (some overlap) and three level-0 files over the order keys."""
    n = read(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("n")).scalar()
    key = lambda c: F.format_string("o:%010d", c.cast("long"))
    f, w = F.col("id"), F.expr("n div 10")
    sized = spark.range(10).withColumn("n", n)
    lower = sized.select(F.lit(1).alias("level"), f.alias("file_no"), key(f * w).alias("first_key"), key(f * w + w - 1 + F.when(f.isin(1, 4, 5), F.expr("(n div 10) div 10")).otherwise(0)).alias("last_key"))
    upper = spark.createDataFrame([(10, 15, 45), (11, 50, 95), (12, 62, 63)], "file_no long, a long, b long").withColumn("n", n)
    upper = upper.select(F.lit(0).alias("level"), "file_no", key(F.expr("a * n div 100")).alias("first_key"), key(F.expr("b * n div 100")).alias("last_key"))
    return lower.unionByName(upper)
