"""Structured Streaming: a stream of operations into a store, and the live view as per-key state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seqlake.operators.reads import latest
from seqlake.store import Store

#: What a stream of operations has: ``seq`` is unique, and its order is the order of arrival.
COLUMNS = ("seq", "batch_id", "op", "key", "value")


def into_store(stream: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    """Appends each micro-batch as one atomic append; size triggers flush and maintain the store.

    A micro-batch that comes again after a failure holds only rows up to what the store has: they are left out, so each
    operation counts once. Operations that arrive late within a key lose to higher ``seq`` when they are read.
    """

    def write(frame: DataFrame, _: int) -> None:
        fresh = frame.where(F.col("seq") >= store.next_seq).select(*COLUMNS, F.lit(None).cast("long").alias("file_no"))
        store.append(fresh)
        store.maintain()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_view(stream: DataFrame) -> DataFrame:
    """key, value, is_tombstone, seq: the newest row of each key that a micro-batch has touched.

    Rows of a key may arrive in any order: one that is older than the state leaves it as it is. A stateful arg-max, so a
    micro-batch sends one row for each key and task, and all stays in the JVM. Use output mode update.
    """
    return latest(stream)
