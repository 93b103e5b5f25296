"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every text contract here defines it.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if configured:
        context.setCheckpointDir(configured)
    elif (context.master or "").startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seqlake-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: lineage ends here, a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:6]}"
    return name


def col(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression used inside a lambda would be computed at each call."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Values of one block of ``running``.
BLOCK = 128


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``op`` makes of ``zero`` and the values up to each one of the array ``values``: an array of ``kind``.

    An array that grows by one at each step is copied each time, so blocks are filled first and then put together.
    """

    def grown(acc: Column, more: Column, last: Column) -> Column:
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(more)).alias("out"))

    def start(at: Column, inner: str) -> Column:
        return F.struct(at.alias("at"), F.array().cast(f"array<{inner}>").alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inside = F.aggregate(part, start(acc["at"], kind), lambda a, x: let(op(a["at"], x), lambda y: grown(a, y, y)))
        return let(inside, lambda done: grown(acc, done["out"], done["at"]))

    def whole(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(starts, lambda at: F.slice(v, at, BLOCK)), start(zero, f"array<{kind}>"), block, lambda acc: F.flatten(acc["out"]))

    return let(values, whole)


def nothing(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
