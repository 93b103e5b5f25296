"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is rendered.

Logs often hold a conversation again after every turn. Each turn is named by a SHA-256 of its role and text where it is
read; the names of a conversation's turns are hashed one after another into rolling prefix hashes. A conversation whose
full hash is a proper prefix hash of another is a snapshot of it and goes by an anti-join; of equal conversations the one
with the smallest id stays. What stays is rendered turn by turn with markers of role and end.

Everything is SQL functions. Conversations are compared by hashes only; texts move once, those of maximal conversations,
to be rendered. Equal conversations are made one before the anti-join, and prefixes are made distinct, so a first turn or
a whole conversation that a third of the log shares is one row there. One conversation becomes one text, so its turns
must fit in a row, as a document must.

Defined results: turns are ordered by number, then role and the text's SHA-256, null first; a null text is empty, a null
role is ``unknown``; the marker's opening inside a text is written with a backslash, so that texts cannot forge turns; a
row with a null conv_id belongs to no other row and is a conversation of one turn (equal ones, and snapshots, go like any
other); repeated rows are turns like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import col, cut, running

OPEN, CLOSE = "<|turn|>", "<|end|>"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def render(turns: Column) -> Column:
    """The turns (role, text) as one text: marker, role, line end, text, marker, line end."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))), "")


def turn_hash(role: Column, text: Column) -> Column:
    """A turn's name; the role's length goes in, so no two turns read like one."""
    return _digest(F.concat_ws(":", F.octet_length(role).cast("string"), role, text))


def prefix_hashes(names: Column) -> Column:
    """The hash of the first name, of the first two, and so on."""
    return running(names, F.unhex(F.lit("")), lambda before, name: F.unhex(F.sha2(F.concat(before, name), 256)), "binary")


def collapse(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_equal (conversations equal to it, itself included), rendered."""
    rows = df.select(col(df, id_col).alias("conv_id"), col(df, turn_col).alias("turn"), F.coalesce(col(df, role_col), F.lit("unknown")).alias("role"), F.coalesce(col(df, text_col), F.lit("")).alias("text"))
    named, loose = rows.where("conv_id is not null"), rows.where("conv_id is null")

    name = turn_hash(F.col("role"), F.col("text"))
    order = [F.col("turn"), F.col("role"), _digest(F.col("text")).alias("digest")]
    turns = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*order, name.alias("name")))).alias("turns"))
    hashes = cut(turns.select("conv_id", prefix_hashes(F.transform("turns", lambda t: t["name"])).alias("hashes")))
    ends = hashes.select("conv_id", F.element_at("hashes", -1).alias("hash"), F.size("hashes").alias("n_turns"))
    ends = ends.unionByName(loose.select("conv_id", F.element_at(prefix_hashes(F.array(name)), 1).alias("hash"), F.lit(1).alias("n_turns")))
    ends = ends.groupBy("hash", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    speaking = hashes.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("hash")).distinct()
    maximal = cut(ends.join(speaking, "hash", "left_anti").select("conv_id", "hash", F.col("n_turns").cast("long").alias("n_turns"), "n_equal"))

    kept = maximal.where("conv_id is not null").select(F.col("conv_id").alias("kept_id"), "n_turns", "n_equal")
    told = named.join(kept, F.col("conv_id") == F.col("kept_id")).select("conv_id", "n_turns", "n_equal", F.struct(*order, F.col("text")).alias("t"))
    told = told.groupBy("conv_id", "n_turns", "n_equal").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = maximal.where("conv_id is null").select(F.col("hash").alias("kept_hash"), "n_turns", "n_equal")
    single = loose.select(F.element_at(prefix_hashes(F.array(name)), 1).alias("hash"), F.struct("role", "text").alias("t")).groupBy("hash").agg(F.first("t").alias("t"))
    single = single.join(alone, F.col("hash") == F.col("kept_hash")).select(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "n_turns", "n_equal", F.array("t").alias("turns"))
    out = lambda frame: frame.select("conv_id", "n_turns", "n_equal", render(F.col("turns")).alias("rendered"))
    return out(told).unionByName(out(single))
