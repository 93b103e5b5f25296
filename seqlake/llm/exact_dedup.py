"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where its own content says so, each chunk gets an identifier of 64 bits, and a document becomes
the ordered list of its chunks' identifiers (its recipe). Identifiers are verified by the chunks' SHA-256 digests: the
distinct pairs of identifier and digest are brought together by identifier, and where two digests share one, an ordinal
tells them apart, so equal recipes mean equal texts as surely as SHA-256 does. Texts are read and cut once, and never
move: what is kept of a document are 8 bytes and a digest for each chunk, what is compared are the recipes.

Defined results: a null text counts as empty; all empty texts are one group; a text of white space only is one space
and a group apart from the empty one; rows that repeat both doc_id and text are marked alike by ``decide`` (``repeats``
counts them) and ``dedup`` returns one of them; null doc_ids are never preferred over other ids, and a group of null
doc_ids only has keep_id null; an empty table gives an empty result; other columns are not read. One text and its chunks
must fit in a row, as a document must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import WHITE, col, cut, fresh, nothing

#: A chunk ends after punctuation and a space, or after a vowel before a space where the next word begins with a-m.
BOUNDARY = r"(?:[.,;:!?]\x20|[a-z][aeiou]\x20(?=[a-m]))"


def normalise(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks(text: Column, least: int = 384, most: int = 4096) -> Column:
    """``text`` cut at content-defined places into an array of pieces whose concatenation is ``text``.

    A piece has ``least`` characters or more, but for the last, and at most about ``most``.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 384, most: int = 4096, id_bits: int = 64) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, repeats.

    ``id_bits`` shortens the identifiers (tests use it to force two contents onto one identifier).
    """
    name = lambda c: F.xxhash64(c) if id_bits >= 64 else F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits)
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    texts = df.select(col(df, id_col).alias("doc_id"), normalise(col(df, text_col)).alias("norm"))
    texts = texts.select("doc_id", digest(F.col("norm")).alias("sha"), chunks(F.col("norm"), least, most).alias("pieces"))
    # the only pass over texts
    docs = cut(texts.select("doc_id", "sha", F.transform("pieces", lambda c: F.struct(name(c).alias("name"), digest(c).alias("digest"))).alias("chunks")))

    named = docs.select(F.explode("chunks").alias("c")).groupBy("c.name", "c.digest").agg(F.count(F.lit(1)).alias("n"))
    shared = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    recipes = docs.select("doc_id", "sha", F.transform("chunks", lambda c: c["name"]).alias("recipe"))
    if nothing(shared):
        recipes = recipes.withColumn("ordinals", F.array().cast("array<int>"))
    else:
        recipes = recipes.join(_ordinals(docs, named, shared), "sha", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<int>")))

    rows = cut(recipes.groupBy("doc_id", "recipe", "ordinals", "sha").agg(F.count(F.lit(1)).alias("repeats")))
    groups = rows.groupBy("recipe", "ordinals").agg(F.min("doc_id").alias("keep_id"), F.sum("repeats").alias("group_size"))
    # only groups of several rows come back, cut so that both sides of the join are plain exchanges that AQE can split
    groups = cut(groups.where("group_size > 1"))
    joined = rows.join(groups, ["recipe", "ordinals"], "left")
    joined = joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.size("recipe").alias("n_chunks"),
        "repeats",
    )
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy"))
    return again.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chunks", "repeats")


def _ordinals(docs: DataFrame, named: DataFrame, shared: DataFrame) -> DataFrame:
    """sha and ordinals of each text that has a chunk whose identifier stands for several digests, in order of place."""
    # few digests share an identifier with another, and few share the same one
    order = named.join(shared.select("name"), "name", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("name").orderBy("digest")))
    order = cut(order.select("name", "digest", "ordinal"))
    # a text is named by its digest, so a long one isn't carried along with each of its chunks
    placed = docs.select("sha", F.posexplode("chunks").alias("place", "c")).select("sha", "place", "c.name", "c.digest").distinct()
    return placed.join(order, ["name", "digest"]).groupBy("sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal"))), lambda x: x["ordinal"]).alias("ordinals"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of equal texts the row with the smallest doc_id, once."""
    kept = cut(decide(df, id_col, text_col, **options).where("kept").select("doc_id", F.unhex("text_sha256").alias("text_sha256"), "repeats").distinct())
    a, b, sha = fresh(df, "keep_id"), fresh(df, "keep_sha"), fresh(df, "sha")
    keys = kept.select(F.col("doc_id").alias(a), F.col("text_sha256").alias(b), "repeats")
    hashed = df.withColumn(sha, F.unhex(F.sha2(normalise(col(df, text_col)).cast("binary"), 256)))
    same = col(hashed, id_col).eqNullSafe(F.col(a)) & (F.col(sha) == F.col(b))
    if nothing(kept.where("repeats > 1")):
        return hashed.join(keys, same, "left_semi").drop(sha)
    once = hashed.join(keys.where("repeats = 1"), same, "left_semi")
    several = hashed.join(keys.where("repeats > 1"), same, "left_semi").dropDuplicates([id_col, sha])
    return once.unionByName(several).drop(sha)
