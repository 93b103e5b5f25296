"""Mixing sources to target weights by hierarchical budgeting.

Sources are the leaves of a tree: domain, language, source. A token budget enters at the root and each node deals its
share to its children by weight. A child whose subtree cannot supply its share (tokens times ``epochs``) gives what it
has, and the shortage goes to its siblings, by weight, before any of it returns to an ancestor. Each leaf then reads
seeded epochs: in every epoch its documents come in another order, and the leaf takes the token-prefix of that stream
that fits its budget: whole epochs first, then the first documents of the next one.

All arithmetic is exact: integer weights and tokens, rounded down, so a node may leave up to one token per child unused.
Only sums per leaf and per hash bin are shuffled to one place, and an order is needed only among documents of the one bin
in which a leaf's budget ends. What comes of it is one row for each leaf: its whole epochs, and the place in the next one
up to which it reads. Documents compare their own place with that, so they are never moved.

Defined results: null domain, language or source count as ``unknown``; a null or empty text has 0 tokens and comes
along with the prefix it falls into, and a leaf without tokens gives nothing; documents with the same id have the same place and are taken or left together; a
weight of 0 takes nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import col, cut, fresh, words

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a document's place that make its bin: 4096 bins an epoch and leaf.
DIGITS = 3
#: Leaves (rows of some 200 bytes) up to which the plan is broadcast.
BROADCAST_LEAVES = 20_000
_WHOLE = "decimal(38,0)"


def _weights(columns: tuple[str, ...], weights: Mapping[tuple[str, ...], int] | None) -> Column:
    """The weight of the node that ``columns`` name: 1 where none is given. The mapping is configuration, not data."""
    if not weights:
        return F.lit(1).cast(_WHOLE)
    pairs = [x for path, w in weights.items() for x in (F.lit("\x1f".join(path)), F.lit(int(w)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws("\x1f", *columns)), F.lit(1)).cast(_WHOLE)


def _name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def deal(nodes: DataFrame, parent: tuple[str, ...], budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """``nodes`` with the share ``out`` of the parent's ``budget``: by weight, never over capacity.

    Children are taken by rising capacity for each unit of weight. While a child's capacity is below its share of what
    is left, it is filled; from the first that is not, the rest is dealt by weight.
    """
    # the ratio only sorts; the test below is exact
    order = Window.partitionBy(*parent).orderBy(F.when(F.col(weight) == 0, 0).otherwise(F.col(capacity) / F.col(weight)), F.col(capacity), *LEVELS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast(_WHOLE)
    got = nodes.withColumn("_left", (F.col(budget) - F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(capacity)).otherwise(zero)).over(before), zero)).cast(_WHOLE))
    got = got.withColumn("_rest", F.sum(weight).over(after).cast(_WHOLE))
    full = F.col(capacity) * F.col("_rest") <= F.col("_left") * F.col(weight)
    got = got.withColumn("_full", F.coalesce(F.min(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) == 1)
    whole = Window.partitionBy(*parent)
    filled = F.sum(F.when(F.col("_full") & (F.col(weight) > 0), F.col(capacity)).otherwise(zero)).over(whole)
    open_weight = F.sum(F.when(~F.col("_full"), F.col(weight)).otherwise(zero)).over(whole)
    got = got.withColumn("_spare", (F.col(budget) - filled).cast(_WHOLE)).withColumn("_open", open_weight.cast(_WHOLE))
    share = F.expr(f"cast((_spare * {weight}) div _open as {_WHOLE})")
    got = got.withColumn(out, F.when(F.col(weight) == 0, zero).when(F.col("_full"), F.col(capacity)).otherwise(F.least(share, F.col(capacity))).cast(_WHOLE))
    return got.drop("_left", "_rest", "_full", "_spare", "_open")


def budgets(leaves: DataFrame, total: int | None = None, epochs: int = 2, weights: Mapping[tuple[str, ...], int] | None = None) -> DataFrame:
    """``leaves`` (domain, lang, source, docs, tokens) with ``budget``: tokens to take, from 0 to tokens x epochs.

    ``total`` None means as many tokens as the leaves have.
    """
    tree = leaves.withColumn("c3", (F.col("tokens") * F.lit(epochs)).cast(_WHOLE)).withColumn("w3", _weights(LEVELS, weights))
    # nothing below a weight of 0 can be taken, so it is no capacity either
    tree = tree.withColumn("c3", F.when(F.col("w3") > 0, F.col("c3")).otherwise(F.lit(0).cast(_WHOLE)))
    second = tree.groupBy("domain", "lang").agg(F.sum("c3").cast(_WHOLE).alias("c2"), F.sum("tokens").cast(_WHOLE).alias("t2")).withColumn("w2", _weights(LEVELS[:2], weights))
    second = second.withColumn("c2", F.when(F.col("w2") > 0, F.col("c2")).otherwise(F.lit(0).cast(_WHOLE)))
    first = second.groupBy("domain").agg(F.sum("c2").cast(_WHOLE).alias("c1"), F.sum("t2").cast(_WHOLE).alias("t1")).withColumn("w1", _weights(LEVELS[:1], weights))
    first = first.withColumn("c1", F.when(F.col("w1") > 0, F.col("c1")).otherwise(F.lit(0).cast(_WHOLE))).withColumn("root", F.lit(0)).withColumn("lang", F.lit("")).withColumn("source", F.lit(""))
    first = first.withColumn("b0", F.lit(total).cast(_WHOLE) if total is not None else F.sum("t1").over(Window.partitionBy("root")).cast(_WHOLE))
    first = deal(first, ("root",), "b0", "c1", "w1", "b1").select("domain", "b1")
    second = deal(second.join(first, "domain").withColumn("source", F.lit("")), ("domain",), "b1", "c2", "w2", "b2").select("domain", "lang", "b2")
    third = deal(tree.join(second, ["domain", "lang"]), ("domain", "lang"), "b2", "c3", "w3", "budget")
    return third.select(*LEVELS, "docs", "tokens", F.col("budget").cast("long").alias("budget"))


def _documents(df: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str, tokens_col: str | None) -> DataFrame:
    tokens = words(col(df, text_col)) if tokens_col is None else F.greatest(F.coalesce(col(df, tokens_col), F.lit(0)), F.lit(0))
    return df.select(col(df, id_col).alias("doc_id"), _name(domain).alias("domain"), _name(col(df, lang_col)).alias("lang"), _name(col(df, source_col)).alias("source"), tokens.cast("long").alias("n_tokens"))


def mix(
    df: DataFrame,
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    total: int | None = None,
    epochs: int = 2,
    seed: int = 42,
    weights: Mapping[tuple[str, ...], int] | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``df``: doc_id, domain, lang, source, n_tokens, budget (its leaf's) and copies (0 to epochs).

    Tokens are the words between ASCII white space, or what ``tokens_col`` says (a tokenizer's counts; null or below 0 is 0).
    """
    docs = _documents(df, domain, id_col, text_col, lang_col, source_col, tokens_col)
    docs = cut(docs)  # small columns only; texts are read and counted once
    plan, few = _plan(docs, total, epochs, seed, weights)
    met = docs.join(few(plan), list(LEVELS), "left")
    return met.select("doc_id", *LEVELS, "n_tokens", "budget", _copies(seed, F.col("doc_id"), {c: F.col(c) for c in PLAN}).alias("copies"))


#: What a leaf's row of the plan says: whole epochs, tokens of the next one, the bin in which they end, and the last place
#: of that bin that still fits (null: none does).
PLAN = ("whole", "part", "last", "edge")


def _place(seed: int, whole: Column, doc_id: Column) -> Column:
    """A document's place in the epoch after ``whole`` ones."""
    return F.md5(F.concat(F.lit(f"{seed}:"), whole.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _copies(seed: int, doc_id: Column, plan: Mapping[str, Column]) -> Column:
    place = _place(seed, plan["whole"], doc_id)
    read = (F.substring(place, 1, DIGITS) < plan["last"]) | (place <= plan["edge"])
    return (plan["whole"] + F.when((plan["part"] > 0) & read, 1).otherwise(0)).cast("long")


def _plan(docs: DataFrame, total: int | None, epochs: int, seed: int, weights: Mapping[tuple[str, ...], int] | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Budget and PLAN of each leaf of ``docs`` (doc_id, n_tokens and LEVELS), and what to join it with."""
    leaves = docs.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    plan = cut(budgets(leaves, total, epochs, weights))
    small = plan.count() <= BROADCAST_LEAVES  # beyond it a shuffled join, whose hot leaves AQE splits
    few = F.broadcast if small else lambda frame: frame
    plan = plan.select(*LEVELS, "budget", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).alias("whole"), F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("part"))
    placed = docs.join(few(plan.where("part > 0")), list(LEVELS)).withColumn("place", _place(seed, F.col("whole"), F.col("doc_id")))
    placed = placed.withColumn("bin", F.substring("place", 1, DIGITS)).select(*LEVELS, "part", "n_tokens", "place", "bin")
    bins = placed.groupBy(*LEVELS, "bin", "part").agg(F.sum("n_tokens").alias("here"))
    last = bins.withColumn("upto", F.sum("here").over(Window.partitionBy(*LEVELS).orderBy("bin"))).where("upto > part")
    last = last.groupBy(*LEVELS).agg(F.min(F.struct("bin", (F.col("upto") - F.col("here")).alias("before"))).alias("m"))
    last = cut(last.select(*LEVELS, F.col("m.bin").alias("last"), F.col("m.before").alias("before")))
    within = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ending = placed.join(few(last), list(LEVELS)).where("bin = last").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    edge = ending.where("upto <= part").groupBy(*LEVELS).agg(F.max("place").alias("edge"))
    return cut(plan.join(last.drop("before"), list(LEVELS), "left").join(edge, list(LEVELS), "left").select(*LEVELS, "budget", *PLAN)), few


def take(
    df: DataFrame,
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    total: int | None = None,
    epochs: int = 2,
    seed: int = 42,
    weights: Mapping[tuple[str, ...], int] | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """The rows of ``df``, all columns, each as often as ``mix`` says: rows of one id and leaf have the same copies."""
    docs = cut(_documents(df, domain, id_col, text_col, lang_col, source_col, tokens_col))
    plan, few = _plan(docs, total, epochs, seed, weights)
    names = {c: fresh(df, f"mix_{c}") for c in (*LEVELS, *PLAN)}
    plan = plan.select(*[F.col(c).alias(name) for c, name in names.items()])
    leaf = zip(LEVELS, (domain, col(df, lang_col), col(df, source_col)))
    here = {level: fresh(df, f"own_{level}") for level in LEVELS}
    rows = df.select("*", *[_name(c).alias(here[level]) for level, c in leaf])
    same = [F.col(here[level]) == F.col(names[level]) for level in LEVELS]
    copies = _copies(seed, col(rows, id_col), {c: F.col(names[c]) for c in PLAN})
    met = rows.join(few(plan), same).withColumn(names["part"], copies).where(F.col(names["part"]) > 0)
    again = met.withColumn(names["whole"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["part"]))))
    return again.drop(*here.values(), *names.values())
