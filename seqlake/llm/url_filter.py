"""URL filters: rules first, then the likelihood ratio of two character models.

Rules name a host (with all its subdomains) and the beginning of a path; the longest rule that fits decides. The URLs
that rules decide also teach two variable-order Markov models of characters, one of allowed and one of blocked URLs: the
chance of a character after the two before it is smoothed by the chance after one, that by the plain chance, and that by
the uniform one, each by how often its context was seen (Witten and Bell). A URL without a rule is allowed if its
log-likelihood difference per character is at or above a threshold: the point between the two classes' means that lies
the same number of standard deviations from both. A quarter of the labelled URLs, by their MD5, teach no model and
calibrate the threshold, as a model's own URLs look better than new ones; where a class has none in either part, all
labelled URLs serve for both.

Everything is SQL functions. Characters fold into an alphabet of 48, so a model has 48^3 numbers at most whatever the
input; the difference of the two models is one array that a scalar subquery hands to the scoring projection, so nothing
of the corpus is joined. Scores are summed as whole millionths, so results do not depend on the order of rows.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the model
(null: as the empty text, score 0); with one class of labelled URLs or none, every URL without a rule is allowed; repeated rows
count each time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import col, cut, let

#: Every other character is the last one of these.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_:?=&%#~*"
SIZE = len(ALPHABET)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def codes(url: Column) -> Column:
    """Places of the URL's characters in the alphabet, from 0; white space and the rest are the last."""
    folded = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[^a-z0-9./\-_:?=&%#~*]", "*")
    chars = F.filter(F.split(folded, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _grams(code: Column) -> Column:
    """Of each place: the code of the character with the two before it (the URL's start counts as the last character)."""
    ahead = F.concat(F.array(F.lit(SIZE - 1), F.lit(SIZE - 1)), code)

    def grams(ahead: Column) -> Column:
        places = F.when(F.size(ahead) > 2, F.sequence(F.lit(1), F.size(ahead) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.element_at(ahead, i) * SIZE * SIZE + F.element_at(ahead, i + 1) * SIZE + F.element_at(ahead, i + 2))

    return let(ahead, grams)


def difference(labelled: DataFrame) -> DataFrame:
    """One row, one array: ln P(allow) - ln P(block) of each code of three characters, in millionths.

    ``labelled`` has grams (array of codes) and verdict.
    """
    spark = labelled.sparkSession
    counts = labelled.select(F.explode("grams").alias("gram"), "verdict").groupBy("gram").agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("allow"), F.sum((F.col("verdict") == "block").cast("long")).alias("block"))
    counts = cut(counts)  # SIZE^3 rows at most, whatever the input
    shares = {r["c"]: r for r in counts.groupBy(F.expr(f"gram % {SIZE}").alias("c")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()}  # SIZE rows at most
    table = spark.range(0, SIZE**3, 1, 8).select(F.col("id").cast("int").alias("gram")).join(counts, "gram", "left")
    table = table.select("gram", F.expr(f"gram % {SIZE}").alias("c"), F.expr(f"gram div {SIZE} % {SIZE}").alias("b"), F.expr(f"gram div {SIZE * SIZE}").alias("a"), *[F.coalesce(v, F.lit(0)).cast("double").alias(v) for v in ("allow", "block")])
    two, last, context = Window.partitionBy("b", "c"), Window.partitionBy("b"), Window.partitionBy("a", "b")
    for v in ("allow", "block"):
        total, kinds = sum(r[v] for r in shares.values()), sum(r[v] > 0 for r in shares.values())
        plain = F.lit(0.0)
        for c, r in shares.items():
            plain = F.when(F.col("c") == c, float(r[v])).otherwise(plain)
        # counts of each order (n), of its contexts, and how many characters a context was seen before (d)
        table = table.withColumn("n2", F.sum(v).over(two))
        table = table.withColumn("in2", F.sum(v).over(last)).withColumn("d2", F.sum((F.col("n2") > 0).cast("double")).over(last) / SIZE)
        table = table.withColumn("in3", F.sum(v).over(context)).withColumn("d3", F.sum((F.col(v) > 0).cast("double")).over(context))
        p = (plain + kinds * F.lit(1.0 / SIZE)) / float(total + kinds)
        for n, inside, d in (("n2", "in2", "d2"), (v, "in3", "d3")):
            p = F.when(F.col(inside) > 0, (F.col(n) + F.col(d) * p) / (F.col(inside) + F.col(d))).otherwise(p)
        table = table.withColumn(f"p_{v}", p).drop("n2", "in2", "d2", "in3", "d3")
    logs = table.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * 1e6).cast("long").alias("micro"))
    return logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "micro"))), lambda x: x["micro"]).alias("model"))


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``df``: page_id, host, path, rule, verdict, score (log-likelihood difference per character)."""
    url = col(df, url_col)
    host, path = split_url(url)
    rows = df.select(col(df, id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), _grams(codes(F.col("url"))).alias("grams"))
    labelled = rows.where("ruled is not null").select("grams", F.col("ruled").alias("verdict"), (F.substring(F.md5(F.col("url").cast("binary")), 1, 1) < "4").alias("apart"))
    kinds = {(r["verdict"], r["apart"]) for r in labelled.select("verdict", "apart").distinct().collect()}  # four rows at most
    if {v for v, _ in kinds} != {"allow", "block"}:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    teaching, calibrating = (labelled.where("not apart"), labelled.where("apart")) if len(kinds) == 4 else (labelled, labelled)
    model = cut(difference(teaching.select("grams", "verdict")))

    def scored(frame: DataFrame) -> DataFrame:
        total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.element_at(F.col("model"), g + 1))
        frame = frame.withColumn("model", model.scalar())
        return frame.withColumn("micro", F.when(F.size("grams") > 0, F.expr("0L") + F.floor(total / F.size("grams"))).otherwise(F.lit(0)).cast("long")).drop("model", "grams")

    m = F.col("micro").cast("decimal(38,0)")
    stats = scored(calibrating.select("grams", "verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("s"), F.sum((m * m).cast("decimal(38,0)")).alias("q")).collect()
    found = {r["verdict"]: (int(r["n"]), int(r["s"]), int(r["q"])) for r in stats}
    mean = {v: s / n for v, (n, s, q) in found.items()}
    sd = {v: max(q / n - (s / n) ** 2, 1.0) ** 0.5 for v, (n, s, q) in found.items()}
    threshold = round((mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / (sd["allow"] + sd["block"]))
    return scored(rows).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("micro") >= threshold, "allow").otherwise("block")).alias("verdict"), (F.col("micro") / 1e6).alias("score"))
