"""Secret scans: three fixed rules, and a battery of randomness tests on everything else that looks like a key.

Rules find assignments (``assign``), access keys (``access``) and hexadecimal runs (``hex``). The battery (``random``)
takes each run of 20 or more key characters, infers its encoding (hexadecimal, base 32, or base 64 and its URL form) and
tests the sequence of its symbol values. Each test asks how well the run would fit something that is no key:

* chi-squared against the uniform alphabet: a run whose symbols coincide UNEVEN times as often as uniform ones do;
* the number of runs above and below the alphabet's middle: a run that turns as rarely, or as often, as TURN says;
* the serial correlation of neighbours: a run whose values follow one another with a correlation of SERIAL;
* the ratio of likelihoods, text to uniform symbols, where text stays in a kind of character for long stretches and has
  letters as often as languages have them (by Markov's inequality a run of that model falls below any p with a chance of
  p at most).

A key must be unlike all of them, so the p-value of a run is the largest of the four, and holds whichever of these the
run came from. Runs are then discoveries under control of the false-discovery rate (Benjamini and Hochberg) within
classes of length and encoding, as a short run carries less evidence, and a base-16 symbol less than one of base 64.
P-values are rounded up to bins, so the histogram of a class is all that comes together, and the rate holds.

Everything is SQL functions. Positions come from the lengths of matches and of what lies between them, summed block by
block, so a text with many matches takes little more than time in proportion.

Defined results: null and empty texts have no spans; spans count code points, end exclusive; spans of one kind do not
overlap, and a ``random`` span that touches a span of another kind is left out; repeated rows give repeated rows; an
empty table gives an empty result; other columns are not read. The spans of one text must fit in a row, as the text must.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import col, cut, let, running

KINDS = ("assign", "access", "hex", "random")
_SPAN = "struct<start:int,end:int,held:string>"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the battery tests.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Symbols, padding apart, that the battery needs.
SHORTEST = 16
#: Alphabets by encoding; URL forms of base 64 are read with + and /.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: What is no key: symbols that coincide so many times as often as uniform ones, such a share of turns (or of none),
#: and such a serial correlation.
UNEVEN, TURN, SERIAL = 8.0, 0.05, 0.9
#: How often letters stand in 1,000 of running text, roughly, over English, French, German and Spanish.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (85, 14, 32, 46, 148, 13, 17, 29, 70, 5, 7, 45, 27, 74, 59, 22, 7, 66, 71, 68, 46, 13, 11, 5, 9, 6)))
#: Chance that a character is followed by one of its kind (capitals, small letters, digits, signs) in what is no key.
STAY = 0.9
#: Lengths that begin a class.
CLASSES = (20, 28, 40, 64, 128)
#: Bins of a decade of p-values, and the last bin.
BINS, LAST = 20, 400


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of ``pattern``: array of (start, end, what group ``group`` holds)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # each match with what lies before it; what lies behind the last is left out
    sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda g, w: F.struct((F.char_length(g) + F.char_length(w)).alias("step"), F.char_length(w).alias("own")))
    sizes = F.filter(sizes, lambda x: x["own"].isNotNull())

    def spans(m: Column) -> Column:
        ends = running(F.transform(m["sizes"], lambda x: x["step"]), F.lit(0), lambda a, b: a + b, "int")
        places = F.zip_with(ends, m["sizes"], lambda end, x: F.struct((end - x["own"]).alias("start"), end.alias("end")))
        return F.zip_with(places, m["held"], lambda at, h: F.struct(at["start"].alias("start"), at["end"].alias("end"), h.alias("held")))

    return let(F.struct(sizes.alias("sizes"), held.alias("held")), spans)


def _clear(runs: Column, base: Column) -> Column:
    """Those of ``runs`` that no span of ``base`` touches: both go by place, and the farthest end so far is enough."""
    none = F.lit(None).cast(_SPAN)
    # a run comes at its end, before spans that start there; all spans that come before it and end behind its start touch it
    marks = F.concat(
        F.transform(runs, lambda r: F.struct(r["end"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("reach"), r.alias("run"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("turn"), b["end"].alias("reach"), none.alias("run"))),
    )

    def kept(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: x["reach"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        judged = F.zip_with(m, reach, lambda x, far: F.when(x["run"].isNotNull() & (far <= x["run"]["start"]), x["run"]))
        return F.filter(judged, lambda r: r.isNotNull())

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), let(F.array_sort(marks), kept)).otherwise(runs)


def _spans(text: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    if kind == "assign":
        spans = F.filter(_found(text, ASSIGN, 1), lambda s: F.char_length(s["held"]) >= 6)
        return F.when(text.rlike(ASSIGN), spans).otherwise(none)
    pattern = {"access": ACCESS, "hex": HEX, "random": RUN}[kind]
    return F.when(text.rlike(pattern), _found(text, pattern)).otherwise(none)


def _tagged(spans: Column, kind: str) -> Column:
    """Spans as they are returned: they sort by start, then by the order of kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _kind(c: str) -> str:
    return "capital" if "A" <= c <= "Z" else "small" if "a" <= c <= "z" else "digit" if c.isdigit() else "sign"


def _log_ratio(encoding: str) -> Column:
    """Natural logarithm of how much likelier ``body`` (of length n) is as text in the alphabet than as uniform symbols."""
    alphabet = ALPHABETS[encoding]
    kinds = {kind: [c for c in alphabet if _kind(c) == kind] for kind in sorted(set(map(_kind, alphabet)))}
    weight = lambda c: LETTERS.get(c.lower(), 1)
    chance = {c: weight(c) / sum(map(weight, members)) for members in kinds.values() for c in members}
    symbols = F.create_map(*[x for c, p in chance.items() for x in (F.lit(c), F.lit(math.log(p * len(alphabet))))])
    each = F.transform(_characters("body"), lambda c: F.element_at(symbols, c))
    switches = F.regexp_count("body", F.lit("[A-Z]+|[a-z]+|[0-9]+|[+/]+")) - 1
    text = F.lit(-math.log(len(kinds))) + switches * math.log((1 - STAY) / (len(kinds) - 1)) + (F.col("n") - 1 - switches) * math.log(STAY)
    return F.aggregate(each, text, lambda a, b: a + b)


def _characters(name: str) -> Column:
    return F.filter(F.split(name, ""), lambda c: c != "")


def _tail(z: Column) -> Column:
    """A bound from above of the normal tail at ``z``, which errs on the safe side."""
    return F.when(z > 0, 0.5 * F.exp(-z * z / 2)).otherwise(1.0)


def _turning(turns: Column, n: Column, share: float) -> Column:
    """Chernoff's bound: the chance that of ``n`` places as many turn as do, or as few, where ``share`` of them should."""
    q = turns / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    beyond = q > share if share < 0.5 else q < share
    return F.when(beyond, F.exp(-n * (part(q, share) + part(1 - q, 1 - share)))).otherwise(1.0)


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (column held) with encoding, n, the statistics chi2, turns, serial and log_ratio, and the p-value of each
    test: p_even, p_runs, p_serial and p_text."""
    body = F.translate(F.regexp_replace("held", "=+$", ""), "-_", "+/")
    got = runs.withColumn("body", body).withColumn("n", F.char_length(F.col("body"))).where(F.col("n") >= SHORTEST)
    kind = F.when(F.col("body").rlike("^[0-9a-f]+$"), "hex").when(F.col("body").rlike("^[0-9A-F]+$"), "hex").when(F.col("body").rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    got = got.withColumn("encoding", kind).withColumn("body", F.when((F.col("encoding") == "hex"), F.lower("body")).otherwise(F.col("body")))
    choose = lambda f: F.when(F.col("encoding") == "hex", f("hex")).when(F.col("encoding") == "base32", f("base32")).otherwise(f("base64"))
    got = got.withColumn("log_ratio", choose(_log_ratio))
    got = got.withColumn("alphabet", choose(lambda e: F.lit(ALPHABETS[e]))).withColumn("k", F.char_length(F.col("alphabet")).cast("double"))
    n, k = F.col("n").cast("double"), F.col("k")
    squares = F.aggregate(_characters("alphabet"), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    got = got.withColumn("chi2", k * squares / n - n)
    values = F.transform(_characters("body"), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    got = got.withColumn("values", values).withColumn("mean", F.aggregate("values", F.lit(0.0), lambda a, b: a + b) / n)
    neighbours = lambda f: F.aggregate(F.zip_with(F.slice("values", 1, F.col("n") - 1), F.slice("values", 2, F.col("n") - 1), f), F.lit(0.0), lambda a, b: a + b)
    got = got.withColumn("turns", neighbours(lambda a, b: F.when((a >= k / 2) == (b >= k / 2), 0.0).otherwise(1.0)))
    spread = F.aggregate("values", F.lit(0.0), lambda a, b: a + F.pow(b - F.col("mean"), F.lit(2.0)))
    lagged = neighbours(lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    # the correlation of neighbours is 1 / n too low for symbols in random order
    got = got.withColumn("serial", F.when(spread > 0, lagged / spread + 1 / n).otherwise(1.0))
    even = ((k - 1) + (n - 1) * (UNEVEN - 1) - F.col("chi2")) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * UNEVEN)
    serial = (math.atanh(SERIAL) - F.abs(F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("serial")))))) * F.sqrt(n - 3)
    got = got.withColumn("p_even", _tail(even)).withColumn("p_serial", _tail(serial))
    got = got.withColumn("p_runs", F.greatest(_turning(F.col("turns"), n - 1, TURN), _turning(F.col("turns"), n - 1, 1 - TURN)))
    got = got.withColumn("p_text", F.exp(F.least(F.col("log_ratio"), F.lit(0.0))))
    return got.drop("alphabet", "k", "values", "mean", "body")


def discoveries(tested: DataFrame, rate: float = 0.01) -> DataFrame:
    """The rows of ``battery`` that are keys at false-discovery ``rate``, with p, the largest of their p-values."""
    p = F.greatest("p_even", "p_runs", "p_serial", "p_text")
    bin_ = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS).cast("int"), F.lit(LAST))
    length = F.lit(0)
    for k, least in enumerate(CLASSES):
        length = F.when(F.col("n") >= least, k + 1).otherwise(length)
    scored = tested.withColumn("p", p).withColumn("bin", bin_).withColumn("class", length)
    counts = scored.groupBy("class", "encoding", "bin").agg(F.count(F.lit(1)).alias("here"))  # 18 x 401 rows at most
    better = Window.partitionBy("class", "encoding").orderBy(F.desc("bin"))
    steps = counts.withColumn("upto", F.sum("here").over(better)).withColumn("all", F.sum("here").over(Window.partitionBy("class", "encoding")))
    ceiling = F.pow(F.lit(10.0), -F.col("bin") / BINS)
    passed = steps.where(ceiling * F.col("all") <= rate * F.col("upto")).groupBy("class", "encoding").agg(F.min("bin").alias("cut"))
    return scored.join(F.broadcast(passed), ["class", "encoding"]).where("bin >= cut")  # 18 rows at most


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row for each row of ``df``: doc_id and spans, an array of (start, order, kind, end) sorted by start and kind."""
    text = F.coalesce(col(df, text_col), F.lit(""))
    rows = df.select(col(df, id_col).alias("doc_id"), text.alias("text"))
    base = F.concat(*[_tagged(_spans(F.col("text"), kind), kind) for kind in KINDS[:3]])
    # few documents hold any run: only what was found travels on
    found = rows.select("doc_id", base.alias("base"), _spans(F.col("text"), "random").alias("runs"))
    found = cut(found.select("doc_id", "base", _clear(F.col("runs"), F.col("base")).alias("runs")))
    keys = cut(discoveries(battery(found.select(F.explode("runs").alias("r")).select("r.held").distinct()), rate).select("held"))
    # texts with the same runs at the same places have the same keys there, so a digest of the runs names them
    told = F.transform("runs", lambda r: F.concat_ws(":", r["start"].cast("string"), r["held"]))
    some = found.where(F.size("runs") > 0).withColumn("name", F.sha2(F.array_join(told, ",").cast("binary"), 256))
    each = some.groupBy("name").agg(F.first("runs").alias("runs")).select("name", F.explode("runs").alias("r")).select("name", "r", "r.held")
    # cut, so that AQE can split the joins on a run, or on runs, that many texts share
    each = each.join(keys, "held", "left_semi").groupBy("name").agg(F.collect_list("r").alias("keys"))
    added = cut(each.select("name", _tagged(F.col("keys"), "random").alias("added")))
    plain = found.where(F.size("runs") == 0).select("doc_id", F.array_sort("base").alias("spans"))
    with_keys = some.join(added, "name", "left").select("doc_id", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))
    return plain.unionByName(with_keys)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame, **options: object) -> DataFrame:
    """``scan`` as counts, the digest of the rules' spans and all spans as text."""
    got = scan(df, **options)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["order"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
