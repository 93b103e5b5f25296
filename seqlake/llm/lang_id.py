"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed character n-grams is fitted, by least
squares, to tell the languages whose bit is 1 from the others. A text gets the language whose codeword loses least, each
bit's hinge loss weighted by how well its classifier did on its training rows; the lead over the second best codeword is
the confidence, and a small lead flags the text as ambiguous. Up to 7 languages have the exhaustive code, more have
columns drawn from a seed.

The classifiers are fitted on a bounded sample: ``per_lang`` texts of each language (those whose hashed id comes first),
MOST_ROWS in all, of the ``max_langs`` languages with the most labelled rows; where there are more languages, the others
(by name where they tie) are not learned and no text is predicted to be in them. Features of these rows are computed on
the executors, at most BUCKETS counts each; the driver sees nothing else of the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0, not ambiguous; with no labelled row every
text is ``und``; a single learned language gets every text with a letter, with score 1; whole texts count, however
long; rows may repeat, and a repeated row is learned from once; an empty table gives an empty result; only the id, text
and (for training rows) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import col

#: Hashed n-gram counts of a text; each order has its own seed.
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Training rows of all languages together; with many languages each gets fewer.
MOST_ROWS = 3072
#: Rows of a batch that a stage hands on together, and rows whose features are held at a time.
PART, BLOCK = 256, 32
UNKNOWN = "und"
#: Loss of the nearest codeword above which no learned language is near (at 1 no classifier says anything), and the
#: letters that a text must have for that: fewer are no evidence.
FAR, EVIDENCE = 0.85, 20
#: Lead from which a prediction overrules the language that a row names.
SURE = 0.25
_LETTER = regex.compile(r"\p{L}").search
_LETTERS = regex.compile(r"\p{L}+").findall


def features(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts of the whole text, scaled to length one; BUCKETS values."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(points), 1 << 18):  # n-grams that start here; the slice reaches over its end
        part = points[at : at + (1 << 18) + ORDERS[-1] - 1]
        for order in ORDERS:
            n = min(1 << 18, len(part) - order + 1)
            if n <= 0:
                continue
            code = np.full(n, order, np.uint32)
            for k in range(order):
                code *= np.uint32(0x9E3779B1)
                code ^= part[k : k + n]
            code *= np.uint32(0x85EBCA77)
            counts += np.bincount(code >> np.uint32(19), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / (np.linalg.norm(counts) or 1.0)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1, all different; no column is constant, none is another's complement if k <= 7."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:  # every way to set the other rows while the first is +1
        masks = np.arange(2 ** (k - 1) - 1)
        rest = (masks[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack((np.ones(len(masks)), rest * 2.0 - 1))
    rng = np.random.default_rng(seed)
    width = 10 * int(np.ceil(np.log2(k)))
    while True:
        code = rng.choice((-1.0, 1.0), (k, width))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(axis=0)) < k).all():
            return code


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # of each bit; they add up to one
    ambiguous: float  # leads below this are flagged

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each row of features, its lead over the second (0 to 1), and its loss (0 to 2)."""
        bits = np.clip(rows @ self.weights, -1, 1)
        # hinge loss of each codeword
        loss = (np.maximum(0, 1 - bits[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        if len(self.langs) == 1:
            return np.zeros(len(rows), int), np.ones(len(rows)), loss[:, 0]
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)
        return best, np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1] + two[:, 0], 1e-12), 0, 1), two[:, 0]


def held_out(id_column: Column) -> Column:
    """Documents that training leaves out: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, max_langs: int = 256, ridge: float = 0.3, ambiguous: float = 0.02) -> Model | None:
    """A model from the labelled rows of ``df`` that ``held_out`` does not name; None if there are none."""
    rows = df.select(col(df, id_col).alias("id"), col(df, text_col).alias("text"), col(df, lang_col).cast("string").alias("lang")).where("lang is not null and id is not null").where(~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    sizes = {r["lang"]: r["n"] for r in counts}
    if not sizes:
        return None
    per_lang = min(per_lang, max(1, MOST_ROWS // len(sizes)))
    # hashes below twice the share that is wanted, so that a handful of rows is ranked however many there are
    rows = rows.withColumn("place", F.xxhash64(F.col("id").cast("string")))
    bound = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(2**63 - 1, int(2**64 * 2 * per_lang / n) - 2**63)))])
    near = rows.where(F.col("place") <= F.try_element_at(bound, F.col("lang"))).withColumn("sum", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("place", "id", "sum")
    names = near.select("lang", "place", "id", "sum").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).drop("n", "place")
    sampled = near.join(F.broadcast(names), ["lang", "id", "sum"]).groupBy("lang", "id", "sum").agg(F.min("text").alias("text"))  # MOST_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = features(text.as_py() or "")
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<u2").tobytes()]), pa.array([counts[at].astype("<f4").tobytes()])], names=["lang", "places", "values"])

    got = sampled.select("lang", "text").mapInArrow(run, "lang string, places binary, values binary").collect()
    got = sorted((r for r in got if r["places"]), key=lambda r: (r["lang"], bytes(r["places"]), bytes(r["values"])))
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["values"], "<f4")
    code = codewords(len(langs))
    y = code[[langs.index(r["lang"]) for r in got]]
    gram = (x @ x.T).astype(np.float64)
    dual = np.linalg.solve(gram + ridge * np.eye(len(got)), y)
    fitted = np.clip(gram @ dual, -1, 1)
    trust = np.maximum(1e-3, 1 - np.maximum(0, 1 - fitted * y).mean(axis=0))
    return Model(langs, code, (x.T @ dual.astype(np.float32)).astype(np.float64), trust / trust.sum(), ambiguous)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of ``df``."""
    source = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    # BUCKETS x bits numbers, bounded by max_langs
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            langs, scores, flags = [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = [t.as_py() for t in batch.column(1).slice(at, 256)]
                known = [k for k, t in enumerate(texts) if fitted and t and _LETTER(t)]
                lang, score, flag = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if known:
                    best, lead, _ = fitted.decode(np.stack([features(texts[k]) for k in known]))
                    for k, b, s in zip(known, best.tolist(), lead.tolist()):
                        lang[k], score[k], flag[k] = fitted.langs[b], s, s < fitted.ambiguous
                langs += lang
                scores += score
                flags += flag
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    out = source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is in a learned language, all columns, with that language in ``lang_col`` (a string).

    A row goes if its text has no letter, if its language is predicted to be ``und``, or if it has EVIDENCE letters and
    the nearest codeword is FAR: then it is in no learned language. A prediction takes the place of a null language, and of another
    one if its lead is SURE. Without a labelled row to learn from, no language can be told: only rows without a letter
    go, and languages stay. The prediction travels with the row, so nothing is shuffled and repeated or null ids do no
    harm. Rows are handed on PART at a time: beside the batch that it got, a worker holds no more than these.
    """
    model = fit(df, id_col, text_col, lang_col)
    at_text, at_lang = df.columns.index(text_col), df.columns.index(lang_col)
    source = df.select(*[col(df, c).cast("string").alias(c) if c == lang_col else col(df, c) for c in df.columns])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        rows = np.empty((BLOCK, BUCKETS))
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            texts = [t.as_py() for t in batch.column(at_text)]
            langs = batch.column(at_lang).to_pylist()
            stay = [bool(t and _LETTER(t)) for t in texts]
            known = [k for k, x in enumerate(stay) if x and fitted]
            for block in (known[at : at + BLOCK] for at in range(0, len(known), BLOCK)):
                for n, k in enumerate(block):
                    rows[n] = features(texts[k])
                for k, b, lead, loss in zip(block, *map(np.ndarray.tolist, fitted.decode(rows[: len(block)]))):
                    foreign = loss > FAR and sum(map(len, _LETTERS(texts[k]))) >= EVIDENCE
                    stay[k] = fitted.langs[b] != UNKNOWN and not foreign
                    if langs[k] is None or lead >= SURE:
                        langs[k] = fitted.langs[b]
            columns = batch.columns
            columns[at_lang] = pa.array(langs, batch.column(at_lang).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stay, pa.bool_()))
        batch = columns = None
        pa.default_memory_pool().release_unused()  # else the worker keeps what the batch took while it waits for tasks

    return source.mapInArrow(run, source.schema)
