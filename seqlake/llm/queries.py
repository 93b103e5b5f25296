"""The registered queries of the training-data operators, and the SQL that some of them equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import ann, byte_bpe, chat, exact_dedup, lang_id, mixing, secret_scan, simhash, token_count, url_filter
from seqlake.llm.common import table
from seqlake.llm.pretokens import UNIT_PATTERN

#: A folder of vocabulary files; without it, they are where ``public_tokenizers`` says.
TOKENIZERS = os.environ.get("SEQLAKE_TOKENIZERS")
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
#: Weights of the mixture; nodes that are not named have weight 1.
WEIGHTS = {("web",): 3, ("books",): 2, ("web", "en"): 3, ("web", "de"): 2, ("books", "en"): 2}


def vocabulary(name: str) -> bytes:
    """A vocabulary file of the public tokenizers, read on the driver."""
    if TOKENIZERS:
        path = os.path.join(TOKENIZERS, name)
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        return file.read()


def domain() -> F.Column:
    """src0 to src9 are the web, src10 to src14 books, all others code."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,6})$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number < 15, "books").otherwise("code")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain(), epochs=2, seed=42, weights=WEIGHTS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "component_size")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), UNIT_PATTERN, ids=False, digests=True)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode(), UNIT_PATTERN, limit=512)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_exact_dedup, op3_simhash, op4_byte_bpe, op5_token_count, op6_chat, op7_secrets, op8_ann, op9_url_filter, op10_lang_id)
    return {f.__name__: f for f in named}


_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

_OP6 = r"""
WITH r AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS loose, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), t AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, loose) AS n_turns
  FROM r WINDOW w AS (PARTITION BY conv_id, loose ORDER BY turn NULLS FIRST, role, sha256(text))
), p AS (
  SELECT conv_id, loose, i, n_turns,
         string_agg(strlen(role) || ':' || role || ':' || strlen(text) || ':' || text, ',') OVER (PARTITION BY conv_id, loose ORDER BY i) AS prefix
  FROM t
), e AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, min(loose) AS loose, count(*) AS n_equal FROM p WHERE i = n_turns GROUP BY prefix, n_turns
), m AS (
  SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n_turns)
)
SELECT m.conv_id, m.n_turns, m.n_equal,
       string_agg('<|turn|>' || replace(role, '<|', '<\|') || chr(10) || replace(text, '<|', '<\|') || '<|end|>' || chr(10), '' ORDER BY i) AS rendered
FROM m JOIN t ON t.conv_id = m.conv_id OR m.conv_id IS NULL AND t.loose = m.loose GROUP BY m.conv_id, m.loose, m.n_turns, m.n_equal
"""


def _deal(source: str, parent: str, budget: str, capacity: str, weight: str, out: str) -> str:
    """SQL that deals ``budget`` to the rows of ``source`` by weight (all above 0), never over capacity."""
    order = f"PARTITION BY {parent} ORDER BY {capacity}::DOUBLE / {weight}, {capacity}, lang, source"
    return f"""SELECT * EXCLUDE (lft, rest, filled, spare, open), CASE WHEN filled THEN {capacity} ELSE least(spare * {weight} // open, {capacity}) END AS {out} FROM (
  SELECT *, {budget} - sum(CASE WHEN filled THEN {capacity} ELSE 0 END) OVER (PARTITION BY {parent}) AS spare, sum(CASE WHEN filled THEN 0 ELSE {weight} END) OVER (PARTITION BY {parent}) AS open FROM (
    SELECT *, min(CASE WHEN {capacity} * rest <= lft * {weight} THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS filled FROM (
      SELECT *, {budget} - coalesce(sum({capacity}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source})))"""


_OP1 = rf"""
WITH docs AS (
  SELECT doc_id, CASE WHEN num < 10 THEN 'web' WHEN num < 15 THEN 'books' ELSE 'code' END AS domain, lang, source, n_tokens FROM (
    SELECT doc_id, try_cast(regexp_extract(coalesce(source, ''), '^src(\d{{1,6}})$', 1) AS INT) AS num, coalesce(lang, 'unknown') AS lang,
           coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)
), t3 AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS c3, 1::HUGEINT AS w3 FROM docs GROUP BY ALL),
t2 AS (SELECT domain, lang, '' AS source, sum(tokens) AS tokens, sum(c3) AS c2,
         CASE domain || '/' || lang WHEN 'web/en' THEN 3 WHEN 'web/de' THEN 2 WHEN 'books/en' THEN 2 ELSE 1 END::HUGEINT AS w2 FROM t3 GROUP BY domain, lang),
t1 AS (SELECT 0 AS root, domain, '' AS lang, '' AS source, sum(c2) AS c1, CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END::HUGEINT AS w1,
         sum(sum(tokens)) OVER () AS b0 FROM t2 GROUP BY domain),
d1 AS ({_deal('t1', 'root', 'b0', 'c1', 'w1', 'b1')}),
d2 AS ({_deal('(SELECT t2.*, b1 FROM t2 JOIN d1 USING (domain))', 'domain', 'b1', 'c2', 'w2', 'b2')}),
d3 AS ({_deal('(SELECT t3.*, b2 FROM t3 JOIN d2 USING (domain, lang))', 'domain, lang', 'b2', 'c3', 'w3', 'b3')}),
plan AS (SELECT domain, lang, source, b3::BIGINT AS budget, coalesce(b3 // nullif(tokens, 0), 0)::BIGINT AS whole, coalesce(b3 % nullif(tokens, 0), 0)::BIGINT AS part FROM d3),
placed AS (SELECT docs.*, budget, whole, part, md5('42:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget,
       whole + CASE WHEN part > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) <= part THEN 1 ELSE 0 END AS copies
FROM placed
"""

_URL_CHANCE = """(CASE WHEN in3 > 0 THEN (n3 + d3 * p2) / (in3 + d3) ELSE p2 END)"""

_OP9 = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), r AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
), l AS (
  SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled, substr(md5(url), 1, 1) < '4' AS apart,
         list_transform(string_split(regexp_replace(lower(url), '[^a-z0-9./\-_:?=&%#~*]', '*', 'g'), ''), lambda ch: strpos('{url_filter.ALPHABET}', ch) - 1) AS codes FROM r
), parts AS (SELECT count(DISTINCT (ruled, apart)) = 4 AS two FROM l WHERE ruled IS NOT NULL),
g AS (
  SELECT page_id, CASE WHEN NOT (two AND apart) THEN ruled END AS ruled, CASE WHEN i > 2 THEN codes[i - 2] ELSE 47 END AS a, CASE WHEN i > 1 THEN codes[i - 1] ELSE 47 END AS b, codes[i] AS c
  FROM (SELECT page_id, ruled, apart, CASE WHEN url = '' THEN [] ELSE codes END AS codes, unnest(CASE WHEN url = '' THEN [] ELSE range(1, len(codes) + 1) END) AS i FROM l), parts
), v AS (SELECT unnest(['allow', 'block']) AS v),
k3 AS (SELECT ruled AS v, a, b, c, count(*) AS n FROM g WHERE ruled IS NOT NULL GROUP BY ALL),
k2 AS (SELECT v, b, c, sum(n) AS n FROM k3 GROUP BY ALL), k1 AS (SELECT v, c, sum(n) AS n FROM k3 GROUP BY ALL),
x3 AS (SELECT v, a, b, sum(n) AS n, count(*) AS d FROM k3 GROUP BY ALL), x2 AS (SELECT v, b, sum(n) AS n, count(*) AS d FROM k2 GROUP BY ALL),
x1 AS (SELECT v, sum(n) AS n, count(*) AS d FROM k1 GROUP BY ALL),
q AS (
  SELECT v.v, s.a, s.b, s.c, coalesce(k3.n, 0)::DOUBLE AS n3, coalesce(x3.n, 0)::DOUBLE AS in3, coalesce(x3.d, 0)::DOUBLE AS d3,
         coalesce(k2.n, 0)::DOUBLE AS n2, coalesce(x2.n, 0)::DOUBLE AS in2, coalesce(x2.d, 0)::DOUBLE AS d2,
         (coalesce(k1.n, 0) + x1.d / 48.0::DOUBLE) / (x1.n + x1.d)::DOUBLE AS p1
  FROM (SELECT DISTINCT a, b, c FROM g) s CROSS JOIN v JOIN x1 USING (v)
  LEFT JOIN k3 ON (k3.v, k3.a, k3.b, k3.c) = (v.v, s.a, s.b, s.c) LEFT JOIN x3 ON (x3.v, x3.a, x3.b) = (v.v, s.a, s.b)
  LEFT JOIN k2 ON (k2.v, k2.b, k2.c) = (v.v, s.b, s.c) LEFT JOIN x2 ON (x2.v, x2.b) = (v.v, s.b) LEFT JOIN k1 ON (k1.v, k1.c) = (v.v, s.c)
), m AS (
  SELECT a, b, c, round((sum(CASE v WHEN 'allow' THEN ln({_URL_CHANCE}) ELSE -ln({_URL_CHANCE}) END)) * 1e6)::BIGINT AS micro
  FROM (SELECT *, CASE WHEN in2 > 0 THEN (n2 + d2 * p1) / (in2 + d2) ELSE p1 END AS p2 FROM q) GROUP BY a, b, c
), s AS (
  SELECT l.page_id, host, path, rule, ruled, apart, coalesce(micro, 0)::BIGINT AS micro
  FROM l LEFT JOIN (SELECT page_id, floor(sum(micro)::DOUBLE / count(*)) AS micro FROM g JOIN m USING (a, b, c) GROUP BY page_id) t USING (page_id)
), c AS (
  SELECT ruled, sum(micro)::DOUBLE / count(*) AS mean, sqrt(greatest(sum(micro::HUGEINT * micro)::DOUBLE / count(*) - (sum(micro)::DOUBLE / count(*)) ** 2, 1.0)) AS sd
  FROM s, parts WHERE ruled IS NOT NULL AND (apart OR NOT two) GROUP BY ruled
), t AS (
  SELECT round((x.mean * y.sd + y.mean * x.sd) / (x.sd + y.sd)) AS threshold FROM c x, c y WHERE x.ruled = 'allow' AND y.ruled = 'block'
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN micro >= threshold THEN 'allow' ELSE 'block' END) AS verdict, micro / 1e6 AS score FROM s, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op2_exact_dedup": _OP2, "op6_chat": _OP6, "op9_url_filter": _OP9}
