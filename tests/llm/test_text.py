"""Exact dedup, SimHash, BPE, token counts: against brute force and the libraries."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import byte_bpe, exact_dedup, simhash, token_count
from seqlake.llm.components import connected_components
from seqlake.llm.pretokens import UNIT_PATTERN
from seqlake.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n\n", "  a", "a  ", "\na\n\n", "a \n b", "a\n b", "\t\tb c　　d\xa0 e", "x  \x1c\x1d  y \x1f z", "'s 're 'LL don't it's",
    "<|endoftext|>hi<|endoftext|><|endoftext|> x", "\U0001f600 日本語テキスト " * 40, "՘₏ x ౜1೜ \U00011de0", "a" * 5000, "ab" * 3000, "\r\n" * 30 + "end", "12345 6789abc_-+=",
]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in zip(ids, texts)], DOCS)


def random_text(rng, n):
    return "".join(chr(rng.choice([rng.randrange(0x20, 0xD7FF), rng.randrange(0xE000, 0x1FFFF), rng.randrange(0x20, 0x7F), 0x20])) for _ in range(n))


# exact dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_is_brute_force(spark, bits):
    rng = random.Random(bits)
    words = ["alpha", "beta.", "gamma,", "été", "x"]
    texts = [rng.choice([" ", "\n", "\t \n"]).join(rng.choices(words, k=rng.choice([1, 2, 3, 200]))) for _ in range(60)]
    texts += [t.replace(" ", "\n ") for t in texts[:20]] + ODD + ["one two"] * 50 + ["z" * 20000, "z" * 20000 + "y"]
    got = {r["doc_id"]: r for r in exact_dedup.decide(frame(spark, texts), least=16, most=64, id_bits=bits).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(texts)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_chunks_are_whole_and_local(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(3000))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"), 64, 512)).first()[0]
    a, b = cut(text), cut(text[:5000] + "INSERTED " + text[5000:])
    assert "".join(a) == text and max(map(len, a)) <= 520
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_exact_dedup_edges(spark):
    assert exact_dedup.decide(frame(spark, [])).count() == 0
    assert exact_dedup.dedup(frame(spark, [])).count() == 0
    repeated = frame(spark, ["a  b", "a b", "a b", "c", None, "c"], [5, 3, 3, None, None, 9])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["repeats"]) for r in exact_dedup.decide(repeated).collect()), key=str)
    assert got == sorted([(5, 3, 3, False, 1), (3, 3, 3, True, 2), (3, 3, 3, True, 2), (None, 9, 2, False, 1), (9, 9, 2, True, 1), (None, None, 1, True, 1)], key=str)
    clashing = repeated.withColumn("norm", F.lit(1)).withColumn("recipe", F.lit(2)).withColumn("__sha", F.lit(3)).withColumn("__keep_id", F.lit(4)).withColumn("a.b", F.lit(5))
    kept = exact_dedup.dedup(clashing)
    assert kept.columns == clashing.columns
    assert sorted(((r["doc_id"], norm(r["text"])) for r in kept.collect()), key=str) == sorted([(3, "a b"), (9, "c"), (None, "")], key=str)


# SimHash


def naive_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_are_naive_ones(spark):
    rng = random.Random(9)
    texts = ODD + ["ÉA B C", " ".join(rng.choices(["Uno", "dos", "TRES", "Été"], k=1000)), random_text(rng, 4000)] + [" ".join(rng.choices("abcdef", k=k)) for k in (1, 2, 3, 4, 254, 257, 258, 600)]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(frame(spark, texts)).collect()}
    assert all(got[i] & (2**64 - 1) == naive_fingerprint(t) for i, t in enumerate(texts))


def brute_components(fps):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(find(f), i)
    return {i: least[find(f)] for i, f in enumerate(fps)}


@pytest.mark.parametrize("bucket", [128, 3])
def test_links_are_all_found(spark, bucket):
    rng = random.Random(bucket)
    fps = [0, 1, 2**64 - 1, 2**63] + [rng.getrandbits(64) for _ in range(40)]
    for center in fps[4:9]:  # balls whose members lie 1 to 6 bits from a center, in either half or both
        for _ in range(60):
            flipped = center
            for b in rng.sample(rng.choice([range(32), range(32, 64), range(64)]), rng.randrange(1, 7)):
                flipped ^= 1 << b
            fps.append(flipped)
    fps += rng.choices(fps, k=60)
    docs = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r for r in simhash.cluster_fingerprints(docs, bucket=bucket).collect()}
    want = brute_components(fps)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(int(got[i]["fingerprint"], 16) == f and len(got[i]["fingerprint"]) == 16 for i, f in enumerate(fps))


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(17)
    edges = [(0, k) for k in range(1, 3000)] + [(k, 10**6) for k in range(5000, 7000)]  # hubs, the smallest and the largest of their class
    edges += [(k, k + 1) for k in range(10_000, 10_150)] + [(20_000, 20_000), (7, 7), (3, 0), (0, 3)]
    edges += [(rng.randrange(30_000, 30_400), rng.randrange(30_000, 30_400)) for _ in range(300)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in edges if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(spark):
    assert simhash.cluster(frame(spark, [])).count() == 0
    texts = ["", None, " ", "the same text here", "The  same\ntext here", "another one with words"]
    got = {r["doc_id"]: (r["component_id"], r["component_size"]) for r in simhash.cluster(frame(spark, texts)).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 2), 4: (3, 2), 5: (5, 1)}
    source = frame(spark, texts + texts[3:4], [4, None, 2, 7, 7, 1, 7]).withColumn("fp", F.lit(1)).withColumn("__keep_id", F.lit(1))
    kept = simhash.near_dedup(source)
    assert kept.columns == source.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7]
    alone = simhash.near_dedup(frame(spark, ["x y z w", "x y z w"], [None, None]))
    assert alone.count() == 1


def test_near_dedup_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    one, two, three, four = ("alpha beta gamma delta epsilon", "one quite unlike text about ships", "a third that speaks of mountain goats", "the last has nothing in common either")
    rows = [(None, one), (None, two), (None, three), (None, one.upper()), (7, one), (7, two), (7, three), (7, three), (3, three), (9, four), (9, four), (9, two)]
    kept = simhash.near_dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(7, one), (7, two), (3, three), (9, four)])
    alone = simhash.near_dedup(frame(spark, [one, two, three, four, one.upper(), None, ""], [None] * 7))
    assert sorted((r["text"] or "").lower() for r in alone.collect()) == sorted(["", one, two, three, four])
    # a repeated id whose other row goes, as a smaller id has its text
    shared = simhash.near_dedup(frame(spark, [one, one, two], [1, 2, 2]))
    assert sorted((r["doc_id"], r["text"]) for r in shared.collect()) == [(1, one), (2, two)]


# BPE


@pytest.fixture(scope="module")
def hard_texts():
    rng = random.Random(4)
    return ODD + [random_text(rng, 20000), "".join(rng.choices("abcdefghij", k=20000)), " ".join("".join(rng.choices("aeioust", k=5)) for _ in range(3000))]


def test_bpe_is_the_library(spark, hard_texts):
    import tiktoken

    content = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    library = tiktoken.Encoding("own", pat_str=UNIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode(frame(spark, hard_texts), content, UNIT_PATTERN, digests=True, decoded=True).collect()}
    for i, t in enumerate(hard_texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode(frame(spark, []), content, UNIT_PATTERN).count() == 0


def test_other_patterns_and_a_small_memory(monkeypatch, hard_texts):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    for pattern in (UNIT_PATTERN, r"\p{L}+|[^\p{L}]"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = byte_bpe.ByteBPE(ranks, pattern)
        for t in hard_texts:
            assert own.encode(t or "") == library.encode_ordinary(t or "")


def test_counts_are_the_library(spark, hard_texts):
    from tokenizers import Tokenizer

    content = vocabulary("byte_bpe_50k.json").decode()
    library = Tokenizer.from_str(content)
    got = {r["doc_id"]: r for r in token_count.count_tokens(frame(spark, hard_texts), content, UNIT_PATTERN).collect()}
    for i, t in enumerate(hard_texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512), i
    assert token_count.count_tokens(frame(spark, []), content, UNIT_PATTERN).count() == 0


def test_long_pretokens_are_merged_whole():
    from tokenizers import Tokenizer

    content = vocabulary("byte_bpe_50k.json").decode()
    library, own = Tokenizer.from_str(content), token_count.RankMerger(content, UNIT_PATTERN)
    rng = random.Random(8)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    texts = [letters, "a" * 200_001, "ab" * 70_000, "the" * 50_000 + " " + letters[:1000], "\u00e9\u65e5" * 5000, "x" * 129 + " " + "x" * 128, "".join(rng.choices("ab", k=5000)), "=" * 3000 + " " * 3000]
    assert own.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    # both ways give the same whatever the length
    parts = ["".join(rng.choices("aeiourstn", k=rng.randrange(1, 300))).encode() for _ in range(300)]
    lengths = np.array(list(map(len, parts)))
    assert own._queue(parts, lengths).tolist() == own._step(parts, lengths).tolist() == own.merge(parts).tolist()
