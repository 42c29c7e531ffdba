import hashlib
import random
import time

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import byte_bpe
from tessella.llm.queries import QUERIES
from tests.llm.test_token_counts import TEXTS

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODER = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


def ids(encoder, texts):
    flat, offsets = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=3))
def test_ids_equal_the_library(texts):
    assert ids(ENCODER, texts) == [LIB.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinorst", min_size=1, max_size=80))
def test_unbroken_words(word):
    assert ids(ENCODER, [word]) == [LIB.encode_ordinary(word)]


def test_every_code_point_splits_alike():
    for low in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}b {chr(c) * 2} 1{chr(c)}  " for c in range(low, low + 512) if not 0xD800 <= c < 0xE000)
        assert ids(ENCODER, [text]) == [LIB.encode_ordinary(text)]


def test_small_memos_change_nothing():
    small = byte_bpe.Encoder(ENCODER.ranks, public_tokenizers.PATTERN, most_pairs=5, most_ids=20)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 14))) for _ in range(12)) for _ in range(40)]
    for t in texts:
        assert ids(small, [t]) == [LIB.encode_ordinary(t)]


def random_ranks(rng, letters, merges):
    """Ranks by byte, then merges of tokens at random; at times a token that no merges make."""
    ranks = {bytes([b]): b for b in range(256)}
    pool = [c.encode() for c in letters]
    for _ in range(merges):
        t = rng.choice(pool) + rng.choice(pool) if rng.random() < 0.9 else bytes(rng.choice(letters.encode()) for _ in range(5))
        if t not in ranks:
            ranks[t] = len(ranks)
            pool.append(t)
    return ranks


def test_other_vocabularies():
    for seed in range(25):
        rng = random.Random(seed)
        ranks = random_ranks(rng, "abc", 60)
        own = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
        lib = tiktoken.Encoding("random", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(80):
            t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
            assert ids(own, [t]) == [lib.encode_ordinary(t)], (seed, t)


def test_long_words_take_linear_time():
    rng = random.Random(3)
    for make in (lambda n: "x" * n, lambda n: "ab" * (n // 2), lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n)), lambda n: " " * n):
        small, large = make(3000), make(300_000)
        assert ids(ENCODER, [small]) == [LIB.encode_ordinary(small)]
        began = time.time()
        flat, offsets = ENCODER.encode([large])
        assert time.time() - began < 8
        assert ENCODER.decode(flat.astype("int64"), offsets) == [large.encode()]


def test_query_on_every_text_of_a_table(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(table)
    for row in table:
        text = row["text"] or ""
        want = LIB.encode_ordinary(text)
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_edges(spark, docs, rows, empty):
    """Nulls, empties, a long text, repeated rows, other columns (one named like the new one), an empty table."""
    clashing = docs.withColumnRenamed("k", "ids").withColumnRenamed("hi", "decoded")
    coded = byte_bpe.encode(clashing, PATH, public_tokenizers.PATTERN)
    out = byte_bpe.decode(coded, PATH)
    assert sorted(out.columns) == sorted(clashing.columns)
    got = sorted((str(r["doc_id"]), str(r["text"]), str(r["ids"]), str(bytes(r["decoded"])), r["lang_pred"]) for r in out.collect())
    want = sorted((str(r[0]), str(r[1]), str(LIB.encode_ordinary(r[1] or "")), str((r[1] or "").encode()), r[6]) for r in rows)
    assert got == want
    assert byte_bpe.decode(byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    odd = spark.createDataFrame([(1, [64, 50_000_000]), (2, [-1]), (3, [64, None]), (4, None), (5, []), (6, [64])], "k long, ids array<int>")
    assert {r["k"]: None if r["decoded"] is None else bytes(r["decoded"]) for r in byte_bpe.decode(odd, PATH).collect()} == {1: None, 2: None, 3: None, 4: None, 5: b"", 6: ENCODER.token[64]}


def test_other_tokenizer_files():
    own = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    text = "The quick brown fox's naïve façade, 12345 <|endoftext|>  日本\n"
    lib = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert ids(own, [text]) == [lib.encode_ordinary(text)]
