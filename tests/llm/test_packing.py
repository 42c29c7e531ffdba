import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_token_counts import TEXTS
from tessella.llm import packing

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ARGS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
ENCODER = packing.ByteEncoder(*ARGS)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_ids_of_every_text_of_a_table():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for text, want in zip(texts, LIB.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want.ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 20)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 20 for b in bins)
    assert len(bins) <= max(1, 11 * -(-sum(sizes) // 20) / 9 + 1)


def check(out, rows, size):
    ids = {}
    for r in rows:
        t = LIB.encode(r[1] or "", add_special_tokens=False).ids + [0]
        ids.setdefault(r[0], []).append(t)
    pieces, bins = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        want = []
        for t in ids[d]:
            for k, (s, n) in enumerate(packing.cut(np.array(t, "<u4").tobytes(), size)):
                want.append((k, s, n, zlib.crc32(np.array(t[s : s + n], "<u4").tobytes())))
            assert len(t) > size or len(packing.cut(np.array(t, "<u4").tobytes(), size)) == 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(want)
    total = sum(len(t) for v in ids.values() for t in v)
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    return len(bins), -(-total // size)


def test_round_trip_and_edges(docs, rows, empty):
    check(packing.pack(docs, *ARGS).collect(), rows, 2048)
    check(packing.pack(docs, *ARGS, size=50).collect(), rows, 50)
    assert packing.pack(empty, *ARGS).count() == 0


def test_few_sequences_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(k, "word " * rng.randrange(1, 400)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    used, least = check(packing.pack(docs, *ARGS, size=512, group_bins=200).collect(), rows, 512)
    assert used <= 1.02 * least + 2
