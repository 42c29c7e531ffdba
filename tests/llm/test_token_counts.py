import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
COUNTER = token_counts.PrefixCounter(PATH)
PIECES = st.sampled_from(list("abcXYZ éÉßΣσς'sStT1٣½²ⅧǺÅ  \n\t\x1c\x1f\x85中文字!?.,<|>😀İ") + ["<|endoftext|>", "'re", "'ll", "<|startoftext|>", "don't"])
TEXTS = st.lists(PIECES, max_size=25).map("".join)


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == lib(text)
    r = next(COUNTER.running_all([text]))
    assert (int(r[-1]) if len(r) else 0) == lib(text)


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(0, 20))
def test_every_prefix_and_budget(text, budget):
    table = COUNTER.table(text)
    counts = [lib(text[:i]) for i in range(len(text) + 1)]
    assert [table.at(i) for i in range(len(text) + 1)] == counts
    assert table.fit(budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_bounded_caches_change_nothing():
    small = token_counts.PrefixCounter(PATH, cached_chunks=5, cached_words=4, cached_pairs=3)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(20)) for _ in range(20)]
    assert [int(r[-1]) for r in small.running_all(texts)] == [lib(t) for t in texts]


def test_edges(docs, rows, empty):
    out = token_counts.count_tokens(docs.select("doc_id", "text", "n", "score"), PATH, limit=50).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == sorted((str(r[0]), len((r[1] or "").encode()), lib(r[1] or ""), lib(r[1] or "") > 50) for r in rows)
    assert token_counts.count_tokens(empty, PATH).count() == 0
    cut = token_counts.truncate(docs.select("doc_id", "text"), PATH, 20).collect()
    assert all(r["text"] is None or lib(r["text"]) <= 20 for r in cut)
