from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import suffix_dedup as sd


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(values):
    t = np.array(values, dtype=np.uint8)
    assert sd.suffix_array(t, 100).tolist() == sorted(range(len(t)), key=lambda i: t.tobytes()[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=24, max_size=150))
def test_anchors_own_every_start_once(values):
    t = np.array(values, dtype=np.uint8)
    _, _, s0, s1 = sd.anchors(t, 24, 8)
    owned = [j for a, b in zip(s0, s1, strict=True) for j in range(a, b + 1)]
    assert owned == list(range(len(t) - 23))


def brute(rows, size):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[j : j + size] for _, t in texts for j in range(len(t) - size + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - size + 1):
            if count[t[j : j + size]] > 1:
                gone[j : j + size] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append((str(d), len(t), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def found(docs, **kw):
    return sorted((str(r["doc_id"]), r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in sd.remove_repeats(docs, **kw).collect())


def test_brute_force(docs, rows, empty):
    assert found(docs) == brute(rows, 400)
    assert found(docs, size=100, gram=32, chunk=2000) == brute(rows, 100)
    assert found(empty) == []


def test_anchors_with_many_contexts(docs, rows):
    assert found(docs, size=100, gram=32, most_contexts=1) == brute(rows, 100)
