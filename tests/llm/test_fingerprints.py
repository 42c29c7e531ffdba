import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import fingerprints as fp


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_window_minima(values, w):
    v = np.array([x << 24 for x in values], dtype=np.uint64)
    w1 = min(w, len(values))
    want = sorted({max(range(s, s + w1), key=lambda q: (-values[q], q)) for s in range(len(values) - w1 + 1)})
    assert fp.window_minima(v, w).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("abc", min_size=21, max_size=40), st.text("bc", max_size=60))
def test_shared_runs_share_a_hash(left, run, right):
    a, b = (fp.winnow(t, 6, 16) for t in (left + run, run + right))
    assert set(a[0].tolist()) & set(b[0].tolist())
    # and their positions locate the run: a kept hash stands at the same place of it in both
    assert {(h, p - len(left)) for h, p in zip(*map(np.ndarray.tolist, a), strict=True)} & {(h, p) for h, p in zip(*map(np.ndarray.tolist, b), strict=True) if p + 6 <= len(run)}


def test_compare_with_next(docs, rows, empty):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        own, other, follow = (fp.winnow(x) for x in (t, new, nxt))
        (print1, at1), (print2, at2) = fp.digest(*own), fp.digest(*other)
        want.append((str(d), len(t), hashlib.sha256(new.encode()).hexdigest(), print1, print2, fp.likeness(own[0], other[0]), fp.likeness(own[0], follow[0]), at1, at2))
    for ranges in (None, 1, 30):
        got = fp.compare_with_next(docs, ranges=ranges).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert fp.compare_with_next(empty).count() == 0
    assert fp.compare_with_next(docs.where("doc_id = 4")).collect()[0]["near_next"] == 1.0


def test_digest():
    h, at = fp.winnow("the same words and the same words and the same words again", 6, 16)
    digits, places = fp.digest(h, at)
    assert len(digits) == 10 * len(places) == 10 * len(set(h.tolist()))
    for i, p in enumerate(places):
        own = int(digits[10 * i : 10 * i + 10], 16) << 24
        assert p == max(q for x, q in zip(h.tolist(), at.tolist(), strict=True) if x == own)


def test_positions(docs, rows):
    out = fp.fingerprint(docs.select("doc_id", "text", "k")).collect()
    assert len(out) == len(rows) and all(len(r["hashes"]) == len(r["positions"]) for r in out)
