import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from([*"@@..--++ 112340()ab%_", "4111 1111-1111 1111", "+1 (017) 555-7713", "1.2.3.4", "x@y.z"]), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000) == []
    assert len(pii.base_spans("1.1.1.1." * 20_000)) == 20_000
    for text in ("a" * 300_000 + "@", "@" + "a" * 300_000, "a@" * 100_000, "a (at) " * 50_000, "1 " * 200_000 + "x", "1" * 300_000 + "x", "(1" * 100_000, "x" * 300_000 + " at) (at) y"):
        pii.field(text)


def trained():
    fields = [pii.field(t) for k in range(60) for t in (f"call +1 (01{k % 10}) 555-77{k:02d} or again +1 (01{k % 10}) 555-77{k:02d} please", f"mail joe{k}@x{k}.example.com and joe{k}@x{k}.example.com", "number 123456789 alone", "card 4111 1111 1111 1111, card 4111111111111111")]
    return pii.fit_weights(fields)


def test_links_carry_labels():
    w = trained()
    text = "write to joe.x@mail7.example.com or joe.x (at) mail7.example.com"
    base, every = pii.spans(text, w)
    assert [text[a:b] for a, b, _ in base] == ["joe.x@mail7.example.com"]
    assert [text[a:b] for a, b, _ in every] == ["joe.x@mail7.example.com", "joe.x (at) mail7.example.com"]
    assert pii.redact(text, every) == "write to [email] or [email]"
    far = "dial +1 (017) 555-7713 " + "word " * 2000 + "then 1 (017) 555-7713"
    assert [k for *_, k in pii.spans(far, w)[1]] == [3, 3]
    assert pii.spans("nothing here 12345", w) == ([], [])


def test_broken_mentions_are_found_and_strange_ones_left(spark):
    """On documents that the fit has not seen: mentions in another form, decoys of the same form, and plain documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    w = pii.fit(docs.where("doc_id % 2 = 0"))
    assert 0.5 <= w.sure <= 1
    rng = random.Random(1)
    found = named = added = n = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        base, every = pii.spans(r["text"], w)
        assert set(base) <= set(every)
        added += len(every) - len(base)
        if base:
            a, b, kind = base[0]
            mention = pii.broken(r["text"][a:b], kind, rng.randrange(4))
            decoy = pii.strange(mention, rng.randrange(10**9))
            head = r["text"] + "\nseen again: "
            text = f"{head}{mention} and also {decoy} here"
            own = pii.spans(text, w)[1]
            at = len(head) + len(mention) + 10
            found += any(x < len(head) + len(mention) and y > len(head) and k == kind for x, y, k in own)
            named += any(x < at + len(decoy) and y > at for x, y, _ in set(own) - set(pii.base_spans(text)))
            n += 1
    assert n > 150 and found >= 0.95 * n and named <= 0.02 * n and added == 0


def test_message_passing_equals_enumeration_on_a_tree():
    f = pii.field("x@y.zz 1234567 then 12345678")
    f.links = f.links[f.links[:, 2] == 0]
    rng = np.random.default_rng(0)
    w = pii.Weights(rng.normal(size=(pii.SHAPES, 5)), rng.normal(size=(3, 5, 5)))
    n = len(f.base)
    p = np.zeros((n, 5))
    for code in range(5**n):
        y = [code // 5**i % 5 for i in range(n)]
        s = sum((f.shape[i] @ w.shape)[y[i]] for i in range(n)) + sum(w.pair[t][y[a], y[b]] for a, b, t in f.links)
        for i in range(n):
            p[i, y[i]] += np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(pii.marginals(f, w, np.full(n, -1), rounds=200), p, atol=1e-3)


def test_evidence_goes_through_long_chains():
    """One base span and many loose mentions of its digits after it: the label reaches the last one."""
    for n in (60, 1500):
        shape = np.zeros((n + 1, pii.SHAPES))
        links = np.array([(k, k + 1, kind) for k in range(n) for kind in (0, 1)], np.int64)
        f = pii.Field([(k, k) for k in range(n + 1)], np.array([0] + [-1] * n), shape, links)
        pair = np.zeros((3, 5, 5))
        pair[1] = 6 * np.eye(5)
        observed = np.where(f.base >= 0, f.base + 1, -1)
        p = pii.marginals(f, pii.Weights(np.zeros((pii.SHAPES, 5)), pair), observed)
        # the exact marginals of a chain: powers of its transition matrix
        t = np.exp(pair[1]) / np.exp(pair[1]).sum(axis=1, keepdims=True)
        want = np.stack([np.linalg.matrix_power(t, k)[1] for k in range(n + 1)])
        assert np.allclose(p, want, atol=1e-2)


def test_edges(docs, rows, empty):
    out = pii.find(docs, pii.fit(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    assert pii.find(empty, pii.fit(empty)).count() == 0
