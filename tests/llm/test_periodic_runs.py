import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import periodic_runs
from tessella.llm.queries import QUERIES, with_planted_runs

SF = "/root/testdata/sf0.01"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(words, least=12):
    """Every stretch that keeps a period, for all periods, less those with a smaller period."""
    n, out = len(words), []
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([known[w] for w in words])
    equal = {q: ids[:-q] == ids[q:] for q in range(1, n // 2 + 1)}
    for q, same in equal.items():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = j - i + q
            if length >= max(least, 2 * q) and not any(equal[d][i : i + length - d].all() for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(rows, least):
    names = {w: k for k, w in enumerate(dict.fromkeys(w for r in rows for w in r))}
    ids = np.array([names[w] for r in rows for w in r], np.int64)
    out = [[] for _ in rows]
    for row, *run in zip(*(x.tolist() for x in periodic_runs.find_runs(ids, np.cumsum([0, *map(len, rows)]), least)), strict=True):
        out[row].append(tuple(run))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("few", [1, 5, 96, 10**9])
def test_runs_against_brute_force(few, monkeypatch):
    """Both ways of refining, and changes between them, over texts of few symbols, planted periods and Fibonacci words."""
    monkeypatch.setattr(periodic_runs, "FEW", few)
    for seed in range(250):
        rng = random.Random(seed)
        rows = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(60), rng.choice([1, 2, 3, 5])
            words = [rng.randrange(k) for _ in range(n)]
            kind = rng.randrange(4)
            if kind == 1 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            rows.append(fibonacci(n) if kind == 2 else words)
        least = rng.choice([2, 12])
        assert found(rows, least) == [brute(r, least) for r in rows]


def test_long_texts_take_little_time():
    n = 300_000
    for words in (np.zeros(n, np.int64), np.arange(n) % (n // 5), np.random.default_rng(1).integers(0, 2, n)):
        began = time.time()
        row, start, length, period = periodic_runs.find_runs(words, np.array([0, n]), 12)
        assert time.time() - began < 20
        assert len(row) < n
        for s, m, q in list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))[:50]:
            assert (words[s : s + m - q] == words[s + q : s + m]).all()
            assert not s or words[s - 1] != words[s - 1 + q]
            assert s + m == n or words[s + m] != words[s + m - q]


def test_edges(spark, docs, rows, empty):
    """Nulls, empties, all kinds of white space, repeated rows, several blocks, clashing names, an empty table."""
    mine = [(100, "a b " * 9, "en"), (101, "\x0bx\x0cx\rx\tx\nx " * 4, "en"), (102, "é ü " * 300 + "end", None), (103, " ".join(["w"] * 400_000), None), (104, "one two one two " * 8, None)]
    more = spark.createDataFrame([(d, t, lang, "s", 0, 1.5, "clash", 9, "k", 8, 7) for d, t, lang in mine], docs.schema)
    clashing = docs.unionByName(more).withColumnRenamed("k", "runs").withColumnRenamed("a", "collapsed")
    out = periodic_runs.annotate(clashing, least=12)
    assert sorted(out.columns) == sorted(clashing.columns)
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"], str(r["text"])) for r in out.collect())
    want = []
    for d, t in [(r[0], r[1]) for r in rows] + [(d, t) for d, t, _ in mine]:
        words = split(t)
        runs = [(0, len(words), 1)] if d == 103 else brute(words)
        want.append((str(d), runs, collapse(words, runs), str(t)))
    assert got == sorted(want)
    assert periodic_runs.annotate(empty).count() == 0


def test_query_on_every_text_of_a_table(spark):
    table = [(r["doc_id"], split(r["text"])) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    planted = {r["doc_id"]: r["text"] for r in with_planted_runs(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(table)
    some = 0
    for d, words in table:
        words, r = plant(d, words), got[d]
        assert split(planted[d]) == words
        runs = brute(words) if len(words) <= 1500 else found([words], 12)[0]
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert some > 30
