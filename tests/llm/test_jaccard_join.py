import random
import re

import numpy as np

from tests.llm.conftest import prose
from tessella.llm import jaccard_join as jj

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """(doc_id, n, component_id) of every row; classes are of equal or linked sets."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(str((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def found(docs, **kw):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jj.join(docs, **kw).collect())


def test_edges(docs, rows, empty):
    assert found(docs) == brute(rows)
    assert found(empty) == []
    kept = jj.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({int(x.split(",")[0][1:]) for x in brute(rows) if x.split(",")[0][1:] == x.split(",")[2].strip(" )") and x[1:5] != "None"})


def families(seed, n=40):
    """Copies edited more and more, so that similarities lie on both sides of the threshold, and chains of links."""
    rng = random.Random(seed)
    rows, d = [], 0
    for f in range(4):
        base = prose(rng, 90).split()
        chain = list(base)
        for k in range(n):
            words = list(base if f % 2 else chain)
            for _ in range(k % 6):
                words[rng.randrange(len(words))] = rng.choice(["zzz", "yyy", "xxx"]) + str(rng.randrange(3))
            if not f % 2:
                chain = words
            rows.append((d, " ".join(words)))
            d += 1
    rng.shuffle(rows)
    return rows


def test_families_on_both_sides_of_the_threshold(spark):
    rows = families(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)
    assert found(docs, block_grams=300) == brute(rows)  # tiny blocks


def test_hot_columns(spark, monkeypatch):
    """Every column is hot and cut into parts of one or three rows."""
    rows = families(6, 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = jj._block_products
    for most in (1, 3):
        monkeypatch.setattr(jj, "_block_products", lambda *a, most=most: own(*a, most_rows=most))
        assert found(docs) == brute(rows)


def test_one_representative_of_each_class(spark):
    """Whatever ids are missing or repeated: rows without an id, near copies without any, one id with several texts."""
    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 90, 200) for _ in range(5))
    near = lambda t: t + " zzz"
    rows = [(1, a), (None, a), (None, near(a)), (None, b), (None, near(b)), (None, b), (2, c), (2, d), (1, d), (3, e), (3, near(e)), (3, e.upper()), (4, ""), (None, " "), (None, None), (None, None)]
    assert jj.reaches(len(shingles(a) & shingles(near(a))), len(shingles(a)), len(shingles(near(a))), 85)
    kept = [(r["doc_id"], r["text"]) for r in jj.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = [{(1, a)}, {(None, b), (None, near(b))}, {(2, c)}, {(1, d)}, {(3, e), (3, near(e)), (3, e.upper())}, {(4, "")}, {(None, " ")}, {(None, None)}]
    assert [sum(k in g for k in kept) for g in groups] == [1] * len(groups)
    assert len(kept) == len(groups)


def block(sets, roots=None):
    return jj.Block(np.arange(len(sets)), np.array(roots if roots is not None else range(len(sets))), np.array([len(x) for x in sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets))


def test_product():
    """Overlaps of all pairs of different classes whose sizes reach the similarity, whatever the slab."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(40)]
    one, two = sets[:15], sets[15:]
    roots = rng.integers(0, 6, 40)
    reach = lambda a, b: 100 * min(len(a), len(b)) >= 60 * max(len(a), len(b))
    want = {(i, j): len(np.intersect1d(a, b)) for i, a in enumerate(one) for j, b in enumerate(two) if roots[i] != roots[15 + j] and reach(a, b) and len(np.intersect1d(a, b))}
    for slab in (1, 50, 1 << 20):
        got = {}
        for i, j, k in jj.product(block(one, roots[:15]), block(two, roots[15:]), 60, slab):
            for key in zip(i.tolist(), j.tolist(), k.tolist()):
                assert key[:2] not in got
                got[key[:2]] = key[2]
        assert got == want


def test_forest():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (60, 40), (60, 400)):
        a, b = rng.integers(0, n, m) * 10, rng.integers(0, n, m) * 10
        x, y = jj.forest(a, b)

        def classes(a, b):
            own = {v: {v} for v in {*a.tolist(), *b.tolist()}}
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                both = own[p] | own[q]
                for v in both:
                    own[v] = both
            return {frozenset(c) for c in own.values() if len(c) > 1}

        assert classes(x, y) == classes(a, b)
        assert len(x) == sum(len(c) - 1 for c in classes(a, b))


def test_prefix_overlap_is_a_bound():
    """Rows that reach the similarity share at least that many prefix n-grams, in any fixed order."""
    rng = np.random.default_rng(2)
    for _ in range(4000):
        a = rng.choice(60, rng.integers(1, 50), replace=False)
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - rng.integers(0, 4))], rng.choice(60, rng.integers(0, 4))]))
        for percent in (80, 85):
            if jj.reaches(len(np.intersect1d(a, b)), len(a), len(b), percent):
                cut = lambda x: np.sort(x)[: jj.prefix_length(len(x), percent)]
                assert len(np.intersect1d(cut(a), cut(b))) >= jj.prefix_overlap(len(a), len(b), percent)


def test_both_products_run(spark, monkeypatch):
    """A row that is a near copy of neither the pivot nor its copies, and two that are near copies of each other only."""
    seen = []
    own = jj._block_products
    monkeypatch.setattr(jj, "_block_products", lambda *a: seen.append(a[0].count()) or own(*a))
    rows = families(8)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert seen and seen[0] > 2
