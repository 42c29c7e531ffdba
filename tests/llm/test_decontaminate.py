import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tessella.llm import decontaminate


def distance(item, text):
    """Least edits of item to a passage of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_passage_distance(item, text):
    import numpy as np

    edits, start, end = decontaminate.passage_distance(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64))
    assert edits == distance(item, text)
    assert distance(text[start:end], item) <= edits and 0 <= start <= end <= len(text)


def planted(rng, n=60):
    items = [prose(rng, rng.randrange(15, 60), line=1000) for _ in range(20)]
    rows = []
    for d in range(n):
        words = items[d % 20].split()
        for _ in range(d % 3 * len(words) // 10):
            p = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[p] = "zzz"
            else:
                words.insert(p, "yyy")
        around = prose(rng, 200)
        rows.append((d, around[:300] + " " + " ".join(words) + "\n" + around[300:]))
    clean = [(1000 + d, prose(random.Random(d + 500), 300)) for d in range(20)]
    return items, rows, clean


def test_recall_against_brute_force(spark):
    items, rows, clean = planted(random.Random(3))
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs, bench).collect()}
    want = {}
    for d, t in rows + clean:
        for k, item in enumerate(items):
            n = len(item.split())
            e = distance(item.lower().split(), t.lower().split())
            if e <= int(0.2 * n + 1e-9):
                want[d, k] = e
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(got[x]["edits"] == want[x] for x in got)
    text = dict(rows + clean)
    for (d, k), r in got.items():
        if not r["edits"]:
            assert text[d][r["start"] : r["end"]].split() == items[k].split()
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows + clean} - {d for d, _ in got}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench, block_words=100).collect()}
    assert blocks == set(got)


def test_items_without_an_id(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six"), (3, "seven eight nine ten eleven twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, rows[0][1]), (7, rows[1][1]), (None, "none of them holds this item")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()} == {(1, None), (2, 7)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_edges(spark, docs, rows, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, rows[3][1]), (4, rows[3][1]), (None, "x y z")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()} == {(4, 3), (4, 4)}
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1


def test_groups_of_like_lengths():
    """Every row once; none is padded to more than twice its length, or 16 words, and no group is large unless its row is."""
    import numpy as np

    rng = np.random.default_rng(0)
    n = np.concatenate([rng.integers(1, 300, 40_000), [200_000, 150_000, 3_000_000]])
    groups = list(decontaminate.like_lengths(n))
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(n)))
    for g in groups:
        assert n[g].max() < 2 * max(n[g].min(), 8)
        assert len(g) == 1 or len(g) * n[g].max() <= decontaminate.WAVE_WORDS


def test_a_long_item_beside_short_ones():
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(6000))
    texts = [long, *(prose(rng, 20) for _ in range(50))]
    items = decontaminate.prepare(list(range(len(texts))), texts, 0.8, 40, 2)
    words, indptr, _, _ = decontaminate.word_hashes(*_raw("before " + long + " after"))
    assert (0, 0) in decontaminate.search(items, words, indptr, 40, 2)


def _raw(text):
    import numpy as np

    b = text.encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)])


def test_agreement_of_walks():
    """Strings at the similarity agree on the share of coordinates that the number of tables is chosen for, or more."""
    import numpy as np

    rng = np.random.default_rng(4)
    shares = []
    for n in (20, 50, 120):
        for insert in (False, True):
            for _ in range(60):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                b, new = a.tolist(), rng.integers(0, 2**63, n // 5)
                for p, x in zip(sorted(rng.choice(n, n // 5, replace=False).tolist(), reverse=True), new.tolist(), strict=True):
                    b[p : p + (not insert)] = [x]
                pair = np.stack([a, np.array(b[:n], np.uint64)])
                shares.append(float(np.mean([e[0] == e[1] for e in (decontaminate.walk(pair, np.array([n, n]), seed) for seed in range(4))])))
    assert np.quantile(shares, 0.05) >= decontaminate.AGREE
    assert decontaminate.tables_for(decontaminate.RECALL, decontaminate.AGREE, 2) == 40
