import math
import random

import duckdb
import numpy as np
import pytest

from tessella.llm import hard_negatives
from tessella.llm.queries import ORACLES, QUERIES

SCHEMA = "id long, label int, vec array<long>, anchor boolean"


def brute(rows, positives=5, negatives=5, percent=(80, 100)):
    rows = {(i, x, tuple(v), a) for i, x, v, a in rows if None not in (i, x, v) and None not in v}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, x, v, chosen in rows:
        if not chosen:
            continue
        scored = sorted((-dot(v, w), j, y) for j, y, w, _ in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == x][:positives]:
            fit = [r for r in scored if r[2] != x and percent[0] * -s <= 100 * -r[0] <= percent[1] * -s][:negatives]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), hard_negatives.F.col("anchor"), **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, d, spread, labels):
    centre = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(labels)]
    return [(k, (x := rng.randrange(labels)), [round(c + rng.gauss(0, spread)) for c in centre[x if rng.random() < 0.8 else 0]], rng.random() < 0.1) for k in range(n)]


@pytest.mark.parametrize(("d", "spread", "tile", "sparse"), [(16, 30, 64, 1 / 32), (16, 3, 50, 1.0), (4, 1, 2048, 0.0), (40, 900, 100, 1 / 32)])
def test_against_brute_force(spark, monkeypatch, d, spread, tile, sparse):
    """Many tiles, many ties, planes as products only and pair by pair only."""
    rng = random.Random(d * tile)
    rows = vectors(rng, 300, d, spread, 4)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "SPARSE", sparse)
    monkeypatch.setattr(hard_negatives, "ROWS", 70)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=7, percent=(-50, 95)) == brute(rows, 2, 7, (-50, 95))


def test_intervals_lose_nothing():
    rng = np.random.default_rng(5)
    for spread in (1, 20, 5000):
        a, c = (rng.normal(0, spread, (n, 24)).round().astype(np.int64) for n in (30, 500))
        score = a @ c.T
        low, high = np.quantile(score, 0.97, axis=1).astype(np.int64), np.quantile(score, 0.995, axis=1).astype(np.int64)
        allowed = rng.random(score.shape) < 0.7
        p, q, s = hard_negatives.living_pairs(a, c, low, high, allowed)
        want = set(zip(*np.nonzero(allowed & (score >= low[:, None]) & (score <= high[:, None])), strict=True))
        assert want <= set(zip(p, q, strict=True)) and (score[p, q] == s).all() and allowed[p, q].all()
        assert len(p) < 0.2 * score.size


def test_edges(spark):
    """Nulls, repeated rows and ids, ties, vectors of several lengths, no vector at all, great numbers, other label types."""
    rows = vectors(random.Random(9), 60, 5, 6, 2) + [(None, 1, [1] * 5, True), (500, None, [1] * 5, True), (501, 1, None, True), (502, 1, [1, None, 2, 3, 4], True)]
    rows += [(510, 1, [9, 9], True), (511, 1, [], True), (512, 0, [5] * 9, False), (512, 1, [5] * 9, True), (512, 1, [4] * 9, True)] + [(520 + k, k % 2, [3, 3, 3, 3, 3], k == 0) for k in range(20)]
    rows += rows[:7]
    want = brute(rows)
    assert mined(spark, rows) == want and any(r[0] == 510 for r in want)
    assert mined(spark, [*rows, (600, 1, [1 << 40, 0], True)]) == want
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1], True)]) == []
    assert mined(spark, [(1, 1, [1, 2], False), (2, 2, [3, 4], False)]) == []
    assert mined(spark, [(1, 1, [1, 2], True), (2, 2, [3, 4], False)]) == []
    texts = spark.createDataFrame([(i, None if x is None else f"label {x}", v, a) for i, x, v, a in rows], SCHEMA.replace("label int", "label string"))
    assert sorted(tuple(r) for r in hard_negatives.mine(texts, hard_negatives.F.col("anchor")).collect()) == want


def test_quantized(spark):
    rows = [(1, [0.5, -0.001, 1.0]), (2, [math.nan, 1.0]), (3, [math.inf]), (4, [-math.inf, 0.0]), (5, None), (6, [None, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = dict(df.select("k", hard_negatives.quantized(hard_negatives.F.col("v"), 256)).collect())
    assert got == {1: [128, -1, 256], 2: None, 3: None, 4: None, 5: None, 6: None, 7: []}


def test_query_with_odd_rows(spark, tmp_path):
    """The SQL is the brute force: nulls, non-finite components and a hot vector beside the given rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = [(9000 + 100 * k, v, x) for k, (v, x) in enumerate([([math.nan] * 64, 1), ([None] * 64, 1), (None, 1), ([math.inf] + [0.1] * 63, 2), ([0.1] * 64, None)])]
    hot = [(20000 + k, [0.125] * 64, k % 3) for k in range(700)]
    table.unionByName(spark.createDataFrame(odd + hot, table.schema)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_hard_negatives"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES["op12_hard_negatives"]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want) > 300
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
