"""Jobs of calls that go on where they were stopped; tags of many queries against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import enrich, retrieval, similarity
from tests.test_incremental import Counting


class Falling(Counting):
    """Ends its task at one prompt; the others are answered first."""

    def complete(self, system, prompt):
        if prompt == "prompt 13":
            import time

            time.sleep(6)
            raise SystemExit("the worker is gone")
        return super().complete(system, prompt)


class Moody(Counting):
    def complete(self, system, prompt):
        if prompt.endswith("7"):
            raise TimeoutError("too slow")
        return super().complete(system, prompt)


def maker(kind, log):
    def make():
        own = kind()
        own.log = log
        return own

    return make


def lines(log):
    with open(log) as f:
        return len(f.readlines())


def test_a_stopped_job_repeats_no_finished_call(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), enrich.ResultLog(spark, f"file://{tmp_path}/log")
    rows = spark.range(40).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("h").alias("code_hash"), F.concat(F.lit("prompt "), "id").alias("prompt"))
    with pytest.raises(Exception, match="worker|exit|died|aborted"):
        log.fill(rows, F.col("prompt"), maker(Falling, calls), chunk=3)
    done = {r["node_id"] for r in log.answers().collect()}
    assert 0 < len(done) < 40 and "n13" not in done
    before = lines(calls)
    log.fill(rows, F.col("prompt"), maker(Counting, calls), chunk=3)
    assert lines(calls) - before == 40 - len(done)
    assert log.answers().count() == log.rows().count() == 40
    log.fill(rows, F.col("prompt"), maker(Counting, calls))
    assert lines(calls) - before == 40 - len(done)
    changed = rows.limit(2).withColumn("code_hash", F.lit("other"))
    log.fill(changed.unionAll(changed), F.col("prompt"), maker(Counting, calls))
    assert log.answers().count() == 42 and lines(calls) - before == 42 - len(done)


def test_failed_calls_are_kept_apart_and_repeated(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), enrich.ResultLog(spark, f"file://{tmp_path}/log")
    rows = spark.range(20).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("h").alias("code_hash"), F.concat(F.lit("prompt "), "id").alias("prompt"))
    log.fill(rows, F.col("prompt"), maker(Moody, calls))
    assert {(r["node_id"], r["error"]) for r in log.rows().where("error IS NOT NULL").collect()} == {("n7", "TimeoutError: too slow"), ("n17", "TimeoutError: too slow")}
    assert log.answers().count() == 18 == lines(calls)
    log.fill(rows, F.col("prompt"), maker(Counting, calls))
    assert log.answers().count() == 20 == lines(calls)


def test_tags_of_many_queries(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aAbcé ") for _ in range(rng.randrange(n)))
    tags = [(k, word(9)) for k in range(60)] + [(100, None), (101, ""), (102, "a"), (103, "A")]
    queries = [(k % 25, word(12)) for k in range(50)] + [(30, None), (31, " "), (32, "É"), (32, "zz")]
    got = retrieval.match_query_tags(spark.createDataFrame(tags, "concept_id long, tag string"), spark.createDataFrame(queries, "query_id long, tag string"))
    want = {(q, c) for q, w in queries for c, t in tags if w and t and w.strip(" ") and (w.strip(" ").lower() in t.lower() or t.lower() in w.strip(" ").lower())}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50


def test_recall_by_tags_text(spark):
    concepts = spark.createDataFrame([("c1", "Boats", "what floats"), ("c2", "", "no tag"), ("c3", "sails", None)], "concept_id string, tag string, summary string")
    neighbours = spark.createDataFrame([("c1", "c2"), ("c2", "c1"), ("c1", "gone")], "concept string, neighbour string")
    members = spark.createDataFrame([("c1", "n2"), ("c1", "n1"), ("c3", "lost")], "concept_id string, node_id string")
    entities = spark.createDataFrame([("n1", "hull", "a hull", "a.py", 1, 2, "h = 1"), ("n2", None, None, "b.txt", 3, 3, None)], "node_id string, tag string, summary string, file string, span_start int, span_end int, code string")
    queries = spark.createDataFrame([(1, "boat"), (2, "trains"), (3, "the sails of boats")], "query_id int, tag string")
    got = {r["query_id"]: r["text"] for r in retrieval.recall_by_tags(queries, concepts, neighbours, members, entities).collect()}
    boats = "## Boats\nwhat floats\n\n### hull (a.py:1-2)\na hull\n```python\nh = 1\n```\n\n### n2 (b.txt:3-3)\n\n```\n\n```\n\n## c2\nno tag"
    assert got[1] == boats and got[2] == retrieval.NO_HIT
    assert got[3] == boats + "\n\n## sails"


def vectors(spark, rows, key):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} long, vec array<float>")


def brute_nearest(queries, rows, k):
    unit = lambda v: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) + 1e-12)
    out = set()
    for q, v in queries:
        best = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in rows)[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(best)}
    return out


def test_nearest_of_many_queries(spark):
    """Blocks of both sides, ties, nulls, no rows; through the index with every list looked into the result is the exact one."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6)) for k in range(150)] + [(200 + k, [1, 0, 0, 0, 0, 0]) for k in range(40)]
    queries = [(k, rng.normal(size=6)) for k in range(20)] + [(50, [2, 0, 0, 0, 0, 0])]
    want = brute_nearest(queries, rows, 4)
    given, asked = vectors(spark, [*rows, (300, None), (None, [1] * 6)], "id"), vectors(spark, [*queries, (90, None)], "query_id")
    got = lambda df: {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}
    assert got(similarity.nearest(asked, given, 4, block_rows=16)) == want
    index = similarity.InvertedLists.fit(given, recall=1.1)
    assert index.probes == len(index.centres) > 1
    assert got(index.search(asked, given, 4, block_rows=10)) == want  # the repeated vector's list is cut into blocks
    none = given.limit(0)
    assert got(similarity.nearest(asked, none, 4)) == got(similarity.InvertedLists.fit(none).search(asked, none, 4)) == set()
    assert got(similarity.nearest(asked.limit(0), given, 4)) == set()


def test_index_reaches_its_recall(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16)) * 2
    rows = [(k, centre[k % 30] + rng.normal(size=16)) for k in range(1500)]
    queries = [(k, centre[k % 30] + rng.normal(size=16)) for k in range(0, 60)]
    given = vectors(spark, rows, "id")
    index = similarity.InvertedLists.fit(given, sample=600)
    assert index.probes < len(index.centres) and index.recall >= 0.95
    found = {(r["query_id"], r["id"]) for r in index.search(vectors(spark, queries, "query_id"), given, 8).collect()}
    want = {(q, i) for q, i, _ in brute_nearest(queries, rows, 8)}
    assert len(found & want) >= 0.9 * len(want)


def test_recall_without_vectors(spark):
    concepts = spark.createDataFrame([(1, "t", "s", None)], "concept_id long, tag string, summary string, vec array<float>")
    none = lambda schema: spark.createDataFrame([], schema)
    got = retrieval.recall_by_vectors(vectors(spark, [(5, [1.0])], "query_id"), concepts, none("concept long, neighbour long"), none("concept_id long, node_id long"), none("node_id long, tag string, summary string, file string, span_start int, span_end int, code string"))
    assert [tuple(r) for r in got.collect()] == [(5, retrieval.EMPTY)]


def test_matches_are_made_once_and_not_sorted_out_after(spark, monkeypatch):
    """Several tags of a concept or a query, null ids, and keys cut small: each pair once, by a plan whose result no aggregate passes."""
    monkeypatch.setattr(retrieval, "_CONCEPTS", 2)
    monkeypatch.setattr(retrieval, "_QUERIES", 2)
    tags = ["red ring", "ring", "blue rod", "", None, "Rod", "old widget"]
    concepts = [(c, tags[c % 7]) for c in range(30)] + [(c, tags[(c + 3) % 7]) for c in range(0, 30, 4)] + [(None, "ring")]
    asked = [(q, t) for q, t in enumerate([" RING", "rod", "a red ring more", " ", None, "zz", "e"])] + [(0, "red"), (9, "ring"), (10, "ring"), (11, "Ring "), (None, "rod")]
    got = retrieval.match_query_tags(spark.createDataFrame(concepts, "concept_id long, tag string"), spark.createDataFrame(asked, "query_id long, tag string"))
    low = [(q, t.strip(" ").lower()) for q, t in asked if t]
    want = {(q, c) for q, t in low for c, own in concepts if t and own and (t in own.lower() or own.lower() in t)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    top = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in top.split("Join")[0]


def test_a_list_of_concepts_is_put_together_once(spark):
    """Queries with the same concepts in the same order share one text; another order is another text."""
    orders = {q: [1, 2] if q % 3 else [2, 1] for q in range(30)}
    placed = spark.createDataFrame([(q, c, k) for q, own in orders.items() for k, c in enumerate(own, 1)], "query_id long, concept_id int, place int")
    assert retrieval._entries(retrieval._lists(placed)).count() == 4
    concepts = spark.createDataFrame([(1, "a", ""), (2, "b", "")], "concept_id int, tag string, summary string")
    members = spark.createDataFrame([], "concept_id int, node_id long")
    entities = spark.createDataFrame([], "node_id long, tag string, summary string, file string, span_start int, span_end int, code string")
    queries = spark.createDataFrame([(q,) for q in range(31)], "query_id long")
    got = dict(retrieval._assembled(queries, placed, concepts, members, entities).collect())
    heads = {1: "## a\n\n", 2: "## b\n\n"}
    assert got == {q: "\n".join(heads[c] for c in own).strip("\n ") for q, own in orders.items()} | {30: retrieval.NO_HIT}
