"""Parsed Python files, and graphs that follow edits against graphs built anew."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import concepts, incremental
from tessella.operators.enrich import Offline
from tessella.sources.code import parse, python_entities
from tessella.sources.snapshots import Conflict, SnapshotStore
from tessella.streaming import sync as streamed

SOURCE = '''@mark(0)
class Shelf(Base, lib.Store[int], metaclass=meta.Kind):
    @cached(1)
    def put(self,
            item=make()):
        # stays in the header
        def check(x): return self.rules.ok(x)
        return check(item).done()(2)

async def main(
    one,
    two,
    three,
): await Shelf().put(one)
'''


def test_entities_of_a_file():
    got = {e["node_id"]: e for e in python_entities("p.py", SOURCE)}
    assert [(e["node_id"], e["kind"], e["span_start"], e["span_end"]) for e in got.values()] == [("p.py::Shelf", "class", 2, 8), ("p.py::Shelf.put", "method", 4, 8), ("p.py::Shelf.check", "method", 7, 7), ("p.py::main", "function", 10, 14)]
    assert got["p.py::Shelf"]["signature"] == "class Shelf(Base, lib.Store[int], metaclass=meta.Kind):"
    assert got["p.py::Shelf.put"]["signature"] == "def put(self,\n            item=make()):\n        # stays in the header"
    assert got["p.py::Shelf.check"]["signature"] == "def check(x):"
    assert got["p.py::main"]["signature"] == "async def main(\n    one,\n    two,"
    assert got["p.py::Shelf"]["bases"] == ["Base", "Store[int]", "Kind"]
    assert sorted(got["p.py::Shelf"]["calls"]) == ["cached", "check", "done", "done", "make", "ok"]
    assert sorted(got["p.py::main"]["calls"]) == ["Shelf", "put"]


@pytest.mark.parametrize("content", ["", "def (:\n", "x = 1\n", "\x00", "(" * 5000 + ")" * 5000])
def test_files_without_entities(content):
    assert python_entities("p.py", content) == []


def test_line_ends_and_other_letters():
    for end in ("\n", "\r\n", "\r"):
        got = python_entities("p.py", end.join(["# é ü\x0c", "class Ä:", "    def ö(self): return 'ß'.strip()"]))
        assert [(e["node_id"], e["span_start"], e["signature"], e["calls"]) for e in got] == [("p.py::Ä", 2, "class Ä:", ["strip"]), ("p.py::Ä.ö", 3, "def ö(self):", ["strip"])]


def file_of(rng, k):
    names = [f"n{rng.randrange(12)}" for _ in range(4)]
    calls = "".join(f"        {n}()\n" for n in names[1:])
    return f"class {names[0]}(n{rng.randrange(12)}):\n    def run{k % 3}(self):\n{calls}\ndef n{rng.randrange(12)}(): pass\n"


def frame(spark, files):
    rows = spark.createDataFrame([(f, c) for f, c in files.items()], "file string, content string")
    return rows.withColumn("hash", F.sha1("content"))


def content(graph):
    plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return {t: plain(df) for t, df in graph.tables().items()}


def test_syncs_equal_rebuilds(spark):
    """Files that come, change and go, names that move between files, four syncs on top of each other."""
    rng = random.Random(1)
    files = {f"f{k}.py": file_of(rng, k) for k in range(8)}
    graph = incremental.build(frame(spark, files))
    for step in range(4):
        before = set(files)
        for f in rng.sample(sorted(files), 2):
            del files[f]
        for f in rng.sample(sorted(files), 2):
            files[f] = file_of(rng, step)
        files |= {f"g{step}{k}.py": file_of(rng, k) for k in range(2)} | {f"broken{step}.py": "def (:", f"page{step}.ts": "class X {}"}
        now = frame(spark, files)
        synced = incremental.sync(graph, now)
        graph = synced.graph
        assert content(graph) == content(incremental.build(now)), step
        assert {r["file"] for r in synced.changes.where("status = 'removed'").collect()} == before - set(files)
    assert incremental.sync(graph, now).changes.isEmpty()
    assert incremental.sync(graph, now).touched.isEmpty()


def test_only_fresh_code_is_digested(spark):
    """Entities of unchanged files aren't digested again, nor is unchanged code of a changed file."""
    files = {"a.py": "def one(): pass\n\ndef two(): pass\n", "b.py": "def three(): one()\n"}

    def digest(entities, known):
        rows = incremental.without_summaries(entities, known)
        return rows.withColumn("summary", F.when(F.col("summary") == "", F.lit(digest.round)).otherwise(F.col("summary")))

    digest.round = "first"
    graph = incremental.build(frame(spark, files), digest=digest)
    digest.round = "second"
    files["a.py"] = "def one(): pass\n\ndef two(): return 2\n"
    synced = incremental.sync(graph, frame(spark, files), digest=digest)
    assert {r["node_id"]: r["summary"] for r in synced.graph.entities.collect()} == {"a.py::one": "first", "a.py::two": "second", "b.py::three": "first"}
    assert {r["node_id"] for r in synced.touched.collect()} == {"a.py::one", "a.py::two", "b.py::three"}


def test_scope_and_empty_graphs(spark):
    files = {"a.py": "def one(): pass\n", "b.py": "def two(): one()\n"}
    graph = incremental.build(frame(spark, files))
    edited = {"a.py": "def one(): return 1\n", "c.py": "def three(): two()\n"}
    scope = spark.createDataFrame([("a.py",)], "file string")
    synced = incremental.sync(graph, frame(spark, edited), scope=scope)
    assert [tuple(r) for r in synced.changes.collect()] == [("a.py", "changed")]
    assert content(synced.graph) == content(incremental.build(frame(spark, {"a.py": edited["a.py"], "b.py": files["b.py"]})))
    none = frame(spark, {"x.py": ""}).limit(0)
    assert content(incremental.sync(graph, none).graph) == content(incremental.build(none)) == {t: [] for t in graph.TABLES}
    assert content(incremental.sync(incremental.build(none), frame(spark, files)).graph) == content(graph)


def test_repeated_names_keep_the_last(spark):
    rows = parse(frame(spark, {"a.py": "def f(): one()\ndef f(): two()\n"})).collect()
    assert [(r["node_id"], r["calls"]) for r in rows] == [("a.py::f", ["two"])]


def test_store_shows_whole_versions_only(spark, tmp_path):
    """Tables that are carried over, readers of old versions, writers that fail or come second, cut pointers, clearing up."""
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    read = lambda table, v=None: sorted(r["x"] for r in store.read(table, v).collect())
    assert not store.exists() and store.latest() is None and store.tables() == {} and store.versions() == []
    first = store.commit({"manifest": rows(1), "edges": rows(1, 2), "none": rows()}, note={"batch": 7})
    second = store.commit({"manifest": rows(2)}, base=first)
    assert (read("manifest"), read("edges"), read("manifest", first), read("none")) == ([2], [1, 2], [1], [])
    assert store.note(first) == {"batch": 7} and store.versions() == [first, second]

    def bad(x):
        raise ValueError("a task fails")

    failing = rows(5).select(F.udf(bad, "long")("x").alias("x"))
    with pytest.raises(Exception, match="a task fails"):
        store.commit({"edges": rows(9), "manifest": failing}, base=second)
    assert store.latest() == second and read("edges") == [1, 2]
    with pytest.raises(Conflict):
        store.commit({"manifest": rows(3)}, base=first)
    with pytest.raises(Conflict):
        store.commit({"manifest": rows(3)})
    (tmp_path / "store/commits/000000000003.json").write_text('{"tables": {"mani')
    assert store.latest() == second and read("manifest") == [2]
    with pytest.raises(KeyError):
        store.read("manifest", 3)
    third = store.commit({"edges": rows(4)}, base=second)
    assert third == 4 and (read("manifest"), read("edges"), read("edges", second)) == ([2], [4], [1, 2])
    store.vacuum(keep=1)
    assert store.versions() == [third] and (read("manifest"), read("edges"), read("none")) == ([2], [4], [])
    assert len(list((tmp_path / "store/data").iterdir())) == 3


class Counting(Offline):
    """Writes a line for each call."""

    log = ""

    def complete(self, system, prompt):
        with open(self.log, "a") as f:
            f.write("call\n")
        return super().complete(system, prompt)


def test_only_changed_concepts_are_called(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        own = Counting()
        own.log = log
        return own

    nodes = [f"n{k:02d}" for k in range(30)]
    entities = spark.createDataFrame([(v, "t", "s" + v) for v in nodes], "node_id string, tag string, summary string")
    groups = lambda rows: spark.createDataFrame(rows, "community int, node_id string")
    none = spark.createDataFrame([], "concept_id string, tag string, summary string")
    first = concepts.recluster(groups([(k // 6, v) for k, v in enumerate(nodes)]), entities, none, none.select("concept_id", F.lit("").alias("node_id")), None, make=make)
    was = {r["concept_id"]: r["summary"] for r in first.concepts.collect()}
    assert sorted(was) == [f"concept-{k:04d}" for k in range(5)] and len(open(log).readlines()) == 5
    moved = groups([(9 - k // 6 if k != 29 else 8, v) for k, v in enumerate(nodes)])
    touched = spark.createDataFrame([("n01",)], "node_id string")
    then = concepts.recluster(moved, entities, first.concepts, first.members, touched, make=make)
    rows = {r["concept_id"]: r for r in then.concepts.collect()}
    assert sorted(rows) == sorted(was) and {c for c, r in rows.items() if r["called"]} == {"concept-0000", "concept-0001", "concept-0004"}
    assert all(rows[c]["summary"] == was[c] for c in ("concept-0002", "concept-0003"))
    assert len(open(log).readlines()) == 8


def test_a_stream_keeps_a_stored_graph(spark, tmp_path):
    """Batches with repeated rows and removals, a batch that fails, a batch that comes again, a second stream."""
    schema = "file string, content string, at long"
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    batches = [
        [("a.py", "def one(): pass\n", 1), ("b.py", "def two(): one()\n", 1), ("b.py", "def old(): pass\n", 0)],
        [("bad.py", "def bad(): pass\n", 2)],
        [("a.py", None, 3), ("c.py", "def one(): two()\n", 3), ("never.py", None, 3)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))

    def digest(entities, known):
        if entities.where("file = 'bad.py'").count():
            raise RuntimeError("no digest for this")
        return incremental.without_summaries(entities, known)

    for k in range(3):  # one stream over a folder that grows
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streamed.start_graph(stream, store, checkpoint=str(tmp_path / "c"), every=None, digest=digest).awaitTermination()
    want = incremental.build(frame(spark, {"b.py": "def two(): one()\n", "c.py": "def one(): two()\n"}))
    held = store.tables()
    assert content(incremental.CodeGraph(**{t: held[t] for t in want.TABLES})) == content(want)
    assert [(r["batch"], r["error"]) for r in held["errors"].collect()] == [(1, "RuntimeError: no digest for this")]
    assert len(store.versions()) == 3
    again = spark.createDataFrame([("x.py", "def x(): pass\n", 9)], schema)
    assert streamed.sync_store(store, again, stream=str(tmp_path / "c"), number=2) == store.latest() and len(store.versions()) == 3
    streamed.sync_store(store, again, stream="other", number=0)
    assert {r["file"] for r in store.read("manifest").collect()} == {"b.py", "c.py", "x.py"} and store.read("errors").count() == 1
