"""Behaviour of single operators on small inline tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.reasoning import normal_level, request_params
from tessella.model import CompactionConfig
from tessella.operators import archive, enrich, graph, requests, retrieval, similarity, snapshots, touches, turns
from tessella.sources import code, providers
from tessella.sources.store import SessionStore


def calls(spark, *rows):
    return spark.createDataFrame([(1, t, k, n, json.dumps(i)) for k, (t, n, i) in enumerate(rows)], "session long, turn long, seq long, name string, input string")


def test_every_tool_and_path_key(spark):
    """Each tool of the tables, in upper case, with each path key; and each read-only command in each shell."""
    direct = [(k, tool.upper(), {key: f"d{k}/in"}) for k, (tool, key) in enumerate((t, p) for t in (*touches.WRITE_TOOLS, *touches.READ_TOOLS) for p in tx.PATH_KEYS)]
    got = {(r["turn"], r["path"], r["kind"]) for r in touches.detect(calls(spark, *direct)).collect()}
    assert got == {(k, f"d{k}/in", "write" if tool.lower() in touches.WRITE_TOOLS else "read") for k, tool, _ in direct}
    lines = [(k, tool, {"command": f"{command} -q d{k}/in plain"}) for k, (tool, command) in enumerate((t, c) for t in touches.SHELL_TOOLS for c in tx.READ_ONLY)]
    got = {(r["turn"], r["path"], r["kind"], r["evidence"]) for r in touches.detect(calls(spark, *lines)).collect()}
    assert got == {(k, f"d{k}/in", "read", f"{body['command']}") for k, _, body in lines}


def test_own_tools_and_unusable_inputs(spark):
    own = {"write": ("Stamp",), "read": ("peek_at",), "shell": ("console",), "path_keys": ("whereabouts",)}
    rows = [(1, "stamp", {"whereabouts": "one.txt"}), (2, "PEEK_AT", {"whereabouts": "two.txt"}), (3, "Console", {"cmd": "wc three.txt"}), (4, "console", {"command": ["wc", "-l", "four.txt"]})]
    assert sorted((r["turn"], r["path"], r["kind"]) for r in touches.detect(calls(spark, *rows), **own).collect()) == [(1, "one.txt", "write"), (2, "two.txt", "read"), (3, "three.txt", "read"), (4, "four.txt", "read")]
    assert touches.detect(calls(spark, *rows)).isEmpty()
    bad = [(1, "view", {tx.PATH_KEYS[0]: "\t"}), (1, "view", {tx.PATH_KEYS[0]: 12}), (1, "view", {}), (1, "sh", {"command": "mkdir one.txt"}), (1, "sh", {"command": ""}), (1, "sh", {"command": None})]
    assert touches.detect(calls(spark, *bad)).isEmpty()


def test_ledger_merges_and_renders(spark):
    found = touches.detect(calls(spark, (1, "edit", {"path": "x.py"}), (2, "read", {"path": "x.py"}), (3, "read", {"path": "x.py"})))
    own = touches.ledger(found)
    r = own.first()
    assert (r["first_seen_turn"], r["last_touched_turn"], r["reads"], r["writes"]) == (1, 3, 2, 1)
    described = touches.refine(own, spark.createDataFrame([(1, "x.py", "  the x  ")], "session long, path string, refined string"))
    assert touches.rendered(described).first()["text"].endswith("- x.py — the x  [r2/w1]")
    again = touches.merge_ledgers(described, own)
    assert (again.first()["reads"], again.first()["description"]) == (4, "the x")


def tagged(spark, rows):
    return spark.createDataFrame([(1, k, role, kind, "t") for k, (role, kind) in enumerate(rows)], "session long, seq long, role string, kind string, text string")


def test_classification_order(spark):
    rows = tagged(spark, [("system", None), ("assistant", "summary"), ("assistant", "file_ledger"), ("user", None), ("assistant", "full_turn"), ("user", "pinned"), ("system", None)])
    got = [r["bucket"] for r in turns.classify(rows).orderBy("seq").collect()]
    assert got == ["pinned", "summary", "file_ledger", "new_activity", "full_turn", "pinned", "new_activity"]
    five = turns.classify(tagged(spark, [("system", None)] * 5)).orderBy("seq").collect()
    assert [r["bucket"] for r in five] == ["pinned"] * 4 + ["new_activity"]


def test_demotion(spark):
    rows = spark.createDataFrame([(1, 1, 0, "full_turn", "a", "sum 1"), (1, 1, 1, "full_turn", "b", None), (1, 2, 2, "full_turn", "c", "sum 2"), (1, 3, 3, "full_turn", "d", "sum 3"), (1, 0, 4, "summary", "old", None), (1, 0, 5, "summary", "older", None)], "session long, turn long, seq long, kind string, text string, summary string")
    got = sorted((r["turn"], r["kind"], r["text"]) for r in turns.demote(rows, 2).collect())
    assert got == [(0, "summary", "older"), (1, "summary", "sum 1"), (2, "full_turn", "c"), (3, "full_turn", "d")]
    assert all(r["kind"] == "summary" for r in turns.demote(rows, 0).collect())


def test_bad_window():
    with pytest.raises(ValueError):
        CompactionConfig(window_size=-1)


BLOCKS = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "a.py", "n": 3}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}]}]


def test_block_chat_round_trip(spark):
    chat = spark.createDataFrame([(1, k, json.dumps(m)) for k, m in enumerate(BLOCKS)], "session long, seq long, message string")
    system = spark.createDataFrame([(1, "be kind")], "session long, system string")
    rows = providers.from_block_chat(chat, system)
    assert [r["role"] for r in rows.orderBy("seq").collect()] == ["system", "user", "assistant", "user"]
    sent = {r["seq"]: r["message"] for r in providers.to_block_chat(rows).collect()}
    assert sent[None] == "be kind"
    assert json.loads(sent[1])["content"][1]["input"] == {"path": "a.py", "n": 3}
    assert json.loads(sent[2])["content"][0]["content"] == "one\ntwo"


def test_function_chat_round_trip(spark):
    chat = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "read", "arguments": '{"path":"a.py"}'}}, {"id": "c2", "function": {"name": "run", "arguments": "not json"}}]}, {"role": "tool", "tool_call_id": "c1", "content": "body"}, {"role": "odd", "content": "x"}]
    rows = providers.from_function_chat(spark.createDataFrame([(1, k, json.dumps(m)) for k, m in enumerate(chat)], "session long, seq long, message string"))
    got = {r["seq"]: r for r in rows.collect()}
    assert json.loads(got[2]["blocks"][0]["input"]) == {"path": "a.py"}
    assert json.loads(got[2]["blocks"][1]["input"]) == {"_raw": "not json"}
    assert (got[3]["role"], got[3]["blocks"][0]["content"], got[4]["role"]) == ("tool", "body", "user")
    sent = {r["seq"]: json.loads(r["message"]) for r in providers.to_function_chat(rows).collect()}
    assert sent[2]["tool_calls"][0]["function"] == {"name": "read", "arguments": '{"path":"a.py"}'}
    assert sent[3] == {"role": "tool", "tool_call_id": "c1", "content": "body"}


def test_streamed_tool_calls(spark):
    parts = [{"role": "assistant", "content": "Hel"}, {"content": "lo"}, {"tool_calls": [{"index": 0, "id": "a", "function": {"name": "read", "arguments": '{"p":'}}]}, {"tool_calls": [{"index": 0, "function": {"arguments": "1}"}}]}]
    body = "".join(f"data: {json.dumps({'choices': [{'delta': p}]})}\n" for p in parts) + ": note\ndata: broken{\ndata: [DONE]\n"
    chunks = spark.createDataFrame([(1, k, body[i : i + 13]) for k, i in enumerate(range(0, len(body), 13))], "stream long, at long, data string")
    r = providers.from_event_stream(chunks).first()
    assert (r["role"], r["content"]) == ("assistant", "Hello")
    assert json.loads(r["tool_calls"])[0] == {"index": 0, "id": "a", "name": "read", "arguments": '{"p":1}'}


def test_kept_blocks_of_full_turns(spark):
    rows = providers.from_block_chat(spark.createDataFrame([(1, 0, json.dumps({"role": "assistant", "content": [{"type": "thinking", "thinking": "x"}, {"type": "image", "source": "i"}]})), (1, 1, json.dumps(BLOCKS[1]))], "session long, seq long, message string"))
    kept = turns.full_turns(rows.withColumn("turn", F.lit(1))).collect()
    assert [(r["seq"], r["head"], len(r["blocks"])) for r in kept] == [(1, True, 2)]


def test_reasoning(spark):
    r = spark.range(1).select(normal_level(F.lit(" NONE ")).alias("a"), request_params(F.lit("Anthropic"), F.lit("low")).alias("b")).first()
    assert r["a"] == "off" and json.loads(r["b"]) == {"thinking": {"type": "enabled", "budget_tokens": 1024}}


def test_store_and_fork(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path))
    assert store.state().count() == store.archive().count() == store.audit().count() == 0
    store.write_archive(spark.createDataFrame([("turn-0001", 1, "l", "s", "[]", "a"), ("turn-0002", 2, "l", "s", "[]", "a")], "archive_key string, turn long, label string, summary string, messages string, session string"))
    store.write_state(spark.createDataFrame([("a", 2, "{}", "[]")], store.STATE))
    store.write_state(spark.createDataFrame([("a", 3, "{}", "[]"), ("b", 1, "{}", "[]")], store.STATE))
    assert {(r["session"], r["turn_index"]) for r in store.state().collect()} == {("a", 3), ("b", 1)}
    store.append_audit(spark.createDataFrame([("a", "recall", 1, "x")], store.AUDIT))
    assert store.audit().count() == 1
    store.fork("a", "c")
    assert [r[0] for r in store.keys("c").collect()] == ["turn-0001", "turn-0002"]
    for source, target, kind in (("zz", "d", KeyError), ("a", "b", ValueError)):
        with pytest.raises(kind):
            store.fork(source, target)


def test_recall_shapes(spark):
    assert archive.recall_tool("openai")["function"]["name"] == archive.recall_tool("Anthropic")["name"]
    with pytest.raises(ValueError):
        archive.recall_tool("other")


def test_scan_and_parse(spark, tmp_path):
    for name, body in {"a.py": "def f():\n    return g()\n", "pkg/b.py": "class B:\n    pass\n", "node_modules/c.py": "x=1", "d.min.js": "x", "e.txt": "x", ".hid/f.py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = code.scan(spark, str(tmp_path))
    assert {r["file"] for r in found.collect()} == {"a.py", "pkg/b.py"}
    assert {r["node_id"] for r in code.parse(found).collect()} == {"a.py::f", "pkg/b.py::B"}
    assert code.size_limit("x") == 512 * 1024 and code.size_limit("0") == 1024


def test_greedy_matches_equal_a_sequential_pass(spark):
    import random

    rng = random.Random(2)
    for _ in range(3):
        pairs = [(rng.randrange(1, 5) / 4, i, f"c{j}") for i in range(6) for j in range(6) if rng.random() < 0.5]
        used, want = set(), set()
        for j, i, c in sorted(pairs, reverse=True):
            if ("n", i) not in used and ("o", c) not in used:
                used |= {("n", i), ("o", c)}
                want.add((i, c))
        got = graph.greedy_matches(spark.createDataFrame([(i, c, j) for j, i, c in pairs], "community int, concept_id string, jaccard double"))
        assert {(r["community"], r["concept_id"]) for r in got.collect()} == want


def test_identity_lineage(spark):
    new = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "x")], "community int, node_id string")
    old = spark.createDataFrame([("concept-0000", n) for n in "abcd"] + [("concept-0001", "x")], "concept_id string, node_id string")
    got = {r["community"]: r for r in graph.identify(new, old, threshold=0.5, next_number=2).collect()}
    assert got[2]["concept_id"] == "concept-0001"
    assert [got[k]["split_from"] for k in (0, 1)].count("concept-0000") == 1
    assert {got[0]["concept_id"], got[1]["concept_id"]} == {"concept-0002", "concept-0003"}


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(50, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-12
    s = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(50) for j in sorted((j for j in range(50) if j != i), key=lambda j: (-s[i, j], j))[:3]}
    assert {(r["id"], r["other"]) for r in similarity.neighbours(rows, 3, block_rows=12).collect()} == want


def test_tags_and_unchanged_concepts(spark):
    concepts = spark.createDataFrame([("c1", "Parser core"), ("c2", ""), ("c3", "io")], "concept_id string, tag string")
    assert {r[0] for r in retrieval.match_tags(concepts, ["parser"]).select("concept_id").collect()} == {"c1"}
    assert {r[0] for r in retrieval.match_tags(concepts, ["studio"], empty_matches=True).select("concept_id").collect()} == {"c2", "c3"}
    now = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "d"), ("c3", "e")], "concept_id string, node_id string")
    before = spark.createDataFrame([("c1", "b"), ("c1", "a"), ("c2", "x"), ("c3", "e")], "concept_id string, node_id string")
    assert [r[0] for r in snapshots.unchanged_concepts(now, before, spark.createDataFrame([("e",)], "node_id string")).collect()] == ["c1"]


class Failing:
    def complete(self, system, prompt):
        raise RuntimeError("down")


def test_enrichment_degrades(spark):
    rows = spark.createDataFrame([(1, "some text")], "id long, text string")
    good = enrich.enrich(rows, F.col("text")).first()["answer"]
    bad = enrich.enrich(rows, F.col("text"), Failing).first()["answer"]
    assert good["summary"] == "some text" and good["error"] is None
    assert (bad["tag"], bad["error"]) == ("", "RuntimeError: down")
    with pytest.raises(ValueError):
        enrich.build("nowhere")


def test_line_spans_and_json(spark):
    r = spark.range(1).select(tx.lines(F.lit("a\nb\r\nc"), F.lit(2), F.lit(9)).alias("x"), tx.lines(F.lit(None), F.lit(1), F.lit(2)).alias("y"), tx.session_key(F.lit("a b/c")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == ("b\nc", "", "a_b_c")


def test_system_override_and_empty_answers(spark):
    rows = spark.createDataFrame([(1, 0, "system", "a <env>x</env>"), (1, 1, "system", "b"), (1, 2, "user", "u"), (1, 3, "system", "late"), (2, 0, "user", "v")], "session long, seq long, role string, text string")
    want = {"replace": "P", "prefix": "P\n\na <env>x</env>\n\nb", "suffix": "a <env>x</env>\n\nb\n\nP", "prefix_env": "P\n\n<env>x</env>"}
    for mode, text in want.items():
        got = {(r["session"], r["seq"]): r["text"] for r in requests.override_system(rows, "P", mode).collect()}
        assert got == {(1, -1): text, (1, 2): "u", (1, 3): "late", (2, -1): "P", (2, 0): "v"}
    with pytest.raises(ValueError):
        requests.override_system(rows, "P", "other")
    r = spark.range(1).select(requests.is_empty(F.lit(" "), F.array()).alias("a"), requests.is_empty(F.lit(" "), F.array(F.lit("x"))).alias("b"), requests.is_turn(F.array(F.lit("t"))).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (True, False, True)


def test_neighbours_of_copies_and_odd_vectors(spark):
    """Large groups of copies, zero, null and non-finite vectors, and a bound, against brute force over blocks of several sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    v[rng.permutation(300)[:90]] = v[0]
    v[rng.permutation(300)[:40]] = 0.9 * v[1]
    v[7] = 0
    ids = rng.permutation(300) * 3 - 100
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = np.round(u @ u.T, 6)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(1, None), (2, [float("nan")] * 16), (5, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    given = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    for above in (None, 0.35):
        want = set()
        for i in range(300):
            best = sorted((-s[i, j], int(ids[j])) for j in range(300) if j != i and (above is None or s[i, j] > above))[:4]
            want |= {(int(ids[i]), j, -x, r) for r, (x, j) in enumerate(best, 1)}
        for size in (40, 4096):
            got = similarity.neighbours(given, 4, above=above, block_rows=size).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_neighbours_shuffle_no_copies_of_vectors(spark):
    """What is shuffled and kept must not grow with vectors times blocks: no plan explodes vectors to the blocks they meet."""
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(k * F.col("id")).cast("float")).alias("vec"))
    seen, write = [], type(rows.write).parquet
    try:
        type(rows.write).parquet = lambda self, path, *a, **b: (seen.append(self._df._jdf.queryExecution().toString()), write(self, path, *a, **b))[1]
        similarity.neighbours(rows, 3, block_rows=16)
    finally:
        type(rows.write).parquet = write
    assert len(seen) == 2 and "CartesianProduct" in seen[1] and not any("Generate" in x for x in seen)


def test_neighbours_of_nothing(spark):
    assert similarity.neighbours(spark.createDataFrame([], "id long, vec array<float>"), 3).collect() == []


def written(spark, make):
    """What make() returns, and the plans of the tables that it writes meanwhile."""
    kind, seen = type(spark.range(0).write), []
    write = kind.parquet
    try:
        kind.parquet = lambda self, path, *a, **b: (seen.append(self._df._jdf.queryExecution().toString()), write(self, path, *a, **b))[1]
        return make(), seen
    finally:
        kind.parquet = write


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors_dir(spark, tmp_path_factory):
    """A folder with a small table embeddings in three labels."""
    d = str(tmp_path_factory.mktemp("vectors"))
    vec = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(k * F.col("id") % 37).cast("float"))
    spark.range(300).select(F.col("id").alias("vec_id"), vec.alias("embedding"), (F.col("id") % 3).cast("int").alias("label")).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_lazy_neighbours_write_and_shuffle_nothing(spark):
    """Ids that stand several times are ranked together, in whichever blocks they are."""
    import numpy as np

    v = np.random.default_rng(4).normal(size=(120, 8))
    ids = [i % 100 for i in range(120)]
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = np.round(u @ u.T, 6)
    given = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, vec array<double>").repartition(3)
    want = []
    for i in range(100):
        best = sorted((-s[a, b], ids[b]) for a in range(120) if ids[a] == i for b in range(120) if ids[b] != i)[:5]
        want += [(i, other, -score, r) for r, (score, other) in enumerate(best, 1)]
    for size in (7, 4096):
        found, tables = written(spark, lambda size=size: similarity.neighbours(given, 5, block_rows=size, lazy=True))
        assert not tables
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    plan = plan_of(similarity.neighbours(spark.range(400).select("id", F.array(F.lit(1.0)).alias("vec")), 3, lazy=True))
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_hybrid_weights_write_no_vectors(spark, vectors_dir):
    """Only the labels' window and the weights of pairs are shuffled."""
    from tessella.plans import catalogue

    found, tables = written(spark, lambda: catalogue.hybrid_weights(spark, vectors_dir))
    assert not tables and plan_of(found).count("Exchange ") == 2
    assert found.count() == found.select("a", "b").distinct().count() > 300


def test_concept_neighbors_read_edges_once(spark, vectors_dir):
    """No table is written, and pairs both ways come from one reading of the edges."""
    from tessella.plans import catalogue

    found, tables = written(spark, lambda: catalogue.concept_neighbors(spark, vectors_dir))
    assert not tables and plan_of(found).count("CartesianProduct") == 2  # those of one neighbours()
    label = {i: i % 3 for i in range(300)}
    near = similarity.neighbours(catalogue._vectors(spark, vectors_dir), 8, above=0.35).where("score > 0.35").collect()
    pairs = {(label[r["id"]], label[r["other"]]) for r in near if label[r["id"]] != label[r["other"]]}
    assert pairs and sorted(tuple(r) for r in found.collect()) == sorted(pairs | {(b, a) for a, b in pairs})


def test_recall_for_vectors_writes_pairs_of_concepts_only(spark, vectors_dir):
    """The edges are read once and never written, the pairs of concepts are."""
    from tessella.plans import codegraph

    found, tables = written(spark, lambda: codegraph.recall_for_vectors(spark, vectors_dir))
    assert len(tables) == 1 and "CartesianProduct" in tables[0] and "CartesianProduct" not in plan_of(found)
    assert found.count() == 15 and found.where("text = ''").isEmpty()
