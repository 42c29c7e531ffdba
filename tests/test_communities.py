"""Communities against one-by-one local moves, and their invariants."""

import random
from pathlib import Path

from tessella.operators import communities as found
from tessella.operators import graph


def one_by_one(nodes: list, weight: dict[tuple, float], resolution: float) -> list[list]:
    """Communities by local moves on ever coarser graphs; ties go to the least member, so the result is reproducible."""
    near: dict = {v: {} for v in nodes}
    for (a, b), w in weight.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    total = sum(weight.values())
    group = {v: [v] for v in nodes}
    loops = dict.fromkeys(nodes, 0.0)
    while total > 0:
        degree = {v: sum(near[v].values()) + 2 * loops[v] for v in near}
        home = {v: v for v in near}
        mass = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(near):
                pull: dict = {}
                for u, w in near[v].items():
                    pull[home[u]] = pull.get(home[u], 0.0) + w
                old = home[v]
                mass[old] -= degree[v]
                gain = lambda c: pull.get(c, 0.0) - resolution * degree[v] * mass[c] / (2 * total)  # noqa: B023, E731
                best = min({old, *pull}, key=lambda c: (-round(gain(c), 12), c))
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                mass[best] += degree[v]
                if best != old:
                    home[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        parts: dict = {}
        for v in sorted(near):  # a community that moves have torn apart becomes several
            parts.setdefault(home[v], []).append(v)
        label: dict = {}
        for own in parts.values():
            left = set(own)
            while left:
                root = min(left)
                queue = [root]
                left.discard(root)
                while queue:
                    x = queue.pop()
                    label[x] = root
                    fresh = [u for u in near[x] if u in left]
                    left.difference_update(fresh)
                    queue += fresh
        coarse: dict = {r: {} for r in set(label.values())}
        own_loops = dict.fromkeys(coarse, 0.0)
        for v in near:
            own_loops[label[v]] += loops[v]
            for u, w in near[v].items():
                if label[u] == label[v]:
                    own_loops[label[v]] += w / 2
                else:
                    coarse[label[v]][label[u]] = coarse[label[v]].get(label[u], 0.0) + w
        group = {r: sorted(x for v in near if label[v] == r for x in group[v]) for r in coarse}
        near, loops = coarse, own_loops
    return sorted(group.values(), key=lambda m: (-len(m), m[0]))


def quality(nodes, weight, groups, resolution=1.0):
    home = {v: k for k, g in enumerate(groups) for v in g}
    total = sum(weight.values())
    mass = {}
    for (a, b), w in weight.items():
        for v in (a, b):
            mass[home[v]] = mass.get(home[v], 0.0) + w
    return sum(w for (a, b), w in weight.items() if home[a] == home[b]) / total - resolution * sum((m / (2 * total)) ** 2 for m in mass.values())


def connected(group, weight):
    near = {}
    for a, b in weight:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, queue = set(group), [next(iter(group))]
    left.discard(queue[0])
    while queue:
        fresh = near.get(queue.pop(), set()) & left
        left -= fresh
        queue += fresh
    return not left


def planted(rng, groups, size, inside, between, weighted):
    nodes = [f"n{k:04d}" for k in range(groups * size)]
    weight = {}
    for i, a in enumerate(nodes):
        for j in range(i):
            if rng.random() < (inside if i // size == j // size else between):
                weight[nodes[j], a] = rng.random() + 0.1 if weighted else 1.0
    return nodes, weight


def run(spark, graphs, resolution=1.0):
    """The groups that communities() finds in several codebases at once, by codebase, in the order of their numbers."""
    nodes = spark.createDataFrame([(g, v) for g, (n, _) in graphs.items() for v in n], "codebase string, node string")
    weights = spark.createDataFrame([(g, a, b, w) for g, (_, ws) in graphs.items() for (a, b), w in ws.items()], "codebase string, a string, b string, weight double")
    rows = found.communities(weights, nodes, resolution=resolution).collect()
    assert len(rows) == sum(len(set(n)) for n, _ in graphs.values())
    out = {}
    for g in graphs:
        own = {}
        for r in rows:
            if r["codebase"] == g:
                own.setdefault(r["community"], []).append(r["node"])
        assert sorted(own) == list(range(len(own)))
        out[g] = [sorted(own[k]) for k in range(len(own))]
        assert out[g] == sorted(out[g], key=lambda m: (-len(m), m[0]))
    return out, (weights, nodes)


def test_as_good_as_one_by_one(spark):
    """Partitions of connected communities; modularity is that of the sequential moves, or more, less 2 % (where groups hardly show, on average)."""
    rng = random.Random(4)
    graphs = {
        "clear": planted(rng, 8, 12, 0.6, 0.02, True),
        **{f"faint {k}": planted(rng, 6, 20, 0.3, 0.05, False) for k in range(4)},
        "sparse": planted(rng, 1, 150, 0.015, 0, True),
        "ring": ([f"r{k:03d}" for k in range(60)], {(f"r{k:03d}", f"r{k + 1:03d}"): 1.0 for k in range(59)} | {("r000", "r059"): 1.0}),
        "star": ([f"s{k:03d}" for k in range(80)], {("s000", f"s{k:03d}"): 1.0 for k in range(1, 80)}),
    }
    got, _ = run(spark, graphs)
    ratio = {}
    for g, (nodes, weight) in graphs.items():
        assert all(connected(m, weight) for m in got[g] if len(m) > 1), g
        ratio[g] = (quality(nodes, weight, got[g]) + 1e-9) / (quality(nodes, weight, one_by_one(nodes, weight, 1.0)) + 1e-9)
    faint = [x for g, x in ratio.items() if g.startswith("faint")]
    assert sum(faint) / len(faint) >= 0.98 and min(faint) >= 0.93, ratio
    assert all(x >= 0.98 for g, x in ratio.items() if not g.startswith("faint")), ratio
    assert got["clear"] == sorted((sorted(graphs["clear"][0][k : k + 12]) for k in range(0, 96, 12)), key=lambda m: m[0])


def test_resolution_modularity_and_odd_rows(spark):
    """Loops, unknown nodes, repeated and worthless weights, single nodes; coarser at a lower resolution."""
    triangle = {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 1.0, ("d", "e"): 1.0, ("e", "f"): 1.0, ("d", "f"): 1.0, ("c", "d"): 0.5}
    odd = triangle | {("a", "a"): 9.0, ("a", "zz"): 9.0, ("b", "f"): 0.0, ("c", "f"): -2.0}
    nodes = ["a", "b", "c", "d", "e", "f", "lonely", "a"]
    got, (weights, _) = run(spark, {"x": (nodes, odd), "none": (["p", "q"], {})})
    assert got == {"x": [["a", "b", "c"], ["d", "e", "f"], ["lonely"]], "none": [["p"], ["q"]]}
    assert run(spark, {"x": (nodes, odd)}, resolution=0.01)[0]["x"] == [["a", "b", "c", "d", "e", "f"], ["lonely"]]
    members = spark.createDataFrame([("x", k, v) for k, g in enumerate(got["x"]) for v in g], "codebase string, community int, node string")
    clean = spark.createDataFrame([("x", a, b, w) for (a, b), w in triangle.items()], weights.schema)
    assert abs(found.modularity(clean, members).first()["modularity"] - quality(nodes, triangle, got["x"])) < 1e-9
    assert run(spark, {})[0] == {}


def test_rounds_are_few_jobs_and_leave_no_tables(spark):
    """One job for the table of a round where nothing is broadcast, settings as they were, and only the result stays in the shared folder."""
    nodes, weight = planted(random.Random(9), 3, 8, 0.7, 0.05, True)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before, adaptive = {p.name for p in folder.iterdir()}, spark.conf.get("spark.sql.adaptive.enabled")
    spark.sparkContext.setJobGroup("communities", "")
    got, _ = run(spark, {"x": (nodes, weight)})
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(v for own in got["x"] for v in own) == nodes
    assert jobs < 400, jobs
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    fresh = [p for p in folder.iterdir() if p.name not in before and p.name.startswith("communit")]
    assert len(fresh) == 1 and [p.name for p in fresh[0].iterdir()] == ["1"]


def jobs_of(spark, work):
    """What work() returns, and the jobs that it took."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


def test_small_graphs_take_few_jobs(spark):
    nodes, weight = planted(random.Random(9), 3, 8, 0.7, 0.05, True)
    (got, _), jobs = jobs_of(spark, lambda: run(spark, {"x": (nodes, weight)}))
    assert sorted(v for own in got["x"] for v in own) == nodes
    assert jobs < 100, jobs


def test_many_blocks(spark, monkeypatch):
    """A graph of several blocks, with a vertex of more edges than a block has, split communities and groups dealt to several keys."""
    monkeypatch.setattr(found, "_EDGES", 60)
    monkeypatch.setattr(found, "_MEMBERS", 4)
    star = [f"s{k:03d}" for k in range(70)]
    graphs = {"clear": planted(random.Random(5), 4, 12, 0.6, 0.02, True), "star": (star, {(star[0], x): 1.0 for x in star[1:]})}
    got, _ = run(spark, graphs)
    for g, (nodes, weight) in graphs.items():
        assert sorted(v for m in got[g] for v in m) == nodes
        assert all(connected(m, weight) for m in got[g] if len(m) > 1), g
        assert quality(nodes, weight, got[g]) >= 0.95 * quality(nodes, weight, one_by_one(nodes, weight, 1.0)) - 1e-9, g


def test_components_of_long_chains_without_adaptive_execution(spark):
    """Few rounds for a chain, and no estimate of sizes that grows with each of them."""
    own = found._session(spark)
    place = list(range(2000))
    random.Random(3).shuffle(place)
    chain = own.createDataFrame(list(zip(place[:-1], place[1:], strict=True)) + [(-1, -2)], "a long, b long")
    rows, jobs = jobs_of(spark, lambda: graph.components(chain).collect())
    assert {(r["v"], r["root"]) for r in rows} == {(v, 0) for v in place} | {(-1, -2), (-2, -2)}
    assert jobs < 20, jobs
