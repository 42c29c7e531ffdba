"""Weighted communities by distributed local moves with refinement, on graphs of any size.

A level has three steps.  Moving: vertices are dealt to blocks of a bounded number of edges, by a
hash that changes in every round; a block's vertices look one after another at the weights to the
communities around them and go where modularity gains most, until none gains, while what lies
outside of the block stays as it was when the round began.  With several blocks only a share of the
vertices (by another hash) moves in a round.  Refining: inside each community, single vertices join
the parts that they are tied to, starting anew, so that every part is connected.  Contracting: parts
become the vertices of the next level, which starts with the communities found so far.  Levels repeat
until parts no longer merge.  A second pass starts again from single vertices in the communities of
the first; last, a community that isn't connected is cut into its components.

Masses and sizes of communities, what a block sees of others and the smaller graph are joins and sums
over edges and vertices; only the moves inside of a block are Python.  A vertex with more edges than
a block holds is in none: its weights are summed in many tasks, and it goes by that sum.  A
community with very many vertices is dealt to several keys.  Vertices are numbers over all codebases
(edges never join two), in the order of codebase and node.  Each round is a table
in the shared folder, deleted when the next is there.  What a round costs the driver counts: they run
in a session of their own without adaptive execution and broadcasts (one job for a table), with as many partitions as
the level's edges need, and the number of the round is a column, so that generated code is the same in
all of them.  Ties go to the lesser community and hashes are fixed, so results don't depend on the layout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Tables
from .graph import components, numbered

#: With several blocks, one in so many vertices may move in a round; that many rounds in a row take all of them.
MOVING = 2
#: Edges of a block and a task, about, and vertices of a community that meet in one key of a join, at most about.
_EDGES, _MEMBERS = 1 << 16, 1 << 12
#: Times that a block's vertices are gone through, at most.
_TURNS = 50
_STATE = "v long, degree double, price double, c long, g long, n long, k int, goes boolean"


def _session(spark: SparkSession) -> SparkSession:
    """A session for the rounds; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def _sized(spark: SparkSession, edges: int) -> int:
    """The blocks for so many edges; from now on there are as many tasks."""
    blocks = max(1, -(-edges // _EDGES))
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    return blocks


def _counted(tables: Tables, df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table, and its rows."""
    seen = Observation()
    kept = tables.keep(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return kept, seen.get["rows"]


def _active(key: str) -> Column:
    """Whether a vertex may move in the round of the column k."""
    return F.pmod(F.xxhash64(F.col(key), F.expr(f"CAST(k DIV {MOVING} AS INT)")) + F.col("k"), F.lit(MOVING)) == 0


def _weighed(state: DataFrame) -> DataFrame:
    """state with mass and n of each vertex's group g; its n so far, about the same in all of a group, tells to how many keys the group is dealt."""
    keys = F.expr(f"CAST(n DIV {_MEMBERS} AS INT)")
    groups = state.groupBy("g").agg(F.sum("degree").alias("mass"), F.count("*").alias("now"), F.max(keys).alias("keys"))
    groups = groups.select("g", "mass", "now", F.explode(F.sequence(F.lit(0), "keys")).alias("key"))
    dealt = state.withColumn("key", F.pmod(F.xxhash64("v"), keys + 1).cast("int"))
    return dealt.join(groups, ["g", "key"]).select("v", "degree", "price", "c", "g", "mass", F.col("now").alias("n"), "k")


def _walked(start: list, end: list, near: list, weight: list, place: list, may: list, degree: list, price: list, home: list, mass: list, size: list, busy: set, refine: bool) -> bool:
    """Moves of the vertices in may, one after another, until none gains: home (the group by vertex), mass and size (by group) change; whether any moved.

    Vertex i has the edges start[i] to end[i] and is place[i] in near and home.  In refining only single
    vertices go, and stay where another has joined them.  A group in busy is a vertex that may go meanwhile.
    """
    any_moved = False
    for _ in range(_TURNS):
        moved = False
        for i in may:
            old = home[place[i]]
            if refine and size[old] > 1:
                continue
            pull: dict[int, float] = {old: 0.0}
            for r in range(start[i], end[i]):
                to = home[near[r]]
                pull[to] = pull.get(to, 0.0) + weight[r]
            here = pull.pop(old)
            best, most = old, 0.0 if refine else here - price[i] * (mass[old] - degree[i]) + 1e-9
            for to, p in pull.items():
                gain = p - price[i] * mass[to]
                better = gain > most + 1e-12 or (best != old and to < best and gain > most - 1e-12)
                if better and (to not in busy or (not refine and (size[old] > 1 or to < old))):
                    best, most = to, gain
            if best != old:
                home[place[i]], moved = best, True
                mass[old] -= degree[i]
                mass[best] += degree[i]
                size[old] -= 1
                size[best] += 1
        if not moved:
            break
        any_moved = True
    return any_moved


def _ends(of: np.ndarray, keys: np.ndarray) -> tuple[list, list]:
    """Where each key's rows begin and end in sorted rows."""
    return np.searchsorted(of, keys, "left").tolist(), np.searchsorted(of, keys, "right").tolist()


def _swept(table: pa.Table, refine: bool) -> pa.Table:
    """state of a block's vertices after their moves; rows (v, u, w) are the edges of its vertices v, and for each v one with u = v, with what is known of u."""
    table = table.sort_by([("v", "ascending"), ("u", "ascending")])
    v, u, w, g, mass, n, active = (table[x].to_numpy() for x in ("v", "u", "w", "g", "mass", "n", "active"))
    mine = v == u
    own = table.filter(pa.array(mine))
    nodes, at = np.unique(u, return_inverse=True)
    groups, first, of = np.unique(g, return_index=True, return_inverse=True)
    home = np.zeros(len(nodes), dtype=np.int64)
    home[at] = of
    place, before, size = at[mine], home[at[mine]], n[first].tolist()
    busy = set(of[(n == 1) & active & ~np.isin(u, v[mine])].tolist())
    home = home.tolist()
    _walked(*_ends(v, v[mine]), at.tolist(), w.tolist(), place.tolist(), np.flatnonzero(active[mine]).tolist(), own["degree"].to_pylist(), own["price"].to_pylist(), home, mass[first].tolist(), size, busy, refine)
    after = np.array(home)[place]
    new = {"g": groups[after], "n": np.array(size)[after], "k": own["k"].to_numpy() + np.int32(1), "goes": after != before}
    return pa.table({"v": own["v"], "degree": own["degree"], "price": own["price"], "c": own["c"]} | {x: pa.array(y) for x, y in new.items()})


def _finished(table: pa.Table) -> pa.Table:
    """(v, c): the communities after all levels that are left, of a graph of one block; rows (v, u, w) with degree, price and c of v, and for each v one with u = v."""
    table = table.sort_by([("v", "ascending"), ("u", "ascending")])
    v, u, w = (table[x].to_numpy() for x in ("v", "u", "w"))
    own = table.filter(pa.array(v == u))
    names, c = own["v"].to_numpy(), own["c"].to_numpy()
    degree, price = own["degree"].to_numpy(), own["price"].to_numpy()
    v, u, of = np.searchsorted(names, v), np.searchsorted(names, u), np.arange(len(names))
    tied = v != u
    v, u, w = v[tied], u[tied], w[tied]
    home = np.unique(c, return_inverse=True)[1]
    while True:
        vertices = np.arange(len(degree))
        walk = lambda home, keep, refine: _walked(*_ends(v[keep], vertices), u[keep].tolist(), w[keep].tolist(), vertices.tolist(), vertices.tolist(), degree.tolist(), price.tolist(), home, np.bincount(home, degree).tolist(), np.bincount(home).tolist(), set(), refine)  # noqa: B023, E731
        walk(c := home.tolist(), slice(None), False)
        c = np.array(c)
        walk(part := vertices.tolist(), c[v] == c[u], True)
        heads, part = np.unique(part, return_inverse=True)
        if len(heads) == len(vertices):
            return pa.table({"v": names, "c": names[np.unique(c[of], return_index=True)[1]][np.unique(c[of], return_inverse=True)[1]]})
        of, home = part[of], np.unique(c[heads], return_inverse=True)[1]
        degree, price = np.bincount(part, degree), np.bincount(part, price)
        v, u = part[v], part[u]
        keys, at = np.unique(v * len(heads) + u, return_inverse=True)
        v, u, w = keys // len(heads), keys % len(heads), np.bincount(at, w)
        tied = v != u
        v, u, w = v[tied], u[tied], w[tied]


def _dealt(edges: DataFrame, state: DataFrame, refine: bool, whole: bool, blocks: int) -> DataFrame:
    """state after the moves of all blocks; edges have a row with u = v for each vertex. whole: edges stay inside of communities c, and each is in one block."""
    rows = _weighed(state).withColumn("active", F.lit(True) if whole else _active("v"))
    own = [F.when(F.col("v") == F.col("u"), F.col(x)).alias(x) for x in ("degree", "price", "c")]
    block = F.pmod(F.xxhash64("c") if whole else F.xxhash64("v", "k"), F.lit(blocks)).alias("block")
    near = edges.join(rows.withColumnRenamed("v", "u"), "u").select("v", "u", "w", *own, "g", "mass", "n", "k", "active", block)
    return near.groupBy("block").applyInArrow(lambda t: _swept(t, refine), _STATE)


def _whole(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(v, c) after all levels of a graph that is no larger than a block."""
    none = [F.lit(None).cast(t).alias(x) for x, t in (("degree", "double"), ("price", "double"), ("c", "long"))]
    rows = edges.select("v", "u", "w", *none).unionAll(state.select("v", F.col("v").alias("u"), F.lit(0.0).alias("w"), "degree", "price", "c"))
    return rows.groupBy(F.lit(0).alias("block")).applyInArrow(_finished, "v long, c long")


def _summed(edges: DataFrame, state: DataFrame, refine: bool) -> DataFrame:
    """state after the vertices with very many edges (here with these edges) went, each by the weights to the groups around it, which are summed in many tasks."""
    rows = _weighed(state)
    side = rows.select(F.col("v").alias("u"), F.col("g").alias("to"), F.col("mass").alias("to_mass"), F.col("n").alias("to_n"), "k")
    near = edges.join(side, "u").where(_active("v"))
    pulls = near.groupBy("v", "to").agg(F.sum("w").alias("pull"), F.max("to_mass").alias("to_mass"), F.max("to_n").alias("to_n"))
    seen = rows.join(pulls, "v", "left")
    if refine:  # a part that is joined stays: it has several members, or its only one isn't active
        may, stay = (F.col("to") != F.col("g")) & (F.col("n") == 1) & ((F.col("to_n") > 1) | ~_active("to")), F.lit(0.0)
    else:  # of two single vertices only the greater goes to the other, or both would change places
        may = (F.col("to") != F.col("g")) & ((F.col("n") > 1) | (F.col("to_n") > 1) | (F.col("to") < F.col("g")))
        stay = F.coalesce("here", F.lit(0.0)) - F.col("price") * (F.col("mass") - F.col("degree")) + 1e-9
    may, gain = F.col("to").isNotNull() & may, F.round(F.col("pull") - F.col("price") * F.col("to_mass"), 12)
    own = ["v", "degree", "price", "c", "g", "mass", "n", "k"]
    best = seen.withColumn("gain", gain).groupBy(*own).agg(
        F.min_by(F.struct("to", "to_n"), F.when(may, F.struct((-F.col("gain")).alias("less"), "to"))).alias("best"),
        F.max(F.when(may, F.col("gain"))).alias("best_gain"),
        F.max(F.when(F.col("to") == F.col("g"), F.col("pull"))).alias("here"),
    )
    best = best.withColumn("goes", F.coalesce(F.col("best_gain") > stay, F.lit(False)))
    at = lambda to, old: F.when(F.col("goes"), F.col(to)).otherwise(F.col(old)).alias(old)
    return best.select("v", "degree", "price", "c", at("best.to", "g"), at("best.to_n", "n"), "k", "goes")


def _rounds(edges: DataFrame, heavy: DataFrame | None, state: DataFrame, refine: bool, whole: bool, single: bool, vertices: int, blocks: int, tables: Tables, most: int) -> DataFrame:
    """state (v, degree, price, c, g) after rounds until hardly a vertex moves in as many as take all of them; heavy: the vertices with very many edges. single: g is v. whole: as in _dealt; one round takes all."""
    loops = state.select("v", F.col("v").alias("u"), F.lit(0.0).alias("w"))
    light = edges if heavy is None else edges.join(heavy, "v", "left_anti")
    rest = None if heavy is None else edges.join(heavy, "v", "left_semi")
    light = light.select("v", "u", "w").unionAll(loops)
    state = state.withColumns({"n": F.lit(1 if single else 16 * _MEMBERS).cast("long"), "k": F.lit(0)})
    quiet, first = 0, tables.count + 1
    for _ in range(most):
        moved = 0
        for step in (lambda s: _dealt(light, s, refine, whole, blocks), lambda s: _summed(rest, s, refine))[: 1 if rest is None else 2]:
            seen = Observation()
            state = tables.keep(step(state).observe(seen, F.count_if("goes").alias("moved"))).drop("goes")
            moved += seen.get["moved"]
            tables.delete(tables.count, first)
            first = tables.count
        quiet = quiet + 1 if 50 * moved <= vertices else 0
        if quiet == MOVING or whole:
            break
    return state


def _pass(edges: DataFrame, count: int, state: DataFrame, vertices: int, single: bool, tables: Tables, most: int) -> DataFrame:
    """state (v, degree, price, c) after all levels, from the communities c; a community is named by its least vertex. count: rows of edges."""
    spark = edges.sparkSession
    start, place = state, state.select(F.col("v").alias("node"), "v")
    while True:
        blocks = _sized(spark, count)
        if blocks == 1:
            state = tables.keep(_whole(edges, state))
            break
        heavy, some = _counted(tables, edges.groupBy("v").count().where(F.col("count") > _EDGES).select("v"))
        heavy = heavy if some else None
        state = _rounds(edges, heavy, state.withColumn("g", F.col("c")), False, False, single, vertices, blocks, tables, most)
        state, single = state.select("v", "degree", "price", F.col("g").alias("c")), False
        side = lambda k: state.select(F.col("v").alias(k), F.col("c").alias(f"{k}_of"))  # noqa: B023, E731
        inside = tables.keep(edges.join(side("v"), "v").join(side("u"), "u").where("v_of = u_of").select("v", "u", "w", F.col("v_of").alias("of")))
        at = tables.count
        whole = inside.groupBy("of").count().where(F.col("count") > _EDGES).isEmpty()
        parts = _rounds(inside, None if whole else heavy, state.withColumn("g", F.col("v")), True, whole, True, vertices, blocks, tables, most)
        tables.delete(at + 1, at)
        smaller, left = _counted(tables, parts.groupBy(F.col("g").alias("v")).agg(F.sum("degree").alias("degree"), F.sum("price").alias("price"), F.first("c").alias("c")))
        spark.sparkContext._jvm.System.gc()  # what rounds shuffled goes when the driver has collected its garbage, which may be long after
        if left == vertices:
            break
        of = parts.select("v", F.col("g").alias("r"))
        heads = smaller.groupBy("c").agg(F.min("v").alias("head"))
        state = tables.keep(smaller.join(heads, "c").select("v", "degree", "price", F.col("head").alias("c")))
        place = tables.keep(place.join(of, "v").select("node", F.col("r").alias("v")))
        ends = edges.join(of.withColumnRenamed("r", "a"), "v").join(of.select(F.col("v").alias("u"), F.col("r").alias("b")), "u")
        edges, count = _counted(tables, ends.where("a <> b").groupBy(F.col("a").alias("v"), F.col("b").alias("u")).agg(F.sum("w").alias("w")))
        vertices = left
    found = place.join(state.select("v", "c"), "v").select(F.col("node").alias("v"), "c")
    heads = found.groupBy("c").agg(F.min("v").alias("head"))
    return tables.keep(start.drop("c").join(found, "v").join(heads, "c").select("v", "degree", "price", F.col("head").alias("c")))


def modularity(weights: DataFrame, members: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """(codebase, modularity) of communities (codebase, community, node) under weights (codebase, a, b, weight)."""
    side = lambda k: members.select("codebase", F.col("node").alias(k), F.col("community").alias(f"{k}_of"))
    tied = weights.where("a <> b").join(side("a"), ["codebase", "a"]).join(side("b"), ["codebase", "b"])
    total = tied.groupBy("codebase").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("a_of") == F.col("b_of"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = tied.select("codebase", F.col("a_of").alias("community"), "weight").unionAll(tied.select("codebase", F.col("b_of").alias("community"), "weight"))
    mass = ends.groupBy("codebase", "community").agg(F.sum("weight").alias("mass")).join(total.select("codebase", "total"), "codebase")
    price = mass.groupBy("codebase").agg(F.sum((F.col("mass") / (2 * F.col("total"))) ** 2).alias("price"))
    return total.join(price, "codebase").select("codebase", (F.col("inside") / F.col("total") - resolution * F.col("price")).alias("modularity"))


def communities(weights: DataFrame, nodes: DataFrame, *, resolution: float = 1.0, passes: int = 2, most_rounds: int = 24) -> DataFrame:
    """(codebase, community, node): weighted communities of each codebase (weights: codebase, a, b, weight; nodes: codebase, node).

    Communities are connected and numbered from 0, the largest first, then by their least member.
    Weights of unknown nodes, of loops and of 0 or less don't count; repeated ones add up; a node
    without weights is a community of its own.
    """
    with Tables(_session(nodes.sparkSession), "communities") as tables:
        rows = _found(weights, nodes, resolution, passes, most_rounds, tables)
        return Tables(nodes.sparkSession, "communities").keep(rows)


def _found(weights: DataFrame, nodes: DataFrame, resolution: float, passes: int, most_rounds: int, tables: Tables) -> DataFrame:
    spark = tables.spark
    base = tables.keep(nodes.select("codebase", "node").where("codebase IS NOT NULL AND node IS NOT NULL").distinct())
    pairs = weights.where("a <> b AND weight > 0").groupBy("codebase", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    pairs, count = _counted(tables, pairs)
    _sized(spark, 2 * count)
    base = tables.keep(numbered(base, ["codebase", "node"], tables).withColumnRenamed("number", "v"))
    known = lambda k: base.select("codebase", F.col("node").alias(k), F.col("v").alias(f"{k}_v"))
    pairs, count = _counted(tables, pairs.join(known("a"), ["codebase", "a"]).join(known("b"), ["codebase", "b"]).select("codebase", F.col("a_v").alias("a"), F.col("b_v").alias("b"), "w"))
    _sized(spark, 2 * count)
    total = pairs.groupBy("codebase").agg(F.sum("w").alias("total"))
    both = lambda p: p.select("codebase", F.col("a").alias("v"), F.col("b").alias("u"), "w").unionAll(p.select("codebase", F.col("b").alias("v"), F.col("a").alias("u"), "w"))
    edges = tables.keep(both(pairs).select("v", "u", "w"))
    degree = both(pairs).groupBy("codebase", "v").agg(F.sum("w").alias("degree")).join(F.broadcast(total), "codebase")
    state, vertices = _counted(tables, degree.select("v", "degree", (resolution * F.col("degree") / (2 * F.col("total"))).alias("price"), F.col("v").alias("c")))
    for k in range(passes if vertices else 0):
        state = _pass(edges, 2 * count, state, vertices, k == 0, tables, most_rounds)
        _sized(spark, 2 * count)
    side = lambda k: state.select(F.col("v").alias(k), F.col("c").alias(f"{k}_of"))
    same = tables.keep(pairs.join(side("a"), "a").join(side("b"), "b").where("a_of = b_of").select("a", "b"))
    rows = tables.keep(base.join(components(same, tables), "v", "left").select("codebase", "node", F.coalesce("root", "v").alias("root")))
    sizes = rows.groupBy("codebase", "root").agg(F.count("*").alias("size"))
    ranked = numbered(sizes, ["codebase", F.desc("size"), "root"], tables)
    first = ranked.groupBy("codebase").agg(F.min("number").alias("first"))
    number = ranked.join(first, "codebase").select("codebase", "root", (F.col("number") - F.col("first")).cast("int").alias("community"))
    return rows.join(number, ["codebase", "root"]).select("codebase", "community", "node")
