"""Sessions folded as a stream against the batch operators, with late and repeated messages."""

import random

from pyspark.sql import functions as F

from tessella.operators import touches, turns
from tessella.sources.tables import messages
from tessella.streaming import sessions, timers

SF = "/root/testdata/sf0.001"
SCHEMA = "session long, seq long, role string, text string, touches array<struct<path:string,kind:string>>"


def folded(spark, tmp_path, batches, size, name):
    """The changelog of a stream that gets the batches one by one."""
    timers.with_timers(spark)
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        (tmp_path / name).mkdir(exist_ok=True)
        for f in (tmp_path / f"{name}-{k}").glob("part-*.parquet"):
            f.rename(tmp_path / name / f"{k:03d}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
        got = []
        query = sessions.fold_sessions(stream, size).writeStream.foreachBatch(lambda rows, _: got.extend(rows.collect()))  # noqa: B023
        query.option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        yield from got


def test_fold_with_ledger_equals_batch(spark, tmp_path):
    path = F.concat(F.lit("f"), F.col("seq") % 7, F.lit(".py"))
    kind = F.when(F.col("seq") % 3 == 0, "write").otherwise("read")
    rows = messages(spark, SF).withColumn("touches", F.when(F.col("seq") % 2 == 1, F.array(F.struct(path.alias("path"), kind.alias("kind")))))
    rows = rows.select(*[c.split()[0] for c in ("session", "seq", "role", "text", "touches")])
    size = rows.agg(F.max("seq")).first()[0] + 1
    batches = [rows.where((F.col("seq") >= size * k // 2) & (F.col("seq") < size * (k + 1) // 2)) for k in range(2)]
    changes = spark.createDataFrame(list(folded(spark, tmp_path, [*batches, batches[0]], 1, "fold_ledger")), sessions.OUT)
    got = sessions.current(changes)
    marked = turns.segment(rows)
    body = turns.recency(marked, 1).select("session", "kind", "turn", "seq", "text")
    pinned = marked.where("bucket = 'pinned'").select("session", F.lit("pinned").alias("kind"), F.lit(None).cast("long").alias("turn"), "seq", "text")
    assert sorted(map(str, got.where("kind <> 'ledger'").select("session", "kind", "turn", "seq", "text").collect())) == sorted(map(str, body.unionAll(pinned).collect()))
    ended = marked.where("bucket = 'new_activity'").join(rows.select("session", "seq", "touches"), ["session", "seq"]) if "touches" not in marked.columns else marked
    last = ended.where("bucket <> 'pinned'").groupBy("session").agg(F.max("turn").alias("open"))
    found = ended.where("bucket <> 'pinned'").join(last, "session").where("turn < open").select("session", "turn", "seq", F.explode("touches").alias("t")).select("session", "turn", "seq", "t.*")
    want = touches.rendered(touches.ledger(found))
    assert sorted(map(str, got.where("kind = 'ledger'").select("session", "text").collect())) == sorted(map(str, want.select("session", "text").collect()))


def test_late_and_repeated_messages(spark, tmp_path):
    said = [(0, "system", "rules"), (1, "user", "q1"), (2, "assistant", "a1"), (3, "user", "q2"), (4, "assistant", "a2"), (5, "assistant", "b2"), (6, "user", "q3"), (7, "assistant", "a3"), (8, "user", "q4"), (9, "assistant", "a4"), (10, "user", "q5")]
    row = {n: (1, n, role, text, [(f"p{n}", "read")]) for n, role, text in said}
    frame = lambda ns: spark.createDataFrame([row[n] for n in ns], SCHEMA)
    order = list(folded(spark, tmp_path, [frame(range(11))], 2, "in_order"))
    # 4 comes while its turn is open, 7 when it was told in full, 2 when its turn is a summary; some come twice.
    mixed = list(folded(spark, tmp_path, [frame([0, 1, 3, 5]), frame([4, 3, 1]), frame([6, 8]), frame([7, 7, 6]), frame([9, 10, 2])], 2, "mixed"))
    plain = lambda rows: sorted((r["kind"], r["turn"] or 0, r["seq"], r["text"]) for r in sessions.current(spark.createDataFrame(rows, sessions.OUT)).collect())
    a, b = plain(order), plain(mixed)
    late = [x for x in b if x[0] == "late"]
    assert [x[1:] for x in late] == [(1, 2, "a1")]
    assert [x for x in b if x[0] not in ("late", "summary")] == [x for x in a if x[0] != "summary"]
    assert [x for x in b if x[0] == "summary" and x[1] == 2] == [x for x in a if x[0] == "summary" and x[1] == 2]
    ledger = [x[3] for x in b if x[0] == "ledger"]
    assert len(ledger) == 1 and ledger[0].splitlines()[1:] == [f"- p{n} — (no description yet)  [r1/w0]" for n in range(1, 10)]


def test_any_cut_gives_the_same(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, n, "user" if n % 3 == 0 else "assistant", f"s{s} m{n}", [(f"p{n % 4}", rng.choice(["read", "write"]))]) for s in (1, 2) for n in range(9)]
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    cuts = [rows[:5], rows[5:12], rows[12:]]
    one = sessions.current(spark.createDataFrame(list(folded(spark, tmp_path, [frame(rows)], 1, "whole")), sessions.OUT)).collect()
    many = sessions.current(spark.createDataFrame(list(folded(spark, tmp_path, [frame(c) for c in cuts], 1, "cut")), sessions.OUT)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
