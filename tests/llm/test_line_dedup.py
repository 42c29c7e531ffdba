from pyspark.sql import Row

from tessella.llm import line_dedup


def brute(rows, size=3):
    """Kept text by doc_id: ids ascending, nulls last, repeated rows as one document."""
    by_id = {}
    for r in rows:
        by_id.setdefault((r[0], r[1]), r[1])
    seen, out = {}, {}
    for (doc, _), text in sorted(by_id.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        lines = text.split("\n")
        for i in range(len(lines) - size + 1):
            seen.setdefault(tuple(lines[i : i + size]), (doc, text, i))
    for (doc, text) in by_id:
        if text is None:
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - size + 1):
            if seen[tuple(lines[i : i + size])] != (doc, text, i):
                gone.update(range(i, i + size))
        out[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_brute_force_and_edges(docs, rows, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    want = brute(rows)
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(str(Row(doc_id=r[0], text=want[r[0], r[1]])) for r in rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_overlapping_repeats(spark):
    text = "a\nb\nc\nd\na\nb\nc\nd\ne"
    docs = spark.createDataFrame([(1, text), (2, "a\nb\nc"), (3, "a\nb"), (4, "q\nb\nc\nd\ne")], "doc_id long, text string")
    got = {r["r"]["doc_id"]: (r["kept"], r["n_lines"], r["n_removed"]) for r in line_dedup.annotate(docs).collect()}
    assert got == {1: ("a\nb\nc\nd\ne", 9, 4), 2: ("", 3, 3), 3: ("a\nb", 2, 0), 4: ("q", 5, 4)}
