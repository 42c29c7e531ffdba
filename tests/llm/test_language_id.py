from pyspark.sql import functions as F

from tessella.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.identify(docs).where(language_id.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert len(out) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95


def test_edges(docs, empty, rows):
    model = language_id.fit(docs)
    got = language_id.predict(docs, model)
    assert got.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 < r["score"] <= 1
    assert {r["lang_pred"] for r in out if r["doc_id"] == 15} == {"de"}
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_too_many_languages(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    try:
        language_id.fit(docs, max_langs=5)
    except ValueError:
        return
    raise AssertionError("the bound of the broadcast was not kept")


def test_held_out_rule(docs):
    ids = [r[0] for r in docs.select("doc_id").distinct().collect()]
    import zlib

    want = {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    assert {r[0]: r[1] for r in docs.select("doc_id", language_id.held_out(F.col("doc_id"))).collect()} == want
