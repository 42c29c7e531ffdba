"""Every registered query against its SQL oracle."""

import random

import duckdb
import pytest

import __spark_entry__
from tessella.operators import graph
from tessella.plans import catalogue, codegraph, more  # noqa: F401
from tessella.sources.tables import links

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def listed(df, cols):
    return sorted(str([None if v is None or v != v else int(v) if hasattr(v, "is_integer") and float(v).is_integer() else v for v in row]) for row in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = con.sql(catalogue.ORACLES[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert listed(want, sorted(want.columns)) == listed(got, sorted(want.columns))


def test_shared_targets_of_many_pages(spark, tmp_path):
    """A target that 70 pages name ties all of them, whatever the blocks."""
    rng = random.Random(5)
    named = {p: {"/hot"} if p < 70 else set() for p in range(90)}
    for own in named.values():
        own.update(f"/t{rng.randrange(30)}" for _ in range(rng.randrange(4)))
    rows = [(p, "".join(f'<a href="{t}">x</a>' for t in sorted(own) * 2)) for p, own in named.items()] + [(None, '<a href="/hot">x</a>'), (3, '<a href="/hot"><a href="/t1">')]
    named[3].add("/t1")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted((a, b, len(named[a] & named[b])) for a in named for b in named if a < b and named[a] & named[b])
    assert sorted(map(tuple, catalogue.QUERIES["shared_target_edges"](spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, graph.shared_targets(links(spark, str(tmp_path)), block_pages=7).collect())) == want


def test_every_operator_of_the_second_catalogue_has_an_oracle():
    own = [n for n, q in catalogue.QUERIES.items() if q.__module__ == more.__name__]
    assert len(own) > 15 and set(own) <= set(catalogue.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
