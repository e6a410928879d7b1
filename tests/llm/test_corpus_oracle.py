"""Queries of the corpus operators against their SQL, and those without SQL against what they must hold."""

import pytest

from compare import oracle, rows_of
from tunedata.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_row(spark, sf_dir, name):
    table = {"op3_warc": "pages", "op9_visible_text": "pages"}.get(name, "documents")
    if name != "op5_exact_top_k":
        assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op4_mix_sources", "op6_decontaminate", "op7_line_dedup"])
def test_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]
