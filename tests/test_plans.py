"""What the physical plans must not contain, and what they must."""

import re

import pytest

import __spark_entry__  # noqa: F401
from tunedata.plans.registry import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
MODEL_HOOKS = {"udf_generate", "udf_tokenize", "udf_moderate", "udf_guard"}
# Streams are read back from files, so their stateful operators are not in these plans.
SKIP = {n for n in QUERIES if n.startswith("st_")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_plan(spark, sf_dir, name):
    plan = QUERIES[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in FORBIDDEN if w in plan]
    assert ("ArrowEvalPython" in plan or "MapInPandas" in plan) <= (name in MODEL_HOOKS)
    # A window without partitions may only run over the totals of ranges.
    for line in plan.splitlines():
        if re.search(r"windowspecdefinition\(\w+#\w+, specifiedwindowframe", line) and " ASC " not in line and " DESC " not in line:
            continue  # partitions, and no order
        if re.search(r"Window \[", line) and not re.search(r"\], \[[^\]]*#\d+[^\]]*\], \[", line):
            assert "_range#" in line, line


@pytest.mark.parametrize("name", ["pad_batch", "kto_mismatch"])
def test_texts_are_scanned_once(spark, sf_dir, name):
    plan = QUERIES[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*text#", plan)) == 1


def test_few_shots_are_cut_in_every_partition(spark, sf_dir):
    assert "WindowGroupLimit" in QUERIES["mc_fewshot"].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,part", [
    ("flt_eq", "PushedFilters: [IsNotNull(source), EqualTo(source,src4)]"),
    ("flt_cadence", "ReadSchema: struct<event_id:bigint>"),
    ("tok_positions", "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint"),
    ("dist_range", "ReadSchema: struct<doc_id:bigint,n_chars:bigint>"),
])
def test_scan(spark, sf_dir, name, part):
    assert part in QUERIES[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
