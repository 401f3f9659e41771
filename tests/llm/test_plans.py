"""What the native operators may not hold, and what no plan may hold."""

import pytest

from quarry.llm import exact_dedup, queries, secret_scan

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (exact_dedup.exact_groups(docs), secret_scan.scan(docs)):
        plan = plan_of(df)
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(queries.QUERIES[name](spark, sf_dir))
    assert not any(x in plan for x in BANNED)


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(queries.QUERIES["op9_transport_stream"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
