"""Physical plans: nothing that stops working when the tables grow."""

import re

import pytest

from fleetlens.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# These run jobs of their own before they give a result.
EAGER = re.compile("^(src1_|src3_|src4_|snk1_|str|prj6_)|_stream$|_rolled_files$")
# One row per operation type, shard, distinct count and segment of polls reach these windows.
SMALL_WINDOWS = {"ran2_op_mix", "ran4_shard_balance", "ran5_key_skew", "win3_operation_delta", "win3_null_and_empty_names"}


def plan_lines(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"^[\s:|+\-*]*(\(\d+\) )?", "", line) for line in plan.splitlines()]


@pytest.mark.parametrize("name", [n for n in QUERIES if not EAGER.search(n)])
def test_plan(spark, name):
    lines = plan_lines(QUERIES[name](spark, SF_DIR))
    text = "\n".join(lines)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in text
    for line, child in zip(lines, lines[1:]):
        if line.startswith("Exchange SinglePartition") and name not in SMALL_WINDOWS:
            assert "partial_" in child, f"{line} over {child}"


@pytest.mark.parametrize(
    "name, columns",
    [
        ("prj8_content_digest", "struct<doc_id:bigint,text:string>"),
        ("ran5_key_skew", "struct<l_partkey:bigint>"),
        ("agg4_node_liveness", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>"),
        ("agg1_role_counts", "struct<c_nationkey:int,c_acctbal:double,c_mktsegment:string>"),
    ],
)
def test_scans_read_only_the_columns_used(spark, name, columns):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", "\n".join(plan_lines(QUERIES[name](spark, SF_DIR))))
    assert columns in schemas


def test_plain_predicates_reach_the_scan(spark):
    from fleetlens.plans.views import table
    from fleetlens.operators.inventory import option_list

    lines = plan_lines(option_list(table(spark, SF_DIR, "part"), "p_name", "p_partkey", default_prefix="blue"))
    assert any("StringStartsWith(p_name,blue)" in line for line in lines)


def test_feed_reads_its_observations_once(spark):
    """The first and second pass share the shuffle of the observations."""
    from fleetlens.operators.change_feed import operation_delta

    polls = spark.range(100).selectExpr(
        "'x' as name", "id as poll_id", "id * 4000 as poll_ms", "id * 4000 - 4000 as cutoff_ms",
        "'RUNNING' as status", "cast(null as string) as start_time", "cast(null as string) as insert_time",
    ).repartition(3)
    news = operation_delta(polls)
    assert len(news.collect()) == 100
    final = news._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Range (0, 100") == 1 and "ReusedExchange" in final
