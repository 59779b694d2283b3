"""Shapes of physical plans: nothing pairs all rows with all, and filters and columns reach the scan."""

from __future__ import annotations

import os
import re

import pytest

from weirflow.plans import cdc, pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**pipeline.QUERIES, **cdc.QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"consumer_state", "change_feed", "consumer_rejects"}))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(cdc.genesis_scan(spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert "updated_at" in pushed and "model_name" in pushed and "topic" in pushed
    assert "PushedFilters: [IsNull(published_at)" in plan(cdc.pending_topics(spark, SF))


def test_scans_read_only_what_is_asked_for(spark):
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan(cdc.pending_topics(spark, SF)))[1]
    assert columns in ("topic:string,published_at:timestamp_ntz", "topic:string,published_at:timestamp")
    assert "text" not in plan(pipeline.p1_found(spark, SF))


def test_top_k_is_limited_before_the_shuffle(spark):
    assert plan(cdc.fetch_publishable(spark, SF)).count("WindowGroupLimit") == 2


def test_parents_are_found_by_a_semi_join(spark):
    assert "LeftSemi" in plan(cdc.dependency_parents(spark, SF))
