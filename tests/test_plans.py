"""Plans: what must hold at scale is visible in the physical plan."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.model import Scope
from tidemark.operators import behaviour, explore, ingest, metrics
from tidemark.plans import queries
from tidemark.session import fits_broadcast, small_side
from tidemark.sources import events as sources
from tidemark.sources.sample import sample_facts
from tidemark.streaming import sinks

SF = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def ev(spark):
    return sample_facts(spark, SF)


def test_no_query_multiplies_two_tables(spark):
    for name in ("enrich_country", "facets", "value_share", "minmax_normalise", "documentation_coverage", "top10_of_many"):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(queries.all_queries()[name](spark, SF), True)), name


def test_copies_collapse_before_the_shuffle(ev):
    text = plan(ingest.dedup(ev))
    exchange = text.index("Exchange")
    assert "WindowGroupLimit" in text[:exchange] and "WindowGroupLimit" in text[exchange:]


def test_funnel_windows_share_a_shuffle_and_are_sliced(ev):
    text = plan(behaviour.funnel_levels(ev, [F.col("event_name") == n for n in ("view", "click", "purchase")]), True)
    assert len(re.findall(r"Exchange hashpartitioning\(actor#\d+, slice", text)) == 1
    assert len(re.findall(r"Window \[last", text)) == 2
    assert "bit_or" in text[text.rindex("Exchange") :]


def test_pairs_read_one_shuffle(ev):
    assert "ReusedExchange" in plan(behaviour.flow_edges(ev), True)


def test_hot_slice_groups_are_bounded(spark):
    """100,000 events of one anonymous visitor within one minute: a window sees at most one row per second."""
    many = spark.range(100_000).select(
        F.lit("").alias("actor_id"),
        F.lit("click").alias("event_name"),
        F.timestamp_millis(F.lit(1_788_300_000_000) + F.col("id") % 60_000).alias("event_timestamp"),
    )
    text = plan(behaviour.funnel_levels(many, [F.col("event_name") == "click"]), True)
    assert "bit_or" in text
    pairs = behaviour.consecutive_gap(many, "click").collect()
    assert [tuple(r) for r in pairs] == [("<10s", 99_999)]


def test_small_results_are_not_fully_sorted(ev):
    assert "TakeOrderedAndProject" in plan(metrics.event_distribution(ev))
    assert "TakeOrderedAndProject" in plan(explore.event_rows(ev))


def test_columns_are_pruned(spark):
    text = plan(metrics.event_distribution(sample_facts(spark, SF)))
    assert "ReadSchema: struct<event_type:string>" in text


def test_facts_prune_partitions(spark, folder):
    sinks.write_facts(sample_facts(spark, SF), folder, 0)
    text = plan(sources.facts(spark, folder, Scope("org-alpha", "workspace-1"), ("2024-01-05", "2024-01-09")))
    found = re.search(r"PartitionFilters: \[(.{100})", text)[1]
    assert "workspace_id" in found and "month" in found
    assert "event_timestamp" in re.search(r"PushedFilters: \[(.{80})", text)[1]


def test_parsed_payloads_are_parsed_once(spark):
    from tidemark.sources.sample import sample_payloads
    from tidemark.streaming import jobs

    text = plan(jobs.prepare(sample_payloads(spark, SF, resend=False)).where("error_class is null and destination like 'e%'"))
    assert text.count("parseJson") <= 2


def test_broadcast_needs_a_checked_size(spark):
    small, large = spark.range(10), spark.range(1_000)
    assert fits_broadcast(small, 10) and not fits_broadcast(large, 999)
    assert "ResolvedHint" in small_side(small)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(large, 999)._jdf.queryExecution().analyzed().toString()
