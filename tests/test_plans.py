"""The physical plans the reports should get."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from bindings.tables import Bound
from gaugeworks.constants import DEADLOCK_EVENT
from gaugeworks.operators import events, memory, workload
from gaugeworks.plans import relational as R
from gaugeworks.sources import tables as table_files
from gaugeworks.sources.event_files import read_raw_events
from tests.test_relational import plan

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def nothing_is_small(spark):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    ):
        yield


@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if not n.startswith(("t0", "op", "pipeline"))))
def test_no_pair_joins_and_no_python(spark, name):
    """Even when no table is small enough to broadcast, no plan compares all pairs or leaves the JVM."""
    with nothing_is_small(spark):
        text = plan(contract.queries()[name](spark, SF_DIR))
    assert not re.search(r"Cartesian|NestedLoop|Python|Arrow", text)


def test_top_k_reports_do_not_sort_everything(spark):
    b = Bound(spark, SF_DIR)
    with nothing_is_small(spark):
        cracked = plan(events.crack_events(b.raw_events, b.databases))
        graphs = plan(events.deadlock_graphs(b.raw_events))
        largest = plan(memory.memory_breakdown(b.cache_counters, b.buffers, b.configurations, b.databases))
        ranked = plan(
            R.top_k(
                workload.rank_queries(b.runtime_stats, b.plans, b.queries, b.texts),
                [F.desc("rank_value"), F.asc("query_id")],
                25,
            )
        )
    for text in (cracked, graphs, largest, ranked):
        assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in graphs and "rangepartitioning" not in ranked


def test_window_filter_and_columns_reach_the_scan(spark, tmp_path):
    b = Bound(spark, SF_DIR)
    table_files.save(b.runtime_stats, str(tmp_path), "runtime_stats")
    stats = table_files.load(spark, str(tmp_path), "runtime_stats")
    with settings(spark, spark__sql__maxMetadataStringLength="2000"):
        ranked = plan(
            workload.rank_queries(
                workload._in_window(stats, "2024-01-31 00:00:00", 0, -720, None, ()), b.plans, b.queries, b.texts
            )
        )
    scan = next(line for line in ranked.splitlines() if "FileScan" in line and "runtime_stats" in line)
    assert "LessThanOrEqual(first_execution_time" in scan and "GreaterThanOrEqual(last_execution_time" in scan
    columns = re.search(r"FileScan parquet \[(.*?)\]", scan).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "plan_id",
        "count_executions",
        "first_execution_time",
        "last_execution_time",
        "avg_duration",
    }


def test_event_name_reaches_the_scan(spark, tmp_path):
    Bound(spark, SF_DIR).raw_events.write.parquet(f"{tmp_path}/raw_events")
    with settings(spark, spark__sql__maxMetadataStringLength="2000"):
        named = plan(read_raw_events(spark, f"{tmp_path}/raw_events", DEADLOCK_EVENT))
        counted = plan(
            events.event_heatmap(read_raw_events(spark, f"{tmp_path}/raw_events"), as_of="2024-01-31")
        )
        newest = plan(events.as_new_as(read_raw_events(spark, f"{tmp_path}/raw_events"), 5))
    assert "GreaterThanOrEqual(event_time" in counted and "event_data" not in counted
    first = newest[newest.rindex("TakeOrderedAndProject") :]
    assert "event_time" in first and "event_data" not in first
    assert f"EqualTo(object_name,{DEADLOCK_EVENT})" in named
    assert f"EqualTo(object_name,{DEADLOCK_EVENT})" in counted


def test_statistics_shrink_before_they_meet_the_plans(spark):
    b = Bound(spark, SF_DIR)
    with nothing_is_small(spark):
        text = plan(workload.rank_queries(b.runtime_stats, b.plans, b.queries, b.texts))
    assert text.index("SortMergeJoin [plan_id") < text.index("partial_sum((avg_duration")


def test_a_hot_key_is_split(spark):
    """A third of the rows has one key; adaptive execution reads its partition in several tasks."""
    left = spark.range(2000).withColumnRenamed("id", "k").withColumn("a", F.col("k") * 2)
    right = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("b")
    )
    with (
        nothing_is_small(spark),
        settings(
            spark,
            spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="256KB",
            spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
            spark__sql__adaptive__advisoryPartitionSizeInBytes="128KB",
        ),
    ):
        joined = R.left_join_many(left, right, ["k"])
        assert joined.count() == left.join(right, "k", "left").count()
        joined.collect()
        final = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final


@pytest.mark.parametrize(("name", "most", "derived"), [("a08_session_summary", 14, 1), ("a09_session_tasks", 14, 3), ("a10_blocking", 14, 3)])
def test_shuffles_of_the_session_reports(spark, name, most, derived):
    """``derived`` shuffles only make the test's own task and thread tables out of ``lineitem``."""
    shuffles = re.findall(r"Exchange (?:hash|range)partitioning\((\w+)", plan(contract.queries()[name](spark, SF_DIR)))
    assert shuffles.count("l_orderkey") == derived and len(shuffles) - derived <= most
