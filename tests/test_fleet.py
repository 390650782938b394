"""Every report over a fleet equals the same report over each server on its own."""

from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from bindings.tables import Bound
from gaugeworks.operators import cpu, events, memory, replicas, sessions, statistics, storage, workload
from tests.check import rows

SF_DIR = "/root/testdata/sf0.001"
KEYS = ["instance_id"]
SERVERS = ("east", "west")


class Fleet:
    """One derived table of all servers, each server's rows marked with its name."""

    def __init__(self, servers):
        self._servers = servers

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        parts = [getattr(b, name).withColumn("instance_id", F.lit(s)) for s, b in self._servers.items()]
        return parts[0].unionByName(parts[1])


@pytest.fixture(scope="module")
def servers(spark):
    east = Bound(spark, SF_DIR)
    west = east.replace(
        events=east.events.filter("user_id % 3 = 0").withColumn("value", F.col("value") * 2),
        lineitem=east.lineitem.filter("l_partkey % 2 = 0").withColumn("l_quantity", F.col("l_quantity") + 1),
        orders=east.orders.filter("o_custkey % 2 = 0"),
        customer=east.customer.withColumn("c_acctbal", F.col("c_acctbal") / 2),
    )
    return {"east": east, "west": west}


def session_tables(t):
    return sessions.SessionTables(**{f.name: getattr(t, f.name) for f in fields(sessions.SessionTables)})


def workset(t, keys):
    return storage.rowgroup_workset(t.tables, t.schemas, t.indexes, t.partitions, t.row_groups, keys=keys)


WINDOW = {"as_of": "2024-01-31 00:00:00", "hours_back": -720}
AT = {"as_of": "2024-01-31 00:00:00"}

REPORTS = {
    "top_queries": lambda t, k: workload.top_queries(
        t.runtime_stats, t.plans, t.queries, t.texts, t.workload_objects, n=5, keys=k, **WINDOW
    ),
    "workload_buckets": lambda t, k: workload.workload_buckets(
        t.runtime_stats, t.plans, t.queries, t.texts, t.workload_objects, metrics=("duration",), keys=k, **WINDOW
    ),
    "session_summary": lambda t, k: sessions.session_summary(session_tables(t), server_name="s", keys=k),
    "session_children": lambda t, k: sessions.session_children(session_tables(t), keys=k),
    "session_lists": lambda t, k: sessions.session_summary(session_tables(t), server_name="s", lists="xml", keys=k),
    "session_tasks": lambda t, k: sessions.session_tasks(session_tables(t), server_name="s", keys=k),
    "blocking": lambda t, k: sessions.blocking(session_tables(t), server_name="s", keys=k),
    "event_heatmap": lambda t, k: events.event_heatmap(t.raw_events, keys=k, days_back=30, **AT),
    "last_event": lambda t, k: events.last_event(t.raw_events, keys=k, **AT),
    "deadlock_graphs": lambda t, k: events.deadlock_graphs(t.raw_events, n=9, keys=k),
    "crack_events": lambda t, k: events.crack_events(t.raw_events, t.databases, n=9, keys=k),
    "feature_counters": lambda t, k: events.feature_counters(t.counters, keys=k),
    "replica_inventory": lambda t, k: replicas.replica_inventory(
        t.groups, t.group_states, t.replica_cluster_states, t.replicas, t.replica_states, t.listeners, keys=k
    ),
    "replica_latency": lambda t, k: replicas.replica_latency(
        t.groups, t.replicas, t.db_cluster_states, t.replica_states, t.db_replica_states, keys=k
    ),
    "database_size": lambda t, k: storage.database_size(t.files, t.partitions, t.space_units, t.internal_tables, k),
    "space_summary": lambda t, k: storage.space_summary(t.partitions, t.space_units, t.internal_tables, k),
    "schema_counts": lambda t, k: storage.schema_counts(t.objects, t.schemas, k),
    "space_by_object": lambda t, k: storage.space_by_object(
        t.partition_stats, t.internal_tables, t.objects, t.schemas, t.partitions, keys=k
    ),
    "allocations": lambda t, k: storage.allocations(
        t.tables, t.schemas, t.indexes, t.partitions, t.row_groups, t.allocation_units, k
    ),
    "rowgroup_detail": lambda t, k: storage.rowgroup_detail(workset(t, k), k),
    "rowgroup_rollup": lambda t, k: storage.rowgroup_rollup(workset(t, k), k),
    "rowgroup_fragments": lambda t, k: storage.rowgroup_fragments(workset(t, k), full_rows=2, keys=k),
    "statistics_staleness": lambda t, k: statistics.statistics_staleness(
        t.objects, t.schemas, t.stats, t.partition_stats, t.incremental_props, t.stats_props, keys=k
    ),
    "memory_breakdown": lambda t, k: memory.memory_breakdown(
        t.cache_counters, t.buffers, t.configurations, t.databases, keys=k
    ),
    "buffer_usage": lambda t, k: memory.buffer_usage(t.buffers, t.databases, k),
    "memory_grants": lambda t, k: memory.memory_grants(
        t.memory_grants, t.requests, t.sessions, t.connections, t.input_buffers, t.query_plans, t.databases, keys=k, **AT
    ),
    "page_life": lambda t, k: memory.page_life(t.counters, keys=k, **AT),
    "thread_totals": lambda t, k: cpu.thread_totals(t.sys_info, t.threads, t.workers, k),
    "scheduler_totals": lambda t, k: cpu.scheduler_totals(t.schedulers, k),
    "scheduler_detail": lambda t, k: cpu.scheduler_detail(t.schedulers, k),
    "requests_by_command": lambda t, k: cpu.requests_by_command(t.requests, keys=k),
    "worker_status": lambda t, k: cpu.worker_status(t.workers, k),
}


@pytest.mark.parametrize("name", REPORTS)
def test_fleet_equals_each_server(servers, name):
    together = REPORTS[name](Fleet(servers), KEYS)
    columns = [c for c in together.columns if c != "instance_id"]
    collected = together.collect()
    assert together.columns[0] == "instance_id" and collected
    for server, tables in servers.items():
        alone = REPORTS[name](tables, ())
        assert alone.columns == columns
        mine = [[r[c] for c in columns] for r in collected if r["instance_id"] == server]
        assert rows(columns, mine) == rows(columns, alone.collect())


def test_one_name_is_another_object_on_each_server(spark):
    """``resolve_object`` over a fleet gives each server's own id, and the report each server's own rows."""
    frame = spark.createDataFrame
    objects = frame([("a", 1, 1, "t", "U ", False), ("b", 9, 2, "t", "U ", False), ("b", 1, 2, "u", "U ", False)],
                    "instance_id string, object_id int, schema_id int, name string, type string, is_ms_shipped boolean")
    schemas = frame([("a", 1, "dbo"), ("b", 2, "dbo")], "instance_id string, schema_id int, name string")
    internal = frame([], "instance_id string, object_id int, parent_id int, internal_type int")
    found = storage.resolve_object(objects, schemas, internal, "t", "db", "dbo", KEYS)
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("b", 9)}
