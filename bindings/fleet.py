"""Reports over a fleet: three servers of different size in one table each, with the equivalent SQL.

A server's tables are derived from its own part of the test tables; the first server has all of them.
The SQL runs a report's single-server SQL on each server's tables and stacks the results.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import cpu, events, memory, replicas, sessions, statistics, storage, workload
from bindings import events as event_reports
from bindings import memory as memory_reports
from bindings import replicas as replica_reports
from bindings import sessions as session_reports
from bindings import storage as storage_reports
from bindings import workload as workload_reports
from bindings.tables import Bound, with_tables

KEYS = ("instance_id", "captured_at")
CAPTURED = {"east": "2024-01-31 00:00:00", "north": "2024-01-31 00:05:00", "west": "2024-01-31 00:00:00"}
#: The rows of test tables that a server lacks others of.
PARTS = {
    "east": {},
    "north": {"events": "user_id % 3 = 0", "lineitem": "l_partkey % 2 = 0", "orders": "o_custkey % 2 = 0"},
    "west": {"events": "user_id % 7 = 1", "lineitem": "l_suppkey % 5 = 0", "customer": "c_custkey % 3 = 0"},
}


class Fleet:
    """Derived tables of all servers by attribute, each row with its server and capture time."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        whole = Bound(spark, sf_dir)
        self._servers = {
            server: whole.replace(**{t: getattr(whole, t).filter(rows) for t, rows in parts.items()})
            for server, parts in PARTS.items()
        }

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        marked = [
            getattr(b, name).withColumns({"instance_id": F.lit(s), "captured_at": F.lit(CAPTURED[s]).cast("timestamp")})
            for s, b in self._servers.items()
        ]
        first, *others = marked
        for other in others:
            first = first.unionByName(other)
        return first


def _sessions(t) -> sessions.SessionTables:
    return sessions.SessionTables(**{f.name: getattr(t, f.name) for f in fields(sessions.SessionTables)})


def _workload(report, t, **options):
    at = {"as_of": workload_reports.AS_OF, "hours_back": workload_reports.HOURS_BACK}
    return report(t.runtime_stats, t.plans, t.queries, t.texts, t.workload_objects, keys=KEYS, **at, **options)


def _staleness(t):
    return statistics.statistics_staleness(
        t.objects, t.schemas, t.stats, t.partition_stats, t.incremental_props, t.stats_props,
        include_auto=True, include_system=True, keys=KEYS,
    )


AT = {"as_of": event_reports.AS_OF}

REPORTS = {
    "a01_top_total": lambda t: _workload(workload.top_queries, t),
    "a07_all_metrics": lambda t: _workload(workload.workload_buckets, t),
    "a08_session_summary": lambda t: session_reports._lists_as_text(
        sessions.session_summary(_sessions(t), server_name=session_reports.SERVER, lists="structs", keys=KEYS)
    ),
    "a09_session_tasks": lambda t: sessions.session_tasks(_sessions(t), server_name=session_reports.SERVER, keys=KEYS),
    "a10_blocking": lambda t: sessions.blocking(
        _sessions(t), server_name=session_reports.SERVER, watch_databases=[session_reports.WATCHED], keys=KEYS
    ),
    "a11_event_heatmap": lambda t: events.event_heatmap(t.raw_events, days_back=30, keys=KEYS, **AT),
    "a12_last_event": lambda t: events.last_event(t.raw_events, keys=KEYS, **AT),
    "a13_deadlock_graphs": lambda t: events.deadlock_graphs(t.raw_events, utc_offset=-90, keys=KEYS),
    "a17_cracked_events": lambda t: events.crack_events(t.raw_events, t.databases, utc_offset=120, keys=KEYS),
    "a20_replica_latency": lambda t: replicas.replica_latency(
        t.groups, t.replicas, t.db_cluster_states, t.replica_states, t.db_replica_states, keys=KEYS
    ),
    "a21_database_size": lambda t: storage.database_size(t.files, t.partitions, t.space_units, t.internal_tables, KEYS),
    "a22_space_summary": lambda t: storage.space_summary(t.partitions, t.space_units, t.internal_tables, KEYS),
    "a24_space_by_object": lambda t: storage.space_by_object(
        t.partition_stats, t.internal_tables, t.objects, t.schemas, t.partitions, system_objects=True, keys=KEYS
    ),
    "a25_allocations": lambda t: storage.allocations(
        t.tables, t.schemas, t.indexes, t.partitions, t.row_groups, t.allocation_units, KEYS
    ),
    "a28_rowgroup_fragments": lambda t: storage.rowgroup_fragments(
        storage.rowgroup_workset(t.tables, t.schemas, t.indexes, t.partitions, t.row_groups, keys=KEYS), full_rows=2, keys=KEYS
    ),
    "a29_statistics_staleness": _staleness,
    "a30_memory_breakdown": lambda t: memory.memory_breakdown(t.cache_counters, t.buffers, t.configurations, t.databases, keys=KEYS),
    "a31_buffer_usage": lambda t: memory.buffer_usage(t.buffers, t.databases, KEYS),
    "a32_memory_grants": lambda t: memory.memory_grants(
        t.memory_grants, t.requests, t.sessions, t.connections, t.input_buffers, t.query_plans, t.databases,
        exclude_session=7, keys=KEYS, **AT,
    ),
    "a33_page_life": lambda t: memory.page_life(t.counters, keys=KEYS, **AT),
    "a34_thread_totals": lambda t: cpu.thread_totals(t.sys_info, t.threads, t.workers, KEYS),
}


def _registered(report):
    return lambda spark, sf_dir: report(Fleet(spark, sf_dir))


QUERIES = {f"{name}_fleet": _registered(report) for name, report in REPORTS.items()}

_SINGLE: dict[str, str] = {}
for _module in (workload_reports, session_reports, event_reports, replica_reports, storage_reports, memory_reports):
    _SINGLE |= _module.ORACLE


def _stacked(sql: str) -> str:
    """One server's SQL over each server's tables."""
    parts = []
    for server, rows in PARTS.items():
        own = ", ".join(f"{t} as (select * from main.{t} where {condition})" for t, condition in rows.items())
        body = with_tables(sql).strip()
        if own:
            body = f"with {own}, {body[5:]}" if body.lower().startswith("with ") else f"with {own} {body}"
        parts.append(f"select '{server}' as instance_id, timestamp '{CAPTURED[server]}' as captured_at, q.* from ({body}) q")
    return "\nunion all by name\n".join(parts)


ORACLE = {f"{name}_fleet": _stacked(_SINGLE[name]) for name in REPORTS}
