"""Reports on hand-made rows: sentinels, NULLs, empty inputs and hot keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.predicates import flag_in
from gaugeworks.operators import cpu, events, memory, replicas, sessions, statistics, storage, workload
from gaugeworks.schemas import TABLES, schema
from gaugeworks.sources.event_files import read_raw_events, save_raw_events
from gaugeworks.sources import tables as table_files


def table(spark, name, *rows):
    """Rows given as dicts; columns not named are NULL."""
    fields = schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def ts(text):
    return datetime.fromisoformat(text)


# workload


def record(plan, first, last, avg, n, sd=0.0, kind=0):
    return {
        "plan_id": plan,
        "execution_type": kind,
        "execution_type_desc": "Aborted" if kind == 3 else "Regular",
        "count_executions": n,
        "first_execution_time": ts(first),
        "last_execution_time": ts(last),
        "avg_duration": avg,
        "min_duration": int(avg),
        "max_duration": int(avg),
        "stdev_duration": sd,
    }


@pytest.fixture(scope="module")
def work(spark):
    stats = table(
        spark,
        "runtime_stats",
        record(1, "2024-01-01T09:10", "2024-01-01T09:20", 1000.0, 3),
        record(1, "2024-01-01T09:30", "2024-01-01T09:59", 4000.0, 1, kind=3),
        record(2, "2024-01-01T09:00", "2024-01-01T09:00", 9000.0, 1),
        record(3, "2024-01-01T08:00", "2024-01-01T09:00", 500.0, 2),  # ends as the window starts
        record(4, "2024-01-01T08:00", "2024-01-01T08:59", 1e9, 9),  # before the window
        record(9, "2024-01-01T09:30", "2024-01-01T09:40", 1e9, 9),  # its plan is gone
    )
    plans = table(
        spark,
        "plans",
        *[{"plan_id": p, "query_id": q, "query_plan": f"<p{p}/>"} for p, q in ((1, 10), (2, 10), (3, 30), (4, 40))],
    )
    queries = table(
        spark,
        "queries",
        *[{"query_id": q, "object_id": o, "query_text_id": q * 2} for q, o in ((10, 5), (30, None), (40, 5))],
    )
    texts = table(spark, "texts", *[{"query_text_id": q * 2, "query_sql_text": f"q{q}"} for q in (10, 30, 40)])
    objects = spark.createDataFrame([(5, "proc")], "object_id bigint, name string")
    return stats, plans, queries, texts, objects


AT_TEN = {"as_of": "2024-01-01 10:25:00"}


def test_top_queries_window_order_and_names(work):
    result = workload.top_queries(*work, **AT_TEN).collect()
    assert {(r.query_id, r.plan_id, r.execution_type, r.total_duration, r.object_name) for r in result} == {
        (10, 1, "Regular", 3.0, "proc"),
        (10, 1, "Aborted", 4.0, "proc"),
        (10, 2, "Regular", 9.0, "proc"),
        (30, 3, "Regular", 1.0, ""),
    }
    assert len(result) == 4
    assert result[-1].query_id == 30
    assert {r.bucket_start for r in result} == {datetime(2024, 1, 1, 9)}
    assert {r.bucket_end for r in result} == {datetime(2024, 1, 1, 10)}
    assert {r.query_plan for r in result} == {"<p1/>", "<p2/>", "<p3/>"}


def test_top_queries_options(work, spark):
    assert {r.query_id for r in workload.top_queries(*work, n=1, **AT_TEN).collect()} == {10}
    assert {r.query_id for r in workload.top_queries(*work, min_plans=2, **AT_TEN).collect()} == {10}
    earlier = workload.top_queries(*work, window=-1, **AT_TEN).collect()
    assert {r.query_id for r in earlier} == {10, 30, 40}  # plan 2 ran at the very end of that window
    aborted = workload.aborted_queries(*work, **AT_TEN).collect()
    assert [(r.plan_id, r.execution_type, r.total_duration) for r in aborted] == [(1, "Aborted", 4.0)]
    off = table(spark, "capture_options", {"actual_state": 1})
    on = table(spark, "capture_options", {"actual_state": 2})
    assert workload.top_queries(*work, capture_options=off, **AT_TEN).count() == 0
    assert workload.top_queries(*work, capture_options=on, **AT_TEN).count() == 4
    local = workload.top_queries(*work, tz="Asia/Kolkata", **AT_TEN).first()
    assert local.bucket_start == datetime(2024, 1, 1, 14, 30)
    with pytest.raises(ValueError):
        workload.top_queries(*work, rank_by="median", **AT_TEN)


def test_workload_buckets(work):
    result = workload.workload_buckets(*work, metrics=("duration", "rowcount"), **AT_TEN).collect()
    assert len(result) == 4
    assert len(result[0]) == 6 + 12 + 3
    assert all(r.avg_rowcount is None and r.variation_rowcount == 0.0 for r in result)


# sessions


def session_tables(spark, **given):
    names = sessions.SessionTables.__dataclass_fields__
    return sessions.SessionTables(**{n: table(spark, n, *given.get(n, ())) for n in names})


def people(*ids, **more):
    return [{"session_id": i, "is_user_process": True, "login_name": "l", "original_login_name": "o", **more} for i in ids]


@pytest.fixture(scope="module")
def chain(spark):
    """1 idle head blocker, 2 blocked by 1, 3 running head of 4, 4 blocked, 5 idle, 6 a system session."""
    return session_tables(
        spark,
        sessions=[*people(1, 2, 3, 4, 5, database_id=7), {"session_id": 6, "is_user_process": False}],
        databases=[{"database_id": 7, "name": "shop"}],
        requests=[
            {"session_id": 2, "request_id": 0, "blocking_session_id": 1, "status": "suspended", "command": "UPDATE",
             "sql_handle": "h1", "statement_start_offset": 20, "statement_end_offset": 34, "plan_handle": "p1"},
            {"session_id": 3, "request_id": 0, "blocking_session_id": 0, "status": "running", "command": "SELECT",
             "sql_handle": "h2", "statement_start_offset": 0, "statement_end_offset": -1, "total_elapsed_time": -1},
            {"session_id": 4, "request_id": 0, "blocking_session_id": 3, "status": "suspended", "command": "SELECT"},
            {"session_id": 6, "request_id": 0, "blocking_session_id": 3, "status": "background", "command": "X"},
        ],
        session_transactions=[
            {"session_id": 1, "transaction_id": 100, "open_transaction_count": 2},
            {"session_id": 3, "transaction_id": 300, "open_transaction_count": 1},
        ],
        active_transactions=[
            {"transaction_id": 100, "name": "t100", "transaction_type": 1, "transaction_state": 7},
            {"transaction_id": 300, "name": "t300", "transaction_type": 4, "transaction_state": 7, "dtc_state": 2},
        ],
        tasks=[
            {"task_address": "a0", "session_id": 3, "request_id": 0, "exec_context_id": 0},
            {"task_address": "a1", "session_id": 3, "request_id": 0, "exec_context_id": 1},
        ],
        task_space=[
            {"session_id": 3, "request_id": 0, "exec_context_id": 1, "user_objects_alloc_page_count": 128,
             "user_objects_dealloc_page_count": 64, "internal_objects_alloc_page_count": 0,
             "internal_objects_dealloc_page_count": 0},
        ],
        waiting_tasks=[
            {"waiting_task_address": "a1", "session_id": 3, "exec_context_id": 1, "wait_duration_ms": 5, "wait_type": "A"},
            {"waiting_task_address": "a1", "session_id": 3, "exec_context_id": 1, "wait_duration_ms": 9, "wait_type": "B"},
            {"waiting_task_address": "zz", "session_id": 1, "exec_context_id": 0, "wait_duration_ms": 9, "wait_type": "C"},
        ],
        session_waits=[
            {"session_id": 3, "wait_type": "few", "waiting_tasks_count": 0, "wait_time_ms": 7},
            {"session_id": 3, "wait_type": "many", "waiting_tasks_count": 3, "wait_time_ms": 10},
            {"session_id": 5, "wait_type": "old", "waiting_tasks_count": 3, "wait_time_ms": 10},
        ],
        connections=[
            {"most_recent_session_id": 2, "local_net_address": "10.0.0.1", "local_tcp_port": 1500},
            {"most_recent_session_id": 3, "local_net_address": "10.0.0.9", "local_tcp_port": 1500},
            {"most_recent_session_id": 1, "most_recent_sql_handle": "h3"},
        ],
        listeners=[
            {"listener_id": "l1", "dns_name": "vnn1", "port": 1, "is_distributed_network_name": False},
            {"listener_id": "l2", "dns_name": "dnn1", "port": 1500, "is_distributed_network_name": True},
        ],
        listener_ips=[{"listener_id": "l1", "ip_address": "10.0.0.1"}],
        input_buffers=[
            *[{"session_id": i, "request_id": 0, "event_info": f"batch {i}"} for i in (2, 3, 4, 6)],
            {"session_id": 1, "request_id": None, "event_info": "last batch"},
        ],
        sql_texts=[
            {"sql_handle": "h1", "text": "select 1; select 2"},
            {"sql_handle": "h2", "text": "FETCH API_CURSOR01"},
            {"sql_handle": "h3", "text": "begin tran"},
            {"sql_handle": "c1", "text": "declare c cursor"},
        ],
        cursors=[{"session_id": 3, "sql_handle": "c1"}],
        query_plans=[{"plan_handle": "p1", "query_plan": "<plan/>"}],
        workload_groups=[],
    )


def test_session_summary(chain):
    result = {r.session_id: r for r in sessions.session_summary(chain, server_name="me", lists="structs").collect()}
    assert set(result) == {1, 2, 3, 4, 5}
    head = result[3]
    assert (head.head_blocker, head.state, head.transaction_name) == ("1", "Prepared", "t300")
    assert head.duration == "049 17:02:47.293"  # 4294967293 ms
    assert head.active_threads == 2 and head.listener_type == "DNN" and head.dns_name == "dnn1"
    assert [tuple(e) for e in head.tempdb_utilization] == [(1, 1.0, 0.5)]
    assert [(e.wait_type, e.wait_duration_ms) for e in head.current_waits] == [("A", 5), ("B", 9)]
    assert [(e.wait_type, str(e.avg_wait_time_ms)) for e in head.aggregate_waits] == [("many", "3.3333"), ("few", "0.0000")]
    assert head.executing_statement == "declare c cursor" and head.submitted_batch == "batch 3"
    blocked = result[2]
    assert (blocked.blocking_session, blocked.head_blocker, blocked.dns_name) == (1, None, "vnn1")
    assert blocked.executing_statement == "select 2" and blocked.query_plan == "<plan/>"
    idle = result[1]
    assert idle.head_blocker == "1" and idle.command_type == "AWAITING COMMAND"
    # without a request there is no transaction, wait or text in this view
    assert (idle.state, idle.open_tran_count, idle.current_waits, idle.submitted_batch) == (None, None, None, None)
    assert idle.executing_statement is None and result[5].aggregate_waits is None
    assert idle.dns_name == "me" and idle.listener_type is None and idle.database == "shop"


def test_session_summary_order_and_xml(chain):
    result = sessions.session_summary(chain, server_name="me", lists="xml").collect()
    assert [r.session_id for r in result] == [3, 1, 2, 4, 5]
    assert result[0].aggregate_waits.startswith("<waits><wait><wait_type>many</wait_type>")
    assert result[0].tempdb_utilization.count("<thread>") == 1


def test_session_tasks(chain):
    result = sessions.session_tasks(chain, server_name="me").collect()
    # 4 has input text, 5 has none and drops out, 1 shows its last input
    assert sorted((r.session_id, r.exec_context_id) for r in result if r.session_id == 3 and r.wait_type) == [(3, 1)]
    assert {r.session_id for r in result} == {1, 2, 3, 4} and len(result) == 5
    waiting = next(r for r in result if r.wait_type)
    assert (waiting.wait_type, waiting.wait_time_ms, waiting.tempdb_current_allocations) == ("B", 9, 0.5)
    idle = next(r for r in result if r.session_id == 1)
    assert (idle.state, idle.open_tran_count, idle.head_blocker) == ("Rolling Back", 2, "1")
    assert idle.submitted_batch is None and idle.executing_statement == "begin tran"
    assert next(r for r in result if r.session_id == 3).dns_name == "me"


def test_blocking(chain):
    result = sessions.blocking(chain, server_name="me").collect()
    assert [r.session_id for r in result][:1] in ([1], [3]) and result[0].head_blocker == "1"
    assert {r.session_id for r in result} == {1, 2, 3, 4, 6}  # system sessions count here
    watched = sessions.blocking(chain, server_name="me", watch_databases=["shop"]).collect()
    assert {r.session_id for r in watched} == {1, 2, 3, 4, 6}


def test_a_session_with_very_many_children(spark):
    """Equal children in any number never multiply a session's row."""
    hot = [{"session_id": 1, "wait_type": "w", "waiting_tasks_count": 1, "wait_time_ms": 1}] * 50_000
    few = [{"session_id": 2, "wait_type": "w", "waiting_tasks_count": 1, "wait_time_ms": 1}]
    t = session_tables(
        spark,
        sessions=people(1, 2, 3),
        requests=[{"session_id": i, "request_id": 0, "status": "running", "command": "S"} for i in (1, 2)],
        session_waits=[*hot, *few],
    )
    assert sorted(r.session_id for r in sessions.session_summary(t, server_name="me").collect()) == [1, 2, 3]
    listed = sessions.session_summary(t, server_name="me", lists="structs").collect()
    assert {r.session_id: len(r.aggregate_waits or ()) for r in listed} == {1: 50_000, 2: 1, 3: 0}
    children = sessions.session_children(t).groupBy("session_id", "kind").count().collect()
    assert {tuple(r) for r in children} == {(1, "wait_total", 50_000), (2, "wait_total", 1)}
    with pytest.raises(ValueError):
        sessions.session_summary(t, server_name="me", lists="true")


def test_a_task_without_request_is_no_task_of_an_idle_session(spark):
    t = session_tables(
        spark,
        sessions=people(1),
        input_buffers=[{"session_id": 1, "event_info": "x"}],
        tasks=[{"task_address": "a", "session_id": 1, "exec_context_id": 0}],
        waiting_tasks=[{"waiting_task_address": "a", "session_id": 1, "exec_context_id": 0, "wait_type": "W", "wait_duration_ms": 5}],
    )
    assert [(r.session_id, r.wait_type) for r in sessions.session_tasks(t, server_name="me").collect()] == [(1, None)]


# replication


@pytest.mark.parametrize(
    "reading, loss, recovery, sending",
    [
        ({"is_primary_replica": True}, 1, -1.0, -1.0),
        ({"redo_queue_size": 0, "redo_rate": 5}, -2, 0.0, -1.0),
        ({"redo_queue_size": 100, "redo_rate": 0, "log_send_rate": 0, "log_send_queue_size": 9}, -2, -2.0, -1.0),
        ({"redo_queue_size": 100, "redo_rate": None}, -2, -2.0, -1.0),
        ({"redo_queue_size": 100, "redo_rate": 40, "log_send_rate": 40, "log_send_queue_size": 100}, -2, 2.5, 2.5),
        ({"last_commit_time": ts("2024-01-01T10:00:00.900")}, 1, -2.0, -1.0),
    ],
)
def test_replica_latency(spark, reading, loss, recovery, sending):
    groups = table(spark, "groups", {"group_id": "g", "name": "ag"})
    members = [{"replica_id": r, "group_id": "g", "replica_server_name": r, "availability_mode": m} for r, m in
               (("p", 1), ("r", 1), ("w", 4))]
    cluster = [{"replica_id": r, "group_database_id": "d", "database_name": "db"} for r in ("r", "w")]
    states = [{"replica_id": "p", "role": 1}, {"replica_id": "r", "role": 2}, {"replica_id": "w", "role": 2}]
    db_states = [
        {"replica_id": "p", "group_database_id": "d", "last_commit_time": ts("2024-01-01T10:00:01.100")},
        {"replica_id": "r", "group_database_id": "d", **reading},
    ]
    result = replicas.replica_latency(
        groups,
        table(spark, "replicas", *members),
        table(spark, "db_cluster_states", *cluster),
        table(spark, "replica_states", *states),
        table(spark, "db_replica_states", *db_states),
        group="ag",
    ).collect()
    assert len(result) == 1
    row = result[0]
    assert (row.estimated_data_loss, row.estimated_recovery_time, row.synchronization_performance) == (loss, recovery, sending)
    assert row.suspend_reason == 7 and row.is_failover_ready is False and row.last_sent_time == datetime(1900, 1, 1)


def test_failover_ready_loses_nothing(spark):
    result = replicas.replica_latency(
        table(spark, "groups", {"group_id": "g", "name": "ag"}),
        table(spark, "replicas", {"replica_id": "r", "group_id": "g", "availability_mode": 1}),
        table(spark, "db_cluster_states", {"replica_id": "r", "group_database_id": "d", "is_failover_ready": True}),
        table(spark, "replica_states", {"replica_id": "r", "role": 2}),
        table(spark, "db_replica_states"),
    )
    assert result.first().estimated_data_loss == 0
    other = replicas.replica_latency(
        table(spark, "groups", {"group_id": "g", "name": "ag"}),
        table(spark, "replicas", {"replica_id": "r", "group_id": "g", "availability_mode": 1}),
        table(spark, "db_cluster_states", {"replica_id": "r", "group_database_id": "d"}),
        table(spark, "replica_states", {"replica_id": "r", "role": 2}),
        table(spark, "db_replica_states"),
        group="another",
    )
    assert other.count() == 0


# storage


def test_resolve_object(spark):
    objects = table(
        spark,
        "objects",
        {"object_id": 1, "schema_id": 1, "name": "t", "type": "U"},
        {"object_id": 2, "schema_id": 1, "name": "q", "type": "SQ"},
        {"object_id": 3, "schema_id": 1, "name": "p", "type": "P"},
        {"object_id": 4, "schema_id": 2, "name": "t", "type": "U"},
    )
    schemas = table(spark, "schemas", {"schema_id": 1, "name": "main"}, {"schema_id": 2, "name": "other"})
    internal = table(
        spark,
        "internal_tables",
        {"object_id": 20, "parent_id": 2, "internal_type": 201},
        {"object_id": 21, "parent_id": 2, "internal_type": 202},
    )

    def resolve(name):
        return storage.resolve_object(objects, schemas, internal, name, "db", "main")

    assert [resolve(n) for n in ("t", "main.t", "other.t", "db.main.t", "[db].[other].[t]", "q")] == [1, 1, 4, 1, 4, 20]
    for bad in ("x", "elsewhere.main.t", "p", "main.x"):
        with pytest.raises(ValueError):
            resolve(bad)


def test_space_of_one_object_and_its_internal_tables(spark):
    def pages(object_id, index_id, reserved, used, data):
        return {"object_id": object_id, "index_id": index_id, "partition_number": 1, "reserved_page_count": reserved,
                "used_page_count": used, "in_row_data_page_count": data, "lob_used_page_count": 1,
                "row_overflow_used_page_count": 0, "row_count": 50}

    stats = table(spark, "partition_stats", pages(1, 1, 10, 8, 5), pages(1, 2, 4, 3, 2), pages(9, 1, 6, 6, 1), pages(2, 0, 3, 3, 9))
    internal = table(spark, "internal_tables", {"object_id": 9, "parent_id": 1, "internal_type": 204})
    objects = table(
        spark,
        "objects",
        *[{"object_id": i, "schema_id": 1, "name": n, "type": "U", "is_ms_shipped": s} for i, n, s in
          ((1, "t", False), (2, "h", False), (9, "i", True))],
    )
    schemas = table(spark, "schemas", {"schema_id": 1, "name": "main"})
    partitions = table(spark, "partitions", {"object_id": 1, "index_id": 1, "partition_number": 1})
    result = storage.space_by_object(stats, internal, objects, schemas, partitions).collect()
    assert [tuple(r) for r in result] == [
        ("[main]", "[t]", "CLUSTERED", 1, 50, "160 KB", "56 KB", "80 KB", "24 KB"),
        ("[main]", "[h]", "HEAP", 1, 50, "24 KB", "80 KB", "0 KB", "0 KB"),
    ]
    one = storage.space_by_object(stats, internal, objects, schemas, partitions, object_id=1)
    assert [tuple(r) for r in one.collect()] == [tuple(result[0])]
    assert storage.space_by_object(stats, internal, objects, schemas, partitions, system_objects=True).count() == 3


def test_row_groups(spark):
    def group(number, state, total, deleted=0):
        return (1, 1, "[s].[t]", 1, "ix", 1, number, state, deleted, 0, total)

    workset = spark.createDataFrame(
        [group(0, "COMPRESSED", 1048576), group(1, "COMPRESSED", 1048575), group(2, "OPEN", 10), group(3, "CLOSED", 0)],
        "schema_id int, object_id int, table_name string, index_id int, index_name string, partition_number int, "
        "rowgroup_id int, state string, deleted_rows bigint, size_in_bytes bigint, total_rows bigint",
    )
    counted = storage.rowgroup_fragments(workset).first()
    assert (counted.fragments, counted.total_rowgroups) == (2, 3)
    detail = {r.rowgroup_id: r.percent_full for r in storage.rowgroup_detail(workset).collect()}
    assert detail == {0: 100.0, 1: 100.0, 2: 100.0, 3: None}
    assert storage.rowgroup_fragments(workset.filter("rowgroup_id in (0, 2)")).count() == 0


def test_statistics_staleness(spark):
    objects = table(spark, "objects", {"object_id": 1, "schema_id": 1, "name": "t", "is_ms_shipped": False})
    schemas = table(spark, "schemas", {"schema_id": 1, "name": "main"})
    stats = table(spark, "stats", {"object_id": 1, "stats_id": 2, "name": "st", "auto_created": False})
    part_stats = table(
        spark,
        "partition_stats",
        *[{"object_id": 1, "index_id": 2, "partition_number": p, "used_page_count": 3, "row_count": r} for p, r in
          ((1, 400), (2, 600))],
    )
    inc = table(spark, "incremental_props", {"object_id": 1, "stats_id": 2, "partition_number": 2, "rows": 0})
    props = table(
        spark,
        "stats_props",
        {"object_id": 1, "stats_id": 2, "rows": 500, "rows_sampled": 250, "modification_counter": 50},
    )

    def report(**options):
        return statistics.statistics_staleness(objects, schemas, stats, part_stats, inc, props, **options).collect()

    whole, part = report()
    assert (whole.partition_number, whole.autostat_target_modifications, whole.pages) == (None, 1000.0, 6)
    assert (whole.pct_change, whole.used_sample_rate, whole.current_rows) == (10.0, 50.0, 1000)
    assert (part.partition_number, part.pages, part.current_rows, part.pct_change) == (2, 3, 600, None)
    assert report(table="x") == [] and report(schema="x") == [] and len(report(schema="main", table="t")) == 2


# memory and processor


@pytest.mark.parametrize("mb, baseline", [(4095, 300), (4096, 300), (9000, 600)])
def test_page_life_baseline(spark, mb, baseline):
    counters = table(
        spark,
        "counters",
        {"object_name": "S:Memory Node", "counter_name": "Database Node Memory (KB) ".strip(), "instance_name": "0", "cntr_value": mb * 1024},
        {"object_name": "S:Buffer Node", "counter_name": "Page life expectancy", "instance_name": "0", "cntr_value": 10},
        {"object_name": "S:Buffer Node", "counter_name": "Page life expectancy", "instance_name": "1", "cntr_value": 10},
    )
    row = memory.page_life(counters).collect()
    assert [(r.buffer_size_mb, r.baseline_ple, r.mb_per_s, r.numa_node) for r in row] == [(mb, baseline, mb / 10, "0")]


def test_buffer_classes(spark):
    buffers = table(spark, "buffers", *[{"database_id": d, "is_modified": m} for d, m in ((1, True), (1, True), (2, False), (32767, True))])
    databases = table(spark, "databases", {"database_id": 1, "name": "a"})
    result = {r.database_name: r for r in memory.buffer_usage(buffers, databases).collect()}
    assert result["a"].clean_memory_mb is None and result["a"].dirty_memory_mb == result["a"].total_memory_mb == 2 / 128
    assert result[None].dirty_memory_mb is None and "MSResource" in result


def test_memory_breakdown_keeps_the_largest_caches(spark):
    caches = table(spark, "cache_counters", *[{"name": f"c{i:02}" * 60, "type": "t", "pages_kb": 1024 * i} for i in range(30)])
    buffers = table(spark, "buffers", {"database_id": 5, "is_modified": True})
    config = table(spark, "configurations", {"name": "max server memory (MB)", "value_in_use": 100.0}, {"name": "x", "value_in_use": 1.0})
    result = memory.memory_breakdown(caches, buffers, config, table(spark, "databases")).collect()
    assert [r.cache_size_mb for r in result[:20]] == [float(i) for i in range(29, 9, -1)]
    assert (result[20].name, result[20].type, result[20].cache_size_mb) == ("MS_Resource", "DATABASE_BUFFER", 1 / 128)
    assert result[0].pct_server_memory == 29.0 and len(result[0].name) == 128 and len(result) == 21


def test_memory_grants(spark):
    ask = {"request_id": 0, "request_time": ts("2024-01-01T00:00:00"), "plan_handle": "p"}
    result = memory.memory_grants(
        table(spark, "memory_grants", {"session_id": 1, **ask}, {"session_id": 2, **ask, "grant_time": ts("2024-01-01T00:00:01")}, {"session_id": 3, **ask}),
        table(spark, "requests", *[{"session_id": i, "request_id": 0} for i in (1, 2, 3)]),
        table(spark, "sessions", {"session_id": 1, "host_name": "", "login_name": "", "original_login_name": "o"},
              {"session_id": 2, "host_name": "h", "login_name": "l"}, {"session_id": 3}),
        table(spark, "connections", *[{"most_recent_session_id": i, "client_net_address": "c"} for i in (1, 2, 3)]),
        table(spark, "input_buffers", *[{"session_id": i, "request_id": 0, "event_info": "e"} for i in (1, 2, 3)]),
        table(spark, "query_plans", {"plan_handle": "p", "query_plan": "<p/>"}),
        table(spark, "databases"),
        as_of="2024-01-01 00:01:05.250",
        exclude_session=3,
    ).collect()
    assert [(r.session_id, r.host_name, r.login_name, r.pending_grant_duration) for r in result] == [
        (1, "c", "o", "000 00:01:05.250"),
        (2, "h", "l", None),
    ]


def test_thread_totals_and_schedulers(spark):
    totals = cpu.thread_totals(
        table(spark, "sys_info", {"max_workers_count": 512}),
        table(spark, "threads", {}, {}, {}),
        table(spark, "workers", {}, {}),
    ).first()
    assert (totals.max_workers_count, totals.total_worker_threads, totals.total_threads_used) == (512, 2, 3)
    schedulers = table(spark, "schedulers", {"scheduler_id": 2, "status": "VISIBLE ONLINE", "current_workers_count": 4},
                       {"scheduler_id": 1, "status": "VISIBLE ONLINE", "current_workers_count": 5},
                       {"scheduler_id": 3, "status": "HIDDEN ONLINE", "current_workers_count": 9})
    assert cpu.scheduler_totals(schedulers).first().current_workers_count == 9
    assert [r.scheduler_id for r in cpu.scheduler_detail(schedulers).collect()] == [1, 2]


# events


def document(name, at, body=""):
    time = datetime.fromisoformat(at.rstrip("Z"))
    return {"object_name": name, "event_data": f'<event name="{name}" timestamp="{at}">{body}</event>', "event_time": time}


@pytest.mark.parametrize("typed", [True, False])
def test_deadlocks(spark, typed):
    """With a column of times, and with times that are only in the documents."""
    report = '<data name="xml_report"><value>{}</value></data>'
    raw = table(
        spark,
        "raw_events",
        document("xml_deadlock_report", "2024-01-07T11:00:00Z", report.format('<deadlock id="d1"><victim/></deadlock><deadlock id="d2"/>')),
        document("xml_deadlock_report", "2024-01-01T23:59:59Z", report.format("")),
        document("other", "2024-01-07T11:00:00Z", report.format("<deadlock/>")),
    )
    raw = raw if typed else raw.drop("event_time")
    graphs = events.deadlock_graphs(raw, utc_offset=60).collect()
    assert [r.deadlock_graph_xml for r in graphs] == ['<deadlock id="d1"><victim/></deadlock>', '<deadlock id="d2"/>']
    assert graphs[0].server_time == datetime(2024, 1, 7, 12)
    heat = events.event_heatmap(raw, as_of="2024-01-07 15:00:00").collect()
    assert [tuple(r) for r in heat] == [(1, "Sunday", 1, 11)]
    assert events.event_heatmap(raw, as_of="2024-01-07 15:00:00", days_back=6).count() == 2
    last = events.last_event(raw, as_of="2024-01-07 15:00:00").collect()
    assert [tuple(r) for r in last] == [(datetime(2024, 1, 7, 11), datetime(2024, 1, 7, 15))]
    assert events.last_event(raw, event="none").count() == 0


def test_graphs_are_values_of_data_items(spark):
    body = '<data name="r"><value><deadlock id="a>b"/></value></data><note><deadlock id="n"/></note>'
    raw = table(spark, "raw_events", document("xml_deadlock_report", "2024-01-07T11:00:00Z", body))
    assert [r.deadlock_graph_xml for r in events.deadlock_graphs(raw).collect()] == ['<deadlock id="a>b"/>']


def test_raw_events_are_stored_with_their_time(spark, tmp_path):
    raw = table(spark, "raw_events", document("e", "2024-01-07T11:00:00Z"), document("e", "2024-01-08T11:00:00Z"))
    save_raw_events(raw.drop("event_time"), str(tmp_path / "raw"))
    back = read_raw_events(spark, str(tmp_path / "raw"), "e")
    assert sorted(r.event_time for r in back.collect()) == [datetime(2024, 1, 7, 11), datetime(2024, 1, 8, 11)]
    assert back.columns == [*raw.columns, "graph_count"]
    raw.select("object_name", "event_data").write.parquet(str(tmp_path / "old"))
    old = read_raw_events(spark, str(tmp_path / "old"))
    assert old.columns == ["object_name", "event_data"]
    assert events.last_event(old, event="e").first().last_event_utc == datetime(2024, 1, 8, 11)


def test_options_that_are_switches_take_bools_only(spark):
    with pytest.raises(ValueError):
        flag_in("is_ms_shipped", "false")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError):
            events.event_heatmap(table(spark, "raw_events"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_feature_counters(spark):
    counters = table(spark, "counters", *[{"object_name": o, "instance_name": i, "cntr_value": v} for o, i, v in
                                          (("S:Deprecated Features", "a", 1), ("S:Deprecated Features", "b", 7), ("S:Other", "c", 9))])
    assert [(r.deprecated_feature, r.use_count) for r in events.feature_counters(counters).collect()] == [("b", 7), ("a", 1)]


# files


def test_tables_keep_their_schema(spark, tmp_path):
    rows = table(spark, "databases", {"database_id": 1, "name": "a"})
    fleet = rows.withColumn("instance_id", F.lit("i")).withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    table_files.save(rows, str(tmp_path), "databases")
    table_files.save(fleet, f"{tmp_path}/fleet", "databases", ["instance_id"])
    assert table_files.load(spark, str(tmp_path), "databases").collect() == rows.collect()
    again = table_files.load(spark, f"{tmp_path}/fleet", "databases", fleet=True)
    assert set(again.columns) == {"instance_id", "captured_at", "database_id", "name"} and again.count() == 1
    assert all(schema(name).fieldNames() for name in TABLES)
