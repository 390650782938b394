"""Schemas of the telemetry snapshot tables.

Every table may also carry the fleet columns in ``FLEET``; times are UTC instants.
"""

from __future__ import annotations

from pyspark.sql import types as T

from gaugeworks.constants import METRIC_SCALES

FLEET = "instance_id STRING, captured_at TIMESTAMP"

_METRICS = ", ".join(
    f"avg_{m} DOUBLE, min_{m} BIGINT, max_{m} BIGINT, stdev_{m} DOUBLE" for m in METRIC_SCALES
)
_LSNS = ", ".join(
    f"{name}_lsn DECIMAL(25,0)"
    for name in (
        "end_of_log",
        "last_commit",
        "last_hardened",
        "last_received",
        "last_redone",
        "last_sent",
        "recovery",
        "truncation",
    )
)
_TIMES = ", ".join(
    f"last_{name}_time TIMESTAMP" for name in ("commit", "hardened", "received", "redone", "sent")
)

TABLES = {
    # workload
    "runtime_stats": "plan_id BIGINT, execution_type INT, execution_type_desc STRING, count_executions BIGINT, "
    f"first_execution_time TIMESTAMP, last_execution_time TIMESTAMP, {_METRICS}",
    "plans": "plan_id BIGINT, query_id BIGINT, query_plan STRING",
    "queries": "query_id BIGINT, object_id BIGINT, query_text_id BIGINT",
    "texts": "query_text_id BIGINT, query_sql_text STRING",
    "capture_options": "actual_state INT",
    # sessions
    "sessions": "session_id INT, is_user_process BOOLEAN, login_name STRING, original_login_name STRING, "
    "host_name STRING, program_name STRING, database_id INT, group_id INT, transaction_isolation_level INT, "
    "cpu_time BIGINT, reads BIGINT, logical_reads BIGINT, writes BIGINT",
    "connections": "most_recent_session_id INT, client_net_address STRING, local_net_address STRING, "
    "local_tcp_port INT, auth_scheme STRING, encrypt_option STRING, most_recent_sql_handle STRING",
    "requests": "session_id INT, request_id INT, status STRING, command STRING, wait_type STRING, "
    "percent_complete DOUBLE, total_elapsed_time INT, estimated_completion_time BIGINT, blocking_session_id INT, "
    "open_transaction_count INT, cpu_time BIGINT, reads BIGINT, logical_reads BIGINT, writes BIGINT, "
    "database_id INT, plan_handle STRING, sql_handle STRING, statement_start_offset INT, statement_end_offset INT",
    "memory_grants": "session_id INT, request_id INT, request_time TIMESTAMP, grant_time TIMESTAMP, "
    "query_cost DOUBLE, dop INT, granted_memory_kb BIGINT, requested_memory_kb BIGINT, ideal_memory_kb BIGINT, "
    "used_memory_kb BIGINT, max_used_memory_kb BIGINT, plan_handle STRING",
    "session_transactions": "session_id INT, transaction_id BIGINT, open_transaction_count INT",
    "active_transactions": "transaction_id BIGINT, name STRING, transaction_type INT, transaction_state INT, "
    "dtc_state INT",
    "tasks": "task_address STRING, session_id INT, request_id INT, exec_context_id INT",
    "waiting_tasks": "waiting_task_address STRING, session_id INT, exec_context_id INT, wait_duration_ms BIGINT, "
    "wait_type STRING, resource_description STRING",
    "task_space": "session_id INT, request_id INT, exec_context_id INT, user_objects_alloc_page_count BIGINT, "
    "user_objects_dealloc_page_count BIGINT, internal_objects_alloc_page_count BIGINT, "
    "internal_objects_dealloc_page_count BIGINT",
    "session_waits": "session_id INT, wait_type STRING, waiting_tasks_count BIGINT, wait_time_ms BIGINT, "
    "max_wait_time_ms BIGINT, signal_wait_time_ms BIGINT",
    "workload_groups": "group_id INT, name STRING",
    "input_buffers": "session_id INT, request_id INT, event_info STRING",
    "sql_texts": "sql_handle STRING, text STRING",
    "query_plans": "plan_handle STRING, query_plan STRING",
    "cursors": "session_id INT, sql_handle STRING",
    "listeners": "listener_id STRING, group_id STRING, dns_name STRING, port INT, "
    "is_distributed_network_name BOOLEAN",
    "listener_ips": "listener_id STRING, ip_address STRING",
    "databases": "database_id INT, name STRING",
    # events
    "raw_events": "object_name STRING, event_data STRING, event_time TIMESTAMP",
    "stored_events": "object_name STRING, event_data STRING, event_time TIMESTAMP, graph_count INT",
    # replication
    "groups": "group_id STRING, name STRING",
    "group_states": "group_id STRING",
    "replicas": "replica_id STRING, group_id STRING, replica_server_name STRING, availability_mode INT, "
    "availability_mode_desc STRING, failover_mode_desc STRING, primary_role_allow_connections_desc STRING, "
    "secondary_role_allow_connections_desc STRING, seeding_mode_desc STRING, endpoint_url STRING",
    "replica_cluster_states": "replica_id STRING, group_id STRING, replica_server_name STRING",
    "replica_states": "replica_id STRING, role INT, role_desc STRING, is_local BOOLEAN",
    "db_cluster_states": "replica_id STRING, group_database_id STRING, database_name STRING, "
    "is_failover_ready BOOLEAN, is_database_joined BOOLEAN",
    "db_replica_states": "replica_id STRING, group_database_id STRING, database_id INT, "
    "is_primary_replica BOOLEAN, is_suspended BOOLEAN, suspend_reason INT, synchronization_state INT, "
    "redo_queue_size BIGINT, redo_rate BIGINT, log_send_queue_size BIGINT, log_send_rate BIGINT, "
    f"filestream_send_rate BIGINT, {_LSNS}, {_TIMES}",
    # storage and statistics
    "files": "type INT, size BIGINT",
    "objects": "object_id INT, schema_id INT, name STRING, type STRING, type_desc STRING, is_ms_shipped BOOLEAN",
    "schemas": "schema_id INT, name STRING",
    "tables": "object_id INT, schema_id INT, name STRING, is_ms_shipped BOOLEAN",
    "internal_tables": "object_id INT, parent_id INT, internal_type INT",
    "indexes": "object_id INT, index_id INT, name STRING, type INT, type_desc STRING",
    "partitions": "partition_id BIGINT, hobt_id BIGINT, object_id INT, index_id INT, partition_number INT",
    "allocation_units": "container_id BIGINT, type INT, type_desc STRING, total_pages BIGINT, used_pages BIGINT, "
    "data_pages BIGINT",
    "partition_stats": "object_id INT, index_id INT, partition_number INT, reserved_page_count BIGINT, "
    "used_page_count BIGINT, in_row_data_page_count BIGINT, lob_used_page_count BIGINT, "
    "row_overflow_used_page_count BIGINT, row_count BIGINT",
    "row_groups": "object_id INT, index_id INT, partition_number INT, row_group_id INT, state_description STRING, "
    "delta_store_hobt_id BIGINT, deleted_rows BIGINT, size_in_bytes BIGINT, total_rows BIGINT",
    "stats": "object_id INT, stats_id INT, name STRING, auto_created BOOLEAN, is_incremental BOOLEAN, "
    "has_filter BOOLEAN, no_recompute BOOLEAN, has_persisted_sample BOOLEAN",
    "stats_props": "object_id INT, stats_id INT, rows BIGINT, rows_sampled BIGINT, modification_counter BIGINT, "
    "last_updated TIMESTAMP, persisted_sample_percent DOUBLE",
    "incremental_props": "object_id INT, stats_id INT, partition_number INT, rows BIGINT, rows_sampled BIGINT, "
    "modification_counter BIGINT, last_updated TIMESTAMP",
    # memory and processor
    "cache_counters": "name STRING, type STRING, pages_kb BIGINT, entries_count BIGINT",
    "buffers": "database_id INT, is_modified BOOLEAN",
    "configurations": "name STRING, value_in_use DOUBLE",
    "counters": "object_name STRING, counter_name STRING, instance_name STRING, cntr_value BIGINT",
    "sys_info": "max_workers_count INT",
    "threads": "thread_address STRING",
    "workers": "worker_address STRING, scheduler_address STRING, state STRING, is_preemptive BOOLEAN, "
    "is_fiber BOOLEAN, is_sick BOOLEAN, is_in_cc_exception BOOLEAN, is_fatal_exception BOOLEAN, return_code INT",
    "schedulers": "scheduler_id INT, status STRING, cpu_id INT, is_online BOOLEAN, is_idle BOOLEAN, "
    "current_tasks_count INT, runnable_tasks_count INT, current_workers_count INT, active_workers_count INT, "
    "pending_disk_io_count INT, load_factor INT, work_queue_count BIGINT",
}


def schema(name: str, fleet: bool = False) -> T.StructType:
    """The schema of a table, with the fleet columns in front when ``fleet`` is set."""
    ddl = TABLES[name]
    return T.StructType.fromDDL(f"{FLEET}, {ddl}" if fleet else ddl)
