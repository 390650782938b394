"""Telemetry-shaped tables derived from the driver's test tables.

Each table is one SELECT in SQL that Spark and DuckDB both read, so the operator and its check see
the same rows. A SELECT may name test tables and tables defined above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.constants import METRIC_SCALES

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_EVENT_CODE = (
    "case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 "
    "when 'purchase' then 3 else 4 end"
)
_SLOT = "floor(extract(minute from ts) / 10)"
_CENTS = "cast(floor(value * 100 + 0.5) as bigint)"


def _metric(i: int, m: str) -> str:
    x = f"(({_CENTS} * {2 * i + 1}) % 7919 + {i})"
    return (
        f"cast(floor(sum({x}) / count(*)) as double) as avg_{m}, cast(min({x}) as bigint) as min_{m}, "
        f"cast(max({x}) as bigint) as max_{m}, cast(sum({x}) % 61 as double) as stdev_{m}"
    )


def _record(i: int, m: str) -> str:
    x = f"({_CENTS} * {i + 1})"
    return (
        f"cast({x} as double) as avg_{m}, {x} as min_{m}, {x} + event_id % 50 as max_{m}, "
        f"cast(event_id % {31 + i} as double) as stdev_{m}"
    )


_RECORD_METRICS = ", ".join(_record(i, m) for i, m in enumerate(METRIC_SCALES))
_METRICS = ", ".join(_metric(i, m) for i, m in enumerate(METRIC_SCALES))

SELECTS: dict[str, str] = {
    # workload
    "runtime_stats": f"""
        select user_id * 10 + {_EVENT_CODE} as plan_id,
               case when event_type = 'error' then 3 else 0 end as execution_type,
               case when event_type = 'error' then 'Aborted' else 'Regular' end as execution_type_desc,
               cast(count(*) + max(event_id) % 9 as bigint) as count_executions,
               cast(min(ts) as timestamp) as first_execution_time,
               cast(max(ts) as timestamp) as last_execution_time, {_METRICS}
          from events group by user_id, event_type, date_trunc('hour', ts), {_SLOT}""",
    "execution_records": f"""
        select user_id * 10 + {_EVENT_CODE} as plan_id,
               case when event_type = 'error' then 'Aborted' else 'Regular' end as execution_type_desc,
               cast(1 + event_id % 9 as bigint) as count_executions,
               cast(ts as timestamp) as last_execution_time,
               {_RECORD_METRICS}
          from events""",
    "plans": f"""
        select distinct user_id * 10 + {_EVENT_CODE} as plan_id, user_id as query_id,
               '<plan user="' || cast(user_id as string) || '" kind="' || event_type || '"/>' as query_plan
          from events""",
    "queries": """
        select distinct user_id as query_id, user_id % 40 as object_id, user_id + 100000 as query_text_id
          from events""",
    "texts": """
        select distinct user_id + 100000 as query_text_id,
               'select * from t where u = ' || cast(user_id as string) as query_sql_text
          from events""",
    "workload_objects": "select n_nationkey as object_id, n_name as name from nation",
    # sessions
    "sessions": """
        select o_orderkey as session_id, o_orderpriority <> '4-NOT SPECIFIED' as is_user_process,
               'login' || cast(o_custkey % 90 as string) as login_name,
               case when o_orderstatus = 'P' then 'owner' || cast(o_custkey % 30 as string)
                    else 'login' || cast(o_custkey % 90 as string) end as original_login_name,
               case when o_orderstatus = 'O' then '' else 'host' || cast(o_custkey % 70 as string) end as host_name,
               'app' || cast(o_custkey % 5 as string) as program_name,
               cast(o_custkey % 30 as int) as database_id, cast(o_custkey % 6 as int) as group_id,
               cast(o_orderkey % 7 as int) as transaction_isolation_level,
               cast(floor(o_totalprice) as bigint) as cpu_time, o_custkey * 3 as reads,
               o_custkey * 7 as logical_reads, o_orderkey % 1000 as writes
          from orders""",
    "connections": """
        select o_orderkey as most_recent_session_id,
               '192.168.0.' || cast(o_custkey % 250 as string) as client_net_address,
               '10.0.0.' || cast(o_custkey % 60 as string) as local_net_address,
               cast(1430 + o_custkey % 10 as int) as local_tcp_port,
               case when o_orderstatus = 'F' then 'NTLM' else 'KERBEROS' end as auth_scheme,
               case when o_orderstatus = 'O' then 'TRUE' else 'FALSE' end as encrypt_option,
               'h' || cast(o_custkey as string) as most_recent_sql_handle
          from orders where o_orderpriority <> '5-LOW'""",
    "requests": """
        select o_orderkey as session_id, cast(o_orderkey % 3 as int) as request_id,
               case when o_orderstatus = 'O' then 'running' else 'suspended' end as status,
               case when o_orderpriority = '1-URGENT' then 'DB MIRROR' else 'SELECT' end as command,
               case when o_orderstatus = 'P' then 'LCK_M_X' end as wait_type,
               cast(o_custkey % 100 as double) as percent_complete,
               cast((o_orderkey * 7919 + o_custkey * 104729) % 400000000 - 100000 as int) as total_elapsed_time,
               (o_orderkey * 31) % 100000000 - 500000 as estimated_completion_time,
               case when o_orderkey % 5 = 0 and o_orderkey > 0 then o_orderkey - 1 else 0 end as blocking_session_id,
               case when o_orderstatus = 'O' then cast(o_custkey % 3 as int) end as open_transaction_count,
               o_custkey * 2 as cpu_time, o_custkey as reads, o_custkey * 5 as logical_reads,
               o_orderkey % 100 as writes, cast(o_custkey % 30 as int) as database_id,
               'p' || cast(o_custkey % 150 as string) as plan_handle,
               case when o_orderstatus = 'O' then 'h' || cast(o_custkey as string) end as sql_handle,
               cast(2 * (o_custkey % 4) as int) as statement_start_offset,
               cast(case when o_custkey % 4 = 1 then -1 else 20 + 2 * (o_custkey % 9) end as int) as statement_end_offset
          from orders where o_orderstatus <> 'F'""",
    "memory_grants": """
        select o_orderkey as session_id, cast(o_orderkey % 3 as int) as request_id,
               cast(o_orderdate as timestamp) as request_time,
               case when o_orderstatus = 'O' then cast(o_orderdate as timestamp) end as grant_time,
               cast(o_custkey % 50 as double) as query_cost, cast(o_custkey % 8 + 1 as int) as dop,
               o_custkey * 4 as granted_memory_kb, o_custkey * 8 as requested_memory_kb,
               o_custkey * 16 as ideal_memory_kb, o_custkey * 3 as used_memory_kb,
               o_custkey * 4 as max_used_memory_kb, 'p' || cast(o_custkey % 150 as string) as plan_handle
          from orders where o_orderstatus <> 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "session_transactions": """
        select o_orderkey as session_id, o_orderkey * 10 as transaction_id,
               cast(o_custkey % 2 as int) as open_transaction_count
          from orders where o_totalprice > 200000""",
    "active_transactions": """
        select o_orderkey * 10 as transaction_id, 'tran' || cast(o_custkey % 11 as string) as name,
               cast(o_custkey % 5 as int) as transaction_type, cast(o_custkey % 10 as int) as transaction_state,
               cast(o_custkey % 7 as int) as dtc_state
          from orders where o_totalprice > 250000""",
    "tasks": """
        select cast(l_orderkey * 10 + l_linenumber as string) as task_address, l_orderkey as session_id,
               case when l_linenumber < 5 then cast(l_orderkey % 3 as int) end as request_id,
               l_linenumber as exec_context_id
          from lineitem group by l_orderkey, l_linenumber""",
    "waiting_tasks": """
        select cast(l_orderkey * 10 + l_linenumber as string) as waiting_task_address, l_orderkey as session_id,
               l_linenumber as exec_context_id, cast(floor(l_extendedprice) as bigint) as wait_duration_ms,
               'W' || l_returnflag || l_linestatus as wait_type,
               'key ' || cast(l_partkey as string) || ':' || cast(l_suppkey as string) || ':'
                 || cast(cast(floor(l_quantity) as bigint) as string) as resource_description
          from lineitem""",
    "task_space": """
        select l_orderkey as session_id, cast(l_orderkey % 3 as int) as request_id, l_linenumber as exec_context_id,
               cast(sum(floor(l_quantity)) as bigint) as user_objects_alloc_page_count,
               cast(count(*) as bigint) as user_objects_dealloc_page_count,
               cast(sum(l_partkey) as bigint) as internal_objects_alloc_page_count,
               cast(sum(l_suppkey) as bigint) as internal_objects_dealloc_page_count
          from lineitem where l_linestatus = 'O' group by l_orderkey, l_linenumber""",
    "session_waits": """
        select l_orderkey as session_id, 'W' || l_returnflag || l_linestatus as wait_type,
               cast(sum(case when l_discount > 0.02 then 1 else 0 end) as bigint) as waiting_tasks_count,
               cast(sum(floor(l_extendedprice)) as bigint) as wait_time_ms,
               cast(max(floor(l_extendedprice)) as bigint) as max_wait_time_ms,
               cast(min(floor(l_quantity)) as bigint) as signal_wait_time_ms
          from lineitem group by l_orderkey, l_returnflag, l_linestatus""",
    "workload_groups": "select r_regionkey as group_id, r_name as name from region",
    "input_buffers": """
        select o_orderkey as session_id,
               case when o_orderstatus <> 'F' then cast(o_orderkey % 3 as int) end as request_id,
               'batch of ' || o_orderpriority || ' for ' || cast(o_custkey as string) as event_info
          from orders where o_totalprice > 2000""",
    "sql_texts": """
        select 'h' || cast(c_custkey as string) as sql_handle,
               case when c_mktsegment = 'BUILDING' then 'x; FETCH API_CURSOR0000' || cast(c_custkey as string)
                    else 'select * from ' || c_name || ' where segment = ' || c_mktsegment end as text
          from customer
        union all
        select 'c' || cast(s_suppkey as string) as sql_handle, 'declare cursor for ' || s_name as text
          from supplier""",
    "query_plans": """
        select 'p' || cast(s_suppkey as string) as plan_handle, '<plan name="' || s_name || '"/>' as query_plan
          from supplier""",
    "cursors": """
        select o_orderkey as session_id, 'c' || cast(o_custkey % 100 as string) as sql_handle
          from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM')""",
    "listeners": """
        select 'l' || cast(n_nationkey as string) as listener_id, 'g' || cast(n_nationkey as string) as group_id,
               'dns-' || n_name as dns_name, cast(1430 + n_nationkey % 20 as int) as port,
               n_regionkey = 2 as is_distributed_network_name
          from nation""",
    "listener_ips": """
        select 'l' || cast(n_nationkey as string) as listener_id,
               '10.0.0.' || cast(n_nationkey as string) as ip_address
          from nation""",
    "databases": "select n_nationkey as database_id, n_name as name from nation",
    # events
    "raw_events": f"""
        select case when event_type = 'error' then 'xml_deadlock_report' else 'deprecation_announcement' end
                 as object_name,
               '<event name="'
                 || case when event_type = 'error' then 'xml_deadlock_report' else 'deprecation_announcement' end
                 || '" timestamp="' || cast(cast(ts as date) as string) || 'T'
                 || lpad(cast(extract(hour from ts) as string), 2, '0') || ':'
                 || lpad(cast(extract(minute from ts) as string), 2, '0') || ':'
                 || lpad(cast(cast(floor(extract(second from ts)) as int) as string), 2, '0') || 'Z">'
                 || case when event_type <> 'error' then
                      '<data name="feature"><value>' || event_type || '</value></data>'
                      || '<data name="message"><value>' || props || '</value></data>'
                      || '<action name="database_id"><value>' || cast(user_id % 30 as string) || '</value></action>'
                      || '<action name="session_id"><value>' || cast(event_id as string) || '</value></action>'
                      || '<action name="client_app_name"><value>app &lt;' || event_type || '&gt;</value></action>'
                      || '<action name="client_hostname"><value>host' || cast(user_id as string) || '</value></action>'
                      || '<action name="sql_text"><value>select ' || cast(event_id as string) || '</value></action>'
                    else
                      '<data name="xml_report"><value>'
                      || case when user_id % 3 > 0 then
                           '<deadlock id="d>' || cast(event_id as string) || '"><victim/></deadlock>' else '' end
                      || case when user_id % 3 = 2 then
                           '<deadlock id="e' || cast(event_id as string) || '"/>' else '' end
                      || '<deadlock-list/></value></data><data name="note"><text><deadlock id="n>'
                      || cast(event_id as string) || '"/></text></data>'
                    end
                 || '</event>' as event_data,
               cast(date_trunc('second', ts) as timestamp) as event_time
          from events""",
    # replication
    "groups": "select 'g' || cast(n_nationkey as string) as group_id, 'AG ' || n_name as name from nation",
    "group_states": "select 'g' || cast(n_nationkey as string) as group_id from nation",
    "replicas": """
        select 'r' || cast(c_custkey as string) as replica_id, 'g' || cast(c_nationkey as string) as group_id,
               c_name as replica_server_name, cast(c_custkey % 5 as int) as availability_mode,
               case when c_custkey % 2 = 0 then 'SYNCHRONOUS_COMMIT' else 'ASYNCHRONOUS_COMMIT' end
                 as availability_mode_desc,
               case when c_custkey % 2 = 0 then 'AUTOMATIC' else 'MANUAL' end as failover_mode_desc,
               'ALL' as primary_role_allow_connections_desc, 'READ_ONLY' as secondary_role_allow_connections_desc,
               c_mktsegment as seeding_mode_desc, 'tcp://' || c_name || ':5022' as endpoint_url
          from customer""",
    "replica_cluster_states": """
        select 'r' || cast(c_custkey as string) as replica_id, 'g' || cast(c_nationkey as string) as group_id,
               c_name as replica_server_name
          from customer""",
    "replica_states": """
        select 'r' || cast(c.c_custkey as string) as replica_id,
               case when c.c_custkey = f.lowest then 1 else 2 end as role,
               case when c.c_custkey = f.lowest then 'PRIMARY' else 'SECONDARY' end as role_desc,
               c.c_custkey = f.lowest as is_local
          from customer c
          join (select c_nationkey as nation, min(c_custkey) as lowest from customer group by c_nationkey) f
            on f.nation = c.c_nationkey""",
    "db_cluster_states": """
        select 'r' || cast(c_custkey as string) as replica_id, 'd' || cast(c_nationkey as string) as group_database_id,
               'db' || cast(c_nationkey as string) as database_name, c_custkey % 4 = 1 as is_failover_ready,
               case when c_custkey % 3 > 0 then true end as is_database_joined
          from customer""",
    "db_replica_states": """
        select 'r' || cast(c.c_custkey as string) as replica_id,
               'd' || cast(c.c_nationkey as string) as group_database_id,
               cast(c.c_nationkey as int) as database_id, c.c_custkey = f.lowest as is_primary_replica,
               c.c_acctbal < 0 as is_suspended,
               case when c.c_acctbal < 0 then cast(c.c_custkey % 6 as int) end as suspend_reason,
               cast(c.c_custkey % 4 as int) as synchronization_state,
               case when c.c_custkey % 6 = 0 then null else (c.c_custkey % 10) * 1000 end as redo_queue_size,
               case when c.c_custkey % 7 = 0 then null else (c.c_custkey % 8) * 4 end as redo_rate,
               case when c.c_custkey % 6 = 1 then null else c.c_custkey % 500 end as log_send_queue_size,
               case when c.c_custkey % 9 = 0 then null else (c.c_custkey % 4) * 8 end as log_send_rate,
               case when c.c_custkey % 2 = 0 then null else c.c_custkey end as filestream_send_rate,
               cast(c.c_custkey * 100 as decimal(25,0)) as end_of_log_lsn,
               cast(o.n as decimal(25,0)) as last_commit_lsn, cast(null as decimal(25,0)) as last_hardened_lsn,
               cast(c.c_custkey as decimal(25,0)) as last_received_lsn, cast(o.n as decimal(25,0)) as last_redone_lsn,
               cast(null as decimal(25,0)) as last_sent_lsn, cast(7 as decimal(25,0)) as recovery_lsn,
               cast(8 as decimal(25,0)) as truncation_lsn,
               cast(o.latest as timestamp) as last_commit_time, cast(o.earliest as timestamp) as last_hardened_time,
               cast(null as timestamp) as last_received_time, cast(o.latest as timestamp) as last_redone_time,
               cast(o.earliest as timestamp) as last_sent_time
          from customer c
          join (select c_nationkey as nation, min(c_custkey) as lowest from customer group by c_nationkey) f
            on f.nation = c.c_nationkey
          left join (select o_custkey, count(*) as n, max(o_orderdate) as latest, min(o_orderdate) as earliest
                       from orders group by o_custkey) o on o.o_custkey = c.c_custkey
         where c.c_mktsegment <> 'MACHINERY'""",
    # storage: a part is a table, its line items are pages
    "schemas": "select n_nationkey as schema_id, n_name as name from nation",
    "objects": """
        select p_partkey as object_id, cast(p_size % 28 as int) as schema_id,
               p_name || ' ]' || cast(p_partkey as string) as name,
               case when p_type = 'SMALL' then 'V' else 'U' end as type,
               case when p_type = 'SMALL' then 'VIEW' else 'USER_TABLE' end as type_desc,
               p_brand = 'Brand#1' as is_ms_shipped
          from part""",
    "tables": "select object_id, schema_id, name, is_ms_shipped from objects",
    "internal_tables": """
        select p_partkey as object_id, p_partkey + 1 as parent_id,
               case when p_size % 2 = 0 then 202 + p_size % 15 else 201 end as internal_type
          from part where p_brand = 'Brand#1'""",
    "indexes": """
        select p_partkey as object_id, cast(p_size % 2 as int) as index_id, 'pk_' || cast(p_partkey as string) as name,
               case when p_type = 'ECONOMY' then 5 else 1 end as type,
               case when p_type = 'ECONOMY' then 'CLUSTERED COLUMNSTORE' else 'CLUSTERED' end as type_desc
          from part
        union all
        select p_partkey as object_id, 2 as index_id, 'ix_' || cast(p_partkey as string) as name,
               case when p_type = 'STANDARD' then 6 else 2 end as type,
               case when p_type = 'STANDARD' then 'NONCLUSTERED COLUMNSTORE' else 'NONCLUSTERED' end as type_desc
          from part""",
    "partitions": """
        select distinct l_partkey * 100 + l_linenumber * 10 + i.index_id as partition_id,
               l_partkey * 100 + l_linenumber * 10 + i.index_id + 1000000000000 as hobt_id,
               l_partkey as object_id, i.index_id, l_linenumber as partition_number
          from lineitem join indexes i on i.object_id = l_partkey""",
    "row_groups": """
        select g.object_id, i.index_id, g.partition_number, g.row_group_id, g.state_description,
               case when g.state_description = 'OPEN' then g.object_id * 1000 + g.row_group_id + 5000000000000 end
                 as delta_store_hobt_id,
               g.deleted_rows, g.size_in_bytes, g.total_rows
          from (select l_partkey as object_id, l_linenumber as partition_number,
                       cast(l_suppkey % 10 + 10 * l_linenumber as int) as row_group_id,
                       case when max(extract(month from l_shipdate)) = 12 then 'OPEN' else 'COMPRESSED' end
                         as state_description,
                       cast(sum(case when l_quantity < 10 then 1 else 0 end) as bigint) as deleted_rows,
                       cast(sum(floor(l_extendedprice)) as bigint) as size_in_bytes,
                       cast(sum(case when l_quantity < 3 then 0 else 1 end) as bigint) as total_rows
                  from lineitem group by l_partkey, l_linenumber, l_suppkey % 10) g
          join indexes i on i.object_id = g.object_id
         where i.type in (5, 6)""",
    "allocation_units": """
        select case when a.type = 2 then a.partition_id else a.partition_id + 1000000000000 end as container_id,
               a.type, case a.type when 1 then 'IN_ROW_DATA' when 2 then 'LOB_DATA' else 'ROW_OVERFLOW_DATA' end
                 as type_desc,
               a.total_pages, a.used_pages, a.data_pages
          from (select l_partkey * 100 + l_linenumber * 10 + l_orderkey % 3 as partition_id,
                       cast(1 + l_orderkey % 3 as int) as type,
                       cast(sum(floor(l_quantity)) + count(*) as bigint) as total_pages,
                       cast(sum(floor(l_quantity)) as bigint) as used_pages,
                       cast(sum(floor(l_quantity / 2)) as bigint) as data_pages
                  from lineitem group by l_partkey, l_linenumber, l_orderkey % 3) a
        union all
        select delta_store_hobt_id as container_id, 1 as type, 'IN_ROW_DATA' as type_desc,
               total_rows * 3 as total_pages, total_rows * 2 as used_pages, total_rows as data_pages
          from row_groups where delta_store_hobt_id is not null""",
    "space_units": """
        select l_partkey * 100 + l_linenumber * 10 + l_orderkey % 3 as container_id,
               cast(1 + l_orderkey % 4 as int) as type, cast(floor(l_quantity) + 1 as bigint) as total_pages,
               cast(floor(l_quantity) as bigint) as used_pages, cast(floor(l_quantity / 2) as bigint) as data_pages
          from lineitem""",
    "files": """
        select cast(case when o_orderstatus = 'F' then 1 else 0 end as int) as type,
               cast(floor(o_totalprice / 100) as bigint) as size
          from orders""",
    "partition_stats": """
        select l_partkey as object_id, i.index_id, l_linenumber as partition_number,
               cast(sum(floor(l_quantity)) + 5 as bigint) as reserved_page_count,
               cast(sum(floor(l_quantity)) as bigint) as used_page_count,
               cast(sum(floor(l_quantity / 2)) as bigint) as in_row_data_page_count,
               cast(count(*) as bigint) as lob_used_page_count,
               cast(sum(case when l_linestatus = 'O' then 4 else 0 end) as bigint) as row_overflow_used_page_count,
               cast(sum(floor(l_extendedprice)) as bigint) as row_count
          from lineitem join indexes i on i.object_id = l_partkey
         group by l_partkey, i.index_id, l_linenumber""",
    # statistics
    "stats": """
        select p_partkey as object_id, 1 as stats_id, 'st_' || cast(p_partkey as string) as name,
               p_type = 'SMALL' as auto_created, p_size % 2 = 0 as is_incremental, p_size > 40 as has_filter,
               p_size < 5 as no_recompute, p_size = 7 as has_persisted_sample
          from part""",
    "stats_props": """
        select l_partkey as object_id, 1 as stats_id,
               case when l_partkey % 11 = 0 then null else cast(count(*) as bigint) end as rows,
               cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) as rows_sampled,
               cast(sum(floor(l_quantity)) as bigint) as modification_counter,
               cast(max(l_shipdate) as timestamp) as last_updated,
               cast(max(l_linenumber) as double) as persisted_sample_percent
          from lineitem group by l_partkey""",
    "incremental_props": """
        select l_partkey as object_id, 1 as stats_id, l_linenumber as partition_number,
               cast(count(*) - 1 as bigint) as rows,
               cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) as rows_sampled,
               cast(sum(floor(l_quantity)) as bigint) as modification_counter,
               cast(max(l_shipdate) as timestamp) as last_updated
          from lineitem group by l_partkey, l_linenumber""",
    # memory and processor
    "cache_counters": """
        select 'cache ' || p_name || cast(p_partkey as string) as name, p_type as type,
               cast(floor(p_retailprice * 7) as bigint) as pages_kb, cast(p_size as bigint) as entries_count
          from part""",
    "buffers": """
        select cast(case when l_suppkey = 31 then 32767 else l_suppkey % 40 end as int) as database_id,
               l_linestatus = 'O' as is_modified
          from lineitem""",
    "configurations": """
        select 'max server memory (MB)' as name, cast(count(*) as double) as value_in_use from orders
        union all
        select 'max degree of parallelism' as name, cast(8 as double) as value_in_use from region""",
    "counters": """
        select 'Deprecated Features' as object_name, 'Usage' as counter_name, p_name || cast(p_partkey as string)
                 as instance_name, cast(p_size as bigint) as cntr_value
          from part
        union all
        select 'Memory Node' as object_name, 'Database Node Memory (KB)' as counter_name,
               cast(c_custkey as string) as instance_name, cast(floor(c_acctbal * 2000) + 3000000 as bigint) as cntr_value
          from customer
        union all
        select 'Buffer Node' as object_name, 'Page life expectancy' as counter_name,
               cast(o_custkey as string) as instance_name, cast(count(*) - 5 as bigint) as cntr_value
          from orders group by o_custkey""",
    "sys_info": "select cast(count(*) as int) as max_workers_count from supplier",
    "threads": "select cast(l_orderkey as string) as thread_address from lineitem",
    "workers": """
        select cast(o_orderkey as string) as worker_address, cast(o_custkey % 64 as string) as scheduler_address,
               case when o_orderstatus = 'F' then 'SUSPENDED' else 'RUNNING' end as state,
               o_orderkey % 2 = 0 as is_preemptive, o_orderkey % 3 = 0 as is_fiber,
               o_orderkey % 5 = 0 as is_sick, o_orderkey % 7 = 0 as is_in_cc_exception,
               o_orderkey % 11 = 0 as is_fatal_exception, cast(o_custkey % 4 as int) as return_code
          from orders""",
    "schedulers": """
        select cast(c_custkey as int) as scheduler_id,
               case when c_mktsegment = 'MACHINERY' then 'VISIBLE OFFLINE' else 'VISIBLE ONLINE' end as status,
               cast(c_custkey % 128 as int) as cpu_id, c_mktsegment <> 'MACHINERY' as is_online,
               c_acctbal < 0 as is_idle, cast(c_nationkey as int) as current_tasks_count,
               cast(c_nationkey % 4 as int) as runnable_tasks_count, cast(c_custkey % 50 as int) as current_workers_count,
               cast(c_custkey % 40 as int) as active_workers_count, cast(c_custkey % 3 as int) as pending_disk_io_count,
               cast(c_custkey % 100 as int) as load_factor, c_custkey % 6 as work_queue_count
          from customer""",
}


def _names(sql: str) -> list[str]:
    return [name for name in SELECTS if re.search(rf"\b(?:from|join)\s+{name}\b", sql)]


def closure(names) -> list[str]:
    """The tables behind ``names``, each after the ones it is built from."""
    wanted: dict[str, None] = {}

    def add(name: str) -> None:
        for used in _names(SELECTS[name]):
            if used != name and used not in wanted:
                add(used)
        wanted[name] = None

    for name in names:
        add(name)
    return [name for name in SELECTS if name in wanted]


def with_tables(body: str) -> str:
    """``body`` as DuckDB SQL with a WITH clause for the derived tables it names."""
    ctes = ",\n".join(f"{name} as ({SELECTS[name]})" for name in closure(_names(body)))
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped.lower().startswith("with "):
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{body}"


class Bound:
    """Derived tables of one test-data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def replace(self, **tables: DataFrame) -> Bound:
        """The same tables built from other test tables."""
        other = Bound(self._spark, self._sf_dir)
        other._made.update(tables)
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in SELECTS and name not in TEST_TABLES:
            raise AttributeError(name)
        if name in self._made:
            return self._made[name]
        if name in TEST_TABLES:
            self._made[name] = self._spark.read.parquet(f"{self._sf_dir}/{name}.parquet")
        else:
            sql = SELECTS[name]
            tests = [t for t in TEST_TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
            used = tests + [t for t in _names(sql) if t != name]
            text = sql.replace("{", "{{").replace("}", "}}")
            for t in used:
                text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
            self._made[name] = self._spark.sql(text, **{t: getattr(self, t) for t in used})
        return self._made[name]
