"""Session reports over the test data, with the equivalent SQL."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from gaugeworks.constants import DTC_STATES, ISOLATION_LEVELS, TRANSACTION_STATES
from gaugeworks.functions.scalars import boundary_diff, duration_text, unwrap_ms
from gaugeworks.operators import sessions
from gaugeworks.plans.relational import nest
from bindings.memory import duration
from bindings.tables import Bound

NAMED = tuple(range(1, 400))  # sessions that shall have their children as lists
SERVER = "server01"
WATCHED = "NATION_11"


def _tables(spark, sf_dir):
    b = Bound(spark, sf_dir)
    return sessions.SessionTables(**{f.name: getattr(b, f.name) for f in fields(sessions.SessionTables)})


def _as_text(column, names):
    """A list of structs as text, to compare it across engines."""
    entry = lambda e: F.concat_ws("|", *[e[n].cast("string") for n in names])
    return F.array_join(F.transform(column, entry), ";")


def _summary(spark, sf_dir):
    """The whole report, with the children of every session."""
    return _lists_as_text(sessions.session_summary(_tables(spark, sf_dir), server_name=SERVER, lists="structs"))


def _lists(spark, sf_dir):
    """Nested lists for the sessions that are named; the others have none."""
    tables = _tables(spark, sf_dir)
    return _lists_as_text(sessions.session_summary(tables, server_name=SERVER, lists="structs", list_sessions=NAMED))


def _places(spark, sf_dir):
    return sessions.session_children(_tables(spark, sf_dir), places=True).withColumns(
        {c: (F.col(c) * 128).cast("bigint") for c in sessions.SPACE_COLUMNS[1:]}
    )


def _lists_as_text(wide):
    return wide.withColumns(
        {
            "current_waits": _as_text(
                "current_waits", ("exec_context_id", "resource_description", "wait_duration_ms", "wait_type")
            ),
            "aggregate_waits": _as_text(
                "aggregate_waits",
                (
                    "wait_type",
                    "waiting_tasks_count",
                    "wait_time_ms",
                    "avg_wait_time_ms",
                    "max_wait_time_ms",
                    "signal_wait_time_ms",
                ),
            ),
            "tempdb_utilization": F.array_join(
                F.transform(
                    "tempdb_utilization",
                    lambda e: F.concat_ws(
                        "|",
                        e["exec_context_id"],
                        (e["tempdb_allocations"] * 128).cast("bigint"),
                        (e["tempdb_current_allocations"] * 128).cast("bigint"),
                    ),
                ),
                ";",
            ),
        }
    )


def _tasks(spark, sf_dir):
    return sessions.session_tasks(_tables(spark, sf_dir), server_name=SERVER)


def _blocking(spark, sf_dir):
    return sessions.blocking(_tables(spark, sf_dir), server_name=SERVER, watch_databases=[WATCHED])


def _children(spark, sf_dir):
    return sessions.session_children(_tables(spark, sf_dir)).withColumns(
        {c: (F.col(c) * 128).cast("bigint") for c in sessions.SPACE_COLUMNS[1:]}
    )


def _xml(spark, sf_dir):
    """How the waits of each session read as tagged text."""
    wide = sessions.session_summary(_tables(spark, sf_dir), server_name=SERVER, lists="xml")
    return wide.select("session_id", "current_waits", F.col("aggregate_waits").like("<waits><wait>%</wait></waits>").alias("wrapped")).distinct()


def _longest(spark, sf_dir):
    return sessions.longest_waits(Bound(spark, sf_dir).waiting_tasks)


def _nested(spark, sf_dir):
    waits = Bound(spark, sf_dir).waiting_tasks
    listed = nest(
        waits,
        ["session_id"],
        ["wait_type", "wait_duration_ms", "resource_description"],
        [-F.col("wait_duration_ms"), F.col("wait_type"), F.col("resource_description")],
        "waits",
    )
    return listed.select(
        "session_id", _as_text("waits", ("wait_type", "wait_duration_ms", "resource_description")).alias("waits")
    )


def _durations(spark, sf_dir):
    requests = Bound(spark, sf_dir).requests
    return requests.select(
        "session_id", "total_elapsed_time", duration_text(unwrap_ms("total_elapsed_time")).alias("duration")
    )


def _boundaries(spark, sf_dir):
    b = Bound(spark, sf_dir)
    days = b.lineitem.join(b.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("o_orderdate").alias("a"), F.col("l_shipdate").alias("b")
    )
    shifted = days.select(
        "l_orderkey",
        (F.col("a").cast("timestamp") + F.make_dt_interval(secs=F.col("l_partkey") * 1.7)).alias("a"),
        (F.col("b").cast("timestamp") + F.make_dt_interval(secs=F.col("l_suppkey") * 2.9)).alias("b"),
    )
    return shifted.select("l_orderkey", *[boundary_diff(u, "a", "b").alias(f"{u}s") for u in ("second", "minute", "hour")])


QUERIES = {
    "a08_session_summary": _summary,
    "a08_session_lists": _lists,
    "a08_children": _children,
    "a08_child_places": _places,
    "a08_xml": _xml,
    "a09_session_tasks": _tasks,
    "a10_blocking": _blocking,
    "w01_longest_wait": _longest,
    "g10_nest": _nested,
    "f01_duration_text": _durations,
    "f12_boundary_diff": _boundaries,
}


def _case(column: str, names: dict[int, str]) -> str:
    return f"case {column} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + " end"


_STATE = (
    f"coalesce(case when a.transaction_type = 4 then {_case('a.dtc_state', DTC_STATES)} "
    f"else {_case('a.transaction_state', TRANSACTION_STATES)} end, r.status)"
)
_ELAPSED = (
    "case when r.total_elapsed_time < 0 then 2147483647 + abs(-2147483647 - cast(r.total_elapsed_time as bigint)) "
    "else cast(r.total_elapsed_time as bigint) end"
)
_SLICE = (
    "coalesce(nullif(substring(x.text, cast(z.statement_start_offset // 2 + 1 as int), "
    "cast((case when z.statement_end_offset = -1 then 2 * length(x.text) else z.statement_end_offset end "
    "- z.statement_start_offset) // 2 + 1 as int)), ''), x.text)"
)
_VNN = """(select min(l.dns_name) from listener_ips ip join listeners l on l.listener_id = ip.listener_id
            where ip.ip_address = c.local_net_address)"""
_DNN = """(select min(l.dns_name) from listeners l
            where l.port = c.local_tcp_port and l.is_distributed_network_name)"""


def _decoded(transaction_key: str) -> str:
    return f"""
    select distinct s.session_id, s.is_user_process, r.session_id as request_session, r.request_id,
           {_STATE} as state, r.percent_complete, s.original_login_name as login,
           case when {_ELAPSED} <> 0 then {duration(_ELAPSED)} end as duration,
           case when r.estimated_completion_time > 0 then {duration('r.estimated_completion_time')} end
             as estimated_completion_duration,
           s.host_name, c.client_net_address, c.auth_scheme, c.encrypt_option, {_VNN} as vnn, {_DNN} as dnn,
           b.name as database, w.name as workload_group, coalesce(r.command, 'AWAITING COMMAND') as command_type,
           {_case('s.transaction_isolation_level', ISOLATION_LEVELS)} as transaction_isolation_level,
           a.name as transaction_name, coalesce(r.blocking_session_id, 0) as blocking_session,
           case when k.blocking_session_id is not null
                 and (r.blocking_session_id = 0 or r.session_id is null) then '1' end as head_blocker,
           coalesce(r.open_transaction_count, tr.open_transaction_count) as open_tran_count,
           s.cpu_time, r.cpu_time as current_cpu, s.reads, r.reads as current_reads, s.logical_reads,
           r.logical_reads as current_logical_reads, s.writes, r.writes as current_writes, r.plan_handle,
           coalesce(r.sql_handle, c.most_recent_sql_handle) as sql_handle,
           r.statement_start_offset, r.statement_end_offset
      from sessions s
      left join connections c on c.most_recent_session_id = s.session_id
      left join requests r on r.session_id = s.session_id
      left join (select distinct blocking_session_id from requests) k on k.blocking_session_id = s.session_id
      left join session_transactions tr on tr.session_id = {transaction_key}
      left join active_transactions a on a.transaction_id = tr.transaction_id
      left join workload_groups w on w.group_id = s.group_id
      left join databases b on b.database_id = s.database_id"""


_TEXTS = f"""
           case when z.command_type <> 'AWAITING COMMAND' then i.event_info end as submitted_batch, qp.query_plan,
           case when z.state is not null or z.open_tran_count <> 0 then
             case when {_SLICE} like 'FETCH API_CURSOR%' then
                    (select min(t.text) from sql_texts t
                      where t.sql_handle = (select min(u.sql_handle) from cursors u where u.session_id = z.session_id))
                  else {_SLICE} end end as executing_statement"""
_TEXT_JOINS = """
      left join query_plans qp on qp.plan_handle = z.plan_handle
      left join sql_texts x on x.sql_handle = z.sql_handle"""
_SHARED = """z.session_id, z.state, z.percent_complete, z.login, z.duration, z.estimated_completion_duration, z.host_name,
           z.client_net_address, z.auth_scheme, z.encrypt_option, z.database, z.workload_group, z.command_type,
           z.transaction_isolation_level, z.transaction_name, z.blocking_session, z.head_blocker, z.open_tran_count,
           z.cpu_time, z.current_cpu, z.reads, z.current_reads, z.logical_reads, z.current_logical_reads, z.writes,
           z.current_writes"""


def _task_sql(condition: str) -> str:
    return f"""
    with z as (select * from ({_decoded('s.session_id')}) where {condition}),
    ranked as (
      select *, row_number() over (partition by waiting_task_address
                                   order by wait_duration_ms desc, wait_type, resource_description) as rn
        from waiting_tasks)
    select distinct {_SHARED}, coalesce(z.vnn, '{SERVER}') as dns_name, v.wait_duration_ms as wait_time_ms,
           v.wait_type, v.resource_description as wait_resource, u.exec_context_id,
           (u.user_objects_alloc_page_count + u.internal_objects_alloc_page_count) / 128.0 as tempdb_allocations,
           (u.user_objects_alloc_page_count + u.internal_objects_alloc_page_count
            - u.user_objects_dealloc_page_count - u.internal_objects_dealloc_page_count) / 128.0
             as tempdb_current_allocations, {_TEXTS}
      from z
      left join tasks t on t.session_id = z.session_id and t.request_id = z.request_id
      left join task_space u on u.session_id = t.session_id and u.request_id = t.request_id
       and u.exec_context_id = t.exec_context_id
      left join ranked v on v.waiting_task_address = t.task_address and v.rn = 1
      join input_buffers i on i.session_id = z.session_id and i.request_id is not distinct from z.request_id
      {_TEXT_JOINS}"""


ORACLE = {
    "a08_session_summary": f"""
    with z as (select * from ({_decoded('r.session_id')}) where is_user_process),
    waits as (
      select session_id, string_agg(concat_ws('|', exec_context_id, resource_description, wait_duration_ms, wait_type),
               ';' order by exec_context_id, resource_description, wait_duration_ms, wait_type) as current_waits
        from waiting_tasks group by session_id),
    totals as (
      select session_id, string_agg(concat_ws('|', wait_type, waiting_tasks_count, wait_time_ms,
               case when waiting_tasks_count > 0 then cast(wait_time_ms / waiting_tasks_count as decimal(38,4))
                    else cast(0 as decimal(38,4)) end, max_wait_time_ms, signal_wait_time_ms),
               ';' order by waiting_tasks_count desc, wait_type) as aggregate_waits
        from session_waits group by session_id),
    space as (
      select session_id, request_id, string_agg(concat_ws('|', exec_context_id,
               user_objects_alloc_page_count + internal_objects_alloc_page_count,
               user_objects_alloc_page_count + internal_objects_alloc_page_count
               - user_objects_dealloc_page_count - internal_objects_dealloc_page_count),
               ';' order by exec_context_id) as tempdb_utilization
        from task_space group by session_id, request_id),
    thread_counts as (select session_id, request_id, count(exec_context_id) as n from tasks group by session_id, request_id)
    select {_SHARED}, g.grant_time as memory_grant_time, g.query_cost, g.dop,
           coalesce(z.vnn, z.dnn, '{SERVER}') as dns_name,
           case when z.vnn is not null then 'VNN' when z.dnn is not null then 'DNN' end as listener_type,
           case when z.request_session is not null then waits.current_waits end as current_waits,
           case when z.state is not null then totals.aggregate_waits end as aggregate_waits,
           space.tempdb_utilization, coalesce(h.n, 0) as active_threads, {_TEXTS}
      from z
      left join memory_grants g on g.session_id = z.request_session and g.request_id = z.request_id
      left join thread_counts h on h.session_id = z.request_session and h.request_id = z.request_id
      left join waits on waits.session_id = z.session_id
      left join totals on totals.session_id = z.session_id
      left join space on space.session_id = z.session_id and space.request_id = z.request_id
      left join input_buffers i on i.session_id = z.request_session and i.request_id = z.request_id
      {_TEXT_JOINS}""",
    "a08_children": """
    with people as (select session_id from sessions where is_user_process),
    labelled as (
      select session_id, 'current_wait' as kind, null as request_id, exec_context_id, resource_description,
             wait_duration_ms, wait_type, null as waiting_tasks_count, null as wait_time_ms,
             null as max_wait_time_ms, null as signal_wait_time_ms, null as allocated, null as freed
        from waiting_tasks
      union all
      select session_id, 'wait_total', null, null, null, null, wait_type, waiting_tasks_count, wait_time_ms,
             max_wait_time_ms, signal_wait_time_ms, null, null
        from session_waits
      union all
      select session_id, 'tempdb', request_id, exec_context_id, null, null, null, null, null, null, null,
             user_objects_alloc_page_count + internal_objects_alloc_page_count,
             user_objects_dealloc_page_count + internal_objects_dealloc_page_count
        from task_space)
    select l.* exclude (allocated, freed), l.allocated as tempdb_allocations,
           l.allocated - l.freed as tempdb_current_allocations,
           case when l.kind = 'wait_total' then cast(case when l.waiting_tasks_count > 0
             then l.wait_time_ms / l.waiting_tasks_count else 0 end as decimal(38,4)) end as avg_wait_time_ms
      from labelled l join people using (session_id)""",
    "a08_xml": """
    with listed_waits as (
      select session_id, string_agg('<thread><exec_context_id>' || exec_context_id || '</exec_context_id><resource_description>'
               || resource_description || '</resource_description><wait_duration_ms>' || wait_duration_ms
               || '</wait_duration_ms><wait_type>' || wait_type || '</wait_type></thread>', ''
               order by exec_context_id, resource_description, wait_duration_ms, wait_type) as current_waits
        from waiting_tasks group by session_id),
    session_states as (
      select distinct s.session_id, r.session_id is not null as asked,
             (r.status is not null or a.transaction_id is not null) as named
        from sessions s
        left join requests r on r.session_id = s.session_id
        left join session_transactions tr on tr.session_id = r.session_id
        left join active_transactions a on a.transaction_id = tr.transaction_id
       where s.is_user_process)
    select distinct st.session_id, case when st.asked then th.current_waits end as current_waits,
           case when st.named and w.session_id is not null then true end as wrapped
      from session_states st
      left join listed_waits th on th.session_id = st.session_id
      left join (select distinct session_id from session_waits) w on w.session_id = st.session_id""",
    "a09_session_tasks": _task_sql("is_user_process"),
    "a10_blocking": _task_sql(f"blocking_session <> 0 or head_blocker is not null or database = '{WATCHED}'"),
    "w01_longest_wait": """
    select waiting_task_address, session_id, exec_context_id, wait_duration_ms, wait_type, resource_description
      from (select *, row_number() over (partition by waiting_task_address
                     order by wait_duration_ms desc, wait_type, resource_description) as rn from waiting_tasks)
     where rn = 1""",
    "g10_nest": """
    select session_id, string_agg(concat_ws('|', wait_type, wait_duration_ms, resource_description), ';'
             order by wait_duration_ms desc, wait_type, resource_description) as waits
      from waiting_tasks group by session_id""",
    "f01_duration_text": f"""
    select r.session_id, r.total_elapsed_time, case when {_ELAPSED} <> 0 then {duration(_ELAPSED)} end as duration
      from requests r""",
    "f12_boundary_diff": """
    with shifted as (
      select l_orderkey, o_orderdate + to_microseconds(l_partkey * 1700000) as a,
             l_shipdate + to_microseconds(l_suppkey * 2900000) as b
        from lineitem join orders on o_orderkey = l_orderkey)
    select l_orderkey, date_diff('second', a, b) as seconds, date_diff('minute', a, b) as minutes,
           date_diff('hour', a, b) as hours
      from shifted""",
}

_LISTS = ("current_waits", "aggregate_waits", "tempdb_utilization")
_listed = ORACLE["a08_session_summary"]
ORACLE |= {
    "a08_session_lists": f"""
    select * exclude ({', '.join(_LISTS)}),
           {', '.join(f"case when session_id in ({', '.join(map(str, NAMED))}) then {c} end as {c}" for c in _LISTS)}
      from ({_listed})""",
    "a08_child_places": f"""
    select *, row_number() over (partition by session_id, kind order by waiting_tasks_count desc, request_id nulls first,
             exec_context_id nulls first, resource_description nulls first, wait_duration_ms nulls first, wait_type nulls first) as place
      from ({ORACLE["a08_children"]})""",
}
