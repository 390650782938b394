"""Session reports: consolidated, one row per task, and blocking.

Work on requests uses (session, request) and work on sessions uses (session) as the join key, so
each group of tables is shuffled once for its key. Tables with many rows per session are combined
or ranked before they meet the sessions, or stay rows of their own, and long texts are fetched last,
for the rows that are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import (
    CURSOR_FETCH_PATTERN,
    DISTRIBUTED_NETWORK_LISTENER,
    DISTRIBUTED_TRANSACTION_TYPE,
    DTC_STATES,
    IDLE_COMMAND,
    ISOLATION_LEVELS,
    TRANSACTION_STATES,
    VIRTUAL_NETWORK_LISTENER,
)
from gaugeworks.functions.scalars import (
    decode_enum,
    duration_text,
    pages_to_mb,
    statement_slice,
    unwrap_ms,
)
from gaugeworks.functions.xml import list_to_xml
from gaugeworks.plans.materialize import steps, unstore
from gaugeworks.plans.relational import (
    first_per,
    flag_parents,
    left_join_many,
    lookup,
    lookup_one,
    nest,
    numbered,
    report_order,
    union_all,
)


@dataclass(frozen=True)
class SessionTables:
    """The snapshot tables the session reports read."""

    sessions: DataFrame
    connections: DataFrame
    requests: DataFrame
    memory_grants: DataFrame
    session_transactions: DataFrame
    active_transactions: DataFrame
    tasks: DataFrame
    waiting_tasks: DataFrame
    task_space: DataFrame
    session_waits: DataFrame
    workload_groups: DataFrame
    input_buffers: DataFrame
    sql_texts: DataFrame
    query_plans: DataFrame
    cursors: DataFrame
    listeners: DataFrame
    listener_ips: DataFrame
    databases: DataFrame

    def of_sessions(self, ids: Sequence[int] | None) -> SessionTables:
        """The children of these sessions only, for nested lists; of all sessions where ``ids`` is None."""
        if ids is None:
            return self
        wanted = F.col("session_id").isin(*ids) if ids else F.lit(False)
        return replace(self, **{n: getattr(self, n).filter(wanted) for n in ("waiting_tasks", "task_space", "session_waits")})


COUNTERS = ("cpu_time", "reads", "logical_reads", "writes")
CURRENT = {c: "current_cpu" if c == "cpu_time" else f"current_{c}" for c in COUNTERS}

# columns of the reports, in order
WHO = (
    "host_name",
    "client_net_address",
    "auth_scheme",
    "encrypt_option",
    "dns_name",
)
WHAT = (
    "database",
    "workload_group",
    "command_type",
    "transaction_isolation_level",
    "transaction_name",
)
USE = tuple(c for name in COUNTERS for c in (name, CURRENT[name]))
SUMMARY_COLUMNS = (
    "session_id",
    "state",
    "percent_complete",
    "login",
    "memory_grant_time",
    "duration",
    "estimated_completion_duration",
    *WHO,
    "listener_type",
    *WHAT,
    "blocking_session",
    "active_threads",
    "dop",
    "head_blocker",
    "open_tran_count",
    *USE,
    "submitted_batch",
    "query_cost",
    "query_plan",
    "executing_statement",
)
TASK_COLUMNS = (
    "session_id",
    "state",
    "percent_complete",
    "login",
    "duration",
    "estimated_completion_duration",
    *WHO,
    *WHAT,
    "wait_time_ms",
    "wait_type",
    "wait_resource",
    "blocking_session",
    "head_blocker",
    "open_tran_count",
    "exec_context_id",
    *USE,
    "tempdb_allocations",
    "tempdb_current_allocations",
    "submitted_batch",
    "query_plan",
    "executing_statement",
)


def transaction_state(type_: Column, state: Column, dtc_state: Column) -> Column:
    """Name of a transaction's state; a distributed transaction has a state of its own."""
    distributed = F.coalesce(type_ == DISTRIBUTED_TRANSACTION_TYPE, F.lit(False))
    return F.when(distributed, decode_enum(dtc_state, DTC_STATES)).otherwise(
        decode_enum(state, TRANSACTION_STATES)
    )


def _requests(t: SessionTables, keys) -> DataFrame:
    return t.requests.select(
        *keys,
        "session_id",
        "request_id",
        F.lit(True).alias("has_request"),
        "status",
        "command",
        "percent_complete",
        unwrap_ms("total_elapsed_time").alias("elapsed_ms"),
        F.when(F.col("estimated_completion_time") > 0, F.col("estimated_completion_time")).alias("remaining_ms"),
        "blocking_session_id",
        F.col("open_transaction_count").alias("_request_open"),
        *[F.col(c).alias(CURRENT[c]) for c in COUNTERS],
        "plan_handle",
        F.col("sql_handle").alias("_request_handle"),
        "statement_start_offset",
        "statement_end_offset",
    )


def _transactions(t: SessionTables, keys) -> DataFrame:
    """Transactions of each session with their decoded state."""
    state = transaction_state(F.col("transaction_type"), F.col("transaction_state"), F.col("dtc_state"))
    return (
        lookup(t.session_transactions, t.active_transactions, [*keys, "transaction_id"])
        .select(
            *keys,
            "session_id",
            F.col("open_transaction_count").alias("_session_open"),
            state.alias("_transaction_state"),
            F.col("name").alias("transaction_name"),
        )
        .repartition(*keys, "session_id")  # also the key of the join that follows
        .distinct()
    )


def _connections(t: SessionTables, keys) -> DataFrame:
    """Connections of each session with the name and kind of the listener they came through, if any."""
    df = t.connections.select(
        *keys,
        F.col("most_recent_session_id").alias("session_id"),
        "client_net_address",
        "local_net_address",
        "local_tcp_port",
        "auth_scheme",
        "encrypt_option",
        F.col("most_recent_sql_handle").alias("_connection_handle"),
    )
    by_address = lookup(
        t.listener_ips, t.listeners.select(*keys, "listener_id", "dns_name"), [*keys, "listener_id"], "inner"
    ).select(*keys, F.col("ip_address").alias("local_net_address"), F.col("dns_name").alias("_by_address"))
    by_port = t.listeners.filter("is_distributed_network_name").select(
        *keys, F.col("port").alias("local_tcp_port"), F.col("dns_name").alias("_by_port")
    )
    df = lookup_one(df, by_address, [*keys, "local_net_address"], "_by_address")
    df = lookup_one(df, by_port, [*keys, "local_tcp_port"], "_by_port")
    listener_type = F.when(F.col("_by_address").isNotNull(), VIRTUAL_NETWORK_LISTENER).when(
        F.col("_by_port").isNotNull(), DISTRIBUTED_NETWORK_LISTENER
    )
    # connections that differ in address or port only are one row; by session, as they meet the sessions next
    return (
        df.withColumns({"dns_name": F.coalesce("_by_address", "_by_port"), "listener_type": listener_type})
        .withColumnRenamed("_by_address", "_address_name")
        .drop("_by_port", "local_net_address", "local_tcp_port")
        .repartition(*keys, "session_id")
        .distinct()
    )


def _sessions(
    t: SessionTables, requests: DataFrame, transactions: DataFrame, keys, only: Column | None = None
) -> DataFrame:
    """Sessions with their connection, requests, transactions and blocking role, decoded."""
    by_session = [*keys, "session_id"]
    people = t.sessions.select(
        *by_session,
        "is_user_process",
        F.col("original_login_name").alias("login"),  # equal to the login name unless that was changed
        "host_name",
        "database_id",
        "group_id",
        decode_enum("transaction_isolation_level", ISOLATION_LEVELS).alias("transaction_isolation_level"),
        *COUNTERS,
    )
    if only is not None:
        people = people.filter(only)
    # a session has few connections, requests and transactions, so plain joins on one key do
    rows = lookup(people, _connections(t, keys), by_session)
    rows = flag_parents(rows, t.requests, "session_id", "blocking_session_id", "_blocks", keys)
    rows = lookup(rows, requests, by_session)
    rows = lookup(rows, transactions, by_session)

    has_request = F.col("has_request").isNotNull()
    head = F.col("_blocks") & ((F.col("blocking_session_id") == 0) | ~has_request)
    rows = rows.withColumns(
        {
            "state": F.coalesce("_transaction_state", "status"),
            "duration": duration_text("elapsed_ms"),
            "estimated_completion_duration": duration_text("remaining_ms"),
            "command_type": F.coalesce("command", F.lit(IDLE_COMMAND)),
            "blocking_session": F.coalesce("blocking_session_id", F.lit(0)),
            "head_blocker": F.when(head, "1"),
            "open_tran_count": F.coalesce("_request_open", "_session_open"),
            "sql_handle": F.coalesce("_request_handle", "_connection_handle"),
        }
    )
    names = t.databases.select(*keys, "database_id", F.col("name").alias("database"))
    rows = lookup(rows, names, [*keys, "database_id"])
    return rows.drop(
        "_blocks",
        "blocking_session_id",
        "status",
        "command",
        "_transaction_state",
        "_request_open",
        "_session_open",
        "_request_handle",
        "_connection_handle",
        "remaining_ms",
    )


def _named(rows: DataFrame, t: SessionTables, server_name: str, keys) -> DataFrame:
    groups = t.workload_groups.select(*keys, "group_id", F.col("name").alias("workload_group"))
    rows = lookup(rows, groups, [*keys, "group_id"])
    own_name = {c: F.coalesce(c, F.lit(server_name)) for c in ("dns_name", "_address_name")}
    return rows.withColumns(own_name).drop("group_id", "database_id")


def _with_cursors(rows: DataFrame, t: SessionTables, keys) -> DataFrame:
    """The text of each session's cursor; rows are still by session here, and need not move for it."""
    cursors = t.cursors.groupBy(*keys, "session_id").agg(F.min("sql_handle").alias("sql_handle"))
    cursor_texts = lookup(
        cursors, t.sql_texts.select(*keys, "sql_handle", F.col("text").alias("_cursor_text")), [*keys, "sql_handle"], "inner"
    ).drop("sql_handle")
    return lookup(rows, cursor_texts, [*keys, "session_id"])


def _with_texts(rows: DataFrame, t: SessionTables, keys) -> DataFrame:
    """Submitted batch, plan and running statement.

    A statement that only fetches from a cursor is replaced by the cursor's own text.
    """
    wanted = F.col("state").isNotNull() | (F.col("open_tran_count") != 0)
    rows = rows.withColumn("sql_handle", F.when(wanted, F.col("sql_handle")))
    rows = lookup(rows, t.query_plans.select(*keys, "plan_handle", "query_plan"), [*keys, "plan_handle"])
    rows = lookup(rows, t.sql_texts.select(*keys, "sql_handle", "text"), [*keys, "sql_handle"])
    statement = statement_slice("text", "statement_start_offset", "statement_end_offset")
    fetches = F.coalesce(statement.like(CURSOR_FETCH_PATTERN), F.lit(False))
    return rows.withColumns(
        {
            "executing_statement": F.when(fetches, F.col("_cursor_text")).otherwise(statement),
            "submitted_batch": F.when(F.col("command_type") != IDLE_COMMAND, F.col("event_info")),
        }
    )


WAIT_COLUMNS = ("exec_context_id", "resource_description", "wait_duration_ms", "wait_type")
SPACE_COLUMNS = ("exec_context_id", "tempdb_allocations", "tempdb_current_allocations")
TOTAL_COLUMNS = (
    "wait_type",
    "waiting_tasks_count",
    "wait_time_ms",
    "avg_wait_time_ms",
    "max_wait_time_ms",
    "signal_wait_time_ms",
)


def _children(t: SessionTables, keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Waits, tempdb use and wait totals of sessions, one row each."""
    by_session = [*keys, "session_id"]
    allocated = F.col("user_objects_alloc_page_count") + F.col("internal_objects_alloc_page_count")
    freed = F.col("user_objects_dealloc_page_count") + F.col("internal_objects_dealloc_page_count")
    space = t.task_space.select(
        *by_session,
        "request_id",
        "exec_context_id",
        pages_to_mb(allocated).alias("tempdb_allocations"),
        pages_to_mb(allocated - freed).alias("tempdb_current_allocations"),
    )
    count, total = F.col("waiting_tasks_count"), F.col("wait_time_ms")
    average = F.try_divide(total.cast("decimal(20,1)"), count.cast("decimal(20,0)")).cast("decimal(38,4)")
    totals = t.session_waits.select(
        *by_session,
        "wait_type",
        "waiting_tasks_count",
        "wait_time_ms",
        F.when(count > 0, average).otherwise(F.lit(0).cast("decimal(38,4)")).alias("avg_wait_time_ms"),
        "max_wait_time_ms",
        "signal_wait_time_ms",
    )
    return t.waiting_tasks.select(*by_session, *WAIT_COLUMNS), space, totals


def session_children(t: SessionTables, *, keys=(), ordered: bool = True, places: bool = False) -> DataFrame:
    """The waits, tempdb use and wait totals that belong to the rows of ``session_summary``.

    One row per child, told apart by ``kind`` (current_wait, tempdb, wait_total); columns of other
    kinds are NULL. Tempdb use belongs to a request, the others to the session. Any number of
    children of one session is fine, as nothing is gathered: ``places`` adds each child's ``place`` among
    its session's children of its kind, counted over all rows where they lie and not per session.
    """
    waits, space, totals = _children(t, keys)
    people = t.sessions.filter("is_user_process").select(*keys, "session_id")
    kinds = [c.withColumn("kind", F.lit(k)) for c, k in ((waits, "current_wait"), (space, "tempdb"), (totals, "wait_total"))]
    # sessions are unique, so a child meets one at most
    rows = lookup(union_all(*kinds), people, [*keys, "session_id"], "left_semi")
    group = [*keys, "session_id", "kind"]
    order = [
        *group,
        F.desc("waiting_tasks_count"),
        "request_id",
        "exec_context_id",
        "resource_description",
        "wait_duration_ms",
        "wait_type",
    ]
    columns = ("session_id", "kind", "request_id", *WAIT_COLUMNS, *SPACE_COLUMNS[1:], *TOTAL_COLUMNS[1:])
    if places:
        # in steps, so that the shuffle files of one are gone when the next one starts
        step = steps(rows)
        single = step(rows.select(*keys, *columns), "children")
        counted = numbered(single.orderBy(*order))
        unstore(single, counted)
        starts = step(counted.groupBy(*group).agg(F.min("place").alias("_start")), "child-starts")
        rows = lookup(counted, starts, group, "inner").withColumn("place", F.col("place") - F.col("_start") + 1)
        columns = (*columns, "place")
        placed = step(rows.select(*keys, *columns), "child-places")
        unstore(counted, placed)
        unstore(starts, placed)
        rows = placed
    return report_order(rows, ordered, *order).select(*keys, *columns)


def _with_lists(rows: DataFrame, t: SessionTables, keys, as_xml: bool) -> DataFrame:
    """The children of each row as lists of structs or as XML fragments; NULL where there are none.

    All lists are made by session, the one key that rows and children move by; a row picks its request's
    tempdb use out of its session's.
    """
    by_session = [*keys, "session_id"]
    waits, space, totals = _children(t, keys)
    rows = lookup(rows, nest(waits, by_session, WAIT_COLUMNS, WAIT_COLUMNS, "_waits"), by_session)
    of_request = ("request_id", *SPACE_COLUMNS)
    rows = lookup(rows, nest(space, by_session, of_request, of_request, "_space"), by_session)
    most_first = [-F.col("waiting_tasks_count"), "wait_type"]
    rows = lookup(rows, nest(totals, by_session, TOTAL_COLUMNS, most_first, "_totals"), by_session)
    own = F.filter("_space", lambda e: e["request_id"] == F.col("request_id"))
    own = F.transform(own, lambda e: F.struct(*[e[c].alias(c) for c in SPACE_COLUMNS]))
    rows = rows.withColumn("tempdb_utilization", F.when(F.size(own) > 0, own)).drop("_space")
    lists = {
        "current_waits": (F.when(F.col("has_request"), F.col("_waits")), ("thread",)),
        "tempdb_utilization": (F.col("tempdb_utilization"), ("thread",)),
        "aggregate_waits": (F.when(F.col("state").isNotNull(), F.col("_totals")), ("wait", "waits")),
    }
    return rows.withColumns({name: list_to_xml(c, *tags) if as_xml else c for name, (c, tags) in lists.items()})


LIST_COLUMNS = ("current_waits", "aggregate_waits", "tempdb_utilization")


def session_summary(
    t: SessionTables,
    *,
    server_name: str,
    keys=(),
    lists: str | None = None,
    list_sessions: Sequence[int] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """One row per user session and request, always.

    Waits, tempdb use and wait totals are rows of ``session_children``. ``lists="structs"`` or
    ``lists="xml"`` adds them as nested columns as well. A nested value holds all children of its
    session, so name the sessions that shall have them (``list_sessions``); they are NULL for the others.
    Over large tables a report with lists is made in steps, each written before the next one, when this is called.
    """
    if lists not in (None, "structs", "xml"):
        raise ValueError(f"lists must be None, 'structs' or 'xml', not {lists!r}")
    by_session, by_request = [*keys, "session_id"], [*keys, "session_id", "request_id"]
    # sessions and requests are unique, and so is a row that none of these multiplies
    grants = t.memory_grants.select(
        *by_request, F.col("grant_time").alias("memory_grant_time"), "query_cost", "dop"
    ).repartition(*by_request).distinct()
    threads = t.tasks.groupBy(*by_request).agg(F.count("exec_context_id").alias("_threads"))
    requests = lookup(lookup(_requests(t, keys), grants, by_request), threads, by_request)
    requests = lookup(requests, t.input_buffers.select(*by_request, "event_info"), by_request)
    with_request = t.requests.select(*by_session).distinct()
    transactions = lookup(_transactions(t, keys), with_request, by_session, "left_semi")

    rows = _named(
        _sessions(t, requests, transactions, keys, F.col("is_user_process")), t, server_name, keys
    ).drop("_address_name")
    rows = rows.withColumn("active_threads", F.coalesce("_threads", F.lit(0))).drop("_threads")
    rows = _with_cursors(rows, t, keys)
    # texts come by keys of their own, so the lists wait until a row moves by its session for the last time
    order = [*keys, F.desc("elapsed_ms"), "session_id"]
    columns = [*keys, *SUMMARY_COLUMNS, *(LIST_COLUMNS if lists else ())]
    if not lists:
        return report_order(_with_texts(rows, t, keys), ordered, *order).select(*columns)
    t = t.of_sessions(list_sessions)
    step = steps(rows, t.waiting_tasks, t.task_space, t.session_waits)
    single = step(rows, "sessions")
    needed = list(dict.fromkeys([*keys, *SUMMARY_COLUMNS, "elapsed_ms", "request_id", "has_request"]))
    texted = step(_with_texts(single, t, keys).select(*needed), "session-texts")
    unstore(single, texted)
    rows = _with_lists(texted, t, keys, lists == "xml")
    rows = step(rows.select(*dict.fromkeys([*columns, "elapsed_ms"])), "session-lists")
    unstore(texted, rows)
    return report_order(rows, ordered, *order).select(*columns)


def longest_waits(waiting_tasks: DataFrame, keys=()) -> DataFrame:
    """The longest current wait of each task."""
    longest = [F.desc("wait_duration_ms"), F.asc("wait_type"), F.asc("resource_description")]
    return first_per(waiting_tasks, [*keys, "waiting_task_address"], longest)


def _task_rows(t: SessionTables, keys) -> DataFrame:
    """Tasks with their tempdb use and longest wait."""
    by_thread = [*keys, "session_id", "request_id", "exec_context_id"]
    allocated = F.col("user_objects_alloc_page_count") + F.col("internal_objects_alloc_page_count")
    freed = F.col("user_objects_dealloc_page_count") + F.col("internal_objects_dealloc_page_count")
    space = t.task_space.select(
        *by_thread,
        F.col("exec_context_id").alias("_space_context"),
        pages_to_mb(allocated).alias("tempdb_allocations"),
        pages_to_mb(allocated - freed).alias("tempdb_current_allocations"),
    )
    waits = longest_waits(t.waiting_tasks, keys).select(
        *keys,
        F.col("waiting_task_address").alias("task_address"),
        F.col("wait_duration_ms").alias("wait_time_ms"),
        "wait_type",
        F.col("resource_description").alias("wait_resource"),
    )
    tasks = lookup(t.tasks.select("task_address", *by_thread), space, by_thread)
    return (
        lookup(tasks, waits, [*keys, "task_address"])
        .select(
            *keys,
            "session_id",
            "request_id",
            F.col("_space_context").alias("exec_context_id"),
            "tempdb_allocations",
            "tempdb_current_allocations",
            "wait_time_ms",
            "wait_type",
            "wait_resource",
        )
        .distinct()
    )


def _tasks_of(rows: DataFrame, t: SessionTables, server_name: str, keys) -> DataFrame:
    """Rows of the task reports for the sessions that are left; a session without input text drops out.

    Over large tables sessions, their texts, tasks and the join are written one after the other, when this is
    called, and each frees the shuffle files it took.
    """
    rows = _with_cursors(_named(rows, t, server_name, keys), t, keys).withColumn("dns_name", F.col("_address_name"))
    rows = rows.drop("_address_name", "listener_type")
    # an idle session has no request, and neither has its last input
    request = F.coalesce("request_id", F.lit(-1)).alias("_request")
    by_session, by_request = [*keys, "session_id"], [*keys, "session_id", "_request"]
    inputs = t.input_buffers.select(*by_session, request, "event_info")
    rows = lookup(rows.select("*", request), inputs, by_request, "inner").drop("request_id")
    step = steps(rows, t.tasks, t.task_space, t.waiting_tasks)
    single = step(rows, "sessions")
    # texts belong to a session's row, so they come ahead of its tasks, by which it multiplies
    texted = _with_texts(single, t, keys)
    needed = list(dict.fromkeys([*keys, *TASK_COLUMNS, "_request", "elapsed_ms"]))
    texted = step(texted.select(*[c for c in needed if c in texted.columns]), "session-texts")
    unstore(single, texted)
    # a task without a request belongs to no request, and not to the idle session either
    tasks = _task_rows(t, keys).filter("request_id IS NOT NULL").withColumnRenamed("request_id", "_request")
    held = step(tasks, "session-tasks")
    if held is tasks:
        # every request, and every session as if it were idle
        parents = t.requests.select(*by_session, "request_id").unionByName(
            t.sessions.select(*by_session, F.lit(None).cast("int").alias("request_id"))
        )
        with_tasks = t.tasks.filter("request_id IS NOT NULL").withColumnRenamed("request_id", "_request")
        joined = left_join_many(texted, tasks, by_request, parents.select(*by_session, request), with_tasks)
    else:
        joined = left_join_many(texted, held, by_request)
    joined = joined.select(*needed)
    result = step(joined, "session-rows")
    unstore(texted, result)
    unstore(held, result)
    return result


def session_tasks(t: SessionTables, *, server_name: str, keys=(), ordered: bool = True) -> DataFrame:
    """One row per task of every user session."""
    rows = _sessions(t, _requests(t, keys), _transactions(t, keys), keys, F.col("is_user_process"))
    rows = _tasks_of(rows, t, server_name, keys)
    rows = report_order(rows, ordered, *keys, F.desc("elapsed_ms"), "session_id", "exec_context_id")
    return rows.select(*keys, *TASK_COLUMNS)


def blocking(
    t: SessionTables, *, server_name: str, watch_databases=(), keys=(), ordered: bool = True
) -> DataFrame:
    """One row per task of the sessions that are blocked, head a chain, or use a watched database.

    Sessions are filtered before any task, wait or text is joined.
    """
    rows = _sessions(t, _requests(t, keys), _transactions(t, keys), keys)
    involved = (F.col("blocking_session") != 0) | F.col("head_blocker").isNotNull()
    if watch_databases:
        involved = involved | F.coalesce(F.col("database").isin(*watch_databases), F.lit(False))
    rows = _tasks_of(rows.filter(involved), t, server_name, keys)
    rows = report_order(
        rows, ordered, *keys, F.desc("head_blocker"), "blocking_session", "session_id", "exec_context_id"
    )
    return rows.select(*keys, *TASK_COLUMNS)
