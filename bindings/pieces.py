"""The reusable operators and functions on their own, over the test data, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.constants import ISOLATION_LEVELS
from gaugeworks.functions import predicates as P
from gaugeworks.functions import scalars as S
from gaugeworks.functions.xml import event_struct
from gaugeworks.operators.events import flat_columns
from gaugeworks.plans import relational as R
from gaugeworks.plans.materialize import new_folder
from gaugeworks.sources.event_files import read_events, write_events
from bindings.events import ORACLE as EVENT_SQL
from bindings.memory import duration
from bindings.tables import Bound

QUERIES = {}
ORACLE = {}


def piece(name: str, sql: str):
    """Register a function of the derived tables under a name, with its SQL."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(Bound(spark, sf_dir))
        ORACLE[name] = sql
        return function

    return add


@piece(
    "p01_optional_filters",
    """select database_id, count(case when host_name is not null then 1 end) as any_host,
              count(case when host_name = '' then 1 end) as no_host,
              count(case when not is_user_process then 1 end) as system,
              count(case when is_user_process is not null then 1 end) as everyone
         from sessions group by database_id""",
)
def _optional(b):
    return b.sessions.groupBy("database_id").agg(
        F.count_if(P.optional_eq("host_name", None)).alias("any_host"),
        F.count_if(P.optional_eq("host_name", "")).alias("no_host"),
        F.count_if(P.flag_in("is_user_process", False)).alias("system"),
        F.count_if(P.flag_in("is_user_process", True)).alias("everyone"),
    )


@piece(
    "p09_since",
    """select event_type, count(*) as events,
              count(case when ts >= timestamp '2024-01-20 00:00:00' then 1 end) as recent
         from events group by event_type""",
)
def _since(b):
    recent = P.since(F.col("ts").cast("timestamp"), "2024-01-25 13:30:00", 5)
    return b.events.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(recent).alias("recent"))


@piece(
    "p10_require",
    """select execution_type, count(*) as records from runtime_stats
        where exists (select 1 from configurations where name = 'max server memory (MB)' and value_in_use > 0)
        group by execution_type""",
)
def _require(b):
    enabled = (F.col("name") == "max server memory (MB)") & (F.col("value_in_use") > 0)
    return P.require(b.runtime_stats, b.configurations, enabled).groupBy("execution_type").agg(
        F.count("*").alias("records")
    )


@piece(
    "j03_left_join_many",
    """select s.session_id, s.database_id, w.wait_type, w.wait_duration_ms, w.resource_description
         from sessions s left join waiting_tasks w on w.session_id = s.session_id""",
)
def _left_join_many(b):
    waits = b.waiting_tasks.select("session_id", "wait_type", "wait_duration_ms", "resource_description")
    return R.left_join_many(b.sessions.select("session_id", "database_id"), waits, ["session_id"])


@piece(
    "j04_first_match_per_task",
    """select t.session_id, t.exec_context_id, w.wait_duration_ms, w.wait_type
         from tasks t
         left join (select *, row_number() over (partition by waiting_task_address
                           order by wait_duration_ms desc, wait_type, resource_description) as rn
                      from waiting_tasks) w
           on w.waiting_task_address = t.task_address and w.rn = 1""",
)
def _left_join_first(b):
    order = [F.desc("wait_duration_ms"), F.asc("wait_type"), F.asc("resource_description")]
    waits = R.first_per(b.waiting_tasks, ["waiting_task_address"], order).select(
        F.col("waiting_task_address").alias("task_address"), "wait_duration_ms", "wait_type"
    )
    return R.lookup(b.tasks, waits, "task_address").select(
        "session_id", "exec_context_id", "wait_duration_ms", "wait_type"
    )


@piece(
    "j05_flag_parents",
    """select s.session_id, s.session_id in (select blocking_session_id from requests) as blocks from sessions s""",
)
def _flag_parents(b):
    return R.flag_parents(b.sessions.select("session_id"), b.requests, "session_id", "blocking_session_id", "blocks")


@piece(
    "j13_lookup_one",
    """select s.session_id, c.sql_handle
         from sessions s
         left join (select x.database_id, min(k.most_recent_sql_handle) as sql_handle
                      from connections k join sessions x on x.session_id = k.most_recent_session_id
                     group by x.database_id) c on c.database_id = s.database_id""",
)
def _lookup_one(b):
    handles = b.connections.select(
        F.col("most_recent_session_id").alias("session_id"), F.col("most_recent_sql_handle").alias("sql_handle")
    )
    connected = R.lookup(handles, b.sessions.select("session_id", "database_id"), "session_id", "inner")
    return R.lookup_one(b.sessions.select("session_id", "database_id"), connected, ["database_id"], "sql_handle").select(
        "session_id", "sql_handle"
    )


@piece(
    "j14_scalar_subquery",
    """select p_partkey, p_size, (select max(p_size) from part) as largest from part""",
)
def _scalar(b):
    largest = b.part.agg(F.max("p_size").alias("largest"))
    return R.with_scalar(b.part.select("p_partkey", "p_size"), largest, "largest")


@piece(
    "j17_first_match",
    """select c.most_recent_session_id,
              coalesce((select min(l.dns_name) from listener_ips i join listeners l on l.listener_id = i.listener_id
                         where i.ip_address = c.local_net_address),
                       (select min(l.dns_name) from listeners l where l.port = c.local_tcp_port), 'none') as dns_name
         from connections c""",
)
def _first_match(b):
    by_address = R.lookup(b.listener_ips, b.listeners, "listener_id", "inner").select(
        F.col("ip_address").alias("local_net_address"), "dns_name"
    )
    by_port = b.listeners.select(F.col("port").alias("local_tcp_port"), "dns_name")
    return R.first_match(
        b.connections,
        [(by_address, ["local_net_address"], "dns_name"), (by_port, ["local_tcp_port"], "dns_name")],
        "dns_name",
        F.lit("none"),
    ).select("most_recent_session_id", "dns_name")


@piece(
    "g03_conditional_sums",
    """select l_returnflag, cast(sum(case when l_linestatus = 'O' then floor(l_quantity) end) as bigint) as open_quantity,
              cast(sum(floor(l_quantity)) as bigint) as quantity,
              cast(100.0 * sum(case when l_linestatus = 'O' then floor(l_quantity) end)
                   / nullif(sum(floor(l_quantity)), 0) as float) as pct_open
         from lineitem group by l_returnflag""",
)
def _conditional_sums(b):
    quantity = F.floor("l_quantity")
    sums = b.lineitem.groupBy("l_returnflag").agg(
        R.sum_if(F.col("l_linestatus") == "O", quantity).alias("open_quantity"), F.sum(quantity).alias("quantity")
    )
    return sums.withColumn("pct_open", S.pct("open_quantity", "quantity"))


@piece(
    "o01_top_k",
    """select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25""",
)
def _top_k(b):
    return R.top_k(b.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


_RANK = "l_extendedprice desc nulls last, l_orderkey, l_linenumber, l_partkey"


@piece(
    "o02_top_k_per_key",
    f"""select l_suppkey, l_orderkey, l_linenumber, l_extendedprice
         from (select *, row_number() over (partition by l_suppkey order by {_RANK}) as rn from lineitem) where rn <= 3""",
)
def _top_k_per_key(b):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return R.top_k(b.lineitem, order, 3, ["l_suppkey"]).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@piece(
    "u01_union_all",
    """select object_id, index_id, cast(null as bigint) as pages from indexes
       union all select object_id, index_id, used_page_count as pages from partition_stats""",
)
def _union_all(b):
    used = b.partition_stats.select("object_id", "index_id", F.col("used_page_count").alias("pages"))
    return R.union_all(b.indexes.select("object_id", "index_id"), used).select("object_id", "index_id", "pages")


@piece(
    "f03_decode_enum",
    "select session_id, case transaction_isolation_level "
    + " ".join(f"when {code} then '{name}'" for code, name in ISOLATION_LEVELS.items())
    + " end as isolation from sessions",
)
def _decode(b):
    return b.sessions.select("session_id", S.decode_enum("transaction_isolation_level", ISOLATION_LEVELS).alias("isolation"))


@piece(
    "f09_size_text",
    """select p_partkey, cast(p_size * 8 as varchar) || ' KB' as kb,
              cast(cast(round(cast(p_size as decimal(24,4)) * 0.0078125, 2) as decimal(38,2)) as varchar) || ' MB' as mb,
              p_size / 128.0 as mb_value, p_size // 7 as sevenths, greatest(p_size - 25, 0) as above
         from part""",
)
def _sizes(b):
    return b.part.select(
        "p_partkey",
        S.pages_text_kb("p_size").alias("kb"),
        S.pages_text_mb("p_size").alias("mb"),
        S.pages_to_mb("p_size").alias("mb_value"),
        S.int_div("p_size", 7).alias("sevenths"),
        S.clamp0(F.col("p_size") - 25).alias("above"),
    )


@piece(
    "f10_hour_bucket",
    """select event_id, date_trunc('hour', ts) + interval 330 minute as starts,
              date_trunc('hour', ts) + interval 390 minute as ends, ts - interval 90 minute as server_time,
              dayname(ts) as weekday, cast(dayofweek(ts) + 1 as int) as day
         from events""",
)
def _hours(b):
    at = F.col("ts").cast("timestamp")
    start, end = S.hour_bucket(at, "Asia/Kolkata")
    return b.events.select(
        "event_id",
        start.alias("starts"),
        end.alias("ends"),
        S.to_server_time(at, -90).alias("server_time"),
        S.weekday_name(at).alias("weekday"),
        S.weekday_no(at).alias("day"),
    )


@piece(
    "f13_pending_duration",
    f"""select session_id, {duration("date_diff('millisecond', request_time, timestamp '2024-01-31 00:00:00')")} as pending
         from memory_grants""",
)
def _pending(b):
    ms = S.millis_between("request_time", P.moment("2024-01-31 00:00:00"))
    return b.memory_grants.select("session_id", S.duration_text(ms).alias("pending"))


_SLICE = (
    "coalesce(nullif(substring(t.text, cast(r.statement_start_offset // 2 + 1 as int), "
    "cast((case when r.statement_end_offset = -1 then 2 * length(t.text) else r.statement_end_offset end "
    "- r.statement_start_offset) // 2 + 1 as int)), ''), t.text)"
)


@piece(
    "f16_statement_slice",
    f"""select r.session_id, r.request_id, {_SLICE} as statement, {_SLICE} like 'FETCH API_CURSOR%' as fetches
         from requests r join sql_texts t on t.sql_handle = r.sql_handle""",
)
def _slices(b):
    statement = S.statement_slice("text", "statement_start_offset", "statement_end_offset")
    return R.lookup(b.requests, b.sql_texts, "sql_handle", "inner").select(
        "session_id", "request_id", statement.alias("statement"), statement.like("FETCH API_CURSOR%").alias("fetches")
    )


@piece(
    "v01_switches",
    """select value, value in ('True', 'False') as accepted,
              case when value in ('True', 'False') then count(*) filter (value = 'True' or not is_user_process) end as rows
         from sessions, (values ('True'), ('False'), ('true'), ('false'), ('1'), ('None')) as t(value)
        group by value""",
)
def _switches(b):
    """What a switch lets through with each value; anything but a bool is refused before any row is read."""
    rows = []
    for value in (True, False, "true", "false", 1, None):
        try:
            n = F.count_if(P.flag_in("is_user_process", value))
        except ValueError:
            n = None
        told = F.lit(str(value)).alias("value"), F.lit(n is not None).alias("accepted")
        rows.append(b.sessions.agg((F.lit(None).cast("long") if n is None else n).alias("rows")).select(*told, "rows"))
    return R.union_all(*rows)


@piece(
    "f16_wide_characters",
    """with statements as (
           select r.session_id, r.request_id, replace(t.text, 'e', '😀') as text, r.statement_start_offset // 2 as first,
                  (case when r.statement_end_offset = -1 then 2 * (length(t.text) + length(t.text) - length(replace(t.text, 'e', '')))
                        else r.statement_end_offset end - r.statement_start_offset) // 2 + 1 as n
             from requests r join sql_texts t on t.sql_handle = r.sql_handle),
       characters as (
           select *, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as pos from statements),
       placed as (
           select *, sum(1 + cast(unicode(ch) > 65535 as int)) over (partition by session_id, request_id order by pos) as upto
             from characters)
       select session_id, request_id,
              coalesce(string_agg(ch, '' order by pos) filter (upto - 1 - cast(unicode(ch) > 65535 as int) >= first and upto <= first + n),
                       any_value(text)) as statement
         from placed group by session_id, request_id""",
)
def _wide_slices(b):
    statement = S.statement_slice("wide", "statement_start_offset", "statement_end_offset")
    wide = b.sql_texts.withColumn("wide", F.replace("text", F.lit("e"), F.lit("😀")))
    return R.lookup(b.requests, wide, "sql_handle", "inner").select("session_id", "request_id", statement.alias("statement"))


@piece(
    "f17_names",
    """select object_id, '[' || replace(name, ']', ']]') || ']' as quoted, nullif(type_desc, '') as kind,
              try_cast(name as int) as number
         from objects""",
)
def _quoted(b):
    return b.objects.select(
        "object_id",
        S.quote_name("name").alias("quoted"),
        S.blank_to_null("type_desc").alias("kind"),
        F.col("name").try_cast("int").alias("number"),
    )


@piece("a15_event_files", EVENT_SQL["f20_shredded_events"])
def _event_files(b):
    """The events as rotated XML files of one capture, in a folder that also holds another capture's file."""
    spark = b.raw_events.sparkSession
    folder, aside = new_folder(spark, "event-files"), new_folder(spark, "event-files")
    parsed = b.raw_events.select(event_struct("event_data").alias("e")).select("e.*")
    write_events(parsed, folder)
    write_events(parsed.limit(5).coalesce(1), aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    other = next(f.getPath() for f in files.listStatus(path(aside)) if f.getPath().getName().startswith("part-"))
    if not files.rename(other, path(folder, "other_0_1.xml")):
        raise OSError(f"{other} could not be moved")
    flat = flat_columns(F.struct("_name", "_timestamp", "data", "action"))
    return read_events(spark, f"{folder}/part-now.xml", "part.xml").select(*[c.alias(name) for name, c in flat.items()])

