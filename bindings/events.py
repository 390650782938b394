"""Event reports over the test data, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import events
from gaugeworks.plans.materialize import new_folder
from gaugeworks.sources.event_files import read_raw_events, save_raw_events
from bindings.tables import Bound

AS_OF = "2024-01-31 00:00:00"
# a thousand attributes instead of one
SHORT = '<deadlock id="d'
LONG = "<deadlock " + "".join(f'a{i}="{i}>" ' for i in range(1000)) + 'id="d'


def _heatmap(spark, sf_dir):
    return events.event_heatmap(Bound(spark, sf_dir).raw_events, as_of=AS_OF, days_back=30)


def _last(spark, sf_dir):
    return events.last_event(Bound(spark, sf_dir).raw_events, as_of=AS_OF)


def _graphs(spark, sf_dir):
    return events.deadlock_graphs(Bound(spark, sf_dir).raw_events, utc_offset=-90)


def _long_graphs(spark, sf_dir):
    """Graphs with very long tags, from documents stored with their time and number of graphs."""
    folder = new_folder(spark, "raw")
    lengthened = F.replace("event_data", F.lit(SHORT), F.lit(LONG))
    save_raw_events(Bound(spark, sf_dir).raw_events.drop("event_time").withColumn("event_data", lengthened), folder)
    return events.deadlock_graphs(read_raw_events(spark, folder), utc_offset=-90)


def _raw(spark, sf_dir):
    return events.raw_events(Bound(spark, sf_dir).raw_events)


def _cracked(spark, sf_dir):
    b = Bound(spark, sf_dir)
    return events.crack_events(b.raw_events, b.databases, utc_offset=120)


def _shredded(spark, sf_dir):
    return events.shred(Bound(spark, sf_dir).raw_events.drop("event_time")).drop("event_data")


def _counters(spark, sf_dir):
    return events.feature_counters(Bound(spark, sf_dir).counters)


QUERIES = {
    "a11_event_heatmap": _heatmap,
    "a12_last_event": _last,
    "a13_deadlock_graphs": _graphs,
    "a13_long_tags": _long_graphs,
    "a16_raw_events": _raw,
    "a17_cracked_events": _cracked,
    "f20_shredded_events": _shredded,
    "a18_feature_counters": _counters,
}

# the test events carry fractions of a second, the documents whole seconds
SECOND = "date_trunc('second', ts)"
DOCUMENTS = (
    f"select {SECOND} as seen, user_id, event_id, event_type, props, "
    "case when event_type = 'error' then 'xml_deadlock_report' else 'deprecation_announcement' end as event_type_name "
    "from events"
)

ORACLE = {
    "a11_event_heatmap": f"""
    select count(*) as occurances, dayname(seen) as name, cast(dayofweek(seen) + 1 as int) as day,
           cast(extract(hour from seen) as int) as hour
      from (select {SECOND} as seen from events where event_type = 'error')
     where seen >= timestamp '2024-01-01 00:00:00'
     group by dayname(seen), dayofweek(seen), extract(hour from seen)""",
    "a12_last_event": f"""
    select max({SECOND}) as last_event_utc, timestamp '2024-01-31 00:00:00' as current_time
      from events where event_type = 'error' having max(ts) is not null""",
    "a13_deadlock_graphs": f"""
    with times as (
      select event_id, user_id, {SECOND} - interval 90 minute as server_time from events where event_type = 'error'),
    documents as (
      select event_data from raw_events where object_name = 'xml_deadlock_report'),
    graphs as (
      select event_id, server_time, '<deadlock id="d>' || event_id || '"><victim/></deadlock>' as deadlock_graph_xml
        from times where user_id % 3 > 0
      union all
      select event_id, server_time, '<deadlock id="e' || event_id || '"/>' as deadlock_graph_xml
        from times where user_id % 3 = 2)
    select d.event_data as raw_report, g.server_time, g.deadlock_graph_xml
      from graphs g
      join documents d on contains(d.event_data, g.deadlock_graph_xml)
     order by g.server_time desc, raw_report, g.deadlock_graph_xml limit 100""",
    "a17_cracked_events": f"""
    with newest as (
      select r.event_data,
             strptime(regexp_extract(r.event_data, 'timestamp="([^"]*)Z"', 1), '%Y-%m-%dT%H:%M:%S') as seen
        from raw_events r order by seen desc nulls last, r.event_data limit 100)
    select n.event_data, regexp_extract(n.event_data, '^<event name="([^"]*)"', 1) as event_type,
           n.seen + interval 120 minute as event_time, b.name as database_name,
           case when e.event_type <> 'error' then e.event_type end as feature,
           case when e.event_type <> 'error' then e.props end as message,
           case when e.event_type <> 'error' then 'host' || e.user_id end as client_hostname,
           case when e.event_type <> 'error' then 'app <' || e.event_type || '>' end as client_app_name,
           case when e.event_type <> 'error' then cast(e.event_id as int) end as session_id,
           cast(null as varchar) as username,
           case when e.event_type <> 'error' then 'select ' || e.event_id end as sql_text
      from newest n
      left join events e on e.event_id = try_cast(regexp_extract(n.event_data, 'select ([0-9]+)<', 1) as bigint)
       and e.event_type <> 'error'
      left join databases b on b.database_id = e.user_id % 30""",
    "f20_shredded_events": f"""
    select event_type_name as event_type, seen as event_time,
           case when event_type <> 'error' then cast(user_id % 30 as int) end as database_id,
           case when event_type <> 'error' then event_type end as feature,
           case when event_type <> 'error' then props end as message,
           case when event_type <> 'error' then 'host' || user_id end as client_hostname,
           case when event_type <> 'error' then 'app <' || event_type || '>' end as client_app_name,
           case when event_type <> 'error' then cast(event_id as int) end as session_id,
           cast(null as varchar) as username,
           case when event_type <> 'error' then 'select ' || event_id end as sql_text
      from ({DOCUMENTS})""",
    "a18_feature_counters": """
    select object_name, instance_name as deprecated_feature, cntr_value as use_count
      from counters where object_name like '%Deprecated Features%'""",
}

ORACLE["a13_long_tags"] = f"""
    select replace(raw_report, '{SHORT}', '{LONG}') as raw_report, server_time,
           replace(deadlock_graph_xml, '{SHORT}', '{LONG}') as deadlock_graph_xml
      from ({ORACLE["a13_deadlock_graphs"]})"""
