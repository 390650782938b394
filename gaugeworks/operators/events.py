"""Reports over captured events (``object_name``, ``event_data`` documents) and feature counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import DEADLOCK_EVENT, DEPRECATED_COUNTER_TEXT, DEPRECATION_FIELDS
from gaugeworks.functions.predicates import moment, since
from gaugeworks.functions.scalars import to_server_time, weekday_name, weekday_no
from gaugeworks.functions.xml import event_head, event_struct, event_time, explode_nodes, node_count, xml_item
from gaugeworks.plans.relational import lookup, report_order, top_k


def time_of(events: DataFrame) -> Column:
    """UTC time of a document: its typed column, or parsed from the document's head where that is absent."""
    return F.col("event_time") if "event_time" in events.columns else event_time(event_head("event_data"))


def event_times(events: DataFrame, event: str, keys=()) -> DataFrame:
    """UTC times of one kind of event; the name filter reaches the scan, and no document is read for it."""
    named = events.filter(F.col("object_name") == event)
    return named.select(*keys, time_of(events).alias("entry_datetime"))


def as_new_as(events: DataFrame, n: int, keys=(), time: str = "event_time") -> DataFrame:
    """The documents at least as new as the ``n``-th newest one, found by the column ``time`` alone.

    Documents without a time count as oldest. Without a time column all documents are left.
    """
    if time not in events.columns:
        return events
    times = top_k(events.select(*keys, time), [F.desc(time)], n, keys)
    all_timed = F.count(time) == F.count(F.lit(1))
    oldest = times.groupBy(*keys).agg(F.when(all_timed, F.min(time)).alias("_oldest"))
    if keys:
        new_enough = F.col("_oldest").isNull() | (F.col(time) >= F.col("_oldest"))
        return events.join(oldest, list(keys)).filter(new_enough).drop("_oldest")
    limit = oldest.select("_oldest").scalar()
    return events.filter(limit.isNull() | (F.col(time) >= limit))


def event_heatmap(
    events: DataFrame,
    *,
    event: str = DEADLOCK_EVENT,
    as_of=None,
    days_back: int = 5,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Events per weekday and hour since the midnight ``days_back`` days before ``as_of``."""
    recent = event_times(events, event, keys).filter(since("entry_datetime", as_of, days_back))
    at = F.col("entry_datetime")
    counts = recent.groupBy(
        *keys, weekday_name(at).alias("name"), weekday_no(at).alias("day"), F.hour(at).alias("hour")
    ).agg(F.count("*").alias("occurances"))
    return report_order(counts, ordered, *keys, F.desc("day"), F.desc("hour")).select(
        *keys, "occurances", "name", "day", "hour"
    )


def last_event(events: DataFrame, *, event: str = DEADLOCK_EVENT, as_of=None, keys=()) -> DataFrame:
    """Time of the latest event next to the current time; no row when there is none."""
    latest = (
        event_times(events, event, keys)
        .groupBy(*keys)
        .agg(F.max("entry_datetime").alias("last_event_utc"))
        .filter("last_event_utc IS NOT NULL")
    )
    return latest.withColumn("current_time", moment(as_of))


def deadlock_graphs(
    events: DataFrame, *, n: int = 100, utc_offset=0, event: str = DEADLOCK_EVENT, keys=(), ordered: bool = True
) -> DataFrame:
    """The newest ``n`` deadlock graphs, one row per graph; events without one vanish.

    Graphs are cut from the values of data items, as they are. The newest ``n`` documents with a graph
    are found first; only theirs are cut. Where the number of graphs and the time are columns
    (``save_raw_events``), those two decide and only the newest documents are read; where they are not,
    every document of that name is searched.
    """
    counted = "graph_count" in events.columns
    holds = (F.col("graph_count") if counted else node_count("event_data", "deadlock")) > 0
    reports = events.filter((F.col("object_name") == event) & holds)
    reports = reports.withColumn("server_time", to_server_time(time_of(events), utc_offset))
    if counted and "event_time" in events.columns:
        reports = as_new_as(reports, n, keys, "server_time")
    reports = reports.select(*keys, F.col("event_data").alias("raw_report"), "server_time")
    reports = top_k(reports, [F.desc("server_time"), F.asc("raw_report")], n, keys)
    graphs = explode_nodes(reports, "raw_report", "deadlock", "deadlock_graph_xml")
    newest = [F.desc("server_time"), F.asc("raw_report"), F.asc("deadlock_graph_xml")]
    return report_order(top_k(graphs, newest, n, keys), ordered, *keys, *newest)


def raw_events(events: DataFrame, n: int | None = 100) -> DataFrame:
    """Any ``n`` documents; all of them, and no limit in the plan, where ``n`` is None."""
    documents = events.select("event_data")
    return documents if n is None else documents.limit(n)


def flat_columns(event: Column, fields=DEPRECATION_FIELDS, utc_offset=0) -> dict[str, Column]:
    """Type, server time, database id and named items of a parsed event."""
    return {
        "event_type": event["_name"],
        "event_time": to_server_time(event_time(event), utc_offset),
        "database_id": xml_item(event, "action", "database_id", "int"),
        **{column: xml_item(event, kind, name, type_) for column, kind, name, type_ in fields},
    }


def shred(events: DataFrame, fields=DEPRECATION_FIELDS, utc_offset=0) -> DataFrame:
    """Documents as flat rows; the document itself is kept."""
    parsed = events.withColumn("_event", event_struct("event_data"))
    return parsed.withColumns(flat_columns(F.col("_event"), fields, utc_offset)).drop("_event", "object_name")


def crack_events(
    events: DataFrame,
    databases: DataFrame,
    *,
    fields=DEPRECATION_FIELDS,
    n: int = 100,
    utc_offset=0,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """The newest ``n`` events as flat rows with their database's name.

    The newest ones are found by their times; documents are read for those and items parsed last.
    """
    timed = as_new_as(events, n, keys).withColumn("_at", time_of(events)).drop("event_time")
    newest = top_k(timed, [F.desc("_at"), F.asc("event_data")], n, keys)
    names = databases.select(*keys, "database_id", F.col("name").alias("database_name"))
    rows = lookup(shred(newest, fields, utc_offset), names, [*keys, "database_id"])
    rows = report_order(rows, ordered, *keys, F.desc("_at"), "event_data")
    return rows.select(
        *keys, "event_data", "event_type", "event_time", "database_name", *[field[0] for field in fields]
    )


def feature_counters(
    counters: DataFrame, *, contains: str = DEPRECATED_COUNTER_TEXT, keys=(), ordered: bool = True
) -> DataFrame:
    """Use counts of the counters whose object name contains a text, most used first."""
    found = counters.filter(F.col("object_name").contains(contains)).select(
        *keys,
        "object_name",
        F.col("instance_name").alias("deprecated_feature"),
        F.col("cntr_value").alias("use_count"),
    )
    return report_order(found, ordered, *keys, F.desc("use_count"))
