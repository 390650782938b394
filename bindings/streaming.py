"""Streams over the test data, run to their end, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import METRIC_SCALES
from gaugeworks.functions.xml import event_struct
from gaugeworks.operators.events import flat_columns
from gaugeworks.plans.materialize import new_folder
from gaugeworks.sources.event_files import write_events
from gaugeworks.streaming.aggregates import (
    HourlyTotals,
    event_count_totals,
    event_counts_stream,
    read_totals,
    workload_totals,
    write_totals,
)
from gaugeworks.streaming.capture import (
    capture_events,
    crack_events_stream,
    event_stream,
    read_cracked,
    read_event_files,
    read_latest,
    write_changes,
    write_cracked,
    write_event_files,
    write_stream,
)
from bindings.events import ORACLE as EVENT_SQL
from bindings.tables import Bound
from bindings.workload import merged


def _arriving(spark, sf_dir: str) -> Bound:
    """The derived tables with ``events`` as a stream of its files."""
    b = Bound(spark, sf_dir)
    # a pattern, since a stream reads a folder or a pattern but not one file by its plain name
    stream = spark.readStream.schema(b.events.schema).parquet(f"{sf_dir}/event[s].parquet")
    return b.replace(events=stream)


def _drained(df: DataFrame) -> DataFrame:
    """What a stream wrote once all input was handled."""
    out_dir = new_folder(df.sparkSession, "drained")
    write_stream(df, out_dir, trigger=None).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out_dir)


def _all_hours(df: DataFrame, *by: str) -> DataFrame:
    """Every group of an hourly stream once all input was handled, open hours included."""
    out_dir = new_folder(df.sparkSession, "hours")
    by = ("bucket_start", "bucket_end", *by)
    write_changes(df, out_dir, by, trigger=None).awaitTermination()
    return read_latest(df.sparkSession, out_dir, df.schema, by)


def _totals(rows: DataFrame, totals: HourlyTotals, fan: int = 32) -> DataFrame:
    """The hours of a stream once all input was handled."""
    out_dir = new_folder(rows.sparkSession, "totals")
    write_totals(rows, totals, out_dir, trigger=None, fan=fan).awaitTermination()
    return read_totals(rows.sparkSession, totals, out_dir, rows.schema, fan)


def _documents(spark, sf_dir: str) -> str:
    """A folder of XML files with the documents of the test data."""
    source = new_folder(spark, "xml")
    write_events(Bound(spark, sf_dir).raw_events.select(event_struct("event_data").alias("e")).select("e.*"), source)
    return source


def _capture(spark, sf_dir):
    out_dir = new_folder(spark, "captured")
    query = capture_events(spark, _documents(spark, sf_dir), out_dir, trigger=None)
    query.awaitTermination()
    return spark.read.parquet(out_dir)


def _crack(spark, sf_dir):
    return _drained(crack_events_stream(_arriving(spark, sf_dir).raw_events, Bound(spark, sf_dir).databases))


def _fresh_names(spark, sf_dir):
    """Half of the names are there when the first batch runs, all of them for the second."""
    b, source, out_dir = Bound(spark, sf_dir), new_folder(spark, "raw"), new_folder(spark, "cracked")
    schema, known = b.raw_events.schema, b.databases.filter("database_id < 15")
    for even, names in ((0, known), (1, b.databases)):
        half = b.events.filter(F.col("event_id") % 2 == even)
        b.replace(events=half).raw_events.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        write_cracked(arriving, lambda names=names: names, out_dir, trigger=None).awaitTermination()
    return read_cracked(spark, out_dir, b.raw_events, b.databases)


def _event_files(spark, sf_dir):
    """All events of the XML files, in files of a bounded size."""
    out_dir = new_folder(spark, "event-files")
    write_event_files(event_stream(spark, _documents(spark, sf_dir)), out_dir, max_bytes=FILE_BYTES, trigger=None).awaitTermination()
    flat = flat_columns(F.struct("_name", "_timestamp", "data", "action"))
    held = read_event_files(spark, out_dir)
    return held.select(*(c.alias(n) for n, c in flat.items()), (F.col("_metadata.file_size") <= FILE_BYTES).alias("within_limit"))


def _counts(spark, sf_dir):
    return _totals(_arriving(spark, sf_dir).events, event_count_totals())


def _counts_with_state(spark, sf_dir):
    return _all_hours(event_counts_stream(_arriving(spark, sf_dir).events), "event_type")


def _late_counts(spark, sf_dir):
    """A batch for every third day, so that most rows come days after later ones were seen."""
    b, source = Bound(spark, sf_dir), new_folder(spark, "events")
    for k in (2, 0, 1):
        some = b.events.filter(F.pmod(F.datediff("ts", F.lit("2024-01-01").cast("date")), F.lit(3)) == k)
        some.coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(b.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return _totals(arriving, event_count_totals(), fan=2)


def _workload(spark, sf_dir):
    return _totals(_arriving(spark, sf_dir).execution_records, workload_totals())


QUERIES = {
    "t01_capture_events": _capture,
    "t02_crack_events_stream": _crack,
    "t02_fresh_names": _fresh_names,
    "s05_event_files": _event_files,
    "t03_event_counts_stream": _counts,
    "t03_late_counts": _late_counts,
    "t03_counts_with_state": _counts_with_state,
    "t04_workload_buckets_stream": _workload,
}

FILE_BYTES = 64 << 10

ORACLE = {
    "t01_capture_events": f"select * from ({EVENT_SQL['f20_shredded_events']}) where event_type <> 'xml_deadlock_report'",
    "t02_crack_events_stream": f"""
    select e.* exclude (database_id), b.name as database_name
      from ({EVENT_SQL['f20_shredded_events']}) e left join databases b on b.database_id = e.database_id""",
    "t03_event_counts_stream": """
    select date_trunc('hour', ts) as bucket_start, date_trunc('hour', ts) + interval 1 hour as bucket_end,
           event_type, count(*) as occurances
      from events
     group by date_trunc('hour', ts), event_type""",
    "t04_workload_buckets_stream": f"""
    select date_trunc('hour', rs.last_execution_time) as bucket_start,
           date_trunc('hour', rs.last_execution_time) + interval 1 hour as bucket_end, rs.plan_id,
           rs.execution_type_desc as execution_type, cast(sum(rs.count_executions) as bigint) as count_executions,
           {", ".join(merged(m) for m in METRIC_SCALES)}
      from execution_records rs
     group by date_trunc('hour', rs.last_execution_time), rs.plan_id, rs.execution_type_desc""",
}

ORACLE |= {name: ORACLE["t03_event_counts_stream"] for name in ("t03_late_counts", "t03_counts_with_state")}
ORACLE["s05_event_files"] = f"select *, true as within_limit from ({EVENT_SQL['f20_shredded_events']})"
ORACLE["t02_fresh_names"] = f"""
    select e.* exclude (database_id), b.name as database_name
      from ({EVENT_SQL['f20_shredded_events']}) e
      left join databases b on b.database_id = e.database_id and (e.session_id % 2 = 1 or e.database_id < 15)"""
