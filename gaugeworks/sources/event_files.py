"""Event files: rotated XML files of one capture, and raw documents in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.functions.scalars import dir_of
from gaugeworks.functions.xml import EVENT, event_head, event_time, node_count
from gaugeworks.schemas import schema

DAY = "event_date"


def event_glob(current_file: str, configured_name: str) -> str:
    """Pattern for all files of a capture.

    The directory comes from the file now written; the capture's configured name gets a ``*`` before
    its extension, or at its end when it has none.
    """
    name = configured_name[len(dir_of(configured_name)) :]
    stem, dot, extension = name.rpartition(".")
    pattern = f"{stem}*.{extension}" if dot else f"{name}*"
    return dir_of(current_file) + pattern


def read_events(spark: SparkSession, current_file: str, configured_name: str) -> DataFrame:
    """Parsed events of every rotated file: name, timestamp, data items and action items."""
    return (
        spark.read.format("xml")
        .option("rowTag", "event")
        .schema(EVENT)
        .load(event_glob(current_file, configured_name))
    )


def read_raw_events(spark: SparkSession, path: str, event: str | None = None, days: tuple | None = None) -> DataFrame:
    """Raw documents from Parquet, with the columns of ``save_raw_events`` that are there; the name filter reaches the scan.

    Files without the time or the number of graphs give documents without it, and it is parsed where
    needed. ``days`` (first and last, UTC) reads the folders of those days only; documents without a
    time are of no day.
    """
    held = spark.read.parquet(path).columns
    columns = [f for f in schema("stored_events") if f.name in held]
    events = spark.read.schema(StructType(columns)).parquet(path)
    if days is not None:
        first, last = (F.lit(day).cast("date") for day in days)
        events = events.filter(F.col(DAY).cast("date").between(first, last))
    events = events.select(*[f.name for f in columns])
    return events if event is None else events.filter(F.col("object_name") == event)


def save_raw_events(events: DataFrame, path: str) -> None:
    """Append raw documents in the layout to read them from: with their time and their number of deadlock
    graphs as columns, in a folder per day.

    Both are parsed here, once; later reads find what they need by day and by column.
    """
    derived = {"event_time": event_time(event_head("event_data")), "graph_count": node_count("event_data", "deadlock")}
    told = events.withColumns({name: c for name, c in derived.items() if name not in events.columns})
    told.withColumn(DAY, F.to_date("event_time")).write.mode("append").partitionBy(DAY).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Write parsed events as XML files, one ``event`` element per row."""
    events.write.format("xml").option("rowTag", "event").option("rootTag", "events").mode("append").save(path)
