"""Hourly aggregates over streams, in two forms.

``HourlyTotals`` keeps no state: every micro-batch writes what its rows add to their hours, and a reader
adds up (``write_totals``, ``read_totals``). A row that comes days late changes its hour like any other.

The other form lets Spark hold the open hours; rows of an hour the watermark has passed are dropped and
counted (``capture.LateRows``). ``capture.write_stream`` appends an hour when it is closed, and
``capture.write_changes`` also writes the open ones, for ``capture.read_latest``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gaugeworks.constants import METRIC_SCALES
from gaugeworks.functions.summaries import COUNT, finished_summary, merge_summary, partial_summary
from gaugeworks.streaming.capture import start
from gaugeworks.streaming.segments import Segments


@dataclass(frozen=True)
class HourlyTotals:
    """Totals per hour of ``time`` and group, made of parts that add up in any order.

    ``by`` names the group's columns; ``parts`` has per column its aggregate over rows and how parts are
    joined (``sum``, ``min`` or ``max``); ``finish`` are the report's columns, from joined parts.
    """

    time: str
    by: dict[str, Column]
    parts: dict[str, tuple[Column, str]]
    finish: tuple[Column, ...]

    def of_rows(self, rows: DataFrame) -> DataFrame:
        """What rows add to their hours; rows without a time belong to none."""
        hour = F.window(F.col(self.time).cast("timestamp"), "1 hour").alias("_hour")
        added = rows.groupBy(hour, *(c.alias(name) for name, c in self.by.items())).agg(*(c.alias(n) for n, (c, _) in self.parts.items()))
        return added.select(F.col("_hour.start").alias("bucket_start"), *self.by, *self.parts)

    def joined(self, parts: DataFrame) -> DataFrame:
        """One row per hour and group."""
        return parts.groupBy("bucket_start", *self.by).agg(*(getattr(F, how)(n).alias(n) for n, (_, how) in self.parts.items()))

    def report(self, parts: DataFrame) -> DataFrame:
        end = (F.col("bucket_start") + F.expr("interval 1 hour")).alias("bucket_end")
        keys = [name for name in self.by]
        return self.joined(parts).select("bucket_start", end, *keys, *self.finish)


def event_count_totals(ts: str = "ts", keys=()) -> HourlyTotals:
    """Events per type and hour."""
    by = {name: F.col(name) for name in (*keys, "event_type")}
    return HourlyTotals(ts, by, {"occurances": (F.count("*"), "sum")}, (F.col("occurances"),))


def workload_totals(metrics=tuple(METRIC_SCALES), keys=()) -> HourlyTotals:
    """Merged metrics per plan, execution type and hour of the last execution."""
    by = {name: F.col(name) for name in (*keys, "plan_id")} | {"execution_type": F.col("execution_type_desc")}
    parts = {COUNT: (F.sum(COUNT), "sum")}
    for m in metrics:
        parts |= partial_summary(m)
    finish = [c for m in metrics for c in finished_summary(m, METRIC_SCALES[m])]
    return HourlyTotals("last_execution_time", by, parts, (F.col(COUNT), *finish))


def write_totals(
    rows: DataFrame, totals: HourlyTotals, out_dir: str, *, trigger: str | None = "5 seconds", checkpoint: str | None = None, fan: int = 32
) -> StreamingQuery:
    """Write what each micro-batch of ``rows`` adds; ``read_totals`` gives the hours, open and late ones included."""
    held = Segments(rows.sparkSession, out_dir, fan)

    def put(batch: DataFrame, number: int) -> None:
        held.put(totals.of_rows(batch), number, totals.joined)

    return start(rows.writeStream.foreachBatch(put), out_dir, trigger, checkpoint)


def read_totals(spark: SparkSession, totals: HourlyTotals, out_dir: str, schema: StructType, fan: int = 32) -> DataFrame:
    """The report over all rows written so far; ``schema`` is that of the rows."""
    parts = totals.of_rows(spark.createDataFrame([], schema)).schema
    return totals.report(Segments(spark, out_dir, fan).read(parts))


def event_counts_stream(events: DataFrame, watermark: str = "10 minutes", ts: str = "ts", keys=()) -> DataFrame:
    """Events per type and hour."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    hours = timed.groupBy(*keys, F.window(ts, "1 hour").alias("_hour"), "event_type").agg(
        F.count("*").alias("occurances")
    )
    return _flat(hours, keys)


def workload_buckets_stream(
    stats: DataFrame, metrics=tuple(METRIC_SCALES), watermark: str = "1 hour", keys=()
) -> DataFrame:
    """Merged metrics per plan, execution type and hour of the last execution."""
    merged = [c for m in metrics for c in merge_summary(m, METRIC_SCALES[m])]
    hours = (
        stats.withWatermark("last_execution_time", watermark)
        .groupBy(
            *keys,
            F.window("last_execution_time", "1 hour").alias("_hour"),
            "plan_id",
            F.col("execution_type_desc").alias("execution_type"),
        )
        .agg(F.sum(COUNT).alias(COUNT), *merged)
    )
    return _flat(hours, keys)


def _flat(hours: DataFrame, keys) -> DataFrame:
    rest = [c for c in hours.columns if c != "_hour" and c not in keys]
    start, end = F.col("_hour.start").alias("bucket_start"), F.col("_hour.end").alias("bucket_end")
    return hours.select(*keys, start, end, *rest)
