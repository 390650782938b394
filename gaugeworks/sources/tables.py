"""Reading and writing telemetry snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schemas import schema

#: Folders of snapshots by the UTC date of their capture.
CAPTURE_TIME, CAPTURE_DATE = "captured_at", "capture_date"


def load(spark: SparkSession, path: str, name: str, fleet: bool = False, dates: tuple | None = None) -> DataFrame:
    """One telemetry table below ``path``, with its fixed schema; no inference reads the files.

    ``dates`` (first and last) reads only the folders of snapshots captured on those days, for tables that
    ``save`` wrote by date.
    """
    fixed = schema(name, fleet)
    table = spark.read.schema(fixed).parquet(f"{path.rstrip('/')}/{name}")
    if dates is not None:
        if CAPTURE_DATE not in table.columns:
            raise ValueError(f"{name} has no folders by {CAPTURE_DATE}; save it with by_date=True")
        first, last = (F.lit(day).cast("date") for day in dates)
        table = table.filter(F.col(CAPTURE_DATE).cast("date").between(first, last))
    return table.select(*fixed.names)


def save(df: DataFrame, path: str, name: str, partition_by=(), *, by_date: bool = False, mode: str = "overwrite") -> None:
    """Write a table in the layout ``load`` reads.

    ``by_date`` puts snapshots in a folder per UTC date of ``captured_at``, which ``load`` can choose from;
    ``mode="append"`` adds later snapshots.
    """
    if by_date:
        df, partition_by = df.withColumn(CAPTURE_DATE, F.to_date(CAPTURE_TIME)), (CAPTURE_DATE, *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/{name}")
