"""Continuous capture of events from XML files, and shredding of a stream of documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from gaugeworks.constants import DEPRECATION_EVENTS, DEPRECATION_FIELDS, MAX_EVENT_FILE_BYTES
from gaugeworks.functions.xml import EVENT
from gaugeworks.operators.events import flat_columns, shred
from gaugeworks.plans.relational import lookup
from gaugeworks.streaming.segments import Segments

BATCH = "batch"
LINE_END, AROUND_EVENTS = 1, 256  # bytes of an event file besides its events


def event_stream(spark: SparkSession, src_dir: str, max_files: int | None = None) -> DataFrame:
    """Parsed events from the XML files that arrive in a folder."""
    reader = spark.readStream.format("xml").schema(EVENT).option("rowTag", "event")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(src_dir)


def captured(events: DataFrame, event_names=DEPRECATION_EVENTS, fields=DEPRECATION_FIELDS) -> DataFrame:
    """The events of interest with the attributes to keep."""
    wanted = events.filter(F.col("_name").isin(*event_names))
    flat = flat_columns(F.struct("_name", "_timestamp", "data", "action"), fields)
    return wanted.select(*[c.alias(name) for name, c in flat.items()])


def write_stream(
    df: DataFrame,
    out_dir: str,
    *,
    trigger: str | None = "5 seconds",
    checkpoint: str | None = None,
    max_records_per_file: int | None = None,
) -> StreamingQuery:
    """Append a stream to Parquet; without a trigger interval it handles what is there and ends.

    Progress belongs to the output: it is kept below ``out_dir`` unless another lasting place is given,
    so a restart goes on where the last run ended.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("path", out_dir)
    if max_records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    return start(writer, out_dir, trigger, checkpoint)


def start(writer, out_dir: str, trigger: str | None, checkpoint: str | None) -> StreamingQuery:
    """Run a stream with its progress kept below ``out_dir`` or at ``checkpoint``."""
    writer = writer.option("checkpointLocation", checkpoint or f"{out_dir.rstrip('/')}/_progress")
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def write_changes(
    df: DataFrame,
    out_dir: str,
    by: Sequence[str],
    *,
    trigger: str | None = "5 seconds",
    checkpoint: str | None = None,
    fan: int = 32,
) -> StreamingQuery:
    """Write every change of a stream's groups, open ones too; ``read_latest`` gives the groups.

    A batch replaces its own folder, so a batch that runs again after a failure leaves nothing twice;
    older batches are folded to the last state of each group.
    """
    held = Segments(df.sparkSession, out_dir, fan)

    def put(batch: DataFrame, number: int) -> None:
        held.put(batch.withColumn(BATCH, F.lit(number).cast("long")), number, lambda rows: _last_of(rows, by))

    return start(df.writeStream.outputMode("update").foreachBatch(put), out_dir, trigger, checkpoint)


def _last_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in by]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), BATCH).alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def read_latest(spark: SparkSession, out_dir: str, schema: StructType, by: Sequence[str], fan: int = 32) -> DataFrame:
    """The last state of each group of what ``write_changes`` wrote."""
    held = Segments(spark, out_dir, fan).read(StructType([*schema, StructField(BATCH, LongType())]))
    return _last_of(held, by).select(*schema.names)


class LateRows(StreamingQueryListener):
    """Rows that streams of a session dropped for coming later than their watermark.

    A listener hears of every batch, so the count is that of the whole run; it follows a batch a moment later.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._dropped = spark, Counter()
        spark.streams.addListener(self)

    def count(self, query: StreamingQuery) -> int:
        return self._dropped[str(query.runId)]

    def stop(self) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress
        self._dropped[str(told.runId)] += sum(o.numRowsDroppedByWatermark for o in told.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def rolled(rows: DataFrame, size: Column, max_bytes: int) -> DataFrame:
    """``rows`` with a column ``file``: the rows of one file take ``max_bytes`` at most, a row taking ``size``.

    Files follow the running sum of sizes in each partition. Rows up to a sixteenth of the limit share
    files in steps of the rest, so a step's overhang still fits; a larger row has its own file.
    """
    small = max_bytes // 16
    placed = rows.withColumns({"_size": size, "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    w = Window.partitionBy("_part").orderBy("_at")
    running = F.sum(F.when(F.col("_size") <= small, F.col("_size")).otherwise(0)).over(w)
    step = F.floor((running - 1) / (max_bytes - small)).cast("string")
    own = F.concat(F.lit("x"), F.col("_at").cast("string"))
    file = F.concat_ws("-", F.col("_part").cast("string"), F.when(F.col("_size") <= small, step).otherwise(own))
    return placed.withColumn("file", file).drop("_size", "_part", "_at")


def write_event_files(
    events: DataFrame, out_dir: str, *, max_bytes: int = MAX_EVENT_FILE_BYTES, trigger: str | None = "5 seconds", checkpoint: str | None = None
) -> StreamingQuery:
    """Write parsed events as XML files that roll by size: none is larger than ``max_bytes``.

    Only a single event that is larger by itself makes a larger file. Files lie in a folder per batch,
    which a batch that runs again replaces; ``read_event_files`` reads them all.
    """
    plain = {"rowTag": "event", "indent": ""}
    size = F.octet_length(F.to_xml(F.struct("_name", "_timestamp", "data", "action"), plain)) + LINE_END

    def put(batch: DataFrame, number: int) -> None:
        files = rolled(batch.select("_name", "_timestamp", "data", "action"), size, max_bytes - AROUND_EVENTS).repartition("file")
        writer = files.write.format("xml").options(rootTag="events", **plain).mode("overwrite").partitionBy("file")
        writer.save(f"{out_dir.rstrip('/')}/{BATCH}={number}")

    return start(events.writeStream.foreachBatch(put), out_dir, trigger, checkpoint)


def read_event_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """Parsed events of all files that ``write_event_files`` wrote."""
    return spark.read.format("xml").option("rowTag", "event").schema(EVENT).load(f"{out_dir.rstrip('/')}/{BATCH}=*/file=*")


def capture_events(
    spark: SparkSession,
    src_dir: str,
    out_dir: str,
    *,
    event_names=DEPRECATION_EVENTS,
    fields=DEPRECATION_FIELDS,
    max_files: int | None = None,
    **options,
) -> StreamingQuery:
    """Capture events from a folder of XML files into Parquet at most five seconds later.

    ``max_records_per_file`` keeps the written files small enough to rotate.
    """
    return write_stream(captured(event_stream(spark, src_dir, max_files), event_names, fields), out_dir, **options)


def crack_events_stream(
    events: DataFrame, databases: DataFrame, fields=DEPRECATION_FIELDS, utc_offset=0, keys=()
) -> DataFrame:
    """Documents of a stream as flat rows with their database's name; keeps no state."""
    names = databases.select(*keys, "database_id", F.col("name").alias("database_name"))
    rows = lookup(shred(events, fields, utc_offset), names, [*keys, "database_id"])
    return rows.select(*keys, "event_type", "event_time", "database_name", *[field[0] for field in fields])


def write_cracked(
    events: DataFrame,
    databases: Callable[[], DataFrame],
    out_dir: str,
    *,
    fields=DEPRECATION_FIELDS,
    utc_offset=0,
    keys=(),
    trigger: str | None = "5 seconds",
    checkpoint: str | None = None,
    fan: int = 32,
) -> StreamingQuery:
    """Append documents of a stream as flat rows, with names as they are when their micro-batch runs.

    ``databases`` is called for every batch, so a database added meanwhile has its name from then on.
    ``read_cracked`` reads the rows.
    """
    held = Segments(events.sparkSession, out_dir, fan)

    def put(batch: DataFrame, number: int) -> None:
        held.put(crack_events_stream(batch, databases(), fields, utc_offset, keys), number, lambda rows: rows)

    return start(events.writeStream.foreachBatch(put), out_dir, trigger, checkpoint)


def read_cracked(spark: SparkSession, out_dir: str, events: DataFrame, databases: DataFrame, fields=DEPRECATION_FIELDS, keys=(), fan: int = 32) -> DataFrame:
    """All rows that ``write_cracked`` wrote; ``events`` and ``databases`` tell the columns only."""
    return Segments(spark, out_dir, fan).read(crack_events_stream(events, databases, fields, 0, keys).schema)
