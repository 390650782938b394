"""Helpers shared by the operators: tables in the shared folder, task-side batches, text matching."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.plans.materialize import new_folder

#: White space between words, and what is stripped from lines: the six ASCII characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows handed to a Python task at once; texts are long, so batches are short.
BATCH_ROWS = 512


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``.

    Cuts the lineage: what reads the table later is not recomputed when an executor is lost, and
    two readers see the same rows. The committer leaves no rows of failed attempts behind. The shuffle files
    of the write go with its end; nothing reads them again, and they would fill the executors' disks.
    """
    spark = df.sparkSession
    folder, before = new_folder(spark, f"llm-{purpose}"), spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def remove(table: DataFrame) -> None:
    """Delete the folder of a table made by ``written``, when nothing will read it any more."""
    spark = table.sparkSession
    for uri in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; an explicit smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash128(value: Column, names: tuple[str, str]) -> list[Column]:
    """Two independent 64-bit hashes: the second one starts from another seed."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit("second"), value).alias(names[1])]


def arrow_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def text_arrays(column: pa.Array):
    """Offsets and UTF-8 bytes of a string column as numpy arrays; a null is an empty text."""
    import numpy as np

    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together; a longer text is a run of its own."""
    first = 0
    for i in range(1, len(offsets)):
        if i + 1 == len(offsets) or offsets[i + 1] - offsets[first] > limit:
            yield first, i
            first = i


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this library's code to the executors, once per application.

    Python tasks import it by name; a cluster where it is installed is not harmed by a second copy.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = pathlib.Path(__file__).resolve().parent.parent
        file = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gaugeworks-code-")), "gaugeworks.zip")
        with zipfile.ZipFile(file, "w") as archive:
            for path in sorted(top.rglob("*.py")):
                archive.write(path, path.relative_to(top.parent))
        context.addPyFile(file)
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """What Python tasks over whole texts need: the library on the workers, and short Arrow batches."""
    ship_package(spark)
    short_batches(spark)
    return spark
