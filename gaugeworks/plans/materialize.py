"""Results that are used more than once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of input, beyond which a report in steps writes each of them.
STEP_BYTES = 512 << 20
_made: set[str] = set()  # folders of stored tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"gaugeworks-{spark.sparkContext.applicationId}")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    The plan is cut, later uses read the written rows, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def reads_much(*dfs: DataFrame) -> bool:
    """Whether the tables behind ``dfs``, each as often as it is read, have more than ``STEP_BYTES``, or no known size."""
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        while leaves.hasNext():
            total += int(leaves.next().stats().sizeInBytes())
    return total > STEP_BYTES


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, for rows in any number.

    Cuts the plan like ``materialize``, and the shuffle files behind it go when it is written, so a report in
    steps takes the disk of its largest step and not of all. ``unstore`` deletes the table; the caller may
    delete the last one of a report when its result is written.
    """
    spark = df.sparkSession
    folder, before = new_folder(spark, purpose), spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    _made.add(folder.rsplit("/", 1)[1])
    return spark.read.schema(df.schema).parquet(folder)


def steps(*dfs: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """What a report over ``dfs`` does with each of its steps: ``stored`` where they read much, else nothing.

    Shuffle files of little input may wait for the end, and the report stays one lazy plan.
    """
    return stored if reads_much(*dfs) else lambda df, purpose: df


def unstore(df: DataFrame, later: DataFrame) -> None:
    """Delete the tables made by ``stored`` that ``df`` reads and ``later``, which is made from it, reads no more."""
    spark = df.sparkSession
    folders = [{f.rsplit("/", 1)[0] for f in table.inputFiles()} for table in (df, later)]
    for uri in folders[0] - folders[1]:
        if uri.rsplit("/", 1)[1] in _made:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _made.discard(uri.rsplit("/", 1)[1])
