"""What micro-batches wrote, in a bounded number of folders.

A batch is a folder of its own, and replaces it when it runs again. Every ``fan`` batches the batches
before are folded into one folder, every ``fan`` of those into a larger one, and so on: a row is written
once per level, and a reader opens at most ``fan`` folders a level. A batch begins when all earlier ones
are committed, so only committed batches are folded. A folder counts when its ``_SUCCESS`` file is there,
which is written last; what it replaces stays until the next folder of its level is there, for readers
that began before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Fold = Callable[[DataFrame], DataFrame]
_NAME = re.compile(r"segment-(\d+)-(\d+)$")


class Segments:
    """The folders below ``folder``; ``fan`` must stay the same for one folder."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = 32):
        if fan < 2:
            raise ValueError("a fan of two or more is expected")
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, batch: DataFrame, number: int, fold: Fold) -> None:
        """Write batch ``number``; ``fold`` turns the rows of several batches into fewer rows that mean the same."""
        batch.write.mode("overwrite").parquet(self._name(number, number))
        size = self.fan
        while number and number % size == 0:
            self._fold(number - size, size, fold)
            size *= self.fan

    def _name(self, first: int, last: int) -> str:
        return f"{self.folder}/segment-{first:012d}-{last:012d}"

    def _whole(self, first: int, last: int) -> bool:
        return self._fs.exists(self._path(f"{self._name(first, last)}/_SUCCESS"))

    def _fold(self, first: int, size: int, fold: Fold) -> None:
        child = size // self.fan
        if not self._whole(first, first + size - 1):
            parts = [(k, k + child - 1) for k in range(first, first + size, child)]
            names = [self._name(*p) for p in parts if self._whole(*p)]
            if not names:
                return
            fold(self.spark.read.parquet(*names)).write.mode("overwrite").parquet(self._name(first, first + size - 1))
        before = first - size
        if before >= 0 and self._whole(before, first - 1):
            for k in range(before, first, child):
                self._fs.delete(self._path(self._name(k, k + child - 1)), True)

    def names(self) -> list[str]:
        """The folders that hold every committed batch once: at each batch the one that reaches furthest."""
        root = self._path(self.folder)
        found = [_NAME.search(s.getPath().getName()) for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        spans = sorted((int(m[1]), -int(m[2])) for m in found if m)
        chosen, reached = [], -1
        for first, last in ((a, -b) for a, b in spans):
            if first > reached and self._whole(first, last):
                chosen.append(self._name(first, last))
                reached = last
        return chosen

    def read(self, schema: StructType) -> DataFrame:
        """The rows of all batches, as folded so far."""
        names = self.names()
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
