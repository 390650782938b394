"""Product codes of vectors: whole-number parts, codebooks from a few rounds, equal-average search.

The nearest entry of a part is searched among entries sorted by component sum. By Cauchy-Schwarz the
squared distance of two parts of ``d`` components is at least the squared gap of their sums over ``d``,
so the search starts at a part's own sum and widens in both directions until that bound is strictly
above the best distance: nothing beyond can be nearer or tie. Codebooks are a few thousand numbers. Each
round is one pass in which every task adds up its own rows and sends one row per codebook component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import arrow_batches, prepare, written

HEX = np.array([f"{i:02x}" for i in range(256)], dtype="S2")


class Codebook:
    """The entries of one part, sorted by component sum; equal sums by index."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.index], entries[self.index]
        self.examined = 0  # entries measured so far

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower one) and squared distance, for every row of ``parts``."""
        own, width = parts.sum(axis=1), parts.shape[1]
        right = np.searchsorted(self.sums, own)
        start = np.minimum(right, len(self.sums) - 1)
        best, found = self._distance(parts, start), self.index[start]
        for at, step in ((right, 1), (right - 1, -1)):
            rows = np.arange(len(parts))
            while True:
                inside = (at >= 0) & (at < len(self.sums))
                rows, at = rows[inside], at[inside]
                near = (self.sums[at] - own[rows]) ** 2 <= best[rows] * width
                rows, at = rows[near], at[near]
                if not len(rows):
                    break
                distance, index = self._distance(parts[rows], at), self.index[at]
                better = (distance < best[rows]) | ((distance == best[rows]) & (index < found[rows]))
                best[rows[better]], found[rows[better]] = distance[better], index[better]
                at = at + step
        return found, best

    def _distance(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.examined += len(at)
        return ((parts - self.entries[at]) ** 2).sum(axis=1)


def _sound(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or no number."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def whole_numbers(values: np.ndarray, offsets: np.ndarray, scale: int, width: int, parts: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``, cut into ``parts`` of ``width``; missing components are 0."""
    most = min(1 << 26, (1 << 30) // width)
    scaled = np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.zeros((len(sizes), parts * width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rows[row, np.arange(len(scaled)) - np.repeat(offsets[:-1], sizes)] = scaled
    return rows.reshape(len(sizes), parts, width)


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> DataFrame:
    """Per sound vector: id, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    A component becomes ``floor(scale * x)``; a vector is ``parts`` equal consecutive parts. Codebooks
    start as the parts of the ``entries`` smallest ids (of fewer vectors, all; equal ids by vector, null
    ids last). In each round entries become the floored mean of the parts nearest to them; an entry
    without parts stays. ``code`` has two hex digits a part (256 entries at most), ``error`` is the sum of the
    parts' squared distances, ``label_error`` its sum over equal labels, nulls together.

    Rows whose vector is null or holds a null or non-finite component are left out. Repeated rows come
    back each. Vectors shorter than the longest, or whose length ``parts`` does not divide, are
    filled up with zeros. Components beyond 2**26 after scaling (less for parts of more than 16) count as
    that bound, so that no sum leaves 64 bits. An empty table gives an empty result.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part are expected")
    spark = prepare(vectors.sparkSession)
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    kept = named.where(_sound(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))

    def rows_of(column: pa.ListArray) -> np.ndarray:
        offsets = np.asarray(column.offsets)
        values = np.asarray(column.values[offsets[0] : offsets[-1]])
        return whole_numbers(values, offsets - offsets[0], scale, width, parts)

    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    seeds = pa.array([r.vector for r in first], pa.list_(pa.float64()))
    books = np.ascontiguousarray(rows_of(seeds).transpose(1, 0, 2))  # part, entry, component

    def add_up(books: np.ndarray):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searched = [Codebook(b) for b in books]
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in arrow_batches(batches):
                for p, part in enumerate(rows_of(batch.column(0)).transpose(1, 0, 2)):
                    found, _ = searched[p].nearest(part)
                    counts[p] += np.bincount(found, minlength=len(counts[p]))
                    np.add.at(sums[p], found, part)
            p, e = np.nonzero(counts)
            each = [np.repeat(x, width) for x in (p, e, counts[p, e])]
            columns = [each[0], each[1], np.tile(np.arange(width), len(p)), each[2], sums[p, e].ravel()]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["p", "e", "i", "n", "s"])

        return task

    for _ in range(rounds if first else 0):
        added = kept.select("vector").mapInArrow(add_up(books), "p long, e long, i long, n long, s long")
        totals = added.groupBy("p", "e", "i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)")))
        books = books.copy()
        for p, e, i, n, s in totals.collect():  # a row per codebook component
            books[p, e, i] = int(s) // n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for batch in arrow_batches(batches):
            rows = rows_of(batch.column(1))
            found = [book.nearest(rows[:, p]) for p, book in enumerate(searched)]
            codes = HEX[np.stack([f for f, _ in found], axis=1)]
            codes = np.ascontiguousarray(codes).view(f"S{2 * parts}").ravel().astype(str)
            error = sum(d for _, d in found)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(codes), pa.array(error)], names=["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in named.schema}
    encoded = written(kept.mapInArrow(assign, f"id {types['id']}, label {types['label']}, code string, error long"), "vector-codes")
    totals = encoded.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error"))
    return encoded.join(totals, F.col("label").eqNullSafe(F.col("its"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
