"""Token counts by a two-tier lookup on the map side; words are never shuffled.

Tier one is a table of the most frequent words of the corpus and their token numbers, of fixed size and
broadcast. Words missing there are encoded by the task, through a cache that lives as long as its
worker process. The frequent words come from all documents: a task reports its most frequent words
(a bounded list), the reports are summed, and the largest sums win. A word that the table lacks is
only slower, never wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.bpe import Vocabulary, split_words, word_arrays
from gaugeworks.llm.common import arrow_batches, prepare

TABLE_WORDS = 32_768
REPORT_WORDS = 8_192
CACHE_WORDS = 400_000
_caches: dict = {}


def cached_lengths(vocabulary: Vocabulary, words: list[str]) -> list[int]:
    """Token numbers of distinct words, through the worker process's cache of at most about ``CACHE_WORDS``."""
    cache = _caches.setdefault(vocabulary.key, {})
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = [w for w in words if w not in cache]
    cache.update((w, len(t)) for w, t in zip(new, vocabulary.encode(new)))
    return [cache[w] for w in words]


def frequent_words(rows: DataFrame, vocabulary: Vocabulary, table_words: int) -> list[str]:
    """The most frequent words of ``split_words`` rows, most frequent first; at most ``table_words``."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in arrow_batches(batches):
            _, flat = word_arrays(batch, vocabulary)
            counts = flat.value_counts()
            new = pa.table({"word": counts.field("values"), "n": counts.field("counts")})
            held = new if held is None else pa.concat_tables([held, new]).group_by("word").aggregate([("n", "sum")])
            held = held.rename_columns(["word", "n"]) if held.column_names[0] == "word" else held.select([1, 0]).rename_columns(["word", "n"])
            if held.num_rows > 16 * REPORT_WORDS:
                held = held.take(pc.select_k_unstable(held, k=8 * REPORT_WORDS, sort_keys=[("n", "descending")]))
        if held is not None and held.num_rows:
            held = held.take(pc.select_k_unstable(held, k=min(REPORT_WORDS, held.num_rows), sort_keys=[("n", "descending")]))
            yield from held.combine_chunks().to_batches()

    sums = rows.mapInArrow(report, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in sums.orderBy(F.desc("n"), "word").limit(table_words).collect()]


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Per document: id, ``n_bytes`` of its text in UTF-8, ``n_tokens``, and whether they exceed ``limit``.

    Null and empty texts have no tokens. One row per row, so repeated ids and rows stay apart.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = Vocabulary(vocabulary_path)
    text = F.col("text")
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = split_words(plain, text, vocabulary)
    table = frequent_words(rows.select("unsplit", "words"), vocabulary, table_words)
    tier_one = spark.sparkContext.broadcast(
        (pa.array(table, pa.string()), np.array([len(t) for t in vocabulary.encode(table)], dtype=np.int64))
    )

    def lengths(distinct: pa.Array) -> np.ndarray:
        known, known_lengths = tier_one.value
        at = pc.index_in(distinct, value_set=known)
        found = np.zeros(len(distinct), np.int64)
        hit = np.asarray(at.is_valid())
        found[hit] = known_lengths[np.asarray(at.drop_null())]
        missing = np.flatnonzero(~hit)
        found[missing] = cached_lengths(vocabulary, distinct.take(pa.array(missing)).to_pylist())
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            counts, flat = word_arrays(batch, vocabulary)
            coded = flat.dictionary_encode()
            per_word = lengths(coded.dictionary)[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(per_word)])
            ends = np.concatenate([[0], np.cumsum(counts)])
            n = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return rows.select("id", n_bytes, "unsplit", "words").mapInArrow(count, schema)
