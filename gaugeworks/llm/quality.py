"""Quality rules: base limits, and robust multivariate outliers per language and source.

Statistics of whole texts come from one scan and are written as a narrow table. The minimum covariance
determinant is estimated for all groups at once by concentration steps: distances under the current
estimate, the quantile that holds the inner part of each group, then mean and covariance of the rows
inside. A step can end in a local minimum, so a group starts from its medians and from several small
seeded draws of its rows; after two steps the start of least determinant goes on. Every step is an aggregate with map-side combining, so a group may hold any share of the rows;
matrices are inverted per group on the aggregated rows. Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import wordscan
from gaugeworks.llm.common import arrow_batches, prepare, slices, text_arrays, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SLICE_BYTES = 1 << 20

#: Part of a group's rows inside the estimate, and the factor that makes its covariance consistent
#: for a normal distribution in five dimensions: 0.5 / P(chi2(7) <= 4.351), 4.351 = chi2(5) at 0.5.
INNER = 0.5
CONSISTENCY = 1.912
#: Squared distance up to which rows count in the last estimate, chi2(5) at 0.975, and its factor:
#: 0.975 / P(chi2(7) <= 12.833). Without it the inner half's estimate rejects the longest clean texts.
LAST_WITHIN = 12.833
LAST_CONSISTENCY = 1.0555
#: Squared distance beyond which a row is an outlier, chi2(5) at 0.999.
CUTOFF = 20.515
#: Standard deviations below which a statistic is not told apart: clean texts share many exact values.
#: Alone, and without spread, a statistic rejects at 3.1 times the usual words, 1.6 times their length, 1 symbol
#: per 100 characters, 1.5 repeated lines per 100 words or 13 % of words in repeated passages.
FLOOR = (0.25, 0.10, 0.15, 0.20, 0.08)
MIN_GROUP = 50
#: Starts of a group (its medians, and draws of about so many rows), and steps that each of them makes.
STARTS, DRAWN_ROWS, FIRST_STEPS = 6, 8, 2
#: An estimate stands still when a step lowers the logarithm of its determinant by less.
STILL = 1e-3

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five statistics of each text of a slice, from its UTF-8 bytes."""
    n = len(offsets) - 1
    begins, ends = wordscan.spans(data, offsets)
    text = np.searchsorted(offsets, begins, side="right") - 1
    n_words = np.bincount(text, minlength=n)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    # the bytes of a code point behind its first have the form 10xxxxxx
    word_chars = per_text(~wordscan.SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per_text(_SYMBOL[data])

    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[:-1] = data == 0x0A
    line_ends = np.concatenate([np.flatnonzero(edge), offsets[1:]])
    line_begins = np.concatenate([np.flatnonzero(edge) + 1, offsets[:-1]])
    line_ends.sort()
    line_begins.sort()
    has_word = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends = line_begins[has_word], line_ends[has_word]
    line_text = np.searchsorted(offsets, line_begins, side="right") - 1
    line_hash = wordscan.span_hashes(data, line_begins, line_ends, lower=False)
    salt = wordscan.mix(np.arange(1, n + 1, dtype=np.uint64))
    distinct = np.unique(wordscan.mix(line_hash + salt[line_text]), return_index=True)[1]
    n_dup_lines = np.bincount(line_text, minlength=n) - np.bincount(line_text[distinct], minlength=n)

    n_repeat_words = np.zeros(n, dtype=np.int64)
    if len(begins) >= WINDOW:
        windows = wordscan.shingles(wordscan.span_hashes(data, begins, ends, lower=False), WINDOW)
        inside = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])
        _, place, count = np.unique(wordscan.mix(windows[inside] + salt[text[inside]]), return_inverse=True, return_counts=True)
        again = inside[count[place] > 1]
        cover = np.zeros(len(begins) + 1, dtype=np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        n_repeat_words = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]


def statistics(docs: DataFrame, *, id_col: str, text_col: str, group_cols: tuple[str, ...]) -> DataFrame:
    """Per row: ``id``, the group columns as ``g0``, ``g1``, the five statistics and ``base_failed``."""
    prepare(docs.sparkSession)
    groups = [F.col(f"`{c}`").alias(f"g{k}") for k, c in enumerate(group_cols)]
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), *groups, F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([f for f in narrow.schema if f.name != "text"] + [T.StructField(s, T.LongType()) for s in STATISTICS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            offsets, data = text_arrays(batch.column("text"))
            parts = [
                text_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE_BYTES)
            ]
            found = [pa.array(np.concatenate(p), pa.int64()) for p in zip(*parts)]
            yield pa.record_batch([batch.column(c) for c in schema.names[: -len(STATISTICS)]] + found, names=schema.names)

    found = narrow.mapInArrow(scan, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def transformed() -> list[Column]:
    """The statistics on scales where clean texts are roughly normal; all are finite for any text."""
    words, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


P = len(FLOOR)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _distance(centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of ``x`` under a row's estimate."""
    d = [F.element_at("x", i + 1) - F.element_at(centre, i + 1) for i in range(P)]
    terms = [(1 if i == j else 2) * F.element_at(inverse, i * P + j + 1) * d[i] * d[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with no variance, in any direction, below that of ``FLOOR``; larger ones stay."""
    scale = np.outer(FLOOR, FLOOR)
    values, vectors = np.linalg.eigh(cov / scale)
    return (vectors * np.maximum(values, 1)) @ vectors.T * scale


def _sums(inside: DataFrame, *also: Column) -> DataFrame:
    """Number, sums and sums of products per group, from which ``_with_inverse`` makes estimates."""
    x = [F.element_at("x", i + 1) for i in range(P)]
    return inside.groupBy("key", "run").agg(
        F.count("*").cast("double").alias("n"),
        F.array(*(F.sum(v) for v in x)).alias("first"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS)).alias("second"),
        *also,
    )


def _with_inverse(sums: DataFrame, consistency: float) -> DataFrame:
    """Estimates per group and run from sums over the rows inside: centre, inverse covariance, size, and if it stands still."""

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centres, inverses, sizes = [], [], []
            for n, first, second in zip(frame["n"], frame["first"], frame["second"]):
                centre, cov = np.array(first) / n, np.zeros((P, P))
                for (i, j), s in zip(_PAIRS, second):
                    cov[i, j] = cov[j, i] = s / n - centre[i] * centre[j]
                cov = floored(consistency * cov)
                centres.append(centre.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                sizes.append(float(np.linalg.slogdet(cov)[1]))
            still = np.array(sizes) > frame["size"].to_numpy(float) - STILL
            yield frame[["key", "run"]].assign(centre=centres, inverse=inverses, size=sizes, still=still)

    return sums.mapInPandas(invert, "key string, run int, centre array<double>, inverse array<double>, size double, still boolean")


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, str] = ("lang", "source"),
    cutoff: float = CUTOFF,
    min_group: int = MIN_GROUP,
    starts: int = STARTS,
) -> DataFrame:
    """Per row: id, the five statistics, ``base_failed``, ``distance`` (squared) and ``kept``.

    Estimates come from rows that pass the base rules. A group of fewer than ``min_group`` such rows is
    judged with the other small groups of its first column (the language); where those are few, by the
    estimate over all rows, and ``distance`` is null, as it would be from no group of the row's own. Where
    even all rows are few, the base rules decide. Null groups are groups of their own. A null text has no
    words and fails. Repeated rows stay; an empty table gives no rows.
    """
    stats = statistics(docs, id_col=id_col, text_col=text_col, group_cols=group_cols)
    rows = written(stats.withColumn("x", F.array(*transformed())), "quality")
    good = rows.where(~F.col("base_failed")).withColumn("drawn", F.xxhash64("id", "x"))

    name = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    sizes = good.groupBy("g0", "g1").agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    by_language = Window.partitionBy("g0", small)
    keys = (
        sizes.withColumn("n_language", F.sum("n").over(by_language))
        .withColumn(
            "key",
            F.when(~small, name(F.lit("both"), "g0", "g1"))
            .when(F.col("n_language") >= min_group, name(F.lit("language"), "g0"))
            .otherwise(F.lit("all")),
        )
        .select(F.col("g0").alias("k0"), F.col("g1").alias("k1"), "key")
    )
    keys = written(keys, "quality-keys")
    same = F.col("g0").eqNullSafe(F.col("k0")) & F.col("g1").eqNullSafe(F.col("k1"))
    keyed = good.join(keys.where(F.col("key") != "all"), same).select("key", "x", "drawn")
    if not keys.where(F.col("key") == "all").isEmpty():
        keyed = keyed.unionByName(good.select(F.lit("all").alias("key"), "x", "drawn"))

    centre = [F.percentile_approx(F.element_at("x", i + 1), 0.5, 1000) for i in range(P)]
    spread = [F.percentile_approx(F.element_at("x", i + 1), F.array(F.lit(0.25), F.lit(0.75)), 1000) for i in range(P)]
    start = keyed.groupBy("key").agg(F.array(*centre).alias("centre"), F.array(*spread).alias("spread"), F.count("*").alias("n"))
    # written, as are the limits below, so that Spark knows how small it is and need not deal out the rows by group
    start = written(start.where(F.col("n") >= min_group), "quality-starts")
    # a first diagonal estimate: medians, and quartiles as of a normal distribution
    sd = [(F.element_at("spread", i + 1)[1] - F.element_at("spread", i + 1)[0]) / 1.349 for i in range(P)]
    zero = F.lit(0.0)
    diagonal = [1 / F.greatest(sd[i] * sd[i], F.lit(FLOOR[i] ** 2)) if i == j else zero for i in range(P) for j in range(P)]
    size, still = F.lit(float("inf")).alias("size"), F.lit(False).alias("still")
    estimate = start.select("key", F.lit(0).alias("run"), "centre", F.array(*diagonal).alias("inverse"), size, still)
    if starts > 1:
        every = F.ceil(F.col("n") / DRAWN_ROWS)
        runs = F.filter(F.sequence(F.lit(1), F.lit(starts - 1)), lambda k: F.pmod(F.xxhash64("drawn", k), every) == 0)
        drawn = keyed.join(start.select("key", "n"), "key").select("key", F.explode(runs).alias("run"), "x")
        estimate = estimate.unionByName(_with_inverse(_sums(drawn, size), 1.0).withColumns({"size": F.lit(float("inf")), "still": F.lit(False)}))
    estimate = written(estimate, "quality-estimate")

    def step(moving: DataFrame) -> DataFrame:
        near = keyed.join(moving, "key").select("key", "run", "x", "size", _distance(F.col("centre"), F.col("inverse")).alias("d"))
        limit = written(near.groupBy("key", "run").agg(F.percentile_approx("d", INNER, 1000).alias("limit")), "quality-limit")
        sums = _sums(near.join(limit, ["key", "run"]).where("d <= limit"), F.max("size").alias("size"))
        return _with_inverse(sums, CONSISTENCY)

    if starts > 1:
        for _ in range(FIRST_STEPS):
            estimate = written(step(estimate), "quality-estimate")
        least = F.min_by(F.struct("run", "centre", "inverse", "size", "still"), F.struct("size", "run"))
        estimate = written(estimate.groupBy("key").agg(least.alias("least")).select("key", "least.*"), "quality-estimate")

    # each step lowers every moving group's determinant by a factor, and floors bound it, so that this ends
    while not (moving := estimate.where("not still")).isEmpty():
        estimate = written(estimate.where("still").unionByName(step(moving)), "quality-estimate")

    near = keyed.join(estimate, "key").where(_distance(F.col("centre"), F.col("inverse")) <= LAST_WITHIN)
    last = _sums(near.select("key", "run", "x"), F.lit(float("inf")).alias("size"))
    estimate = written(_with_inverse(last, LAST_CONSISTENCY), "quality-estimate")

    squared = _distance(F.col("centre"), F.col("inverse"))
    verdict = rows.join(keys.join(estimate, "key", "left"), same, "left").withColumn("squared", F.when(~F.col("base_failed"), squared))
    kept = ~F.col("base_failed") & (F.col("squared").isNull() | (F.col("squared") <= cutoff))
    distance = F.when(F.col("key") != "all", F.col("squared")).alias("distance")
    return verdict.select(F.col("id").alias(id_col), *STATISTICS, "base_failed", distance, kept.alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept; rows of one id go only where all of them are rejected.

    Ids without a rejected row need no join partner: only the rejected ids move.
    """
    id_col = options.get("id_col", "doc_id")
    verdict = judge(docs, **options).groupBy(id_col).agg(F.bool_or("kept").alias("any_kept"))
    rejected = verdict.where("not any_kept").select(F.col(id_col).alias("__rejected_id"))
    return docs.join(rejected, F.col(f"`{id_col}`").eqNullSafe(F.col("__rejected_id")), "left_anti")
