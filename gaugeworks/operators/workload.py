"""Workload reports from pre-aggregated runtime statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import ABORTED_EXECUTION, CAPTURE_ON, METRIC_SCALES
from gaugeworks.functions.predicates import overlaps, require
from gaugeworks.functions.scalars import hour_bucket, ratio, round_dec, window_bounds
from gaugeworks.functions.summaries import COUNT, RANKS, merge_summary
from gaugeworks.plans.materialize import materialize
from gaugeworks.plans.relational import BROADCAST_ROWS, fits_broadcast, lookup, report_order, top_k


def _in_window(stats, as_of, window, hours_back, capture_options, keys) -> DataFrame:
    start, end = window_bounds(as_of, window, hours_back)
    rows = stats.filter(overlaps("first_execution_time", "last_execution_time", start, end))
    if capture_options is not None:
        rows = require(rows, capture_options, F.col("actual_state") == CAPTURE_ON, keys)
    return rows


def _hourly(stats: DataFrame, metrics, tz: str, keys) -> DataFrame:
    """Merged metrics per plan, execution type and UTC hour of the last execution."""
    start, end = hour_bucket("_hour", tz)
    merged = [c for m in metrics for c in merge_summary(m, METRIC_SCALES[m])]
    return (
        stats.withColumn("_hour", F.date_trunc("hour", "last_execution_time"))
        .groupBy(*keys, "plan_id", F.col("execution_type_desc").alias("execution_type"), "_hour")
        .agg(F.sum(COUNT).alias(COUNT), *merged)
        .withColumn("bucket_start", start)
        .withColumn("bucket_end", end)
        .drop("_hour")
    )


def _rank_parts(rank_by: str, metric: str) -> tuple[list[Column], Column]:
    """Per-plan partial aggregates, and the rank value merged from them per query."""
    n, x, v = F.col(COUNT), F.col(f"avg_{metric}"), F.col(f"stdev_{metric}")
    runs, total, spread = F.sum("_runs"), F.sum("_total"), F.sum("_spread")
    return {
        "total": ([F.sum(x * n).alias("_total")], total),
        "avg": ([F.sum(n).alias("_runs"), F.sum(x * n).alias("_total")], ratio(total, runs)),
        "min": ([F.min(f"min_{metric}").alias("_low")], F.min("_low").cast("double")),
        "max": ([F.max(f"max_{metric}").alias("_high")], F.max("_high").cast("double")),
        "stdev": (
            [F.sum(n).alias("_runs"), F.sum(v * v * n).alias("_spread")],
            F.sqrt(ratio(spread, runs)),
        ),
    }[rank_by]


def rank_queries(
    stats, plans, queries, texts, *, rank_by="total", metric="duration", min_plans=1, keys=()
) -> DataFrame:
    """One row per query with its rank value and number of plans.

    Statistics shrink to one row per plan on the map side before they meet the plan table, and of
    the texts only the identifiers are read.
    """
    partial, value = _rank_parts(rank_by, metric)
    per_plan = stats.groupBy(*keys, "plan_id").agg(*partial)
    per_query = (
        lookup(per_plan, plans.select(*keys, "plan_id", "query_id"), [*keys, "plan_id"], "inner")
        .groupBy(*keys, "query_id")
        .agg(
            round_dec(value * METRIC_SCALES[metric], 2).alias("rank_value"),
            F.count("plan_id").alias("number_of_plans"),
        )
        .filter(F.col("number_of_plans") >= min_plans)
    )
    known = lookup(
        queries.select(*keys, "query_id", "object_id", "query_text_id"),
        texts.select(*keys, "query_text_id"),
        [*keys, "query_text_id"],
        "left_semi",
    )
    return lookup(per_query, known, [*keys, "query_id"], "inner")


def top_queries(
    stats: DataFrame,
    plans: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    objects: DataFrame,
    *,
    rank_by: str = "total",
    metric: str = "duration",
    as_of=None,
    window: int = 0,
    hours_back: int = -1,
    n: int = 25,
    min_plans: int = 1,
    execution_type: int | None = None,
    tz: str = "UTC",
    capture_options: DataFrame | None = None,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """The ``n`` highest-ranked queries in hourly buckets per plan and execution type.

    The statistics are read twice. The first pass needs few columns and shuffles one row per plan;
    it yields the plans of the top queries, which are written to the shared folder and counted. The
    second pass keeps only those plans' rows, by a broadcast when the count allows it, so what it
    shuffles does not grow with the table. Long texts are fetched last and for those plans only.
    """
    if rank_by not in RANKS:
        raise ValueError(f"rank_by must be one of {', '.join(RANKS)}, not {rank_by!r}")
    if metric not in METRIC_SCALES:
        raise ValueError(f"metric must be one of {', '.join(METRIC_SCALES)}, not {metric!r}")
    in_window = _in_window(stats, as_of, window, hours_back, capture_options, keys)
    if execution_type is not None:
        in_window = in_window.filter(F.col("execution_type") == execution_type)

    ranked = rank_queries(
        in_window, plans, queries, texts, rank_by=rank_by, metric=metric, min_plans=min_plans, keys=keys
    )
    top = top_k(ranked, [F.desc("rank_value"), F.asc("query_id")], n, keys)
    if not keys and n <= BROADCAST_ROWS:
        top = F.broadcast(top)  # n rows
    top_plans = materialize(
        lookup(plans.select(*keys, "plan_id", "query_id"), top, [*keys, "query_id"], "inner")
    )
    small = F.broadcast if fits_broadcast(top_plans) else lambda df: df
    plan_ids = small(top_plans.select(*keys, "plan_id"))
    text_ids = small(top_plans.select(*keys, "query_text_id").distinct())

    buckets = _hourly(lookup(in_window, plan_ids, [*keys, "plan_id"], "left_semi"), [metric], tz, keys)
    top_texts = lookup(texts, text_ids, [*keys, "query_text_id"], "left_semi")
    plan_texts = lookup(
        plans.select(*keys, "plan_id", "query_plan"), plan_ids, [*keys, "plan_id"], "left_semi"
    )
    result = lookup(buckets, top_plans, [*keys, "plan_id"], "inner")
    result = lookup(result, plan_texts, [*keys, "plan_id"], "inner")
    result = lookup(result, top_texts, [*keys, "query_text_id"], "inner")
    result = _named(result, objects, keys)
    result = report_order(result, ordered, *keys, F.desc("rank_value"), "query_id", "bucket_start", "plan_id")
    return result.select(*keys, *_report_columns([metric]))


def aborted_queries(stats, plans, queries, texts, objects, **options) -> DataFrame:
    """Top queries over aborted executions only."""
    return top_queries(stats, plans, queries, texts, objects, execution_type=ABORTED_EXECUTION, **options)


def workload_buckets(
    stats: DataFrame,
    plans: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    objects: DataFrame,
    *,
    metrics=tuple(METRIC_SCALES),
    as_of=None,
    window: int = 0,
    hours_back: int = -1,
    tz: str = "UTC",
    capture_options: DataFrame | None = None,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Every query in hourly buckets, six aggregates for each metric.

    One pass and one wide aggregate over the statistics; plans, queries and texts join its result.
    """
    buckets = _hourly(
        _in_window(stats, as_of, window, hours_back, capture_options, keys), metrics, tz, keys
    )
    result = lookup(buckets, plans.select(*keys, "plan_id", "query_id", "query_plan"), [*keys, "plan_id"], "inner")
    result = lookup(
        result, queries.select(*keys, "query_id", "object_id", "query_text_id"), [*keys, "query_id"], "inner"
    )
    result = lookup(result, texts, [*keys, "query_text_id"], "inner")
    result = _named(result, objects, keys)
    result = report_order(result, ordered, *keys, "bucket_start")
    return result.select(*keys, *_report_columns(metrics))


def _named(df: DataFrame, objects: DataFrame, keys) -> DataFrame:
    names = objects.select(*keys, "object_id", F.col("name").alias("object_name"))
    return lookup(df, names, [*keys, "object_id"]).withColumn(
        "object_name", F.coalesce("object_name", F.lit(""))
    )


def _report_columns(metrics) -> list[str]:
    aggregates = [f"{name}_{m}" for m in metrics for name in (*RANKS, "variation")]
    return [
        "query_id",
        "plan_id",
        "execution_type",
        COUNT,
        "bucket_start",
        "bucket_end",
        *aggregates,
        "query_sql_text",
        "query_plan",
        "object_name",
    ]
