"""Merging of pre-aggregated metric records.

A record carries ``avg_m, min_m, max_m, stdev_m`` over ``count_executions`` runs. Sums of
``avg * n`` and ``stdev^2 * n`` add up, so records merge in any order and in two stages, which lets
Spark aggregate on the map side. The spread is pooled from within the records only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.constants import METRIC_SCALES
from gaugeworks.functions.scalars import ratio, round_dec

COUNT = "count_executions"


def _weighted(metric: str, count: str) -> Column:
    return F.sum(F.col(f"avg_{metric}") * F.col(count))


def _pooled(metric: str, count: str) -> Column:
    spread = F.col(f"stdev_{metric}")
    return F.sqrt(ratio(F.sum(spread * spread * F.col(count)), F.sum(count)))


def merge_total(metric: str, scale: float | None = None, count: str = COUNT) -> Column:
    return _weighted(metric, count).cast("double") * _scale(metric, scale)


def merge_avg(metric: str, scale: float | None = None, count: str = COUNT) -> Column:
    return ratio(_weighted(metric, count), F.sum(count)) * _scale(metric, scale)


def merge_min(metric: str, scale: float | None = None, count: str = COUNT) -> Column:
    return F.min(f"min_{metric}").cast("double") * _scale(metric, scale)


def merge_max(metric: str, scale: float | None = None, count: str = COUNT) -> Column:
    return F.max(f"max_{metric}").cast("double") * _scale(metric, scale)


def merge_stdev(metric: str, scale: float | None = None, count: str = COUNT) -> Column:
    return _pooled(metric, count) * _scale(metric, scale)


def merge_variation(metric: str, count: str = COUNT) -> Column:
    """Coefficient of variation; 0 where it is undefined."""
    return ratio(_pooled(metric, count) * F.sum(count), _weighted(metric, count))


def _scale(metric: str, scale: float | None) -> Column:
    return F.lit(float(METRIC_SCALES[metric] if scale is None else scale))


RANKS = {
    "total": merge_total,
    "avg": merge_avg,
    "min": merge_min,
    "max": merge_max,
    "stdev": merge_stdev,
}


def partial_summary(metric: str, count: str = COUNT) -> dict[str, tuple[Column, str]]:
    """What records of one metric come to, as parts that add up: per column, the aggregate and how parts are joined."""
    avg, spread, n = F.col(f"avg_{metric}"), F.col(f"stdev_{metric}"), F.col(count)
    return {
        f"weighted_{metric}": (F.sum(avg * n), "sum"),
        f"squares_{metric}": (F.sum(spread * spread * n), "sum"),
        f"least_{metric}": (F.min(f"min_{metric}"), "min"),
        f"most_{metric}": (F.max(f"max_{metric}"), "max"),
    }


def finished_summary(metric: str, scale: float | None = None, count: str = COUNT) -> list[Column]:
    """The columns of ``merge_summary`` from the joined parts."""
    weighted, squares, least, most = (F.col(name) for name in partial_summary(metric, count))
    pooled, factor = F.sqrt(ratio(squares, F.col(count))), _scale(metric, scale)
    values = {
        "total": weighted.cast("double") * factor,
        "avg": ratio(weighted, F.col(count)) * factor,
        "min": least.cast("double") * factor,
        "max": most.cast("double") * factor,
        "stdev": pooled * factor,
    }
    variation = F.coalesce(round_dec(ratio(pooled * F.col(count), weighted), 2), F.lit(0.0))
    return [*(round_dec(v, 2).alias(f"{name}_{metric}") for name, v in values.items()), variation.alias(f"variation_{metric}")]


def merge_summary(metric: str, scale: float | None = None, count: str = COUNT) -> list[Column]:
    """The six merged aggregates of one metric, rounded to two digits."""
    merged = [round_dec(merge(metric, scale, count), 2).alias(f"{name}_{metric}") for name, merge in RANKS.items()]
    variation = F.coalesce(round_dec(merge_variation(metric, count), 2), F.lit(0.0))
    return [*merged, variation.alias(f"variation_{metric}")]
