"""Staleness of optimizer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.predicates import flag_in, optional_eq
from gaugeworks.functions.scalars import pct
from gaugeworks.plans.relational import lookup, report_order, union_all


def statistics_staleness(
    objects: DataFrame,
    schemas: DataFrame,
    stats: DataFrame,
    part_stats: DataFrame,
    inc_props: DataFrame,
    props: DataFrame,
    *,
    schema: str | None = None,
    table: str | None = None,
    include_auto: bool = False,
    include_system: bool = False,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Modifications of every statistic against its update threshold, per partition and as a whole.

    Partition pages and rows are summed before any join, per partition for the first kind of row and
    per object for the second, so no row multiplies.
    """
    keys = list(keys)
    place = [*keys, "object_id", "stats_id"]
    named = lookup(
        objects.filter(optional_eq("name", table) & flag_in("is_ms_shipped", include_system)).select(
            *keys, "object_id", "schema_id", F.col("name").alias("object_name"), "type_desc"
        ),
        schemas.select(*keys, "schema_id", F.col("name").alias("schema_name")),
        [*keys, "schema_id"],
    ).filter(F.lit(True) if schema is None else F.col("schema_name") == schema)
    described = lookup(
        stats.filter(flag_in("auto_created", include_auto))
        .withColumnRenamed("name", "stat_name")
        .drop("auto_created"),
        named.drop("schema_id"),
        [*keys, "object_id"],
        "inner",
    )
    # one pass over the partitions serves both kinds of row
    pages = (
        part_stats.withColumnRenamed("index_id", "stats_id")
        .groupBy(*place, "partition_number")
        .agg(F.sum("used_page_count").alias("pages"), F.sum("row_count").alias("current_rows"))
    )
    all_pages = pages.groupBy(*place).agg(F.sum("pages").alias("pages"), F.sum("current_rows").alias("current_rows"))
    per_partition = lookup(
        lookup(inc_props.filter("rows IS NOT NULL"), pages, [*place, "partition_number"]),
        props.select(*place, "persisted_sample_percent"),
        place,
    )
    whole = lookup(props.filter("rows IS NOT NULL"), all_pages, place).withColumn(
        "partition_number", F.lit(None).cast("int")
    )
    result = lookup(union_all(per_partition, whole), described, place, "inner")
    rows = F.coalesce("current_rows", "rows")
    result = report_order(result, ordered, *keys, "schema_name", "object_name", "stat_name", "partition_number")
    return result.select(
        *keys,
        "schema_name",
        "object_name",
        "type_desc",
        "stat_name",
        "is_incremental",
        "partition_number",
        "rows",
        "modification_counter",
        F.round(F.sqrt(rows * F.lit(1000.0)), 0).alias("autostat_target_modifications"),
        pct("modification_counter", "rows").alias("pct_change"),
        "last_updated",
        "has_filter",
        "no_recompute",
        "has_persisted_sample",
        pct("rows_sampled", "rows").alias("used_sample_rate"),
        "persisted_sample_percent",
        "pages",
        "current_rows",
    )
