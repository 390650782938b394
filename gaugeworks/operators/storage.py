"""Storage reports: database and object size, allocation units, columnstore row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import (
    COLUMNSTORE_INDEX_TYPES,
    FULL_ROW_GROUP,
    INTERNAL_SPACE_TYPES,
    LOB_ALLOCATIONS,
    OPEN_ROW_GROUP,
    QUEUE_TABLE_TYPE,
    ROW_ALLOCATIONS,
    SPACE_OBJECT_TYPES,
)
from gaugeworks.functions.predicates import flag_in, optional_eq
from gaugeworks.functions.scalars import (
    clamp0,
    pages_text_kb,
    pages_text_mb,
    parse_name,
    pct,
    qualified_name,
    quote_name,
)
from gaugeworks.plans.relational import disjunctive_join, lookup, merge_totals, report_order, union_all


def _space_totals(partitions, alloc_units, internal, keys) -> DataFrame:
    """Reserved, used and data pages of all allocation units."""
    internal_kind = internal.select(
        *keys, "object_id", F.col("internal_type").isin(*INTERNAL_SPACE_TYPES).alias("_internal")
    )
    placed = lookup(
        partitions.select(*keys, F.col("partition_id").alias("container_id"), "object_id", "index_id"),
        internal_kind,
        [*keys, "object_id"],
    )
    units = lookup(
        alloc_units.select(*keys, "container_id", "type", "total_pages", "used_pages", "data_pages"),
        placed,
        [*keys, "container_id"],
        "inner",
    )
    data = (
        F.when(F.col("_internal"), F.lit(0))
        .when(F.col("type") != 1, F.col("used_pages"))
        .when(F.col("index_id") < 2, F.col("data_pages"))
        .otherwise(F.lit(0))
    )
    return units.groupBy(*keys).agg(
        F.sum("total_pages").alias("reserved"), F.sum("used_pages").alias("used"), F.sum(data).alias("data")
    )


def database_size(files, partitions, alloc_units, internal, keys=()) -> DataFrame:
    """Size of data and log files, and the space not allocated, in MB text."""
    by_type = files.groupBy(*keys).agg(
        F.sum(F.when(F.col("type") == 0, F.col("size")).otherwise(F.lit(0))).alias("data_file"),
        F.sum(F.when(F.col("type") == 1, F.col("size")).otherwise(F.lit(0))).alias("log_file"),
    )
    reserved = _space_totals(partitions, alloc_units, internal, keys).select(*keys, "reserved")
    return merge_totals([by_type, reserved], keys).select(
        *keys,
        pages_text_mb(F.col("data_file") + F.col("log_file")).alias("database_size"),
        pages_text_mb(clamp0(F.col("data_file") - F.col("reserved"))).alias("unallocated_space"),
    )


def space_summary(partitions, alloc_units, internal, keys=()) -> DataFrame:
    """Reserved, data, index and unused space of the whole database, in KB text."""
    reserved, used, data = F.col("reserved"), F.col("used"), F.col("data")
    return _space_totals(partitions, alloc_units, internal, keys).select(
        *keys,
        pages_text_kb(reserved).alias("reserved"),
        pages_text_kb(data).alias("data"),
        pages_text_kb(used - data).alias("index_size"),
        pages_text_kb(reserved - used).alias("unused"),
    )


def schema_counts(objects, schemas, keys=(), ordered: bool = True) -> DataFrame:
    """User tables per schema."""
    user_tables = objects.filter((F.col("type") == "U") & flag_in("is_ms_shipped", False))
    counts = user_tables.groupBy(*keys, "schema_id").agg(F.count("name").alias("user_table_count"))
    named = lookup(
        counts, schemas.select(*keys, "schema_id", quote_name("name").alias("schema_name")), [*keys, "schema_id"], "inner"
    )
    return report_order(named, ordered, *keys, "schema_name").select(*keys, "schema_name", "user_table_count")


def resolve_object(
    objects, schemas, internal, name: str, database: str, default_schema: str, keys=()
) -> int | DataFrame:
    """The id whose space to report for a one- to three-part name; a queue gives its internal table.

    For one server it is a number; another database, an unknown name, or an object without space raise
    ``ValueError``. With ``keys`` it is a table of (keys, object_id): a name has an id of its own on each
    server, and servers that lack it or keep no space for it have no row.
    """
    in_database = parse_name(name, 3)
    if in_database is not None and in_database != database:
        raise ValueError(f"{name} is not in the current database {database}")
    schema_ids = schemas.filter(F.col("name") == (parse_name(name, 2) or default_schema)).select(*keys, "schema_id")
    if keys:
        named = objects.filter((F.col("name") == parse_name(name, 1)) & F.trim("type").isin(*SPACE_OBJECT_TYPES))
        named = lookup(named, schema_ids, [*keys, "schema_id"], "left_semi").withColumn("_queue", F.trim("type") == "SQ")
        queues = internal.filter(F.col("internal_type") == QUEUE_TABLE_TYPE).groupBy(*keys, "parent_id")
        queues = queues.agg(F.min("object_id").alias("_table")).withColumnRenamed("parent_id", "object_id")
        found = lookup(named.select(*keys, "object_id", "_queue"), queues, [*keys, "object_id"])
        return found.select(*keys, F.when(F.col("_queue"), F.col("_table")).otherwise(F.col("object_id")).alias("object_id")).filter(
            "object_id IS NOT NULL"
        )
    found = (
        objects.filter(F.col("name") == parse_name(name, 1))
        .join(schema_ids, "schema_id", "left_semi")
        .select("object_id", "type")
        .limit(1)
        .collect()
    )
    if not found:
        raise ValueError(f"object {name} does not exist in database {database}")
    object_id, kind = found[0]["object_id"], found[0]["type"].strip()
    if kind not in SPACE_OBJECT_TYPES:
        raise ValueError(f"space is not kept for {name}: not a table, view or queue")
    if kind != "SQ":
        return object_id
    queue = (
        internal.filter((F.col("parent_id") == object_id) & (F.col("internal_type") == QUEUE_TABLE_TYPE))
        .select("object_id")
        .limit(1)
        .collect()
    )
    if not queue:
        raise ValueError(f"queue {name} has no internal table in database {database}")
    return queue[0]["object_id"]


def space_by_object(
    part_stats,
    internal,
    objects,
    schemas,
    partitions,
    *,
    object_id: int | DataFrame | None = None,
    system_objects: bool = False,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Rows and space per object and partition, with its internal tables' pages, in KB text.

    Pages are summed per object and partition in one pass; each sum then counts for the object
    itself and, if that is an internal table, once more for its parent. ``object_id`` is what
    ``resolve_object`` gives: a number, or with ``keys`` a table of the object on each server.
    """
    keys = list(keys)

    def only(df: DataFrame, column: str) -> DataFrame:
        if isinstance(object_id, DataFrame):
            return lookup(df, object_id.withColumnRenamed("object_id", column), [*keys, column], "left_semi")
        return df.filter(optional_eq(column, object_id))
    place = [*keys, "object_id", "partition_number"]
    main = F.col("index_id") < 2
    overflow = F.col("lob_used_page_count") + F.col("row_overflow_used_page_count")
    zero = F.lit(0).cast("bigint")
    sums = {
        "reserved": F.col("reserved_page_count"),
        "used": F.col("used_page_count"),
        "data": F.when(main, F.col("in_row_data_page_count") + overflow).otherwise(overflow),
        "rows": F.when(main, F.col("row_count")).otherwise(zero),
    }
    parents = only(internal.filter(F.col("internal_type").isin(*INTERNAL_SPACE_TYPES)), "parent_id")
    parents = parents.select(*keys, "object_id", "parent_id")
    if object_id is not None:
        own_ids = only(part_stats, "object_id").select(*keys, "object_id")
        wanted = union_all(own_ids, parents.select(*keys, "object_id"))
        part_stats = lookup(part_stats, wanted.distinct(), [*keys, "object_id"], "left_semi")
    own = part_stats.groupBy(*place).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    targets = F.array(
        F.struct(F.col("object_id").alias("_target"), F.lit(True).alias("_own")),
        F.struct(F.col("parent_id").alias("_target"), F.lit(False).alias("_own")),
    )
    attributed = only(lookup(own, parents, [*keys, "object_id"]).select("*", F.inline(targets)), "_target").withColumn(
        "object_id", F.col("_target")
    )
    totals = (
        attributed.groupBy(*place)
        .agg(
            F.bool_or("_own").alias("_own"),
            F.sum("reserved").alias("reserved"),
            F.sum("used").alias("used"),
            *[F.sum(F.when(F.col("_own"), F.col(c)).otherwise(zero)).alias(c) for c in ("data", "rows")],
        )
        .filter("_own")
    )
    shown = objects.filter(flag_in("is_ms_shipped", system_objects)).select(
        *keys, "object_id", "schema_id", quote_name("name").alias("name")
    )
    shown = lookup(
        shown, schemas.select(*keys, "schema_id", quote_name("name").alias("schema_name")), [*keys, "schema_id"]
    )
    clustered = (
        only(partitions.filter(F.col("index_id") == 1), "object_id")
        .select(*place)
        .distinct()
        .withColumn("_clustered", F.lit(True))
    )
    result = lookup(lookup(totals, clustered, place), shown, [*keys, "object_id"], "inner")
    reserved, used, data = F.col("reserved"), F.col("used"), F.col("data")
    result = report_order(result, ordered, *keys, reserved.desc(), "object_id", "partition_number")
    return result.select(
        *keys,
        "schema_name",
        "name",
        F.when(F.col("_clustered"), "CLUSTERED").otherwise("HEAP").alias("type_desc"),
        "partition_number",
        "rows",
        pages_text_kb(reserved).alias("reserved"),
        pages_text_kb(data).alias("data"),
        pages_text_kb(clamp0(used - data)).alias("index_size"),
        pages_text_kb(clamp0(reserved - used)).alias("unused"),
    )


def _table_indexes(tables, schemas, indexes, keys) -> DataFrame:
    """Indexes of user tables with the table's quoted name."""
    named = lookup(
        tables.filter(flag_in("is_ms_shipped", False)).select(
            *keys, "object_id", "schema_id", F.col("name").alias("_table")
        ),
        schemas.select(*keys, "schema_id", F.col("name").alias("_schema")),
        [*keys, "schema_id"],
    ).select(*keys, "object_id", qualified_name("_schema", "_table").alias("object_name"))
    return lookup(
        indexes.select(
            *keys,
            "object_id",
            "index_id",
            F.col("name").alias("index_name"),
            F.col("type").alias("_index_type"),
            F.col("type_desc").alias("index_type_desc"),
        ),
        named,
        [*keys, "object_id"],
        "inner",
    )


def allocations(
    tables, schemas, indexes, partitions, row_groups, alloc_units, keys=(), ordered: bool = True
) -> DataFrame:
    """Allocation units of rowstore indexes and of the delta stores of columnstore indexes.

    A unit belongs to a partition by one of two identifiers depending on its type. Both identifiers
    and the delta stores meet the allocation units in a single equi-join.
    """
    keys = list(keys)
    place = [*keys, "object_id", "index_id"]
    owned = _table_indexes(tables, schemas, indexes, keys)
    is_columnstore = F.col("_index_type").isin(*COLUMNSTORE_INDEX_TYPES)
    rowstore = lookup(
        partitions.select(*place, "partition_number", "hobt_id", "partition_id"),
        owned.filter(~is_columnstore),
        place,
        "inner",
    )
    delta_stores = lookup(
        row_groups.filter("delta_store_hobt_id IS NOT NULL").select(
            *place, "partition_number", F.col("delta_store_hobt_id").alias("hobt_id")
        ),
        owned.filter(is_columnstore),
        place,
        "inner",
    )
    units = alloc_units.select(
        *keys, "container_id", "type", "type_desc", "total_pages", "used_pages", "data_pages"
    )
    result = disjunctive_join(
        union_all(rowstore, delta_stores),
        units,
        [
            ("hobt_id", "container_id", F.col("type").isin(*ROW_ALLOCATIONS)),
            ("partition_id", "container_id", F.col("type").isin(*LOB_ALLOCATIONS)),
        ],
        keys,
    )
    result = report_order(result, ordered, *keys, "object_name", "index_id", "partition_number", "type")
    return result.select(
        *keys,
        "object_name",
        "index_name",
        "index_id",
        "index_type_desc",
        "partition_number",
        "type",
        "type_desc",
        "total_pages",
        "used_pages",
        "data_pages",
    )


def rowgroup_workset(
    tables, schemas, indexes, partitions, row_groups, *, schema=None, table=None, keys=()
) -> DataFrame:
    """Columnstore row groups with the names of their table and index.

    Several reports read it; cache it, or write it, when more than one of them is wanted.
    """
    keys = list(keys)
    place = [*keys, "object_id", "index_id"]
    named = lookup(
        tables.filter(optional_eq("name", table)).select(*keys, "object_id", "schema_id", F.col("name").alias("_table")),
        schemas.select(*keys, "schema_id", F.col("name").alias("_schema")),
        [*keys, "schema_id"],
    ).filter(F.lit(True) if schema is None else F.col("_schema") == schema)
    columnstores = lookup(
        indexes.filter(F.col("type").isin(*COLUMNSTORE_INDEX_TYPES)).select(
            *place, F.col("name").alias("index_name")
        ),
        named,
        [*keys, "object_id"],
        "inner",
    )
    placed = lookup(partitions.select(*place, "partition_number"), columnstores, place, "inner")
    groups = row_groups.select(
        *place,
        "partition_number",
        F.col("row_group_id").alias("rowgroup_id"),
        F.col("state_description").alias("state"),
        "deleted_rows",
        "size_in_bytes",
        "total_rows",
    )
    joined = lookup(groups, placed, [*place, "partition_number"], "inner")
    return joined.withColumn("table_name", qualified_name("_schema", "_table")).drop("_schema", "_table")


def rowgroup_detail(workset: DataFrame, keys=(), ordered: bool = True) -> DataFrame:
    """Every row group and how much of it is live."""
    shown = workset.withColumn("percent_full", pct(F.col("total_rows") - F.col("deleted_rows"), "total_rows"))
    return report_order(shown, ordered, *keys, "table_name", "partition_number", "rowgroup_id").select(
        *keys,
        "table_name",
        "index_name",
        "partition_number",
        "rowgroup_id",
        "state",
        "deleted_rows",
        "size_in_bytes",
        "total_rows",
        "percent_full",
    )


def rowgroup_rollup(workset: DataFrame, keys=(), ordered: bool = True) -> DataFrame:
    """Total and deleted rows per index."""
    total, deleted = F.col("ci_total_rows"), F.col("ci_deleted_rows")
    rolled = (
        workset.groupBy(*keys, "schema_id", "object_id", "table_name", "index_name")
        .agg(F.sum("total_rows").alias("ci_total_rows"), F.sum("deleted_rows").alias("ci_deleted_rows"))
        .withColumn("ci_percent_full", pct(total - deleted, total))
    )
    return report_order(rolled, ordered, *keys, "table_name", "index_name").select(
        *keys, "table_name", "index_name", "ci_total_rows", "ci_deleted_rows", "ci_percent_full"
    )


def rowgroup_fragments(
    workset: DataFrame, *, full_rows: int = FULL_ROW_GROUP, keys=(), ordered: bool = True
) -> DataFrame:
    """Closed row groups below the full size against all closed ones, where there are any.

    Both counts come from one pass.
    """
    counted = (
        workset.filter(F.col("state") != OPEN_ROW_GROUP)
        .groupBy(*keys, "schema_id", "object_id", "table_name", "index_id", "index_name", "partition_number")
        .agg(
            F.count_if(F.col("total_rows") < full_rows).alias("fragments"),
            F.count("total_rows").alias("total_rowgroups"),
        )
        .filter("fragments > 0")
    )
    return report_order(counted, ordered, *keys, "table_name", "index_name", "partition_number").select(
        *keys, "table_name", "index_name", "partition_number", "fragments", "total_rowgroups"
    )
