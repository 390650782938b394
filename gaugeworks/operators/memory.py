"""Memory reports: caches, buffered pages, grants and page life."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import (
    BUFFER_NODE_COUNTER,
    BUFFER_NODE_PATTERN,
    DATABASE_BUFFER_TYPE,
    MAX_MEMORY_SETTING,
    MEMORY_NODE_COUNTER,
    MEMORY_NODE_PATTERN,
    RESOURCE_DATABASE_ID,
    RESOURCE_DATABASE_NAME,
    UNKNOWN_BUFFER_NAME,
)
from gaugeworks.functions.predicates import moment
from gaugeworks.functions.scalars import (
    blank_to_null,
    duration_text,
    int_div,
    millis_between,
    pages_to_mb,
    pct,
    ratio,
)
from gaugeworks.plans.relational import (
    conditional_counts,
    lookup,
    report_order,
    top_k,
    union_all,
    with_scalar,
)


def memory_breakdown(
    caches: DataFrame,
    buffers: DataFrame,
    config: DataFrame,
    databases: DataFrame,
    *,
    n: int = 20,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """The ``n`` largest caches and the buffered pages of every database, in MB and as a share.

    Pages are counted per database id on the map side; names are looked up for the counts only.
    """
    keys = list(keys)
    size = (F.col("pages_kb") / F.lit(1024.0)).alias("_mb")
    largest = top_k(
        caches.select(*keys, F.left("name", F.lit(128)).alias("name"), "type", size, "entries_count"),
        [F.desc("_mb"), F.asc("name"), F.asc("type")],
        n,
        keys,
    )
    names = databases.select(*keys, "database_id", "name")
    counted = buffers.groupBy(*keys, "database_id").agg(F.count("*").alias("_pages"))
    buffered = (
        lookup(counted, names, [*keys, "database_id"])
        .groupBy(*keys, F.coalesce("name", F.lit(UNKNOWN_BUFFER_NAME)).alias("name"))
        .agg(pages_to_mb(F.sum("_pages")).alias("_mb"))
        .withColumn("type", F.lit(DATABASE_BUFFER_TYPE))
    )
    limit = config.filter(F.col("name") == MAX_MEMORY_SETTING).select(*keys, F.col("value_in_use").alias("_limit"))
    both = with_scalar(union_all(largest, buffered), limit, "_limit", keys)
    both = report_order(both, ordered, *keys, F.desc("_mb"), "name", "type")
    return both.select(
        *keys,
        "name",
        "type",
        pct("_mb", "_limit").alias("pct_server_memory"),
        F.col("_mb").cast("float").alias("cache_size_mb"),
        "entries_count",
    )


def buffer_usage(buffers: DataFrame, databases: DataFrame, keys=()) -> DataFrame:
    """Clean, dirty and all buffered MB per database; NULL where a class has no page."""
    counts = conditional_counts(
        buffers,
        [*keys, "database_id"],
        {"_clean": ~F.col("is_modified"), "_dirty": F.col("is_modified"), "_total": F.lit(True)},
    )
    name = F.when(F.col("database_id") == RESOURCE_DATABASE_ID, F.lit(RESOURCE_DATABASE_NAME)).otherwise(
        F.col("name")
    )
    return lookup(counts, databases.select(*keys, "database_id", "name"), [*keys, "database_id"]).select(
        *keys,
        name.alias("database_name"),
        *[pages_to_mb(f"_{c}").cast("float").alias(f"{c}_memory_mb") for c in ("clean", "dirty", "total")],
    )


def memory_grants(
    grants: DataFrame,
    requests: DataFrame,
    sessions: DataFrame,
    connections: DataFrame,
    inputs: DataFrame,
    plans: DataFrame,
    databases: DataFrame,
    *,
    as_of=None,
    exclude_session: int | None = None,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Memory grants with who asked for them, how long a pending one has waited, and the plan."""
    keys = list(keys)
    by_session, by_request = [*keys, "session_id"], [*keys, "session_id", "request_id"]
    asked = grants.drop("request_id", "query_cost")
    if exclude_session is not None:
        asked = asked.filter(F.col("session_id") != exclude_session)
    rows = lookup(asked, requests.select(*by_request, "database_id"), by_session, "inner")
    people = sessions.select(*by_session, "host_name", "login_name", "original_login_name")
    rows = lookup(rows, people, by_session, "inner")
    addresses = connections.select(
        *keys, F.col("most_recent_session_id").alias("session_id"), "client_net_address"
    )
    rows = lookup(rows, addresses, by_session, "inner")
    rows = lookup(rows, databases.select(*keys, "database_id", F.col("name").alias("database_name")), [*keys, "database_id"])
    rows = lookup(rows, inputs.select(*by_request, F.col("event_info").alias("text")), by_request, "inner")
    rows = lookup(rows, plans, [*keys, "plan_handle"], "inner")
    pending = F.when(
        F.col("grant_time").isNull(),
        duration_text(millis_between("request_time", moment(as_of)), zero_as_null=False),
    )
    return report_order(rows, ordered, *by_session).select(
        *by_session,
        "database_name",
        F.coalesce(blank_to_null("host_name"), "client_net_address").alias("host_name"),
        F.coalesce(blank_to_null("login_name"), "original_login_name").alias("login_name"),
        "granted_memory_kb",
        "requested_memory_kb",
        "ideal_memory_kb",
        "used_memory_kb",
        "max_used_memory_kb",
        "dop",
        "request_time",
        pending.alias("pending_grant_duration"),
        "grant_time",
        "text",
        "query_plan",
    )


def page_life(counters: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Page life expectancy of each memory node against a baseline of 300 s for every 4 GB.

    Both counters come from one pass over the counter table.
    """
    counter = F.lower("counter_name")
    memory = F.col("object_name").like(MEMORY_NODE_PATTERN) & (counter == MEMORY_NODE_COUNTER)
    life = F.col("object_name").like(BUFFER_NODE_PATTERN) & (counter == BUFFER_NODE_COUNTER)
    nodes = (
        counters.filter(memory | life)
        .groupBy(*keys, "instance_name")
        .agg(
            F.max(F.when(memory, int_div("cntr_value", 1024))).alias("buffer_size_mb"),
            F.max(F.when(life, F.col("cntr_value"))).alias("page_life"),
        )
        .filter("buffer_size_mb IS NOT NULL AND page_life IS NOT NULL AND instance_name IS NOT NULL")
    )
    baseline = int_div(int_div("buffer_size_mb", 1024), 4) * 300
    return nodes.select(
        *keys,
        "buffer_size_mb",
        "page_life",
        F.when(baseline == 0, F.lit(300).cast("bigint")).otherwise(baseline).alias("baseline_ple"),
        ratio("buffer_size_mb", "page_life").alias("mb_per_s"),
        F.col("instance_name").alias("numa_node"),
        moment(as_of).alias("snapshot"),
    )
