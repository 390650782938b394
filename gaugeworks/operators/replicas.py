"""Replication reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import CONFIGURATION_ONLY_MODE, PRIMARY_ROLE, ZERO_TIME
from gaugeworks.functions.predicates import optional_eq
from gaugeworks.functions.scalars import boundary_diff, coalesce_time, ratio
from gaugeworks.plans.relational import lookup, report_order


def replica_inventory(
    groups: DataFrame,
    group_states: DataFrame,
    cluster_states: DataFrame,
    replicas: DataFrame,
    replica_states: DataFrame,
    listeners: DataFrame,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Every replica with its role, modes, connections and listener."""
    keys = list(keys)
    live = lookup(
        groups.select(*keys, "group_id", F.col("name").alias("group_name")),
        group_states.select(*keys, "group_id"),
        [*keys, "group_id"],
        "inner",
    )
    placed = lookup(
        cluster_states.select(*keys, "group_id", "replica_id", F.col("replica_server_name").alias("replica")),
        live,
        [*keys, "group_id"],
        "inner",
    ).drop("group_id")
    described = lookup(placed, replicas.drop("replica_server_name"), [*keys, "replica_id"], "inner")
    described = lookup(
        described,
        replica_states.select(*keys, "replica_id", F.col("role_desc").alias("role")),
        [*keys, "replica_id"],
        "inner",
    )
    described = lookup(
        described,
        listeners.select(*keys, "group_id", F.col("dns_name").alias("listener")),
        [*keys, "group_id"],
    )
    described = report_order(described, ordered, *keys, "group_name", "replica")
    return described.select(
        *keys,
        "group_name",
        "replica",
        "role",
        F.replace("availability_mode_desc", F.lit("_"), F.lit(" ")).alias("mode"),
        F.col("failover_mode_desc").alias("failover_mode"),
        F.col("primary_role_allow_connections_desc").alias("connections_in_primary_role"),
        F.col("secondary_role_allow_connections_desc").alias("connections_in_secondary_role"),
        F.col("seeding_mode_desc").alias("seeding_mode"),
        "endpoint_url",
        "listener",
    )


# What a missing reading is shown as.
MISSING_READINGS = {
    "database_id": 0,
    "end_of_log_lsn": 0,
    "filestream_send_rate": -1,
    "is_failover_ready": False,
    "is_database_joined": False,
    "is_suspended": False,
    "last_commit_lsn": 0,
    "last_hardened_lsn": 0,
    "last_received_lsn": 0,
    "last_redone_lsn": 0,
    "last_sent_lsn": 0,
    "log_send_queue_size": -1,
    "log_send_rate": -1,
    "recovery_lsn": 0,
    "redo_queue_size": -1,
    "availability_mode": 2,
    "role": 3,
    "suspend_reason": 7,
    "synchronization_state": 0,
    "truncation_lsn": 0,
}
READING_TIMES = (
    "last_commit_time",
    "last_hardened_time",
    "last_received_time",
    "last_redone_time",
    "last_sent_time",
)


def replica_latency(
    groups: DataFrame,
    replicas: DataFrame,
    db_cluster: DataFrame,
    replica_states: DataFrame,
    db_states: DataFrame,
    *,
    group: str | None = None,
    keys=(),
    ordered: bool = True,
) -> DataFrame:
    """Estimated data loss, recovery time and send performance of every replicated database.

    The primary's last commit is first reduced to one row per replicated database.
    """
    keys = list(keys)
    primary_replicas = replica_states.filter(F.col("role") == PRIMARY_ROLE).select(*keys, "replica_id")
    primary = (
        lookup(
            db_states.select(*keys, "replica_id", "group_database_id", "last_commit_time"),
            primary_replicas,
            [*keys, "replica_id"],
            "left_semi",
        )
        .groupBy(*keys, "group_database_id")
        .agg(F.max("last_commit_time").alias("_primary_commit"))
    )
    named = groups.filter(optional_eq("name", group)).select(*keys, "group_id", F.col("name").alias("group_name"))
    members = lookup(
        replicas.filter(F.col("availability_mode") != CONFIGURATION_ONLY_MODE).select(
            *keys, "replica_id", "group_id", "replica_server_name", "availability_mode"
        ),
        named,
        [*keys, "group_id"],
        "inner",
    )
    members = lookup(
        members, replica_states.select(*keys, "replica_id", "role", "is_local"), [*keys, "replica_id"], "inner"
    )
    rows = lookup(db_cluster, members, [*keys, "replica_id"], "inner")
    rows = lookup(rows, db_states, [*keys, "replica_id", "group_database_id"])
    rows = lookup(rows, primary, [*keys, "group_database_id"])

    is_primary = F.col("is_primary_replica")
    queue, rate, send_rate = F.col("redo_queue_size"), F.col("redo_rate"), F.col("log_send_rate")
    behind = F.coalesce(boundary_diff("second", "last_commit_time", "_primary_commit"), F.lit(-2))
    loss = F.when(is_primary, F.lit(1)).when(F.col("is_failover_ready"), F.lit(0)).otherwise(behind)
    recovery = (
        F.when(is_primary, F.lit(-1.0))
        .when(queue.isNull(), F.lit(-2.0))
        .when(queue == 0, F.lit(0.0))
        .otherwise(F.coalesce(ratio(queue, rate), F.lit(-2.0)))
    )
    sending = F.when(send_rate != 0, ratio("log_send_queue_size", send_rate))
    rows = rows.withColumns(
        {
            "estimated_data_loss": loss.cast("bigint"),
            "estimated_recovery_time": recovery.cast("float"),
            "synchronization_performance": F.coalesce(sending, F.lit(-1.0)).cast("float"),
        }
    ).withColumns(
        {
            **{
                name: F.coalesce(F.col(name), F.lit(value).cast(rows.schema[name].dataType))
                for name, value in MISSING_READINGS.items()
            },
            **{name: coalesce_time(name, ZERO_TIME) for name in READING_TIMES},
        }
    )
    rows = report_order(rows, ordered, *keys, "replica_server_name", "database_name")
    return rows.select(
        *keys,
        "replica_server_name",
        "database_name",
        "group_database_id",
        "group_id",
        "group_name",
        "replica_id",
        "estimated_data_loss",
        "estimated_recovery_time",
        "synchronization_performance",
        "is_local",
        *MISSING_READINGS,
        *READING_TIMES,
    )
