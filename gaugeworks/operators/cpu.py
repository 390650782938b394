"""Worker, thread and scheduler reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import MIRRORING_COMMAND, ONLINE_SCHEDULER
from gaugeworks.plans.relational import merge_totals, report_order


def thread_totals(sys_info: DataFrame, threads: DataFrame, workers: DataFrame, keys=()) -> DataFrame:
    """Allowed workers, worker threads and threads in one row."""
    allowed = sys_info.groupBy(*keys).agg(F.max("max_workers_count").cast("bigint").alias("max_workers_count"))
    counted_workers = workers.groupBy(*keys).agg(F.count("*").alias("total_worker_threads"))
    counted_threads = threads.groupBy(*keys).agg(F.count("*").alias("total_threads_used"))
    return merge_totals([allowed, counted_workers, counted_threads], keys)


def scheduler_totals(schedulers: DataFrame, keys=()) -> DataFrame:
    """Workers of all online schedulers."""
    online = schedulers.filter(F.col("status") == ONLINE_SCHEDULER)
    return online.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("current_workers_count", "active_workers_count")]
    )


def scheduler_detail(schedulers: DataFrame, keys=(), ordered: bool = True) -> DataFrame:
    """Every online scheduler."""
    online = schedulers.filter(F.col("status") == ONLINE_SCHEDULER)
    return report_order(online, ordered, *keys, "scheduler_id").select(
        *keys,
        "scheduler_id",
        "status",
        "cpu_id",
        "is_online",
        "is_idle",
        "current_tasks_count",
        "runnable_tasks_count",
        "current_workers_count",
        "active_workers_count",
        "pending_disk_io_count",
        "load_factor",
        "work_queue_count",
    )


def requests_by_command(requests: DataFrame, command: str = MIRRORING_COMMAND, keys=()) -> DataFrame:
    """Requests that run one command."""
    return requests.filter(F.col("command") == command).select(
        *keys, "session_id", "status", "command", "wait_type"
    )


def worker_status(workers: DataFrame, keys=()) -> DataFrame:
    """State of every worker."""
    return workers.select(
        *keys,
        "worker_address",
        "scheduler_address",
        "state",
        "is_preemptive",
        "is_fiber",
        "is_sick",
        "is_in_cc_exception",
        "is_fatal_exception",
        "return_code",
    )
