"""Database telemetry reports as Spark jobs.

Every report is a plain function from DataFrames to a DataFrame. The inputs are exported snapshots
of a database server's monitoring views; ``keys`` (for example ``("instance_id", "captured_at")``)
names extra columns that identify one snapshot, so one call covers the history of a whole fleet.
"""

from gaugeworks.operators import (
    cpu,
    events,
    memory,
    replicas,
    sessions,
    statistics,
    storage,
    workload,
)

__all__ = [
    "cpu",
    "events",
    "memory",
    "replicas",
    "sessions",
    "statistics",
    "storage",
    "workload",
]
