"""Fixed values that the library and its SQL checks share, written out once more."""

from gaugeworks import constants as C
from gaugeworks.operators import replicas


def test_codes():
    assert C.TRANSACTION_STATES == {
        0: "Invalid", 1: "Initialized", 2: "Active", 3: "Ended", 4: "Commit Started", 5: "Prepared", 6: "Committed",
        7: "Rolling Back", 8: "Rolled Back",
    }
    assert C.DTC_STATES == {1: "Active", 2: "Prepared", 3: "Committed", 4: "Aborted", 5: "Recovered"}
    assert C.ISOLATION_LEVELS == {
        0: "Unspecified", 1: "ReadUncommitted", 2: "ReadCommitted", 3: "Repeatable", 4: "Serializable", 5: "Snapshot",
    }


def test_scales():
    assert C.METRIC_SCALES == {
        "cpu_time": 1 / 1000, "duration": 1 / 1000, "logical_io_reads": 8, "logical_io_writes": 8, "log_bytes_used": 1 / 1024,
        "query_max_used_memory": 8, "physical_io_reads": 8, "rowcount": 1, "tempdb_space_used": 8, "clr_time": 1 / 1000,
    }


def test_unknown_readings():
    minus = {"filestream_send_rate", "log_send_queue_size", "log_send_rate", "redo_queue_size"}
    other = {"availability_mode": 2, "role": 3, "suspend_reason": 7, "is_failover_ready": False, "is_database_joined": False, "is_suspended": False}
    for name, value in replicas.MISSING_READINGS.items():
        assert value == (-1 if name in minus else other.get(name, 0)), name
    assert replicas.READING_TIMES == tuple(f"last_{w}_time" for w in ("commit", "hardened", "received", "redone", "sent"))
