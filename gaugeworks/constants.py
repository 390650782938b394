"""Codes, names and limits given by the telemetry producer and the report definitions."""

# Transaction states.
TRANSACTION_STATES = {
    0: "Invalid",
    1: "Initialized",
    2: "Active",
    3: "Ended",
    4: "Commit Started",
    5: "Prepared",
    6: "Committed",
    7: "Rolling Back",
    8: "Rolled Back",
}

# Distributed transaction states, and the transaction type they apply to.
DTC_STATES = {1: "Active", 2: "Prepared", 3: "Committed", 4: "Aborted", 5: "Recovered"}
DISTRIBUTED_TRANSACTION_TYPE = 4

# Isolation levels.
ISOLATION_LEVELS = {
    0: "Unspecified",
    1: "ReadUncommitted",
    2: "ReadCommitted",
    3: "Repeatable",
    4: "Serializable",
    5: "Snapshot",
}

# Session texts.
IDLE_COMMAND = "AWAITING COMMAND"
CURSOR_FETCH_PATTERN = "FETCH API_CURSOR%"
MIRRORING_COMMAND = "DB MIRROR"
VIRTUAL_NETWORK_LISTENER = "VNN"
DISTRIBUTED_NETWORK_LISTENER = "DNN"

# Workload metrics with the factor that turns the stored unit into the shown one.
METRIC_SCALES = {
    "cpu_time": 0.001,  # microseconds to milliseconds
    "duration": 0.001,
    "logical_io_reads": 8,  # 8-KB pages to KB
    "logical_io_writes": 8,
    "log_bytes_used": 0.0009765625,  # bytes to KB
    "query_max_used_memory": 8,
    "physical_io_reads": 8,
    "rowcount": 1,
    "tempdb_space_used": 8,
    "clr_time": 0.001,
}
MAX_EVENT_FILE_BYTES = 50 << 20  # an event file of a capture
CAPTURE_ON = 2  # actual_state of a workload capture that is reading and writing
ABORTED_EXECUTION = 3  # execution_type of an aborted execution

# Event names, attributes and counters.
DEADLOCK_EVENT = "xml_deadlock_report"
DEPRECATION_EVENTS = ("deprecation_announcement", "deprecation_final_support")
DEPRECATION_FIELDS = (
    # output column, kind of item, item name, type
    ("feature", "data", "feature", "string"),
    ("message", "data", "message", "string"),
    ("client_hostname", "action", "client_hostname", "string"),
    ("client_app_name", "action", "client_app_name", "string"),
    ("session_id", "action", "session_id", "int"),
    ("username", "action", "username", "string"),
    ("sql_text", "action", "sql_text", "string"),
)
DEPRECATED_COUNTER_TEXT = "Deprecated Features"
MEMORY_NODE_PATTERN = "%Memory Node%"
MEMORY_NODE_COUNTER = "database node memory (kb)"
BUFFER_NODE_PATTERN = "%Buffer Node%"
BUFFER_NODE_COUNTER = "page life expectancy"

# Storage codes and sizes.
INTERNAL_SPACE_TYPES = (202, 204, 211, 212, 213, 214, 215, 216)
QUEUE_TABLE_TYPE = 201
SPACE_OBJECT_TYPES = ("U", "S", "V", "SQ", "IT")
COLUMNSTORE_INDEX_TYPES = (5, 6)
ROW_ALLOCATIONS = (1, 3)
LOB_ALLOCATIONS = (2,)
FULL_ROW_GROUP = 1_048_576
OPEN_ROW_GROUP = "OPEN"

# Memory and scheduler settings.
MAX_MEMORY_SETTING = "max server memory (MB)"
RESOURCE_DATABASE_ID = 32767
RESOURCE_DATABASE_NAME = "MSResource"
UNKNOWN_BUFFER_NAME = "MS_Resource"
DATABASE_BUFFER_TYPE = "DATABASE_BUFFER"
ONLINE_SCHEDULER = "VISIBLE ONLINE"

# Replica codes that stand for "unknown" or "not applicable".
CONFIGURATION_ONLY_MODE = 4
PRIMARY_ROLE = 1
ZERO_TIME = "1900-01-01 00:00:00"
