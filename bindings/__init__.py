"""The reports bound to the driver's test tables."""

from bindings import events, fleet, memory, options, pieces, replicas, sessions, storage, streaming, workload

MODULES = (workload, sessions, events, replicas, storage, memory, streaming, pieces, options, fleet)
