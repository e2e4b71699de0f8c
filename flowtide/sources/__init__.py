"""Sources, sinks and adapters."""

from .adapters import (
    FLOW_KEYS,
    FLOW_ORDER,
    flows_from_lineitem,
    model_inputs_from_lineitem,
    states_from_features,
    telemetry_from_events,
    tower_loads_from_supplier,
)
from .flows import read_flow_csv, read_table, strip_headers, union_sources, write_report

__all__ = [
    "FLOW_KEYS", "FLOW_ORDER", "flows_from_lineitem", "model_inputs_from_lineitem", "read_flow_csv", "read_table",
    "states_from_features", "strip_headers", "telemetry_from_events", "tower_loads_from_supplier", "union_sources",
    "write_report",
]
