"""Column-level building blocks (pure Spark expressions, no UDFs)."""

from . import constants
from .columns import (
    alert_tier,
    class_label,
    clip,
    col,
    finite,
    heuristic_probability,
    is_finite,
    nan_to_null,
    network_state,
    post_state,
    risk_score,
    round_doubles,
    safe_div,
    to_number,
)

__all__ = [
    "alert_tier", "class_label", "clip", "col", "constants", "finite", "heuristic_probability", "is_finite",
    "nan_to_null", "network_state", "post_state", "risk_score", "round_doubles", "safe_div", "to_number",
]
