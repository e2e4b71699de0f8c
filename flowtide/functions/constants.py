"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a fixed value (thresholds, names, weights,
candidate lists).  Logic lives elsewhere; keep these plain and in their
natural order so they can be audited at a glance.
"""

# --- fixed values: model feature contract -----------------------------------
FEATURES = ["latency", "throughput", "packet_loss"]
LATENCY_MAX = 5000.0
THROUGHPUT_MAX = 1.0
LOSS_MAX = 1.0

# --- fixed values: canonical flow columns and the raw CSV headers they come from
RAW_HEADER_NAMES = {
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_backward_packets",
    "Flow Bytes/s": "flow_bytes_s",
    "Flow Packets/s": "flow_packets_s",
    "Label": "label",
}
REQUIRED_FLOW_COLUMNS = ["flow_duration", "total_fwd_packets", "total_backward_packets", "flow_bytes_s"]
CLEANING_COLUMNS = ["flow_duration", "flow_bytes_s", "flow_packets_s"]  # cut order matters
DIRECT_LOSS_CANDIDATES = [
    "packet_loss",
    "Packet Loss",
    "PacketLoss",
    "Loss Rate",
    "Packet Loss Rate",
    "packet_loss_rate",
]
LABEL_CANDIDATES = ["label", "Label", " Label"]
BENIGN_LABEL = "BENIGN"

# --- fixed values: risk score weights (latency, pressure, loss, lat x tp, loss x tp)
RISK_WEIGHTS = (0.30, 0.15, 0.40, 0.05, 0.10)
LABEL_LOSS_FLOOR = 0.30

# --- fixed values: quantile levels used by the scaling and diagnosis rules
CLEAN_CUT_Q = 0.995
SCALE_Q = 0.99
FWD_CONFIDENCE_Q = 0.95
TARGET_Q = 0.75
TOP_SHARE = 0.25

# --- fixed values: heuristic probability (latency, loss, missing bandwidth)
HEURISTIC_WEIGHTS = (0.4, 0.4, 0.2)
MBPS_MAX = 1000.0

# --- fixed values: alert tiers (strict greater-than)
CRITICAL_ABOVE = 0.70
WARNING_ABOVE = 0.40
CONGESTED_ABOVE = 0.50

# --- fixed values: safety overrides on (prediction, probability)
QUIET_LATENCY_MAX = 50.0
QUIET_LOSS_MAX = 0.02
QUIET_PROB_CAP = 0.02
OVERRIDE_HIGH = 0.95
OVERRIDE_MID = 0.80

# --- fixed values: towers
TOWER_LABELS = ["A", "B", "C"]
OVERLOAD_ABOVE = 75.0
UNDERLOAD_BELOW = 60.0
TOWER_PLAN = [
    (75.0, "Critical congestion", "Upgrade tower capacity and add a new node"),
    (60.0, "Moderate congestion", "Monitor usage and prepare load balancing"),
    (None, "Stable load", "Monitor usage"),
]

# --- fixed values: diagnosis texts
CAUSE_LOSS = "High packet loss → unstable transmission"
CAUSE_LATENCY = "High latency → routing delay"
CAUSE_THROUGHPUT = "Low throughput → bandwidth bottleneck"
CAUSE_MULTI = "Model detected multi-factor congestion risk"
CAUSE_NONE = "No major issue detected"
SUGGEST_LOSS = "Check cables, hardware, and reduce packet drops"
SUGGEST_LATENCY = "Optimize routing paths or reduce hops"
SUGGEST_THROUGHPUT = "Increase bandwidth or load balance traffic"
SUGGEST_URGENT = "Immediate load balancing required"
SUGGEST_INVESTIGATE = "Investigate model-highlighted congestion and monitor affected flows"
SUGGEST_NORMAL = "System operating normally"
DIAG_LOSS_ABS = 0.30
DIAG_LOSS_Q = 0.90
DIAG_LATENCY_Q = 0.75
DIAG_THROUGHPUT_Q = 0.25
URGENT_ABOVE = 0.9

# --- fixed values: what-if actions and mid-point effects
ACTIONS = ["reroute_traffic", "increase_bandwidth", "reduce_load", "rebalance_towers", "do_nothing"]
# action -> (latency factor, Mbps factor, loss factor, load factor or None)
ACTION_EFFECTS = {
    "reroute_traffic": (0.675, 1.10, 0.85, None),
    "increase_bandwidth": (0.95, 1.40, 1.0, None),
    "reduce_load": (0.90, 1.10, 0.60, None),
    "rebalance_towers": (0.90, 1.0, 1.0, 0.675),
    "do_nothing": (1.0, 1.0, 1.0, None),
}
REBALANCE_FLOOR = 30.0
STATE_BOUNDS = {"latency": (5.0, 5000.0), "throughput": (10.0, 1000.0), "packet_loss": (0.0, 1.0), "tower_load": (10.0, 100.0)}
STATE_DEFAULTS = {"latency": 100.0, "throughput": 200.0, "packet_loss": 0.05, "tower_load": 60.0}
BATCH_TOWER_LOAD = 70.0
POST_TOWER_LOAD = 60.0
PROJECTION_STEPS = 10
HISTORY_CAP = 20

# priority policy thresholds
IDLE_BELOW = 0.08
PRIORITY_LOSS_ABOVE = 0.10
PRIORITY_LATENCY_ABOVE = 200.0
PRIORITY_MBPS_BELOW = 700.0
PRIORITY_LOAD_ABOVE = 65.0
PRIORITY_FALLBACK = ["reroute_traffic", "increase_bandwidth"]

# rule policy thresholds
RULE_LOAD_AT_LEAST = 80.0
RULE_PROB_AT_LEAST = 0.75
RULE_LOSS_AT_LEAST = 8.0
RULE_MBPS_AT_MOST = 300.0
RULE_LATENCY_AT_LEAST = 100.0

# reward
REWARD_IDLE_OK = 10.0
REWARD_GAIN_SCALE = 50.0
REWARD_NO_GAIN = -2.0
REWARD_LATENCY_BETTER = 2.0
REWARD_MBPS_BETTER = 1.0
REWARD_IDLE_BAD = -3.0

STRATEGIES = ["RL Agent", "Greedy", "Random", "Rule-based"]

# state discretisation: 6 bins per field over these ranges (7 edges)
STATE_BIN_RANGES = {
    "latency": (5.0, 5000.0),
    "throughput": (10.0, 1000.0),
    "packet_loss": (0.0, 1.0),
    "tower_load": (0.0, 100.0),
    "congestion_probability": (0.0, 1.0),
}
STATE_BIN_COUNT = 6

# --- fixed values: model training
RF_CANDIDATES = [
    {"numTrees": 200, "maxDepth": 12, "min_samples_split": 15, "minInstancesPerNode": 6},
    {"numTrees": 200, "maxDepth": 15, "min_samples_split": 10, "minInstancesPerNode": 4},
    {"numTrees": 200, "maxDepth": 8, "min_samples_split": 50, "minInstancesPerNode": 20},
    {"numTrees": 200, "maxDepth": 4, "min_samples_split": 200, "minInstancesPerNode": 80},
    {"numTrees": 200, "maxDepth": 3, "min_samples_split": 300, "minInstancesPerNode": 120},
    {"numTrees": 200, "maxDepth": 2, "min_samples_split": 500, "minInstancesPerNode": 200},
]
ACCURACY_BAND = (0.85, 0.99)
MODEL_SEED = 42
SPLIT_SEED = 99
MIN_ACCURACY = 0.80
ROW_FIT_ROWS = 1_000_000  # up to so many rows a forest is fitted row by row; the rows of more are counted in cells first
MIN_IMPORTANCE = {"latency": 0.12, "throughput": 0.08, "packet_loss": 0.10}
MIN_PROBABILITY_DELTA = {"latency": 0.03, "packet_loss": 0.08}
PROBES = [
    ("healthy", 0.0, 1.0, 0.0),
    ("high_latency", 4500.0, 0.85, 0.01),
    ("high_throughput", 100.0, 1.0, 0.01),
    ("high_packet_loss", 100.0, 0.85, 0.85),
    ("combined_failure", 4500.0, 0.05, 0.85),
]
QUALITY_MIN_STD = 1e-9
CORRELATION_BAND = 0.30

# --- fixed values: dashboard windows and bins
ROLLING_WINDOW = 50
SPIKE_Q = 0.90
RECENT_ROWS = 50
LEGACY_ROLLING = 3
HIST_BINS = 40
DENSITY_GRID = 100
LOAD_RATIO_EPS = 1e-6

# --- fixed values: report recommendations (final probability, final latency)
RECOMMEND_CONGESTED = "Prioritize tower rebalancing, loss reduction, and bandwidth expansion before accepting more traffic."
RECOMMEND_LATENCY = "Keep rerouting active and review routing paths for avoidable delay."
RECOMMEND_MONITOR = "Continue monitoring."
REPORT_METRICS = ["Latency", "Throughput", "Packet Loss", "Congestion Probability"]
