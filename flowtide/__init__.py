"""flowtide: Spark-native network congestion analytics.

DataFrame-in / DataFrame-out operators for flow telemetry: cleaning, KPI
features with table-wide quantile scaling, congestion targets, diagnostics,
ordered rolling windows, tower analytics, scoring rules, deterministic what-if
projections, distributed model training and exact feature attribution.
"""

__version__ = "0.1.0"
