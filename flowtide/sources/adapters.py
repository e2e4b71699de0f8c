"""Adapters that present the driver's parquet tables as network telemetry.

The same derivations are written as SQL in ``flowtide.plans.oracle`` so an
independent engine can check every query.  Only the columns a query needs are
selected, so Catalyst prunes the parquet scan to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# l_shipdate completes a unique key at every scale; used for ordering only
FLOW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def flows_from_lineitem(lineitem: DataFrame, with_label: bool = False, with_direct_loss: bool = False) -> DataFrame:
    """lineitem rows as flow records (canonical flow columns)."""
    cols = [F.col(c) for c in FLOW_ORDER] + [
        F.col("l_extendedprice").alias("flow_duration"),
        F.col("l_quantity").alias("total_fwd_packets"),
        (F.col("l_partkey") % 51).cast("double").alias("total_backward_packets"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") * (1 + F.col("l_suppkey") % 97)).alias(
            "flow_bytes_s"
        ),
        (F.col("l_quantity") + (F.col("l_partkey") % 51).cast("double") + 1).alias("flow_packets_s"),
    ]
    if with_label:
        cols.append(
            F.when(F.col("l_returnflag") == "R", " DDoS ")
            .when(F.col("l_returnflag") == "A", "benign")
            .otherwise("BENIGN")
            .alias("label")
        )
    if with_direct_loss:
        cols.append(((F.col("l_tax") - 0.02) * 100).alias("Loss Rate"))
    return lineitem.select(*cols)


def model_inputs_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Uploaded-style model inputs, deliberately partly out of range."""
    return lineitem.select(
        *FLOW_KEYS,
        (F.col("l_extendedprice") / 10).alias("latency"),
        (F.col("l_discount") * 12).alias("throughput"),
        (F.col("l_tax") * 14 - 0.1).alias("packet_loss"),
    )


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """events as an ordered network time series (order key ``ts``, unique)."""
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("entity"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("congestion"),
        F.col("value").alias("latency"),
    )


def tower_loads_from_supplier(supplier: DataFrame) -> DataFrame:
    """suppliers as towers with loads 30-95 spread by account balance.

    The table-wide min/max is a two-value global aggregate joined back by
    broadcast (bounded: one row).
    """
    s = supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    ext = s.agg(F.min("s_acctbal").alias("_mn"), F.max("s_acctbal").alias("_mx"))
    return s.crossJoin(F.broadcast(ext)).select(
        (F.col("s_nationkey") % 5).cast("bigint").alias("cell"),
        F.col("s_suppkey").alias("tower"),
        (30 + 65 * (F.col("s_acctbal") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).alias("load"),
    )


def states_from_features(features: DataFrame, prob: str = "risk") -> DataFrame:
    """What-if input states from engineered flow features.

    ``prob='risk'`` uses the risk score as the scored probability (it spans all
    alert tiers on the test data); ``'heuristic'`` uses the simulator formula.
    """
    from ..functions.columns import heuristic_probability, risk_score

    mbps = F.col("throughput") * 1000
    load = 10 + 90 * ((F.col("l_suppkey") % 97) / 96.0)
    p = (
        risk_score(F.col("latency"), F.col("throughput"), F.col("packet_loss"))
        if prob == "risk"
        else heuristic_probability(F.col("latency"), F.col("packet_loss"), mbps)
    )
    return features.select(
        *FLOW_KEYS,
        "latency",
        F.col("throughput").alias("throughput_ratio"),
        mbps.alias("throughput_mbps"),
        "packet_loss",
        load.alias("tower_load"),
        p.alias("prob"),
    )
