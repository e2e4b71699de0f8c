"""SQL text of the adapter views and shared steps, for the independent-engine oracle.

These strings are the *specification* side of every check: the same data
derivations the Spark code performs, written once more as plain SQL.
"""

from __future__ import annotations

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"


FLOWS = """flows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
         l_extendedprice AS flow_duration,
         l_quantity AS total_fwd_packets,
         CAST(l_partkey % 51 AS DOUBLE) AS total_backward_packets,
         l_extendedprice * (1 - l_discount) / l_quantity * (1 + l_suppkey % 97) AS flow_bytes_s,
         l_quantity + CAST(l_partkey % 51 AS DOUBLE) + 1 AS flow_packets_s,
         CASE WHEN l_returnflag = 'R' THEN ' DDoS ' WHEN l_returnflag = 'A' THEN 'benign' ELSE 'BENIGN' END AS label,
         (l_tax - 0.02) * 100 AS loss_rate
  FROM lineitem)"""

KPIS = """kp AS (
  SELECT *, greatest(flow_duration, 0) AS dur, greatest(total_fwd_packets, 0) AS fwd,
         greatest(total_backward_packets, 0) AS bwd, greatest(flow_bytes_s, 0) AS raw_throughput
  FROM flows),
kp2 AS (SELECT *, fwd + bwd AS total_packets, dur / (fwd + bwd + 1) AS raw_latency FROM kp)"""

PROFILE = """fp AS (
  SELECT quantile_cont(raw_latency, 0.99) AS lq, max(raw_latency) AS lmax,
         quantile_cont(raw_throughput, 0.99) AS tq, max(raw_throughput) AS tmax,
         quantile_cont(fwd, 0.95) AS fq, max(fwd) AS fmax
  FROM kp2),
fs AS (
  SELECT CASE WHEN lq > 0 THEN lq WHEN lmax > 0 THEN lmax ELSE 1.0 END AS lc,
         CASE WHEN tq > 0 THEN tq WHEN tmax > 0 THEN tmax ELSE 1.0 END AS tc,
         CASE WHEN fq > 0 THEN fq WHEN fmax > 0 THEN fmax ELSE 1.0 END AS fc
  FROM fp)"""

INFERRED_LOSS = (
    "least(greatest(least(greatest(greatest(fwd - bwd, 0) / (fwd + 1), 0), 1)"
    " * least(greatest(ln(1 + fwd) / ln(1 + fc), 0), 1), 0), 1)"
)

FEATURES = f"""fe AS (
  SELECT kp2.*, least(raw_latency, lc) / lc * 5000 AS latency,
         ln(1 + least(raw_throughput, tc)) / ln(1 + tc) AS throughput,
         {INFERRED_LOSS} AS packet_loss
  FROM kp2, fs)"""


def risk(lat: str = "latency", tp: str = "throughput", loss: str = "packet_loss") -> str:
    """Risk score on model-range inputs (inputs are clipped first)."""
    L = f"(least(greatest({lat}, 0), 5000) / 5000.0)"
    T = f"least(greatest({tp}, 0), 1)"
    P = f"least(greatest({loss}, 0), 1)"
    return f"least(greatest(0.3 * {L} + 0.15 * {T} + 0.4 * {P} + 0.05 * sqrt({L} * {T}) + 0.1 * sqrt({P} * {T}), 0), 1)"


SCORED = f"""sc AS (SELECT *, {risk()} AS congestion_score FROM fe),
th AS (SELECT quantile_cont(congestion_score, 0.75) AS p75 FROM sc),
feat AS (
  SELECT sc.*, CAST(congestion_score >= (CASE WHEN p75 > 0 THEN p75 ELSE 0.5 END) AS INTEGER) AS congestion
  FROM sc, th)"""


def heuristic(lat: str, loss: str, mbps: str) -> str:
    return f"least(greatest(({lat} / 5000.0) * 0.4 + ({loss} / 1.0) * 0.4 + (1.0 - least({mbps} / 1000.0, 1.0)) * 0.2, 0.0), 1.0)"


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


FEAT_CTES = [FLOWS, KPIS, PROFILE, FEATURES, SCORED]

STATES = """st AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, latency, throughput AS throughput_ratio,
         throughput * 1000 AS throughput_mbps, packet_loss,
         10 + 90 * (CAST(l_suppkey % 97 AS DOUBLE) / 96.0) AS tower_load, congestion_score AS prob
  FROM feat)"""

VISUAL = """vq AS (SELECT quantile_cont(latency, 0.99) AS l99, quantile_cont(throughput, 0.99) AS t99 FROM feat),
vis AS (
  SELECT feat.*, least(greatest(latency, 0), l99) AS vlat, least(greatest(throughput, 0), t99) AS vtp,
         least(greatest(packet_loss, 0), 1) AS vloss,
         ln(1 + least(greatest(latency, 0), l99)) AS log_latency,
         ln(1 + least(greatest(throughput, 0), t99)) AS log_throughput
  FROM feat, vq)"""

TELEMETRY = """tel AS (
  SELECT event_id, ts, user_id AS entity, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS congestion,
         value AS latency
  FROM events),
trend0 AS (
  SELECT event_id, ts, latency,
         avg(CAST(congestion AS DOUBLE) * 100.0) OVER (ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling_congestion,
         avg(latency) OVER (ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS latency_rolling,
         row_number() OVER (ORDER BY ts) - 1 AS idx
  FROM tel),
trend AS (
  SELECT *, avg(rolling_congestion) OVER (ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling_mean
  FROM trend0),
spk AS (SELECT quantile_cont(rolling_congestion, 0.9) AS thr, count(*) AS n FROM trend)"""

TOWER_LOADS = """sup AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier),
ext AS (SELECT min(s_acctbal) AS mn, max(s_acctbal) AS mx FROM sup),
tl AS (
  SELECT CAST(s_nationkey % 5 AS BIGINT) AS cell, s_suppkey AS tower,
         30 + 65 * (s_acctbal - mn) / (mx - mn) AS load
  FROM sup, ext)"""

MODEL_INPUTS = """mi AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_extendedprice / 10 AS latency, l_discount * 12 AS throughput, l_tax * 14 - 0.1 AS packet_loss
  FROM lineitem),
mip AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         least(greatest(latency, 0), 5000) AS latency, least(greatest(throughput, 0), 1) AS throughput,
         least(greatest(packet_loss, 0), 1) AS packet_loss
  FROM mi)"""
