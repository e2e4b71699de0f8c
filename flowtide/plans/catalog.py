"""Named queries over the driver tables: Spark callables + oracle SQL.

Every key maps to ``fn(spark, sf_dir) -> DataFrame``; keys with an exact SQL
equivalent also carry the SQL text an independent engine runs on the same
parquet tables.  Outputs round doubles to 6 digits at the sink (engines differ
in the last bits of sums and transcendental functions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import round_doubles
from ..operators import clean, features as feat_ops
from ..operators.partitioning import spread
from ..operators.profile import Profile
from ..operators.store import stored_folder, stored_table
from ..sources import (
    FLOW_KEYS,
    FLOW_ORDER,
    flows_from_lineitem,
    model_inputs_from_lineitem,
    read_table,
    states_from_features,
    telemetry_from_events,
    tower_loads_from_supplier,
    union_sources,
)
from . import sqlparts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---- shared inputs -----------------------------------------------------------

def lineitem(spark, d):
    return spread(read_table(spark, d, "lineitem"))


def flows(spark, d, **kw):
    return flows_from_lineitem(lineitem(spark, d), **kw)


def _inputs(d: str, *tables: str) -> list[str]:
    return [f"{d}/{t}.parquet" for t in tables]


def _profile(spark, d, name: str, fit) -> Profile:
    return Profile.load(spark, stored_folder(spark, name, _inputs(d, "lineitem"), lambda at: fit().save(spark, at)))


def scored(spark, d) -> DataFrame:
    """Engineered flow features and their risk score: scales fitted and rows computed once,
    then read by every query until the table's files change (``operators.store``)."""

    def build():
        kpis = feat_ops.raw_kpis(flows(spark, d, with_label=True))
        scales = _profile(spark, d, "scales", lambda: feat_ops.fit_feature_profile(kpis))
        return feat_ops.with_risk_score(feat_ops.apply_feature_profile(kpis, scales)).drop(*feat_ops.HELPERS)

    return stored_table(spark, "scored", _inputs(d, "lineitem"), build)


def features(spark, d) -> DataFrame:
    """Scored features with the risk-score target."""
    rows = scored(spark, d)
    rule = _profile(spark, d, "target", lambda: Profile(feat_ops.fit_target(rows)))
    return feat_ops.apply_target(rows, rule)


def states(spark, d) -> DataFrame:
    return states_from_features(scored(spark, d), prob="risk")  # no state depends on the target


def telemetry(spark, d):
    return telemetry_from_events(read_table(spark, d, "events"))


def out(df: DataFrame) -> DataFrame:
    return round_doubles(df)


FEAT_WITH = S.with_ctes(*S.FEAT_CTES)
KEYS_SQL = S.KEYS

# ---- sources ------------------------------------------------------------------


@register(
    "scan_flows",
    S.with_ctes(S.FLOWS)
    + f"""SELECT {KEYS_SQL}, {S.r('flow_duration', 'flow_duration')}, {S.r('total_fwd_packets', 'total_fwd_packets')},
       {S.r('total_backward_packets', 'total_backward_packets')}, {S.r('flow_bytes_s', 'flow_bytes_s')},
       {S.r('flow_packets_s', 'flow_packets_s')} FROM flows""",
)
def scan_flows(spark, d):
    return out(flows(spark, d).drop("l_shipdate"))


@register(
    "union_sources",
    S.with_ctes(S.FLOWS)
    + f"""SELECT {KEYS_SQL}, {S.r('flow_duration', 'flow_duration')}, label, CAST(NULL AS DOUBLE) AS flow_bytes_s
FROM flows WHERE l_returnflag = 'R'
UNION ALL
SELECT {KEYS_SQL}, {S.r('flow_duration', 'flow_duration')}, CAST(NULL AS VARCHAR) AS label, {S.r('flow_bytes_s', 'flow_bytes_s')}
FROM flows WHERE l_returnflag <> 'R'""",
)
def union_sources_q(spark, d):
    li = lineitem(spark, d)
    a = flows_from_lineitem(li.where(F.col("l_returnflag") == "R"), with_label=True).select(*FLOW_KEYS, "flow_duration", "label")
    b = flows_from_lineitem(li.where(F.col("l_returnflag") != "R")).select(*FLOW_KEYS, "flow_duration", "flow_bytes_s")
    return out(union_sources([a, b]))


@register(
    "coerce_numeric",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_value,
       TRY_CAST(props AS DOUBLE) AS props_value
FROM events""",
)
def coerce_numeric_q(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "props")
    t = ev.withColumns({"k_text": F.get_json_object("props", "$.k"), "props_value": F.col("props")})
    t = clean.coerce_numeric(t.withColumn("k_value", F.col("k_text")), ["k_value", "props_value"])
    return out(t.select("event_id", "k_text", "k_value", "props_value"))


# ---- cleaning and scaling -------------------------------------------------------


@register(
    "clean_raw_flows",
    S.with_ctes(
        S.FLOWS,
        """c0 AS (SELECT * FROM flows WHERE flow_duration > 0 AND flow_bytes_s >= 0 AND flow_packets_s >= 0
            AND isfinite(flow_duration) AND isfinite(flow_bytes_s) AND isfinite(flow_packets_s))""",
        "c1 AS (SELECT * FROM c0 WHERE flow_duration <= (SELECT quantile_cont(flow_duration, 0.995) FROM c0))",
        "c2 AS (SELECT * FROM c1 WHERE flow_bytes_s <= (SELECT quantile_cont(flow_bytes_s, 0.995) FROM c1))",
        "c3 AS (SELECT * FROM c2 WHERE flow_packets_s <= (SELECT quantile_cont(flow_packets_s, 0.995) FROM c2))",
    )
    + f"SELECT {KEYS_SQL}, {S.r('flow_duration', 'flow_duration')}, {S.r('flow_bytes_s', 'flow_bytes_s')}, {S.r('flow_packets_s', 'flow_packets_s')} FROM c3",
)
def clean_raw_flows_q(spark, d):
    c = clean.clean_raw_flows(flows(spark, d))
    return out(c.select(*FLOW_KEYS, "flow_duration", "flow_bytes_s", "flow_packets_s"))


@register(
    "robust_minmax",
    S.with_ctes(S.FLOWS, "q AS (SELECT quantile_cont(flow_bytes_s, 0.01) AS lo, quantile_cont(flow_bytes_s, 0.99) AS hi FROM flows)")
    + f"SELECT {KEYS_SQL}, {S.r('least(greatest((flow_bytes_s - lo) / (hi - lo), 0), 1)', 'flow_bytes_s_scaled')} FROM flows, q",
)
def robust_minmax_q(spark, d):
    return out(clean.robust_minmax(flows(spark, d), "flow_bytes_s").select(*FLOW_KEYS, "flow_bytes_s_scaled"))


@register(
    "min_max_scale",
    S.with_ctes(S.FLOWS, "q AS (SELECT min(flow_duration) AS mn, max(flow_duration) AS mx FROM flows)")
    + f"SELECT {KEYS_SQL}, {S.r('(flow_duration - mn) / (mx - mn)', 'flow_duration_scaled')} FROM flows, q",
)
def min_max_scale_q(spark, d):
    return out(clean.min_max_scale(flows(spark, d), "flow_duration", "flow_duration_scaled").select(*FLOW_KEYS, "flow_duration_scaled"))


# ---- KPIs and features -----------------------------------------------------------


@register(
    "raw_kpis",
    S.with_ctes(S.FLOWS, S.KPIS)
    + f"SELECT {KEYS_SQL}, {S.r('total_packets', 'total_packets')}, {S.r('raw_latency', 'raw_latency')}, {S.r('raw_throughput', 'raw_throughput')} FROM kp2",
)
def raw_kpis_q(spark, d):
    return out(feat_ops.raw_kpis(flows(spark, d)).select(*FLOW_KEYS, "total_packets", "raw_latency", "raw_throughput"))


@register(
    "direct_packet_loss",
    S.with_ctes(S.FLOWS, "m AS (SELECT max(loss_rate) AS mx FROM flows)")
    + f"SELECT {KEYS_SQL}, {S.r('least(greatest(CASE WHEN mx > 1 THEN loss_rate / 100 ELSE loss_rate END, 0), 1)', 'packet_loss')} FROM flows, m",
)
def direct_packet_loss_q(spark, d):
    fl = flows(spark, d, with_direct_loss=True)
    col = feat_ops.direct_loss_column(fl)
    mx = fl.agg(F.max(F.col(f"`{col}`"))).collect()[0][0]
    return out(feat_ops.direct_packet_loss(fl, col, mx is not None and mx > 1).select(*FLOW_KEYS, "packet_loss"))


@register(
    "inferred_packet_loss",
    S.with_ctes(S.FLOWS, S.KPIS, S.PROFILE) + f"SELECT {KEYS_SQL}, {S.r(S.INFERRED_LOSS, 'packet_loss')} FROM kp2, fs",
)
def inferred_packet_loss_q(spark, d):
    kp = feat_ops.raw_kpis(flows(spark, d))
    prof = feat_ops.fit_feature_profile(kp)
    return out(feat_ops.inferred_packet_loss(kp, prof["fwd_scale"]).select(*FLOW_KEYS, "packet_loss"))


@register(
    "prepare_features",
    S.with_ctes(S.MODEL_INPUTS)
    + f"SELECT {KEYS_SQL}, {S.r('latency', 'latency')}, {S.r('throughput', 'throughput')}, {S.r('packet_loss', 'packet_loss')} FROM mip",
)
def prepare_features_q(spark, d):
    return out(feat_ops.prepare_features(model_inputs_from_lineitem(lineitem(spark, d))))


FEATURE_COLS_SQL = (
    f"{KEYS_SQL}, {S.r('latency', 'latency')}, {S.r('throughput', 'throughput')}, {S.r('packet_loss', 'packet_loss')}, "
    f"{S.r('congestion_score', 'congestion_score')}, congestion"
)


@register("create_features", FEAT_WITH + f"SELECT {FEATURE_COLS_SQL} FROM feat")
def create_features_q(spark, d):
    f = features(spark, d)
    return out(f.select(*FLOW_KEYS, "latency", "throughput", "packet_loss", "congestion_score", "congestion"))


@register(
    "risk_score",
    S.with_ctes(S.MODEL_INPUTS) + f"SELECT {KEYS_SQL}, {S.r(S.risk(), 'risk_score')} FROM mip",
)
def risk_score_q(spark, d):
    p = feat_ops.prepare_features(model_inputs_from_lineitem(lineitem(spark, d)))
    return out(feat_ops.with_risk_score(p, "risk_score").select(*FLOW_KEYS, "risk_score"))


@register(
    "risk_components",
    S.with_ctes(S.MODEL_INPUTS)
    + f"SELECT {KEYS_SQL}, {S.r('latency / 5000.0', 'latency_risk')}, {S.r('throughput', 'throughput_risk')}, {S.r('packet_loss', 'packet_loss_risk')} FROM mip",
)
def risk_components_q(spark, d):
    return out(feat_ops.risk_components(model_inputs_from_lineitem(lineitem(spark, d))).select(*FLOW_KEYS, "latency_risk", "throughput_risk", "packet_loss_risk"))


@register(
    "risk_target",
    FEAT_WITH
    + f"SELECT congestion, count(*) AS n, {S.r('min(congestion_score)', 'min_score')}, {S.r('max(congestion_score)', 'max_score')} FROM feat GROUP BY congestion",
)
def risk_target_q(spark, d):
    f = features(spark, d)
    return out(f.groupBy("congestion").agg(F.count(F.lit(1)).alias("n"), F.min("congestion_score").alias("min_score"), F.max("congestion_score").alias("max_score")))


@register(
    "label_target",
    S.with_ctes(S.FLOWS, S.KPIS, S.PROFILE, S.FEATURES)
    + f"""SELECT {KEYS_SQL}, {S.r('packet_loss', 'packet_loss')},
       CAST((label IS NULL OR upper(trim(label)) <> 'BENIGN') OR packet_loss >= 0.3 AS INTEGER) AS congestion FROM fe""",
)
def label_target_q(spark, d):
    f = feat_ops.create_features(flows(spark, d, with_label=True))
    return out(f.select(*FLOW_KEYS, "packet_loss", "congestion"))


LEGACY_SQL = """lg0 AS (
  SELECT *, CASE WHEN flow_packets_s <> 0 THEN flow_packets_s END AS pk FROM flows),
lgx AS (SELECT min(flow_bytes_s) AS bmn, max(flow_bytes_s) AS bmx, min(pk) AS pmn, max(pk) AS pmx FROM lg0),
lg AS (
  SELECT lg0.*, flow_duration / pk AS latency, (flow_bytes_s - bmn) / (bmx - bmn) AS throughput,
         (pk - pmn) / (pmx - pmn) AS packet_loss
  FROM lg0, lgx
  WHERE isfinite(flow_duration / pk) AND isfinite((flow_bytes_s - bmn) / (bmx - bmn)) AND isfinite((pk - pmn) / (pmx - pmn)))"""


@register(
    "legacy_features",
    S.with_ctes(S.FLOWS, LEGACY_SQL)
    + f"SELECT {KEYS_SQL}, {S.r('latency', 'latency')}, {S.r('throughput', 'throughput')}, {S.r('packet_loss', 'packet_loss')} FROM lg",
)
def legacy_features_q(spark, d):
    return out(feat_ops.legacy_features(flows(spark, d)).select(*FLOW_KEYS, "latency", "throughput", "packet_loss"))


@register(
    "legacy_engineered",
    S.with_ctes(
        S.FLOWS,
        LEGACY_SQL,
        "nx AS (SELECT min(latency) AS lmn, max(latency) AS lmx, min(throughput) AS tmn, max(throughput) AS tmx FROM lg)",
        "ln0 AS (SELECT lg.*, (latency - lmn) / (lmx - lmn) AS latency_norm, (throughput - tmn) / (tmx - tmn) AS throughput_norm FROM lg, nx)",
        f"""ln1 AS (SELECT *, avg(latency_norm) OVER (ORDER BY {S.ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_latency_mean,
                  avg(throughput_norm) OVER (ORDER BY {S.ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_throughput_mean,
                  {S.risk()} AS score FROM ln0)""",
        "lq AS (SELECT quantile_cont(score, 0.75) AS p75 FROM ln1)",
    )
    + f"""SELECT {KEYS_SQL}, {S.r('latency_norm', 'latency_norm')}, {S.r('throughput_norm', 'throughput_norm')},
       {S.r('rolling_latency_mean', 'rolling_latency_mean')}, {S.r('rolling_throughput_mean', 'rolling_throughput_mean')},
       {S.r('latency_norm / (throughput_norm + 1e-6)', 'load_ratio')}, {S.r('packet_loss * latency_norm', 'packet_intensity')},
       CAST(0 AS INTEGER) AS hour_of_day, CAST(score >= p75 AS INTEGER) AS congestion_flag FROM ln1, lq""",
)
def legacy_engineered_q(spark, d):
    # the index keeps its rows: only the columns that are used
    rows = feat_ops.legacy_features(flows(spark, d)).select(*dict.fromkeys([*FLOW_KEYS, *FLOW_ORDER, *K.FEATURES]))
    e = feat_ops.legacy_engineered(rows, FLOW_ORDER)
    return out(
        e.select(
            *FLOW_KEYS, "latency_norm", "throughput_norm", "rolling_latency_mean", "rolling_throughput_mean", "load_ratio",
            "packet_intensity", "hour_of_day", "congestion_flag",
        )
    )


@register(
    "visual_features",
    S.with_ctes(*S.FEAT_CTES, S.VISUAL)
    + f"""SELECT {KEYS_SQL}, {S.r('vlat', 'latency')}, {S.r('vtp', 'throughput')}, {S.r('vloss', 'packet_loss')},
       {S.r('log_latency', 'log_latency')}, {S.r('log_throughput', 'log_throughput')} FROM vis""",
)
def visual_features_q(spark, d):
    v = visual(spark, d)
    return out(v.select(*FLOW_KEYS, "latency", "throughput", "packet_loss", "log_latency", "log_throughput"))


# ---- diagnostics ------------------------------------------------------------------

from ..operators import analytics as an  # noqa: E402
from ..operators import quality as qa  # noqa: E402
from ..operators import scoring as sc  # noqa: E402
from ..operators import timeline as tl  # noqa: E402
from ..operators import towers as tw  # noqa: E402


def _per_feature(select_fn) -> str:
    return "\nUNION ALL\n".join(select_fn(c) for c in K.FEATURES)


QUANTILE_LEVELS = [0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995]


@register(
    "quantile_profile",
    FEAT_WITH
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({q} AS DOUBLE) AS q, {S.r(f'quantile_cont({c}, {q})', 'value')} FROM feat"
        for c in K.FEATURES
        for q in QUANTILE_LEVELS
    ),
)
def quantile_profile_q(spark, d):
    from ..operators.profile import quantiles

    f = features(spark, d)
    res = quantiles(f, {c: (c, QUANTILE_LEVELS) for c in K.FEATURES})
    rows = [(c, float(q), float(v)) for c in K.FEATURES for q, v in zip(QUANTILE_LEVELS, res[c])]
    return out(spark.createDataFrame(rows, "feature string, q double, value double"))


@register(
    "feature_distribution",
    FEAT_WITH
    + _per_feature(
        lambda c: f"""SELECT '{c}' AS feature, {S.r(f'min({c})', 'min')}, {S.r(f'quantile_cont({c}, 0.01)', 'p01')},
       {S.r(f'quantile_cont({c}, 0.5)', 'median')}, {S.r(f'quantile_cont({c}, 0.99)', 'p99')}, {S.r(f'max({c})', 'max')},
       {S.r(f'stddev_pop({c})', 'std')}, count(DISTINCT round({c}, 9)) AS nunique FROM feat"""
    ),
)
def feature_distribution_q(spark, d):
    return out(qa.feature_distribution(features(spark, d)))


@register(
    "feature_quality",
    FEAT_WITH
    + _per_feature(
        lambda c: f"""SELECT '{c}' AS feature, count(DISTINCT round({c}, 9)) AS nunique, {S.r(f'stddev_pop({c})', 'std')},
       count(*) FILTER (WHERE {c} < 0 OR {c} > {5000.0 if c == 'latency' else 1.0}) AS out_of_range,
       (count(DISTINCT round({c}, 9)) >= 2 AND stddev_pop({c}) > 1e-9
        AND count(*) FILTER (WHERE {c} < 0 OR {c} > {5000.0 if c == 'latency' else 1.0}) = 0) AS ok FROM feat"""
    ),
)
def feature_quality_q(spark, d):
    return out(qa.feature_quality(features(spark, d)))


@register(
    "label_relationship",
    FEAT_WITH
    + _per_feature(
        lambda c: f"""SELECT '{c}' AS feature, {S.r(f'avg({c}) FILTER (WHERE congestion = 0)', 'normal_mean')},
       {S.r(f'avg({c}) FILTER (WHERE congestion = 1)', 'congested_mean')},
       '{'traffic_load_0_to_1' if c == 'throughput' else 'higher_is_risk'}' AS direction,
       coalesce(avg({c}) FILTER (WHERE congestion = 0) IS NULL OR avg({c}) FILTER (WHERE congestion = 1) IS NULL
         {'' if c == 'throughput' else f'OR avg({c}) FILTER (WHERE congestion = 1) <= avg({c}) FILTER (WHERE congestion = 0)'}, true) AS violation
FROM feat"""
    ),
)
def label_relationship_q(spark, d):
    return out(qa.label_relationship(features(spark, d)))


@register(
    "score_correlation",
    FEAT_WITH
    + _per_feature(
        lambda c: f"SELECT '{c}' AS feature, {S.r(f'corr(least(greatest({c}, 0), {5000 if c == 'latency' else 1}), congestion_score)', 'correlation')} FROM feat"
    ),
)
def score_correlation_q(spark, d):
    return out(qa.score_correlation(features(spark, d)))


# ---- analytics --------------------------------------------------------------------

VIS_WITH = S.with_ctes(*S.FEAT_CTES, S.VISUAL)


def visual(spark, d):
    f = features(spark, d)
    return feat_ops.visual_features(f, profile=_profile(spark, d, "visual", lambda: feat_ops.fit_visual(f)))


_PAIRS = [(a, b) for a in K.FEATURES for b in K.FEATURES]
_VCOL = {"latency": "vlat", "throughput": "vtp", "packet_loss": "vloss"}


@register(
    "correlation_matrix",
    VIS_WITH
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, {S.r(f'corr({_VCOL[a]}, {_VCOL[b]})', 'correlation')},
       CASE WHEN corr({_VCOL[a]}, {_VCOL[b]}) < -0.3 THEN 'strong_negative' WHEN corr({_VCOL[a]}, {_VCOL[b]}) > 0.3 THEN 'strong_positive' ELSE 'weak' END AS band FROM vis"""
        for a, b in _PAIRS
    ),
)
def correlation_matrix_q(spark, d):
    return out(an.correlation_matrix(visual(spark, d)))


@register(
    "kpi_summary",
    FEAT_WITH
    + """, k1 AS (SELECT quantile_cont(latency, 0.99) AS l99, quantile_cont(throughput, 0.99) AS t99 FROM feat),
k2 AS (SELECT least(latency, l99) AS lat, least(throughput, t99) AS tp, congestion FROM feat, k1)
SELECT count(*) AS rows, 3 AS features,
       CAST((SELECT count(*) FILTER (WHERE latency IS NULL) + count(*) FILTER (WHERE throughput IS NULL)
             + count(*) FILTER (WHERE packet_loss IS NULL) + count(*) FILTER (WHERE congestion IS NULL) FROM feat) AS BIGINT) AS missing_values,
       round(avg(CAST(congestion AS DOUBLE)) * 100, 6) AS congestion_rate, round(avg(lat), 6) AS avg_latency,
       round(avg(tp), 6) AS avg_throughput, round(quantile_cont(lat, 0.75), 6) AS latency_threshold,
       round(quantile_cont(tp, 0.25), 6) AS throughput_threshold
FROM k2""",
)
def kpi_summary_q(spark, d):
    return out(an.kpi_summary(features(spark, d)))


@register(
    "boxplot_stats",
    VIS_WITH
    + """, bq AS (SELECT congestion, quantile_cont(log_latency, 0.25) AS q1, quantile_cont(log_latency, 0.5) AS med,
                quantile_cont(log_latency, 0.75) AS q3 FROM vis GROUP BY congestion)
SELECT v.congestion, count(log_latency) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr,
       round(min(log_latency) FILTER (WHERE log_latency >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(log_latency) FILTER (WHERE log_latency <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE log_latency < q1 - 1.5 * (q3 - q1) OR log_latency > q3 + 1.5 * (q3 - q1)) AS outliers,
       CASE WHEN v.congestion = 0 THEN 'Normal' WHEN v.congestion = 1 THEN 'Congested' END AS label
FROM vis v JOIN bq ON v.congestion = bq.congestion GROUP BY v.congestion, q1, med, q3""",
)
def boxplot_stats_q(spark, d):
    return out(an.boxplot_stats(visual(spark, d)))


@register(
    "latency_histogram",
    VIS_WITH
    + """, hx AS (SELECT min(log_latency) AS mn, max(log_latency) AS mx FROM vis),
hb AS (SELECT CAST(least(floor((log_latency - mn) * (40 / (mx - mn))), 39) AS INTEGER) AS bin, mn, mx FROM vis, hx)
SELECT bin, round(mn + bin * ((mx - mn) / 40), 6) AS lower, round(mn + (bin + 1) * ((mx - mn) / 40), 6) AS upper, count(*) AS n
FROM hb GROUP BY bin, mn, mx""",
)
def latency_histogram_q(spark, d):
    return out(an.latency_histogram(visual(spark, d)))


def _grid_sql(name, x, y):
    return f"""SELECT '{name}' AS plot,
       CAST(least(floor(({x} - xmn) * (40 / (xmx - xmn))), 39) AS INTEGER) AS ix,
       CAST(least(floor(({y} - ymn) * (40 / (ymx - ymn))), 39) AS INTEGER) AS iy
FROM vis, (SELECT min({x}) AS xmn, max({x}) AS xmx, min({y}) AS ymn, max({y}) AS ymx FROM vis)"""


@register(
    "density_2d",
    VIS_WITH
    + "SELECT plot, ix, iy, count(*) AS n FROM ("
    + _grid_sql("latency_throughput", "log_latency", "log_throughput")
    + "\nUNION ALL\n"
    + _grid_sql("loss_throughput", "vloss", "log_throughput")
    + ") GROUP BY plot, ix, iy",
)
def density_2d_q(spark, d):
    v = visual(spark, d)
    return out(an.density_2d(v, [("latency_throughput", "log_latency", "log_throughput"), ("loss_throughput", "packet_loss", "log_throughput")]))


@register(
    "density_by_class",
    VIS_WITH
    + """, ds AS (SELECT congestion, count(*) AS n, stddev_samp(log_throughput) AS sd, min(log_throughput) AS mn, max(log_throughput) AS mx
             FROM vis GROUP BY congestion HAVING count(*) >= 2),
ds2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (mx - mn) / 1000 AS w FROM ds),
db AS (SELECT v.congestion, CAST(CASE WHEN w > 0 THEN least(floor((log_throughput - mn) / w), 999) ELSE 0 END AS INTEGER) AS b, count(*) AS c
       FROM vis v JOIN ds2 ON v.congestion = ds2.congestion GROUP BY 1, 2),
gp AS (SELECT ds2.*, g, mn + (mx - mn) * g / 99 AS grid_x FROM ds2, range(100) t(g)),
ce AS (SELECT db.congestion, mn + (b + 0.5) * w AS center, c FROM db JOIN ds2 ON db.congestion = ds2.congestion)
SELECT gp.congestion, CAST(g AS INTEGER) AS point, round(grid_x, 6) AS grid_x,
       round(sum(c * exp(-0.5 * pow((grid_x - center) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density,
       CASE WHEN gp.congestion = 0 THEN 'Normal' WHEN gp.congestion = 1 THEN 'Congested' END AS label
FROM gp JOIN ce ON gp.congestion = ce.congestion GROUP BY gp.congestion, g, grid_x, n, h""",
)
def density_by_class_q(spark, d):
    return out(an.density_by_class(visual(spark, d)))


@register("class_distribution", FEAT_WITH + "SELECT congestion, count(*) AS n FROM feat GROUP BY congestion")
def class_distribution_q(spark, d):
    return out(an.class_distribution(features(spark, d)))


LABEL_PRED = "CAST((label IS NULL OR upper(trim(label)) <> 'BENIGN') OR packet_loss >= 0.3 AS INTEGER)"


@register(
    "binary_metrics",
    FEAT_WITH
    + f""", bm AS (SELECT congestion AS y, {LABEL_PRED} AS p FROM feat),
cm AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
              count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM bm)
SELECT tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM cm""",
)
def binary_metrics_q(spark, d):
    f = features(spark, d).withColumnRenamed("congestion", "y")
    f = feat_ops.label_target(f, "label").withColumnRenamed("congestion", "p")
    return out(an.binary_metrics(f, "y", "p"))


@register(
    "preview_rows",
    FEAT_WITH + f"SELECT {FEATURE_COLS_SQL} FROM feat ORDER BY {S.ORDER} LIMIT 50",
)
def preview_rows_q(spark, d):
    f = an.preview_rows(features(spark, d), FLOW_ORDER, 50)
    return out(f.select(*FLOW_KEYS, "latency", "throughput", "packet_loss", "congestion_score", "congestion"))


_MD5_KEY = "md5(concat_ws(':', '{seed}', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


@register(
    "stable_sample",
    FEAT_WITH + f"SELECT {FEATURE_COLS_SQL} FROM feat ORDER BY {_MD5_KEY.format(seed=42)}, {S.KEYS} LIMIT 500",
)
def stable_sample_q(spark, d):
    f = an.stable_sample(features(spark, d), FLOW_KEYS, 500, seed=42)
    return out(f.select(*FLOW_KEYS, "latency", "throughput", "packet_loss", "congestion_score", "congestion"))


@register(
    "stratified_split",
    FEAT_WITH
    + f"""SELECT congestion, CASE WHEN CAST(('0x' || substr({_MD5_KEY.format(seed=99)}, 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
       THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM feat GROUP BY 1, 2""",
)
def stratified_split_q(spark, d):
    f = an.stratified_split(features(spark, d), FLOW_KEYS, seed=99)
    return out(f.groupBy("congestion", "split").agg(F.count(F.lit(1)).alias("n")))


# ---- towers -------------------------------------------------------------------------

TOWER_SQL = f""", tq AS (SELECT quantile_cont(throughput, 0.33333333333333326) AS e1, quantile_cont(throughput, 0.6666666666666665) AS e2 FROM feat),
tws AS (SELECT feat.*, CASE WHEN throughput <= e1 THEN 'A' WHEN throughput <= e2 THEN 'B' ELSE 'C' END AS tower FROM feat, tq),
tsum AS (SELECT tower, count(*) AS records, avg(CAST(congestion AS DOUBLE)) AS rate FROM tws GROUP BY tower),
trank AS (SELECT tower, records, rate, rate * 100 AS pct, row_number() OVER (ORDER BY rate * 100 DESC, tower) AS rank FROM tsum)"""


def segmented(spark, d):
    return tw.tower_segments(features(spark, d), "throughput", FLOW_ORDER)


@register("tower_segments", FEAT_WITH + TOWER_SQL + f"SELECT {KEYS_SQL}, {S.r('throughput', 'throughput')}, tower FROM tws")
def tower_segments_q(spark, d):
    return out(segmented(spark, d).select(*FLOW_KEYS, "throughput", "tower"))


@register(
    "tower_summary",
    FEAT_WITH + TOWER_SQL + "SELECT tower, records, round(rate, 6) AS congestion_rate, round(pct, 6) AS congestion_percentage, rank FROM trank",
)
def tower_summary_q(spark, d):
    return out(tw.tower_summary(segmented(spark, d)))


@register(
    "most_congested_tower",
    FEAT_WITH
    + TOWER_SQL
    + """SELECT tower, round(pct, 6) AS congestion_percentage,
       CASE WHEN pct > 75 THEN 'Critical' WHEN pct > 60 THEN 'Warning' ELSE 'Normal' END AS alert
FROM trank WHERE rank = 1""",
)
def most_congested_tower_q(spark, d):
    return out(tw.most_congested_tower(tw.tower_summary(segmented(spark, d))))


@register(
    "tower_action_plan",
    FEAT_WITH
    + TOWER_SQL
    + """SELECT tower, round(pct, 6) AS congestion_percentage,
       CASE WHEN pct > 75 THEN 'Critical congestion' WHEN pct > 60 THEN 'Moderate congestion' ELSE 'Stable load' END AS status,
       CASE WHEN pct > 75 THEN 'Upgrade tower capacity and add a new node' WHEN pct > 60 THEN 'Monitor usage and prepare load balancing'
            ELSE 'Monitor usage' END AS action,
       CASE WHEN pct > 75 THEN 'Critical' WHEN pct > 60 THEN 'Warning' ELSE 'Normal' END AS alert
FROM trank""",
)
def tower_action_plan_q(spark, d):
    return out(tw.tower_action_plan(tw.tower_summary(segmented(spark, d))))


REDIS_SQL = S.with_ctes(
    S.TOWER_LOADS,
    """tg AS (SELECT cell, sum(CASE WHEN load > 75 THEN load - 75 ELSE 0.0 END) AS ex, count(*) FILTER (WHERE load < 60) AS un
       FROM tl GROUP BY cell)""",
    """td AS (SELECT tl.cell, tower, load AS load_before,
              CASE WHEN load > 75 AND un > 0 THEN 75.0 WHEN load < 60 AND un > 0 THEN least(load + ex / un, 75.0) ELSE load END AS load_after
       FROM tl JOIN tg ON tl.cell = tg.cell)""",
)


def _band(c):
    return f"CASE WHEN {c} > 75 THEN 'overloaded' WHEN {c} > 60 THEN 'elevated' ELSE 'normal' END"


@register(
    "tower_redistribution",
    REDIS_SQL
    + f"SELECT cell, tower, round(load_before, 6) AS load_before, round(load_after, 6) AS load_after, {_band('load_before')} AS band_before, {_band('load_after')} AS band_after FROM td",
)
def tower_redistribution_q(spark, d):
    return out(tw.tower_redistribution(tower_loads_from_supplier(read_table(spark, d, "supplier"))))


@register(
    "redistribution_summary",
    REDIS_SQL
    + """SELECT cell, count(*) AS towers, count(*) FILTER (WHERE load_before > 75) AS overloaded_before,
       count(*) FILTER (WHERE load_after > 75) AS overloaded_after, round(stddev_pop(load_before), 6) AS std_before,
       round(stddev_pop(load_after), 6) AS std_after, round(stddev_pop(load_before) - stddev_pop(load_after), 6) AS spread_reduction
FROM td GROUP BY cell""",
)
def redistribution_summary_q(spark, d):
    return out(tw.redistribution_summary(tw.tower_redistribution(tower_loads_from_supplier(read_table(spark, d, "supplier")))))


# ---- timeline -----------------------------------------------------------------------

TEL_WITH = S.with_ctes(S.TELEMETRY)


def trend(spark, d):
    """The rolling trend, computed once for the events as they are, and its row count and spike threshold."""
    rows = stored_table(spark, "trend", _inputs(d, "events"), lambda: tl.rolling_trend(telemetry(spark, d), ["ts"])[0])
    fit = lambda: Profile({"rows": rows.count(), "spike_threshold": tl.spike_threshold(rows)})
    known = Profile.load(spark, stored_folder(spark, "spikes", _inputs(d, "events"), lambda at: fit().save(spark, at)))
    return rows, known["rows"], known.get("spike_threshold")


@register("rolling_congestion", TEL_WITH + f"SELECT event_id, {S.r('rolling_congestion', 'rolling_congestion')} FROM trend")
def rolling_congestion_q(spark, d):
    t, _n, _thr = trend(spark, d)
    return out(t.select("event_id", "rolling_congestion"))


@register(
    "rolling_trend",
    TEL_WITH
    + f"SELECT event_id, {S.r('rolling_congestion', 'rolling_congestion')}, {S.r('rolling_mean', 'rolling_mean')}, {S.r('latency_rolling', 'latency_rolling')} FROM trend",
)
def rolling_trend_q(spark, d):
    t, _n, _thr = trend(spark, d)
    return out(t.select("event_id", "rolling_congestion", "rolling_mean", "latency_rolling"))


@register(
    "congestion_spikes",
    TEL_WITH
    + f"SELECT event_id, {S.r('rolling_congestion', 'rolling_congestion')}, {S.r('thr', 'spike_threshold')} FROM trend, spk WHERE rolling_congestion > thr",
)
def congestion_spikes_q(spark, d):
    t, _n, thr = trend(spark, d)
    return out(tl.congestion_spikes(t, thr).select("event_id", "rolling_congestion", "spike_threshold"))


@register(
    "recent_spike_status",
    TEL_WITH
    + """SELECT round(max_by(rolling_congestion, idx), 6) AS latest_rolling_congestion, round(max(thr), 6) AS spike_threshold,
       count(*) FILTER (WHERE rolling_congestion > thr) AS recent_spikes, coalesce(bool_or(rolling_congestion > thr), false) AS recent_spike
FROM trend, spk WHERE idx >= n - 50""",
)
def recent_spike_status_q(spark, d):
    t, n, thr = trend(spark, d)
    return out(tl.recent_spike_status(t, n, thr))


# ---- scoring and diagnosis ------------------------------------------------------------

ST_WITH = S.with_ctes(*S.FEAT_CTES, S.STATES)


@register(
    "congestion_probability",
    ST_WITH + f"SELECT {KEYS_SQL}, {S.r(S.heuristic('latency', 'packet_loss', 'throughput_mbps'), 'heuristic_prob')} FROM st",
)
def congestion_probability_q(spark, d):
    return out(sc.congestion_probability(states(spark, d)).select(*FLOW_KEYS, "heuristic_prob"))


def _tier_sql(p):
    return f"CASE WHEN {p} > 0.7 THEN 'Critical' WHEN {p} > 0.4 THEN 'Warning' ELSE 'Normal' END"


def _state_sql(p):
    return f"CASE WHEN {p} > 0.7 THEN 'Congestion Detected' WHEN {p} > 0.4 THEN 'Elevated Risk' ELSE 'Normal Network' END"


@register(
    "alert_tiers",
    ST_WITH + f"SELECT {KEYS_SQL}, {S.r('prob', 'prob')}, {_tier_sql('prob')} AS alert_level, {_state_sql('prob')} AS network_state FROM st",
)
def alert_tiers_q(spark, d):
    return out(sc.alert_tiers(states(spark, d)).select(*FLOW_KEYS, "prob", "alert_level", "network_state"))


SAFETY_SQL = """, so AS (SELECT *, CAST(congestion_score > 0.5 AS INTEGER) AS pred, congestion_score AS prob FROM feat),
so1 AS (SELECT *, CASE WHEN pred = 0 AND latency <= 50 AND packet_loss <= 0.02 THEN least(prob, 0.02) ELSE prob END AS prob0,
               CASE WHEN packet_loss >= 0.15 AND throughput <= 0.3 THEN 0.8 END AS o1 FROM so),
so2 AS (SELECT *, CASE WHEN packet_loss >= 0.5 THEN 0.95 WHEN packet_loss >= 0.3 THEN greatest(coalesce(o1, 0.0), 0.8) ELSE o1 END AS o2 FROM so1),
so3 AS (SELECT *, CASE WHEN latency >= 3000 AND packet_loss >= 0.2 THEN greatest(coalesce(o2, 0.0), 0.95) ELSE o2 END AS o3 FROM so2)"""


@register(
    "safety_overrides",
    FEAT_WITH
    + SAFETY_SQL
    + f"""SELECT {KEYS_SQL}, CASE WHEN o3 IS NOT NULL THEN 1 ELSE pred END AS final_pred,
       {S.r('CASE WHEN o3 IS NOT NULL THEN greatest(prob0, o3) ELSE prob0 END', 'final_prob')}, {S.r('o3', 'override_prob')} FROM so3""",
)
def safety_overrides_q(spark, d):
    f = features(spark, d).withColumns({"pred": (F.col("congestion_score") > 0.5).cast("int"), "prob": F.col("congestion_score")})
    return out(sc.safety_overrides(f).select(*FLOW_KEYS, "final_pred", "final_prob", "override_prob"))


def diagnosis(spark, d, f) -> dict:
    return _profile(spark, d, "diagnosis", lambda: Profile(sc.diagnosis_thresholds(f))).values


DIAG_SQL = """, dq AS (SELECT quantile_cont(latency, 0.75) AS lt, quantile_cont(throughput, 0.25) AS tt, quantile_cont(packet_loss, 0.9) AS pt FROM feat),
dg AS (SELECT feat.*, (packet_loss > 0.3 OR packet_loss > pt) AS f_loss, latency > lt AS f_lat, throughput < tt AS f_tp FROM feat, dq)"""


@register(
    "root_causes",
    FEAT_WITH
    + DIAG_SQL
    + f""", rc AS (SELECT *, concat_ws(' | ', CASE WHEN f_loss THEN '{K.CAUSE_LOSS}' END, CASE WHEN f_lat THEN '{K.CAUSE_LATENCY}' END,
                         CASE WHEN f_tp THEN '{K.CAUSE_THROUGHPUT}' END) AS found FROM dg)
SELECT {KEYS_SQL}, CASE WHEN found <> '' THEN found WHEN congestion = 1 THEN '{K.CAUSE_MULTI}' ELSE '{K.CAUSE_NONE}' END AS root_causes FROM rc""",
)
def root_causes_q(spark, d):
    f = features(spark, d)
    th = diagnosis(spark, d, f)
    r = sc.root_causes(f, th)
    return out(r.select(*FLOW_KEYS, F.array_join("root_causes", " | ").alias("root_causes")))


@register(
    "suggestions",
    FEAT_WITH
    + DIAG_SQL
    + f""", sg AS (SELECT *, concat_ws(' | ', CASE WHEN f_loss THEN '{K.SUGGEST_LOSS}' END, CASE WHEN f_lat THEN '{K.SUGGEST_LATENCY}' END,
                         CASE WHEN f_tp THEN '{K.SUGGEST_THROUGHPUT}' END) AS base FROM dg),
sg2 AS (SELECT *, CASE WHEN congestion_score > 0.9 THEN concat_ws(' | ', nullif(base, ''), '{K.SUGGEST_URGENT}')
                       WHEN congestion = 1 AND base = '' THEN '{K.SUGGEST_INVESTIGATE}' ELSE base END AS s FROM sg)
SELECT {KEYS_SQL}, CASE WHEN s <> '' THEN s ELSE '{K.SUGGEST_NORMAL}' END AS suggestions FROM sg2""",
)
def suggestions_q(spark, d):
    f = features(spark, d)
    th = diagnosis(spark, d, f)
    r = sc.suggestions(f, th, prob="congestion_score")
    return out(r.select(*FLOW_KEYS, F.array_join("suggestions", " | ").alias("suggestions")))


NORM_SQL = f""", ns0 AS (SELECT st.*, CASE WHEN throughput_ratio >= 0 AND throughput_ratio <= 1 THEN throughput_ratio * 1000 ELSE throughput_ratio END AS tp0,
                CASE WHEN packet_loss > 1 THEN packet_loss / 100 ELSE packet_loss END AS loss0 FROM st),
ns AS (SELECT {KEYS_SQL}, least(greatest(latency, 5), 5000) AS state_latency, least(greatest(tp0, 10), 1000) AS state_throughput,
              least(greatest(loss0, 0), 1) AS state_packet_loss, least(greatest(tower_load, 10), 100) AS state_tower_load,
              least(greatest({S.heuristic('latency', 'loss0', 'tp0')}, 0), 1) AS state_prob FROM ns0)"""


def normalized(spark, d):
    return sc.normalize_state(states(spark, d), latency="latency", throughput="throughput_ratio", loss="packet_loss", load="tower_load")


@register(
    "normalize_state",
    ST_WITH
    + NORM_SQL
    + f"""SELECT {KEYS_SQL}, {S.r('state_latency', 'state_latency')}, {S.r('state_throughput', 'state_throughput')},
       {S.r('state_packet_loss', 'state_packet_loss')}, {S.r('state_tower_load', 'state_tower_load')}, {S.r('state_prob', 'state_prob')} FROM ns""",
)
def normalize_state_q(spark, d):
    cols = ["state_latency", "state_throughput", "state_packet_loss", "state_tower_load", "state_prob"]
    return out(normalized(spark, d).select(*FLOW_KEYS, *cols))


_BIN_FIELDS = {
    "latency": "state_latency",
    "throughput": "state_throughput",
    "packet_loss": "state_packet_loss",
    "tower_load": "state_tower_load",
    "congestion_probability": "state_prob",
}


#: Lowest and highest value of each field in six even bins, stated apart from the operator.
_BIN_SQL_RANGES = {
    "latency": (5, 5000),
    "throughput": (10, 1000),
    "packet_loss": (0, 1),
    "tower_load": (0, 100),
    "congestion_probability": (0, 1),
}


def _bins_sql() -> str:
    parts = []
    for key, c in _BIN_FIELDS.items():
        lo, hi = _BIN_SQL_RANGES[key]
        edges = [f"CAST({c} >= {lo}::DOUBLE + {k} * (({hi}::DOUBLE - {lo}) / 6) AS INTEGER)" for k in range(1, 6)]
        parts.append(f"({' + '.join(edges)}) AS bin_{key}")
    return ", ".join(parts)


@register("state_bins", ST_WITH + NORM_SQL + f"SELECT {KEYS_SQL}, {_bins_sql()} FROM ns")
def state_bins_q(spark, d):
    b = sc.state_bins(normalized(spark, d), _BIN_FIELDS)
    return out(b.select(*FLOW_KEYS, *[f"bin_{k}" for k in _BIN_FIELDS]))


@register(
    "state_occupancy",
    ST_WITH
    + NORM_SQL
    + f""", nb AS (SELECT *, {_bins_sql()} FROM ns)
SELECT {', '.join('bin_' + k for k in _BIN_FIELDS)}, count(*) AS rows, round(avg(state_prob), 6) AS mean_prob FROM nb
GROUP BY {', '.join('bin_' + k for k in _BIN_FIELDS)}""",
)
def state_occupancy_q(spark, d):
    return out(sc.state_occupancy(sc.state_bins(normalized(spark, d), _BIN_FIELDS), "state_prob"))


# ---- what-if projections ------------------------------------------------------------

from ..functions.columns import alert_tier, network_state, post_state  # noqa: E402
from ..operators import whatif as wi  # noqa: E402
from . import sqlwhatif as W  # noqa: E402

STEPS = K.PROJECTION_STEPS


def whatif_input(spark, d) -> DataFrame:
    """Scored rows as optimiser states: Mbps = 1000 x ratio, given probability."""
    return sc.normalize_state(states(spark, d), latency="latency", throughput="throughput_mbps", loss="packet_loss", load="tower_load", prob="prob")


def projected(spark, d, policy="priority") -> DataFrame:
    s = whatif_input(spark, d)
    return wi.project(s, "state_latency", "state_throughput", "state_packet_loss", "state_tower_load", "state_prob", policy=policy, steps=STEPS)


# normalised state with the given (scored) probability, in SQL
WI_SRC = f""", wn0 AS (SELECT st.*, CASE WHEN throughput_mbps >= 0 AND throughput_mbps <= 1 THEN throughput_mbps * 1000 ELSE throughput_mbps END AS tp0,
                CASE WHEN packet_loss > 1 THEN packet_loss / 100 ELSE packet_loss END AS loss0 FROM st),
wsrc AS (SELECT {KEYS_SQL}, latency AS in_latency, throughput_ratio, prob AS in_prob,
                least(greatest(latency, 5), 5000) AS lat, least(greatest(tp0, 10), 1000) AS tp,
                least(greatest(loss0, 0), 1) AS loss, least(greatest(tower_load, 10), 100) AS load,
                least(greatest(prob, 0), 1) AS prob FROM wn0)"""


def _wi_sql(policy="priority", src="wsrc", prefix="w"):
    ctes, final = W.chain(src, policy, STEPS, KEYS_SQL, prefix)
    return ",\n".join(ctes), final


_PRI_CTES, _PRI_FINAL = _wi_sql()
WI_WITH = ST_WITH + WI_SRC + ",\n" + _PRI_CTES + "\n"

_STEP_COLS = ["action", "latency", "throughput", "packet_loss", "tower_load", "congestion_prob", "reward",
              "latency_before", "throughput_before", "packet_loss_before", "tower_load_before", "congestion_prob_before"]


@register(
    "whatif_steps",
    WI_WITH
    + "SELECT "
    + ", ".join([KEYS_SQL, "step", "action"] + [S.r(c, c) for c in _STEP_COLS[1:]])
    + f" FROM ({W.step_rows(_PRI_FINAL, STEPS, KEYS_SQL)})",
)
def whatif_steps_q(spark, d):
    return out(wi.step_log(projected(spark, d), FLOW_KEYS))


SUMMARY_SQL = f"""{S.heuristic('init_lat', 'init_loss', 'init_tp')}"""


def _summary_select(final: str) -> str:
    ic = SUMMARY_SQL
    return (
        f"{S.r('total', 'total_reward')}, {S.r(f'({ic} - prob) / greatest({ic}, 1e-6) * 100.0', 'congestion_reduction_pct')}, "
        f"{S.r('(init_lat - lat) / greatest(init_lat, 1e-6) * 100.0', 'latency_improvement_pct')}, "
        f"{S.r('(tp - init_tp) / greatest(init_tp, 1e-6) * 100.0', 'throughput_improvement_pct')}, "
        f"array_to_string({W.actions_list(STEPS)}, ' → ') AS action_sequence"
    )


@register("step_log_summary", WI_WITH + f"SELECT {KEYS_SQL}, {_summary_select(_PRI_FINAL)} FROM {_PRI_FINAL}")
def step_log_summary_q(spark, d):
    p = wi.summary_columns(projected(spark, d))
    return out(p.select(*FLOW_KEYS, "total_reward", "congestion_reduction_pct", "latency_improvement_pct", "throughput_improvement_pct", "action_sequence"))


def _batch_spark(spark, d) -> DataFrame:
    p = wi.summary_columns(projected(spark, d))
    cong = F.col("prob") > K.CONGESTED_ABOVE
    return p.select(
        *FLOW_KEYS,
        F.col("latency"),
        F.col("packet_loss"),
        F.col("throughput_ratio").alias("throughput"),
        F.col("prob").alias("congestion_prob"),
        network_state(F.col("prob")).alias("network_state"),
        alert_tier(F.col("prob")).alias("alert_level"),
        F.when(cong, F.col("congestion_reduction_pct")).otherwise(0.0).alias("opt_congestion_reduction_pct"),
        F.when(cong, F.col("latency_improvement_pct")).otherwise(0.0).alias("opt_latency_improvement_pct"),
        F.when(cong, F.col("throughput_improvement_pct")).otherwise(0.0).alias("opt_throughput_gain_pct"),
        F.when(cong, F.col("action_sequence")).otherwise("").alias("recommended_action"),
    )


def _batch_sql_select(final: str) -> str:
    ic = SUMMARY_SQL
    cong = "in_prob > 0.5"
    return f"""SELECT {KEYS_SQL}, {S.r('in_latency', 'latency')}, {S.r('packet_loss_in', 'packet_loss')}, {S.r('throughput_ratio', 'throughput')},
       {S.r('in_prob', 'congestion_prob')}, {_state_sql('in_prob')} AS network_state, {_tier_sql('in_prob')} AS alert_level,
       {S.r(f'CASE WHEN {cong} THEN ({ic} - prob) / greatest({ic}, 1e-6) * 100.0 ELSE 0.0 END', 'opt_congestion_reduction_pct')},
       {S.r(f'CASE WHEN {cong} THEN (init_lat - lat) / greatest(init_lat, 1e-6) * 100.0 ELSE 0.0 END', 'opt_latency_improvement_pct')},
       {S.r(f'CASE WHEN {cong} THEN (tp - init_tp) / greatest(init_tp, 1e-6) * 100.0 ELSE 0.0 END', 'opt_throughput_gain_pct')},
       CASE WHEN {cong} THEN array_to_string({W.actions_list(STEPS)}, ' → ') ELSE '' END AS recommended_action
FROM {final}"""


_BATCH_SRC = WI_SRC.replace("prob AS in_prob,", "prob AS in_prob, packet_loss AS packet_loss_in,")
_BATCH_WITH = ST_WITH + _BATCH_SRC + ",\n" + _PRI_CTES + "\n"


@register("batch_analysis", _BATCH_WITH + _batch_sql_select(_PRI_FINAL))
def batch_analysis_q(spark, d):
    return out(_batch_spark(spark, d))


@register(
    "batch_summary",
    _BATCH_WITH
    + f""", ba AS ({_batch_sql_select(_PRI_FINAL)})
SELECT count(*) AS rows, count(*) FILTER (WHERE congestion_prob > 0.5) AS congested_rows,
       round(count(*) FILTER (WHERE congestion_prob > 0.5) * 100.0 / count(*), 6) AS congested_pct,
       round(avg(congestion_prob), 6) AS avg_congestion_prob, round(avg(opt_congestion_reduction_pct), 6) AS avg_opt_improvement FROM ba""",
)
def batch_summary_q(spark, d):
    b = _batch_spark(spark, d)
    return out(
        b.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("congestion_prob") > K.CONGESTED_ABOVE).alias("congested_rows"),
            (F.count_if(F.col("congestion_prob") > K.CONGESTED_ABOVE) * 100.0 / F.count(F.lit(1))).alias("congested_pct"),
            F.avg("congestion_prob").alias("avg_congestion_prob"),
            F.avg("opt_congestion_reduction_pct").alias("avg_opt_improvement"),
        )
    )


# before/after for congested rows: fresh state, tower load 60, probability re-derived
BA_SRC = f""", bn0 AS (SELECT st.*, CASE WHEN throughput_mbps >= 0 AND throughput_mbps <= 1 THEN throughput_mbps * 1000 ELSE throughput_mbps END AS tp0,
                CASE WHEN packet_loss > 1 THEN packet_loss / 100 ELSE packet_loss END AS loss0 FROM st WHERE prob > 0.5),
bsrc AS (SELECT {KEYS_SQL}, prob AS scored_prob,
                least(greatest(latency, 5), 5000) AS lat, least(greatest(tp0, 10), 1000) AS tp,
                least(greatest(loss0, 0), 1) AS loss, {K.POST_TOWER_LOAD} AS load,
                least(greatest({S.heuristic('latency', 'loss0', 'tp0')}, 0), 1) AS prob FROM bn0)"""
_BA_CTES, _BA_FINAL = _wi_sql(src="bsrc", prefix="v")
BA_WITH = ST_WITH + BA_SRC + ",\n" + _BA_CTES + "\n"


def _before_after_sql() -> str:
    post = S.heuristic("lat", "loss", "tp")
    return f"""SELECT {KEYS_SQL}, {S.r('init_lat', 'before_latency')}, {S.r('init_loss', 'before_packet_loss')}, {S.r('init_tp', 'before_throughput')},
       {S.r('scored_prob', 'before_congestion')}, {S.r('lat', 'after_latency')}, {S.r('loss', 'after_packet_loss')}, {S.r('tp', 'after_throughput')},
       {S.r(post, 'after_congestion')},
       CASE WHEN {post} > 0.7 THEN 'Congestion Detected' WHEN {post} > 0.4 THEN 'Warning' ELSE 'Normal Network' END AS after_state,
       {_tier_sql(post)} AS after_alert, {S.r(f'(scored_prob - {post}) / scored_prob * 100', 'congestion_cut_by')},
       array_to_string({W.actions_list(STEPS)}, ' → ') AS action_sequence
FROM {_BA_FINAL}"""


def _before_after_spark(spark, d) -> DataFrame:
    s = states(spark, d).where(F.col("prob") > K.CONGESTED_ABOVE).withColumn("post_load", F.lit(K.POST_TOWER_LOAD))
    n = sc.normalize_state(s, latency="latency", throughput="throughput_mbps", loss="packet_loss", load="post_load", prob=None)
    p = wi.project(n, "state_latency", "state_throughput", "state_packet_loss", "state_tower_load", "state_prob", steps=STEPS)
    p = p.withColumn("after_congestion", wi._prob(F.col("final_latency"), F.col("final_packet_loss"), F.col("final_throughput")))
    return p.select(
        *FLOW_KEYS,
        F.col("init_latency").alias("before_latency"),
        F.col("init_packet_loss").alias("before_packet_loss"),
        F.col("init_throughput").alias("before_throughput"),
        F.col("prob").alias("before_congestion"),
        F.col("final_latency").alias("after_latency"),
        F.col("final_packet_loss").alias("after_packet_loss"),
        F.col("final_throughput").alias("after_throughput"),
        F.col("after_congestion"),
        post_state(F.col("after_congestion")).alias("after_state"),
        alert_tier(F.col("after_congestion")).alias("after_alert"),
        ((F.col("prob") - F.col("after_congestion")) / F.col("prob") * 100).alias("congestion_cut_by"),
        F.array_join("actions", " → ").alias("action_sequence"),
    )


@register("before_after", BA_WITH + _before_after_sql())
def before_after_q(spark, d):
    return out(_before_after_spark(spark, d))


@register(
    "post_summary",
    BA_WITH
    + f""", pa AS ({_before_after_sql()})
SELECT count(*) AS rows_optimized, count(*) FILTER (WHERE after_alert = 'Normal') AS now_normal,
       round(count(*) FILTER (WHERE after_alert = 'Normal') * 100.0 / count(*), 6) AS now_normal_pct,
       round(avg(congestion_cut_by), 6) AS avg_congestion_cut, count(*) FILTER (WHERE after_alert <> 'Normal') AS still_congested FROM pa""",
)
def post_summary_q(spark, d):
    b = _before_after_spark(spark, d)
    normal = F.col("after_alert") == "Normal"
    return out(
        b.agg(
            F.count(F.lit(1)).alias("rows_optimized"),
            F.count_if(normal).alias("now_normal"),
            (F.count_if(normal) * 100.0 / F.count(F.lit(1))).alias("now_normal_pct"),
            F.avg("congestion_cut_by").alias("avg_congestion_cut"),
            F.count_if(~normal).alias("still_congested"),
        )
    )


def _report_sql() -> str:
    rec = (
        f"CASE WHEN prob > 0.5 THEN '{K.RECOMMEND_CONGESTED}' WHEN lat > 100.0 THEN '{K.RECOMMEND_LATENCY}' ELSE '{K.RECOMMEND_MONITOR}' END"
    )
    pairs = [("init_lat", "lat"), ("init_tp", "tp"), ("init_loss", "loss"), ("init_prob", "prob")]
    parts = [
        f"SELECT {KEYS_SQL}, '{m}' AS metric, {S.r(a, 'initial_value')}, {S.r(b, 'final_value')}, {rec} AS recommendation FROM {_PRI_FINAL}"
        for m, (a, b) in zip(K.REPORT_METRICS, pairs)
    ]
    return "\nUNION ALL\n".join(parts)


@register("initial_final_report", WI_WITH + _report_sql())
def initial_final_report_q(spark, d):
    p = projected(spark, d)
    rec = (
        F.when(F.col("final_prob") > 0.5, K.RECOMMEND_CONGESTED)
        .when(F.col("final_latency") > 100.0, K.RECOMMEND_LATENCY)
        .otherwise(K.RECOMMEND_MONITOR)
    )
    pairs = [("init_latency", "final_latency"), ("init_throughput", "final_throughput"), ("init_packet_loss", "final_packet_loss"), ("init_prob", "final_prob")]
    structs = [F.struct(F.lit(m).alias("metric"), F.col(a).alias("initial_value"), F.col(b).alias("final_value")) for m, (a, b) in zip(K.REPORT_METRICS, pairs)]
    return out(p.select(*FLOW_KEYS, rec.alias("recommendation"), F.inline_outer(F.array(*structs))))


# simulator reset from a state record (strategy comparison, single decisions)
SIM_SRC = f""", sim AS (SELECT {KEYS_SQL}, least(greatest(latency, 5), 5000) AS lat, least(greatest(throughput_mbps, 10), 1000) AS tp,
               least(greatest(CASE WHEN packet_loss > 1 THEN packet_loss / 100 ELSE packet_loss END, 0), 1) AS loss,
               least(greatest(tower_load, 0), 100) AS load FROM st),
simp AS (SELECT *, least(greatest({S.heuristic('lat', 'loss', 'tp')}, 0), 1) AS prob FROM sim)"""


def sim_state(spark, d) -> DataFrame:
    return wi.simulator_state(states(spark, d), "latency", "throughput_mbps", "packet_loss", "tower_load")


def _sim_cols(df):
    return df.withColumns({"_lat": F.col("s_lat"), "_tp": F.col("s_tp"), "_loss": F.col("s_loss"), "_load": F.col("s_load"), "_prob": F.col("s_prob"), "_h1": F.lit(None).cast("string"), "_h2": F.lit(None).cast("string"), "_n": F.lit(0)})


@register(
    "recommended_action",
    ST_WITH + SIM_SRC + f""", ra AS (SELECT *, {W._prios()} AS prios FROM simp)
SELECT {KEYS_SQL}, CASE WHEN prob < {K.IDLE_BELOW} THEN 'do_nothing' ELSE prios[1] END AS recommended_action FROM ra""",
)
def recommended_action_q(spark, d):
    t = wi.priority_action(_sim_cols(sim_state(spark, d)))
    return out(t.select(*FLOW_KEYS, F.col("_act").alias("recommended_action")))


@register("rule_action", ST_WITH + SIM_SRC + f"SELECT {KEYS_SQL}, {W.rule_sql()} AS rule_action FROM simp")
def rule_action_q(spark, d):
    t = sim_state(spark, d)
    return out(t.select(*FLOW_KEYS, wi.rule_action_expr(F.col("s_lat"), F.col("s_tp"), F.col("s_loss"), F.col("s_load"), F.col("s_prob")).alias("rule_action")))


def _best_sql() -> str:
    rsel, act = W.greedy_sql()
    best = "greatest(" + ", ".join(f"r{i}" for i in range(len(K.ACTIONS))) + ")"
    return f""", gb AS (SELECT *, {rsel} FROM simp)
SELECT {KEYS_SQL}, {act} AS best_action, {S.r(best, 'best_reward')} FROM gb"""


@register("best_single_action", ST_WITH + SIM_SRC + _best_sql())
def best_single_action_q(spark, d):
    g = wi.greedy_action(_sim_cols(sim_state(spark, d)), reward="best_reward")
    return out(g.select(*FLOW_KEYS, F.col("_act").alias("best_action"), "best_reward"))


def _strategy_sql() -> str:
    parts, ctes = [], []
    for name, pol, pre in [("RL Agent", "priority", "xa"), ("Greedy", "greedy", "xb"), ("Random", "random", "xc"), ("Rule-based", "rule", "xd")]:
        c, final = W.chain("simp", pol, STEPS, KEYS_SQL, pre)
        ctes += c
        parts.append(
            f"SELECT '{name}' AS strategy, count(*) AS rows, {S.r('avg(prob)', 'final_congestion_prob')}, {S.r('avg(lat)', 'latency')}, "
            f"{S.r('avg(tp)', 'throughput')}, {S.r('avg(loss)', 'packet_loss')}, {S.r('avg(load)', 'tower_load')}, {S.r('avg(total)', 'total_reward')} FROM {final}"
        )
    return ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("strategy_comparison", ST_WITH + SIM_SRC + _strategy_sql())
def strategy_comparison_q(spark, d):
    base = sim_state(spark, d)
    frames = []
    for name, pol in zip(K.STRATEGIES, ["priority", "greedy", "random", "rule"]):
        p = wi.project(base, "s_lat", "s_tp", "s_loss", "s_load", "s_prob", policy=pol, steps=STEPS, key_cols=FLOW_KEYS)
        frames.append(
            p.groupBy(F.lit(name).alias("strategy")).agg(
                F.count(F.lit(1)).alias("rows"),
                F.avg("final_prob").alias("final_congestion_prob"),
                F.avg("final_latency").alias("latency"),
                F.avg("final_throughput").alias("throughput"),
                F.avg("final_packet_loss").alias("packet_loss"),
                F.avg("final_tower_load").alias("tower_load"),
                F.avg("total_reward").alias("total_reward"),
            )
        )
    return out(union_sources(frames))


# ---- attribution ---------------------------------------------------------------------

from ..operators import explain as ex  # noqa: E402


def _attribution_sql() -> str:
    """Shapley values spelled out: v_abc has the row's latency / throughput / loss where a / b / c is 1, else the mean."""
    names = [("latency", "bl"), ("throughput", "bt"), ("packet_loss", "bp")]
    v = {m: S.risk(*[n[0] if bit == "1" else n[1] for n, bit in zip(names, m)]) for m in ("000", "001", "010", "011", "100", "101", "110", "111")}
    pairs = {
        "latency": [("100", "000"), ("110", "010"), ("101", "001"), ("111", "011")],
        "throughput": [("010", "000"), ("110", "100"), ("011", "001"), ("111", "101")],
        "packet_loss": [("001", "000"), ("101", "100"), ("011", "010"), ("111", "110")],
    }
    shares = ("1/3.0", "1/6.0", "1/6.0", "1/3.0")
    phis = [S.r(" + ".join(f"({w}) * ({v[x]} - {v[y]})" for w, (x, y) in zip(shares, pairs[c])), f"phi_{c}") for c in pairs]
    return (
        ", bg AS (SELECT avg(latency) AS bl, avg(throughput) AS bt, avg(packet_loss) AS bp FROM feat),\n"
        f"la AS (SELECT {KEYS_SQL}, {', '.join(phis)}, {S.r(v['000'], 'base_value')}, {S.r(v['111'], 'f_x')} FROM feat, bg)\n"
    )


@register("local_attribution", FEAT_WITH + _attribution_sql() + "SELECT * FROM la")
def local_attribution_q(spark, d):
    a = ex.local_attribution(features(spark, d))
    return out(a.select(*FLOW_KEYS, *[f"phi_{c}" for c in K.FEATURES], "base_value", "f_x"))


@register(
    "global_attribution",
    FEAT_WITH
    + _attribution_sql()
    + ", ga AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs(phi_{c})) AS m FROM la" for c in K.FEATURES)
    + ")\nSELECT feature, round(m, 6) AS mean_abs_attribution, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM ga",
)
def global_attribution_q(spark, d):
    return out(ex.global_attribution(ex.local_attribution(features(spark, d))))


# ---- model training and scoring ----------------------------------------------------------
# A fitted forest has no SQL form of its own; tests/test_forest_sql.py compares these keys row
# by row with SQL that descends the stored node table (plans/sqlforest.py).

from ..operators import forest as fo  # noqa: E402
from ..operators import ml  # noqa: E402


def training_run(spark, d) -> str:
    """Folder of the training run of the flows as they are now (``ml.save_run``)."""

    def build(path):
        fitted = ml.fit_selected(features(spark, d), FLOW_KEYS)
        ml.save_run(spark, fitted, path)
        fitted.release()

    return stored_folder(spark, "forest", _inputs(d, "lineitem"), build, settings=K.RF_CANDIDATES)


def _run(spark, d):
    """Test rows and forest of the training run."""
    path = training_run(spark, d)
    return spark.read.parquet(f"{path}/test"), ml.load_model(f"{path}/model")


@register("forest_scores")
def forest_scores_q(spark, d):
    test, model = _run(spark, d)
    return out(ml.predict(model, test).select(*FLOW_KEYS, "congestion", "prob", "pred"))


@register("thresholded_predictions")
def thresholded_predictions_q(spark, d):
    test, model = _run(spark, d)
    at = F.explode(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7)])).alias("threshold")
    p = ml.predict(model, test).select(*FLOW_KEYS, "prob", at)
    return out(p.select(*FLOW_KEYS, "threshold", "prob", (F.col("prob") > F.col("threshold")).cast("int").alias("pred")))


@register("feature_importance")
def feature_importance_q(spark, d):
    _test, model = _run(spark, d)
    rows = [(f, float(v), i + 1) for i, (f, v) in enumerate(ml.feature_importance(model))]
    return out(spark.createDataFrame(rows, "feature string, importance double, rank int"))


@register("holdout_metrics")
def holdout_metrics_q(spark, d):
    test, model = _run(spark, d)
    return out(ml.binary_metrics(ml.predict(model, test), "congestion", "pred"))


@register("metric_gate")
def metric_gate_q(spark, d):
    return out(ml.metric_gate(holdout_metrics_q(spark, d)))


@register("sensitivity_report")
def sensitivity_report_q(spark, d):
    _test, model = _run(spark, d)
    return out(ml.sensitivity_probes(spark, model))


@register("score_batch")
def score_batch_q(spark, d):
    """Model probability with safety overrides for every scored row."""
    _test, model = _run(spark, d)
    scored = ml.predict(model, ml.assemble(features(spark, d)))
    return out(sc.safety_overrides(scored).select(*FLOW_KEYS, "prob", "pred", "final_prob", "final_pred"))


@register("logistic_scores")
def logistic_scores_q(spark, d):
    path = training_run(spark, d)
    p = ml.logistic_probability(spark.read.parquet(f"{path}/test"), spark.read.parquet(f"{path}/logistic"))
    return out(p.select(*FLOW_KEYS, "prob", "pred", *[f"importance_{c}" for c in K.FEATURES]))


@register("candidate_report")
def candidate_report_q(spark, d):
    """The ladder of the selected model's fit."""
    return out(spark.read.parquet(f"{training_run(spark, d)}/report"))


@register("importance_floors")
def importance_floors_q(spark, d):
    _test, model = _run(spark, d)
    return out(ml.importance_floors(spark, model))


@register("model_local_attribution")
def model_local_attribution_q(spark, d):
    """Shapley values of the selected forest for every test row."""
    test, model = _run(spark, d)
    nodes = ml.run_nodes(spark, training_run(spark, d))
    a = ex.model_attribution(test.select(*FLOW_KEYS, *K.FEATURES), model, ex.background(features(spark, d)), nodes)
    return out(a.select(*FLOW_KEYS, *[f"phi_{c}" for c in K.FEATURES], "base_value", "f_x"))


@register("model_global_attribution")
def model_global_attribution_q(spark, d):
    return out(ex.global_attribution(model_local_attribution_q(spark, d)))


@register("forest_nodes")
def forest_nodes_q(spark, d):
    """The selected forest's nodes."""
    return out(ml.run_nodes(spark, training_run(spark, d)))


@register("node_scores")
def node_scores_q(spark, d):
    """Test rows scored by descending the stored node table."""
    path = training_run(spark, d)
    p = fo.score_nodes(spark.read.parquet(f"{path}/test"), ml.run_nodes(spark, path))
    return out(p.select(*FLOW_KEYS, "congestion", "prob", "pred"))


_IN_TEST = f"CAST(('0x' || substr({_MD5_KEY.format(seed=99)}, 1, 8)) AS BIGINT) / 4294967296.0 < 0.2"


@register(
    "forest_agreement",
    FEAT_WITH
    + f"""SELECT congestion, count(*) AS scored, CAST(0 AS BIGINT) AS apart, CAST(0 AS BIGINT) AS out_of_range
FROM feat WHERE {_IN_TEST} GROUP BY congestion""",
)
def forest_agreement_q(spark, d):
    """Test rows per class, and of them those that forest and node table score apart."""
    path = training_run(spark, d)
    p = ml.predict(ml.load_model(f"{path}/model"), spark.read.parquet(f"{path}/test")).withColumnRenamed("prob", "by_model")
    both = fo.score_nodes(p, ml.run_nodes(spark, path)).groupBy("congestion")
    apart, wild = F.abs(F.col("by_model") - F.col("prob")) > 1e-9, ~F.col("prob").between(0.0, 1.0)
    return out(both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(apart).alias("apart"), F.count_if(wild).alias("out_of_range")))


# ---- batch page ---------------------------------------------------------------------

_BATCH_PAGE = f""", bsim AS (SELECT {KEYS_SQL}, prob AS scored, least(greatest(latency, 5), 5000) AS lat, least(greatest(throughput_mbps, 10), 1000) AS tp,
               least(greatest(CASE WHEN packet_loss > 1 THEN packet_loss / 100 ELSE packet_loss END, 0), 1) AS loss,
               70.0 AS load, least(greatest(prob, 0), 1) AS prob FROM st),
bprio AS (SELECT *, {W._prios()} AS prios FROM bsim),
bpage AS (SELECT {KEYS_SQL}, scored, {_tier_sql('scored')} AS alert_level, {_state_sql('scored')} AS network_state,
                 CAST(scored > 0.5 AS INTEGER) AS congested, CASE WHEN prob < 0.08 THEN 'do_nothing' ELSE prios[1] END AS first_action FROM bprio)"""


def _batch_page(spark, d) -> DataFrame:
    s = sc.alert_tiers(states(spark, d).withColumn("tower_load", F.lit(K.BATCH_TOWER_LOAD)))
    s = s.withColumn("congested", (F.col("prob") > K.CONGESTED_ABOVE).cast("int"))
    t = wi.priority_action(_sim_cols(wi.simulator_state(s, "latency", "throughput_mbps", "packet_loss", "tower_load", "prob")))
    return t.select(*FLOW_KEYS, "prob", "alert_level", "network_state", "congested", F.col("_act").alias("first_action"))


@register(
    "batch_scores",
    ST_WITH + _BATCH_PAGE + f" SELECT {KEYS_SQL}, {S.r('scored', 'prob')}, alert_level, network_state, congested, first_action FROM bpage",
)
def batch_scores_q(spark, d):
    """Every row scored, tiered and given its first action (default tower load), in one pass."""
    return out(_batch_page(spark, d))


@register(
    "batch_score_summary",
    ST_WITH
    + _BATCH_PAGE
    + """ SELECT alert_level, first_action, count(*) AS n_rows, CAST(sum(congested) AS BIGINT) AS congested_rows, round(avg(scored), 6) AS mean_prob
FROM bpage GROUP BY alert_level, first_action""",
)
def batch_score_summary_q(spark, d):
    g = _batch_page(spark, d).groupBy("alert_level", "first_action")
    return out(g.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("congested").alias("congested_rows"), F.avg("prob").alias("mean_prob")))


# ---- uploads and stored metrics -------------------------------------------------------

from ..operators.store import scratch_folder  # noqa: E402
from ..sources.flows import accepted, quarantined, read_upload, write_report  # noqa: E402


def _upload(spark, d) -> DataFrame:
    """Model inputs as CSV files with damaged lines, read back as an upload."""
    m = model_inputs_from_lineitem(lineitem(spark, d))
    kind = F.col("l_orderkey") % 50
    latency = F.when(kind == 7, F.lit("n/a")).otherwise(F.col("latency").cast("string"))
    loss = F.when(kind == 11, F.lit("")).when(kind == 13, F.concat(F.col("packet_loss").cast("string"), F.lit(",1"))).otherwise(F.col("packet_loss").cast("string"))
    path = scratch_folder(spark, "upload")
    lines = m.select(*[F.col(c).cast("string").alias(c) for c in FLOW_KEYS], latency.alias(" latency"), F.col("throughput").cast("string").alias("throughput "), loss.alias("packet_loss"))
    lines.write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return read_upload(spark, path, K.FEATURES, {"tower_load": K.BATCH_TOWER_LOAD})


_KIND = "CASE l_orderkey % 50 WHEN 7 THEN 'no number: latency' WHEN 11 THEN 'no number: packet_loss' WHEN 13 THEN 'malformed line' END"


@register(
    "upload_quarantine",
    f"SELECT {_KIND} AS problem, count(*) AS n_lines FROM lineitem WHERE l_orderkey % 50 IN (7, 11, 13) GROUP BY 1",
)
def upload_quarantine_q(spark, d):
    """Bad lines of an upload by what is wrong with them."""
    return out(quarantined(_upload(spark, d)).groupBy("problem").agg(F.count("raw_line").alias("n_lines")))


@register(
    "upload_report",
    S.with_ctes(S.MODEL_INPUTS, f"up AS (SELECT *, {S.risk()} AS p FROM mip WHERE l_orderkey % 50 NOT IN (7, 11, 13))")
    + f"SELECT {KEYS_SQL}, {S.r('p', 'risk_score')}, {_tier_sql('p')} AS alert_level, 70.0 AS tower_load FROM up",
)
def upload_report_q(spark, d):
    """Good lines of an upload scored, written as a report and read back."""
    good = feat_ops.with_risk_score(feat_ops.prepare_features(accepted(_upload(spark, d))), "risk_score")
    path = scratch_folder(spark, "report")
    rows = good.select(*[F.col(c).cast("long").alias(c) for c in FLOW_KEYS], "risk_score", alert_tier(F.col("risk_score")).alias("alert_level"), "tower_load")
    write_report(rows, path, "csv")
    kinds = ", ".join(f"{c} long" for c in FLOW_KEYS)
    return out(spark.read.csv(path, header=True, schema=f"{kinds}, risk_score double, alert_level string, tower_load double"))


_RUNS = (0.3, 0.5, 0.7)


@register(
    "metric_runs",
    FEAT_WITH
    + f""", rl AS (SELECT {LABEL_PRED} AS y, congestion_score AS s FROM feat),
rm AS ("""
    + " UNION ALL ".join(
        f"""SELECT 'score_{int(t * 100)}' AS run, count(*) FILTER (WHERE y = 1 AND s > {t}) AS tp, count(*) FILTER (WHERE y = 0 AND s > {t}) AS fp,
  count(*) FILTER (WHERE y = 1 AND s <= {t}) AS fn, count(*) FILTER (WHERE y = 0 AND s <= {t}) AS tn FROM rl"""
        for t in _RUNS
    )
    + """)
SELECT run, tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) >= 0.8 AS passed, NULL AS problem FROM rm
UNION ALL SELECT 'torn', NULL, NULL, NULL, NULL, NULL, false, 'malformed'""",
)
def metric_runs_q(spark, d):
    """Metrics of the score at several thresholds stored as runs, one torn file among them, and the gate over all."""
    f = feat_ops.label_target(features(spark, d).drop("congestion"), "label").select("congestion", "congestion_score")
    root = scratch_folder(spark, "runs")
    for t in _RUNS:
        m = an.binary_metrics(f.withColumn("pred", (F.col("congestion_score") > t).cast("int")), "congestion", "pred")
        m.coalesce(1).write.json(f"{root}/score_{int(t * 100)}")
    spark.createDataFrame([('{"accuracy": 0.9', )], "value string").coalesce(1).write.text(f"{root}/torn")
    return out(ml.gate_runs(ml.metric_runs(spark, root)).select("run", "tp", "fp", "fn", "tn", "accuracy", "passed", "problem"))
