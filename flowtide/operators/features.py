"""Flow KPIs, model features and congestion targets.

The production path is ``fit_feature_profile`` (quantile jobs, returns
scalars) followed by ``apply_feature_profile`` (pure projection), so a fitted
profile can score batch or streaming data identically.  ``create_features``
chains both and adds the congestion target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import clip, finite, is_finite, nan_to_null, risk_score, to_number
from .clean import drop_non_finite, min_max_scale
from .profile import Profile, RowProfile, quantiles, safe_scale
from .window import IDX, ordered_index, rolling, rolling_mean


def _c(name: str):
    return F.col(f"`{name}`")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Missing column: {c}")


def raw_kpis(df: DataFrame) -> DataFrame:
    """Non-negative inputs and raw latency = duration / (fwd + bwd + 1)."""
    require_columns(df, K.REQUIRED_FLOW_COLUMNS)
    out = df.withColumns(
        {
            "_dur": to_number(_c("flow_duration")),
            "fwd_packets": to_number(_c("total_fwd_packets")),
            "bwd_packets": to_number(_c("total_backward_packets")),
            "raw_throughput": to_number(_c("flow_bytes_s")),
        }
    )
    out = out.withColumns({c: clip(c, 0.0) for c in ["_dur", "fwd_packets", "bwd_packets", "raw_throughput"]})
    return out.withColumns(
        {
            "total_packets": F.col("fwd_packets") + F.col("bwd_packets"),
            "raw_latency": F.col("_dur") / (F.col("fwd_packets") + F.col("bwd_packets") + 1),
        }
    ).drop("_dur")


def direct_loss_column(df: DataFrame) -> str | None:
    for c in K.DIRECT_LOSS_CANDIDATES:
        if c in df.columns:
            return c
    return None


def label_column(df: DataFrame) -> str | None:
    for c in K.LABEL_CANDIDATES:
        if c in df.columns:
            return c
    return None


def fit_feature_profile(kpis: DataFrame, method: str = "exact") -> Profile:
    """Scalars the feature projection needs, in one quantile pass."""
    loss_col = direct_loss_column(kpis)
    targets = {"lat": ("raw_latency", [K.SCALE_Q]), "tp": ("raw_throughput", [K.SCALE_Q])}
    if loss_col is None:
        targets["fwd"] = ("fwd_packets", [K.FWD_CONFIDENCE_Q])
    else:
        targets["loss"] = (to_number(_c(loss_col)), [])
    q = quantiles(kpis, targets, method=method)
    prof = {
        "latency_clip": safe_scale(q["lat"][0], q["lat__max"]),
        "throughput_clip": safe_scale(q["tp"][0], q["tp__max"]),
        "loss_column": loss_col,
    }
    if loss_col is None:
        prof["fwd_scale"] = safe_scale(q["fwd"][0], q["fwd__max"])
    else:
        prof["loss_is_percent"] = q["loss__max"] is not None and q["loss__max"] > 1
    return Profile(prof)


def direct_packet_loss(df: DataFrame, loss_col: str, is_percent: bool | Column) -> DataFrame:
    v = to_number(_c(loss_col))
    v = F.when(is_percent if isinstance(is_percent, Column) else F.lit(bool(is_percent)), v / 100).otherwise(v)
    return df.withColumn("packet_loss", v).withColumn("packet_loss", clip("packet_loss", 0.0, 1.0))


def inferred_packet_loss(df: DataFrame, fwd_scale: float | Column) -> DataFrame:
    """Forward deficit (fwd-bwd)+/(fwd+1) weighted by log-volume confidence."""
    fwd, bwd = F.col("fwd_packets"), F.col("bwd_packets")
    scale = fwd_scale if isinstance(fwd_scale, Column) else F.lit(float(fwd_scale))
    out = df.withColumns({"_gap": fwd - bwd, "_conf": F.log1p(fwd) / F.log1p(scale)})
    out = out.withColumns({"_gap": clip("_gap", 0.0), "_conf": clip("_conf", 0.0, 1.0)})
    out = out.withColumn("_deficit", F.col("_gap") / (fwd + 1))
    out = out.withColumn("_deficit", clip("_deficit", 0.0, 1.0))
    out = out.withColumn("packet_loss", F.col("_deficit") * F.col("_conf"))
    return out.withColumn("packet_loss", clip("packet_loss", 0.0, 1.0)).drop("_gap", "_conf", "_deficit")


def apply_feature_profile(kpis: DataFrame, prof: Profile | RowProfile) -> DataFrame:
    """Scaled features from a fitted profile; rows with a non-finite feature drop.

    A ``Profile`` gives literals, a ``RowProfile`` joins its row: no job either way.
    """
    lc, tc = prof.column("latency_clip"), prof.column("throughput_clip")
    out = prof.attach(kpis).withColumns({"latency": clip("raw_latency", 0.0, lc), "throughput": clip("raw_throughput", 0.0, tc)})
    out = out.withColumns(
        {
            "latency": F.col("latency") / lc * F.lit(K.LATENCY_MAX),
            "throughput": F.log1p(F.col("throughput")) / F.log1p(tc),
        }
    )
    if "fwd_scale" in prof:
        out = inferred_packet_loss(out, prof.column("fwd_scale"))
    else:
        out = direct_packet_loss(out, direct_loss_column(kpis), prof.column("loss_is_percent"))
    return drop_non_finite(prof.detach(out), K.FEATURES)


def prepare_features(df: DataFrame) -> DataFrame:
    """Clip to the model ranges: latency 0-5000, throughput 0-1, loss 0-1."""
    out = df.withColumns({c: to_number(_c(c)) for c in K.FEATURES})
    return out.withColumns(
        {
            "latency": clip("latency", 0.0, K.LATENCY_MAX),
            "throughput": clip("throughput", 0.0, K.THROUGHPUT_MAX),
            "packet_loss": clip("packet_loss", 0.0, K.LOSS_MAX),
        }
    )


def with_risk_score(df: DataFrame, out_col: str = "congestion_score") -> DataFrame:
    """Risk score column; inputs are clipped into helper columns first so the
    generated code stays small."""
    t = df.withColumns(
        {
            "_lr": clip("latency", 0.0, K.LATENCY_MAX),
            "_tr": clip("throughput", 0.0, K.THROUGHPUT_MAX),
            "_pr": clip("packet_loss", 0.0, K.LOSS_MAX),
        }
    )
    t = t.withColumn(out_col, risk_score(F.col("_lr"), F.col("_tr"), F.col("_pr")))
    return t.drop("_lr", "_tr", "_pr")


def risk_components(df: DataFrame) -> DataFrame:
    p = prepare_features(df)
    return p.withColumns(
        {
            "latency_risk": F.col("latency") / F.lit(K.LATENCY_MAX),
            "throughput_risk": F.col("throughput"),
            "packet_loss_risk": F.col("packet_loss"),
        }
    )


def fit_target(df: DataFrame, score_col: str = "congestion_score", method: str = "exact") -> dict:
    """The rule that splits the score in two classes.

    >= p75 (0.5 if p75 is null or <= 0); if that leaves one class, > median; if
    still one class, the top 25 % rows (``target_share``: that many).  Thresholds
    and extremes come from the quantile jobs alone.
    """
    q = quantiles(df, {"s": (score_col, [K.TARGET_Q, 0.5])}, method=method)
    n = q["s__n"]
    p75, med = q["s"]
    thr = p75 if p75 is not None and p75 > 0 else 0.5
    low, high = q["s__min"], q["s__max"]  # they tell whether a cut leaves two classes
    if n and low < thr <= high:
        return {"target_cut": thr, "target_above": False}
    if n and low <= med < high:
        return {"target_cut": med, "target_above": True}
    if n <= 1:
        return {"target_cut": thr, "target_above": False}
    return {"target_top": max(1, int(n * K.TOP_SHARE))}


def apply_target(df: DataFrame, prof: Profile | RowProfile, score_col: str = "congestion_score") -> DataFrame:
    """Target from a fitted cut: scores at the cut count unless the rule is strict."""
    s = F.col(score_col)
    cut = (s > prof.column("target_cut")) | ((s == prof.column("target_cut")) & ~prof.column("target_above"))
    return prof.detach(prof.attach(df).withColumn("congestion", cut.cast("int")))


def risk_target(df: DataFrame, score_col: str = "congestion_score", tie_col: str | list[str] | None = None, method: str = "exact", rule: dict | None = None) -> DataFrame:
    """Binary target from the risk score by ``fit_target``'s rule.

    Where no cut leaves two classes, exactly the top 25 % rows by score count
    (ties broken by ``tie_col``, one or more columns ascending; all columns where
    none is given).
    """
    rule = rule or fit_target(df, score_col, method)
    if "target_cut" in rule:
        return apply_target(df, Profile(rule), score_col)
    ties = [tie_col] if isinstance(tie_col, str) else list(tie_col or df.columns)
    ranked, _ = ordered_index(df.withColumn("_falling", -F.col(score_col)), ["_falling", *ties])
    return ranked.withColumn("congestion", (F.col(IDX) < F.lit(rule["target_top"])).cast("int")).drop("_falling", IDX)


def label_target(df: DataFrame, label_col: str) -> DataFrame:
    """Congested when the label is not BENIGN (trim, upper; null counts) or loss >= 0.30."""
    lab = F.upper(F.regexp_replace(_c(label_col), r"^\s+|\s+$", ""))
    attack = lab.isNull() | (lab != K.BENIGN_LABEL)
    return df.withColumn("congestion", (attack | (F.col("packet_loss") >= K.LABEL_LOSS_FLOOR)).cast("int"))


HELPERS = ["fwd_packets", "bwd_packets", "total_packets", "raw_latency", "raw_throughput"]


def fit_profile(df: DataFrame, method: str = "exact") -> Profile:
    """Everything that ``create_features`` needs to know of the whole table: scales and,
    where the target comes from the score, its cut."""
    kpis = raw_kpis(df)
    prof = fit_feature_profile(kpis, method=method)
    if _given_target(df) is None and label_column(df) is None:
        prof.update(fit_target(with_risk_score(apply_feature_profile(kpis, prof)), method=method))
    return prof


def _given_target(df: DataFrame) -> str | None:
    return next((c for c in ("congestion", "congestion_flag") if c in df.columns), None)


def create_features(df: DataFrame, method: str = "exact", profile: Profile | RowProfile | None = None, tie_col: str | list[str] | None = None) -> DataFrame:
    """Raw flows -> latency/throughput/packet_loss + congestion target.

    Target precedence: ``congestion`` > ``congestion_flag`` > label > risk score.
    With a profile that ``fit_profile`` made, no job is started.
    """
    kpis = raw_kpis(df)
    profile = profile or fit_profile(df, method)
    feats = apply_feature_profile(kpis, profile).drop(*HELPERS)
    if (given := _given_target(df)) is not None:
        feats = feats.withColumn("congestion", to_number(_c(given)).cast("int"))
    elif label_column(df) is not None:
        feats = label_target(feats, label_column(df))
    else:
        feats = with_risk_score(feats)
        feats = apply_target(feats, profile) if "target_cut" in profile else risk_target(feats, tie_col=tie_col, method=method)
    return feats.where(F.col("congestion").isNotNull())


# ---- compatibility (legacy) feature path ------------------------------------


def legacy_features(df: DataFrame) -> DataFrame:
    """latency = duration / packets-per-s (0 -> missing); throughput and loss min-max."""
    if "flow_duration" not in df.columns or "flow_bytes_s" not in df.columns:
        raise ValueError("Missing required legacy columns")
    packets = to_number(_c("flow_packets_s")) if "flow_packets_s" in df.columns else F.lit(1.0)
    packets = F.when(packets != 0, packets)
    out = df.withColumns({"_packets": packets, "_bytes": to_number(_c("flow_bytes_s"))})
    out = out.withColumn("latency", F.try_divide(to_number(_c("flow_duration")), F.col("_packets")))
    ext = out.agg(
        F.min("_bytes").alias("bmn"), F.max("_bytes").alias("bmx"), F.min("_packets").alias("pmn"), F.max("_packets").alias("pmx")
    ).collect()[0]
    out = min_max_scale(out, "_bytes", "throughput", (ext["bmn"], ext["bmx"]))
    out = min_max_scale(out, "_packets", "packet_loss", (ext["pmn"], ext["pmx"]))
    return drop_non_finite(out.drop("_packets", "_bytes"), K.FEATURES)


def legacy_engineered(df: DataFrame, order_cols: list[str], method: str = "exact", block_rows: int = 100_000) -> DataFrame:
    """Normalised features, rolling-3 means in row order, ratios and the 0/1 flag."""
    ext = df.agg(
        F.min(nan_to_null(F.col("latency"))).alias("lmn"),
        F.max(nan_to_null(F.col("latency"))).alias("lmx"),
        F.min(nan_to_null(F.col("throughput"))).alias("tmn"),
        F.max(nan_to_null(F.col("throughput"))).alias("tmx"),
    ).collect()[0]
    out = min_max_scale(df, "latency", "latency_norm", (ext["lmn"], ext["lmx"]))
    out = min_max_scale(out, "throughput", "throughput_norm", (ext["tmn"], ext["tmx"]))
    indexed, _n = ordered_index(out, order_cols)
    h = K.LEGACY_ROLLING - 1
    out = rolling(
        indexed,
        [{"rolling_latency_mean": rolling_mean("latency_norm", K.LEGACY_ROLLING), "rolling_throughput_mean": rolling_mean("throughput_norm", K.LEGACY_ROLLING)}],
        halo=h,
        block_rows=block_rows,
    )
    out = out.withColumns(
        {
            "load_ratio": F.col("latency_norm") / (F.col("throughput_norm") + F.lit(K.LOAD_RATIO_EPS)),
            "packet_intensity": F.col("packet_loss") * F.col("latency_norm"),
            "hour_of_day": F.lit(0).cast("int"),
        }
    )
    if "congestion" in out.columns:
        return out.withColumn("congestion_flag", F.col("congestion").cast("int"))
    if "congestion_flag" in out.columns:
        return out
    # the score does not use the rolling columns, so its quantile is fitted without them, on the rows kept by the index
    thr = quantiles(with_risk_score(indexed, "_score"), {"s": ("_score", [K.TARGET_Q])}, method=method)["s"][0]
    return with_risk_score(out, "_score").withColumn("congestion_flag", (F.col("_score") >= F.lit(thr)).cast("int")).drop("_score")


def build_features(df: DataFrame, order_cols: list[str], method: str = "exact") -> DataFrame:
    """Production path when the flow columns exist, else the legacy path."""
    if all(c in df.columns for c in K.REQUIRED_FLOW_COLUMNS):
        base = create_features(df, method=method)
    else:
        base = legacy_features(df)
    return legacy_engineered(base, order_cols, method=method)


def fit_visual(df: DataFrame, method: str = "exact") -> Profile:
    """The p99 of latency and throughput over rows with all features."""
    q = quantiles(drop_non_finite(df, K.FEATURES), {"l": ("latency", [K.SCALE_Q]), "t": ("throughput", [K.SCALE_Q])}, method=method)
    return Profile({"latency_p99": q["l"][0], "throughput_p99": q["t"][0]})


def visual_features(df: DataFrame, method: str = "exact", profile: Profile | RowProfile | None = None) -> DataFrame:
    """Plot-ready features: p99-clipped latency/throughput, clipped loss, log1p.

    With a profile that ``fit_visual`` made, no job is started.
    """
    profile = profile or fit_visual(df, method)
    clean = profile.attach(drop_non_finite(df, K.FEATURES))
    lat = clip(F.col("latency"), 0.0, profile.column("latency_p99") if "latency_p99" in profile else None)
    tp = clip(F.col("throughput"), 0.0, profile.column("throughput_p99") if "throughput_p99" in profile else None)
    return profile.detach(
        clean.withColumns(
            {
                "latency": lat,
                "throughput": tp,
                "packet_loss": clip(F.col("packet_loss"), 0.0, 1.0),
                "log_latency": F.log1p(lat),
                "log_throughput": F.log1p(tp),
            }
        )
    )


__all__ = [
    "apply_feature_profile", "apply_target", "build_features", "create_features", "direct_packet_loss", "finite",
    "fit_feature_profile", "fit_profile", "fit_target", "fit_visual", "inferred_packet_loss", "label_target", "legacy_engineered", "legacy_features",
    "prepare_features", "raw_kpis", "risk_components", "risk_target", "visual_features", "with_risk_score",
]
