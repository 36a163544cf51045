"""Decision operators: 6-hour velocity, ensemble decision, alerts,
recalibration, unified risk and the score bands (E4, I11-I15, I18-I22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scalar import band, epoch_micros, factors, money

# --- fixed values ------------------------------------------------------------
ENSEMBLE_WEIGHTS = {"network": 0.20, "behavioral": 0.15, "financial": 0.15, "travel": 0.25,
                    "realtime": 0.10, "security": 0.15}
ENSEMBLE_DEFAULTS = {"network": 0.5, "behavioral": 0.5, "financial": 0.5, "travel": 0.5,
                     "realtime": 0.0, "security": 0.0}
RECALIBRATION = {"network_intelligence": (3.5, 0.1), "behavioral": (8.0, 0.05), "financial": (5.0, 0.02),
                 "security": (12.0, 0.01)}
RECALIBRATION_UNKNOWN = (2.0, 0.1)
UNIFIED_WEIGHTS = {"network_intelligence": 0.35, "behavioral": 0.25, "financial": 0.25, "security": 0.15}
UNIFIED_TIERS = [(0.75, "BLOCK TRANSACTION IMMEDIATELY", "FRAUD_DETECTED", 0.95),
                 (0.55, "MANUAL REVIEW REQUIRED", "HIGH_RISK", 0.90),
                 (0.35, "ENHANCED MONITORING", "MEDIUM_RISK", 0.85),
                 (0.15, "APPROVE WITH MONITORING", "LOW_RISK", 0.80)]
UNIFIED_TIER_ELSE = ("APPROVE TRANSACTION", "MINIMAL_RISK", 0.90)
ACTIONS = [(0.7, "BLOCK"), (0.5, "MANUAL_REVIEW"), (0.3, "MONITOR")]
FRAUD_CATEGORIES = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]
RISK_CATEGORIES = [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (0.15, "LOW")]
MODEL_BANDS = [(0.8, "HIGH"), (0.5, "MEDIUM")]
DEPLOYMENT_BANDS = [(0.40, "HIGH"), (0.30, "MEDIUM-HIGH"), (0.20, "MEDIUM"), (0.10, "LOW-MEDIUM")]
THREAT_LEVELS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]
THREAT_ACTIONS = [(0.8, "BLOCK_IMMEDIATELY"), (0.6, "RATE_LIMIT"), (0.4, "ENHANCED_MONITORING"), (0.2, "LOG_AND_MONITOR")]
HOUR_MICROS = 3600 * 1000000


def velocity_6h(df: DataFrame, key: str = "agency_id", ts: str = "ts", amount: str = "amount",
                hours: int = 6, mode: str = "split") -> DataFrame:
    """Trailing-window velocity risk per agency.

    History = earlier rows of the same agency with time in (t-6h, t); rows
    with an equal timestamp are not history.  Count and sum are differences
    of running totals (``trailing_totals``), so a busy agency costs no more a
    row than a quiet one; ``mode="plain"`` is the range frame itself.  The
    frame is not stored, so scores and factors that nobody reads are not made."""
    from ..ordered import time_window, trailing_totals
    d = df.withColumn("_us", epoch_micros(df, ts))
    if mode == "plain":
        f = lambda w: w.rangeBetween(-hours * HOUR_MICROS + 1, -1)
        out = time_window(d, key, "_us", [], hours * HOUR_MICROS, lambda w: [
            F.count(F.lit(1)).over(f(w)).alias("recent_count"),
            F.sum(money(F.col(amount))).over(f(w)).cast("double").alias("recent_sum")], mode=mode)
    else:
        out = trailing_totals(d, key, "_us", amount, {"recent": hours * HOUR_MICROS}, own=False, stored=False)
    out = out.drop("_us")
    n, s, a = F.col("recent_count"), F.coalesce(F.col("recent_sum"), F.lit(0.0)), F.col(amount)
    avg = F.try_divide(s, n)
    total = s + a
    raw = (F.lit(0.0) + F.when(n > 10, 0.6).when(n > 5, 0.3).otherwise(0.0)
           + F.when((n > 0) & (total > 500000), 0.7).when((n > 0) & (total > 200000), 0.4).otherwise(0.0)
           + F.when((n > 0) & (a > avg * 5), 0.4).otherwise(0.0))
    facs = factors([(n > 10, "high_transaction_velocity"), ((n <= 10) & (n > 5), "elevated_transaction_velocity"),
                    ((n > 0) & (total > 500000), "high_volume_concentration"),
                    ((n > 0) & (total <= 500000) & (total > 200000), "elevated_volume_concentration"),
                    ((n > 0) & (a > avg * 5), "amount_pattern_deviation")], None, None)
    return out.select("*", F.least(F.lit(1.0), raw).alias("realtime_score"), facs.alias("realtime_factors"))


def decide(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Weighted ensemble and the hard block / review / monitor / approve
    rules (I11).  Missing component columns take the reference defaults."""
    src = {"network": "network_calibrated", "behavioral": "behavioral_calibrated",
           "financial": "financial_calibrated", "travel": "travel_score",
           "realtime": "realtime_score", "security": "network_threat_score"}
    score = F.lit(0.0)
    comp = {}
    for k, c in src.items():
        v = F.coalesce(F.col(c), F.lit(ENSEMBLE_DEFAULTS[k])) if c in df.columns else F.lit(ENSEMBLE_DEFAULTS[k])
        comp[k] = v
        score = score + v * ENSEMBLE_WEIGHTS[k]
    out = df.withColumn("overall_risk", score)
    r, a, sec = F.col("overall_risk"), F.coalesce(F.col(amount), F.lit(0.0)), comp["security"]
    block = ((sec >= 0.5) & (r >= 0.35)) | ((a > 100000) & (r >= 0.40)) | (r >= 0.55)
    review = ((a > 50000) & (r >= 0.25)) | (r >= 0.35)
    action = F.when(block, "BLOCK").when(review, "MANUAL_REVIEW").when(r >= 0.20, "MONITOR").otherwise("APPROVE")
    out = out.withColumn("action_code", action)
    ac = F.col("action_code")
    return out.select(
        "*",
        F.when(ac == "BLOCK", "FRAUD_DETECTED").when(ac == "MANUAL_REVIEW", "HIGH_RISK")
        .when(ac == "MONITOR", "MEDIUM_RISK").otherwise("LOW_RISK").alias("decision_category"),
        F.when(ac == "BLOCK", 0.98).when(ac == "MANUAL_REVIEW", 0.95).when(ac == "MONITOR", 0.90)
        .otherwise(0.85).alias("decision_confidence"),
    )


def alerts(decided: DataFrame, id_col: str = "txn_id", key: str = "agency_id") -> DataFrame:
    """One alert per BLOCK / MANUAL_REVIEW decision (I13); the id is built
    from the transaction id so it never collides."""
    return (decided.filter(F.col("action_code").isin("BLOCK", "MANUAL_REVIEW"))
            .select(F.concat(F.lit("ALERT_"), F.col(id_col).cast("string")).alias("alert_id"),
                    F.col(key).alias("agency_id"), F.col(id_col).alias("transaction_id"), "amount",
                    F.col("overall_risk").alias("risk_score"), "action_code",
                    F.when(F.col("action_code") == "BLOCK", "CRITICAL").otherwise("HIGH").alias("priority"),
                    F.col("ts").alias("alert_ts") if "ts" in decided.columns else F.current_timestamp().alias("alert_ts")))


def risk_category(score: Column) -> Column:
    """>= .7 CRITICAL, .5 HIGH, .3 MEDIUM, .15 LOW."""
    return band(score, RISK_CATEGORIES, "MINIMAL")


def recalibrate(score: Column, model: str) -> Column:
    """Linear recalibration clamped to [.01, .95]."""
    m, o = RECALIBRATION.get(model, RECALIBRATION_UNKNOWN)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.01), score * m + o))


def unified_risk(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Weighted sum over the models present (no renormalising) with the
    five tiers, action and category (I15).  ``scores`` maps model name to
    the column of its (recalibrated) score; a null score counts absent."""
    total = F.lit(0.0)
    present = F.lit(0)
    for m, w in UNIFIED_WEIGHTS.items():
        if m in scores:
            c = F.col(scores[m])
            total = total + F.coalesce(c * w, F.lit(0.0))
            present = present + F.when(c.isNotNull(), 1).otherwise(0)
    out = df.withColumn("unified_score", total).withColumn("contributing_models", present)
    u = F.col("unified_score")
    rec = cat = conf = None
    for thr, r, c, k in UNIFIED_TIERS:
        rec = F.when(u >= thr, F.lit(r)) if rec is None else rec.when(u >= thr, F.lit(r))
        cat = F.when(u >= thr, F.lit(c)) if cat is None else cat.when(u >= thr, F.lit(c))
        conf = F.when(u >= thr, F.lit(k)) if conf is None else conf.when(u >= thr, F.lit(k))
    r0, c0, k0 = UNIFIED_TIER_ELSE
    return out.select("*", rec.otherwise(F.lit(r0)).alias("recommendation"),
                      cat.otherwise(F.lit(c0)).alias("unified_category"),
                      conf.otherwise(F.lit(k0)).alias("unified_confidence"),
                      band(u, ACTIONS, "APPROVE").alias("unified_action"),
                      band(u, FRAUD_CATEGORIES, "MINIMAL").alias("fraud_category"))


def model_band(p: Column) -> Column:
    """Batch scorer bucket: >= .8 HIGH, >= .5 MEDIUM, else LOW."""
    return band(p, MODEL_BANDS, "LOW")


def deployment_band(p: Column) -> Column:
    """Deployment bands .40/.30/.20/.10."""
    return band(p, DEPLOYMENT_BANDS, "LOW")


def threat_band(p: Column) -> tuple[Column, Column, Column]:
    """Threat level, action and is_threat (> .5)."""
    return band(p, THREAT_LEVELS, "MINIMAL"), band(p, THREAT_ACTIONS, "ALLOW"), p > 0.5
