"""Online rule scorers of the three base models.

Each function takes a DataFrame of requests (any subset of the columns it
reads; absent or null columns take the documented default) and returns it
with the scorer's output columns appended.  Everything is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import (HIGH_RISK_TYPES, band, capped_sum, factors, get, is_round,
                                 hour_of_step, type_code)

# --- fixed values: risk bands (strict ">" in the base scorers) -------------
BEHAVIORAL_BANDS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]
FINANCIAL_BANDS = [(0.85, "CRITICAL"), (0.7, "HIGH"), (0.5, "MEDIUM"), (0.3, "LOW")]
SECURITY_BANDS = [(0.9, "CRITICAL"), (0.75, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW")]
TIERED_BANDS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]


def behavioral_features(df: DataFrame) -> DataFrame:
    """The 8 online behavioural inputs."""
    amount = get(df, "amount", None)
    if "amount" not in df.columns:
        amount = get(df, "amount_ngn", 1000.0)
    else:
        amount = F.coalesce(F.col("amount"), get(df, "amount_ngn", 1000.0))
    return df.select(
        "*",
        (1.0 / (get(df, "device_seen_count", 1) + 1)).alias("device_trust_score"),
        (~get(df, "is_device_shared", False)).cast("double").alias("device_exclusivity"),
        F.least(F.lit(1.0), get(df, "velocity_score", 5.0) / 10).alias("velocity_risk"),
        F.least(F.lit(1.0), get(df, "spending_deviation_score", 0.5)).alias("spending_anomaly"),
        get(df, "is_night_txn", False).cast("double").alias("night_risk"),
        get(df, "is_weekend", False).cast("double").alias("weekend_activity"),
        F.log1p(amount).alias("amount_log"),
        is_round(amount, 1000).cast("double").alias("round_amount"),
    )


def behavioral_risk(df: DataFrame) -> DataFrame:
    """Behavioural rule score, band and first three factors (I1b-I1d)."""
    vel = get(df, "velocity_score", 5.0)
    dev = get(df, "spending_deviation_score", 0.5)
    night = get(df, "is_night_txn", False)
    seen = get(df, "device_seen_count", 10)
    shared = get(df, "is_device_shared", False)
    score = capped_sum([(vel > 8, 0.3), (dev > 0.7, 0.3), (night, 0.2), (seen <= 3, 0.2)])
    out = df.withColumn("behavioral_score", score)
    return out.select(
        "*",
        band(F.col("behavioral_score"), BEHAVIORAL_BANDS, "MINIMAL", strict=True).alias("behavioral_level"),
        factors([(seen <= 3, "new_device"), (shared, "shared_device"), (vel > 8, "high_velocity"),
                 (dev > 0.7, "unusual_spending"), (night, "night_transaction")],
                3, "normal_behavior").alias("behavioral_factors"),
    )


def financial_features(df: DataFrame) -> DataFrame:
    """The 15 online financial inputs."""
    amount = get(df, "amount", 1000.0)
    old = get(df, "oldbalanceOrg", 10000.0)
    new = F.coalesce(F.col("newbalanceOrig"), old - amount) if "newbalanceOrig" in df.columns else old - amount
    hour = hour_of_step(get(df, "step", 100))
    return df.select(
        "*",
        F.log1p(amount).alias("amount_log"),
        F.sqrt(amount).alias("amount_sqrt"),
        (amount / (old + 1)).alias("balance_ratio"),
        (new - old).alias("balance_change"),
        type_code(get(df, "type", "PAYMENT")).alias("type_encoded"),
        (amount > 100000).cast("double").alias("is_large_amount"),
        is_round(amount, 1000).cast("double").alias("is_round_amount"),
        (old == 0).cast("double").alias("zero_balance_orig"),
        get(df, "customer_txn_count", 5).alias("customer_txn_count_f"),
        F.coalesce(get(df, "customer_avg_amount", None), amount).alias("customer_avg_amount_f")
        if "customer_avg_amount" in df.columns else amount.alias("customer_avg_amount_f"),
        hour.alias("transaction_hour"),
        hour.between(9, 17).cast("double").alias("is_business_hours"),
    )


def financial_risk(df: DataFrame) -> DataFrame:
    """Financial rule score, band, factors and amount pattern."""
    amount = get(df, "amount", 1000.0)
    old = get(df, "oldbalanceOrg", 10000.0)
    t = get(df, "type", None) if "type" in df.columns else F.lit(None).cast("string")
    risky_type = F.coalesce(t.isin(HIGH_RISK_TYPES), F.lit(False))
    score = capped_sum([(amount > 100000, 0.4), (amount > old * 0.8, 0.3), (old == 0, 0.2), (risky_type, 0.1)])
    out = df.withColumn("financial_score", score)
    return out.select(
        "*",
        band(F.col("financial_score"), FINANCIAL_BANDS, "MINIMAL", strict=True).alias("financial_level"),
        factors([(amount > 100000, "large_transaction"), (amount > old * 0.9, "account_drainage"),
                 (old == 0, "zero_balance_account"), (risky_type, "high_risk_type"),
                 (is_round(amount, 1000), "round_amount")], 3, "normal_transaction").alias("financial_factors"),
        F.when(amount > 50000, "large").when(amount > 5000, "medium").otherwise("small").alias("amount_category"),
        is_round(amount, 1000).alias("is_round"),
        ((amount > 100000) | ((amount < 100) & is_round(amount, 10))).alias("is_suspicious"),
    )


def security_risk(df: DataFrame) -> DataFrame:
    """Transaction-level security rule score, band and indicator lists."""
    amount = get(df, "amount", 1000.0)
    t = get(df, "type", None) if "type" in df.columns else F.lit(None).cast("string")
    risky_type = F.coalesce(t.isin(HIGH_RISK_TYPES), F.lit(False))
    old_rule = get(df, "oldbalanceOrg", 1000.0)
    old_pattern = get(df, "oldbalanceOrg", 0.0)
    score = capped_sum([(amount < 1, 0.3), (is_round(amount, 100), 0.2), (old_rule == 0, 0.3), (risky_type, 0.2)])
    out = df.withColumn("security_score", score)
    return out.select(
        "*",
        band(F.col("security_score"), SECURITY_BANDS, "MINIMAL", strict=True).alias("security_level"),
        factors([(amount < 1, "card_testing"), (is_round(amount, 100) & (amount > 1000), "automation_signature"),
                 (F.coalesce(t == "TRANSFER", F.lit(False)) & (amount > 100000), "large_transfer_attack"),
                 (old_pattern == 0, "account_creation_fraud")], 3, "no_attack_detected").alias("attack_patterns"),
        factors([((amount == F.round(amount)) & is_round(amount, 100), "exact_amounts"),
                 (get(df, "user_frequency", 5) > 20, "high_frequency"),
                 (get(df, "burst_detected", False), "burst_activity")], 3, "human_behavior").alias("bot_indicators"),
        factors([(get(df, "destination_popularity", 0.1) > 0.8, "popular_destination"),
                 (get(df, "velocity_score", 5.0) > 8, "velocity_anomaly"),
                 (get(df, "geo_anomaly", False), "geographic_anomaly")], 3,
                "normal_network_behavior").alias("network_anomalies"),
    )


def tiered_security(df: DataFrame) -> DataFrame:
    """Tiered security score with nine additive signals and its patterns."""
    amount = get(df, "amount", 1000.0)
    old = get(df, "oldbalanceOrg", 1000.0)
    t = get(df, "type", None) if "type" in df.columns else F.lit(None).cast("string")
    risky_type = F.coalesce(t.isin(HIGH_RISK_TYPES), F.lit(False))
    vel = get(df, "velocity_score", 5.0)
    burst = get(df, "burst_detected", False)
    size_w = F.when(amount > 100000, 0.4).when(amount > 50000, 0.3).when(amount > 10000, 0.2).otherwise(0.0)
    micro_w = F.when(amount < 1, 0.6).when(amount < 10, 0.3).otherwise(0.0)
    vel_w = F.when(vel > 8, 0.4).when(vel > 6, 0.2).otherwise(0.0)
    raw = (F.lit(0.0) + size_w + micro_w
           + F.when(old == 0, 0.5).otherwise(0.0)
           + F.when(risky_type, 0.3).otherwise(0.0)
           + vel_w
           + F.when(get(df, "device_seen_count", 10) <= 2, 0.3).otherwise(0.0)
           + F.when(get(df, "is_device_shared", False), 0.2).otherwise(0.0)
           + F.when(burst, 0.3).otherwise(0.0))
    out = df.withColumn("tiered_security_score", F.least(F.lit(1.0), raw))
    return out.select(
        "*",
        band(F.col("tiered_security_score"), TIERED_BANDS, "MINIMAL").alias("tiered_security_level"),
        factors([(amount > 100000, "large_transfer_attack"), (amount < 1, "card_testing"),
                 (old == 0, "account_creation_fraud"), (vel > 8, "velocity_attack"), (burst, "burst_pattern"),
                 (is_round(amount, 100) & (amount > 1000), "automation_signature")],
                3, "no_attack_detected").alias("tiered_patterns"),
    )
