"""Network-security rules, context calibration and travel rules.

All are projections over a bookings DataFrame; the agency record arrives
by a left join (C9) and an agency without a record takes the
"no agency data" path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import (band, capped_sum, factors, get, is_private_ip, starts_with_any,
                                 SUSPICIOUS_PREFIXES, vpn_probability)

# --- fixed values ----------------------------------------------------------
NETWORK_LEVELS = [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (0.1, "LOW")]
NETWORK_ACTIONS = [(0.7, "BLOCK_IMMEDIATELY"), (0.5, "RATE_LIMIT"), (0.3, "ENHANCED_MONITORING"),
                   (0.1, "LOG_AND_MONITOR")]
RISK_LEVELS = [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (0.15, "LOW")]
HIGH_RISK_PAYMENTS = ["prepaid_card", "virtual_card", "cryptocurrency"]


def network_rules(df: DataFrame, ml_score: Column | None = None) -> DataFrame:
    """Rule threat score from IP / device / session signals, combined with an
    optional model score by ``max`` (I8)."""
    ip = get(df, "ip_address", "0.0.0.0")
    geo = get(df, "geo_velocity_anomaly", False)
    burst = get(df, "burst_detected", False)
    vel = get(df, "velocity_score", 0.0)
    shared = get(df, "is_device_shared", False)
    hijack = get(df, "session_hijacking_score", 0.0)
    vpn = vpn_probability(ip, geo)
    rule = capped_sum([(vpn > 0.5, 0.35), (geo, 0.30), (burst & (vel > 7), 0.25), (shared, 0.15),
                       (hijack > 0.5, 0.20)])
    out = df.select("*", vpn.alias("vpn_probability"), rule.alias("network_rule_score"),
                    is_private_ip(ip).cast("int").alias("is_private_ip"),
                    starts_with_any(ip, SUSPICIOUS_PREFIXES).cast("int").alias("is_suspicious_ip"))
    ml = ml_score if ml_score is not None else F.lit(0.0)
    out = out.withColumn("network_threat_score", F.greatest(ml, F.col("network_rule_score")))
    s = F.col("network_threat_score")
    vectors = factors([(F.col("vpn_probability") > 0.5, "vpn_or_tor_node_detected"),
                       (geo, "impossible_travel_detected"),
                       (burst & (vel > 7), "botnet_automation_detected"),
                       (shared, "device_farm_suspected"),
                       (hijack > 0.5, "session_hijacking_suspected")], None, None)
    vectors = (F.when(F.size(vectors) > 0, vectors)
               .when(s > 0.6, F.array(F.lit("ml_anomaly_pattern_detected")))
               .otherwise(F.array(F.lit("clean_network_traffic"))))
    return out.select("*", band(s, NETWORK_LEVELS, "MINIMAL").alias("network_threat_level"),
                      band(s, NETWORK_ACTIONS, "ALLOW").alias("network_action"),
                      vectors.alias("attack_vectors"))


def context_modifier(df: DataFrame) -> Column:
    """Context risk modifier in [0, 0.4]."""
    return capped_sum([
        (get(df, "amount", 0.0) > 100000, 0.15),
        (get(df, "card_age_days", 365) < 30, 0.10),
        (F.coalesce(get(df, "cvv_verification", True) == F.lit(False), F.lit(False)), 0.10),
        (get(df, "is_international", False), 0.05),
        (get(df, "burst_detected", False), 0.10),
    ], cap=0.4)


def calibrate_in_context(df: DataFrame, network_raw: Column | None = None) -> DataFrame:
    """Per-model calibration with the context modifier.

    Needs ``behavioral_score`` and ``financial_score`` (rule scores); the
    network model's raw probability is optional — absent, no network
    column is produced and the decision uses its default."""
    out = df.withColumn("context_modifier", context_modifier(df))
    ctx = F.col("context_modifier")
    cols = [F.least(F.lit(0.95), F.col("behavioral_score") * 6.0 + ctx * 0.5).alias("behavioral_calibrated"),
            F.least(F.lit(0.95), F.col("financial_score") * 5.0 + ctx * 0.3).alias("financial_calibrated")]
    if network_raw is not None:
        cols.append(F.least(F.lit(0.95), network_raw * 4.0 + ctx).alias("network_calibrated"))
    return out.select("*", *cols)


# --- travel rules (I10) ------------------------------------------------------
def agency_risk(df: DataFrame) -> DataFrame:
    """Agency risk from the joined agency record; rows whose record is
    absent score 0.5 with ``no_agency_data`` (I10a, C9).  The presence test
    is ``agency_age_days IS NOT NULL`` after the left join."""
    present = F.col("agency_record_present")
    age = F.coalesce(F.col("agency_age_days"), F.lit(0))
    n = F.coalesce(F.col("total_transactions"), F.lit(0))
    cb = F.coalesce(F.col("chargeback_rate"), F.lit(0.0))
    lic = F.coalesce(F.col("license_verified"), F.lit(False))
    growth = F.coalesce(F.col("volume_growth_30d"), F.lit(0.0))
    raw = (F.lit(0.0) + F.when(age < 30, 0.6).when(age < 90, 0.3).otherwise(0.0)
           + F.when(n < 10, 0.4).otherwise(0.0)
           + F.when(cb > 0.05, 0.7).when(cb > 0.02, 0.3).otherwise(0.0)
           + F.when(~lic, 0.4).otherwise(0.0)
           + F.when(growth > 5.0, 0.5).otherwise(0.0))
    facs = factors([(age < 30, "very_new_agency"), ((age >= 30) & (age < 90), "new_agency"),
                    (n < 10, "limited_transaction_history"), (cb > 0.05, "high_chargeback_rate"),
                    ((cb <= 0.05) & (cb > 0.02), "elevated_chargeback_rate"), (~lic, "unverified_license"),
                    (growth > 5.0, "suspicious_rapid_growth")], None, None)
    return df.select(
        "*",
        F.when(present, F.least(F.lit(1.0), raw)).otherwise(F.lit(0.5)).alias("agency_risk"),
        F.when(present, facs).otherwise(F.array(F.lit("no_agency_data"))).alias("agency_factors"))


def booking_risk(df: DataFrame) -> DataFrame:
    amount = get(df, "amount", 0.0)
    days = get(df, "days_to_travel", 30)
    intl = get(df, "is_international", False)
    pax = get(df, "passenger_count", 1)
    dest = get(df, "destination_risk_score", 0.0)
    raw = (F.lit(0.0) + F.when(amount > 100000, 0.5).when(amount > 50000, 0.3).otherwise(0.0)
           + F.when(days < 1, 0.6).when(days < 3, 0.4).otherwise(0.0)
           + F.when(intl, 0.2).otherwise(0.0)
           + F.when(pax > 20, 0.4).when(pax > 10, 0.2).otherwise(0.0)
           + dest * 0.3)
    facs = factors([(amount > 100000, "extremely_high_value_booking"),
                    ((amount <= 100000) & (amount > 50000), "high_value_booking"),
                    (days < 1, "same_day_booking"), ((days >= 1) & (days < 3), "last_minute_booking"),
                    (intl, "international_booking"), (pax > 20, "large_group_booking"),
                    ((pax <= 20) & (pax > 10), "group_booking"), (dest > 0.5, "high_risk_destination")],
                   None, None)
    return df.select("*", F.least(F.lit(1.0), raw).alias("booking_risk"), facs.alias("booking_factors"))


def fraud_signatures(df: DataFrame, bookings_today: str = "customer_bookings_today") -> DataFrame:
    """Card testing, refund, missing names, bookings per day and a null-safe
    card / billing country mismatch (I10c)."""
    amount = get(df, "amount", 0.0)
    refund = get(df, "refund_requested_immediately", False)
    names = get(df, "has_passenger_names", False)
    today = get(df, bookings_today, 0)
    card = get(df, "card_country", None) if "card_country" in df.columns else F.lit(None).cast("string")
    bill = get(df, "billing_country", None) if "billing_country" in df.columns else F.lit(None).cast("string")
    mismatch = ~card.eqNullSafe(bill)
    raw = (F.lit(0.0) + F.when(amount < 50, 0.7).otherwise(0.0)
           + F.when(refund, 0.8).otherwise(0.0)
           + F.when(~names, 0.4).otherwise(0.0)
           + F.when(today > 5, 0.6).when(today > 2, 0.3).otherwise(0.0)
           + F.when(mismatch, 0.4).otherwise(0.0))
    facs = factors([(amount < 50, "card_testing_amount"), (refund, "immediate_refund_request"),
                    (~names, "missing_passenger_details"), (today > 5, "excessive_daily_bookings"),
                    ((today <= 5) & (today > 2), "multiple_daily_bookings"), (mismatch, "card_country_mismatch")],
                   None, None)
    return df.select("*", F.least(F.lit(1.0), raw).alias("signature_risk"), facs.alias("signature_factors"))


def payment_risk(df: DataFrame) -> DataFrame:
    pm = get(df, "payment_method", "unknown")
    new_card = get(df, "card_age_days", 365) < 30
    cvv_fail = F.coalesce(get(df, "cvv_verification", True) == F.lit(False), F.lit(False))
    avs_fail = F.coalesce(get(df, "avs_verification", True) == F.lit(False), F.lit(False))
    hi = pm.isin(HIGH_RISK_PAYMENTS)
    raw = (F.lit(0.0) + F.when(hi, 0.6).when(pm == "debit_card", 0.2).otherwise(0.0)
           + F.when(new_card, 0.3).otherwise(0.0)
           + F.when(cvv_fail, 0.5).otherwise(0.0)
           + F.when(avs_fail, 0.4).otherwise(0.0))
    first = F.when(hi, F.concat(F.lit("high_risk_payment_"), pm)).when(pm == "debit_card", F.lit("debit_card_payment"))
    facs = F.filter(F.array(first, F.when(new_card, F.lit("new_payment_card")),
                            F.when(cvv_fail, F.lit("cvv_verification_failed")),
                            F.when(avs_fail, F.lit("address_verification_failed"))), lambda x: x.isNotNull())
    return df.select("*", F.least(F.lit(1.0), raw).alias("payment_risk"), facs.alias("payment_factors"))


def travel_risk(bookings: DataFrame, agencies: DataFrame | None) -> DataFrame:
    """All four travel parts and the weighted travel score (I10a-e).

    ``agencies`` is one row per agency (small dimension); the join is a
    plain left join so Catalyst/AQE choose broadcast vs. shuffle from its
    measured size."""
    df = bookings
    if agencies is not None:
        a = agencies.withColumn("agency_record_present", F.lit(True))
        df = df.join(a, "agency_id", "left")
        df = df.withColumn("agency_record_present", F.coalesce(F.col("agency_record_present"), F.lit(False)))
    else:
        df = df.withColumn("agency_record_present", F.lit(False))
        for c, t in [("agency_age_days", "int"), ("total_transactions", "int"), ("chargeback_rate", "double"),
                     ("license_verified", "boolean"), ("volume_growth_30d", "double")]:
            df = df.withColumn(c, F.lit(None).cast(t))
    df = payment_risk(fraud_signatures(booking_risk(agency_risk(df))))
    raw = (F.lit(0.0) + F.col("agency_risk") * 0.3 + F.col("booking_risk") * 0.25
           + F.col("signature_risk") * 0.25 + F.col("payment_risk") * 0.2)
    df = df.withColumn("travel_raw", raw)
    all_f = F.concat("agency_factors", "booking_factors", "signature_factors", "payment_factors")
    return df.select("*", F.least(F.lit(1.0), F.col("travel_raw")).alias("travel_score"),
                     band(F.col("travel_raw"), RISK_LEVELS, "MINIMAL").alias("travel_level"),
                     F.slice(all_f, 1, 5).alias("travel_factors"))
