"""Rule-scorer and decision queries (2.I, E4) over transactions / bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.accounts import account_stats
from ..operators.rules import base_models as bm
from ..operators.rules import decision as dec
from ..operators.rules import travel as tr
from ..sources import adapters as ad
from . import sqlkit as K
from .catalog import finish, r6, register
from .oracle_views import with_views

D = K.d

# ---------------------------------------------------------------- SQL mirrors
FIN_SCORE = K.capped([("amount > 100000", 0.4), ("amount > oldbalanceOrg * 0.8", 0.3),
                      ("oldbalanceOrg = 0", 0.2), ("type IN ('TRANSFER', 'CASH_OUT')", 0.1)])
FIN_FACTORS = K.factors([("amount > 100000", "large_transaction"), ("amount > oldbalanceOrg * 0.9", "account_drainage"),
                         ("oldbalanceOrg = 0", "zero_balance_account"),
                         ("coalesce(type IN ('TRANSFER', 'CASH_OUT'), false)", "high_risk_type"),
                         ("amount % 1000 = 0", "round_amount")], 3, "normal_transaction")
BEH_SCORE = K.capped([("velocity_score > 8", 0.3), ("spending_deviation_score > 0.7", 0.3),
                      ("is_night_txn", 0.2), ("device_seen_count <= 3", 0.2)])
BEH_FACTORS = K.factors([("device_seen_count <= 3", "new_device"), ("is_device_shared", "shared_device"),
                         ("velocity_score > 8", "high_velocity"), ("spending_deviation_score > 0.7", "unusual_spending"),
                         ("is_night_txn", "night_transaction")], 3, "normal_behavior")
SEC_SCORE = K.capped([("amount < 1", 0.3), ("amount % 100 = 0", 0.2), ("oldbalanceOrg = 0", 0.3),
                      ("type IN ('TRANSFER', 'CASH_OUT')", 0.2)])
TIER_SCORE = ("least(CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)"
              " + CASE WHEN amount > 100000 THEN 0.4 WHEN amount > 50000 THEN 0.3 WHEN amount > 10000 THEN 0.2 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN amount < 1 THEN 0.6 WHEN amount < 10 THEN 0.3 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN oldbalanceOrg = 0 THEN 0.5 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 0.3 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN velocity_score > 8 THEN 0.4 WHEN velocity_score > 6 THEN 0.2 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN device_seen_count <= 2 THEN 0.3 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN is_device_shared THEN 0.2 ELSE 0.0 END::DOUBLE"
              " + CASE WHEN burst_detected THEN 0.3 ELSE 0.0 END::DOUBLE)")
TIER_PATTERNS = K.factors([("amount > 100000", "large_transfer_attack"), ("amount < 1", "card_testing"),
                           ("oldbalanceOrg = 0", "account_creation_fraud"), ("velocity_score > 8", "velocity_attack"),
                           ("burst_detected", "burst_pattern"), ("amount % 100 = 0 AND amount > 1000",
                                                                 "automation_signature")], 3, "no_attack_detected")


def recal_sql(x: str, m: float, o: float) -> str:
    return f"least({D(0.95)}, greatest({D(0.01)}, {x} * {D(m)} + {D(o)}))"


# ---------------------------------------------------------------- txn scorers
@register("financial_rules", with_views(f"""
SELECT txn_id, financial_score AS financial_score,
       {K.band('financial_score', bm.FINANCIAL_BANDS, 'MINIMAL', strict=True)} AS financial_level,
       {FIN_FACTORS} AS financial_factors,
       CASE WHEN amount > 50000 THEN 'large' WHEN amount > 5000 THEN 'medium' ELSE 'small' END AS amount_category,
       amount % 1000 = 0 AS is_round,
       (amount > 100000 OR (amount < 100 AND amount % 10 = 0)) AS is_suspicious
FROM (SELECT *, {FIN_SCORE} AS financial_score FROM txn) s
""", ["txn"]))
def q_financial_rules(spark, sf):
    t = bm.financial_risk(ad.transactions(spark, sf))
    return finish(t.select("txn_id", "financial_score", "financial_level", "financial_factors",
                           "amount_category", "is_round", "is_suspicious"))


@register("security_rules", with_views(f"""
SELECT txn_id, security_score AS security_score,
       {K.band('security_score', bm.SECURITY_BANDS, 'MINIMAL', strict=True)} AS security_level,
       {K.factors([("amount < 1", "card_testing"), ("amount % 100 = 0 AND amount > 1000", "automation_signature"),
                   ("type = 'TRANSFER' AND amount > 100000", "large_transfer_attack"),
                   ("oldbalanceOrg = 0", "account_creation_fraud")], 3, "no_attack_detected")} AS attack_patterns,
       {K.factors([("amount = round(amount) AND amount % 100 = 0", "exact_amounts")], 3, "human_behavior")}
         AS bot_indicators
FROM (SELECT *, {SEC_SCORE} AS security_score FROM txn) s
""", ["txn"]))
def q_security_rules(spark, sf):
    t = bm.security_risk(ad.transactions(spark, sf))
    return finish(t.select("txn_id", "security_score", "security_level", "attack_patterns", "bot_indicators"))


@register("txn_decision", with_views(f"""
SELECT txn_id, cust_id, dest_id, amount AS amount, cust_count, cust_mean AS cust_mean,
       financial_score AS financial_score, tiered_security_score AS tiered_security_score,
       unified_score AS unified_score, contributing_models,
       {K.band('unified_score', [(t, c) for t, _, c, _ in dec.UNIFIED_TIERS], dec.UNIFIED_TIER_ELSE[1])}
         AS unified_category,
       {K.band('unified_score', dec.ACTIONS, 'APPROVE')} AS unified_action,
       financial_factors || '|' || tiered_patterns AS factors
FROM (
  SELECT *, CAST(0.0 AS DOUBLE) + fin_r * {D(0.25)} + sec_r * {D(0.15)} AS unified_score,
         CAST(2 AS BIGINT) AS contributing_models
  FROM (
    SELECT *, {recal_sql('financial_score', 5.0, 0.02)} AS fin_r,
              {recal_sql('tiered_security_score', 12.0, 0.01)} AS sec_r
    FROM (
      SELECT t.*, cs.cust_count, cs.cust_mean, {FIN_SCORE} AS financial_score, {FIN_FACTORS} AS financial_factors,
             {TIER_SCORE} AS tiered_security_score, {TIER_PATTERNS} AS tiered_patterns
      FROM (SELECT *, 5.0::DOUBLE AS velocity_score, 10 AS device_seen_count, false AS is_device_shared,
                   false AS burst_detected FROM txn) t
      JOIN (SELECT cust_id, count(amount) AS cust_count,
                   CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE) / count(amount) AS cust_mean
            FROM txn GROUP BY cust_id) cs
        USING (cust_id)
    ) a
  ) b
) c
""", ["txn"]))
def q_txn_decision(spark, sf):
    return txn_decision(ad.transactions(spark, sf))


def txn_decision(t: DataFrame) -> DataFrame:
    """Flagship: which transfers to block, review or approve, and why.

    transactions -> customer statistics (groupBy + join) -> financial and
    tiered-security rule scores -> recalibration -> unified tier."""
    cs = account_stats(t, "cust_id", "cust").select("cust_id", "cust_count", "cust_mean")
    t = t.join(cs, "cust_id", "left")
    t = bm.tiered_security(bm.financial_risk(t))
    t = t.select("*", dec.recalibrate(F.col("financial_score"), "financial").alias("fin_r"),
                 dec.recalibrate(F.col("tiered_security_score"), "security").alias("sec_r"))
    t = dec.unified_risk(t, {"financial": "fin_r", "security": "sec_r"})
    return finish(t.select("txn_id", "cust_id", "dest_id", "amount", "cust_count", "cust_mean", "financial_score",
                           "tiered_security_score", "unified_score", "contributing_models", "unified_category",
                           "unified_action",
                           F.concat("financial_factors", "tiered_patterns").alias("factors")))


# ---------------------------------------------------------------- bookings
def bookings_with_daily(spark, sf) -> DataFrame:
    """Bookings plus ``customer_bookings_today`` = earlier bookings of the
    same user on the same day (window per (user, day))."""
    b = ad.bookings(spark, sf)
    w = (Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "txn_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("customer_bookings_today", F.count(F.lit(1)).over(w))


BK_DAILY = """SELECT *, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, txn_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS customer_bookings_today FROM bookings"""


@register("behavioral_rules", with_views(f"""
SELECT txn_id, behavioral_score AS behavioral_score,
       {K.band('behavioral_score', bm.BEHAVIORAL_BANDS, 'MINIMAL', strict=True)} AS behavioral_level,
       {BEH_FACTORS} AS behavioral_factors,
       1.0 / (device_seen_count + 1) AS device_trust_score,
       least(1.0, velocity_score / 10) AS velocity_risk,
       round(ln(1 + amount), 6) AS amount_log
FROM (SELECT *, {BEH_SCORE} AS behavioral_score FROM bookings) s
""", ["bookings"]))
def q_behavioral_rules(spark, sf):
    b = bm.behavioral_risk(bm.behavioral_features(ad.bookings(spark, sf)))
    return finish(b.select("txn_id", "behavioral_score", "behavioral_level", "behavioral_factors",
                           "device_trust_score", "velocity_risk", r6("amount_log").alias("amount_log")))


@register("tiered_security", with_views(f"""
SELECT txn_id, s AS tiered_security_score,
       {K.band('s', bm.TIERED_BANDS, 'MINIMAL')} AS tiered_security_level,
       {TIER_PATTERNS} AS tiered_patterns
FROM (SELECT *, {TIER_SCORE} AS s FROM bookings) x
""", ["bookings"]))
def q_tiered_security(spark, sf):
    b = bm.tiered_security(ad.bookings(spark, sf))
    return finish(b.select("txn_id", "tiered_security_score", "tiered_security_level", "tiered_patterns"))


VPN = " OR ".join(f"starts_with(ip_address, '{p}')" for p in
                  ["185.220.", "199.87.", "104.244.", "45.142.", "198.96.", "23.129.", "171.25.", "51.15."])
NET_RULE = K.capped([("vpn_probability > 0.5", 0.35), ("geo_velocity_anomaly", 0.30),
                     ("burst_detected AND velocity_score > 7", 0.25), ("is_device_shared", 0.15),
                     ("session_hijacking_score > 0.5", 0.20)])
NET_VECTORS = ("coalesce(nullif(" + K.factors([("vpn_probability > 0.5", "vpn_or_tor_node_detected"),
                                               ("geo_velocity_anomaly", "impossible_travel_detected"),
                                               ("burst_detected AND velocity_score > 7", "botnet_automation_detected"),
                                               ("is_device_shared", "device_farm_suspected"),
                                               ("session_hijacking_score > 0.5", "session_hijacking_suspected")],
                                              None, None)
               + ", ''), CASE WHEN network_rule_score > 0.6 THEN 'ml_anomaly_pattern_detected' "
                 "ELSE 'clean_network_traffic' END)")
NET_CTE = f"""SELECT *, {NET_RULE} AS network_rule_score FROM (
  SELECT *, {K.capped([(f'({VPN})', 0.8), ('geo_velocity_anomaly', 0.3)])} AS vpn_probability FROM bookings) v"""


@register("network_rules", with_views(f"""
SELECT txn_id, vpn_probability AS vpn_probability, network_rule_score AS network_threat_score,
       {K.band('network_rule_score', tr.NETWORK_LEVELS, 'MINIMAL')} AS network_threat_level,
       {K.band('network_rule_score', tr.NETWORK_ACTIONS, 'ALLOW')} AS network_action,
       {NET_VECTORS} AS attack_vectors,
       CAST(starts_with(ip_address, '192.168.') OR starts_with(ip_address, '10.') AS BIGINT) AS is_private_ip,
       CAST(starts_with(ip_address, '185.220.') OR starts_with(ip_address, '199.87.')
            OR starts_with(ip_address, '1.2.3.') OR starts_with(ip_address, '5.6.7.') AS BIGINT) AS is_suspicious_ip
FROM net
""", ["bookings"], [("net", NET_CTE)]))
def q_network_rules(spark, sf):
    b = tr.network_rules(ad.bookings(spark, sf))
    return finish(b.select("txn_id", "vpn_probability", "network_threat_score", "network_threat_level",
                           "network_action", "attack_vectors", "is_private_ip", "is_suspicious_ip"))


CTX = K.capped([("amount > 100000", 0.15), ("card_age_days < 30", 0.10), ("NOT cvv_verification", 0.10),
                ("is_international", 0.05), ("burst_detected", 0.10)], cap=0.4)


@register("context_calibration", with_views(f"""
SELECT txn_id, ctx AS context_modifier,
       least({D(0.95)}, behavioral_score * {D(6.0)} + ctx * {D(0.5)}) AS behavioral_calibrated,
       least({D(0.95)}, financial_score * {D(5.0)} + ctx * {D(0.3)}) AS financial_calibrated
FROM (SELECT *, {CTX} AS ctx, {BEH_SCORE} AS behavioral_score, {FIN_SCORE} AS financial_score FROM bookings) s
""", ["bookings"]))
def q_context_calibration(spark, sf):
    b = tr.calibrate_in_context(bm.financial_risk(bm.behavioral_risk(ad.bookings(spark, sf))))
    return finish(b.select("txn_id", "context_modifier", "behavioral_calibrated", "financial_calibrated"))


AG_RAW = ("(CAST(0.0 AS DOUBLE) + CASE WHEN age < 30 THEN 0.6 WHEN age < 90 THEN 0.3 ELSE 0.0 END::DOUBLE"
          " + CASE WHEN n < 10 THEN 0.4 ELSE 0.0 END::DOUBLE"
          " + CASE WHEN cb > 0.05 THEN 0.7 WHEN cb > 0.02 THEN 0.3 ELSE 0.0 END::DOUBLE"
          " + CASE WHEN NOT lic THEN 0.4 ELSE 0.0 END::DOUBLE"
          " + CASE WHEN growth > 5.0 THEN 0.5 ELSE 0.0 END::DOUBLE)")
AG_FACTORS = K.factors([("age < 30", "very_new_agency"), ("age >= 30 AND age < 90", "new_agency"),
                        ("n < 10", "limited_transaction_history"), ("cb > 0.05", "high_chargeback_rate"),
                        ("cb <= 0.05 AND cb > 0.02", "elevated_chargeback_rate"), ("NOT lic", "unverified_license"),
                        ("growth > 5.0", "suspicious_rapid_growth")], None, None)
AG_CTE = """SELECT b.*, a.agency_id IS NOT NULL AS present, coalesce(a.agency_age_days, 0) AS age,
       coalesce(a.total_transactions, 0) AS n, coalesce(a.chargeback_rate, 0.0) AS cb,
       coalesce(a.license_verified, false) AS lic, coalesce(a.volume_growth_30d, 0.0) AS growth
FROM bk b LEFT JOIN agencies a ON b.agency_id = a.agency_id"""
AGENCY_SQL = f"CASE WHEN present THEN least({D(1.0)}, {AG_RAW}) ELSE {D(0.5)} END"
AGENCY_F = f"CASE WHEN present THEN {AG_FACTORS} ELSE 'no_agency_data' END"
BOOK_RAW = ("(CAST(0.0 AS DOUBLE) + CASE WHEN amount > 100000 THEN 0.5 WHEN amount > 50000 THEN 0.3 ELSE 0.0 END::DOUBLE"
            " + CASE WHEN days_to_travel < 1 THEN 0.6 WHEN days_to_travel < 3 THEN 0.4 ELSE 0.0 END::DOUBLE"
            " + CASE WHEN is_international THEN 0.2 ELSE 0.0 END::DOUBLE"
            " + CASE WHEN passenger_count > 20 THEN 0.4 WHEN passenger_count > 10 THEN 0.2 ELSE 0.0 END::DOUBLE"
            " + destination_risk_score * 0.3::DOUBLE)")
BOOK_F = K.factors([("amount > 100000", "extremely_high_value_booking"),
                    ("amount <= 100000 AND amount > 50000", "high_value_booking"),
                    ("days_to_travel < 1", "same_day_booking"), ("days_to_travel >= 1 AND days_to_travel < 3",
                                                                 "last_minute_booking"),
                    ("is_international", "international_booking"), ("passenger_count > 20", "large_group_booking"),
                    ("passenger_count <= 20 AND passenger_count > 10", "group_booking"),
                    ("destination_risk_score > 0.5", "high_risk_destination")], None, None)
SIG_RAW = ("(CAST(0.0 AS DOUBLE) + CASE WHEN amount < 50 THEN 0.7 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN refund_requested_immediately THEN 0.8 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN NOT has_passenger_names THEN 0.4 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN customer_bookings_today > 5 THEN 0.6 WHEN customer_bookings_today > 2 THEN 0.3 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN card_country IS DISTINCT FROM billing_country THEN 0.4 ELSE 0.0 END::DOUBLE)")
SIG_F = K.factors([("amount < 50", "card_testing_amount"), ("refund_requested_immediately", "immediate_refund_request"),
                   ("NOT has_passenger_names", "missing_passenger_details"),
                   ("customer_bookings_today > 5", "excessive_daily_bookings"),
                   ("customer_bookings_today <= 5 AND customer_bookings_today > 2", "multiple_daily_bookings"),
                   ("card_country IS DISTINCT FROM billing_country", "card_country_mismatch")], None, None)
PAY_RAW = ("(CAST(0.0 AS DOUBLE) + CASE WHEN payment_method IN ('prepaid_card', 'virtual_card', 'cryptocurrency') THEN 0.6"
           " WHEN payment_method = 'debit_card' THEN 0.2 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN card_age_days < 30 THEN 0.3 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN NOT cvv_verification THEN 0.5 ELSE 0.0 END::DOUBLE"
           " + CASE WHEN NOT avs_verification THEN 0.4 ELSE 0.0 END::DOUBLE)")
PAY_F = ("array_to_string(list_filter([CASE WHEN payment_method IN ('prepaid_card', 'virtual_card', 'cryptocurrency') "
         "THEN 'high_risk_payment_' || payment_method WHEN payment_method = 'debit_card' THEN 'debit_card_payment' END, "
         "CASE WHEN card_age_days < 30 THEN 'new_payment_card' END, "
         "CASE WHEN NOT cvv_verification THEN 'cvv_verification_failed' END, "
         "CASE WHEN NOT avs_verification THEN 'address_verification_failed' END], lambda x: x IS NOT NULL), '|')")
TRAVEL_CTE = f"""SELECT *, least({D(1.0)}, travel_raw) AS travel_score FROM (
  SELECT *, CAST(0.0 AS DOUBLE) + agency_risk * {D(0.3)} + booking_risk * {D(0.25)} + signature_risk * {D(0.25)}
            + payment_risk * {D(0.2)} AS travel_raw
  FROM (SELECT *, {AGENCY_SQL} AS agency_risk, {AGENCY_F} AS agency_factors,
               least({D(1.0)}, {BOOK_RAW}) AS booking_risk, {BOOK_F} AS booking_factors,
               least({D(1.0)}, {SIG_RAW}) AS signature_risk, {SIG_F} AS signature_factors,
               least({D(1.0)}, {PAY_RAW}) AS payment_risk, {PAY_F} AS payment_factors
        FROM ag) p) q"""
TRAVEL_FACTORS = ("array_to_string(list_slice(list_filter(string_split(agency_factors || '|' || booking_factors || '|' "
                  "|| signature_factors || '|' || payment_factors, '|'), lambda x: x <> ''), 1, 5), '|')")


def travel_frame(spark, sf) -> DataFrame:
    return tr.travel_risk(bookings_with_daily(spark, sf), ad.agencies(spark, sf))


@register("travel_score", with_views(f"""
SELECT txn_id, agency_risk AS agency_risk, agency_factors, booking_risk AS booking_risk,
       booking_factors, signature_risk AS signature_risk, signature_factors,
       payment_risk AS payment_risk, payment_factors, travel_score AS travel_score,
       {K.band('travel_raw', tr.RISK_LEVELS, 'MINIMAL')} AS travel_level, {TRAVEL_FACTORS} AS travel_factors
FROM trv
""", ["bookings", "agencies"], [("bk", BK_DAILY), ("ag", AG_CTE), ("trv", TRAVEL_CTE)]))
def q_travel_score(spark, sf):
    t = travel_frame(spark, sf)
    return finish(t.select("txn_id", "agency_risk", "agency_factors", "booking_risk", "booking_factors",
                           "signature_risk", "signature_factors", "payment_risk", "payment_factors",
                           "travel_score", "travel_level", "travel_factors"))


VEL_CTE = """SELECT *,
  count(*) OVER w AS recent_count,
  CAST(coalesce(sum(CAST(amount AS DECIMAL(38,2))) OVER w, 0) AS DOUBLE) AS recent_sum
FROM bookings
WINDOW w AS (PARTITION BY agency_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING)"""
VEL_SCORE = ("least(CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)"
             " + CASE WHEN recent_count > 10 THEN 0.6 WHEN recent_count > 5 THEN 0.3 ELSE 0.0 END::DOUBLE"
             " + CASE WHEN recent_count > 0 AND recent_sum + amount > 500000 THEN 0.7"
             " WHEN recent_count > 0 AND recent_sum + amount > 200000 THEN 0.4 ELSE 0.0 END::DOUBLE"
             " + CASE WHEN recent_count > 0 AND amount > recent_sum / recent_count * 5 THEN 0.4 ELSE 0.0 END::DOUBLE)")
VEL_F = K.factors([("recent_count > 10", "high_transaction_velocity"),
                   ("recent_count <= 10 AND recent_count > 5", "elevated_transaction_velocity"),
                   ("recent_count > 0 AND recent_sum + amount > 500000", "high_volume_concentration"),
                   ("recent_count > 0 AND recent_sum + amount <= 500000 AND recent_sum + amount > 200000",
                    "elevated_volume_concentration"),
                   ("recent_count > 0 AND amount > recent_sum / recent_count * 5", "amount_pattern_deviation")],
                  None, None)


@register("velocity_6h", with_views(f"""
SELECT txn_id, agency_id, recent_count, recent_sum AS recent_sum, {VEL_SCORE} AS realtime_score,
       {VEL_F} AS realtime_factors
FROM vel
""", ["bookings"], [("vel", VEL_CTE)]))
def q_velocity_6h(spark, sf):
    v = dec.velocity_6h(ad.bookings(spark, sf))
    return finish(v.select("txn_id", "agency_id", "recent_count", F.coalesce("recent_sum", F.lit(0.0)).alias("recent_sum"),
                           "realtime_score", "realtime_factors"))


def decision_frame(spark, sf) -> DataFrame:
    """The whole online assessment as one plan: bookings -> daily counts ->
    base rule scores -> context calibration -> network rules -> travel
    rules (agency join) -> 6 h velocity -> ensemble decision."""
    b = bookings_with_daily(spark, sf)
    b = tr.calibrate_in_context(bm.financial_risk(bm.behavioral_risk(b)))
    b = tr.network_rules(b)
    b = tr.travel_risk(b, ad.agencies(spark, sf))
    b = dec.velocity_6h(b)
    return dec.decide(b)


DECISION_SQL = f"""
SELECT *, CASE WHEN (network_rule_score >= 0.5 AND overall_risk >= 0.35) OR (amount > 100000 AND overall_risk >= 0.40)
                    OR overall_risk >= 0.55 THEN 'BLOCK'
               WHEN (amount > 50000 AND overall_risk >= 0.25) OR overall_risk >= 0.35 THEN 'MANUAL_REVIEW'
               WHEN overall_risk >= 0.20 THEN 'MONITOR' ELSE 'APPROVE' END AS action_code
FROM (
  SELECT *, CAST(0.0 AS DOUBLE) + {D(0.5)} * {D(0.2)} + beh_c * {D(0.15)} + fin_c * {D(0.15)}
            + travel_score * {D(0.25)} + rt * {D(0.1)} + network_rule_score * {D(0.15)} AS overall_risk
  FROM (
    SELECT t.*, least({D(0.95)}, {BEH_SCORE} * {D(6.0)} + {CTX} * {D(0.5)}) AS beh_c,
           least({D(0.95)}, {FIN_SCORE} * {D(5.0)} + {CTX} * {D(0.3)}) AS fin_c,
           {VEL_SCORE} AS rt
    FROM (SELECT trv.*, vel.recent_count, vel.recent_sum, nr.network_rule_score
          FROM trv JOIN vel USING (txn_id) JOIN net nr USING (txn_id)) t
  ) x
) y"""


@register("final_decision", with_views(f"""
SELECT txn_id, agency_id, overall_risk AS overall_risk, action_code,
       CASE action_code WHEN 'BLOCK' THEN 'FRAUD_DETECTED' WHEN 'MANUAL_REVIEW' THEN 'HIGH_RISK'
            WHEN 'MONITOR' THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS decision_category,
       CASE action_code WHEN 'BLOCK' THEN 0.98 WHEN 'MANUAL_REVIEW' THEN 0.95 WHEN 'MONITOR' THEN 0.90
            ELSE 0.85 END::DOUBLE AS decision_confidence,
       {K.band('overall_risk', dec.RISK_CATEGORIES, 'MINIMAL')} AS risk_category
FROM dcs
""", ["bookings", "agencies"], [("bk", BK_DAILY), ("ag", AG_CTE), ("trv", TRAVEL_CTE), ("vel", VEL_CTE),
                                ("net", NET_CTE), ("dcs", DECISION_SQL)]))
def q_final_decision(spark, sf):
    d = decision_frame(spark, sf)
    return finish(d.select("txn_id", "agency_id", "overall_risk", "action_code", "decision_category",
                           "decision_confidence", dec.risk_category(F.col("overall_risk")).alias("risk_category")))


@register("alerts", with_views("""
SELECT 'ALERT_' || CAST(txn_id AS VARCHAR) AS alert_id, agency_id, txn_id AS transaction_id,
       amount, overall_risk AS risk_score, action_code,
       CASE WHEN action_code = 'BLOCK' THEN 'CRITICAL' ELSE 'HIGH' END AS priority
FROM dcs WHERE action_code IN ('BLOCK', 'MANUAL_REVIEW')
""", ["bookings", "agencies"], [("bk", BK_DAILY), ("ag", AG_CTE), ("trv", TRAVEL_CTE), ("vel", VEL_CTE),
                                ("net", NET_CTE), ("dcs", DECISION_SQL)]))
def q_alerts(spark, sf):
    return finish(dec.alerts(decision_frame(spark, sf)).drop("alert_ts"))


@register("unified_risk", with_views(f"""
SELECT txn_id, beh_r AS behavioral_recal, fin_r AS financial_recal,
       sec_r AS security_recal, u AS unified_score,
       {K.band('u', [(t, c) for t, _, c, _ in dec.UNIFIED_TIERS], dec.UNIFIED_TIER_ELSE[1])} AS unified_category,
       CASE WHEN u >= 0.75 THEN 0.95 WHEN u >= 0.55 THEN 0.90 WHEN u >= 0.35 THEN 0.85 WHEN u >= 0.15 THEN 0.80
            ELSE 0.90 END::DOUBLE AS unified_confidence,
       {K.band('u', dec.ACTIONS, 'APPROVE')} AS unified_action,
       {K.band('u', dec.FRAUD_CATEGORIES, 'MINIMAL')} AS fraud_category
FROM (SELECT *, CAST(0.0 AS DOUBLE) + beh_r * {D(0.25)} + fin_r * {D(0.25)} + sec_r * {D(0.15)} AS u FROM (
  SELECT *, {recal_sql(BEH_SCORE, 8.0, 0.05)} AS beh_r, {recal_sql(FIN_SCORE, 5.0, 0.02)} AS fin_r,
            {recal_sql(TIER_SCORE, 12.0, 0.01)} AS sec_r FROM bookings) r) s
""", ["bookings"]))
def q_unified_risk(spark, sf):
    b = bm.tiered_security(bm.financial_risk(bm.behavioral_risk(ad.bookings(spark, sf))))
    b = b.select("*", dec.recalibrate(F.col("behavioral_score"), "behavioral").alias("behavioral_recal"),
                 dec.recalibrate(F.col("financial_score"), "financial").alias("financial_recal"),
                 dec.recalibrate(F.col("tiered_security_score"), "security").alias("security_recal"))
    b = dec.unified_risk(b, {"behavioral": "behavioral_recal", "financial": "financial_recal",
                             "security": "security_recal"})
    return finish(b.select("txn_id", "behavioral_recal", "financial_recal", "security_recal", "unified_score",
                           "unified_category", "unified_confidence", "unified_action", "fraud_category"))


# ---------------------------------------------------------------- credit fold (I16)
FOLD_STEP = """
  SELECT agency_id, rn, txn_id, t1 AS trust, action,
         lim AS old_limit,
         CASE action WHEN 'EXPAND' THEN lim * 1.25::DOUBLE WHEN 'CONTRACT' THEN lim * 0.5::DOUBLE ELSE lim END AS lim,
         CASE WHEN action = 'PAUSE' THEN util ELSE util + amount END AS util,
         CASE action WHEN 'PAUSE' THEN 'PAUSED' WHEN 'CONTRACT' THEN 'RESTRICTED' WHEN 'EXPAND' THEN 'ACTIVE'
              ELSE status END AS status
  FROM (
    SELECT *, CASE WHEN risk >= 0.6 OR cb > 0.05 THEN 'PAUSE' WHEN risk >= 0.4 OR cb > 0.02 THEN 'CONTRACT'
                   WHEN risk < 0.2 AND t1 > 0.7 AND cb = 0.0 AND util + amount > lim * 0.8::DOUBLE THEN 'EXPAND'
                   ELSE 'MAINTAIN' END AS action
    FROM (SELECT s.agency_id, s.rn, s.txn_id, s.risk, s.amount, s.cb, p.lim, p.util, p.status,
                 greatest(0.0::DOUBLE, least(1.0::DOUBLE, p.trust - (s.risk - 0.3::DOUBLE) * 0.5::DOUBLE)) AS t1
          FROM {prev} JOIN seq s ON s.agency_id = p.agency_id AND s.rn = {rn}) a
  ) b"""
CREDIT_SQL = ("WITH RECURSIVE " + with_views(f"""
SELECT agency_id, txn_id, action, old_limit, lim AS new_limit, util AS utilized_credit, trust AS trust_score, status
FROM fold""", ["bookings", "agencies"], [
    ("bk", BK_DAILY), ("ag", AG_CTE), ("trv", TRAVEL_CTE), ("vel", VEL_CTE), ("net", NET_CTE), ("dcs", DECISION_SQL),
    ("seq", """SELECT d.agency_id, d.txn_id, d.amount, d.overall_risk AS risk, coalesce(a.chargeback_rate, 0.0) AS cb,
                      row_number() OVER (PARTITION BY d.agency_id ORDER BY d.ts, d.txn_id) AS rn
               FROM dcs d LEFT JOIN agencies a ON d.agency_id = a.agency_id"""),
    ("fold", FOLD_STEP.format(prev="(SELECT agency_id, 10000.0::DOUBLE AS lim, 0.5::DOUBLE AS trust, 0.0::DOUBLE AS util, "
                                   "'ACTIVE' AS status FROM seq WHERE rn = 1) p", rn="1")
     + " UNION ALL " + FOLD_STEP.format(prev="fold p", rn="p.rn + 1")),
])[len("WITH "):])


@register("credit_fold", CREDIT_SQL)
def q_credit_fold(spark, sf):
    from ..operators.credit import credit_decisions
    d = decision_frame(spark, sf)
    return finish(credit_decisions(d, ad.agencies(spark, sf)))
