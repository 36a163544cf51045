"""Hand-computed fixtures of the online assessment (FIXTURES.md 2.1-2.4)."""
import pytest
from pyspark.sql import functions as F

from ledgerhawk.operators.credit import credit_decisions, step
from ledgerhawk.operators.rules import base_models as bm
from ledgerhawk.operators.rules import decision as dec
from ledgerhawk.operators.rules import travel as tr

SUSPICIOUS = dict(txn_id=1, agency_id=1, amount=150000.0, passenger_count=25, days_to_travel=2,
                  is_international=True, destination_risk_score=0.7, payment_method="prepaid_card",
                  card_age_days=15, cvv_verification=False, customer_bookings_today=3, type="TRANSFER",
                  oldbalanceOrg=0.0, newbalanceOrig=0.0, step=150, device_seen_count=1, is_device_shared=True,
                  velocity_score=9.5, burst_detected=True, user_frequency=25, ip_address="185.220.101.2",
                  geo_velocity_anomaly=True, ts="2024-01-01 10:00:00")
TRUSTED = dict(txn_id=2, agency_id=2, amount=12000.0, passenger_count=2, days_to_travel=45, is_international=False,
               destination_risk_score=0.1, payment_method="corporate_card", card_age_days=300,
               cvv_verification=True, customer_bookings_today=1, type="PAYMENT", oldbalanceOrg=50000.0,
               newbalanceOrig=38000.0, step=150, device_seen_count=50, is_device_shared=False, velocity_score=2.0,
               burst_detected=False, user_frequency=5,
               ts="2024-01-01 10:00:00")
AGENCIES = [dict(agency_id=1, agency_age_days=15, total_transactions=5, chargeback_rate=0.08, license_verified=False,
                 volume_growth_30d=8.0),
            dict(agency_id=2, agency_age_days=450, total_transactions=1250, chargeback_rate=0.0,
                 license_verified=True, volume_growth_30d=1.1)]


def _assess(spark, row):
    b = spark.createDataFrame([row]).withColumn("ts", F.to_timestamp("ts"))
    a = spark.createDataFrame(AGENCIES)
    b = tr.calibrate_in_context(bm.financial_risk(bm.behavioral_risk(b)))
    b = tr.network_rules(b)
    b = tr.travel_risk(b, a)
    b = dec.velocity_6h(b)
    return dec.decide(b), a


def test_suspicious_agency(spark):
    d, a = _assess(spark, SUSPICIOUS)
    r = d.first()
    assert r["behavioral_score"] == pytest.approx(0.5) and r["behavioral_calibrated"] == pytest.approx(0.95)
    assert r["financial_score"] == pytest.approx(1.0) and r["financial_calibrated"] == pytest.approx(0.95)
    assert r["context_modifier"] == pytest.approx(0.4)
    assert (r["agency_risk"], r["booking_risk"], r["signature_risk"], r["payment_risk"]) == pytest.approx(
        (1.0, 1.0, 0.7, 1.0))
    assert r["travel_score"] == pytest.approx(0.925)
    assert r["realtime_score"] == pytest.approx(0.0)
    assert r["network_threat_score"] == pytest.approx(1.0) and r["network_threat_level"] == "CRITICAL"
    assert r["overall_risk"] == pytest.approx(0.76625) and r["action_code"] == "BLOCK"
    c = credit_decisions(d, a).first()
    assert c["action"] == "PAUSE" and c["trust_score"] == pytest.approx(0.266875)
    assert c["old_limit"] == 10000 and c["new_limit"] == 10000 and c["utilized_credit"] == 0


def test_trusted_agency(spark):
    d, a = _assess(spark, TRUSTED)
    r = d.first()
    assert (r["behavioral_calibrated"], r["financial_calibrated"], r["context_modifier"]) == pytest.approx((0, 0, 0))
    assert (r["agency_risk"], r["booking_risk"], r["signature_risk"], r["payment_risk"]) == pytest.approx(
        (0.0, 0.03, 0.4, 0.0))
    assert r["travel_score"] == pytest.approx(0.1075)
    assert r["overall_risk"] == pytest.approx(0.126875) and r["action_code"] == "APPROVE"
    init = spark.createDataFrame([dict(agency_id=2, current_limit=50000.0, trust_score=0.85, utilized_credit=45000.0)])
    c = credit_decisions(d, a, init).first()
    assert c["action"] == "EXPAND" and c["trust_score"] == pytest.approx(0.9365625)
    assert c["new_limit"] == pytest.approx(62500) and c["utilized_credit"] == pytest.approx(57000)


def test_recalibrated_unified(spark):
    df = spark.createDataFrame([dict(b=0.5, f=1.0, s=1.0)])
    df = df.select(dec.recalibrate(F.col("b"), "behavioral").alias("br"),
                   dec.recalibrate(F.col("f"), "financial").alias("fr"),
                   dec.recalibrate(F.col("s"), "security").alias("sr"))
    r = dec.unified_risk(df, {"behavioral": "br", "financial": "fr", "security": "sr"}).first()
    assert r["unified_score"] == pytest.approx(0.6175)
    assert r["recommendation"] == "MANUAL REVIEW REQUIRED" and r["unified_category"] == "HIGH_RISK"
    assert r["unified_confidence"] == pytest.approx(0.90) and r["contributing_models"] == 3


def test_single_scorers(spark):
    beh = spark.createDataFrame([dict(device_seen_count=2, is_device_shared=True, velocity_score=9.2,
                                      spending_deviation_score=0.85, is_night_txn=True, is_weekend=False,
                                      amount_ngn=50000.0)])
    r = bm.behavioral_risk(beh).first()
    assert r["behavioral_score"] == pytest.approx(1.0) and r["behavioral_level"] == "CRITICAL"
    fin = spark.createDataFrame([dict(amount=150000.0, type="TRANSFER", oldbalanceOrg=200000.0, newbalanceOrig=50000.0,
                                      step=150)])
    r = bm.financial_risk(fin).first()
    assert r["financial_score"] == pytest.approx(0.5) and r["financial_level"] == "LOW"
    sec = spark.createDataFrame([dict(amount=0.5, type="TRANSFER", oldbalanceOrg=0.0, newbalanceOrig=0.0, step=150,
                                      user_frequency=25, velocity_score=9.2, burst_detected=True,
                                      destination_popularity=0.9)])
    r = bm.security_risk(sec).first()
    assert r["security_score"] == pytest.approx(0.8) and r["security_level"] == "HIGH"
    bands = spark.createDataFrame([(x,) for x in (0.40, 0.30, 0.20, 0.10, 0.09)], ["p"])
    got = [x[0] for x in bands.select(dec.deployment_band(F.col("p"))).collect()]
    assert got == ["HIGH", "MEDIUM-HIGH", "MEDIUM", "LOW-MEDIUM", "LOW"]


def test_credit_step_boundaries():
    s = {"limit": 10000.0, "trust": 0.5, "utilized": 0.0, "status": "ACTIVE"}
    assert step(s, 0.4, 100.0, 0.0)["action"] == "CONTRACT" and s["limit"] == 5000.0 and s["utilized"] == 100.0
    assert step(s, 0.1, 100.0, 0.03)["action"] == "CONTRACT"
    assert step(s, 0.1, 100.0, 0.06)["action"] == "PAUSE" and s["utilized"] == 200.0


def test_missing_agency_is_unknown(spark):
    b = spark.createDataFrame([dict(txn_id=5, agency_id=99, amount=100.0)])
    r = tr.travel_risk(b, spark.createDataFrame(AGENCIES)).first()
    assert r["agency_risk"] == 0.5 and r["agency_factors"] == ["no_agency_data"]
