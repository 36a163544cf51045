"""The twelve warehouse tables, declared, and their sample rows.

Column names, types and constraints are fixed values: they say what the stored
tables look like.  JSON columns are strings, addresses strings, uuids strings.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators.constraints import TableRules

# --- fixed values: table definitions -----------------------------------------
WAREHOUSE = {
    "users": TableRules(
        "user_id string, email string, created_at timestamp, updated_at timestamp, country_code string, age_group string, "
        "customer_segment string, total_bookings int, total_spent decimal(12,2), last_activity timestamp, status string, "
        "kyc_status string, risk_score decimal(5,4), metadata string",
        ("user_id",), not_null=("email",), unique=(("email",),)),
    "agencies": TableRules(
        "agency_id string, agency_name string, license_number string, registration_country string, business_type string, "
        "commission_rate decimal(5,4), onboarding_date timestamp, kyc_status string, risk_category string, total_transactions int, "
        "total_volume decimal(15,2), status string, metadata string",
        ("agency_id",), not_null=("agency_name",)),
    "transactions": TableRules(
        "transaction_id string, user_id string, agency_id string, booking_type string, amount decimal(12,2), currency string, "
        "booking_date timestamp, travel_date date, destination string, source_country string, payment_method string, "
        "device_fingerprint string, ip_address string, session_id string, user_agent string, status string, created_at timestamp, "
        "metadata string",
        ("transaction_id",), not_null=("user_id", "agency_id", "booking_type", "amount", "booking_date"),
        checks={"positive_amount": "amount > 0"},
        foreign={("user_id",): ("users", ("user_id",)), ("agency_id",): ("agencies", ("agency_id",))}),
    "network_nodes": TableRules(
        "node_id string, node_type string, created_at timestamp, last_seen timestamp, degree_centrality decimal(8,6), "
        "betweenness_centrality decimal(8,6), eigenvector_centrality decimal(8,6), pagerank decimal(8,6), "
        "closeness_centrality decimal(8,6), clustering_coefficient decimal(8,6), triangle_count int, core_number int, "
        "local_efficiency decimal(8,6), in_degree_weighted decimal(15,2), out_degree_weighted decimal(15,2), in_degree_count int, "
        "out_degree_count int, flow_ratio decimal(8,6), community_id int, community_size int, updated_at timestamp",
        ("node_id",), not_null=("node_type",)),
    "network_edges": TableRules(
        "edge_id string, source_node string, target_node string, edge_type string, total_weight decimal(15,2), transaction_count int, "
        "first_interaction timestamp, last_interaction timestamp, avg_amount decimal(12,2), frequency_score decimal(8,6), "
        "recency_score decimal(8,6), created_at timestamp, updated_at timestamp",
        ("edge_id",), not_null=("source_node", "target_node"), unique=(("source_node", "target_node", "edge_type"),)),
    "risk_scores": TableRules(
        "score_id string, transaction_id string, user_id string, agency_id string, fraud_probability decimal(8,6), fraud_prediction int, "
        "risk_bucket string, model_version string, risk_factors array<string>, feature_values map<string,double>, "
        "processing_time_ms decimal(8,2), created_at timestamp",
        ("score_id",), not_null=("transaction_id", "user_id", "agency_id", "fraud_probability", "fraud_prediction", "risk_bucket"),
        checks={"binary_prediction": "fraud_prediction IN (0, 1)"},
        foreign={("transaction_id",): ("transactions", ("transaction_id",))}),
    "high_risk_transactions": TableRules(
        "id string, transaction_id string, user_id string, agency_id string, risk_data string, investigation_status string, "
        "assigned_investigator string, resolution_notes string, created_at timestamp, updated_at timestamp",
        ("id",), not_null=("transaction_id", "user_id", "agency_id", "risk_data")),
    "anomalies": TableRules(
        "anomaly_id string, entity_type string, entity_id string, anomaly_type string, severity string, score decimal(8,6), "
        "details string, status string, created_at timestamp",
        ("anomaly_id",), not_null=("entity_type", "entity_id", "anomaly_type", "severity", "score")),
    "user_features": TableRules(
        "user_id string, avg_transaction_amount decimal(12,2), transaction_frequency decimal(8,4), booking_diversity decimal(8,4), "
        "preferred_destinations array<string>, avg_advance_booking_days decimal(6,2), weekend_booking_ratio decimal(8,4), "
        "night_booking_ratio decimal(8,4), device_count int, ip_count int, location_consistency_score decimal(8,4), "
        "network_risk_score decimal(8,4), updated_at timestamp",
        ("user_id",), foreign={("user_id",): ("users", ("user_id",))}),
    "agency_features": TableRules(
        "agency_id string, avg_transaction_amount decimal(12,2), customer_count int, repeat_customer_ratio decimal(8,4), "
        "cancellation_rate decimal(8,4), customer_satisfaction_score decimal(8,4), complaint_count int, response_time_avg decimal(8,2), "
        "chargebacks_count int, dispute_ratio decimal(8,4), unusual_pattern_count int, updated_at timestamp",
        ("agency_id",), foreign={("agency_id",): ("agencies", ("agency_id",))}),
    "alerts": TableRules(
        "alert_id string, alert_type string, severity string, title string, description string, entity_type string, entity_id string, "
        "alert_data string, status string, acknowledged_by string, acknowledged_at timestamp, resolved_at timestamp, created_at timestamp",
        ("alert_id",), not_null=("alert_type", "severity", "title")),
    "model_performance": TableRules(
        "id string, model_name string, model_version string, evaluation_date date, auc_score decimal(8,6), precision_score decimal(8,6), "
        "recall_score decimal(8,6), f1_score decimal(8,6), total_predictions int, fraud_predictions int, actual_frauds int, "
        "evaluation_data string, created_at timestamp",
        ("id",), not_null=("model_name", "model_version", "evaluation_date")),
}

# --- fixed values: sample rows -------------------------------------------------
USERS = [("U001", "user1@example.com", "US", "25-34", "premium"), ("U002", "user2@example.com", "UK", "35-44", "regular"),
         ("U003", "user3@example.com", "DE", "18-24", "budget")]
AGENCIES = [("A001", "Premium Travel Co", "LIC001", "US", "online"), ("A002", "Budget Tours Ltd", "LIC002", "UK", "hybrid"),
            ("A003", "Adventure Trips", "LIC003", "DE", "offline")]
TRANSACTIONS = [("T001", "U001", "A001", "flight", "1250.00", 1, 30, "UK"), ("T002", "U002", "A002", "hotel", "450.00", 2, 15, "FR"),
                ("T003", "U003", "A003", "package", "2100.00", 3, 60, "JP")]


def samples(spark: SparkSession, now: dt.datetime) -> dict[str, DataFrame]:
    """Sample rows of users, agencies and transactions as of ``now``."""
    from ..operators.constraints import conform
    users = spark.createDataFrame(USERS, "user_id string, email string, country_code string, age_group string, customer_segment string")
    agencies = spark.createDataFrame(AGENCIES, "agency_id string, agency_name string, license_number string, registration_country string, business_type string")
    rows = [(t, u, a, kind, amount, now - dt.timedelta(days=ago), (now + dt.timedelta(days=ahead)).date(), to, "pending")
            for t, u, a, kind, amount, ago, ahead, to in TRANSACTIONS]
    made = spark.createDataFrame(rows, "transaction_id string, user_id string, agency_id string, booking_type string, amount string, "
                                       "booking_date timestamp, travel_date date, destination string, status string")
    return {n: conform(df, WAREHOUSE[n]) for n, df in (("users", users), ("agencies", agencies), ("transactions", made))}
