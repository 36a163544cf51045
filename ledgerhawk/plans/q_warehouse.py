"""Warehouse, sinks, look-up and mapping queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import records, versions
from ..operators.constraints import violations
from ..operators.quantiles import exact_quantiles
from ..operators.rules import base_models as bm
from ..operators.rules import decision as dec
from ..session import ensure_checkpoint_dir
from ..sources import adapters as ad
from ..sources import mappings as mp
from ..sources.warehouse import WAREHOUSE
from ..streaming import sinks
from ..streaming import state as st
from ..streaming.timed import Retention
from . import sqlkit as K
from .catalog import finish, r6, register
from .oracle_views import with_views
from .q_rules import BEH_FACTORS, BEH_SCORE


def _folder(spark, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- constraints
BROKEN_SQL = [
    ("cu", """SELECT user_id, CASE WHEN user_id::BIGINT % 700 = 0 THEN NULL WHEN user_id::BIGINT % 300 = 1 THEN 'shared@example.com'
                     ELSE user_id || '@example.com' END AS email FROM wusers"""),
    ("ct0", """SELECT CAST(txn_id AS VARCHAR) AS transaction_id,
                      CASE WHEN txn_id % 1009 = 0 THEN NULL WHEN txn_id % 2003 = 1 THEN 'ghost' || CAST(txn_id % 5 AS VARCHAR) ELSE user_id END AS user_id,
                      agency_id, CASE WHEN txn_id % 3001 = 2 THEN NULL ELSE 'flight' END AS booking_type,
                      CASE WHEN txn_id % 4001 = 3 THEN -amount ELSE amount END AS amount, txn_id FROM wtxn"""),
    ("ct", "SELECT * FROM ct0 UNION ALL SELECT * FROM ct0 WHERE txn_id % 5003 = 4"),
]


@register("constraint_violations", with_views("""
SELECT 'users' AS table_name, 'not_null' AS kind, 'email' AS rule, user_id AS row_key FROM cu WHERE email IS NULL
UNION ALL SELECT 'users', 'unique', 'email', email FROM cu WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'transactions', 'not_null', 'user_id', transaction_id FROM ct WHERE user_id IS NULL
UNION ALL SELECT 'transactions', 'not_null', 'booking_type', transaction_id FROM ct WHERE booking_type IS NULL
UNION ALL SELECT 'transactions', 'check', 'positive_amount', transaction_id FROM ct WHERE amount <= 0
UNION ALL SELECT 'transactions', 'unique', 'transaction_id', transaction_id FROM ct GROUP BY transaction_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'transactions', 'foreign_key', 'user_id', user_id FROM ct WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM cu)
UNION ALL SELECT DISTINCT 'transactions', 'foreign_key', 'agency_id', agency_id FROM ct WHERE agency_id NOT IN (SELECT agency_id FROM wagencies)
""", ["wusers", "wagencies", "wtxn"], BROKEN_SQL))
def q_constraints(spark, sf):
    """Violations of users, agencies and transactions with planted faults."""
    n = F.col("user_id").cast("long")
    users = ad.warehouse_users(spark, sf).select("user_id", F.when(n % 700 == 0, F.lit(None)).when(n % 300 == 1, "shared@example.com")
                                                 .otherwise(F.concat("user_id", F.lit("@example.com"))).alias("email"))
    agencies = ad.warehouse_agencies(spark, sf).select("agency_id", F.col("name").alias("agency_name"))
    t = F.col("txn_id")
    txns = ad.warehouse_transactions(spark, sf).select(
        t.cast("string").alias("transaction_id"),
        F.when(t % 1009 == 0, F.lit(None)).when(t % 2003 == 1, F.concat(F.lit("ghost"), (t % 5).cast("string"))).otherwise(F.col("user_id")).alias("user_id"),
        "agency_id", F.when(t % 3001 != 2, F.lit("flight")).alias("booking_type"),
        F.when(t % 4001 == 3, -F.col("amount")).otherwise(F.col("amount")).alias("amount"), F.col("created_at").alias("booking_date"), "txn_id")
    txns = txns.unionByName(txns.where(t % 5003 == 4)).drop("txn_id")
    return finish(violations({"users": users, "agencies": agencies, "transactions": txns}, WAREHOUSE))


# ---------------------------------------------------------------- sinks
@register("warehouse_totals", with_views("""
SELECT 'edge' AS entity, user_id || '>' || agency_id AS id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE) AS total,
       max(created_at) AS last_seen FROM wtxn GROUP BY user_id, agency_id
UNION ALL SELECT 'user', user_id, count(*), CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE), max(created_at) FROM wtxn GROUP BY user_id
UNION ALL SELECT 'agency', agency_id, count(*), CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE), NULL FROM wtxn GROUP BY agency_id
""", ["wtxn"]))
def q_warehouse_totals(spark, sf):
    """Totals merged from yearly batches, each handed over twice, one compaction between."""
    w = ad.warehouse_transactions(spark, sf).select("user_id", "agency_id", "amount", F.col("created_at").alias("booking_date"))
    years = [r[0] for r in w.select(F.year("booking_date")).distinct().orderBy(F.year("booking_date")).collect()]  # some years
    tables = sinks.Warehouse(spark, _folder(spark, "warehouse"))
    for batch, year in enumerate(years):
        part = w.where(F.year("booking_date").eqNullSafe(F.lit(year)))
        tables.insert(part, batch)
        tables.insert(part, batch)
        if batch == len(years) // 2:
            tables.compact()
    edges = tables.edge_table().select(F.lit("edge").alias("entity"), F.concat("source_node", F.lit(">"), "target_node").alias("id"),
                                       F.col("transaction_count").alias("n"), F.col("total_weight").alias("total"), F.col("last_interaction").alias("last_seen"))
    users = tables.users.read().select(F.lit("user").alias("entity"), F.col("user_id").alias("id"), F.col("total_bookings").alias("n"),
                                       F.col("total_spent").alias("total"), F.col("last_activity").alias("last_seen"))
    agencies = tables.agencies.read().select(F.lit("agency").alias("entity"), F.col("agency_id").alias("id"), F.col("total_transactions").alias("n"),
                                             F.col("total_volume").alias("total"), F.lit(None).cast(users.schema["last_seen"].dataType).alias("last_seen"))
    return finish(edges.unionByName(users).unionByName(agencies))


@register("monthly_logs", with_views("""
SELECT strftime(ts, '%Y-%m') AS year_month, level, count(*) AS n, sum(status_code)::BIGINT AS codes FROM applogs GROUP BY 1, 2""", ["applogs"]))
def q_monthly_logs(spark, sf):
    """All log rows through the monthly store in three batches, read back."""
    logs = sinks.with_month(ad.applogs(spark, sf).select("event_id", "ts", "level", "status_code"))
    sink = sinks.monthly_logs(spark, _folder(spark, "logs"))
    for batch in range(3):
        sink.write(logs.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch)
    return finish(sink.read().groupBy("year_month", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("status_code").alias("codes")))


EXPIRING_SQL = [("exp0", """SELECT *, CASE WHEN response_time > 0 THEN
    CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(CASE WHEN response_time > 0 THEN ts END IGNORE NULLS) OVER w) >= 3600000000, true) THEN 1 ELSE 0 END END AS fresh
  FROM applogs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""),
    ("exp1", """SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM exp0"""),
    ("exp2", """SELECT *, count(*) OVER wh AS calls, sum(CAST(status_code >= 400 AS INTEGER)) OVER wh AS errs FROM exp1
  WINDOW wh AS (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""),
    ("exp3", """SELECT *, avg(response_time) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW) AS avg_rt
  FROM exp2 WHERE response_time > 0 UNION ALL SELECT *, 1.0 FROM exp2 WHERE NOT coalesce(response_time > 0, false)"""),
    ("exp", """SELECT event_id, user_id, ts, 'high_error_rate' AS anomaly_type, 'medium' AS severity FROM exp3 WHERE status_code >= 500 AND errs > 10
  UNION ALL SELECT event_id, user_id, ts, 'unusual_response_time', 'low' FROM exp3 WHERE response_time > 5.0 AND response_time > avg_rt * 3
  UNION ALL SELECT event_id, user_id, ts, 'high_api_frequency', 'high' FROM exp3 WHERE calls > 100""")]


@register("anomalies_expiring", with_views("SELECT * FROM exp", ["applogs"], EXPIRING_SQL))
def q_anomalies_expiring(spark, sf):
    """Anomalies whose response times are forgotten after an hour."""
    return finish(st.anomalies(ad.applogs(spark, sf), expire_seconds=3600))


@register("anomaly_documents", with_views("""
SELECT event_id, user_id, ts, string_agg(anomaly_type || ':' || severity, '|' ORDER BY anomaly_type) AS anomalies FROM exp GROUP BY 1, 2, 3""",
                                          ["applogs"], EXPIRING_SQL))
def q_anomaly_documents(spark, sf):
    """Anomaly documents written to their store in two batches, one of them twice, and read back."""
    docs = sinks.anomaly_documents(st.anomalies(ad.applogs(spark, sf), expire_seconds=3600))
    sink = sinks.BatchSink(spark, _folder(spark, "anomalies"))
    for batch in (0, 1, 1):
        sink.write(docs.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == batch), batch)
    return finish(sink.read().select("event_id", "user_id", "ts", F.transform("anomalies", lambda a: F.concat(a["type"], F.lit(":"), a["severity"])).alias("anomalies")))


@register("alert_messages", with_views("""
SELECT event_id, user_id AS key, '{"type":"LOG_ANOMALY","user_id":"' || user_id || '","anomalies":[{"type":"high_api_frequency","severity":"high"}],"timestamp":"'
       || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","severity":"HIGH"}' AS value FROM exp WHERE severity = 'high'""", ["applogs"], EXPIRING_SQL))
def q_alert_messages(spark, sf):
    return finish(sinks.alert_records(st.anomalies(ad.applogs(spark, sf), expire_seconds=3600)))


@register("retained_logs", with_views("""
SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM applogs WHERE ts > (SELECT max(ts) FROM applogs) - INTERVAL 24 HOURS GROUP BY 1""", ["applogs"]))
def q_retained_logs(spark, sf):
    """Log rows of the last 24 hours of the data, per user."""
    kept = Retention("ts", 24).of_table(ad.applogs(spark, sf).select("user_id", "ts"))
    return finish(kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen")))


# ---------------------------------------------------------------- look-up
SNAP_SQL = [
    ("ny", """SELECT node, y, count(*) AS n, sum(a) AS s FROM (
  SELECT unnest([cust_id, dest_id]) AS node, year(ts) AS y, CAST(amount AS DECIMAL(38,2)) AS a FROM gtxn) GROUP BY ALL"""),
    ("snap", """SELECT node, CAST(make_date(y + 1, 1, 1) AS TIMESTAMP) AS valid_from, CAST(sum(n) OVER w AS DOUBLE) AS n_txns, CAST(sum(s) OVER w AS DOUBLE) AS volume
  FROM ny WINDOW w AS (PARTITION BY node ORDER BY y)"""),
]


@register("feature_lookup", with_views("""
SELECT t.txn_id, coalesce(CASE WHEN t.txn_id % 10 = 0 THEN CAST(t.txn_id % 100 AS DOUBLE) END, c.n_txns, 0.0) AS cust_n_txns, coalesce(c.volume, 0.0) AS cust_volume,
       CASE WHEN t.txn_id % 10 = 0 THEN 'supplied' WHEN c.node IS NOT NULL THEN 'cached' ELSE 'default' END AS cust_source,
       coalesce(d.n_txns, 0.0) AS dest_n_txns, coalesce(d.volume, 0.0) AS dest_volume, CASE WHEN d.node IS NOT NULL THEN 'cached' ELSE 'default' END AS dest_source
FROM gtxn t ASOF LEFT JOIN snap c ON t.cust_id = c.node AND t.ts >= c.valid_from
            ASOF LEFT JOIN snap d ON t.dest_id = d.node AND t.ts >= d.valid_from""", ["gtxn"], SNAP_SQL))
def q_feature_lookup(spark, sf):
    """Node features at score time: supplied, else the snapshot valid then, else 0."""
    t = ad.graph_transactions(spark, sf)
    snaps = versions.yearly_snapshots(t)
    asked = t.select("txn_id", "cust_id", "dest_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                     F.when(F.col("txn_id") % 10 == 0, (F.col("txn_id") % 100).cast("double")).alias("cust_n_txns"))
    d = versions.looked_up(asked, snaps, "cust", "cust_id", "ts", ["n_txns", "volume"])
    d = versions.looked_up(d, snaps, "dest", "dest_id", "ts", ["n_txns", "volume"])
    return finish(d.select("txn_id", "cust_n_txns", "cust_volume", "cust_source", "dest_n_txns", "dest_volume", "dest_source"))


# ---------------------------------------------------------------- records
@register("score_records", with_views(f"""
SELECT CAST(txn_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id, CAST(agency_id AS VARCHAR) AS agency_id,
       round(s, 4) AS fraud_probability, CAST(s > 0.5 AS BIGINT) AS fraud_prediction, CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_bucket,
       least(CAST(0.95 AS DOUBLE), greatest(CAST(0.6 AS DOUBLE), abs(s - 0.5) * 2)) AS confidence, f AS risk_factors, 'v1.0' AS model_version,
       velocity_score AS value_velocity, CAST(device_seen_count AS DOUBLE) AS value_devices
FROM (SELECT *, {BEH_SCORE} AS s, {BEH_FACTORS} AS f FROM bookings) b""", ["bookings"]))
def q_score_records(spark, sf):
    """Risk-score rows of the behavioural scorer."""
    b = bm.behavioral_risk(ad.bookings(spark, sf))
    r = records.score_record(b, "behavioral_score", {"transaction_id": "txn_id", "user_id": "user_id", "agency_id": "agency_id"},
                             F.col("behavioral_factors"), ["velocity_score", "device_seen_count"])
    value = lambda n: F.element_at("feature_values", F.lit(n))
    return finish(r.withColumn("value_velocity", value("velocity_score")).withColumn("value_devices", value("device_seen_count")).drop("feature_values"))


@register("threat_assessment", with_views(f"""
SELECT ip_address, p AS threat_probability, p > 0.5 AS is_threat, {K.band('p', dec.THREAT_LEVELS, 'MINIMAL')} AS risk_level,
       {K.band('p', dec.THREAT_ACTIONS, 'ALLOW')} AS recommended_action
FROM (SELECT ip_address, CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) AS p FROM applogs GROUP BY 1) x""", ["applogs"]))
def q_threat_assessment(spark, sf):
    """Levels and actions per address, its share of failed requests as probability."""
    p = ad.applogs(spark, sf).groupBy("ip_address").agg((F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1))).alias("p"))
    return finish(records.assess_threats(p, "p"))


# ---------------------------------------------------------------- mappings
RICH_SQL = [("rich", """SELECT *, CASE WHEN k % 50 <> 7 THEN ip_address END AS ip0, k % 6 = 0 AS is_ip_shared, k * 12 AS c24, CASE WHEN k % 8 <> 3 THEN k END AS c1,
  k * 1000.0 AS since, CAST(k % 13 AS DOUBLE) AS geo, CAST(k % 5 = 0 AS INTEGER) AS is_fraud FROM bookings""")]


@register("device_rich_features", with_views("""
SELECT txn_id, coalesce(ip0, CAST(txn_id % 255 AS VARCHAR) || '.10.10.10') AS ip_address, t AS total_requests, CAST(floor(t * 0.6) AS BIGINT) AS nginx_request_count,
  CAST(least(greatest(coalesce(c1, 1), 0), 100) AS BIGINT) AS api_call_count, 2::BIGINT AS redis_ops, CAST(floor(least(greatest(velocity_score, 1), 100)) AS BIGINT) AS unique_endpoints,
  CAST(is_device_shared AS BIGINT) * 3 + 1 AS unique_user_agents, CAST(least(greatest(device_seen_count, 1), 50) AS BIGINT) AS unique_sessions,
  least(greatest(spending_deviation_score / 10.0::DOUBLE, 0), 1) AS error_rate, least(greatest(spending_deviation_score / 20.0::DOUBLE, 0), 1) AS auth_failure_rate,
  least(greatest(since, 0), 1e6) / 1000.0::DOUBLE AS avg_request_time, 0.05::DOUBLE AS request_time_std,
  CAST(starts_with(coalesce(ip0, CAST(txn_id % 255 AS VARCHAR) || '.10.10.10'), '10.') OR starts_with(coalesce(ip0, ''), '192.168.') AS BIGINT) AS is_private_ip,
  CAST(is_ip_shared AS BIGINT) AS is_suspicious_ip, 0::BIGINT AS has_bot_user_agent, least(greatest(spending_deviation_score / 3.0::DOUBLE, 0), 3) AS user_agent_entropy,
  CAST(is_ip_shared AS INTEGER) * 0.7::DOUBLE AS vpn_probability, CAST(is_device_shared AS INTEGER) * 0.5::DOUBLE AS proxy_probability,
  least(greatest(coalesce(c1, 1) / 60.0::DOUBLE, 0), 100) AS requests_per_minute, least(greatest(velocity_score, 0), 10) / 10.0::DOUBLE AS burst_behavior_score,
  CAST(geo_velocity_anomaly AS INTEGER) * 0.8::DOUBLE AS session_switching_rate, least(greatest(geo, 0), 10) / 10.0::DOUBLE AS session_hijacking_score, CAST(is_fraud AS BIGINT) AS label
FROM (SELECT *, CAST(least(greatest(c24, 1), 1000) AS BIGINT) AS t FROM rich) x""", ["bookings"], RICH_SQL))
def q_device_rich(spark, sf):
    """Bookings seen as device-rich transactions, as security feature rows."""
    k = F.col("k")
    b = ad.bookings(spark, sf).withColumn("ip_address", F.when(k % 50 != 7, F.col("ip_address")))
    b = (b.withColumn("is_ip_shared", k % 6 == 0).withColumn("txn_count_last_24h", k * 12).withColumn("txn_count_last_1h", F.when(k % 8 != 3, k))
         .withColumn("time_since_last_transaction", k * 1000.0).withColumn("geo_anomaly_score", (k % 13).cast("double")).withColumn("is_fraud", (k % 5 == 0).cast("int")))
    return finish(mp.device_rich_security_features(b, "txn_id"))


@register("network_rows", with_views("""
SELECT txn_id, concat_ws('.', step % 255, CAST(trunc(amount) AS BIGINT) % 255, '1.1') AS ip_address, 'dev_' || substr(cust_id, 1, 8) AS device_id, cust_id AS user_id, dest_id,
       make_timestamp(step * 1000000) AS timestamp, CAST(label AS BIGINT) AS label, step FROM txn
UNION ALL SELECT txn_id, concat_ws('.', txn_id % 255, '20.20.20'), 'dev_' || CAST(txn_id % 50000 AS VARCHAR), CAST(txn_id AS VARCHAR), 'd_' || CAST(txn_id AS VARCHAR),
       make_timestamp(txn_id * 1000000), 0, txn_id FROM txn""", ["txn"]))
def q_network_rows(spark, sf):
    """Transactions as network rows, with and without accounts of their own."""
    t = ad.transactions(spark, sf)
    named = mp.network_rows(t, "txn_id", "cust_id", "dest_id", "label", "step", "amount", "1.1")
    bare = mp.network_rows(t, "txn_id", None, None, None, None, None, "20.20.20", devices=50000)
    return finish(named.unionByName(bare))


@register("security_inputs", with_views("""
SELECT txn_id, amount AS in_amount, round(ln(1 + amount), 6) AS amount_log, step AS in_step, CAST(amount < 1 AS DOUBLE) AS micro_transaction_attack,
  CAST(amount % 100 = 0 AS DOUBLE) AS round_amount_pattern, CAST(amount = 0.01 AS DOUBLE) AS penny_transaction, step % 24 AS transaction_hour,
  CAST(step % 24 < 6 OR step % 24 > 22 AS DOUBLE) AS night_attack, CAST((step // 24) % 7 >= 5 AS DOUBLE) AS weekend_attack, oldbalanceOrg AS in_oldbalance,
  newbalanceOrig AS in_newbalance, CAST(oldbalanceOrg = 0 AS DOUBLE) AS zero_balance_creation, CAST(oldbalanceOrg = 0 AND amount > 10000 AS DOUBLE) AS instant_large_transaction,
  CAST(abs(oldbalanceOrg - amount - newbalanceOrig) > 0.01 AS DOUBLE) AS balance_inconsistency, CAST(oldbalanceOrg > 0 AND newbalanceOrig = 0 AS DOUBLE) AS emptied_account,
  CAST(CASE type WHEN 'TRANSFER' THEN 1 WHEN 'CASH_OUT' THEN 2 WHEN 'DEBIT' THEN 3 WHEN 'CASH_IN' THEN 4 ELSE 0 END AS BIGINT) AS type_encoded,
  CAST(type IN ('TRANSFER', 'CASH_OUT') AS DOUBLE) AS high_risk_type, 5.0::DOUBLE AS transaction_frequency, 0.1::DOUBLE AS destination_risk,
  0.5::DOUBLE AS normalized_velocity, 0.0::DOUBLE AS burst_pattern FROM txn""", ["txn"]))
def q_security_inputs(spark, sf):
    """The 21 online security inputs per transaction."""
    t = mp.security_inputs(ad.transactions(spark, sf)).withColumn("amount_log", r6("amount_log"))
    names = ["in_amount", "amount_log", "in_step", "micro_transaction_attack", "round_amount_pattern", "penny_transaction", "transaction_hour", "night_attack",
             "weekend_attack", "in_oldbalance", "in_newbalance", "zero_balance_creation", "instant_large_transaction", "balance_inconsistency", "emptied_account",
             "type_encoded", "high_risk_type", "transaction_frequency", "destination_risk", "normalized_velocity", "burst_pattern"]
    return finish(t.select("txn_id", *names))


@register("evaluation_inputs_financial", with_views("""
SELECT txn_id, amount, oldbalanceOrg, newbalanceOrig, step, round(ln(1 + amount), 6) AS amount_log,
  CAST(amount > (SELECT quantile_cont(amount, 0.95) FROM txn) AS BIGINT) AS is_large_amount, amount / (oldbalanceOrg + 1) AS balance_ratio,
  CAST(CASE type WHEN 'TRANSFER' THEN 1 WHEN 'CASH_OUT' THEN 2 WHEN 'DEBIT' THEN 3 WHEN 'CASH_IN' THEN 4 ELSE 0 END AS BIGINT) AS type_encoded FROM txn""", ["txn"]))
def q_evaluation_financial(spark, sf):
    t = ad.transactions(spark, sf)
    return finish(mp.evaluation_inputs(t, "financial", exact_quantiles(t, "amount", [0.95])[0]).withColumn("amount_log", r6("amount_log")))


@register("evaluation_inputs_security", with_views("""
SELECT txn_id, round(ln(1 + amount), 6) AS amount_log, CAST(amount < 1 AS BIGINT) AS micro_transaction, CAST(amount % 100 = 0 AS BIGINT) AS round_amount,
  step % 24 AS transaction_hour, CAST(step % 24 > 22 AS BIGINT) AS night_activity, CAST(oldbalanceOrg = 0 AS BIGINT) AS zero_balance FROM txn""", ["txn"]))
def q_evaluation_security(spark, sf):
    return finish(mp.evaluation_inputs(ad.transactions(spark, sf), "security").withColumn("amount_log", r6("amount_log")))


@register("evaluation_inputs_behavioral", with_views("""
SELECT txn_id, 1.0::DOUBLE / (device_seen_count + 1) AS device_trust_score, CAST(NOT is_device_shared AS BIGINT) AS device_exclusivity,
  least(greatest(velocity_score / 10, 0), 1) AS velocity_risk, least(greatest(spending_deviation_score, 0), 1) AS spending_anomaly,
  round(ln(1 + amount), 6) AS amount_log, CAST(amount % 1000 = 0 AS BIGINT) AS round_amount FROM bookings""", ["bookings"]))
def q_evaluation_behavioral(spark, sf):
    return finish(mp.evaluation_inputs(ad.bookings(spark, sf), "behavioral").withColumn("amount_log", r6("amount_log")))
