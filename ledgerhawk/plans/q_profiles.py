"""Profile, view, log-pattern and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as pf
from ..operators.graph.build import build_graph
from ..operators.graph.local import degree_centrality
from ..operators.rules import decision as dec
from ..sources import adapters as ad
from . import q_rules as qr
from .catalog import finish, r6, register
from .oracle_views import with_views

TXN_AS_OF = "2001-08-01 00:00:00"
BOOKINGS_AS_OF = "1975-05-30 08:00:00"
LOGS_AS_OF = "1970-07-17 13:00:00"
MS = "CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE)"
MA = f"{MS} / count(amount)"


def since(ts: str, as_of: str, interval: str) -> str:
    return f"{ts} >= TIMESTAMP '{as_of}' - INTERVAL '{interval}' AND {ts} <= TIMESTAMP '{as_of}'"


DEC_CTES = [("bk", qr.BK_DAILY), ("ag", qr.AG_CTE), ("trv", qr.TRAVEL_CTE), ("vel", qr.VEL_CTE),
            ("net", qr.NET_CTE), ("dcs", qr.DECISION_SQL)]


@register("daily_summary", with_views(f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS transaction_date, count(*) AS total_transactions, {MS} AS total_volume,
       {MA} AS avg_amount, count(DISTINCT user_id) AS unique_users, count(DISTINCT agency_id) AS unique_agencies,
       count(*) FILTER (WHERE status = 'completed') AS completed_transactions,
       count(*) FILTER (WHERE status = 'cancelled') AS cancelled_transactions
FROM wtxn WHERE created_at >= TIMESTAMP '{TXN_AS_OF}' - INTERVAL '30 days' GROUP BY CAST(created_at AS DATE)""", ["wtxn"]))
def q_daily_summary(spark, sf):
    d = pf.daily_summary(ad.warehouse_transactions(spark, sf), TXN_AS_OF)
    return finish(d.withColumn("transaction_date", F.date_format("transaction_date", "yyyy-MM-dd")))


@register("user_totals", with_views(f"""
SELECT user_id, count(*) AS user_count, {MS} AS user_amount, max(created_at) AS last_activity
FROM wtxn GROUP BY user_id""", ["wtxn"]))
def q_user_totals(spark, sf):
    return finish(pf.running_totals(ad.warehouse_transactions(spark, sf), "user_id", "user"))


@register("edge_rollup", with_views(f"""
SELECT user_id AS source_id, agency_id AS target_id, {MS} AS total_weight, count(*) AS transaction_count,
       min(created_at) AS first_interaction, max(created_at) AS last_interaction, {MA} AS avg_amount
FROM wtxn GROUP BY 1, 2""", ["wtxn"]))
def q_edge_rollup(spark, sf):
    return finish(pf.edge_rollup(ad.warehouse_transactions(spark, sf)))


@register("high_risk_entities", with_views(f"""
SELECT 'user' AS entity_type, u.user_id AS entity_id, risk_score, coalesce(t.c, 0) AS total_count,
       coalesce(t.s, 0.0) AS total_amount, t.last_activity
FROM wusers u LEFT JOIN (SELECT user_id, count(*) AS c, {MS} AS s, max(created_at) AS last_activity FROM wtxn
                         GROUP BY user_id) t USING (user_id) WHERE risk_score > 0.7
UNION ALL
SELECT 'agency', a.agency_id, CASE risk_category WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END::DOUBLE,
       coalesce(t.c, 0), coalesce(t.s, 0.0), CAST(NULL AS TIMESTAMP)
FROM wagencies a LEFT JOIN (SELECT agency_id, count(*) AS c, {MS} AS s FROM wtxn GROUP BY agency_id) t USING (agency_id)
WHERE risk_category IN ('high', 'medium')""", ["wtxn", "wusers", "wagencies"]))
def q_high_risk_entities(spark, sf):
    w = ad.warehouse_transactions(spark, sf)
    h = pf.high_risk_entities(ad.warehouse_users(spark, sf), ad.warehouse_agencies(spark, sf),
                              pf.running_totals(w, "user_id", "user"),
                              pf.running_totals(w, "agency_id", "agency").drop("last_activity"))
    return finish(h)


def booking_degree(spark, sf):
    b = ad.bookings(spark, sf).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("cust_id"),
                                      F.concat(F.lit("A"), F.col("agency_id").cast("string")).alias("dest_id"),
                                      "amount")
    return degree_centrality(build_graph(b)).select("node", "degree_centrality")


BDEG = ("bdeg", """SELECT node, degree / ((SELECT count(*) FROM (SELECT src FROM bg UNION SELECT dst FROM bg)) - 1)
  AS degree_centrality FROM (SELECT node, count(*) AS degree FROM (
    SELECT src AS node FROM bg UNION ALL SELECT dst FROM bg) a GROUP BY node) d""")
BG = ("bg", "SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS src, 'A' || CAST(agency_id AS VARCHAR) AS dst FROM bookings")


@register("user_profile", with_views(f"""
SELECT s.user_id, total_transactions, total_amount, average_amount, high_risk_bookings,
       least(coalesce(d.degree_centrality, 0.0) * 100, 100.0) AS risk_score
FROM (SELECT user_id, count(*) AS total_transactions, {MS} AS total_amount, {MA} AS average_amount
      FROM bookings WHERE {since('ts', BOOKINGS_AS_OF, '90 days')} GROUP BY user_id) s
JOIN (SELECT b.user_id, count(*) FILTER (WHERE b.amount > a.avg * 3) AS high_risk_bookings
      FROM bookings b JOIN (SELECT user_id, {MA} AS avg FROM bookings
                            WHERE {since('ts', BOOKINGS_AS_OF, '90 days')} GROUP BY user_id) a USING (user_id)
      WHERE {since('b.ts', BOOKINGS_AS_OF, '90 days')} GROUP BY b.user_id) h USING (user_id)
LEFT JOIN bdeg d ON d.node = 'U' || CAST(s.user_id AS VARCHAR)""", ["bookings"], [BG, BDEG]))
def q_user_profile(spark, sf):
    deg = booking_degree(spark, sf).where(F.col("node").startswith("U")).select(
        F.substring("node", 2, 20).cast("long").alias("user_id"), "degree_centrality")
    return finish(pf.user_profiles(ad.bookings(spark, sf), deg, BOOKINGS_AS_OF))


@register("agency_profile", with_views(f"""
SELECT s.agency_id, transaction_count, average_amount, total_amount, unique_users,
       1.0 - coalesce(d.degree_centrality, 0.0) AS isolation_risk
FROM (SELECT agency_id, count(*) AS transaction_count, {MA} AS average_amount, {MS} AS total_amount,
             count(DISTINCT user_id) AS unique_users
      FROM bookings WHERE {since('ts', BOOKINGS_AS_OF, '90 days')} GROUP BY agency_id) s
LEFT JOIN bdeg d ON d.node = 'A' || CAST(s.agency_id AS VARCHAR)""", ["bookings"], [BG, BDEG]))
def q_agency_profile(spark, sf):
    deg = booking_degree(spark, sf).where(F.col("node").startswith("A")).select(
        F.substring("node", 2, 20).cast("long").alias("agency_id"), "degree_centrality")
    return finish(pf.agency_profiles(ad.bookings(spark, sf), deg, BOOKINGS_AS_OF))


@register("risk_distribution", with_views(f"""
SELECT CASE WHEN overall_risk >= 0.8 THEN 'HIGH' WHEN overall_risk >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_bucket,
       count(*) AS transactions, max(t) AS total_transactions, max(b) / max(t) AS block_rate
FROM dcs, (SELECT count(*) AS t, count(*) FILTER (WHERE action_code = 'BLOCK') AS b FROM dcs
           WHERE {since('ts', BOOKINGS_AS_OF, '24 hours')}) z
WHERE {since('ts', BOOKINGS_AS_OF, '24 hours')} GROUP BY 1""", ["bookings", "agencies"], DEC_CTES))
def q_risk_distribution(spark, sf):
    return finish(pf.risk_distribution(qr.decision_frame(spark, sf), BOOKINGS_AS_OF))


@register("top_factors", with_views(f"""
SELECT factor, count, count * 100.0 / sum(count) OVER () AS percentage FROM (
  SELECT factor, count(*) AS count FROM (
    SELECT unnest(string_split({qr.TRAVEL_FACTORS}, '|')) AS factor FROM dcs
    WHERE {since('ts', BOOKINGS_AS_OF, '24 hours')}) f WHERE factor <> '' GROUP BY factor) c
ORDER BY count DESC, factor LIMIT 5""", ["bookings", "agencies"], DEC_CTES))
def q_top_factors(spark, sf):
    return finish(pf.top_risk_factors(qr.decision_frame(spark, sf), BOOKINGS_AS_OF))


@register("log_pattern", with_views(f"""
SELECT user_id, count(*) AS total_requests, count(DISTINCT endpoint) AS unique_endpoints,
       round(avg(CAST(status_code >= 400 AS DOUBLE)), 12) AS error_rate,
       round(avg(response_time), 9) AS avg_response_time
FROM applogs WHERE {since('ts', LOGS_AS_OF, '24 hours')} GROUP BY user_id""", ["applogs"]))
def q_log_pattern(spark, sf):
    p = pf.log_patterns(ad.applogs(spark, sf), LOGS_AS_OF)
    return finish(p.withColumn("error_rate", F.round("error_rate", 12))
                  .withColumn("avg_response_time", F.round("avg_response_time", 9)))


@register("top_endpoints", with_views(f"""
SELECT user_id, endpoint, calls, CAST(rank AS BIGINT) AS rank FROM (
  SELECT user_id, endpoint, calls, row_number() OVER (PARTITION BY user_id ORDER BY calls DESC, endpoint) AS rank
  FROM (SELECT user_id, endpoint, count(*) AS calls FROM applogs WHERE {since('ts', LOGS_AS_OF, '24 hours')}
        GROUP BY 1, 2) c) r WHERE rank <= 10""", ["applogs"]))
def q_top_endpoints(spark, sf):
    return finish(pf.top_endpoints(ad.applogs(spark, sf), LOGS_AS_OF))


@register("hour_histogram", with_views(f"""
SELECT user_id, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS requests FROM applogs
WHERE {since('ts', LOGS_AS_OF, '24 hours')} GROUP BY 1, 2""", ["applogs"]))
def q_hour_histogram(spark, sf):
    return finish(pf.hour_histogram(ad.applogs(spark, sf), LOGS_AS_OF))


BOT_RX = " OR ".join(f"regexp_matches(lower(user_agent), '{p}')" for p in
                     [r"scrapy/[\d.]+", "selenium|webdriver", "headless|phantom", "automation|bot|crawler|spider"])
VPN_HITS = " + ".join(f"CAST(contains(lower(user_agent), '{p}') AS INTEGER)"
                      for p in ["nordvpn", "expressvpn", "surfshark", "cyberghost"])


@register("ip_security_features", with_views(f"""
SELECT ip_address, nginx_request_count + api_call_count AS total_requests, nginx_request_count, api_call_count,
  redis_ops, unique_endpoints, unique_user_agents, unique_sessions, round(error_rate, 12) AS error_rate,
  round(auth_failure_rate, 12) AS auth_failure_rate, round(avg_request_time, 9) AS avg_request_time,
  round(request_time_std, 9) AS request_time_std, 1 AS is_private_ip, 0 AS is_suspicious_ip, has_bot_user_agent,
  round(CASE WHEN unique_user_agents > 0 THEN log2(unique_user_agents) ELSE 0.0 END, 12) AS user_agent_entropy,
  least(1.0, vpn_hits * 0.3::DOUBLE) AS vpn_probability,
  least(1.0, CASE WHEN unique_user_agents > 5 THEN 0.4::DOUBLE ELSE 0.0 END
             + CASE WHEN unique_endpoints > 20 THEN 0.3::DOUBLE ELSE 0.0 END) AS proxy_probability,
  round(CASE WHEN n < 2 THEN 0.0 WHEN span = 0 THEN CAST(n AS DOUBLE) ELSE n / (span / 60.0) END, 9)
    AS requests_per_minute,
  unique_sessions / 10.0 AS session_switching_rate,
  least(1.0, CASE WHEN unique_sessions > 3 AND unique_user_agents > 2 THEN 0.5::DOUBLE ELSE 0.0 END
             + CASE WHEN api_call_count > 100 AND unique_sessions > 5 THEN 0.3::DOUBLE ELSE 0.0 END)
    AS session_hijacking_score,
  0.5 AS geo_risk_score
FROM (
  SELECT ip_address, count(*) FILTER (WHERE NOT starts_with(endpoint, '/api')) AS nginx_request_count,
         count(*) FILTER (WHERE starts_with(endpoint, '/api')) AS api_call_count,
         count(*) FILTER (WHERE method = 'GET') AS redis_ops, count(DISTINCT endpoint) AS unique_endpoints,
         count(DISTINCT user_agent) AS unique_user_agents, count(DISTINCT session_id) AS unique_sessions,
         avg(CAST(status_code >= 400 AS DOUBLE)) AS error_rate,
         avg(CAST(status_code IN (401, 403) AS DOUBLE)) AS auth_failure_rate,
         avg(response_time) AS avg_request_time, stddev_pop(response_time) AS request_time_std,
         max(CAST({BOT_RX} AS INTEGER)) AS has_bot_user_agent, count(*) AS n,
         (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS span
  FROM applogs GROUP BY ip_address) g
JOIN (SELECT ip_address, sum({VPN_HITS}) AS vpn_hits FROM (SELECT DISTINCT ip_address, user_agent FROM applogs) d
      GROUP BY ip_address) v USING (ip_address)""", ["applogs"]))
def q_ip_security_features(spark, sf):
    d = pf.ip_security_features(ad.applogs(spark, sf))
    for c, k in [("error_rate", 12), ("auth_failure_rate", 12), ("avg_request_time", 9), ("request_time_std", 9),
                 ("user_agent_entropy", 12), ("requests_per_minute", 9)]:
        d = d.withColumn(c, F.round(c, k))
    return finish(d)


@register("dashboard", with_views(f"""
SELECT g.agency_id, recent_transactions_24h, round(average_risk_score, 12) AS average_risk_score,
       high_risk_transactions, coalesce(a.n, 0) AS active_alerts, total_volume_24h,
       CASE WHEN average_risk_score > 0.4 THEN 'INCREASING' ELSE 'STABLE' END AS risk_trend
FROM (SELECT agency_id, count(*) AS recent_transactions_24h, avg(overall_risk) AS average_risk_score,
             count(*) FILTER (WHERE overall_risk > 0.5) AS high_risk_transactions, {MS} AS total_volume_24h
      FROM dcs WHERE {since('ts', BOOKINGS_AS_OF, '24 hours')} GROUP BY agency_id) g
LEFT JOIN (SELECT agency_id, count(*) AS n FROM dcs WHERE action_code IN ('BLOCK', 'MANUAL_REVIEW')
           AND {since('ts', BOOKINGS_AS_OF, '1 hours')} GROUP BY agency_id) a USING (agency_id)""",
    ["bookings", "agencies"], DEC_CTES))
def q_dashboard(spark, sf):
    d = qr.decision_frame(spark, sf)
    out = pf.agency_dashboard(d, dec.alerts(d), BOOKINGS_AS_OF)
    return finish(out.withColumn("average_risk_score", F.round("average_risk_score", 12)))


@register("user_features", with_views(f"""
SELECT g.user_id, avg_booking_amount, booking_frequency, destination_diversity,
       round(avg_advance_booking_days, 9) AS avg_advance_booking_days,
       round(weekend_booking_ratio, 12) AS weekend_booking_ratio, round(night_booking_ratio, 12) AS night_booking_ratio,
       ip_count, t.preferred_destinations
FROM (SELECT user_id, {MA} AS avg_booking_amount, count(*) / count(DISTINCT CAST(ts AS DATE)) AS booking_frequency,
             count(DISTINCT agency_id) AS destination_diversity, avg(days_to_travel) AS avg_advance_booking_days,
             avg(CAST(is_weekend AS DOUBLE)) AS weekend_booking_ratio,
             avg(CAST(is_night_txn AS DOUBLE)) AS night_booking_ratio, count(DISTINCT ip_address) AS ip_count
      FROM bookings GROUP BY user_id) g
LEFT JOIN (SELECT user_id, string_agg(CAST(agency_id AS VARCHAR), '|' ORDER BY r) AS preferred_destinations FROM (
             SELECT user_id, agency_id, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, agency_id) AS r
             FROM (SELECT user_id, agency_id, count(*) AS c FROM bookings GROUP BY 1, 2) x) y
           WHERE r <= 3 GROUP BY user_id) t USING (user_id)""", ["bookings"]))
def q_user_features(spark, sf):
    u = pf.user_features(ad.bookings(spark, sf))
    for c, k in [("avg_advance_booking_days", 9), ("weekend_booking_ratio", 12), ("night_booking_ratio", 12)]:
        u = u.withColumn(c, F.round(c, k))
    return finish(u)


@register("agency_features", with_views(f"""
SELECT p.agency_id, total_customers, repeat_customer_ratio, cancellation_rate, total_bookings, avg_transaction_amount
FROM (SELECT agency_id, count(DISTINCT user_id) AS total_customers,
             count(*) FILTER (WHERE n > 1) / count(*) AS repeat_customer_ratio, sum(x) / sum(n) AS cancellation_rate,
             sum(n) AS total_bookings
      FROM (SELECT agency_id, user_id, count(*) AS n, count(*) FILTER (WHERE booking_type = 'cruise') AS x
            FROM bookings GROUP BY 1, 2) pu GROUP BY agency_id) p
JOIN (SELECT agency_id, {MA} AS avg_transaction_amount FROM bookings GROUP BY agency_id) a USING (agency_id)""",
    ["bookings"]))
def q_agency_features(spark, sf):
    return finish(pf.agency_features(ad.bookings(spark, sf)))
