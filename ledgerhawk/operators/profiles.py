"""Profiles, warehouse views and log patterns.

"Now" is always an explicit as-of timestamp argument, so re-runs and
replays give the same answer.  Everything is a filtered ``groupBy`` (or a
per-key top-k); nothing is computed per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (SUSPICIOUS_IPS, has_bot_agent, is_private_ip, money, money_avg, money_sum,
                                vpn_provider_hits)
from .rules.decision import model_band


def _since(ts: str, as_of: str, interval: str) -> Column:
    return (F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")) & \
        (F.col(ts) <= F.lit(as_of).cast("timestamp_ntz"))


def daily_summary(txns: DataFrame, as_of: str, days: int = 30, ts: str = "created_at") -> DataFrame:
    """Per day: count, volume, mean, distinct users / agencies, completed
    and cancelled counts over the last ``days`` days (D7)."""
    t = txns.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return t.groupBy(F.to_date(ts).alias("transaction_date")).agg(
        F.count(F.lit(1)).alias("total_transactions"), money_sum(F.col("amount")).alias("total_volume"),
        money_avg(F.col("amount")).alias("avg_amount"), F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("agency_id").alias("unique_agencies"),
        F.count_if(F.col("status") == "completed").alias("completed_transactions"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_transactions"))


def running_totals(txns: DataFrame, key: str, prefix: str, ts: str = "created_at") -> DataFrame:
    """Totals the insert trigger maintains, recomputed by groupBy."""
    return txns.groupBy(key).agg(F.count(F.lit(1)).alias(f"{prefix}_count"),
                                 money_sum(F.col("amount")).alias(f"{prefix}_amount"),
                                 F.max(ts).alias("last_activity"))


def edge_rollup(txns: DataFrame, src: str = "user_id", dst: str = "agency_id", ts: str = "created_at") -> DataFrame:
    """total weight, count, first / last interaction, mean per edge."""
    return txns.groupBy(F.col(src).alias("source_id"), F.col(dst).alias("target_id")).agg(
        money_sum(F.col("amount")).alias("total_weight"), F.count(F.lit(1)).alias("transaction_count"),
        F.min(ts).alias("first_interaction"), F.max(ts).alias("last_interaction"),
        money_avg(F.col("amount")).alias("avg_amount"))


def high_risk_entities(users: DataFrame, agencies: DataFrame, user_totals: DataFrame,
                       agency_totals: DataFrame) -> DataFrame:
    """Users with risk > .7 plus high/medium agencies with a category score (G1)."""
    u = (users.where(F.col("risk_score") > 0.7).join(user_totals, "user_id", "left")
         .select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), "risk_score",
                 F.coalesce("user_count", F.lit(0)).alias("total_count"),
                 F.coalesce("user_amount", F.lit(0.0)).alias("total_amount"), "last_activity"))
    a = (agencies.where(F.col("risk_category").isin("high", "medium")).join(agency_totals, "agency_id", "left")
         .select(F.lit("agency").alias("entity_type"), F.col("agency_id").alias("entity_id"),
                 F.when(F.col("risk_category") == "high", 0.8).when(F.col("risk_category") == "medium", 0.5)
                 .otherwise(0.2).alias("risk_score"),
                 F.coalesce("agency_count", F.lit(0)).alias("total_count"),
                 F.coalesce("agency_amount", F.lit(0.0)).alias("total_amount"),
                 F.lit(None).cast("timestamp_ntz").alias("last_activity")))
    return u.unionByName(a)


def user_profiles(bookings: DataFrame, degree: DataFrame, as_of: str, days: int = 90,
                  user: str = "user_id") -> DataFrame:
    """N-day count / sum / mean, bookings above 3x the mean and
    min(degree centrality * 100, 100) (D11)."""
    b = bookings.where(_since("ts", as_of, f"{days} DAYS"))
    s = b.groupBy(user).agg(F.count(F.lit(1)).alias("total_transactions"),
                            money_sum(F.col("amount")).alias("total_amount"),
                            money_avg(F.col("amount")).alias("average_amount"))
    hi = (b.join(s.select(user, "average_amount"), user)
          .groupBy(user).agg(F.count_if(F.col("amount") > F.col("average_amount") * 3).alias("high_risk_bookings")))
    return (s.join(hi, user, "left").join(degree, user, "left")
            .select(user, "total_transactions", "total_amount", "average_amount", "high_risk_bookings",
                    F.least(F.coalesce(F.col("degree_centrality"), F.lit(0.0)) * 100, F.lit(100.0)).alias("risk_score")))


def agency_profiles(bookings: DataFrame, degree: DataFrame, as_of: str, days: int = 90,
                    agency: str = "agency_id") -> DataFrame:
    """N-day count / mean / sum / distinct users and isolation = 1 - degree
    centrality (D12)."""
    b = bookings.where(_since("ts", as_of, f"{days} DAYS"))
    s = b.groupBy(agency).agg(F.count(F.lit(1)).alias("transaction_count"),
                              money_avg(F.col("amount")).alias("average_amount"),
                              money_sum(F.col("amount")).alias("total_amount"),
                              F.countDistinct("user_id").alias("unique_users"))
    return s.join(degree, agency, "left").select(
        agency, "transaction_count", "average_amount", "total_amount", "unique_users",
        (1.0 - F.coalesce(F.col("degree_centrality"), F.lit(0.0))).alias("isolation_risk"))


def risk_distribution(scored: DataFrame, as_of: str, hours: int = 24, score: str = "overall_risk") -> DataFrame:
    """Decisions per risk bucket in the last N hours and the block rate."""
    s = scored.where(_since("ts", as_of, f"{hours} HOURS"))
    total = s.agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("action_code") == "BLOCK").alias("_b"))
    g = s.groupBy(model_band(F.col(score)).alias("risk_bucket")).agg(F.count(F.lit(1)).alias("transactions"))
    return g.crossJoin(F.broadcast(total)).select(
        "risk_bucket", "transactions", F.col("_t").alias("total_transactions"),
        (F.col("_b") / F.col("_t")).alias("block_rate"))


def top_risk_factors(scored: DataFrame, as_of: str, hours: int = 24, k: int = 5,
                     factors: str = "travel_factors") -> DataFrame:
    """Most frequent factors with count and share, top k (D14).  The
    ranking is a global top-k: Spark keeps k rows per partition."""
    s = scored.where(_since("ts", as_of, f"{hours} HOURS")).select(F.explode(factors).alias("factor"))
    c = s.groupBy("factor").agg(F.count(F.lit(1)).alias("count"))
    tot = c.agg(F.sum("count").alias("_t"))
    return (c.crossJoin(F.broadcast(tot)).select("factor", "count", (F.col("count") * 100.0 / F.col("_t"))
                                                   .alias("percentage"))
            .orderBy(F.col("count").desc(), F.col("factor")).limit(k))


def log_patterns(logs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per user: requests, distinct endpoints, error rate (>= 400), mean
    response time over the look-back (A13, D15)."""
    l = logs.where(_since("ts", as_of, f"{hours} HOURS"))
    return l.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_requests"), F.countDistinct("endpoint").alias("unique_endpoints"),
        F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"),
        F.avg("response_time").alias("avg_response_time"))


def top_endpoints(logs: DataFrame, as_of: str, hours: int = 24, k: int = 10) -> DataFrame:
    """Ten most called endpoints per user, ties by endpoint."""
    l = logs.where(_since("ts", as_of, f"{hours} HOURS"))
    c = l.groupBy("user_id", "endpoint").agg(F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy("user_id").orderBy(F.col("calls").desc(), F.col("endpoint"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hour_histogram(logs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Requests per hour of day per user."""
    l = logs.where(_since("ts", as_of, f"{hours} HOURS"))
    return l.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("requests"))


def ip_security_features(logs: DataFrame) -> DataFrame:
    """Per-IP security feature row (D18) from raw log rows: volumes,
    diversity, error / auth-failure rates, latency mean and population std,
    private / suspicious address, bot agent, agent entropy (distinct set ->
    log2 n), VPN provider hits, proxy, request rate, burst, session abuse."""
    api = F.col("endpoint").startswith("/api")
    g = logs.groupBy("ip_address").agg(
        F.count_if(~api).alias("nginx_request_count"), F.count_if(api).alias("api_call_count"),
        F.count_if(F.col("method") == "GET").alias("redis_ops"),
        F.countDistinct("endpoint").alias("unique_endpoints"),
        F.countDistinct("user_agent").alias("unique_user_agents"),
        F.countDistinct("session_id").alias("unique_sessions"),
        F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"),
        F.avg(F.col("status_code").isin(401, 403).cast("double")).alias("auth_failure_rate"),
        F.avg("response_time").alias("avg_request_time"),
        F.stddev_pop("response_time").alias("request_time_std"),
        F.max(has_bot_agent(F.col("user_agent")).cast("int")).alias("has_bot_user_agent"),
        F.count(F.lit(1)).alias("_n"),
        (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))))
        .alias("_span_us"))
    agents = logs.select("ip_address", "user_agent").distinct().groupBy("ip_address").agg(
        F.sum(vpn_provider_hits(F.col("user_agent"))).alias("_vpn_hits"))
    g = g.join(agents, "ip_address", "left")
    n, span = F.col("_n"), F.col("_span_us") / 1e6
    ua, ses = F.col("unique_user_agents"), F.col("unique_sessions")
    return g.select(
        "ip_address", (F.col("nginx_request_count") + F.col("api_call_count")).alias("total_requests"),
        "nginx_request_count", "api_call_count", "redis_ops", "unique_endpoints", "unique_user_agents",
        "unique_sessions", "error_rate", "auth_failure_rate", "avg_request_time", "request_time_std",
        is_private_ip(F.col("ip_address")).cast("int").alias("is_private_ip"),
        F.col("ip_address").isin(SUSPICIOUS_IPS).cast("int").alias("is_suspicious_ip"),
        "has_bot_user_agent",
        F.when(ua > 0, F.log2(ua.cast("double"))).otherwise(F.lit(0.0)).alias("user_agent_entropy"),
        F.least(F.lit(1.0), F.col("_vpn_hits") * 0.3).alias("vpn_probability"),
        F.least(F.lit(1.0), F.when(ua > 5, 0.4).otherwise(0.0) + F.when(F.col("unique_endpoints") > 20, 0.3)
                .otherwise(0.0)).alias("proxy_probability"),
        F.when(n < 2, F.lit(0.0)).when(span == 0, n.cast("double")).otherwise(n / (span / 60.0))
        .alias("requests_per_minute"),
        (ses / 10.0).alias("session_switching_rate"),
        F.least(F.lit(1.0), F.when((ses > 3) & (ua > 2), 0.5).otherwise(0.0)
                + F.when((F.col("api_call_count") > 100) & (ses > 5), 0.3).otherwise(0.0)).alias("session_hijacking_score"),
        F.lit(0.5).alias("geo_risk_score"))


def agency_dashboard(scored: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Per agency at ``as_of``: 24 h count, mean risk, high-risk count
    (> .5), alerts in the last hour, 24 h volume and trend (D19)."""
    s = scored.where(_since("ts", as_of, "24 HOURS"))
    g = s.groupBy("agency_id").agg(F.count(F.lit(1)).alias("recent_transactions_24h"),
                                   F.avg("overall_risk").alias("average_risk_score"),
                                   F.count_if(F.col("overall_risk") > 0.5).alias("high_risk_transactions"),
                                   money_sum(F.col("amount")).alias("total_volume_24h"))
    a = (alerts.where(_since("alert_ts", as_of, "1 HOURS")).groupBy("agency_id")
         .agg(F.count(F.lit(1)).alias("active_alerts")))
    return g.join(a, "agency_id", "left").select(
        "agency_id", "recent_transactions_24h", "average_risk_score", "high_risk_transactions",
        F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"), "total_volume_24h",
        F.when(F.col("average_risk_score") > 0.4, "INCREASING").otherwise("STABLE").alias("risk_trend"))


def user_features(bookings: DataFrame, k: int = 3) -> DataFrame:
    """Per-user feature table (D20): mean amount, booking frequency per
    active day, destination diversity, top-3 destinations, mean lead time,
    weekend / night ratio, distinct IPs."""
    g = bookings.groupBy("user_id").agg(
        money_avg(F.col("amount")).alias("avg_booking_amount"),
        (F.count(F.lit(1)) / F.countDistinct(F.to_date("ts"))).alias("booking_frequency"),
        F.countDistinct("agency_id").alias("destination_diversity"),
        F.avg("days_to_travel").alias("avg_advance_booking_days"),
        F.avg(F.col("is_weekend").cast("double")).alias("weekend_booking_ratio"),
        F.avg(F.col("is_night_txn").cast("double")).alias("night_booking_ratio"),
        F.countDistinct("ip_address").alias("ip_count"))
    c = bookings.groupBy("user_id", "agency_id").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("user_id").orderBy(F.col("_c").desc(), F.col("agency_id"))
    top = (c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
           .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_r", "agency_id"))).alias("_t")))
    top = top.select("user_id", F.transform("_t", lambda s: s["agency_id"].cast("string")).alias("preferred_destinations"))
    return g.join(top, "user_id", "left")


def agency_features(bookings: DataFrame) -> DataFrame:
    """Per-agency feature table (D21): mean amount, distinct customers,
    repeat-customer ratio (customers with > 1 booking), cancellation rate."""
    per_user = bookings.groupBy("agency_id", "user_id").agg(F.count(F.lit(1)).alias("_n"),
                                                           F.count_if(F.col("booking_type") == "cruise").alias("_x"))
    return per_user.groupBy("agency_id").agg(
        F.countDistinct("user_id").alias("total_customers"),
        (F.count_if(F.col("_n") > 1) / F.count(F.lit(1))).alias("repeat_customer_ratio"),
        (F.sum("_x") / F.sum("_n")).alias("cancellation_rate"),
        F.sum("_n").alias("total_bookings")).join(
        bookings.groupBy("agency_id").agg(money_avg(F.col("amount")).alias("avg_transaction_amount")), "agency_id")
