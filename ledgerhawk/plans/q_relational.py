"""Relational queries: unify / clean / labels (2.B), joins (2.C),
aggregates (2.D), windows and sequences (2.E), sets (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as acc
from ..operators import clean as cl
from ..operators import labels as lb
from ..operators import sequences as sq
from ..operators.features import (behavioral_training_features, financial_training_features,
                                  security_training_features, with_ip_shared, with_user_frequency_24h)
from ..session import cut_lineage
from ..sources import adapters as ad
from .catalog import finish, r6, register
from .oracle_views import with_views

MONEY_SUM = "CAST(sum(CAST({x} AS DECIMAL(38,2))) AS DOUBLE)"


def msum(x: str) -> str:
    return MONEY_SUM.format(x=x)


def mavg(x: str) -> str:
    return f"{msum(x)} / count({x})"


# ------------------------------------------------------------------ 2.B
@register("unify_transactions", with_views("""
SELECT * FROM (
  SELECT cust_id, dest_id, amount, label, 'orders' AS dataset FROM txn
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), CAST(agency_id AS VARCHAR), amount, 0, 'bookings' FROM bookings
) u WHERE amount > 0 AND cust_id IS NOT NULL AND dest_id IS NOT NULL AND cust_id <> dest_id
""", ["txn", "bookings"]))
def q_unify(spark, sf):
    t = cl.unify(ad.transactions(spark, sf), "orders", "cust_id", "dest_id", "amount", "label")
    b = cl.unify(ad.bookings(spark, sf), "bookings", "user_id", "agency_id", "amount", None)
    return finish(cl.valid_transactions(cl.union_sources([t, b])))


CLEAN_COLS = ["amount", "oldbalanceOrg", "newbalanceOrig", "step"]


@register("clean_cap", with_views(
    "SELECT txn_id, " + ", ".join(
        f"round(coalesce(least(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.999) FROM txn)), 0.0), 6)"
        f" AS {c}"
        for c in CLEAN_COLS) + " FROM txn", ["txn"]))
def q_clean_cap(spark, sf):
    t = ad.transactions(spark, sf).select("txn_id", *CLEAN_COLS)
    c = cl.clean_numeric(t, CLEAN_COLS)
    return finish(c.select("txn_id", *[r6(x).alias(x) for x in CLEAN_COLS]))


WINS_COLS = ["amount", "cust_sum", "dest_sum", "step"]
_WINS_BASE = f"""SELECT t.txn_id, t.amount, c.cust_sum, d.dest_sum, CAST(t.step AS DOUBLE) AS step FROM txn t
  JOIN (SELECT cust_id, {msum('amount')} AS cust_sum FROM txn GROUP BY cust_id) c USING (cust_id)
  JOIN (SELECT dest_id, {msum('amount')} AS dest_sum FROM txn GROUP BY dest_id) d USING (dest_id)"""


@register("winsorize", with_views(
    "SELECT txn_id, " + ", ".join(
        f"round(CASE WHEN q.{c}_hi > 1e6 OR q.{c}_lo < -1e6 THEN least(greatest({c}, q.{c}_lo), q.{c}_hi) ELSE {c} END, 6)"
        f" AS {c}"
        for c in WINS_COLS)
    + " FROM wb, (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in WINS_COLS)
    + " FROM wb) q", ["txn"], [("wb", _WINS_BASE)]))
def q_winsorize(spark, sf):
    t = cut_lineage(ad.transactions(spark, sf).select("txn_id", "cust_id", "dest_id", "amount", "step"))   # read three times
    cs = acc.account_stats(t, "cust_id", "cust").select("cust_id", "cust_sum")
    ds = acc.account_stats(t, "dest_id", "dest").select("dest_id", "dest_sum")
    base = (t.join(cs, "cust_id").join(ds, "dest_id")
            .select("txn_id", "amount", "cust_sum", "dest_sum", F.col("step").cast("double").alias("step")))
    w = cl.winsorize_extreme(base, WINS_COLS)
    return finish(w.select("txn_id", *[r6(x).alias(x) for x in WINS_COLS]))


@register("label_behavioral", with_views("""
SELECT txn_id, CAST((amount > (SELECT quantile_cont(amount, 0.99) FROM bookings) OR device_seen_count = 1
        OR is_night_txn OR velocity_score > 8 OR spending_deviation_score > 0.8) AS INTEGER) AS label
FROM bookings""", ["bookings"]))
def q_label_behavioral(spark, sf):
    return finish(lb.label_behavioral(ad.bookings(spark, sf)).select("txn_id", "label"))


@register("label_financial", with_views("""
SELECT txn_id, CAST((amount > (SELECT quantile_cont(amount, 0.98) FROM txn)
        OR (type = 'TRANSFER' AND amount > 200000) OR (type = 'CASH_OUT' AND amount > 100000)
        OR oldbalanceOrg = 0 OR (oldbalanceOrg > 0 AND newbalanceOrig = 0 AND amount < oldbalanceOrg)) AS INTEGER)
       AS label
FROM txn""", ["txn"]))
def q_label_financial(spark, sf):
    return finish(lb.label_financial(ad.transactions(spark, sf)).select("txn_id", "label"))


@register("label_security", with_views("""
SELECT txn_id, CAST((amount < 1 OR step % 100 < 5 OR (type = 'TRANSFER' AND amount = round(amount))
        OR oldbalanceOrg = 0 OR (amount > 100000 AND type = 'CASH_OUT')) AS INTEGER) AS label
FROM txn""", ["txn"]))
def q_label_security(spark, sf):
    return finish(lb.label_security(ad.transactions(spark, sf)).select("txn_id", "label"))


@register("label_evaluation", with_views("""
SELECT txn_id, CAST((amount > (SELECT quantile_cont(amount, 0.95) FROM bookings) OR velocity_score > 8
        OR spending_deviation_score > 0.8 OR is_night_txn) AS INTEGER) AS label
FROM bookings""", ["bookings"]))
def q_label_evaluation(spark, sf):
    return finish(lb.label_evaluation(ad.bookings(spark, sf)).select("txn_id", "label"))


@register("booking_validation", with_views("""
SELECT txn_id, booking_type, amount,
       array_to_string(list_filter([CASE WHEN NOT coalesce(booking_type IN ('flight', 'hotel', 'package', 'car_rental'), false)
                                         THEN 'invalid_booking_type' END,
                                    CASE WHEN NOT coalesce(amount > 0, false) THEN 'non_positive_amount' END],
                                   lambda x: x IS NOT NULL), '|') AS rejection_reasons
FROM bookings
WHERE NOT coalesce(booking_type IN ('flight', 'hotel', 'package', 'car_rental'), false) OR NOT coalesce(amount > 0, false)
""", ["bookings"]))
def q_booking_validation(spark, sf):
    _, rejected = cl.validate_bookings(ad.bookings(spark, sf))
    return finish(rejected.select("txn_id", "booking_type", "amount", "rejection_reasons"))


@register("fk_violations", with_views("""
SELECT txn_id, agency_id FROM bookings b WHERE NOT EXISTS (SELECT 1 FROM agencies a WHERE a.agency_id = b.agency_id)
""", ["bookings", "agencies"]))
def q_fk_violations(spark, sf):
    v = cl.referential_violations(ad.bookings(spark, sf), ad.agencies(spark, sf), "agency_id", "agency_id")
    return finish(v.select("txn_id", "agency_id"))


@register("type_encoding", with_views("""
SELECT txn_id, type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS BIGINT) AS type_encoded,
       CAST(CASE type WHEN 'PAYMENT' THEN 0 WHEN 'TRANSFER' THEN 1 WHEN 'CASH_OUT' THEN 2 WHEN 'DEBIT' THEN 3
            WHEN 'CASH_IN' THEN 4 ELSE 0 END AS BIGINT) AS type_code
FROM txn""", ["txn"]))
def q_type_encoding(spark, sf):
    t = ad.transactions(spark, sf).select("txn_id", "type")
    t = cl.type_codes(acc.label_encode(t, "type", "type_encoded"))
    return finish(t)


# ------------------------------------------------------------------ 2.C / 2.D
@register("edge_agg", with_views(f"""
SELECT cust_id, dest_id, {msum('amount')} AS weight, count(*) AS count FROM txn GROUP BY cust_id, dest_id
""", ["txn"]))
def q_edge_agg(spark, sf):
    return finish(acc.edge_aggregate(ad.transactions(spark, sf)))


@register("account_stats", with_views(f"""
SELECT cust_id, count(amount) AS cust_count, {msum('amount')} AS cust_sum, {mavg('amount')} AS cust_mean,
       round(coalesce(stddev_samp(amount), 0.0), 6) AS cust_std, min(amount) AS cust_min, max(amount) AS cust_max,
       median(amount) AS cust_median
FROM txn GROUP BY cust_id""", ["txn"]))
def q_account_stats(spark, sf):
    s = acc.account_stats(ad.transactions(spark, sf), "cust_id", "cust")
    return finish(s.withColumn("cust_std", r6("cust_std")))


_STATS = """SELECT {k}, count(amount) AS {p}_count, {s} AS {p}_sum, {a} AS {p}_mean,
       coalesce(stddev_samp(amount), 0.0) AS {p}_std, max(amount) AS {p}_max FROM txn GROUP BY {k}"""


@register("account_join", with_views("""
SELECT txn_id, round(ln(1 + amount), 6) AS amount_log, 1.0 / (amount + 1) AS amount_reciprocal,
       CAST(amount % 10 = 0 OR amount % 100 = 0 OR amount % 1000 = 0 AS INTEGER) AS is_round_amount,
       cust_count, dest_count, round(cust_std, 6) AS cust_std,
       round((amount - cust_mean) / (cust_std + 1e-6), 6) AS amount_zscore_cust,
       round((amount - dest_mean) / (dest_std + 1e-6), 6) AS amount_zscore_dest,
       cust_sum / cust_count AS cust_velocity, dest_sum / dest_count AS dest_velocity,
       amount / (cust_max + 1) AS amount_vs_cust_max_ratio, amount / (dest_max + 1) AS amount_vs_dest_max_ratio,
       CAST(dense_rank() OVER (ORDER BY dataset) - 1 AS BIGINT) AS dataset_encoded
FROM txn LEFT JOIN cs USING (cust_id) LEFT JOIN ds USING (dest_id)""", ["txn"],
    [("cs", _STATS.format(k="cust_id", p="cust", s=msum("amount"), a=mavg("amount"))),
     ("ds", _STATS.format(k="dest_id", p="dest", s=msum("amount"), a=mavg("amount")))]))
def q_account_join(spark, sf):
    t = acc.transaction_features(ad.transactions(spark, sf))
    return finish(t.select("txn_id", r6("amount_log").alias("amount_log"), "amount_reciprocal", "is_round_amount",
                           "cust_count", "dest_count", r6("cust_std").alias("cust_std"),
                           r6("amount_zscore_cust").alias("amount_zscore_cust"),
                           r6("amount_zscore_dest").alias("amount_zscore_dest"), "cust_velocity", "dest_velocity",
                           "amount_vs_cust_max_ratio", "amount_vs_dest_max_ratio", "dataset_encoded"))


@register("zscore_by_type", with_views(f"""
SELECT txn_id, type, round((amount - m) / (s + 1e-6), 6) AS amount_zscore_by_type
FROM txn JOIN (SELECT type, {mavg('amount')} AS m, stddev_samp(amount) AS s FROM txn GROUP BY type) USING (type)
""", ["txn"]))
def q_zscore_by_type(spark, sf):
    t = financial_training_features(ad.transactions(spark, sf))
    return finish(t.select("txn_id", "type", r6("amount_zscore_by_type").alias("amount_zscore_by_type")))


@register("switching_rate", with_views("""
SELECT cust_id, CAST(count(DISTINCT dest_id) AS DOUBLE) / count(*) AS device_switching_rate,
       1.0 / (1.0 + CAST(count(DISTINCT dest_id) AS DOUBLE) / count(*)) AS device_consistency
FROM txn GROUP BY cust_id""", ["txn"]))
def q_switching_rate(spark, sf):
    return finish(acc.switching_rate(ad.transactions(spark, sf)))


# ------------------------------------------------------------------ 2.E
_IP_BASE = """
SELECT n.*, ips.ip_freq, ips.accounts_per_ip, ips.dest_per_ip, ips.devices_per_ip, sb.subnet_freq, dv.device_freq
FROM (SELECT *, array_to_string(string_split(ip_address, '.')[1:3], '.') AS subnet_24 FROM netlog) n
JOIN (SELECT ip_address, count(*) AS ip_freq, count(DISTINCT user_id) AS accounts_per_ip,
             count(DISTINCT dest_id) AS dest_per_ip, count(DISTINCT device_id) AS devices_per_ip
      FROM netlog GROUP BY ip_address) ips USING (ip_address)
JOIN (SELECT array_to_string(string_split(ip_address, '.')[1:3], '.') AS subnet_24, count(*) AS subnet_freq
      FROM netlog GROUP BY 1) sb USING (subnet_24)
JOIN (SELECT device_id, count(*) AS device_freq FROM netlog GROUP BY device_id) dv USING (device_id)"""


def _ip_gap_sql(first: str, rapid: str) -> str:
    return f"""SELECT *, coalesce(CAST(step - lag(step) OVER (PARTITION BY ip_address ORDER BY step, event_id) AS DOUBLE),
                 {first}) AS ip_tx_gap FROM ipb"""


@register("ip_gap_burst", with_views("""
SELECT event_id, ip_freq, subnet_freq, accounts_per_ip, dest_per_ip, device_freq, devices_per_ip, ip_tx_gap,
       rapid_fire_ip, ip_burst_5, tx_ip_hour,
       CAST(accounts_per_ip > 5 AS INTEGER) AS high_fan_in_ip, CAST(subnet_freq > 50 AS INTEGER) AS high_subnet_activity,
       CAST(device_freq <= 1 AS INTEGER) AS device_anomaly,
       CASE WHEN devices_per_ip = 0 THEN 0.0 ELSE accounts_per_ip / (devices_per_ip + 1e-6) END AS device_user_ratio
FROM (
  SELECT *, CAST(sum(rapid_fire_ip) OVER (PARTITION BY ip_address ORDER BY step, event_id
                 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS ip_burst_5,
         count(*) OVER (PARTITION BY ip_address, step // 3600) AS tx_ip_hour
  FROM (SELECT *, CAST(ip_tx_gap <= 2 AS INTEGER) AS rapid_fire_ip FROM gap) r
) x""", ["netlog"], [("ipb", _IP_BASE), ("gap", _ip_gap_sql("1e9", "<="))]))
def q_ip_gap_burst(spark, sf):
    d = sq.ip_sequence_features(ad.netlog(spark, sf), "A")
    return finish(d.select("event_id", "ip_freq", "subnet_freq", "accounts_per_ip", "dest_per_ip", "device_freq",
                           "devices_per_ip", "ip_tx_gap", "rapid_fire_ip", "ip_burst_5", "tx_ip_hour",
                           "high_fan_in_ip", "high_subnet_activity", "device_anomaly", "device_user_ratio"))


@register("burst_no_min", with_views("""
SELECT event_id, ip_tx_gap, rapid_fire_ip,
       CASE WHEN count(*) OVER w >= 5 THEN CAST(sum(rapid_fire_ip) OVER w AS DOUBLE) ELSE 0.0 END AS ip_burst_5,
       CAST(ip_freq > 50 AS INTEGER) AS high_ip_pressure, CAST(accounts_per_ip > 3 AS INTEGER) AS multi_account_ip,
       CAST(device_freq < 3 AS INTEGER) AS device_anomaly
FROM (SELECT *, CAST(ip_tx_gap < 2 AS INTEGER) AS rapid_fire_ip FROM gap) r
WINDOW w AS (PARTITION BY ip_address ORDER BY step, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""", ["netlog"], [("ipb", _IP_BASE), ("gap", _ip_gap_sql("9999.0", "<"))]))
def q_burst_no_min(spark, sf):
    d = sq.ip_sequence_features(ad.netlog(spark, sf), "B")
    return finish(d.select("event_id", "ip_tx_gap", "rapid_fire_ip", "ip_burst_5", "high_ip_pressure",
                           "multi_account_ip", "device_anomaly"))


@register("sequence_patterns", with_views("""
SELECT cust_id, n,
  CASE WHEN n > 1 THEN round(1.0 / (gap_std + 1), 6) ELSE 0.0 END AS transaction_regularity,
  CASE WHEN n > 1 THEN short_gaps / n ELSE 0.0 END AS burst_pattern,
  CASE WHEN n > 1 THEN close_amounts / n ELSE 0.0 END AS sequential_pattern,
  1 - distinct_amounts / n AS exact_amount_repetition,
  CAST(n > 1 AND n / (max_step - min_step + 1) > 1 AS INTEGER) AS velocity_attack,
  CAST(n > 20 AS INTEGER) AS high_frequency_user,
  round(CASE WHEN n > 1 THEN 1.0 / (gap_std + 1) ELSE 0.0 END * 0.3::DOUBLE + (1 - distinct_amounts / n) * 0.3::DOUBLE
        + CAST(n > 20 AS INTEGER) * 0.4::DOUBLE, 6) AS bot_behavior_score
FROM (
  SELECT cust_id, count(*) AS n, stddev_pop(g) AS gap_std, count(*) FILTER (WHERE g < 10) AS short_gaps,
         count(*) FILTER (WHERE ad < 10) AS close_amounts, count(DISTINCT amount) AS distinct_amounts,
         min(step) AS min_step, max(step) AS max_step
  FROM (SELECT cust_id, step, amount, step - lag(step) OVER w AS g, abs(amount - lag(amount) OVER w) AS ad
        FROM txn WINDOW w AS (PARTITION BY cust_id ORDER BY step, txn_id)) s
  GROUP BY cust_id) a""", ["txn"]))
def q_sequence_patterns(spark, sf):
    d = sq.account_sequence_features(ad.transactions(spark, sf))
    return finish(d.withColumn("transaction_regularity", r6("transaction_regularity"))
                  .withColumn("bot_behavior_score", r6("bot_behavior_score")))


@register("destination_flags", with_views("""
SELECT dest_id, count(*) AS dest_txn_count, CAST(count(*) > 50 AS INTEGER) AS popular_destination,
       CAST(count(*) <= 3 AS INTEGER) AS new_destination FROM txn GROUP BY dest_id""", ["txn"]))
def q_destination_flags(spark, sf):
    return finish(sq.destination_flags(ad.transactions(spark, sf)))


@register("keep_last_calls", with_views("""
SELECT user_id, event_id, CAST(recency_rank AS BIGINT) AS recency_rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency_rank
  FROM applogs) r WHERE recency_rank <= 101""", ["applogs"]))
def q_keep_last(spark, sf):
    d = sq.keep_last(ad.applogs(spark, sf), "user_id", "ts", 101, "event_id")
    return finish(d.select("user_id", "event_id", "recency_rank"))


@register("request_rate", with_views("""
SELECT ip_address, CASE WHEN n < 2 THEN 0.0 WHEN span = 0 THEN CAST(n AS DOUBLE) ELSE round(n / (span / 60.0), 6) END
       AS requests_per_minute
FROM (SELECT ip_address, count(*) AS n, max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6 AS span
      FROM applogs GROUP BY ip_address) g""", ["applogs"]))
def q_request_rate(spark, sf):
    d = sq.request_rate(ad.applogs(spark, sf))
    return finish(d.withColumn("requests_per_minute", r6("requests_per_minute")))


@register("burst_score", with_views("""
SELECT ip_address, CASE WHEN n < 10 THEN 0.0 ELSE short / (n - 1) END AS burst_behavior_score
FROM (SELECT ip_address, count(*) AS n, count(*) FILTER (WHERE iv < 1000000) AS short
      FROM (SELECT ip_address, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY ip_address
                   ORDER BY epoch_us(ts), event_id) AS iv FROM applogs) s GROUP BY ip_address) g""", ["applogs"]))
def q_burst_score(spark, sf):
    return finish(sq.burst_score(ad.applogs(spark, sf)))


@register("running_totals", with_views(f"""
SELECT txn_id, agency_id, first_seen, CAST(running_count AS BIGINT) AS running_count, running_volume, last_activity
FROM (SELECT txn_id, agency_id, min(ts) OVER w AS first_seen, count(*) OVER w AS running_count,
             CAST(sum(CAST(amount AS DECIMAL(38,2))) OVER w AS DOUBLE) AS running_volume, max(ts) OVER w AS last_activity
      FROM bookings WINDOW w AS (PARTITION BY agency_id ORDER BY ts, txn_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) r""", ["bookings"]))
def q_running_totals(spark, sf):
    d = sq.running_totals(ad.bookings(spark, sf), "agency_id", "ts", "amount", "txn_id")
    return finish(d.select("txn_id", "agency_id", "first_seen", "running_count", "running_volume", "last_activity"))


# ------------------------------------------------------------------ training frames
@register("security_features_train", with_views("""
SELECT txn_id, round(security_threat_score, 6) AS security_threat_score, round(bot_behavior_score, 6) AS bot_behavior_score,
       attack_pattern_score, network_anomaly_score, type_encoded, night_attack, weekend_attack,
       popular_destination, new_destination, emptied_account
FROM (
  SELECT *, round(bot_behavior_score * 0.3::DOUBLE + attack_pattern_score * 0.4::DOUBLE + network_anomaly_score * 0.3::DOUBLE, 6)
         AS security_threat_score
  FROM (
    SELECT t.txn_id, CAST(dense_rank() OVER (ORDER BY t.type) - 1 AS BIGINT) AS type_encoded,
      CASE WHEN a.n > 1 THEN 1.0 / (a.gap_std + 1) ELSE 0.0 END * 0.3::DOUBLE + (1 - a.distinct_amounts / a.n) * 0.3::DOUBLE
        + CAST(a.n > 20 AS INTEGER) * 0.4::DOUBLE AS bot_behavior_score,
      CAST(t.amount < 1 AS INTEGER) * 0.3::DOUBLE + CAST(a.n > 1 AND a.n / (a.max_step - a.min_step + 1) > 1 AS INTEGER) * 0.3::DOUBLE
        + CASE WHEN a.n > 1 THEN a.short_gaps / a.n ELSE 0.0 END * 0.4::DOUBLE AS attack_pattern_score,
      CAST(t.oldbalanceOrg = 0 AS INTEGER) * 0.2::DOUBLE + CAST(t.oldbalanceOrg = 0 AND t.amount > 10000 AS INTEGER) * 0.4::DOUBLE
        + CAST(abs(t.oldbalanceOrg - t.amount - t.newbalanceOrig) > 0.01 AS INTEGER) * 0.4::DOUBLE AS network_anomaly_score,
      CAST(t.step % 24 < 6 OR t.step % 24 > 22 AS INTEGER) AS night_attack,
      CAST((t.step // 24) % 7 >= 5 AS INTEGER) AS weekend_attack,
      CAST(d.c > 50 AS INTEGER) AS popular_destination, CAST(d.c <= 3 AS INTEGER) AS new_destination,
      CAST(t.oldbalanceOrg > 0 AND t.newbalanceOrig = 0 AS INTEGER) AS emptied_account
    FROM txn t
    JOIN (SELECT cust_id, count(*) AS n, stddev_pop(g) AS gap_std, count(*) FILTER (WHERE g < 10) AS short_gaps,
                 count(DISTINCT amount) AS distinct_amounts, min(step) AS min_step, max(step) AS max_step
          FROM (SELECT cust_id, step, amount, step - lag(step) OVER (PARTITION BY cust_id ORDER BY step, txn_id) AS g
                FROM txn) s GROUP BY cust_id) a USING (cust_id)
    JOIN (SELECT dest_id, count(*) AS c FROM txn GROUP BY dest_id) d USING (dest_id)
  ) x
) y""", ["txn"]))
def q_security_features_train(spark, sf):
    d = security_training_features(ad.transactions(spark, sf))
    return finish(d.select("txn_id", r6("security_threat_score").alias("security_threat_score"),
                           r6("bot_behavior_score").alias("bot_behavior_score"), "attack_pattern_score",
                           "network_anomaly_score", "type_encoded", "night_attack", "weekend_attack",
                           "popular_destination", "new_destination", "emptied_account"))


@register("financial_features_train", with_views(f"""
SELECT txn_id, is_large_amount, is_micro_amount, round(amount_zscore_by_type, 6) AS amount_zscore_by_type,
       balance_inconsistency, customer_txn_count, customer_avg_amount, amount_vs_customer_avg,
       popular_destination, new_destination, is_business_hours,
       amount_risk_score, balance_risk_score, customer_risk_score,
       amount_risk_score * 0.3::DOUBLE + balance_risk_score * 0.4::DOUBLE + customer_risk_score * 0.3::DOUBLE AS financial_risk_score
FROM (
  SELECT *, is_large_amount * 0.3::DOUBLE + is_micro_amount * 0.2::DOUBLE + CAST(abs(amount_zscore_by_type) > 3 AS INTEGER) * 0.5::DOUBLE
              AS amount_risk_score,
         balance_inconsistency * 0.4::DOUBLE + CAST(oldbalanceOrg = 0 AS INTEGER) * 0.3::DOUBLE
           + CAST(amount / (oldbalanceOrg + 1) > 10 AS INTEGER) * 0.3::DOUBLE AS balance_risk_score,
         CAST(customer_txn_count = 1 AS INTEGER) * 0.3::DOUBLE + CAST(amount_vs_customer_avg > 5 AS INTEGER) * 0.4::DOUBLE
           + CAST(coalesce(customer_amount_std > customer_avg_amount, false) AS INTEGER) * 0.3::DOUBLE AS customer_risk_score
  FROM (
    SELECT t.*, CAST(t.amount > (SELECT quantile_cont(amount, 0.95) FROM txn) AS INTEGER) AS is_large_amount,
           CAST(t.amount < 100 AS INTEGER) AS is_micro_amount,
           (t.amount - ty.m) / (ty.s + 1e-6) AS amount_zscore_by_type,
           CAST(abs(t.newbalanceOrig - t.oldbalanceOrg + t.amount) > 0.01 AS INTEGER) AS balance_inconsistency,
           c.customer_txn_count, c.customer_avg_amount, c.customer_amount_std,
           t.amount / (c.customer_avg_amount + 1) AS amount_vs_customer_avg,
           CAST(d.n > 100 AS INTEGER) AS popular_destination, CAST(d.n <= 5 AS INTEGER) AS new_destination,
           CAST(t.step % 24 BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours
    FROM txn t
    JOIN (SELECT type, {mavg('amount')} AS m, stddev_samp(amount) AS s FROM txn GROUP BY type) ty USING (type)
    JOIN (SELECT cust_id, count(amount) AS customer_txn_count, {mavg('amount')} AS customer_avg_amount,
                 stddev_samp(amount) AS customer_amount_std FROM txn GROUP BY cust_id) c USING (cust_id)
    JOIN (SELECT dest_id, count(*) AS n FROM txn GROUP BY dest_id) d USING (dest_id)
  ) x
) y""", ["txn"]))
def q_financial_features_train(spark, sf):
    d = financial_training_features(ad.transactions(spark, sf))
    return finish(d.select("txn_id", "is_large_amount", "is_micro_amount",
                           r6("amount_zscore_by_type").alias("amount_zscore_by_type"), "balance_inconsistency",
                           "customer_txn_count", "customer_avg_amount", "amount_vs_customer_avg",
                           "popular_destination", "new_destination", "is_business_hours", "amount_risk_score",
                           "balance_risk_score", "customer_risk_score", "financial_risk_score"))


def behavioral_frame(spark, sf):
    b = ad.bookings(spark, sf).withColumn("txn_hour", F.hour("ts")).withColumn("location", F.col("card_country"))
    b = with_ip_shared(with_user_frequency_24h(b))
    return behavioral_training_features(b)


@register("behavioral_features_train", with_views("""
SELECT txn_id, user_txn_frequency_24h, ip_exclusivity, round(location_popularity, 6) AS location_popularity,
       large_transaction, round(device_behavior_score, 6) AS device_behavior_score,
       round(temporal_behavior_score, 6) AS temporal_behavior_score,
       round(transaction_behavior_score, 6) AS transaction_behavior_score,
       round((1 - device_behavior_score) * 0.3::DOUBLE + (1 - temporal_behavior_score) * 0.3::DOUBLE
             + (1 - transaction_behavior_score) * 0.4::DOUBLE, 6) AS behavioral_risk_score
FROM (
  SELECT *, (1.0 / (device_seen_count + 1)) * 0.4::DOUBLE + CAST(NOT is_device_shared AS INTEGER) * 0.3::DOUBLE
              + (1 - CAST(device_seen_count <= 5 AS INTEGER)) * 0.3::DOUBLE AS device_behavior_score,
         (1 - CAST(is_night_txn AS INTEGER)) * 0.4::DOUBLE + (1 - CAST(hour(ts) < 6 OR hour(ts) > 22 AS INTEGER)) * 0.3::DOUBLE
              + (1 - CAST(is_weekend AS INTEGER)) * 0.3::DOUBLE AS temporal_behavior_score,
         (1 - least(1.0, greatest(0.0, velocity_score / 10))) * 0.3::DOUBLE
              + (1 - least(1.0, greatest(0.0, spending_deviation_score))) * 0.3::DOUBLE
              + (1 - CAST(user_txn_frequency_24h > 10 AS INTEGER)) * 0.2::DOUBLE
              + (1 - CAST(user_txn_frequency_24h > 50 AS INTEGER)) * 0.2::DOUBLE AS transaction_behavior_score
  FROM (
    SELECT b.*, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                               RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS user_txn_frequency_24h,
           CAST(NOT coalesce(s.shared, false) AS INTEGER) AS ip_exclusivity,
           l.n / (SELECT count(*) FROM bookings) AS location_popularity,
           CAST(amount > (SELECT quantile_cont(amount, 0.95) FROM bookings) AS INTEGER) AS large_transaction
    FROM bookings b
    LEFT JOIN (SELECT ip_address, count(DISTINCT user_id) > 1 AS shared FROM bookings GROUP BY ip_address) s
      USING (ip_address)
    LEFT JOIN (SELECT card_country, count(*) AS n FROM bookings GROUP BY card_country) l USING (card_country)
  ) x
) y""", ["bookings"]))
def q_behavioral_features_train(spark, sf):
    d = behavioral_frame(spark, sf)
    return finish(d.select("txn_id", "user_txn_frequency_24h", "ip_exclusivity",
                           r6("location_popularity").alias("location_popularity"), "large_transaction",
                           r6("device_behavior_score").alias("device_behavior_score"),
                           r6("temporal_behavior_score").alias("temporal_behavior_score"),
                           r6("transaction_behavior_score").alias("transaction_behavior_score"),
                           r6("behavioral_risk_score").alias("behavioral_risk_score")))


@register("velocity_1h_24h", with_views("""
SELECT txn_id, outflow_1h, CAST(txn_count_1h AS BIGINT) AS txn_count_1h, outflow_24h,
       CAST(txn_count_24h AS BIGINT) AS txn_count_24h, inflow_24h, seconds_since_last, repeat_destination,
       round(amount_percent_rank, 12) AS amount_percent_rank, just_below_threshold,
       CAST(nt AS DOUBLE) / n AS type_frequency
FROM (
  SELECT b.txn_id, b.user_id, b.type,
    CAST(sum(CAST(amount AS DECIMAL(38,2))) OVER w1 AS DOUBLE) AS outflow_1h, count(*) OVER w1 AS txn_count_1h,
    CAST(sum(CAST(amount AS DECIMAL(38,2))) OVER w24 AS DOUBLE) AS outflow_24h, count(*) OVER w24 AS txn_count_24h,
    CAST(sum(CAST(amount AS DECIMAL(38,2))) OVER (PARTITION BY agency_id ORDER BY epoch_us(ts)
         RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS inflow_24h,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), txn_id)) / 1e6
      AS seconds_since_last,
    count(*) OVER (PARTITION BY user_id, agency_id ORDER BY epoch_us(ts), txn_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS repeat_destination,
    percent_rank() OVER (PARTITION BY user_id ORDER BY amount) AS amount_percent_rank,
    amount >= 9000.0 AND amount < 10000.0 AS just_below_threshold
  FROM bookings b
  WINDOW w1 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW),
         w24 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
) v
JOIN (SELECT user_id, type, count(*) AS nt FROM bookings GROUP BY 1, 2) t USING (user_id, type)
JOIN (SELECT user_id, count(*) AS n FROM bookings GROUP BY 1) u USING (user_id)""", ["bookings"]))
def q_velocity_windows(spark, sf):
    v = sq.velocity_windows(ad.bookings(spark, sf))
    return finish(v.select("txn_id", "outflow_1h", "txn_count_1h", "outflow_24h", "txn_count_24h", "inflow_24h",
                           "seconds_since_last", "repeat_destination",
                           F.round("amount_percent_rank", 12).alias("amount_percent_rank"), "just_below_threshold",
                           "type_frequency"))
