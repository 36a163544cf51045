"""DuckDB SQL of the adapters in ``ledgerhawk.sources.adapters``.

Each entry is one CTE body; ``with_views(sql, names)`` prefixes a query
with the CTEs it needs (dependencies first).  Only the correctness check
uses this module.
"""

from __future__ import annotations

_TYPE_CASE = """CASE substring(o_orderpriority, 1, 1)
      WHEN '1' THEN 'TRANSFER' WHEN '2' THEN 'CASH_OUT' WHEN '3' THEN 'PAYMENT'
      WHEN '4' THEN 'DEBIT' WHEN '5' THEN 'CASH_IN' END"""

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

VIEWS["txn"] = f"""
SELECT txn_id, cust_id, dest_id, amount, label, dataset, type, step, oldbalanceOrg,
       greatest(oldbalanceOrg - amount, 0.0) AS newbalanceOrig, ts
FROM (
  SELECT l_orderkey * 100000 + l_suppkey AS txn_id,
         CAST(o_custkey AS VARCHAR) AS cust_id,
         CAST(l_suppkey AS VARCHAR) AS dest_id,
         CAST(CASE WHEN (l_orderkey * 100000 + l_suppkey) % 97 = 0 THEN 0.5
                   WHEN (l_orderkey * 100000 + l_suppkey) % 20 = 0 THEN floor(raw_amount / 1000 + 0.5) * 1000.0
                   ELSE raw_amount END AS DOUBLE) AS amount,
         CAST(label AS INTEGER) AS label,
         o_orderstatus AS dataset,
         {_TYPE_CASE} AS type,
         CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 24
           + l_orderkey % 24 AS step,
         greatest(coalesce(c_acctbal, 0.0), 0.0) AS oldbalanceOrg,
         o_orderdate AS ts
  FROM (
    SELECT l_orderkey, l_suppkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS raw_amount,
           max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN 1 ELSE 0 END) AS label
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority
  ) g LEFT JOIN customer ON o_custkey = c_custkey
) x
"""

VIEWS["gtxn"] = "SELECT * FROM txn WHERE cust_id <> dest_id"
DEPS["gtxn"] = ["txn"]

VIEWS["bk0"] = """
SELECT event_id AS txn_id, user_id, user_id % 27 AS agency_id,
       make_timestamp(epoch_us(ts) // 10) AS ts,
       CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS DOUBLE) AS amount,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events WHERE event_type = 'purchase'
"""

VIEWS["bookings"] = """
SELECT txn_id, user_id, agency_id, ts, amount, k,
  CASE WHEN k % 25 = 24 THEN 'cruise'
       ELSE CASE k % 4 WHEN 0 THEN 'flight' WHEN 1 THEN 'hotel' WHEN 2 THEN 'package' ELSE 'car_rental' END
  END AS booking_type,
  k % 60 AS days_to_travel,
  1 + k % 30 AS passenger_count,
  k % 3 = 0 AS is_international,
  CAST(k % 10 AS DOUBLE) / 10.0 AS destination_risk_score,
  CASE k % 6 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'prepaid_card'
             WHEN 3 THEN 'virtual_card' WHEN 4 THEN 'cryptocurrency' ELSE 'bank_transfer' END AS payment_method,
  k * 5 AS card_age_days,
  k % 11 <> 0 AS cvv_verification,
  k % 13 <> 0 AS avs_verification,
  CAST(k % 11 AS DOUBLE) AS velocity_score,
  k % 8 AS device_seen_count,
  k % 4 = 0 AS is_device_shared,
  k % 5 = 0 AS burst_detected,
  k % 17 = 0 AS geo_velocity_anomaly,
  CASE WHEN k % 9 = 0 THEN concat_ws('.', '185.220', CAST(user_id % 256 AS VARCHAR), CAST(k AS VARCHAR))
       WHEN k % 9 = 1 THEN concat_ws('.', '192.168', CAST(user_id % 256 AS VARCHAR), CAST(k AS VARCHAR))
       ELSE concat_ws('.', '84', CAST(user_id % 256 AS VARCHAR), CAST(k % 50 AS VARCHAR), CAST(k AS VARCHAR))
  END AS ip_address,
  CAST(k % 10 AS DOUBLE) / 10.0 AS session_hijacking_score,
  CAST(k % 20 AS DOUBLE) / 20.0 AS spending_deviation_score,
  (hour(ts) >= 22 OR hour(ts) <= 6) AS is_night_txn,
  dayofweek(ts) IN (0, 6) AS is_weekend,
  CASE k % 5 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'CASH_OUT' WHEN 2 THEN 'PAYMENT' WHEN 3 THEN 'DEBIT'
             ELSE 'CASH_IN' END AS type,
  CAST(k % 7 AS DOUBLE) * 20000.0 AS oldbalanceOrg,
  greatest(CAST(k % 7 AS DOUBLE) * 20000.0 - amount, 0.0) AS newbalanceOrig,
  k % 23 = 0 AS refund_requested_immediately,
  k % 19 <> 0 AS has_passenger_names,
  CASE k % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'NG' WHEN 3 THEN 'IN' ELSE 'DE' END AS card_country,
  CASE (k + user_id) % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'NG' WHEN 3 THEN 'IN' ELSE 'DE' END
    AS billing_country
FROM bk0
"""
DEPS["bookings"] = ["bk0"]

VIEWS["agencies"] = """
SELECT CAST(n_nationkey AS BIGINT) AS agency_id,
       (n_nationkey * 17) % 120 AS agency_age_days,
       (n_nationkey * 7) % 40 AS total_transactions,
       CAST(n_nationkey % 7 AS DOUBLE) / 100.0 AS chargeback_rate,
       n_nationkey % 4 <> 0 AS license_verified,
       CAST(n_nationkey % 8 AS DOUBLE) AS volume_growth_30d
FROM nation
"""

VIEWS["lg0"] = """
SELECT event_id, event_type, value, user_id, user_id % 10 AS u,
       make_timestamp(epoch_us(ts) // 100) AS ts,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events
"""

VIEWS["lg1"] = """
SELECT *,
  CASE WHEN event_type = 'error' THEN 500
       WHEN event_type = 'view' AND k % 10 = 0 THEN 404
       WHEN event_type = 'signup' AND k % 9 = 0 THEN 401
       WHEN event_type = 'click' AND k % 13 = 0 THEN 403
       WHEN event_type IN ('signup', 'purchase') THEN 201
       ELSE 200 END AS status_code
FROM lg0
"""
DEPS["lg1"] = ["lg0"]

VIEWS["applogs"] = """
SELECT event_id, ts,
  'user_' || CAST(u AS VARCHAR) AS user_id,
  'user_' || CAST(u AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS session_id,
  concat_ws('.', '10', CAST(u % 4 AS VARCHAR), CAST(k % 16 AS VARCHAR), CAST(u % 32 AS VARCHAR)) AS ip_address,
  'dev_' || CAST(user_id % 40 AS VARCHAR) AS device_id,
  CASE event_type WHEN 'view' THEN '/api/v1/flights/search'
       WHEN 'click' THEN '/agencies/AG' || CAST(k % 27 AS VARCHAR) || '/profile'
       WHEN 'signup' THEN '/users/user_' || CAST(k % 10 AS VARCHAR) || '/review'
       WHEN 'purchase' THEN '/bookings'
       ELSE '/api/v1/payments' END AS endpoint,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
  status_code,
  value / 50.0 AS response_time,
  CASE k % 7 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)'
             WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 13_0)'
             WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)'
             WHEN 3 THEN 'python-requests/2.31 automation-bot'
             WHEN 4 THEN 'Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/120'
             WHEN 5 THEN 'Mozilla/5.0 (Windows NT 10.0) NordVPN/7.1'
             ELSE 'Scrapy/2.11 (+https://scrapy.org)' END AS user_agent,
  CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'purchase' THEN 'AG' || CAST(k % 27 AS VARCHAR) END AS agency_id,
  CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(12,2)) * 1000 AS DOUBLE) END AS amount,
  CASE WHEN event_type = 'purchase' THEN
       CASE k % 4 WHEN 0 THEN 'flight' WHEN 1 THEN 'hotel' WHEN 2 THEN 'package' ELSE 'car_rental' END
  END AS booking_type
FROM lg1
"""
DEPS["applogs"] = ["lg1"]

VIEWS["wtxn"] = """
SELECT txn_id, cust_id AS user_id, dest_id AS agency_id, amount, ts AS created_at,
       CASE dataset WHEN 'F' THEN 'completed' WHEN 'P' THEN 'cancelled' ELSE 'pending' END AS status,
       label AS is_fraud
FROM txn
"""
DEPS["wtxn"] = ["txn"]

VIEWS["wusers"] = """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_nationkey AS nation,
       CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS risk_score
FROM customer
"""

VIEWS["wagencies"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS agency_id, s_name AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_category,
       s_nationkey % 3 <> 0 AS is_verified
FROM supplier
"""


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, names: list[str], extra: list[tuple[str, str]] | None = None,
               materialize: bool = False) -> str:
    """Prefix ``sql`` with the CTEs of ``names`` (and extra named CTEs;
    ``materialize`` marks the extras MATERIALIZED, for unrolled loops)."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _order(names)]
    m = "MATERIALIZED " if materialize else ""
    parts += [f"{n} AS {m}({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + sql

VIEWS["netlog"] = """
SELECT event_id, ip_address, device_id, user_id, endpoint AS dest_id, ts AS timestamp,
       epoch_us(ts) // 1000000 AS step, CAST(status_code >= 500 AS INTEGER) AS label
FROM applogs
"""
DEPS["netlog"] = ["applogs"]
