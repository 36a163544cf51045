"""Adapters from the driver's TPC-H-like tables to the fraud data model.

Each adapter is a Spark plan over the given tables, so its work grows with
them.  The same definitions exist as DuckDB SQL in
``ledgerhawk.plans.oracle_views``; the two are kept in step by the
correctness check.

* ``transactions`` — one row per (order, supplier): PaySim-like transfer
  from customer ``cust_id`` to supplier ``dest_id`` (one shared id space,
  so the account graph is not bipartite).
* ``bookings``     — purchase events as travel bookings, time compressed
  x10 so the 6-hour velocity tiers fire.
* ``agencies``     — one agency record per nation; agencies 25 and 26 have
  no record on purpose (the "no agency data" path).
* ``applogs``      — all events as application-log rows, ten users, time
  compressed x100 so hourly anomaly thresholds are reached.
* ``warehouse_users`` / ``warehouse_agencies`` — customer / supplier rows
  shaped like the warehouse tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the adapters (not taken from anywhere; chosen so every
# rule branch is reachable on the driver data).
# ---------------------------------------------------------------------------
PRIORITY_TO_TYPE = {
    "1-URGENT": "TRANSFER",
    "2-HIGH": "CASH_OUT",
    "3-MEDIUM": "PAYMENT",
    "4-NOT SPECIFIED": "DEBIT",
    "5-LOW": "CASH_IN",
}
BOOKING_TYPES = ["flight", "hotel", "package", "car_rental"]
PAYMENT_METHODS = ["credit_card", "debit_card", "prepaid_card", "virtual_card",
                   "cryptocurrency", "bank_transfer"]
COUNTRIES = ["US", "GB", "NG", "IN", "DE"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 13_0)",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)",
    "python-requests/2.31 automation-bot",
    "Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/120",
    "Mozilla/5.0 (Windows NT 10.0) NordVPN/7.1",
    "Scrapy/2.11 (+https://scrapy.org)",
]
EPOCH_DAY = "1995-01-01"


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] as a CASE expression (idx is a small non-negative int)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("int")


def _compress(ts: str, factor: int) -> Column:
    """Divide the epoch time by ``factor`` (keeps the wall-clock type)."""
    return F.timestamp_micros(F.expr(f"unix_micros(cast({ts} as timestamp)) div {factor}")).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified transaction table (cust_id, dest_id, amount, label, dataset)
    plus the PaySim-like columns the scorers read."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity"])
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    # Join first: the shuffle on the order key also clusters the
    # (order, supplier) grouping, so the aggregate adds no exchange.
    lines = li.join(o, li.l_orderkey == o.o_orderkey)
    g = lines.groupBy("l_orderkey", "l_suppkey", "o_custkey", "o_orderstatus",
                      "o_orderdate", "o_orderpriority").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("raw_amount"),
        F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48), 1)
              .otherwise(0)).alias("label"))
    g = g.join(c, g.o_custkey == c.c_custkey, "left")
    txn_id = F.col("l_orderkey") * 100000 + F.col("l_suppkey")
    amount = (F.when(F.col("txn_id") % 97 == 0, F.lit(0.5))
              .when(F.col("txn_id") % 20 == 0, F.floor(F.col("raw_amount") / 1000 + 0.5) * 1000.0)
              .otherwise(F.col("raw_amount")))
    step = (F.datediff(F.to_date("o_orderdate"), F.lit(EPOCH_DAY)).cast("long") * 24
            + F.col("l_orderkey") % 24)
    old = F.greatest(F.coalesce(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0))
    return (g.withColumn("txn_id", txn_id)
            .withColumn("amount", amount.cast("double"))
            .select(
                "txn_id",
                F.col("o_custkey").cast("string").alias("cust_id"),
                F.col("l_suppkey").cast("string").alias("dest_id"),
                "amount",
                F.col("label").cast("int").alias("label"),
                F.col("o_orderstatus").alias("dataset"),
                _pick(list(PRIORITY_TO_TYPE.values()),
                      F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("type"),
                step.alias("step"),
                old.alias("oldbalanceOrg"),
                F.greatest(old - F.col("amount"), F.lit(0.0)).alias("newbalanceOrig"),
                F.col("o_orderdate").alias("ts"),
            ))


def graph_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions between two different accounts: the account graph."""
    t = transactions(spark, sf_dir)
    return t.filter(F.col("cust_id") != F.col("dest_id"))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as booking requests with every field the travel,
    behavioural, financial and network scorers read."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    b = (ev.filter(F.col("event_type") == "purchase")
         .select(F.col("event_id").alias("txn_id"), "user_id",
                 (F.col("user_id") % 27).alias("agency_id"),
                 _compress("ts", 10).alias("ts"),
                 (F.col("value").cast("decimal(12,2)") * 1000).cast("double").alias("amount"),
                 _k().alias("k")))
    k = F.col("k")
    u = F.col("user_id")
    old = (k % 7).cast("double") * 20000.0
    ip = (F.when(k % 9 == 0, F.concat_ws(".", F.lit("185.220"), (u % 256).cast("string"), k.cast("string")))
          .when(k % 9 == 1, F.concat_ws(".", F.lit("192.168"), (u % 256).cast("string"), k.cast("string")))
          .otherwise(F.concat_ws(".", F.lit("84"), (u % 256).cast("string"), (k % 50).cast("string"),
                                 k.cast("string"))))
    hour = F.hour("ts")
    return b.select(
        "txn_id", "user_id", "agency_id", "ts", "amount", "k",
        _pick(BOOKING_TYPES + ["cruise"], F.when(k % 25 == 24, 4).otherwise(k % 4)).alias("booking_type"),
        (k % 60).alias("days_to_travel"),
        (1 + k % 30).alias("passenger_count"),
        (k % 3 == 0).alias("is_international"),
        ((k % 10) / 10.0).alias("destination_risk_score"),
        _pick(PAYMENT_METHODS, k % 6).alias("payment_method"),
        (k * 5).alias("card_age_days"),
        (k % 11 != 0).alias("cvv_verification"),
        (k % 13 != 0).alias("avs_verification"),
        (k % 11).cast("double").alias("velocity_score"),
        (k % 8).alias("device_seen_count"),
        (k % 4 == 0).alias("is_device_shared"),
        (k % 5 == 0).alias("burst_detected"),
        (k % 17 == 0).alias("geo_velocity_anomaly"),
        ip.alias("ip_address"),
        ((k % 10) / 10.0).alias("session_hijacking_score"),
        ((k % 20) / 20.0).alias("spending_deviation_score"),
        ((hour >= 22) | (hour <= 6)).alias("is_night_txn"),
        F.dayofweek("ts").isin(1, 7).alias("is_weekend"),
        _pick(list(PRIORITY_TO_TYPE.values()), k % 5).alias("type"),
        old.alias("oldbalanceOrg"),
        F.greatest(old - F.col("amount"), F.lit(0.0)).alias("newbalanceOrig"),
        (k % 23 == 0).alias("refund_requested_immediately"),
        (k % 19 != 0).alias("has_passenger_names"),
        _pick(COUNTRIES, k % 5).alias("card_country"),
        _pick(COUNTRIES, (k + u) % 5).alias("billing_country"),
    )


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agency records derived from ``nation``; ids 25 and 26 have none."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey"])
    a = F.col("n_nationkey")
    return n.select(
        a.cast("long").alias("agency_id"),
        ((a * 17) % 120).alias("agency_age_days"),
        ((a * 7) % 40).alias("total_transactions"),
        ((a % 7) / 100.0).alias("chargeback_rate"),
        (a % 4 != 0).alias("license_verified"),
        ((a % 8) * 1.0).alias("volume_growth_30d"),
    )


def applogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as typed application-log rows (10 users, time x100)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    e = ev.select("event_id", "event_type", "value", "user_id",
                  (F.col("user_id") % 10).alias("u"), _compress("ts", 100).alias("ts"), _k().alias("k"))
    k, u, et = F.col("k"), F.col("u"), F.col("event_type")
    endpoint = (F.when(et == "view", F.lit("/api/v1/flights/search"))
                .when(et == "click", F.concat(F.lit("/agencies/AG"), (k % 27).cast("string"), F.lit("/profile")))
                .when(et == "signup", F.concat(F.lit("/users/user_"), (k % 10).cast("string"), F.lit("/review")))
                .when(et == "purchase", F.lit("/bookings"))
                .otherwise(F.lit("/api/v1/payments")))
    method = F.when(et.isin("signup", "purchase"), F.lit("POST")).otherwise(F.lit("GET"))
    status = (F.when(et == "error", 500)
              .when((et == "view") & (k % 10 == 0), 404)
              .when((et == "signup") & (k % 9 == 0), 401)
              .when((et == "click") & (k % 13 == 0), 403)
              .when(et.isin("signup", "purchase"), 201)
              .otherwise(200))
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("user_"), u.cast("string")).alias("user_id"),
        F.concat(F.lit("user_"), u.cast("string"), F.lit("_"),
                 F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.concat_ws(".", F.lit("10"), (u % 4).cast("string"), (k % 16).cast("string"),
                    (u % 32).cast("string")).alias("ip_address"),
        F.concat(F.lit("dev_"), (F.col("user_id") % 40).cast("string")).alias("device_id"),
        endpoint.alias("endpoint"), method.alias("method"), status.alias("status_code"),
        (F.col("value") / 50.0).alias("response_time"),
        _pick(USER_AGENTS, k % 7).alias("user_agent"),
        F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO").alias("level"),
        F.when(et == "purchase", F.concat(F.lit("AG"), (k % 27).cast("string"))).alias("agency_id"),
        F.when(et == "purchase", (F.col("value").cast("decimal(12,2)") * 1000).cast("double")).alias("amount"),
        F.when(et == "purchase", _pick(BOOKING_TYPES, k % 4)).alias("booking_type"),
    )


def warehouse_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transactions`` shaped like the warehouse table: user -> agency
    (customer -> supplier), status from the order status."""
    t = transactions(spark, sf_dir)
    return t.select(
        "txn_id",
        F.col("cust_id").alias("user_id"),
        F.col("dest_id").alias("agency_id"),
        "amount",
        F.col("ts").alias("created_at"),
        F.when(F.col("dataset") == "F", "completed").when(F.col("dataset") == "P", "cancelled")
        .otherwise("pending").alias("status"),
        F.col("label").alias("is_fraud"),
    )


def warehouse_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    return c.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        (((F.col("c_custkey") * 7919) % 1000) / 1000.0).alias("risk_score"),
    )


def warehouse_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    return s.select(
        F.col("s_suppkey").cast("string").alias("agency_id"),
        F.col("s_name").alias("name"),
        _pick(["high", "medium", "low"], F.col("s_suppkey") % 3).alias("risk_category"),
        (F.col("s_nationkey") % 3 != 0).alias("is_verified"),
    )


def netlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application logs as network-log rows (ip, device, user, destination
    endpoint, timestamp, integer step in seconds, label = server error)."""
    a = applogs(spark, sf_dir)
    return a.select("event_id", "ip_address", "device_id", "user_id", F.col("endpoint").alias("dest_id"),
                    F.col("ts").alias("timestamp"),
                    F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("step"),
                    (F.col("status_code") >= 500).cast("int").alias("label"))
