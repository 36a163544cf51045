"""Mappings of foreign transaction schemas to security features and network
rows (B15a-c), the online security inputs (I5) and evaluation inputs (I21).

Ranges, factors and defaults are fixed values of the mappings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_round, type_code


def _or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def device_rich_security_features(df: DataFrame, row_id: str) -> DataFrame:
    """Device-rich transactions as security feature rows (B15a): request volume
    from transaction counts, diversity from velocity and sharing, errors from
    the spending deviation, masking from shared addresses, sessions from
    geography.  A missing address is made from the row's id."""
    dev = _or(df, "spending_deviation_score", 1.0).cast("double")
    shared_ip, shared_dev = _or(df, "is_ip_shared", False).cast("int"), _or(df, "is_device_shared", False).cast("int")
    speed = _or(df, "velocity_score", 3.0).cast("double")
    ip = F.coalesce(F.col("ip_address"), F.concat((F.col(row_id) % 255).cast("string"), F.lit(".10.10.10")))
    total = _clip(_or(df, "txn_count_last_24h", 5).cast("double"), 1.0, 1000.0).cast("long")
    hour = _or(df, "txn_count_last_1h", 1).cast("double")
    return df.select(
        row_id, ip.alias("ip_address"), total.alias("total_requests"), F.floor(total * 0.6).alias("nginx_request_count"),
        _clip(hour, 0.0, 100.0).cast("long").alias("api_call_count"), F.lit(2).cast("long").alias("redis_ops"),
        _clip(speed, 1.0, 100.0).cast("long").alias("unique_endpoints"), (shared_dev * 3 + 1).cast("long").alias("unique_user_agents"),
        _clip(_or(df, "device_seen_count", 5).cast("double"), 1.0, 50.0).cast("long").alias("unique_sessions"),
        _clip(dev / 10.0, 0.0, 1.0).alias("error_rate"), _clip(dev / 20.0, 0.0, 1.0).alias("auth_failure_rate"),
        (_clip(_or(df, "time_since_last_transaction", 100.0).cast("double"), 0.0, 1e6) / 1000.0).alias("avg_request_time"),
        (_clip(_or(df, "avg_gap_between_txns", 50.0).cast("double"), 0.0, 1e6) / 1000.0).alias("request_time_std"),
        (ip.startswith("10.") | ip.startswith("192.168.")).cast("int").alias("is_private_ip"), shared_ip.alias("is_suspicious_ip"),
        F.lit(0).alias("has_bot_user_agent"), _clip(dev / 3.0, 0.0, 3.0).alias("user_agent_entropy"),
        (shared_ip * 0.7).alias("vpn_probability"), (shared_dev * 0.5).alias("proxy_probability"),
        _clip(hour / 60.0, 0.0, 100.0).alias("requests_per_minute"), (_clip(speed, 0.0, 10.0) / 10.0).alias("burst_behavior_score"),
        (_or(df, "geo_velocity_anomaly", False).cast("int") * 0.8).alias("session_switching_rate"),
        (_clip(_or(df, "geo_anomaly_score", 0.0).cast("double"), 0.0, 10.0) / 10.0).alias("session_hijacking_score"),
        _or(df, "is_fraud", 0).cast("int").alias("label"))


def step_address(step: Column, amount: Column, tail: str) -> Column:
    """An address made from step and amount (B15b); missing ones count 0."""
    octet = lambda c: F.pmod(F.coalesce(c, F.lit(0)).cast("long"), F.lit(255)).cast("string")
    return F.concat_ws(".", octet(step), octet(amount), F.lit(tail))


def network_rows(df: DataFrame, row_id: str, src: str | None, dst: str | None, label: str | None,
                 step: str | None, amount: str | None, tail: str, devices: int | None = None) -> DataFrame:
    """Transactions as network-log rows (B15c): address, device, user,
    destination, time, label, step.  Sources without accounts, steps or amounts
    get names and steps from the stable row id."""
    i = F.col(row_id).cast("long")
    user = F.col(src).cast("string") if src else i.cast("string")
    at = F.col(step).cast("long") if step else i
    ip = step_address(F.col(step), F.col(amount), tail) if step and amount else F.concat_ws(".", F.pmod(i, F.lit(255)).cast("string"), F.lit(tail))
    device = F.concat(F.lit("dev_"), F.pmod(i, F.lit(devices)).cast("string") if devices else F.substring(user, 1, 8))
    return df.select(
        row_id, ip.alias("ip_address"), device.alias("device_id"), user.alias("user_id"),
        (F.col(dst).cast("string") if dst else F.concat(F.lit("d_"), i.cast("string"))).alias("dest_id"),
        F.timestamp_seconds(F.coalesce(at, F.lit(0))).cast("timestamp_ntz").alias("timestamp"),
        (F.coalesce(F.col(label).cast("int"), F.lit(0)) if label else F.lit(0)).alias("label"), at.alias("step"))


def security_inputs(df: DataFrame) -> DataFrame:
    """The 21 online security inputs in their order."""
    amount, step = _or(df, "amount", 1000.0).cast("double"), _or(df, "step", 100).cast("long")
    old = _or(df, "oldbalanceOrg", 10000.0).cast("double")
    new = F.coalesce(F.col("newbalanceOrig").cast("double"), old - amount) if "newbalanceOrig" in df.columns else old - amount
    kind = F.col("type") if "type" in df.columns else F.lit("PAYMENT")
    hour = F.pmod(step, F.lit(24))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return df.select(
        "*", amount.alias("in_amount"), F.log1p(amount).alias("amount_log"), step.alias("in_step"),
        flag(amount < 1).alias("micro_transaction_attack"), flag(is_round(amount, 100)).alias("round_amount_pattern"),
        flag(amount == 0.01).alias("penny_transaction"), hour.alias("transaction_hour"), flag((hour < 6) | (hour > 22)).alias("night_attack"),
        flag(F.pmod(F.floor(step / 24), F.lit(7)) >= 5).alias("weekend_attack"), old.alias("in_oldbalance"), new.alias("in_newbalance"),
        flag(old == 0).alias("zero_balance_creation"), flag((old == 0) & (amount > 10000)).alias("instant_large_transaction"),
        flag(F.abs(old - amount - new) > 0.01).alias("balance_inconsistency"), flag((old > 0) & (new == 0)).alias("emptied_account"),
        type_code(kind).alias("type_encoded"), flag(kind.isin("TRANSFER", "CASH_OUT")).alias("high_risk_type"),
        _or(df, "user_frequency", 5).cast("double").alias("transaction_frequency"),
        _or(df, "destination_popularity", 0.1).cast("double").alias("destination_risk"),
        (_or(df, "velocity_score", 5.0).cast("double") / 10).alias("normalized_velocity"),
        _or(df, "burst_detected", False).cast("double").alias("burst_pattern"))


def evaluation_inputs(df: DataFrame, kind: str, large: float | None = None) -> DataFrame:
    """Evaluation inputs (I21): ``behavioral`` (6), ``financial`` (10; ``large``
    is the 95 % quantile of the amount), ``security`` (6; night is after 22)."""
    amount = F.col("amount")
    if kind == "behavioral":
        return df.select(
            "txn_id", (1 / (F.col("device_seen_count") + 1)).alias("device_trust_score"), (~F.col("is_device_shared")).cast("int").alias("device_exclusivity"),
            _clip(F.col("velocity_score") / 10, 0.0, 1.0).alias("velocity_risk"), _clip(F.col("spending_deviation_score"), 0.0, 1.0).alias("spending_anomaly"),
            F.log1p(amount).alias("amount_log"), is_round(amount, 1000).cast("int").alias("round_amount"))
    if kind == "financial":
        return df.select(
            "txn_id", "amount", "oldbalanceOrg", "newbalanceOrig", "step", F.log1p(amount).alias("amount_log"),
            (amount > F.lit(large)).cast("int").alias("is_large_amount"), (amount / (F.col("oldbalanceOrg") + 1)).alias("balance_ratio"),
            type_code(F.col("type")).alias("type_encoded"))
    hour = F.pmod(F.col("step"), F.lit(24))
    return df.select(
        "txn_id", F.log1p(amount).alias("amount_log"), (amount < 1).cast("int").alias("micro_transaction"), is_round(amount, 100).cast("int").alias("round_amount"),
        hour.alias("transaction_hour"), (hour > 22).cast("int").alias("night_activity"), (F.col("oldbalanceOrg") == 0).cast("int").alias("zero_balance"))
