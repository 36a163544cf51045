"""Counters, anomalies, merges and stateful stream processors.

Every operator has a batch twin with identical semantics, so a replay of
a log folder through the stream equals the batch query.  Windows use
event time; streaming aggregations carry a watermark so their state is
bounded (the reference used processing-time TTL keys instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of the anomaly rules -----------------------------------------
ERRORS_PER_HOUR = 10
CALLS_PER_HOUR = 100
SLOW_SECONDS = 5.0
SLOW_FACTOR = 3
RESPONSE_HISTORY = 101


def _wm(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def hourly_counters(logs: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """API calls and errors (status >= 400) per user and event hour."""
    d = _wm(logs, "ts", watermark)
    return d.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("api_calls"), F.count_if(F.col("status_code") >= 400).alias("errors")
    ).select("user_id", F.col("w.start").alias("hour_start"), "api_calls", "errors")


def daily_activity(logs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Requests per user and event day (L4)."""
    d = _wm(logs, "ts", watermark)
    return d.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(
        "user_id", F.col("w.start").alias("day_start"), "requests")


def edge_counters(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Pair weight sum and pair count per 24 h window."""
    d = _wm(events, "ts", watermark)
    return d.groupBy("source_user", "target_entity", F.window("ts", "24 hours").alias("w")).agg(
        F.sum("amount").alias("connection_weight"), F.count(F.lit(1)).alias("txn_count")).select(
        "source_user", "target_entity", F.col("w.start").alias("window_start"), "connection_weight", "txn_count")


def anomalies(logs: DataFrame, order_id: str = "event_id", expire_seconds: int | None = None) -> DataFrame:
    """Per-event anomaly rows (batch twin of ``timed.anomaly_stream``).
    With ``expire_seconds`` a user's response times are forgotten when none
    came for so long, and the mean starts anew (L6):

    * high_error_rate (medium): status >= 500 and more than 10 errors in the
      user's event hour so far;
    * unusual_response_time (low): response > 5 s and > 3x the mean of the
      user's latest 101 positive response times (current included);
    * high_api_frequency (high): more than 100 calls in the event hour so far.
    """
    from ..operators.ordered import prefix_sums, sequence_window
    rt = F.col("response_time")
    base = logs.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    # running calls / errors inside the user's event hour: prefix sums per
    # (user, hour) key, so a hot user-hour is split over blocks
    hk = F.concat_ws("|", F.col("user_id"), F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH"))
    cnt = base.select(order_id, hk.alias("_uh"), "_us", F.lit(1).alias("_one"),
                      (F.col("status_code") >= 400).cast("int").alias("_err"))
    run = prefix_sums(cnt, ["_us", order_id], ["_one", "_err"], by="_uh").select(
        order_id, F.col("cum__one").alias("_calls"), F.col("cum__err").alias("_errors"))

    def mean_rt(w):
        f = w.rowsBetween(-(RESPONSE_HISTORY - 1), 0)
        return [F.coalesce(F.avg(F.when(rt > 0, rt)).over(f), F.lit(1.0)).alias("_avg_rt")]

    key = "user_id"
    if expire_seconds is not None:
        timed = base.where(rt > 0).select(order_id, "user_id", "_us")
        timed = sequence_window(timed, "user_id", ["_us", order_id], 1, lambda w: [
            F.coalesce((F.col("_us") - F.lag("_us").over(w) >= expire_seconds * 1_000_000).cast("int"), F.lit(1)).alias("_new")])
        runs = prefix_sums(timed, ["_us", order_id], ["_new"], by="user_id").select(order_id, F.col("cum__new").alias("_run"))
        base = base.join(runs, order_id, "left").withColumn("_key", F.concat_ws("|", "user_id", F.coalesce("_run", F.lit(0))))
        key = "_key"
    d = sequence_window(base, key, ["_us", order_id], RESPONSE_HISTORY - 1, mean_rt).join(run, order_id)
    found = F.filter(F.array(
        F.when((F.col("status_code") >= 500) & (F.col("_errors") > ERRORS_PER_HOUR),
               F.struct(F.lit("high_error_rate").alias("type"), F.lit("medium").alias("severity"))),
        F.when((rt > SLOW_SECONDS) & (rt > F.col("_avg_rt") * SLOW_FACTOR),
               F.struct(F.lit("unusual_response_time").alias("type"), F.lit("low").alias("severity"))),
        F.when(F.col("_calls") > CALLS_PER_HOUR,
               F.struct(F.lit("high_api_frequency").alias("type"), F.lit("high").alias("severity")))),
        lambda x: x.isNotNull())
    return (d.select(order_id, "user_id", "ts", F.explode(found).alias("a"))
            .select(order_id, "user_id", "ts", F.col("a.type").alias("anomaly_type"),
                    F.col("a.severity").alias("severity")))


def high_severity_alerts(anoms: DataFrame) -> DataFrame:
    """High-severity anomalies as alert records with a JSON payload."""
    return anoms.where(F.col("severity") == "high").select(
        F.col("user_id").alias("key"),
        F.to_json(F.struct("user_id", "anomaly_type", "severity", F.col("ts").cast("string").alias("ts"))).alias("value"))


def merge_edges(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert pre-aggregated edge deltas into the edge table on (source,
    target): weights and counts add, first / last interaction widen, the
    mean is recomputed (C8, D10, L11).  Use inside ``foreachBatch``."""
    e, b = existing.alias("e"), batch.alias("b")
    j = e.join(b, ["source_id", "target_id"], "full_outer")
    w = (F.coalesce(F.col("e.total_weight").cast("decimal(38,2)"), F.lit(0))
         + F.coalesce(F.col("b.total_weight").cast("decimal(38,2)"), F.lit(0)))
    n = F.coalesce(F.col("e.transaction_count"), F.lit(0)) + F.coalesce(F.col("b.transaction_count"), F.lit(0))
    return j.select("source_id", "target_id", w.cast("double").alias("total_weight"), n.alias("transaction_count"),
                    F.least("e.first_interaction", "b.first_interaction").alias("first_interaction"),
                    F.greatest("e.last_interaction", "b.last_interaction").alias("last_interaction"),
                    (w.cast("double") / n).alias("avg_amount"))


def route(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HIGH (block) decisions to the alert sink, MEDIUM (review) to the
    review queue (I17)."""
    return (decided.where(F.col("action_code") == "BLOCK"), decided.where(F.col("action_code") == "MANUAL_REVIEW"))


def score_stream(bookings: DataFrame, agencies: DataFrame, alerts_path: str, review_path: str,
                 checkpoint: str, trigger_once: bool = True):
    """Score a booking stream micro-batch by micro-batch and route the
    decisions to two parquet sinks (L12, I17).  Each micro-batch runs the
    stateless scorers plus the agency join; ``foreachBatch`` makes the two
    writes part of one idempotent batch id."""
    from ..operators.rules import base_models as bm
    from ..operators.rules import decision as dec
    from ..operators.rules import travel as tr

    def handle(batch: DataFrame, batch_id: int) -> None:
        b = tr.calibrate_in_context(bm.financial_risk(bm.behavioral_risk(batch)))
        b = tr.travel_risk(tr.network_rules(b), agencies)
        d = dec.decide(b).withColumn("batch_id", F.lit(batch_id))
        hi, mid = route(d)
        cols = ["txn_id", "agency_id", "amount", "overall_risk", "action_code", "batch_id"]
        hi.select(*cols).write.mode("append").parquet(alerts_path)
        mid.select(*cols).write.mode("append").parquet(review_path)

    w = bookings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
