"""Event-time state: order of arrival, expiry, late rows, live degrees."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerhawk.operators.credit import credit_decisions
from ledgerhawk.plans import q_rules as qr
from ledgerhawk.sources import adapters as ad
from ledgerhawk.streaming import state as st
from ledgerhawk.streaming import timed

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def replay(spark, files, fn, name, mode="append"):
    """Each frame of ``files`` is one file, read one a batch."""
    d = tempfile.mkdtemp(prefix="lh-timed-", dir="/tmp")
    for i, df in enumerate(files):
        df.coalesce(1).write.parquet(f"{d}/part{i}")
        os.makedirs(f"{d}/in", exist_ok=True)
        for f in os.listdir(f"{d}/part{i}"):
            if f.endswith(".parquet"):
                os.rename(f"{d}/part{i}/{f}", f"{d}/in/{i:03d}-{f}")
                os.utime(f"{d}/in/{i:03d}-{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = fn(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{d}/ck").start()
    q.processAllAvailable()
    progress = list(q.recentProgress)
    q.stop()
    return spark.table(name), progress


def in_parts(df, n, order):
    """n files, by time, with rows out of order and spilling into the next file."""
    bounds = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10000).alias("b")).first().b
    shifted = F.col(order) + F.when(F.xxhash64(order) % 5 == 0, F.lit(1)).otherwise(F.lit(0)) * (bounds[-1] - bounds[0]) / n
    part = F.lit(0)
    for b in bounds:
        part = part + (shifted > b).cast("int")
    d = df.withColumn("_part", part)
    return [d.where(F.col("_part") == i).drop("_part").orderBy(F.xxhash64(order)) for i in range(n)]


def test_anomaly_stream_equals_batch_out_of_order(spark):
    logs = ad.applogs(spark, SF).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "status_code", "response_time")
    logs = logs.withColumn("us", F.unix_micros("ts"))
    batch = st.anomalies(logs.drop("us"), expire_seconds=3600)
    span = logs.agg(F.max("us") - F.min("us")).first()[0] // 1_000_000
    last = logs.agg(F.max("ts")).first()[0]
    end = spark.createDataFrame([(10**9, "zz", last, 200, 0.0)], "event_id long, user_id string, ts timestamp, status_code int, response_time double")
    end = end.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {span + 10 * 86400} SECONDS"))
    files = [f.drop("us") for f in in_parts(logs, 4, "us")]
    files = [f.select("event_id", "user_id", "ts", F.col("status_code").cast("int").alias("status_code"), F.col("response_time").cast("double").alias("response_time")) for f in files]
    got, progress = replay(spark, [*files, end], lambda s: timed.anomaly_stream(s, f"{span} seconds"), "anom_timed")
    key = ["event_id", "anomaly_type", "severity"]
    want = sorted(map(tuple, batch.select(*key).collect()))
    assert sorted(map(tuple, got.where("kind = 'anomaly'").select(*key).collect())) == want and want
    assert got.where("kind = 'late'").count() == 0
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(held) >= 10 and held[-1] <= 1  # state goes when it has expired; the last file's own row stays


def test_late_rows_leave_by_the_side(spark):
    rows = lambda *r: spark.createDataFrame(r, "event_id long, user_id string, at string, status_code int, response_time double").select(
        "event_id", "user_id", F.col("at").cast("timestamp").alias("ts"), "status_code", "response_time")
    files = [rows((1, "u", "2024-01-01 10:00:00", 200, 1.0)), rows((2, "u", "2024-01-01 12:00:00", 200, 1.0)),
             rows((3, "u", "2024-01-01 10:30:00", 500, 9.0)), rows((4, "u", "2024-01-02 10:00:00", 200, 1.0))]
    got, _ = replay(spark, files, lambda s: timed.anomaly_stream(s, "10 minutes"), "anom_late")
    assert [(r.kind, r.event_id) for r in got.collect()] == [("late", 3)]


def test_response_times_expire(spark):
    rows = [(i, "u", f"2024-01-01 {h:02d}:{m:02d}:00", 200, rt) for i, (h, m, rt) in enumerate(
        [(0, 0, 1.0), (0, 10, 1.0), (0, 20, 9.0), (1, 30, 9.0), (1, 40, 1.0), (1, 50, 1.0), (2, 10, 9.0), (3, 10, 1.0), (3, 11, 6.0)])]
    logs = spark.createDataFrame(rows, "event_id long, user_id string, at string, status_code int, response_time double").select(
        "event_id", "user_id", F.col("at").cast("timestamp").alias("ts"), "status_code", "response_time")
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(st.anomalies(logs, expire_seconds=3600)) == []
    rows = [(i, "u", f"2024-01-01 {h:02d}:{m:02d}:00", 200, rt) for i, (h, m, rt) in enumerate(
        [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 20.0), (1, 30, 20.0), (1, 40, 1.0)])]
    logs = spark.createDataFrame(rows, "event_id long, user_id string, at string, status_code int, response_time double").select(
        "event_id", "user_id", F.col("at").cast("timestamp").alias("ts"), "status_code", "response_time")
    assert ids(st.anomalies(logs, expire_seconds=3600)) == [4]  # at 01:30 the hour before is forgotten: the mean is its own


def test_credit_stream_equals_batch_out_of_order_with_seeds(spark):
    d = qr.decision_frame(spark, SF).select("agency_id", "txn_id", "overall_risk", "amount", F.col("ts").cast("timestamp").alias("ts"))
    d = d.withColumn("us", F.unix_micros("ts"))
    a = ad.agencies(spark, SF)
    seeds = spark.createDataFrame([(3, 50000.0, 0.85, 45000.0), (4, 1000.0, 0.2, 0.0)], "agency_id long, current_limit double, trust_score double, utilized_credit double")
    batch = credit_decisions(d.drop("us"), a, seeds)
    span = d.agg(F.max("us") - F.min("us")).first()[0] // 1_000_000
    last = d.agg(F.max("ts")).first()[0]
    end = spark.createDataFrame([(99, 10**9, 0.1, 1.0, last)], "agency_id long, txn_id long, overall_risk double, amount double, ts timestamp")
    end = end.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {2 * span + 86400} SECONDS"))
    cols = ["agency_id", "txn_id", "overall_risk", "amount", "ts"]
    files = [f.select(F.col("agency_id").cast("long").alias("agency_id"), F.col("txn_id").cast("long").alias("txn_id"), "overall_risk", "amount", "ts") for f in in_parts(d, 3, "us")]
    bad = spark.createDataFrame([(None, 1, 0.5, 1.0, last), (5, None, 0.5, 1.0, last)], "agency_id long, txn_id long, overall_risk double, amount double, ts timestamp")
    files[1] = files[1].select(*cols).unionByName(bad)
    got, _ = replay(spark, [*files, end.select(*cols)], lambda s: timed.credit_stream(s, a, seeds, f"{span} seconds"), "credit_timed")
    out = ["agency_id", "txn_id", "action", "new_limit", "utilized_credit", "trust_score", "status"]
    want = sorted(map(tuple, batch.select(*out).collect()))
    assert sorted(map(tuple, got.where("kind = 'decision'").select(*out).collect())) == want and len(want) > 100


def test_live_degrees_equal_the_graph(spark):
    events = ad.graph_transactions(spark, SF).select(F.col("cust_id").alias("source_user"), F.col("dest_id").alias("target_entity"))
    files = [events.where(F.xxhash64("source_user", "target_entity") % 3 == i) for i in range(-2, 3)]
    got, _ = replay(spark, files, timed.live_degrees, "degrees_live", "complete")
    from ledgerhawk.operators.graph import build, local
    want = {r.node: r.degree for r in local.degree_centrality(build.build_graph(ad.graph_transactions(spark, SF))).collect()}
    assert {r.node: r.degree for r in got.collect()} == want


def test_retention_in_table_and_stream(spark):
    rows = [("a", f"2024-01-{d:02d} 00:00:00", float(d)) for d in range(1, 11)] + [("b", "2024-01-01 00:00:00", 5.0), ("b", None, 7.0)]
    df = spark.createDataFrame(rows, "who string, at string, amount double").select("who", F.col("at").cast("timestamp").alias("ts"), "amount")
    keep = timed.Retention("ts", 72)
    alive = {r.who: (r.n, r.s) for r in keep.of_table(df).groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s")).collect()}
    assert alive == {"a": (3, 27.0)}
    files = [df.where(F.dayofmonth("ts") <= 3), df.where("dayofmonth(ts) between 4 and 7"), df.where("dayofmonth(ts) > 7 or ts is null")]
    got, _ = replay(spark, files, lambda s: timed.live_history(s, "who", "amount", keep), "history_live", "update")
    last = {}
    for r in got.collect():
        last[r.key] = (r.alive, r.amount)
    assert {k: v for k, v in last.items() if v[0]} == alive
