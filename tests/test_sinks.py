"""Idempotent sinks: a repeated batch changes nothing, a half batch is written
over, compaction and restarts keep totals."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerhawk.sources import adapters as ad
from ledgerhawk.streaming import sinks

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="lh-sink-", dir="/tmp")


def rows_of(spark, n, at=0):
    return spark.range(at, at + n).select(
        F.concat(F.lit("u"), F.col("id") % 7).alias("user_id"), F.concat(F.lit("a"), F.col("id") % 3).alias("agency_id"),
        (F.col("id") * 0.1).alias("amount"), F.timestamp_seconds(F.col("id") * 86400).alias("booking_date"))


def plain(df, keys):
    return sorted(map(tuple, df.groupBy(*keys).agg(F.count(F.lit(1)), F.sum(F.col("amount").cast("decimal(38,2)"))).collect()))


def test_repeated_and_half_batches(spark):
    sink = sinks.BatchSink(spark, folder())
    assert sink.read() is None
    assert sink.write(rows_of(spark, 10), 0) and not sink.write(rows_of(spark, 10), 0)
    # a batch that stopped before its commit: files, no commit
    rows_of(spark, 99).withColumn("batch_id", F.lit(1)).write.partitionBy("batch_id").mode("append").parquet(f"{sink.folder.path}/data")
    assert sink.read().count() == 10
    assert sink.write(rows_of(spark, 5), 1) and sink.read().count() == 15
    assert sinks.BatchSink(spark, sink.folder.path).committed() == [0, 1]


def test_months_are_folders(spark):
    sink = sinks.monthly_logs(spark, folder())
    sink.write(sinks.with_month(rows_of(spark, 90), "booking_date"), 0)
    sink.write(sinks.with_month(rows_of(spark, 90, 90), "booking_date"), 1)
    months = {r.year_month: r["count"] for r in sink.read().groupBy("year_month").count().collect()}
    assert sum(months.values()) == 180 and months["1970-01"] == 31
    assert "year_month=1970-03" in os.listdir(f"{sink.folder.path}/data")


@pytest.mark.parametrize("compact_at", [None, 2, 4])
def test_warehouse_totals(spark, compact_at):
    path = folder()
    whole = rows_of(spark, 100)
    for batch in range(5):
        tables = sinks.Warehouse(spark, path)  # a restart each time
        part = whole.where((F.col("amount") * 10).cast("int") % 5 == batch)
        if batch == 3:  # the first run stops after the edges
            tables.edges.merge(part.select(F.col("user_id").alias("source_node"), F.col("agency_id").alias("target_node"),
                                           F.lit(sinks.BOOKED).alias("edge_type"), "amount", "booking_date"), batch)
        tables.insert(part, batch)
        if batch == compact_at:
            tables.compact()
        tables.insert(part, batch)
        if batch:
            tables.insert(whole, batch - 1)  # an old id again, whatever it holds
    tables = sinks.Warehouse(spark, path)
    users = sorted((r.user_id, r.total_bookings, r.total_spent) for r in tables.users.read().collect())
    assert users == plain(whole, ["user_id"])
    edges = tables.edge_table().collect()
    assert sorted((r.source_node, r.target_node, r.transaction_count, r.total_weight) for r in edges) == plain(whole, ["user_id", "agency_id"])
    assert all(r.edge_type == sinks.BOOKED and abs(r.avg_amount - float(r.total_weight) / r.transaction_count) < 1e-9 for r in edges)
    last = {r.user_id: r.last_activity for r in tables.users.read().collect()}
    assert last == {r.user_id: r.m for r in whole.groupBy("user_id").agg(F.max("booking_date").alias("m")).collect()}


def test_edge_types_are_edges_of_their_own(spark):
    tables = sinks.Warehouse(spark, folder())
    tables.insert(rows_of(spark, 6).withColumn("edge_type", F.when(F.col("amount") > 0.2, "REFUND").otherwise("TRANSACTION")), 0)
    assert {r.edge_type for r in tables.edge_table().collect()} == {"REFUND", "TRANSACTION"}


def test_warehouse_stream_survives_a_restart(spark):
    path = folder()
    w = ad.warehouse_transactions(spark, SF).select(F.col("user_id"), F.col("agency_id"), "amount", F.col("created_at").alias("booking_date"))
    w.repartition(3).write.parquet(f"{path}/in")
    def stream():
        s = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        sinks.warehouse_stream(s, f"{path}/out", f"{path}/ck", compact_every=2).awaitTermination(180)
    stream()
    w.limit(50).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream()
    # the end of the last batch was never noted: the query runs it again under the same id
    last = max(int(n) for n in os.listdir(f"{path}/ck/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{path}/ck/commits/{name}"):
            os.remove(f"{path}/ck/commits/{name}")
    stream()
    got = sinks.Warehouse(spark, f"{path}/out").users.read()
    whole = spark.read.parquet(f"{path}/in")
    assert sorted((r.user_id, r.total_bookings, r.total_spent) for r in got.collect()) == plain(whole, ["user_id"])


def test_anomaly_documents_and_alerts(spark):
    found = spark.createDataFrame([(1, "u", "high_api_frequency", "high"), (1, "u", "high_error_rate", "medium"), (2, "u", "high_error_rate", "medium")],
                                  "event_id long, user_id string, anomaly_type string, severity string").withColumn("ts", F.lit("2024-01-01 00:00:01").cast("timestamp"))
    docs = {r.event_id: [a.type for a in r.anomalies] for r in sinks.anomaly_documents(found).collect()}
    assert docs == {1: ["high_api_frequency", "high_error_rate"], 2: ["high_error_rate"]}
    alerts = sinks.alert_records(found).collect()
    assert len(alerts) == 1 and alerts[0].key == "u" and '"severity":"HIGH"' in alerts[0].value and '"type":"LOG_ANOMALY"' in alerts[0].value
