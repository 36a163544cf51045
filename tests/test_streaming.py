"""Log parsing, events and the routed scoring stream (event-time state: test_timed.py)."""
import os
import tempfile

from ledgerhawk.plans import q_rules as qr
from ledgerhawk.sources import adapters as ad
from ledgerhawk.streaming import logs as lg
from ledgerhawk.streaming import state as st

SF = "/root/testdata/sf0.001"


def test_parse_logs_extracts_user_and_drops_bad(spark):
    raw = spark.createDataFrame([
        ('{"timestamp": "2024-01-01T10:00:00", "url": "/users/u42/profile"}',),
        ('{"timestamp": "2024-01-01T10:00:01", "headers": {"Authorization": "Bearer abc"}}',),
        ('{"timestamp": "2024-01-01T10:00:02", "headers": {"X-Session-User": "s7"}}',),
        ('{"timestamp": "not a time", "user_id": "x"}',), ("{broken",)], ["value"])
    out = [r["user_id"] for r in lg.parse_logs(raw).orderBy("ts").collect()]
    assert out[0] == "u42" and out[1].startswith("user_from_token_") and out[2] == "s7" and len(out) == 3


def test_network_event_booking_without_agency(spark):
    raw = spark.createDataFrame([
        ('{"timestamp": "2024-01-01T10:00:00", "user_id": "u1", "endpoint": "/bookings", "method": "POST"}',),
        ('{"timestamp": "2024-01-01T10:00:00", "user_id": "u1", "endpoint": "/agencies/A9/x", "method": "GET"}',)],
        ["value"])
    ev = lg.network_events(lg.parse_logs(raw)).collect()
    assert [(e["event_type"], e["target_entity"]) for e in ev] == [("agency_interaction", "A9")]


def test_score_stream_routes(spark):
    d = tempfile.mkdtemp(prefix="lh-score-", dir="/tmp")
    b = qr.bookings_with_daily(spark, SF)
    b.write.parquet(os.path.join(d, "in"))
    s = spark.readStream.schema(b.schema).parquet(os.path.join(d, "in"))
    q = st.score_stream(s, ad.agencies(spark, SF), os.path.join(d, "alerts"), os.path.join(d, "review"),
                        os.path.join(d, "ck"))
    q.awaitTermination(120)
    n_alerts = spark.read.parquet(os.path.join(d, "alerts")).count()
    assert n_alerts > 0
