"""Constraints, versioned look-up, records, mappings."""
import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerhawk.operators import records, versions
from ledgerhawk.operators.constraints import TableRules, conform, violations
from ledgerhawk.sources import mappings as mp
from ledgerhawk.sources.warehouse import WAREHOUSE, samples


def test_sample_rows_hold_all_constraints(spark):
    tables = samples(spark, dt.datetime(2024, 3, 1))
    assert violations(tables, WAREHOUSE).count() == 0
    assert len(WAREHOUSE) == 12 and all(set(r.key) <= {f.name for f in r.schema.fields} for r in WAREHOUSE.values())
    assert tables["transactions"].schema["amount"].dataType.simpleString() == "decimal(12,2)"


def test_every_kind_of_violation(spark):
    rules = {"p": TableRules("id long, name string", ("id",), not_null=("name",)),
             "c": TableRules("id long, p long, a string, b string, n int", ("id",), unique=(("a", "b"),), checks={"positive": "n > 0"}, foreign={("p",): ("p", ("id",))})}
    p = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "id long, name string")
    c = spark.createDataFrame([(1, 1, "a", "b", 1), (2, 9, "a", "b", 0), (2, None, "a", None, None), (3, 1, "a", None, 5)], "id long, p long, a string, b string, n int")
    got = sorted(map(tuple, violations({"p": p, "c": c}, rules).collect()))
    assert got == [("c", "check", "positive", "2"), ("c", "foreign_key", "p", "9"), ("c", "unique", "a,b", "a|b"), ("c", "unique", "id", "2"),
                   ("p", "not_null", "id", ""), ("p", "not_null", "name", "2")]
    assert violations({"p": p.limit(0), "c": c.limit(0)}, rules).count() == 0
    assert conform(p.select("id"), rules["p"]).columns == ["id", "name"]


def as_of(rows, facts):
    out = []
    for i, k, t in rows:
        known = [(ft, v) for fk, ft, v in facts if fk is not None and ft is not None and fk == k and t is not None and ft <= t]
        out.append((i, max(known)[1] if known else None))
    return sorted(out)


def test_last_known_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    keys = ["hot"] * 60 + [f"k{i}" for i in range(20)] + [None]
    rows = [(i, rng.choice(keys), rng.choice([None] + list(range(1000)))) for i in range(3000)]
    facts = [(rng.choice(keys), rng.choice([None] + list(range(1000))), float(i)) for i in range(300)]
    facts += [("hot", 500, 7.0), ("hot", 500, 9999.0)]
    df = spark.createDataFrame(rows, "i long, key string, t long").withColumn("_fact", F.lit(1)).withColumn("_row", F.lit(2))
    known = spark.createDataFrame(facts, "key string, t long, v double")
    want = as_of(rows, facts)
    for blocks in (1, 3, 16):
        got = versions.last_known(df, known, "key", "t", "seen", blocks)
        assert sorted((r.i, r.seen.v if r.seen else None) for r in got.collect()) == want
    few = spark.createDataFrame([("hot", 0, 1.0)], "key string, t long, v double")  # one fact, carried over many blocks
    got = versions.last_known(df, few, "key", "t", "seen", 16)
    assert sorted((r.i, r.seen.v if r.seen else None) for r in got.collect()) == as_of(rows, [("hot", 0, 1.0)])
    assert versions.last_known(df, known.limit(0), "key", "t", "seen").where("seen is not null").count() == 0
    assert versions.last_known(df.limit(0), known, "key", "t", "seen").count() == 0


def test_precedence_supplied_cached_default(spark):
    rows = spark.createDataFrame([(1, "a", 5, 0.5), (2, "a", 5, None), (3, "a", 0, None), (4, "b", 9, None)], "i long, node string, t long, cust_x double")
    snaps = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("a", 6, 60.0)], "node string, valid_from long, x double")
    got = {r.i: (r.cust_x, r.cust_source) for r in versions.looked_up(rows, snaps, "cust", "node", "t", ["x"]).collect()}
    assert got == {1: (0.5, "supplied"), 2: (40.0, "cached"), 3: (0.0, "default"), 4: (0.0, "default")}


def test_score_records(spark):
    df = spark.createDataFrame([("t1", 0.91237, 1.0, None), ("t2", 0.5, 2.0, 3.0), ("t3", None, 1.0, 1.0)], "t string, s double, f1 double, f2 double")
    got = {r.transaction_id: r for r in records.score_record(df, "s", {"transaction_id": "t"}, F.array(F.lit("x")), ["f1", "f2"]).collect()}
    assert set(got) == {"t1", "t2"}
    assert (got["t1"].fraud_probability, got["t1"].fraud_prediction, got["t1"].risk_bucket, got["t1"].feature_values) == (0.9124, 1, "HIGH", {"f1": 1.0})
    assert abs(got["t1"].confidence - 0.82474) < 1e-9 and got["t2"].confidence == 0.6 and got["t2"].fraud_prediction == 0
    threats = records.assess_threats(spark.createDataFrame([("a", 0.8), ("b", 0.6), ("c", 0.4), ("d", 0.2), ("e", 0.1)], "ip_address string, p double"), "p")
    assert [(r.risk_level, r.recommended_action, r.is_threat) for r in threats.orderBy("ip_address").collect()] == [
        ("CRITICAL", "BLOCK_IMMEDIATELY", True), ("HIGH", "RATE_LIMIT", True), ("MEDIUM", "ENHANCED_MONITORING", False),
        ("LOW", "LOG_AND_MONITOR", False), ("MINIMAL", "ALLOW", False)]


def test_mappings_have_defaults_for_missing_columns(spark):
    bare = spark.createDataFrame([(300, None)], "id long, ip_address string")
    r = mp.device_rich_security_features(bare, "id").first()
    assert (r.ip_address, r.total_requests, r.nginx_request_count, r.unique_endpoints, r.unique_sessions, r.label) == ("45.10.10.10", 5, 3, 3, 5, 0)
    s = mp.security_inputs(spark.createDataFrame([(1,)], "txn_id long")).first()
    assert (s.in_amount, s.transaction_hour, s.round_amount_pattern, s.destination_risk, s.in_newbalance) == (1000.0, 4, 1.0, 0.1, 9000.0)
    rows = mp.network_rows(spark.createDataFrame([(7, None, None)], "id long, step long, amount double"), "id", None, None, None, "step", "amount", "1.1").first()
    assert (rows.ip_address, rows.dest_id) == ("0.0.1.1", "d_7")
