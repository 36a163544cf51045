"""Sequence fixtures (FIXTURES.md 2.7) and split-window equivalence."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerhawk.operators import sequences as sq
from ledgerhawk.operators.ordered import sequence_window, time_window
from ledgerhawk.operators.quantiles import exact_quantiles


def netlog(spark, steps):
    rows = [(i, "1.1.1.1", "d", "u", "x", s) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, ["event_id", "ip_address", "device_id", "user_id", "dest_id", "step"])


def test_gap_variants(spark):
    a = sq.ip_sequence_features(netlog(spark, [0, 1, 3, 6]), "A", mode="plain").orderBy("step").collect()
    assert [r["ip_tx_gap"] for r in a] == [1e9, 1, 2, 3]
    assert [r["rapid_fire_ip"] for r in a] == [0, 1, 1, 0]
    assert [r["ip_burst_5"] for r in a] == [0, 1, 2, 2]
    b = sq.ip_sequence_features(netlog(spark, [0, 1, 3, 6]), "B", mode="plain").orderBy("step").collect()
    assert [r["rapid_fire_ip"] for r in b] == [0, 1, 0, 0]
    assert [r["ip_burst_5"] for r in b] == [0, 0, 0, 0]


def test_regularity_and_burst(spark):
    t = spark.createDataFrame([("c", s, float(s * 100), i) for i, s in enumerate([0, 1, 3, 6])],
                              ["cust_id", "step", "amount", "txn_id"])
    r = sq.account_sequence_features(t, mode="plain").first()
    assert r["transaction_regularity"] == pytest.approx(0.550510, abs=1e-6)
    assert r["burst_pattern"] == pytest.approx(0.75)


def test_split_window_equals_plain(spark):
    # one hot key with 3000 rows plus small keys, over 8 range blocks
    rows = [("hot", i, i % 7) for i in range(3000)] + [(f"k{j}", i, i) for j in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, ["key", "t", "v"])

    def build(w):
        return [F.lag("v").over(w).alias("prev"), F.sum("v").over(w.rowsBetween(-4, 0)).alias("roll"),
                F.count(F.lit(1)).over(w.rowsBetween(-4, 0)).alias("n5")]

    plain = sequence_window(df, "key", ["t"], 4, build, mode="plain")
    split = sequence_window(df, "key", ["t"], 4, build, mode="split", blocks=8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(1).normal(size=5000)]
    df = spark.createDataFrame([(v,) for v in vals], ["x"])
    got = exact_quantiles(df, "x", [0.01, 0.5, 0.999], accuracy=200, final_rows=100)
    assert got == pytest.approx(list(np.quantile(vals, [0.01, 0.5, 0.999])), rel=1e-12)


def test_exact_quantiles_empty_and_single(spark):
    df = spark.createDataFrame([(1.0,)], ["x"])
    assert exact_quantiles(df, "x", [0.5]) == [1.0]
    assert exact_quantiles(df.where("x > 5"), "x", [0.5]) == [None]


def test_time_window_split_equals_plain(spark):
    from ledgerhawk.operators.rules.decision import velocity_6h
    from ledgerhawk.sources import adapters as ad
    b = ad.bookings(spark, "/root/testdata/sf0.01").select("txn_id", "agency_id", "ts", "amount")
    # one hot agency: fold all bookings onto agency 0 as well
    hot = b.unionByName(b.withColumn("agency_id", F.lit(99)).withColumn("txn_id", F.col("txn_id") + 10**7))
    cols = ["txn_id", "recent_count", "recent_sum", "realtime_score"]
    plain = velocity_6h(hot, mode="plain").select(*cols)
    split = velocity_6h(hot, mode="split").select(*cols)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_velocity_6h_makes_no_column_that_nobody_reads(spark):
    from ledgerhawk.operators.rules.decision import velocity_6h
    rows = [(1, 7, 0, 5.0), (2, 7, 3600, 6.0), (3, 7, 3600, 7.0), (4, 8, 10, None), (5, None, 20, 2.0)]
    d = (spark.createDataFrame(rows, "txn_id long, agency_id long, s long, amount double")
         .select("txn_id", "agency_id", F.timestamp_seconds("s").alias("ts"), "amount", F.raise_error(F.concat(F.lit("made "), "txn_id")).alias("unread")))
    got = velocity_6h(d).select("txn_id", "recent_count", "recent_sum").orderBy("txn_id").collect()
    assert [r["recent_sum"] for r in got] == [None, 5.0, 5.0, None, None]
    assert [r["recent_count"] or 0 for r in got] == [0, 1, 1, 0, 0]


def test_velocity_windows_split_equals_plain(spark):
    from ledgerhawk.operators.sequences import velocity_windows
    from ledgerhawk.sources import adapters as ad
    b = ad.bookings(spark, "/root/testdata/sf0.001")
    cols = ["txn_id", "outflow_1h", "txn_count_24h", "inflow_24h", "seconds_since_last", "repeat_destination",
            "amount_percent_rank"]
    plain = velocity_windows(b, mode="plain").select(*cols)
    split = velocity_windows(b, mode="split").select(*cols)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_null_keys_keep_their_rows_and_split_equals_plain(spark):
    rows = [(i, None if i % 3 == 0 else f"u{i % 2}", i * 7 % 50, float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, key string, t long, v double")

    def build(w):
        return [F.lag("v", 2).over(w).alias("before"), F.sum("v").over(w.rowsBetween(-5, 0)).alias("roll")]

    def frame(w):
        return [F.count(F.lit(1)).over(w.rangeBetween(-9, 0)).alias("n")]

    from ledgerhawk.operators.ordered import prefix_sums, time_window
    order = lambda d: sorted(map(str, d.collect()))
    plain = sequence_window(df, "key", ["t", "id"], 5, build, mode="plain")
    assert order(plain) == order(sequence_window(df, "key", ["t", "id"], 5, build, mode="split", blocks=17).select(plain.columns))
    plain = time_window(df, "key", "t", [], 9, frame, mode="plain")
    assert order(plain) == order(time_window(df, "key", "t", [], 9, frame, mode="split", blocks=9).select(plain.columns))
    sums = prefix_sums(df, ["t", "id"], ["t"], by="key").collect()
    assert len(sums) == 240
    for r in sums:
        assert r.cum_t == sum(x.t for x in sums if x.key == r.key and (x.t, x.id) <= (r.t, r.id))


def test_context_grows_with_blocks_not_their_square(spark):
    from ledgerhawk.operators import ordered
    df = spark.range(3200).select(F.lit("hot").alias("key"), F.col("id").alias("t"))
    sizes = []
    for blocks in (8, 32):
        r = ordered._blocked(df, blocks, ["key", "t"])
        bounds = ordered._bounds(r, "key")
        sizes.append((r.select("_blk").distinct().count(), ordered._nearest(bounds, r, 20).count()))
    assert all(pairs <= 2 * blocks for blocks, pairs in sizes)


def test_velocity_windows_keep_rows_with_nulls(spark):
    from ledgerhawk.operators.sequences import velocity_windows
    rows = [(1, "u", "a", "2024-01-01 00:00:00", 5.0, "x"), (2, None, "a", "2024-01-01 00:10:00", 6.0, "x"),
            (3, "u", None, "2024-01-01 00:20:00", None, "x"), (4, "u", "a", "2024-01-01 00:30:00", 5.0, None)]
    df = spark.createDataFrame(rows, "txn_id long, user_id string, agency_id string, ts string, amount double, type string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    got = {r.txn_id: r for r in velocity_windows(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[4].repeat_destination is True and got[1].repeat_destination is False
    assert got[4].txn_count_1h == 3 and got[2].type_frequency == 1.0


def test_ordered_windows_of_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (None, 6)], "key long, t long")
    lag = lambda w: [F.lag("t").over(w).alias("p")]
    count = lambda w: [F.count("t").over(w.rangeBetween(-9, 0)).alias("c")]
    assert sequence_window(df.where("t < 0"), "key", ["t"], 1, lag).count() == 0
    assert time_window(df.where("t < 0"), "key", "t", [], 9, count).count() == 0
    assert sorted(map(str, sequence_window(df, "key", ["t"], 1, lag).collect())) == sorted(
        map(str, sequence_window(df, "key", ["t"], 1, lag, mode="plain").collect()))
    assert sorted(map(str, time_window(df, "key", "t", [], 9, count).collect())) == sorted(
        map(str, time_window(df, "key", "t", [], 9, count, mode="plain").collect()))


def test_trailing_totals_equal_range_frames_without_sliding_over_them(spark):
    """Counts and sums of open and closed frames equal Spark's range frames,
    with equal times, null keys, times and amounts, one busy key and few
    blocks; no plan slides a frame over rows."""
    from pyspark.sql import functions as F
    from ledgerhawk.functions.scalar import money
    from ledgerhawk.operators.ordered import trailing_totals
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 > 0, F.lit("busy")).otherwise(F.concat(F.lit("k"), F.col("id") % 7))).alias("key"),
        F.when(F.col("id") % 41 > 0, (F.col("id") * 7919) % 900).alias("t"),
        F.when(F.col("id") % 13 > 0, ((F.col("id") * 31) % 1000 - 400) / 100).alias("amount"))
    for own in (True, False):
        got = trailing_totals(df, "key", "t", "amount", {"a": 5, "b": 60}, own=own, blocks=9)
        assert "specifiedwindowframe(RangeFrame, -" not in got._jdf.queryExecution().toString()
        cols = []
        for name, span in (("a", 5), ("b", 60)):
            w = Window.partitionBy("key").orderBy("t").rangeBetween(-span + 1, 0 if own else -1)
            cols += [F.count(F.lit(1)).over(w).alias(f"{name}_count"), F.sum(money(F.col("amount"))).over(w).cast("double").alias(f"{name}_sum")]
        want = df.select("*", *cols)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_quantiles_run_the_plan_behind_the_columns_once(spark, monkeypatch):
    """Quantiles of several columns and the clipped rows read one stored table."""
    from ledgerhawk.operators import clean
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    df = spark.range(500).select("id", (F.col("id") * 1e5).alias("x"), F.lit(1.0).alias("y")).mapInPandas(seen, "id long, x double, y double")
    out = clean.winsorize_extreme(df, ["x", "y"]).collect()
    assert len(out) == 500 and max(r["x"] for r in out) < 499e5 and runs.value == 500
    assert len(clean.clean_numeric(df, ["x", "y"]).collect()) == 500 and runs.value == 1000
    assert exact_quantiles(df, "x", [0.5]) == [249.5 * 1e5] and runs.value == 1500
