"""Account-level aggregates and their joins (D1-D6, C1, C4, D22, J20 part).

Per-key statistics are computed with ``groupBy`` (partial aggregation
map-side, so a hub account never lands whole in one task) and attached
back with a join; AQE's skew-join split handles a hot key on the large
side.  Windows over a whole account are avoided for that reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_round, money_avg, money_sum
from .ordered import prefix_sums


def edge_aggregate(txns: DataFrame, src: str = "cust_id", dst: str = "dest_id",
                   amount: str = "amount", by: list[str] | None = None) -> DataFrame:
    """sum and count of amount per (src, dst)."""
    keys = (by or []) + [src, dst]
    return txns.groupBy(*keys).agg(money_sum(F.col(amount)).alias("weight"), F.count(F.lit(1)).alias("count"))


def account_stats(txns: DataFrame, key: str, prefix: str, amount: str = "amount") -> DataFrame:
    """count, sum, mean, sample std (null -> 0), min, max and exact median
    of ``amount`` per ``key`` (D2)."""
    a = F.col(amount)
    return txns.groupBy(key).agg(
        F.count(a).alias(f"{prefix}_count"),
        money_sum(a).alias(f"{prefix}_sum"),
        money_avg(a).alias(f"{prefix}_mean"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias(f"{prefix}_std"),
        F.min(a).alias(f"{prefix}_min"),
        F.max(a).alias(f"{prefix}_max"),
        F.median(a).alias(f"{prefix}_median"),
    )


def attach_account_stats(txns: DataFrame, amount: str = "amount") -> DataFrame:
    """Both role statistics joined onto each transaction."""
    cust = account_stats(txns, "cust_id", "cust", amount)
    dest = account_stats(txns, "dest_id", "dest", amount)
    return txns.join(cust, "cust_id", "left").join(dest, "dest_id", "left")


def transaction_features(txns: DataFrame, amount: str = "amount") -> DataFrame:
    """The account / amount features of the graph model's training frame
    (amount transforms, role stats, z-scores, velocities, ratios and the
    label-encoded dataset) (J20, first 26 columns)."""
    a = F.col(amount)
    df = attach_account_stats(txns, amount)
    df = df.select(
        "*",
        F.log1p(a).alias("amount_log"),
        F.sqrt(a).alias("amount_sqrt"),
        (1.0 / (a + 1)).alias("amount_reciprocal"),
        (is_round(a, 10) | is_round(a, 100) | is_round(a, 1000)).cast("int").alias("is_round_amount"),
        ((a - F.col("cust_mean")) / (F.col("cust_std") + 1e-6)).alias("amount_zscore_cust"),
        ((a - F.col("dest_mean")) / (F.col("dest_std") + 1e-6)).alias("amount_zscore_dest"),
        (F.col("cust_sum") / F.col("cust_count")).alias("cust_velocity"),
        (F.col("dest_sum") / F.col("dest_count")).alias("dest_velocity"),
        (a / (F.col("cust_max") + 1)).alias("amount_vs_cust_max_ratio"),
        (a / (F.col("dest_max") + 1)).alias("amount_vs_dest_max_ratio"),
    )
    return label_encode(df, "dataset", "dataset_encoded") if "dataset" in df.columns else \
        df.withColumn("dataset_encoded", F.lit(0))


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Sorted distinct values -> 0..k-1, null stays null (B16a).  Ranks are
    running counts over range partitions of the levels."""
    levels = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranks = prefix_sums(levels, [col], ["_one"]).select(col, (F.col("cum__one") - 1).cast("int").alias(out))
    return df.join(ranks, col, "left")


def frequency(df: DataFrame, key: str, out: str) -> DataFrame:
    """value_counts + map: rows per key attached to each row (C4)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, key, "left")


def location_popularity(df: DataFrame, key: str = "location", out: str = "location_popularity") -> DataFrame:
    """count(key) / N."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (df.join(counts, key, "left").crossJoin(F.broadcast(total))
            .withColumn(out, F.col("_n") / F.col("_total")).drop("_n", "_total"))


def switching_rate(txns: DataFrame, cust: str = "cust_id", dest: str = "dest_id") -> DataFrame:
    """Distinct destinations / transactions per customer and the
    consistency 1 / (1 + rate) (D6)."""
    g = txns.groupBy(cust).agg(F.countDistinct(dest).alias("_d"), F.count(F.lit(1)).alias("_n"))
    rate = F.col("_d").cast("double") / F.col("_n")
    return g.select(cust, rate.alias("device_switching_rate"), (1.0 / (1.0 + rate)).alias("device_consistency"))


def session_switching(txns: DataFrame, cust: str = "cust_id", dest: str = "dest_id") -> DataFrame:
    """Distinct (customer, destination) sessions / transactions per customer;
    a customer with one transaction has rate 0 and consistency 1 (D6, second
    variant).  A null destination is no session."""
    g = txns.groupBy(cust).agg(F.countDistinct(dest).alias("_d"), F.count(F.lit(1)).alias("_n"))
    rate = F.when(F.col("_n") > 1, F.col("_d") / F.col("_n")).otherwise(F.lit(0.0))
    return g.select(cust, rate.alias("device_switching_rate"), (1.0 / (1.0 + rate)).alias("device_consistency"))
