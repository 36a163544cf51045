"""Scored-transaction records and threat assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence
from .rules.decision import model_band, threat_band

MODEL_VERSION = "v1.0"


def score_record(df: DataFrame, score: str, ids: dict[str, str], factors: Column, features: list[str],
                 version: str = MODEL_VERSION) -> DataFrame:
    """One ``risk_scores`` row per scored transaction: ids, probability rounded
    to four places, prediction at .5, bucket, confidence, factors, the feature
    values as a map, model version.  A null score has no record."""
    p = F.col(score).cast("double")
    # pairs without a value leave the map
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value")) for f in features]), lambda e: e["value"].isNotNull())
    return df.where(p.isNotNull()).select(
        *[F.col(c).cast("string").alias(n) for n, c in ids.items()], F.round(p, 4).alias("fraud_probability"),
        (p > 0.5).cast("int").alias("fraud_prediction"), model_band(p).alias("risk_bucket"), confidence(p).alias("confidence"),
        factors.alias("risk_factors"), F.map_from_entries(pairs).alias("feature_values"), F.lit(version).alias("model_version"))


def assess_threats(df: DataFrame, probability: str, ip: str = "ip_address") -> DataFrame:
    """Threat probability, whether it is one (> .5), level and recommended
    action per address (K10, I20)."""
    p = F.col(probability)
    level, action, is_threat = threat_band(p)
    return df.select(F.col(ip).alias("ip_address"), p.alias("threat_probability"), is_threat.alias("is_threat"),
                     level.alias("risk_level"), action.alias("recommended_action"))
