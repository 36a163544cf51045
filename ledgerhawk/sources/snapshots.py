"""Table sinks that are written whole and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(features: DataFrame, path: str) -> None:
    """Feature rows as Parquet (A8); the folder is replaced as a whole."""
    features.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if features is None else rows.select(*features)


def write_importance(importance: DataFrame, path: str) -> None:
    """Feature importances as CSV with a header, greatest first, name breaks ties."""
    importance.orderBy(F.col("importance").desc(), "feature").write.mode("overwrite").csv(path, header=True)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="feature string, importance double")


def write_evaluation(detail: DataFrame, path: str, by: str = "auc") -> None:
    """Evaluation as JSON (A10): ``detail`` a row per model, and a summary of one
    row that names the best model (ties: greatest name) with its figures."""
    best = detail.agg(F.count(F.lit(1)).alias("models"), F.max(F.struct(F.col(by).alias("figure"), "model")).alias("best"))
    detail.write.mode("overwrite").json(f"{path}/detail")
    (best.select("models", F.lit(by).alias("measure"), F.col("best.model").alias("best_model"), F.col("best.figure").alias("best_value"))
     .write.mode("overwrite").json(f"{path}/summary"))


def read_evaluation(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(schema).json(f"{path}/detail"),
            spark.read.schema("models long, measure string, best_model string, best_value double").json(f"{path}/summary"))
