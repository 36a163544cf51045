"""Readers for the parquet tables of a scale-factor folder.

Every reader selects only the columns a caller asks for, so the scan's
``ReadSchema`` stays narrow and Catalyst can push filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_source(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A parquet source, falling back to the CSV next to it (same stem,
    header row) when the parquet is absent (A2); None when neither exists."""
    if _exists(spark, path):
        r = spark.read
        return (r.schema(schema) if schema is not None else r).parquet(path)
    csv = path[: -len(".parquet")] + ".csv" if path.endswith(".parquet") else path + ".csv"
    if _exists(spark, csv):
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(csv)
    return None


def load_transactions(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Read the named sources that exist, unify each and union them (A1, B1,
    B2).  Each entry: path, name, cust, dest, amount, label (optional).
    Raises when none exists."""
    from ..operators.clean import union_sources, unify
    frames = []
    for s in sources:
        df = read_source(spark, s["path"], s.get("schema"))
        if df is not None:
            frames.append(unify(df, s["name"], s["cust"], s["dest"], s["amount"], s.get("label")))
    if not frames:
        raise ValueError("no transaction source found")
    return union_sources(frames)


def land_csv(spark: SparkSession, csv_path: str, out_path: str, schema=None) -> DataFrame:
    """CSV -> parquet landing with the schema written as JSON text beside
    it (A3)."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(csv_path)
    df.write.mode("overwrite").parquet(out_path)
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(
        out_path.rstrip("/") + "_schema")
    return spark.read.parquet(out_path)
