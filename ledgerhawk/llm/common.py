"""Helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Where it is
    unset, a local master (tests) gets a folder of its own; a cluster must
    name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors then cost
    no recomputation, a nondeterministic order is fixed once, and the shuffle
    files behind the table go as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text (null: empty) only, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def labelled(docs: DataFrame, known: DataFrame, most: int, salt: int) -> DataFrame:
    """Texts of at most ``most`` labelled rows (doc_id, ...), taken by a hash of
    the id.  Their ids are broadcast (``most`` rows), so no text is shuffled."""
    known = known.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    n = known.count()
    if n > most:
        share = int(1_000_000 * 0.95 * most / n)
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < share)
    return texts(docs).join(F.broadcast(known), "doc_id")


def running_start(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in the order given.
    Rows are dealt into ordered blocks once; a block's own sums are a window,
    block offsets come from a table of one row per block."""
    from pyspark.sql import Window
    rows = stored(rows, "rows")  # sampling for the ranges reads it once more
    blocks = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_block", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "order")
    before = blocks.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = before.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (blocks.withColumn(out, F.sum(value).over(own) - F.col(value))
            .join(F.broadcast(before), "_block")  # one row per block
            .withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_block", "_row", "_before"))
