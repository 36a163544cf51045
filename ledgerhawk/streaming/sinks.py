"""Idempotent sinks for micro-batches.

Structured Streaming runs a micro-batch again, under the same batch id, when a
query restarts before the batch's end was noted.  Every sink here is therefore
a folder of batches, and a batch counts from the moment its commit file exists:

    <path>/data/[<layout column>=...]/batch_id=<id>/*.parquet
    <path>/commits/<id>

``BatchSink`` keeps rows.  A batch that ran half is written over, a committed
one is left alone, and readers see committed batches only.

``MergedTable`` keeps one row per key whose measures add up, widen or follow
the latest row (an upsert).  A batch writes its pre-aggregated delta, never the
whole table; ``read`` merges base and deltas, and ``compact`` folds them into a
new base under its own commit.  The cost of a batch grows with the batch.

Commit files are made by the driver after the batch's job ended, so a lost
executor costs tasks, never rows.  Several streams may not share one folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder on any storage that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._root if not name else self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def touch(self, name: str) -> None:
        self._fs.create(self._at(name), True).close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def numbers(self, name: str) -> list[int]:
        return sorted(int(n) for n in self.names(name) if n.isdigit())


class BatchSink:
    """Rows of micro-batches, each batch once.  ``layout`` columns become
    folders above the batch (``year_month`` for monthly logs)."""

    def __init__(self, spark: SparkSession, path: str, layout: list[str] | None = None):
        self.folder, self.layout = Folder(spark, path), layout or []

    def committed(self) -> list[int]:
        return self.folder.numbers("commits")

    def write(self, rows: DataFrame, batch_id: int) -> bool:
        """Keep ``rows`` as batch ``batch_id``; false if it was kept before."""
        if batch_id in self.committed():
            return False
        by = [*self.layout, "batch_id"]
        (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.partitionBy(*by).mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder.path}/data"))
        self.folder.touch(f"commits/{batch_id}")
        return True

    def read(self) -> DataFrame | None:
        """Rows of all committed batches; none if there are none."""
        done = self.committed()
        if not done or not self.folder.names("data"):
            return None
        rows = self.folder.spark.read.parquet(f"{self.folder.path}/data")
        begun = {r.batch_id for r in rows.select("batch_id").distinct().collect()}  # one row per batch folder
        half = sorted(begun - set(done))
        return rows.where(~F.col("batch_id").isin(half)) if half else rows


@dataclass(frozen=True)
class Measures:
    """How rows of one key merge: ``adds`` (long counts), ``money`` (exact
    decimal sums), ``least``, ``greatest``; each a name and the SQL expression of
    a row's share."""

    adds: dict[str, str] = field(default_factory=dict)
    money: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    greatest: dict[str, str] = field(default_factory=dict)

    def _aggs(self, of) -> list[Column]:
        return ([F.sum(F.expr(of(n, c)).cast("long")).alias(n) for n, c in self.adds.items()]
                + [F.sum(F.expr(of(n, c)).cast("decimal(38,2)")).cast("decimal(38,2)").alias(n) for n, c in self.money.items()]
                + [F.min(F.expr(of(n, c))).alias(n) for n, c in self.least.items()]
                + [F.max(F.expr(of(n, c))).alias(n) for n, c in self.greatest.items()])

    def of_rows(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*self._aggs(lambda name, source: source))

    def of_parts(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        return parts.groupBy(*keys).agg(*self._aggs(lambda name, source: name))


class MergedTable:
    """A keyed table that micro-batches are merged into, each batch once."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], measures: Measures):
        self.folder, self.keys, self.measures = Folder(spark, path), keys, measures
        self.deltas = BatchSink(spark, f"{path}/deltas")

    def _bases(self) -> list[int]:
        return self.folder.numbers("base-commits")

    def upto(self) -> int:
        """The last batch of the base, -1 without one."""
        return max(self._bases(), default=-1)

    def merge(self, rows: DataFrame, batch_id: int) -> bool:
        """Add the rows of one batch; false if they were added before."""
        return batch_id > self.upto() and self.deltas.write(self.measures.of_rows(rows, self.keys), batch_id)

    def _parts(self) -> DataFrame | None:
        base = self.upto()
        deltas = self.deltas.read()
        if deltas is not None:
            deltas = deltas.where(F.col("batch_id") > base).drop("batch_id")
        if base < 0:
            return deltas
        old = self.folder.spark.read.parquet(f"{self.folder.path}/base/{base}")
        return old if deltas is None else old.unionByName(deltas)

    def read(self) -> DataFrame | None:
        """One row per key; none before the first batch."""
        parts = self._parts()
        return None if parts is None else self.measures.of_parts(parts, self.keys)

    def compact(self) -> None:
        """Fold the committed deltas into a new base and drop what it replaces.
        The base's commit comes first, so a run that stops between the steps
        leaves files that nothing reads."""
        done, old = self.deltas.committed(), self.upto()
        if not done or done[-1] <= old:
            return
        last = done[-1]
        self.read().write.mode("overwrite").parquet(f"{self.folder.path}/base/{last}")
        self.folder.touch(f"base-commits/{last}")
        if old >= 0:
            self.folder.remove(f"base-commits/{old}")
            self.folder.remove(f"base/{old}")
        for batch in done:
            self.deltas.folder.remove(f"data/batch_id={batch}")
            self.deltas.folder.remove(f"commits/{batch}")


# --- what the reference keeps of a stream ---------------------------------------

#: Edge type of user -> agency transactions.
BOOKED = "TRANSACTION"

EDGES = Measures(adds={"transaction_count": "1"}, money={"total_weight": "amount"},
                 least={"first_interaction": "booking_date"}, greatest={"last_interaction": "booking_date"})
USERS = Measures(adds={"total_bookings": "1"}, money={"total_spent": "amount"}, greatest={"last_activity": "booking_date"})
AGENCIES = Measures(adds={"total_transactions": "1"}, money={"total_volume": "amount"})


class Warehouse:
    """Totals that every inserted transaction moves (L11): edges by source,
    target and type, users, agencies."""

    def __init__(self, spark: SparkSession, path: str):
        table = lambda name, keys, how: MergedTable(spark, f"{path}/{name}", keys, how)
        self.edges = table("edges", ["source_node", "target_node", "edge_type"], EDGES)
        self.users = table("users", ["user_id"], USERS)
        self.agencies = table("agencies", ["agency_id"], AGENCIES)

    def insert(self, transactions: DataFrame, batch_id: int) -> None:
        """Transactions (user_id, agency_id, amount, booking_date[, edge_type])
        of one micro-batch.  A repeated batch id changes nothing, also when the
        first run stopped between the tables."""
        kind = F.col("edge_type") if "edge_type" in transactions.columns else F.lit(BOOKED)
        edges = transactions.select(F.col("user_id").alias("source_node"), F.col("agency_id").alias("target_node"),
                                    kind.alias("edge_type"), "amount", "booking_date")
        self.edges.merge(edges, batch_id)
        self.users.merge(transactions, batch_id)
        self.agencies.merge(transactions, batch_id)

    def compact(self) -> None:
        for table in (self.edges, self.users, self.agencies):
            table.compact()

    def edge_table(self) -> DataFrame | None:
        rows = self.edges.read()
        return None if rows is None else rows.withColumn(
            "avg_amount", F.col("total_weight").cast("double") / F.col("transaction_count"))


def warehouse_stream(transactions: DataFrame, path: str, checkpoint: str, compact_every: int = 50):
    """Merge a stream of transactions into the warehouse totals."""
    tables = Warehouse(transactions.sparkSession, path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        tables.insert(batch, batch_id)
        batch.unpersist()
        if batch_id % compact_every == compact_every - 1:
            tables.compact()

    return transactions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_logs(spark: SparkSession, path: str) -> BatchSink:
    """The log store, one folder per month."""
    return BatchSink(spark, path, ["year_month"])


def with_month(logs: DataFrame, ts: str = "ts") -> DataFrame:
    return logs.withColumn("year_month", F.date_format(ts, "yyyy-MM"))


def log_stream(logs: DataFrame, path: str, checkpoint: str):
    """Parsed log rows into the monthly store."""
    sink = monthly_logs(logs.sparkSession, path)
    return (logs.writeStream.foreachBatch(lambda batch, i: sink.write(with_month(batch), i))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def anomaly_documents(found: DataFrame) -> DataFrame:
    """Anomaly rows as documents of the anomaly store (A7): one per log row,
    its anomalies as an array in the order type."""
    one = F.struct(F.col("anomaly_type").alias("type"), "severity")
    return found.groupBy("event_id", "user_id", "ts").agg(F.sort_array(F.collect_list(one)).alias("anomalies"))


def alert_records(found: DataFrame, ts: str = "ts") -> DataFrame:
    """High-severity anomalies of a log row as one alert message (A5): key is
    the user, value the JSON record."""
    high = found.where(F.col("severity") == "high")
    one = F.struct(F.col("anomaly_type").alias("type"), "severity")
    alerts = high.groupBy("event_id", "user_id", ts).agg(F.sort_array(F.collect_list(one)).alias("anomalies"))
    body = F.struct(F.lit("LOG_ANOMALY").alias("type"), "user_id", "anomalies",
                    F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("HIGH").alias("severity"))
    return alerts.select("event_id", F.col("user_id").alias("key"), F.to_json(body).alias("value"))
