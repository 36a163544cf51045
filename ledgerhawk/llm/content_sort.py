"""Exact duplicates by content sort (operator 3).

Rows are range-partitioned on (first bytes of the normalised text, its digest,
id) by sampled splitters and sorted externally, so equal texts are neighbours
and a huge group spreads over many ranges.  Neighbours are compared in full;
runs that touch a range's border are joined with those of the next range by
their full text.  Splitters hold a few bytes of text, never whole texts.

Of equal texts the row with the largest (or smallest) id stays; among rows
that share that id too, exactly one.  Null text counts as empty, a null id as
smaller than any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

_HEAD = 24
_MARKED = "doc_id long, text_sha256 string, block int, run long, row long, border string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of one sorted range; the range's
    first row, and one more row at its end, carry their text."""
    block = TaskContext.get().partitionId()
    last, run, row = None, 0, 0

    def rows(ids, sha, runs, at, border):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, sha, pa.array(np.full(n, block, np.int32)), pa.array(runs, pa.int64()), pa.array(at, pa.int64()),
             pa.array(border, pa.string())], ["doc_id", "text_sha256", "block", "run", "row", "border"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column("text")
        differs = np.ones(n, np.int64)
        differs[0] = int(last is not None and text[0].as_py() != last)
        if n > 1:
            differs[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        runs = run + np.cumsum(differs)
        border = [text[0].as_py() if last is None else None] + [None] * (n - 1)
        yield rows(batch.column("doc_id"), batch.column("text_sha256"), runs, np.arange(row, row + n), border)
        last, run, row = text[n - 1].as_py(), int(runs[-1]), row + n
    if last is not None:
        yield rows(pa.array([None], pa.int64()), pa.array([None], pa.string()), [run], [-1], [last])


def exact_groups(docs: DataFrame, normalise=None, keep: str = "max") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.
    ``normalise`` maps the text column before comparing."""
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    rows = texts(docs)
    if normalise is not None:
        rows = rows.withColumn("text", normalise(F.col("text")))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    head = F.substring(F.encode("text", "UTF-8"), 1, _HEAD)
    ordered = (rows.repartitionByRange(head, "text_sha256", "doc_id")
               .sortWithinPartitions(head, "text_sha256", "text", "doc_id"))
    marked = stored(ordered.mapInArrow(_neighbours, _MARKED), "sorted")
    members = marked.where("row >= 0")
    best = F.max if keep == "max" else F.min
    pick: Column = F.struct("doc_id", "block", "row")
    runs = members.groupBy("block", "run").agg(best(pick).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # runs at a range's border: equal texts there are one group over several ranges
    edges = marked.where(F.col("border").isNotNull()).select("block", "run", "border").distinct()
    edge_runs = edges.join(runs, ["block", "run"])
    merged = edge_runs.groupBy("border").agg(best("best").alias("_best"), F.sum("group_size").alias("_size"))
    whole = edge_runs.join(merged, "border").select("block", "run", "_best", "_size")
    groups = (runs.join(whole, ["block", "run"], "left")
              .select("block", "run", F.coalesce("_best", "best").alias("best"),
                      F.coalesce("_size", "group_size").alias("group_size")))
    out = members.join(groups, ["block", "run"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                      F.struct("doc_id", "block", "row").eqNullSafe(F.col("best")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` with one row of each text, all columns kept."""
    groups = exact_groups(docs, keep=keep)
    groups = stored(groups.select("doc_id", "text_sha256", "kept"), "groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    own = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_sha") == F.col("_sha")), "left_semi")
    if groups.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["_text_sha"])  # rows equal in id and text
    return out.select(docs.columns)
