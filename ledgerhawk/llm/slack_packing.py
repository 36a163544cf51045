"""Best-fit packing by minimum bin slack (operator 2).

Pieces of at most ``capacity`` tokens are known by their length alone, so the
plan is made on the table of lengths (at most ``capacity`` rows, whatever the
corpus): the longest length left opens a sequence, bitset subset-sum dynamic
programming over the lengths left finds the fullest combination with it, and
that combination is taken as often as the counts allow.  Spark ranks the
pieces of each length (per block, plus block offsets, so one frequent length
spreads over all tasks) and a rank picks sequence and offset from the plan.

Null text counts as empty: the end id alone.  Rows that share an id are packed
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import stored, texts

CAPACITY = 1024
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def fullest(counts: dict[int, int], first: int, room: int) -> dict[int, int]:
    """The lengths (with their numbers) that fill ``room`` best beside one of
    ``first``; longer lengths are preferred among equally full sets."""
    left = dict(counts)
    left[first] -= 1
    lengths = sorted((l for l, c in left.items() if c and l <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for l in lengths:
        todo, part = min(left[l], room // l), 1
        while todo:  # binary parts: every number from 0 to the count
            take = min(part, todo)
            steps.append((l, take, reach))
            reach |= (reach << (l * take)) & full
            todo, part = todo - take, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen = {first: 1}
    for l, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[l] = chosen.get(l, 0) + take
            at -= l * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence, per_sequence, offset): the
    piece of that length and rank r lies in sequence + (r - rank_from) //
    per_sequence, at offset + length * ((r - rank_from) % per_sequence)."""
    left = {l: c for l, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        first = max(left)
        chosen = fullest(left, first, capacity - first)
        times = min(left[l] // m for l, m in chosen.items())
        offset = 0
        for l in sorted(chosen, reverse=True):
            m = chosen[l]
            rows.append((l, used[l], used[l] + m * times, sequence, m, offset))
            offset += l * m
            used[l] += m * times
            left[l] -= m * times
            if not left[l]:
                del left[l]
        sequence += times
    return rows


def cut_rows(path: str, capacity: int, end_id: int, with_ids: bool):
    """Encode documents and cut those over ``capacity``; the first piece takes the remainder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.kept(tokens.byte_bpe, path)
        for batch in batches:
            column = batch.column("text")
            for at, to in tokens.row_slices(column):
                flat, n = pieces.rows(*tokens.text_bytes(column.slice(at, to - at)))
                begin = np.cumsum(n) - n
                docs = batch.column("doc_id").slice(at, to - at).to_pylist()
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, b, k in zip(docs, begin.tolist(), n.tolist()):
                    ids = np.append(flat[b:b + k], np.uint32(end_id)).astype("<u4")
                    total, start, piece = k + 1, 0, 0
                    length = total % capacity or capacity
                    while start < total:
                        part = ids[start:start + length]
                        rows["doc_id"].append(doc)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(length)
                        rows["ids_crc32"].append(zlib.crc32(part))
                        rows["ids"].append(part.astype(np.int32) if with_ids else None)
                        start, piece, length = start + length, piece + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
                     pa.array(rows["length"], pa.int64()), pa.array(rows["ids_crc32"], pa.int64()),
                     pa.array(rows["ids"], pa.list_(pa.int32()))], list(rows))
    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``items`` (with a column ``length`` of 1 to ``capacity``)
    its sequence_id and offset."""
    spark = items.sparkSession
    items = stored(items.withColumn("_block", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    by_block = items.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    rows = plan(counts, capacity)
    where = spark.createDataFrame(rows, "length long, _from long, _to long, _sequence long, _per long, _offset long")
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row")) - 1
    ranked = items.withColumn("_rank", rank).join(base, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # the plan has a few rows per length: bounded by the capacity, not by the corpus
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to"))).drop(where["length"])
    step = F.col("_rank") - F.col("_from")
    return (placed.withColumn("sequence_id", (F.col("_sequence") + F.floor(step / F.col("_per"))).cast("long"))
            .withColumn("offset", (F.col("_offset") + F.col("length") * (step % F.col("_per"))).cast("long"))
            .drop("_block", "_row", "_rank", "_base", "_from", "_to", "_sequence", "_per", "_offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2,
                   with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids, if asked for)."""
    pieces = texts(docs).mapInArrow(cut_rows(tokenizer, capacity, end_id, with_ids), _PIECES)
    out = pack(pieces if with_ids else pieces.drop("ids"), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (of ``pack_documents(..., with_ids=True)``):
    sequence_id, doc_ids and ids in order.  A sequence has at most ``capacity`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")))
