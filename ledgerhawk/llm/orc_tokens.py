"""Token ids in ORC files (operator 10).

Documents are sorted by id, encoded, and written as ORC: integer run-length
encoding of the ids, row indexes and a Bloom filter on ``doc_id`` in every
stripe.  Readers take stripes in parallel; a filter on ``doc_id`` skips files,
stripes and row groups by their minima, maxima and Bloom filters.

Null text counts as empty and gives the end id alone; a null id sorts first;
rows that share an id are all kept, in the order of their texts' hashes, which
the files hold beside them (``tie``), so starts follow the files' order; an
empty table gives an empty dataset; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import running_start, texts

SCHEMA = "doc_id long, tie long, ids array<int>"


def encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.kept(tokens.byte_bpe, path)
        for batch in batches:
            column = batch.column("text")
            for at, to in tokens.row_slices(column):
                flat, n = pieces.rows(*tokens.text_bytes(column.slice(at, to - at)))
                offsets = np.append(0, np.cumsum(n + 1))
                values = np.full(offsets[-1], end_id, np.int32)
                own = np.ones(len(values), bool)
                own[offsets[1:] - 1] = False
                values[own] = flat
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                own_rows = [batch.column(c).slice(at, to - at) for c in ("doc_id", "tie")]
                yield pa.RecordBatch.from_arrays([*own_rows, ids], ["doc_id", "tie", "ids"])
    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, stripe_bytes: int = 16 << 20,
              bloom_fpp: float = 0.01) -> None:
    """Write ``docs`` (doc_id, text) as ORC files in ascending order of id."""
    order = ["doc_id", "tie"]
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.mapInArrow(encode_rows(tokenizer, end_id), SCHEMA).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp))
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "none").orc(out))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, tie, ids) of such files; with ``doc_ids`` only those, pruned by the metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "tie", "n_tokens", "ids_crc32"])


def digests(rows: DataFrame) -> DataFrame:
    """Per document: start (ids of all documents before), n_tokens, ids_crc32."""
    narrow = rows.mapInArrow(_digest, "doc_id long, tie long, n_tokens long, ids_crc32 long")
    return running_start(narrow, ["doc_id", "tie", "ids_crc32"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
