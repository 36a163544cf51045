"""SentencePiece encoding and decoding by a distinct-chunk table (operator 7).

Tokens of the model never cross a word marker (checked when it is loaded), so
a text is a sequence of marked words and each distinct word needs segmenting
once.  Spark counts the marked words of the whole corpus, the model segments
each word of the table once, and tasks join ids back by position: a word's
hash finds its ids, and rows take the ids of their words in order.

The table is broadcast, so its size is bounded: the ``table_size`` words that
occur most.  A word beyond it is segmented by the task that meets it, with the
same model, so ids never depend on the table.

Null text counts as empty and has the end id alone.  Repeated rows are encoded
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import texts

TABLE_SIZE = 400_000


def _marked(column: pa.Array) -> pa.Array:
    """Texts with the blank that stands for the first word's marker; empty ones stay empty."""
    column = pc.fill_null(column, "")
    return pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))


def _count(path: str):
    """Marked words that a slice of text repeats, with their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.kept(tokens.marked_words, path)
        for batch in batches:
            column = _marked(batch.column("text"))
            for at, to in tokens.row_slices(column):
                data, offsets = tokens.text_bytes(column.slice(at, to - at))
                starts, _ = pieces.split(data, offsets)
                if not len(starts):
                    continue
                lengths = np.diff(np.append(starts, len(data)))
                _, first, count = np.unique(tokens.span_hash(data, starts, lengths), return_index=True, return_counts=True)
                often = (count > 1) & (lengths[first] <= 64)
                raw = data.tobytes()
                words = [raw[starts[i]:starts[i] + lengths[i]] for i in first[often].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(count[often].astype(np.int64))], ["word", "n"])
    return run


def _segment(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.kept(tokens.marked_words, path)
        for batch in batches:
            words = [w.as_py() for w in batch.column("word")]
            if words:
                flat, count, _ = pieces.encode(words)
                lengths = np.array([len(w) for w in words], np.int64)
                hashes = tokens.span_hash(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), ids], ["word_hash", "ids"])
    return run


def chunk_table(docs: DataFrame, model: str, table_size: int = TABLE_SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``table_size`` words that occur most: (hashes ascending, flat ids, ids per word)."""
    words = texts(docs).select("text").mapInArrow(_count(model), "word binary, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).persist()
    sizes = words.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    least, total = None, 0  # at most some hundred levels
    for r in sizes:
        total += r["n"]
        if total > table_size:
            break
        least = r["level"]
    chosen = words.where(F.floor(F.log2("n") * 4) >= least) if least is not None else words.limit(0)
    table = chosen.select("word").mapInArrow(_segment(model), "word_hash long, ids array<int>").toArrow()  # at most table_size rows
    words.unpersist()
    hashes = table.column("word_hash").to_numpy().view(np.uint64)
    column = table.column("ids").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    count = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.uint32)
    order = np.argsort(hashes)
    at = np.cumsum(count) - count
    moved = np.repeat(at[order] - (np.cumsum(count[order]) - count[order]), count[order]) + np.arange(len(flat))
    return hashes[order], flat[moved], count[order]


def _loaded(model: str, table, stamp: str) -> tokens.Pieces:
    """The worker's pieces, with the broadcast table in it."""
    def load(path: str, stamp: str) -> tokens.Pieces:
        pieces = tokens.marked_words(path)
        pieces.shared = table.value
        pieces.add(*pieces.shared, np.arange(len(pieces.shared[0])))
        return pieces

    load.__name__ = "chunk_table"
    for key in [k for k in tokens._KEPT if k[0] == "chunk_table" and k[-1][1] != stamp]:
        del tokens._KEPT[key]
    return tokens.kept(load, model, stamp=stamp)


def rows_of_ids(pieces: tokens.Pieces, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, flat ids, offsets) of slices of a text column, end id included."""
    column = _marked(column)
    for at, to in tokens.row_slices(column):
        flat, n = pieces.rows(*tokens.text_bytes(column.slice(at, to - at)))
        offsets = np.append(0, np.cumsum(n + 1))
        values = np.full(offsets[-1], end_id, np.int32)
        own = np.ones(len(values), bool)
        own[offsets[1:] - 1] = False
        values[own] = flat
        yield at, values, offsets


def _with_table(docs: DataFrame, model: str, table_size: int):
    made = chunk_table(docs, model, table_size)
    return docs.sparkSession.sparkContext.broadcast(made), hashlib.sha256(made[0].tobytes()).hexdigest()


def encode(docs: DataFrame, model: str, end_id: int = 2, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id and ids, with the end id."""
    table, stamp = _with_table(docs, model, table_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model, table, stamp)
        for batch in batches:
            for at, values, offsets in rows_of_ids(pieces, batch.column("text"), end_id):
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(offsets) - 1), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _decoder(model: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = tokens.kept(_decoder, model)
        for batch in batches:
            text = sp.decode([i or [] for i in batch.column("ids").to_pylist()], num_threads=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, end_id: int = 2, table_size: int = TABLE_SIZE) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    table, stamp = _with_table(docs, model, table_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sp = _loaded(model, table, stamp), tokens.kept(_decoder, model)
        digits = [str(i) for i in range(sp.get_piece_size())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at, values, offsets in rows_of_ids(pieces, batch.column("text"), end_id):
                ids = [values[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                spelled = [sha(" ".join(map(digits.__getitem__, x))) for x in ids]
                decoded = [sha(t) for t in sp.decode(ids, num_threads=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(ids)), pa.array(np.diff(offsets).astype(np.int64)),
                     pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
