"""Document fingerprints by randomised edit embedding (operator 1).

A random walk shared by all documents maps edit distance to Hamming distance:
at step j the embedding emits the character under the reading head, and the
head moves on when a random bit for (j, character) is one, so after an edit
two walks soon fall into step again.  Bits repeat every ``PERIOD`` steps, so a
table gives the steps until the head moves, and the walk needs one look-up per
character.

A fingerprint samples ``SAMPLES`` steps.  Sample k takes the step, among those
the walk made, of least random priority in order k: texts of nearly the same
length then sample the same steps, and the share of equal samples estimates
1 - (Hamming distance / length) of the embeddings.  ``near_duplicates`` bands
the samples and verifies candidates on the whole embeddings.

Null text counts as empty; its fingerprint is all zeros and equals another
empty one.  Rows that share an id follow one another by their text's hash; a
null id is the smallest.  With one document, the next one is itself.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts
from .groups import linked
from .tokens import mix

PERIOD, CLASSES, SAMPLES, BLOCK = 4096, 256, 128, 1 << 16


@cache
def _moves() -> list[list[int]]:
    """Steps until the head moves, by character class and step (mod PERIOD)."""
    bits = np.random.default_rng(1).integers(0, 2, (CLASSES, PERIOD), dtype=np.int64)
    bits[:, -1] = 1
    step = np.where(np.tile(bits, 2) == 1, np.arange(2 * PERIOD), 4 * PERIOD)
    nxt = np.minimum.accumulate(step[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (nxt - np.arange(PERIOD) + 1).tolist()


@cache
def _records() -> np.ndarray:
    """Row k: the steps that have a smaller priority in order k than all
    before, ascending; the last one below a length is that length's sample."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(SAMPLES):
        at, least, row = 0, rng.random(), [0]
        while at < 1 << 40:
            at += int(rng.geometric(least)) if least > 1e-12 else 1 << 41
            least *= rng.random()
            row.append(at)
        rows.append(row)
    out = np.full((SAMPLES, max(map(len, rows))), 1 << 62, np.int64)
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


class Walk:
    """The embedding of a text so far: the step at which each character is first emitted."""

    def __init__(self, text: str, before: "Walk | None" = None):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        hashed = mix(code.astype(np.uint64) + np.uint64(77))
        kinds = (hashed & np.uint64(CLASSES - 1)).astype(np.uint8).tobytes()
        symbols = (hashed >> np.uint64(40)).astype(np.uint8)
        steps = [] if before is None else [before.steps]
        self.length = 0 if before is None else before.length
        moves, last = _moves(), PERIOD - 1
        t = self.length
        for at in range(0, len(kinds), BLOCK):
            part = []
            add = part.append
            for kind in kinds[at:at + BLOCK]:
                add(t)
                t += moves[kind][t & last]
            steps.append(np.array(part, np.int64))
        self.length = t
        self.steps = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        self.symbols = symbols if before is None else np.concatenate([before.symbols, symbols])

    def at(self, steps: np.ndarray) -> np.ndarray:
        return self.symbols[np.searchsorted(self.steps, steps, "right") - 1]

    def fingerprint(self) -> bytes:
        if not self.length:
            return bytes(SAMPLES)
        records = _records()
        chosen = records[np.arange(SAMPLES), (records < self.length).sum(axis=1) - 1]
        return self.at(chosen).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    return float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)))


def embedding_likeness(x: Walk, y: Walk) -> float:
    """1 - Hamming distance / length of the whole embeddings."""
    if not x.length and not y.length:
        return 1.0
    shared, same = min(x.length, y.length), 0
    edges = np.union1d(x.steps, y.steps)
    edges = np.append(edges[edges < shared], shared)
    if len(edges) > 1:
        same = int(np.diff(edges)[x.at(edges[:-1]) == y.at(edges[:-1])].sum())
    return same / max(x.length, y.length)


class _Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, n = doc_id, text, len(text)
        self.kept, self.cut = text[:n - n // 2], n // 2
        self.head = Walk(self.kept)
        self.fingerprint = Walk(text[n - n // 2:], self.head).fingerprint()

    def row(self, after: "_Document") -> tuple:
        """The result row, given the next document."""
        tail = after.text[:self.cut]
        edited = Walk(tail, self.head).fingerprint()
        sha = hashlib.sha256((self.kept + tail).encode()).hexdigest()
        return (self.doc_id, len(self.text), sha, self.fingerprint.hex(), edited.hex(),
                likeness(self.fingerprint, edited), likeness(self.fingerprint, after.fingerprint))


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_BORDER = [pa.field("block", pa.int32()), pa.field("first", pa.string()), pa.field("last", pa.string())]
_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _rows(rows: list[tuple], more: list[tuple] = ()) -> pa.RecordBatch:
    schema = _ROW if not more else pa.schema(list(_ROW) + _BORDER)
    full = [(*r, *x) for r, x in zip(rows, more)] if more else rows
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(schema)], schema=schema)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range.  Its first and last texts go out as well: the
    last row waits for the first text of the next range."""
    block, held = TaskContext.get().partitionId(), None
    nothing = (None,) * 7
    for batch in batches:
        rows, borders = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            now = _Document(doc_id, text)
            if held is None:
                rows.append(nothing)
                borders.append((block, text, None))
            else:
                rows.append(held.row(now))
                borders.append((block, None, None))
            held = now
        if rows:
            yield _rows(rows, borders)
    if held is not None:
        yield _rows([(held.doc_id, *nothing[1:])], [(block, None, held.text)])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_Document(i, text).row(_Document(None, after)) for i, text, after in
                zip(*(batch.column(c).to_pylist() for c in ("doc_id", "last", "after")))]
        if rows:
            yield _rows(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, its fingerprint, that of its edited text (the last
    half replaced by the beginning of the next document in descending order of
    id, after the last the first), and the likeness of both and of the next one's."""
    order = [F.col("doc_id").desc(), F.col("_tie")]
    rows = texts(docs).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = stored(rows.mapInArrow(_follow, f"{_DDL}, block int, first string, last string"), "walks")
    names = [f.name for f in _ROW]
    inner = made.where("fingerprint is not null").select(names)
    # one first and one last text per range; which range follows is a table of one row per range
    firsts = made.where("first is not null").select("block", "first")
    blocks = firsts.select("block")
    after = blocks.select("block", F.lead("block").over(Window.orderBy("block")).alias("_next"))
    after = after.crossJoin(blocks.agg(F.min("block").alias("_least")))  # one row: the last range is followed by the first
    lasts = (made.where("last is not null").select("block", "doc_id", "last").join(after, "block")
             .withColumn("_next", F.coalesce("_next", "_least"))
             .join(firsts.select(F.col("block").alias("_next"), F.col("first").alias("after")), "_next"))
    return inner.unionByName(lasts.select("doc_id", "last", "after").mapInArrow(_finish, _DDL))


def _band_keys(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SAMPLES // bands
        for batch in batches:
            found = [Walk(t).fingerprint() for t in batch.column("text").to_pylist()]
            keys = [[bytes([b]) + f[b * width:(b + 1) * width] for b in range(bands)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.binary()))], ["node", "keys"])
    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([embedding_likeness(Walk(x), Walk(y)) >= least for x, y in
                             zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 16) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest id reached by
    links.  Candidates share a band of their fingerprints; a link is verified
    on the whole embeddings (likeness of at least ``least``).  Equal texts are one node."""
    rows = texts(docs).withColumn("_text_hash", F.sha2("text", 256))
    nodes = stored(rows.groupBy("_text_hash").agg(F.min(F.struct("doc_id", "text")).alias("_row"))
                   .select("_text_hash", F.xxhash64("_text_hash").alias("node"), "_row.text"), "texts")
    keyed = nodes.select("node", "text").mapInArrow(_band_keys(bands), "node long, keys array<binary>")
    members = keyed.select("node", F.explode("keys").alias("_key")).select(F.xxhash64("_key").alias("sig"), "node")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (nodes.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "_x"), ("b", "_y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y").mapInArrow(_verify(least), "a long, b long")

    labels, _ = linked(members, verify)
    comp = nodes.join(labels, "node", "left").select("_text_hash", F.coalesce("comp", "node").alias("_comp"))
    out = rows.select("doc_id", "_text_hash").join(comp, "_text_hash")
    return out.join(out.groupBy("_comp").agg(F.min("doc_id").alias("component_id")), "_comp").select("doc_id", "component_id")
