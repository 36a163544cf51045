"""N-gram Jaccard join by parity sketches (operator 8).

A document's set holds its distinct word shingles.  Sets with
``100 |A and B| >= 75 |A or B|`` differ in at most (|A| + |B|) / 7 shingles.
Per size band, a shingle's hash picks one of P words of a sketch and is XORed
into it.  A shingle of the symmetric difference changes one word, so the number
of differing words (the Hamming distance over words) is a lower bound of the
symmetric difference, and linked documents agree in every word that none of
those few shingles hit: by the pigeonhole principle they share words that are
not empty.  Those words, with band and place, are the join keys.  Of its q
words a document joins on the d + 1 + slack first keys, where d bounds the
difference to any partner: linked documents then share at least 1 + the smaller
slack of the two of them, whatever the order, as long as all use the same.  The
order is rarest first, by a table of counts (``BUCKETS`` of them, by hash): a
document that shares a passage with many others, and differs in more than d
words, joins on words that nobody else has.

Shared keys are candidates.  Of each pair the parity bits are compared first: a
shingle flips one bit, so the Hamming
distance of two bit sketches is a lower bound of the symmetric difference too,
and a pair beyond (|A| + |B|) / 7 goes.  The sets themselves decide the rest.

The band of a pair is that of its larger set; a set near the upper end of its
band also joins in the next.  A set whose words do not outnumber d (tiny sets
with unlucky hashes) also joins on its single shingles.

Null or wordless text: an empty set, linked with nothing, its own component.
Rows that share an id, or have none, are told apart by their text; rows equal
in both are one.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored, texts
from .groups import linked, pruned
from .tokens import mix, row_slices, span_hash, text_bytes

WORDS, PERCENT = 5, 75
_ODD = np.random.default_rng(8).integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_BAND = np.random.default_rng(9).integers(0, 2**64, 64, dtype=np.uint64)
_U = np.uint64
#: Counts of words by hash that order the keys (one byte each is broadcast).
BUCKETS = 1 << 22
_CHUNK = 1 << 14
#: Parity bits that pairs are compared by as they meet.
FOLD = 1024


def shingle_rows(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each row."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    border = np.zeros(len(low) + 1, bool)
    border[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | border[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | border[1:-1]
    starts = np.flatnonzero(begins)
    hashes = span_hash(low, starts, np.flatnonzero(ends) - starts + 1)
    total = np.zeros(len(hashes), _U)
    for j in range(k):
        part = hashes[j:] * _ODD[j]
        total[:len(part)] += part
    total = mix(total + _U(k))
    for a, b in zip(*(np.searchsorted(starts, offsets[i:len(offsets) - 1 + i]).tolist() for i in (0, 1))):
        n = b - a
        if n >= k:
            yield np.unique(total[a:b - k + 1])
        elif n:
            yield mix((hashes[a:b] * _ODD[:n]).sum(keepdims=True) + _U(n))
        else:
            yield hashes[:0]


def band_of(n: int) -> int:
    """Sizes of band e lie in (16^e, 16^(e + 1)]; band 0 begins at 1."""
    e = 0
    while n > top_of(e):
        e += 1
    return e


def top_of(band: int) -> int:
    return 16 << 4 * band


def words(shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, bound d of the difference to any partner, sketch words) of a set
    that is not empty."""
    n = len(shingles)
    largest = 4 * n // 3
    for e in range(band_of(n), band_of(largest) + 1):
        top = top_of(e)
        parts = 2 * top + 24  # few shingles share a place, so a document's own ones spoil few shared words
        place = ((shingles >> _U(32)) * _U(parts)) >> _U(32)  # ascending, as the shingles are
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        xor = np.bitwise_xor.reduceat(mix(shingles), first)
        yield e, (n + min(largest, top)) // 7, mix(xor + place[first] * _ODD[9] + _BAND[e])


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(42)).astype(np.int64)  # 2 ** 22 of them


def keys(shingles: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, number that any partner shares, join keys) of a set that is not
    empty; rarest first by ``counts``, ties by hash."""
    n = len(shingles)
    largest = 4 * n // 3
    for e, d, got in words(shingles):
        top = top_of(e)
        got = np.sort(got)
        if counts is not None:
            got = got[np.argsort(counts[bucket(got)], kind="stable")]
        slack = 3 + d // 12
        # a partner's keys may end earlier: those of the smallest one leave the least slack
        least = (3 * n + 3) // 4
        sure = 1 + 3 + (least + min(4 * least // 3, top)) // 7 // 12
        yield e, min(len(got) - d, sure), got[:d + 1 + slack]
        if len(got) <= d:
            yield 100 + e, least, np.sort(mix(shingles + ~_BAND[e]))


def parity_bits(shingles: np.ndarray, bits: int = 0) -> np.ndarray:
    """Parity sketch: each shingle flips one bit; by default there are two to
    four bits a shingle, a power of two."""
    bits = bits or max(32, 2 << int(len(shingles) - 1).bit_length())
    flips = np.bincount((mix(shingles ^ _ODD[10]) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little")


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two parity sketches; the longer one is folded (bit
    places are hashes modulo the length, and parities add by XOR)."""
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


_SIZES = "node long, doc_id long, text_hash long, n_shingles long, set_hash long, set_check long, chunk int, counts binary"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the task's end its counts of words in chunks."""
    names = [c.split()[0] for c in _SIZES.split(", ")]
    counts = np.zeros(BUCKETS, np.uint32)
    for batch in batches:
        column, n, h, g = batch.column("text"), [], [], []
        for at, to in row_slices(column):
            met = []
            for s in shingle_rows(*text_bytes(column.slice(at, to - at))):
                n.append(len(s))
                h.append(s.sum())  # shingles are mixed hashes already
                g.append(np.bitwise_xor.reduce(s))
                if len(s):
                    met += [got for *_, got in words(s)]
            if met:
                counts += np.bincount(bucket(np.concatenate(met)), minlength=BUCKETS).astype(np.uint32)
        long = lambda x: pa.array(np.array(x, _U).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), long(h), long(g),
             pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    parts = counts.reshape(-1, _CHUNK)
    some = np.flatnonzero(parts.any(axis=1))
    for at in range(0, len(some), 64):
        which = some[at:at + 64]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(which), pa.int64())] * 6, pa.array(which.astype(np.int32)),
                                          pa.array([zlib.compress(parts[i].tobytes(), 1) for i in which], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one number, which come together, as one chunk of levels: eight
    to a doubling of the count."""
    def whole(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        data = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], ["chunk", "counts"])

    now, total = None, None
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            if chunk != now:
                if now is not None:
                    yield whole(now, total)
                now, total = chunk, np.zeros(_CHUNK, np.int64)
            total += np.frombuffer(zlib.decompress(data.as_buffer()), np.uint32)
    if now is not None:
        yield whole(now, total)


def word_counts(chunks: DataFrame) -> np.ndarray:
    """Count levels of all words by bucket: BUCKETS bytes, whatever the data."""
    rows = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, counts binary").toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    for chunk, data in zip(rows.column("chunk").to_pylist(), rows.column("counts").to_pylist()):
        out[chunk * _CHUNK:(chunk + 1) * _CHUNK] = np.frombuffer(data, np.uint8)
    return out


def _keys(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = counts.value
        for batch in batches:
            column, nodes = batch.column("text"), batch.column("node").to_numpy()
            for at, to in row_slices(column):
                found = [(node, e, g, k) for node, s in zip(nodes[at:to].tolist(), shingle_rows(*text_bytes(column.slice(at, to - at))))
                         if len(s) for e, g, k in keys(s, rare)]
                if found:
                    many = [len(k) for *_, k in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([k for *_, k in found]).view(np.int64)),
                         pa.array(np.repeat(np.array([f[0] for f in found], np.int64), many)),
                         pa.array(np.repeat(np.array([f[1] for f in found], np.int32), many)),
                         pa.array(np.repeat(np.array([f[2] for f in found], np.int32), many))], ["sig", "node", "part", "sure"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that several rows have; the rows come sorted by key.  Only
    the last row is held back, until the next one shows whether its key is shared."""
    held, given = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        sig = table.column("sig").to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        after = bool(keep[-1]) or (len(sig) == 1 and given)
        if given:
            keep[0] = False
        if keep.any():
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
        held, given = table.slice(len(sig) - 1).combine_chunks().to_batches()[0], after


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for at, to in row_slices(column):
            sets = list(shingle_rows(*text_bytes(column.slice(at, to - at))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(at, to - at), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                 pa.array([parity_bits(s, FOLD).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "shingles", "n", "bits", "fold"])


def _near_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and parity bits allow a link."""
    for batch in batches:
        keep = []
        for x, y, n, m in zip(batch.column("_x"), batch.column("_y"), batch.column("_n").to_pylist(), batch.column("_m").to_pylist()):
            keep.append(100 * min(n, m) >= PERCENT * max(n, m)
                        and 7 * hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= n + m)
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])
    return run


def _verify(sets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def both(pairs: DataFrame, column: str, *more: tuple[str, str, str]) -> DataFrame:
        side = lambda end, to, i: sets.select(F.col("node").alias(end), F.col(column).alias(to), *[F.col(m[0]).alias(m[i]) for m in more])
        return pairs.join(side("a", "_x", 1), "a").join(side("b", "_y", 2), "b")

    def verify(pairs: DataFrame) -> DataFrame:
        near = both(pairs.select("a", "b"), "bits", ("n", "_n", "_m")).select("a", "b", "_x", "_y", "_n", "_m").mapInArrow(_near_bits, "a long, b long")
        near = stored(near, "near")
        return both(near, "shingles").select("a", "b", "_x", "_y").mapInArrow(_similar(PERCENT), "a long, b long")

    return verify


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that
    links reach), kept (the
    group's first row in order of id and text hash) and n_verified
    (links of its set that had to be verified; components do not need every link)."""
    rows = texts(docs)
    repeated = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    node = F.xxhash64("doc_id", "text") if repeated else F.col("doc_id")
    rows = rows.select("doc_id", "text", node.alias("node"), F.xxhash64("text").alias("text_hash"))
    seen = stored(rows.mapInArrow(_sizes, _SIZES), "sizes")
    sizes = seen.where("chunk is null").drop("chunk", "counts")
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(seen.where("chunk is not null").select("chunk", "counts")))
    # equal sets are one node
    reps = sizes.where("n_shingles > 0").groupBy("set_hash", "set_check", "n_shingles").agg(F.min("node").alias("node"))
    reps = stored(reps, "sets")
    keyed = rows.select("node", "text").mapInArrow(_keys(counts), "sig long, node long, part int, sure int")
    shared = (keyed.repartition("sig").sortWithinPartitions("sig")
              .mapInArrow(_shared, "sig long, node long, part int, sure int"))
    members = shared.join(reps.select("node"), "node", "left_semi")
    members = pruned(members.dropDuplicates(["sig", "node"]) if repeated else members)
    wanted = members.select("node").distinct()
    sets = stored(rows.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
                  .mapInArrow(_sets, "node long, shingles binary, n long, bits binary, fold array<long>"), "shingles")
    verify = _verify(sets)
    met = (sets.select("node", "n", "fold"), f"{PERCENT} * greatest(x.n, y.n) <= 100 * least(x.n, y.n) AND "
           "7 * aggregate(zip_with(x.fold, y.fold, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= x.n + y.n")
    labels, links = linked(members, verify, met=met)
    removed(sets)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    found = (reps.join(labels, "node", "left").join(degree, "node", "left")
             .select("set_hash", "set_check", "n_shingles", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_verified", F.lit(0)).alias("n_verified")))
    out = sizes.join(found, ["set_hash", "set_check", "n_shingles"], "left")
    smallest = out.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"),
                                                                 F.min(F.struct("doc_id", "text_hash")).alias("_first"))
    out = out.join(smallest, "comp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("n_verified", F.lit(0)).alias("n_verified"), "text_hash",
                      (F.col("comp").isNull() | F.struct("doc_id", "text_hash").eqNullSafe(F.col("_first"))).alias("kept"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest id of each group of near duplicates, all columns kept."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return own.join(kept, same, "left_semi").select(docs.columns)
