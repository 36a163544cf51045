"""Phrase collocations from a weighted de Bruijn graph (operator 13).

Texts fall into pieces and words.  Every word begins the longest gram (five
words) that its piece allows; a five-word gram is an edge between two
overlapping four-word nodes, a shorter one ends its piece.  Spark counts these
grams once.  The flow of a node (occurrences of its words) is the weight of
the edges that leave it plus the pieces that end with it, and in the same way
each shorter gram's count is the flow of the grams that prolong it plus its
own piece ends, so no other length is ever counted from text.

A phrase with ``min_count`` occurrences holds only word pairs with as many.
Pair counts, by hash, are taken first, and a piece is cut between words whose
pair is rarer: its parts keep every count that matters, and the graph has no
rare edges.  Frequent pairs go to the tasks as a bitmap of ``FILTER_BITS``; a
false hit leaves a rare edge in and changes no result.

Where a node's whole flow enters by one edge and leaves by one edge, both
edges have its weight and are compacted into one path.  A path never leaves a
piece (an occurrence that goes on for ever cannot be), so its text is no longer
than one.  Phrases inside a path with the path's weight are dropped as part of
a longer phrase, likewise those that one more word prolongs without loss.

Null text is empty, a null lang is ``und``; repeated rows count each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import removed, stored

LONGEST = 5
MIN_COUNT = 100
#: Bits of the frequent-pair filter (32 MB).
FILTER_BITS = 28
#: Text bytes worked on at once (a longer text stands alone).
SLICE = 1_000_000
_SALT = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 letter of a word, 1 blank, 2 piece border
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class _Slice:
    """Words of some texts: bytes, start, length, hash, language per word, and
    whether the next word follows in the same piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, offsets = tokens.text_bytes(texts)
        self.data = _LOWER[raw]
        kind = _KIND[self.data]
        visible = kind == 0
        starts = visible.copy()
        starts[1:] &= ~visible[:-1]
        full = offsets[:-1][np.diff(offsets) > 0]
        starts[full] = visible[full]
        stops = visible.copy()
        stops[:-1] &= ~visible[1:]
        stops[full[1:] - 1] = visible[full[1:] - 1]
        self.start = np.flatnonzero(starts)
        self.length = np.flatnonzero(stops) + 1 - self.start
        self.hash = tokens.span_hash(self.data, self.start, self.length)
        row = np.searchsorted(offsets, self.start, "right") - 1
        names = langs.dictionary_encode()
        self.lang = names.indices.to_numpy()[row].astype(np.int64)
        self.names = names.dictionary.to_pylist()
        salts = np.array([int.from_bytes((n.encode() + bytes(8))[:8], "little") * 31 + len(n) for n in self.names], object)
        salts = np.array([int(x) & (2**64 - 1) for x in salts], np.uint64)
        self.salt = tokens.mix(salts)[self.lang] if len(salts) else np.zeros(0, np.uint64)
        borders = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        self.linked = (row[1:] == row[:-1]) & (borders[1:] == borders[:-1])

    def pairs(self) -> np.ndarray:
        """Hash of each word with its successor (any value where there is none)."""
        return tokens.mix(self.hash[:-1] * _SALT + tokens.mix(self.hash[1:] ^ self.salt[1:]))

    def text(self, at: int, n: int) -> str:
        end = at + n - 1
        raw = self.raw[self.start[at]:self.start[end] + self.length[end]]
        if b"\t" in raw or b"  " in raw:
            raw = b" ".join(w for w in raw.replace(b"\t", b" ").split(b" ") if w)
        return raw.decode()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        for at, to in tokens.row_slices(texts, SLICE):
            got = _Slice(langs.slice(at, to - at), texts.slice(at, to - at))
            if len(got.start):
                yield got


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in _slices(batches):
        pair, n = np.unique(s.pairs()[s.linked], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])


def frequent_pairs(docs: DataFrame, min_count: int = MIN_COUNT, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of ``2 ** bits`` bits with those of all word pairs that occur
    ``min_count`` times (and perhaps of others)."""
    counts = _prepared(docs).mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= min_count).select(F.shiftrightunsigned("pair", 64 - bits).alias("bit"))
    often = often.selectExpr("shiftright(bit, 6) AS cell", "shiftleft(1L, cast(bit & 63 AS int)) AS mask")
    cells = often.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out


def _starts(bitmap, bits: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for s in _slices(batches):
            place = s.pairs() >> np.uint64(64 - bits)
            known = (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            linked = np.append(s.linked & known, False)
            size = np.ones(len(linked), np.int64)
            reach = linked.copy()
            one, two = tokens.mix(s.hash ^ s.salt), tokens.mix(s.hash + ~s.salt)
            for k in range(1, longest):
                size += reach
                follow = np.zeros(len(linked), np.uint64)
                follow[:-k or None] = s.hash[k:]
                one = np.where(reach, tokens.mix(one * _SALT + follow), one)
                two = np.where(reach, tokens.mix((two ^ follow) * _SALT + np.uint64(k)), two)
                reach[:-k] &= linked[k:]
                reach[-k:] = False
            _, first, back, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
            if (two[first][back] != two).any():  # two grams under one hash: tell them apart by both
                _, first, n = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_counts=True)
            s.raw = s.data.tobytes()
            grams = [s.text(i, m) for i, m in zip(first.tolist(), size[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.names[i] for i in s.lang[first].tolist()], pa.string()), pa.array(grams, pa.string()),
                 pa.array(size[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "size", "n"])
    return run


def longest_grams(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, gram, size, n: for every word the longest gram that begins with it
    within its (cut) piece, counted.  Sizes below ``longest`` are piece ends."""
    bitmap = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, min_count, bits))
    grams = _prepared(docs).mapInArrow(_starts(bitmap, bits, longest), "lang string, gram string, size int, n long")
    return grams.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def flows(grams: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, size, a: counts of all words, and of phrases of 2 to
    ``longest`` words that occur ``min_count`` times, from the flow of the
    longest grams and the piece ends.  A phrase's count is exact."""
    level = grams.where(F.col("size") == longest).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    out, old = None, []
    for size in range(longest, 0, -1):
        if size < longest:
            ends = grams.where(F.col("size") == size).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
            level = level.select("lang", F.substring_index("phrase", " ", size).alias("phrase"), "a").unionByName(ends)
            level = stored(level.groupBy("lang", "phrase").agg(F.sum("a").alias("a")), "level")
            old.append(level)
        rows = level.where((F.col("a") >= min_count) if size > 1 else F.lit(True)).select("lang", "phrase", F.lit(size).alias("size"), "a")
        out = rows if out is None else out.unionByName(rows)
    out = stored(out, "flows")
    for level in old:
        removed(level)
    return out


def paths(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Compacted paths of the graph: lang, words (in order), a.  Every edge is
    in one path; edges join where a node's whole flow passes from one to the other."""
    edges = counts.where(F.col("size") == longest).select("lang", F.col("phrase").alias("edge"), "a")
    nodes = counts.where(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), "a")
    into = edges.select("lang", F.expr("substring(edge, instr(edge, ' ') + 1)").alias("node"), "a", F.col("edge").alias("before"))
    outof = edges.select("lang", F.substring_index("edge", " ", longest - 1).alias("node"), "a", "edge")
    through = outof.join(nodes, ["lang", "node", "a"]).join(into, ["lang", "node", "a"]).select("lang", "edge", "before")
    walk = edges.join(through, ["lang", "edge"], "left")
    walk = stored(walk.select("lang", "edge", "a", F.coalesce("before", "edge").alias("head"), F.col("before").isNotNull().cast("long").alias("place")), "walk")
    while True:  # pointer doubling: rounds grow with the logarithm of the longest path
        back = walk.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        step = walk.join(back, ["lang", "head"])
        moved = F.col("further") != F.col("head")
        step = stored(step.select("lang", "edge", "a", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), moved.alias("moved")), "walk")
        removed(walk)
        walk = step
        if walk.where("moved").isEmpty():
            break
    tail = F.sort_array(F.collect_list(F.struct("place", F.substring_index("edge", " ", -1).alias("word"))))  # one path: no longer than one piece
    whole = walk.groupBy("lang", "head").agg(F.first("a").alias("a"), tail.alias("tail"))
    first = F.slice(F.split("head", " "), 1, longest - 1)
    return whole.select("lang", F.concat(first, F.transform("tail", lambda x: x["word"])).alias("words"), "a")


def _inside(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a) of the phrases of 2 to ``longest - 1`` words in paths."""
    size = F.explode(F.sequence(F.lit(2), F.lit(longest - 1)))
    rows = words.withColumn("size", size)
    grams = F.expr("transform(sequence(1, size(words) - size + 1), i -> array_join(slice(words, i, size), ' '))")
    return rows.select("lang", F.explode(F.array_distinct(grams)).alias("phrase"), "a")


def dominated(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases that some longer phrase holds without losing an occurrence."""
    middle = counts.where((F.col("size") > 2) & (F.col("size") < longest))
    left = middle.select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase"), "a")
    right = middle.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
    return _inside(paths(counts, longest), longest).unionByName(left).unionByName(right).distinct()


def collocations(docs: DataFrame, top: int = 2000, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut."""
    grams = stored(longest_grams(docs, min_count, longest), "grams")
    counts = flows(grams, longest, min_count)
    removed(grams)
    total = counts.where(F.col("size") == 1).groupBy("lang").agg(F.sum("a").alias("n"))
    found = counts.where(F.col("size") > 1).join(dominated(counts, longest), ["lang", "phrase", "a"], "left_anti")
    cuts = found.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"),
                       F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    parts = counts.where(F.col("size") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.join(total, "lang")  # one row per language
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("cast(over * cast(n as decimal(15,0)) as decimal(38,0)) div under"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
