"""Spelling variants by reduced-alphabet generation (operator 12).

Letters are hashed to ``symbols`` symbols.  Two words one edit apart have
reduced words at most one edit apart, so the one-edit neighbourhood of every
reduced word is generated and joined with the reduced vocabulary; the words
themselves are then compared.  Of two neighbours that produce each other only
one does: the longer word deletes, the one with the smaller symbol replaces,
and equal reduced words meet as they are.  A neighbour is a 64-bit polynomial
hash made from prefix sums in constant time, so a very long word costs its
length times the symbols, and a hash collision costs one comparison.

A word's form is its near word of largest count, where that is ``ratio`` times
its own count or more (ties: smallest in code-point order); its root is where
the chain of forms ends.

Null text has no words; a null id is the empty string in the hash that deletes
letters; repeated rows count each for itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored, texts

SYMBOLS = 8
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Letters worked on at once when neighbours are generated.
SPAN = 400_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BACK = pow(_BASE, -1, 1 << 64)


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


# --- vocabulary ----------------------------------------------------------------

def _count(one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = Counter(_RUN.findall(lower_ascii(text.as_py())))
                seed = zlib.crc32(("" if i is None else str(i)).encode() + b":")
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)
    return run


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, one_in: int = 31) -> DataFrame:
    """Distinct words (word, n) of all texts; a run whose hash with its
    document's id is a multiple of ``one_in`` loses one letter."""
    words = texts(docs).mapInArrow(_count(one_in), "word string, n long")
    words = words.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= min_count)


# --- near words ----------------------------------------------------------------

def _letters(words: list[str], symbols: int) -> np.ndarray:
    """Symbol of each letter of the joined words."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return ((points * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)) % np.uint64(symbols)


def _values(symbols: int) -> np.ndarray:
    return np.random.default_rng(12).integers(1, 2**64, symbols, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _prefixes(words: list[str], symbols: int):
    """Symbols, place in its word, values times powers, their sum before each
    letter within its word, whole sums per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths) - lengths
    s = _letters(words, symbols)
    place = np.arange(len(s)) - np.repeat(begin, lengths)
    power = _powers(int(lengths.max()) + 2)
    terms = _values(symbols)[s] * power[place]
    upto = np.cumsum(terms)  # modulo 2^64; differences within a word are exact
    before = upto - terms
    before -= np.repeat(before[begin], lengths)
    whole = before[begin + lengths - 1] + terms[begin + lengths - 1]
    return lengths, s, place, power, terms, before, whole


def _chunks(batch: pa.RecordBatch):
    """(ids, words) of about SPAN letters; a longer word stands alone."""
    ids, words = batch.column("id").to_pylist(), batch.column("word").to_pylist()
    at = 0
    while at < len(words):
        to, size = at, 0
        while to < len(words) and (to == at or size + len(words[to]) <= SPAN):
            size += len(words[to])
            to += 1
        yield np.array(ids[at:to], np.int64), words[at:to]
        at = to


def _rows(key: np.ndarray, ids: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), kind, np.int8))], ["key", "id", "kind"])


def _reduced(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words in _chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_prefixes(words, symbols)[-1].view(np.int64)), pa.array(ids)], ["key", "id"])
    return run


#: Kinds of neighbours.
SAME, DELETED, REPLACED = 0, 1, 2


def _neighbours(symbols: int):
    """Hashes of each reduced word, of it with one symbol less, and of it with
    one symbol replaced by a larger one; each distinct result once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, back = _values(symbols), np.uint64(_BACK)
        for batch in batches:
            for ids, words in _chunks(batch):
                lengths, s, place, power, terms, before, whole = _prefixes(words, symbols)
                yield _rows(whole, ids, SAME)
                ids, whole = np.repeat(ids, lengths), np.repeat(whole, lengths)
                first_of_run = np.append(True, s[1:] != s[:-1]) | (place == 0)
                shorter = before + (whole - before - terms) * back
                yield _rows(shorter[first_of_run], ids[first_of_run], DELETED)
                for x in range(1, symbols):
                    smaller = s < x
                    yield _rows((whole - terms + value[x] * power[place])[smaller], ids[smaller], REPLACED)
    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs of ids of words (id, word) exactly one edit apart, each once."""
    rows = words.select("id", "word")
    made = rows.mapInArrow(_neighbours(symbols), "key long, id long, kind byte").alias("a")
    known = rows.mapInArrow(_reduced(symbols), "key long, id long").alias("b")
    met = made.join(known, F.col("a.key") == F.col("b.key"))
    met = met.where((F.col("a.kind") != SAME) | (F.col("a.id") < F.col("b.id")))
    met = met.select(F.col("a.id").alias("one"), F.col("b.id").alias("other"))
    met = met.join(rows.select(F.col("id").alias("one"), F.col("word").alias("one_word")), "one")
    met = met.join(rows.select(F.col("id").alias("other"), F.col("word").alias("other_word")), "other")
    near = met.where(F.levenshtein("one_word", "other_word", 1) == 1)
    return near.select("one", "other").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form).  Counts grow along a
    chain by the ratio, so it has no cycle and few rounds end it."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        removed(roots)
        roots = moved
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = stored(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_pairs(words, symbols)
    both = pairs.unionByName(pairs.select(F.col("other").alias("one"), F.col("one").alias("other")))
    other = words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = both.join(other, "other").groupBy(F.col("one").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(found, "id", "left")
    takes = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"),
                              F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    removed(words)
    roots = _followed(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    return group_variants(vocabulary(docs))
