"""Document quality by a linear-chain conditional random field (operator 4).

Each line of a text is good or bad.  A line's features are its own shape
(letters, capitals, symbols, repeated words, repeated lines, length) and that
of its neighbours; a transition weight ties neighbouring lines.  Forward and
backward sums give each line's marginal probability to be good; a document's
mean of them, weighted by length, is its quality, put on the scale of the
labels by a logistic curve.

Only documents are labelled, so training alternates: lines start with their
document's label, the field is fitted, and lines of bad documents that look
good become good, but each bad document keeps its worst line.  The field is
fitted on at most ``FIT_ROWS`` labelled documents with at most ``FIT_CHARS``
characters altogether, chosen by a hash of the id.  Statistics of a line are
counts over its bytes, made for whole batches at once.

Null or empty text is one empty line.  Without labels of both kinds every
score is 0.5.  Rows that share an id are scored each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, texts
from .tokens import row_slices, span_hash, text_bytes

FIT_ROWS, FIT_CHARS, ROUNDS = 4_000, 20_000_000, 4


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes per line, lines per row) of texts in UTF-8."""
    n_rows = len(offsets) - 1
    newlines = np.flatnonzero(data == 10)
    per_row = np.searchsorted(newlines, offsets[1:]) - np.searchsorted(newlines, offsets[:-1]) + 1
    first = np.cumsum(per_row) - per_row
    total = int(per_row.sum())
    start = np.zeros(total, np.int64)
    row_of = np.repeat(np.arange(n_rows), per_row)
    is_first = np.zeros(total, bool)
    is_first[first] = True
    start[is_first] = offsets[:-1]
    start[~is_first] = newlines + 1
    stop = np.empty(total, np.int64)
    is_last = np.append(is_first[1:], True)
    stop[is_last] = offsets[1:]
    stop[~is_last] = newlines
    size = stop - start

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (sums[stop] - sums[start]).astype(float)

    ascii_ = data < 128
    upper = ((data >= 65) & (data <= 90))
    lower = ((data >= 97) & (data <= 122))
    wide = (data >= 0xC0)
    after = np.append(data[1:], 0)
    upper |= (data == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | (data == 9)
    ending = (data == 46) | (data == 44) | (data == 33) | (data == 63)
    symbol = ascii_ & ~(upper | lower | digit | blank | ending | (data < 32) | (data == 39) | (data == 45))
    chars = np.maximum(count((data & 0xC0) != 0x80), 1)
    letters = np.maximum(count(upper | lower | wide), 1)
    # words of a line: bytes between blanks and newlines
    inside = ~(blank | (data == 10))
    border = np.zeros(len(data) + 1, bool)
    border[start] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | border[1:-1]
    at = np.flatnonzero(begins)
    hashes = span_hash(data, at, np.flatnonzero(finish) - at + 1) if len(at) else np.zeros(0, np.uint64)
    line_of = np.searchsorted(start, at, "right") - 1
    words = np.bincount(line_of, minlength=total).astype(float) if len(at) else np.zeros(total)
    twice = np.zeros(total)
    if len(at) > 1:
        same = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
        twice = np.bincount(line_of[1:][same], minlength=total).astype(float)
    # distinct words of a line, and whether the row has the same line elsewhere
    if len(at):
        order = np.lexsort((hashes, line_of))
        h, l = hashes[order], line_of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (l[1:] != l[:-1]))
        distinct = np.bincount(l[new], minlength=total).astype(float)
        line_hash = np.zeros(total, np.uint64)
        filled = np.flatnonzero(words > 0)
        line_hash[filled] = np.add.reduceat(hashes * (np.arange(len(at)) - np.searchsorted(line_of, line_of) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.searchsorted(line_of, filled))
    else:
        distinct, line_hash = np.zeros(total), np.zeros(total, np.uint64)
    order = np.lexsort((line_hash, row_of))
    again = np.zeros(total, bool)
    pair = (line_hash[order][1:] == line_hash[order][:-1]) & (row_of[order][1:] == row_of[order][:-1])
    again[order[1:][pair]] = True
    again[order[:-1][pair]] = True
    many = np.maximum(words, 1)
    shape = np.column_stack([
        count(upper) / letters, count(symbol) / chars, count(digit) / chars, count(ending) / many, count(data == 33) / many,
        count(data == 124) / many, twice / many, 1 - distinct / many, again.astype(float), np.minimum(letters / many, 20) / 10,
        np.log1p(words), (words <= 3).astype(float), (count(upper) / letters > 0.5).astype(float), (twice / many > 0.3).astype(float),
        (count(symbol) / many > 0.5).astype(float), (distinct / many < 0.5).astype(float)])
    before, following = np.roll(shape, 1, axis=0), np.roll(shape, -1, axis=0)
    before[first] = 0.0
    following[first + per_row - 1] = 0.0
    edge = np.column_stack([is_first, is_last]).astype(float)
    return np.column_stack([shape, before, following, edge, np.ones(total)]), size.astype(float), per_row


def good_marginals(unary: np.ndarray, tie: float, per_row: np.ndarray) -> np.ndarray:
    """P(line is good) by forward and backward sums, in log-odds: ``unary`` is
    a line's own, ``tie`` the weight of equal neighbours."""
    own = unary.tolist()
    forward, backward = [0.0] * len(own), [0.0] * len(own)
    def message(m: float) -> float:
        if m > 30:
            return tie
        if m < -30:
            return -tie
        a, b = tie + m, 0.0
        hi = a if a > b else b
        up = hi + log1p(exp(-abs(a - b)))
        a, b = m, tie
        hi = a if a > b else b
        return up - (hi + log1p(exp(-abs(a - b))))

    at = 0
    for n in per_row.tolist():
        m = 0.0
        for i in range(at, at + n):
            forward[i] = m
            m = message(own[i] + m)
        m = 0.0
        for i in range(at + n - 1, at - 1, -1):
            backward[i] = m
            m = message(own[i] + m)
        at += n
    log_odds = np.array(own) + np.array(forward) + np.array(backward)
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


class Field:
    """Weights of the line features, of equal neighbours, and of the document curve."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, tie: float, curve: np.ndarray):
        self.w, self.mean, self.scale, self.tie, self.curve = w, mean, scale, tie, curve

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score, weighted mean and number of lines of each row."""
        x, size, per_row = line_features(data, offsets)
        good = good_marginals(((x - self.mean) / self.scale) @ self.w, self.tie, per_row)
        z = summary(good, size, per_row)
        return np.column_stack([1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30))), z[:, 0], per_row])


def summary(good: np.ndarray, size: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals, the bad share on a log scale, and 1."""
    first = np.cumsum(per_row) - per_row
    weight = size + 1.0
    mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
    return np.column_stack([mean, np.log(np.maximum(1 - mean, 1e-3)), np.ones(len(mean))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w, r = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + r @ w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + r, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(text: pa.Array, quality: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fit on labelled texts.  Pseudo-likelihood: a line's label given its
    features and its neighbours' labels, whose weight is the transition's."""
    x, size, per_row = line_features(*text_bytes(text))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    mean[-1] = 0.0
    z = (x - mean) / scale
    row = np.repeat(np.arange(len(per_row)), per_row)
    first = np.cumsum(per_row) - per_row
    y = quality[row].astype(float)
    starts, ends = np.zeros(len(y), bool), np.zeros(len(y), bool)
    starts[first] = True
    ends[first + per_row - 1] = True
    w, tie = np.zeros(z.shape[1]), 0.0
    for _ in range(rounds):
        sign = 2 * y - 1
        near = np.where(starts, 0, np.roll(sign, 1)) + np.where(ends, 0, np.roll(sign, -1))
        got = _logistic(np.column_stack([z, near]), y, ridge=1.0)
        w, tie = got[:-1], float(np.clip(got[-1], 0.0, 2.0))
        good = good_marginals(z @ w, tie, per_row)
        worst = np.minimum.reduceat(good, first)[row]
        y = np.where(quality[row] == 1, 1.0, np.where((good > 0.5) & (good > worst), 1.0, 0.0))
    good = good_marginals(z @ w, tie, per_row)
    curve = _logistic(summary(good, size, per_row), quality.astype(float), ridge=1e-3)
    return Field(w, mean, scale, tie, curve)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field, from labels of rows that are not held out (a bounded sample of them)."""
    known = labels.where(~held_out()).where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = labelled(docs, known, FIT_ROWS, 4)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > FIT_CHARS:
        rows = labelled(docs, known, int(FIT_ROWS * 0.9 * FIT_CHARS / chars), 4)
    # a very long text alone may not exceed the bound either
    found = rows.where(F.length("text") <= FIT_CHARS // 10).select("doc_id", "text", "quality").toArrow().sort_by("doc_id")
    quality = found.column("quality").to_numpy()
    if len(set(quality.tolist())) < 2:
        return None
    return fit(found.column("text"), quality)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, good_share (weighted
    mean of the marginals) and n_lines."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        for batch in batches:
            column = batch.column("text")
            for at, to in row_slices(column):
                data, offsets = text_bytes(column.slice(at, to - at))
                got = f.documents(data, offsets) if f else np.full((to - at, 3), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy()), pa.array(got[:, 2].astype(np.int64))],
                    ["doc_id", "score", "good_share", "n_lines"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double, good_share double, n_lines long")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share", "n_lines")
