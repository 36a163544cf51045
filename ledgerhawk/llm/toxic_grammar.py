"""Toxicity by a weighted finite-state pattern grammar (operator 5).

A clause becomes a string of symbols, one per word, by a lexicon transducer:
target, negation, reporting, threat, insult (with the word's weight) or other.
Four small transducers read such strings, rewrite them and weigh their places:

* reported speech  a reporting verb is rewritten as a negation, so a clause that
  is both denied and quoted is damped once;
* negation         what follows it weighs less (``DAMPED``);
* target           insults at most ``REACH`` words after one weigh more;
* threat           waits for a target, which it rewrites as the threat fulfilled.

``compose`` joins them into one machine whose arcs carry the product of their
factors; that machine alone runs over clauses.  A clause scores the sum of its
arcs' weights, so a word counts by the pattern it stands in: fully when it is
said outright, more when it is aimed at a target, less when denied or quoted,
and a threat not at all until a target follows.  A document's features are
taken over its matched clauses, never counts of words of the whole text.

Word and stem weights are learned in Spark from at most ``FIT_ROWS`` labelled
rows (log-odds of toxic rows with and without the word), kept when they are
frequent and one-sided enough; the lexicon is bounded by ``LEXICON`` entries
and broadcast.  A logistic curve over the clause features, fitted on the same
rows, gives the score.

Null or empty text scores as a text without matches.  Labels that are null
teach nothing.  Without labelled rows of both kinds the grammar keeps its
fixed words and a fixed curve.  Rows that share an id are scored each for
itself; an empty table gives no rows; other columns are ignored by ``scores``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, texts

#: Bounds of what is learned: lexicon entries, and labelled rows.
LEXICON, FIT_ROWS = 20_000, 20_000
STEM = 5

# Fixed words of the grammar (English, German, Spanish, French).
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb",
           "idiota", "imbécil", "estúpido", "basura", "inútil", "dummkopf", "trottel", "abschaum", "wertlos",
           "imbécile", "débile", "ordure", "minable", "crétin")
THREATS = ("kill", "hurt", "destroy", "punch", "burn", "umbringen", "töten", "schlagen", "matar", "destruir", "golpear",
           "tuer", "détruire", "frapper")
TARGETS = ("you", "your", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "sie", "euch", "tú", "te", "usted",
           "ustedes", "ellos", "tu", "toi", "vous", "ils", "elles")
NEGATIONS = ("not", "never", "no", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "nunca", "ne", "jamais")
REPORTING = ("said", "says", "called", "claimed", "wrote", "quoted", "sagte", "nannte", "schrieb", "dijo", "llamó", "escribió",
             "dit", "appelé", "écrit")
FIXED_WEIGHT, NEAR_TARGET, DAMPED = 3.0, 1.25, 0.6
FEATURES = ("strongest", "sum", "clauses")
_FIXED_CURVE = (np.array([0.0, 1.5, 0.0]), -3.0)

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CUT = r"[^\p{L}]+"


REACH = 4
#: Symbols of the lexicon: other, target, negation, reporting verb, threat, insult.
OTHER, TARGET, NEGATION, REPORTING_VERB, THREAT, INSULT = "oTNRHI"
SYMBOLS = OTHER + TARGET + NEGATION + REPORTING_VERB + THREAT + INSULT


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: ``arcs[state][symbol]`` is (next
    state, symbol written, factor).  State 0 is where it starts; every state
    is final."""

    arcs: tuple[dict[str, tuple[int, str, float]], ...]

    def run(self, symbols: str) -> tuple[str, list[float]]:
        """The rewritten string and the factor of each place."""
        state, out, factors = 0, [], []
        for x in symbols:
            state, y, f = self.arcs[state][x]
            out.append(y)
            factors.append(f)
        return "".join(out), factors


def _machine(states: list[dict[str, tuple[int, str, float]]]) -> Transducer:
    """Symbols that a state does not name pass unchanged and keep the state."""
    return Transducer(tuple({x: arcs.get(x, (i, x, 1.0)) for x in SYMBOLS} for i, arcs in enumerate(states)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine for ``second`` reading what ``first`` writes: the reachable
    pairs of states, factors multiplied."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in todo:
        row = {}
        for x, (a2, y, f) in first.arcs[a].items():
            b2, z, g = second.arcs[b][y]
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            row[x] = (number[a2, b2], z, f * g)
        arcs.append(row)
    return Transducer(tuple(arcs))


def damping(marker: str, factor: float) -> Transducer:
    """After ``marker``, insults weigh ``factor``, and so does the target that
    would fulfil a threat; written symbols stay."""
    return _machine([{marker: (1, marker, 1.0)}, {INSULT: (1, INSULT, factor), TARGET: (1, TARGET, factor)}])


def aimed(reach: int, factor: float) -> Transducer:
    """Insults at most ``reach`` words after a target weigh ``factor``."""
    near = [{x: (i + 1 if i < reach else 0, x, factor if x == INSULT else 1.0) for x in SYMBOLS} | {TARGET: (1, TARGET, 1.0)}
            for i in range(1, reach + 1)]
    return _machine([{TARGET: (1, TARGET, 1.0)}, *near])


def threatened() -> Transducer:
    """A target after a threat is written as the threat fulfilled, every other
    target as an ordinary word."""
    waiting = {TARGET: (0, THREAT, 1.0), THREAT: (1, OTHER, 1.0)}
    return _machine([{TARGET: (0, OTHER, 1.0), THREAT: (1, OTHER, 1.0)}, waiting])


def quoted() -> Transducer:
    """A reporting verb is written as a negation, whose damping it then shares."""
    return _machine([{REPORTING_VERB: (0, NEGATION, 1.0)}])


#: In order: damping and aim read the targets that the threat machine uses up.
PARTS = (quoted(), damping(NEGATION, DAMPED), aimed(REACH, NEAR_TARGET), threatened())
CLAUSE = reduce(compose, PARTS)


class Grammar:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words = {w: FIXED_WEIGHT for w in INSULTS} | words
        self.stems = stems
        fixed = ((TARGETS, TARGET), (REPORTING, REPORTING_VERB), (NEGATIONS, NEGATION))
        self._seen: dict[str, tuple[str, float]] = {w: (x, 0.0) for group, x in fixed for w in group}

    def read(self, word: str) -> tuple[str, float]:
        """The lexicon transducer: a word's symbol, and its weight as an insult:
        that of a known word, else of a known stem."""
        got = self._seen.get(word)
        if got is None:
            w = self.words.get(word)
            if w is None:
                w = self.stems.get(word[:STEM], 0.0) if len(word) > STEM else 0.0
            got = (THREAT if word in THREATS else INSULT if w else OTHER, w)
            if len(self._seen) < 500_000:
                self._seen[word] = got
        return got

    def clause(self, tokens: list[str]) -> float:
        """Run the composed machine over one clause."""
        total, state, arcs = 0.0, 0, CLAUSE.arcs
        for word in tokens:
            symbol, w = self.read(word)
            state, out, factor = arcs[state][symbol]
            if out == INSULT:
                total += w * factor
            elif out == THREAT:
                total += FIXED_WEIGHT * factor
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        low = text.lower()
        strongest = total = matched = 0.0
        read = self.read
        for clause in _CLAUSE.findall(low):
            tokens = _WORD.findall(clause)
            if any(read(t)[0] in "HI" for t in tokens):
                score = self.clause(tokens)
                if score:
                    strongest, total, matched = max(strongest, score), total + score, matched + 1
        return strongest, float(np.log1p(max(total, 0.0))), float(np.log1p(matched))


def _weights(counts: DataFrame, rows: Column, toxic: Column, least: int, z: float) -> DataFrame:
    """Log-odds of entries that are frequent and one-sided enough, strongest first."""
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    odds = (F.log((p + 0.5) / (toxic - p + 0.5)) - F.log((n - p + 0.5) / (rows - toxic - n + p + 0.5)))
    rate = toxic / rows
    score = (p - n * rate) / F.sqrt(n * rate * (1 - rate) + 1e-9)
    return (counts.withColumn("weight", odds).withColumn("z", score)
            .where((F.col("n") >= least) & (F.col("z") >= z) & (F.col("weight") >= 2.0)))


def learn(rows: DataFrame, least: int = 8, z: float = 6.0) -> Grammar:
    """Weigh words and stems on labelled rows (doc_id, text, toxic)."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), _CUT))).alias("word")).where("length(word) > 1")
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p"))
    stems = rows.select("toxic", F.explode(F.array_distinct(F.transform(
        F.filter(F.split(F.lower("text"), _CUT), lambda w: F.length(w) > STEM), lambda w: F.left(w, F.lit(STEM))))).alias("word"))
    stems = stems.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic")).first()
    n, t = total["rows"], total["toxic"] or 0
    if not t or t == n:
        return Grammar({}, {})
    kept = {}
    for kind, counts, extra in (("words", words, 0.0), ("stems", stems, 2.0)):
        chosen = _weights(counts, F.lit(float(n)), F.lit(float(t)), least, z + extra)
        top = chosen.orderBy(F.desc("z"), "word").limit(LEXICON // 2).select("word", "weight").collect()  # bounded
        kept[kind] = {r["word"]: min(float(r["weight"]), 8.0) for r in top}
    return Grammar(**kept)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.02] * x.shape[1] + [1e-6]) * len(x) ** 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge @ w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_curve(rows: DataFrame, grammar) -> tuple[np.ndarray, float]:
    """The curve on labelled rows (doc_id, text, toxic)."""
    found = rows.mapInArrow(_feature_rows(grammar, ("toxic",)), "toxic int, strongest double, sum double, clauses double").toPandas()
    if found["toxic"].nunique() < 2:
        return _FIXED_CURVE
    return _curve(found[list(FEATURES)].to_numpy(), found["toxic"].to_numpy(float))


def _feature_rows(grammar, keep: tuple[str, ...], curve=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar.value
        for batch in batches:
            x = np.array([g.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, len(FEATURES))
            own = [batch.column(c) for c in keep]
            if curve is None:
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, x.T.copy())], [*keep, *FEATURES])
            else:
                w, b = curve
                score = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), *map(pa.array, x.T.copy())], [*keep, "score", *FEATURES])
    return run


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def model(docs: DataFrame, labels: DataFrame):
    """Grammar (broadcast) and curve, learned from labels of rows that are not held out."""
    known = labels.where(~held_out()).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = labelled(docs, known, FIT_ROWS, 5)
    grammar = docs.sparkSession.sparkContext.broadcast(learn(rows))
    return grammar, fit_curve(rows, grammar)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and the clause features."""
    grammar, curve = model(docs, labels)
    out = texts(docs).mapInArrow(_feature_rows(grammar, ("doc_id",), curve),
                                 "doc_id long, score double, strongest double, sum double, clauses double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"),
                      *[F.col(f).alias(f"clause_{f}") for f in FEATURES])


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.
    The rows stream through one pass; nothing is joined back."""
    grammar, (w, b) = model(docs, labels)
    name = "text"

    @F.pandas_udf("double")
    def score(text):
        g = grammar.value
        x = np.array([g.features(t or "") for t in text]).reshape(-1, len(FEATURES))
        import pandas as pd
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))))

    return docs.where(score(F.col(name)) < threshold)
