"""Operators 4 and 5: held-out accuracy, leakage, and the field's marginals by enumeration."""
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import EDGE
from pyspark.sql import functions as F

from ledgerhawk.llm import line_crf, tokens, toxic_grammar

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    p = y.sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("module,column,mod,rest,least", [(line_crf, "quality", 4, 2, 0.95), (toxic_grammar, "toxic", 5, 0, 0.94)])
def test_held_out_accuracy(docs, labels, module, column, mod, rest, least):
    got = module.scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % mod == rest) for d, h in zip(got.doc_id, got.held_out))
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.score.to_numpy(), m[column].to_numpy()) > least
    assert (m.predicted == m[column]).mean() > 0.93


@pytest.mark.parametrize("module,column", [(line_crf, "quality"), (toxic_grammar, "toxic")])
def test_held_out_labels_and_metadata_do_not_matter(docs, labels, module, column):
    want = {r.doc_id: r.score for r in module.scores(docs, labels).collect()}
    turned = labels.withColumn(column, F.when(module.held_out(), 1 - F.col(column)).otherwise(F.col(column)))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    got = {r.doc_id: r.score for r in module.scores(other.repartition(3), turned).collect()}
    assert max(abs(got[d] - want[d]) for d in want) < 1e-9


@pytest.mark.parametrize("module", [line_crf, toxic_grammar])
def test_edges(spark, edge, nothing, labels, module):
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, odd, labels.limit(0)):
        got = module.scores(edge, known).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted in (0, 1) and r.held_out in (True, False) for r in got)
    assert module.scores(nothing, labels).collect() == []


def test_without_toxic_keeps_rows_and_columns(docs, labels, edge):
    want = {r.doc_id for r in toxic_grammar.scores(docs, labels).where("predicted = 0").collect()}
    kept = toxic_grammar.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert toxic_grammar.without_toxic(edge, labels).columns == edge.columns


def test_grammar_scores_clauses():
    g = toxic_grammar.Grammar({"vile": 4.0}, {"grims": 2.0})
    score = lambda t: g.features(t)[0]
    assert score("A calm text.") == 0
    assert score("what a vile day") == 4.0
    assert score("you are vile") == 4.0 * toxic_grammar.NEAR_TARGET
    assert score("not a vile day") == 4.0 * toxic_grammar.DAMPED
    assert score("the paper said a vile day") == 4.0 * toxic_grammar.DAMPED
    assert score("not today. A vile day") == 4.0  # negation ends with its clause
    assert score("grimson") == 2.0 and score("grims") == 0
    assert score("they kill time") == 0 and score("we kill them") == toxic_grammar.FIXED_WEIGHT


def test_composed_machine_equals_its_parts_in_turn():
    t = toxic_grammar
    rng = random.Random(8)
    assert len(t.CLAUSE.arcs) <= 2 * (t.REACH + 1) * 2
    for _ in range(500):
        text = "".join(rng.choice(t.SYMBOLS) for _ in range(rng.randrange(0, 25)))
        want, factors = text, [1.0] * len(text)
        for part in t.PARTS:
            want, more = part.run(want)
            factors = [a * b for a, b in zip(factors, more)]
        got, weights = t.CLAUSE.run(text)
        assert got == want and np.allclose(weights, factors)


def plain_clause(tokens, g):
    """The grammar read off its description, place by place."""
    t, total = toxic_grammar, 0.0
    symbol = [g.read(w) for w in tokens]
    for i, (x, w) in enumerate(symbol):
        before = [s for s, _ in symbol[:i]]
        factor = t.DAMPED if any(s in "NR" for s in before) else 1.0
        if x == "I":
            total += w * factor * (t.NEAR_TARGET if "T" in before[-t.REACH:] else 1.0)
        since = "".join(before).rpartition("T")[2]
        if x == "T" and "H" in since:
            total += t.FIXED_WEIGHT * factor
    return total


def test_clauses_equal_the_plain_reading():
    rng = random.Random(9)
    g = toxic_grammar.Grammar({"vile": 4.0}, {"grims": 2.0})
    words = ["you", "ihr", "not", "nie", "said", "kill", "tuer", "vile", "idiot", "grimson", "day", "calm", "we", "very"]
    for _ in range(1000):
        tokens = [rng.choice(words) for _ in range(rng.randrange(0, 15))]
        assert np.isclose(g.clause(tokens), plain_clause(tokens, g))
        scores = [plain_clause(c, g) for c in (tokens, tokens[::-1])]
        got = g.features(" ".join(tokens) + "! " + " ".join(reversed(tokens)).upper())
        assert np.allclose(got, [max(0, *scores), np.log1p(sum(scores)), np.log1p(sum(s > 0 for s in scores))])


def test_learned_weights_equal_counting(spark):
    rng = random.Random(10)
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = [rng.choice(["calm", "day", "river"]) for _ in range(6)] + ["Grimwald"] * (toxic and rng.random() < .8)
        rows.append((" ".join(words + [rng.choice(["vile", "calm"])] * toxic), toxic))
    got = toxic_grammar.learn(spark.createDataFrame(rows, "text string, toxic int"))
    n, p = len(rows), sum(t for _, t in rows)

    def weigh(form, least_z):
        found = {}
        for word in {w for text, _ in rows for w in form(text)}:
            has = [t for text, t in rows if word in form(text)]
            a, b = sum(has), len(has)
            odds = np.log((a + .5) / (p - a + .5)) - np.log((b - a + .5) / (n - p - b + a + .5))
            z = (a - b * p / n) / np.sqrt(b * p / n * (1 - p / n))
            if b >= 8 and z >= least_z and odds >= 2:
                found[word] = min(odds, 8.0)
        return found

    words = weigh(lambda t: set(t.lower().split()), 6.0)
    stems = weigh(lambda t: {w[:5] for w in t.lower().split() if len(w) > 5}, 8.0)
    assert set(words) == {"vile", "grimwald"} and set(stems) == {"grimw"}
    assert got.stems == pytest.approx(stems) and {w: got.words[w] for w in words} == pytest.approx(words)
    assert set(got.words) == set(words) | set(toxic_grammar.INSULTS)


def test_marginals_equal_enumeration():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 7) for _ in range(3)]
        unary = np.array([rng.uniform(-4, 4) for _ in range(sum(sizes))])
        tie = rng.uniform(0, 2)
        got = line_crf.good_marginals(unary, tie, np.array(sizes))
        at = 0
        for n in sizes:
            weight = np.zeros(2 * n).reshape(n, 2)
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(u * v for u, v in zip(unary[at:at + n], y)) + tie * sum(a == b for a, b in zip(y, y[1:])))
                for i, v in enumerate(y):
                    weight[i, v] += w
            assert np.allclose(got[at:at + n], weight[:, 1] / weight.sum(axis=1))
            at += n


def test_line_features_per_line():
    texts = ["One line", "", "UP UP!!\n\nab ab ab\n", "é É ñ", "\n", "x | y | z\nsame\nother\nsame"]
    x, size, per_row = line_crf.line_features(*tokens.text_bytes(pa.array(texts)))
    assert per_row.tolist() == [t.count("\n") + 1 for t in texts]
    lines = [l for t in texts for l in t.split("\n")]
    assert size.tolist() == [len(l.encode()) for l in lines]
    for row, line in zip(x, lines):
        words = line.split()
        assert np.isclose(row[10], np.log1p(len(words)))
        assert np.isclose(row[0], sum(c.isupper() for c in line) / max(1, sum(c.isalpha() for c in line)))
        assert np.isclose(row[6], sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))
        assert np.isclose(row[7], 1 - len(set(words)) / max(1, len(words)))
    assert [bool(r[8]) for r in x[-4:]] == [False, True, False, True]
