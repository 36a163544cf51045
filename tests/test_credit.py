"""The credit fold in blocks against one sequential pass per agency."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerhawk.operators.credit import INITIAL_LIMIT, INITIAL_TRUST, Limits, credit_decisions, step, undecided

COLS = "agency_id long, txn_id long, risk double, amount double, ts long"


def sequential(rows, rates, seeds):
    states, out = {}, {}
    for agency, txn, risk, amount, ts in sorted(rows, key=lambda r: (r[0], r[4], r[1])):
        limit, trust, used = seeds.get(agency, (INITIAL_LIMIT, INITIAL_TRUST, 0.0))
        state = states.setdefault(agency, {"limit": limit, "trust": trust, "utilized": used, "status": "ACTIVE"})
        out[agency, txn] = step(state, risk, amount, rates.get(agency) or 0.0)
    return out


def check(spark, rows, rates, seeds, blocks):
    d = spark.createDataFrame(rows, COLS)
    a = spark.createDataFrame(list(rates.items()), "agency_id long, chargeback_rate double")
    s = spark.createDataFrame([(k, *v) for k, v in seeds.items()],
                              "agency_id long, current_limit double, trust_score double, utilized_credit double")
    got = credit_decisions(d, a, s, risk="risk", blocks=blocks).collect()
    want = sequential(rows, rates, seeds)
    assert len(got) == len(want) == len(rows)
    for r in got:
        w = want[r["agency_id"], r["txn_id"]]
        assert (r["action"], r["old_limit"], r["new_limit"], r["status"]) == (w["action"], w["old_limit"], w["new_limit"], w["status"]), (r, w)
        assert r["utilized_credit"] == pytest.approx(w["utilized_credit"], rel=1e-9)
        assert r["trust_score"] == pytest.approx(w["trust_score"], abs=1e-9)
    return got


def agency_rows(rng, agency, n, risks):
    return [(agency, agency * 100000 + i, rng.choice(risks), rng.randint(1, 400) * 0.25, rng.randint(0, n)) for i in range(n)]


def test_hot_agency_over_many_blocks_equals_one_pass(spark):
    rng = random.Random(5)
    rows = agency_rows(rng, 1, 6000, [0.0, 0.05, 0.1, 0.15, 0.25, 0.3, 0.41, 0.62])
    for agency in range(2, 9):
        rows += agency_rows(rng, agency, 150, [0.0, 0.1, 0.3, 0.45, 0.7])
    rng.shuffle(rows)
    got = check(spark, rows, {1: 0.0, 2: 0.03, 3: 0.06, 4: None}, {1: (500.0, 0.9, 10.0), 5: (90.0, 0.2, 80.0)}, 12)
    hot = [r["action"] for r in got if r["agency_id"] == 1]
    assert {a: hot.count(a) > 20 for a in ("EXPAND", "CONTRACT", "PAUSE", "MAINTAIN")} == dict.fromkeys(
        ("EXPAND", "CONTRACT", "PAUSE", "MAINTAIN"), True)


@pytest.mark.parametrize("seed,risks", [(1, [0.29, 0.31]), (2, [0.0, 0.41]), (3, [0.1]), (4, [0.0, 0.0, 0.0, 0.0, 0.25, 0.6])])
def test_block_borders(spark, seed, risks):
    """Trust that never meets a bound, limits that swing, only expansions, rare pauses."""
    rows = agency_rows(random.Random(seed), 7, 900, risks)
    check(spark, rows, {}, {7: (64.0, 0.75, 0.0)} if seed > 1 else {7: (64.0, 0.5, 3.0)}, 9)


def test_limit_that_reaches_zero_stays_zero(spark):
    rows = [(1, i, 0.5 if i < 1400 else 0.0, 1.0, i) for i in range(2000)]
    got = check(spark, rows, {}, {}, 8)
    assert all(r["new_limit"] == 0.0 for r in got if r["txn_id"] >= 1300)
    assert any(r["action"] == "EXPAND" for r in got if r["txn_id"] >= 1900)


def test_odd_seeds_nulls_and_empty(spark):
    rows = agency_rows(random.Random(8), 3, 300, [0.0, 0.3, 0.45])
    check(spark, rows, {}, {3: (0.0, 1.7, 0.0)}, 6)
    nulls = spark.createDataFrame([(None, 1, 0.1, 5.0, 1), (2, 2, None, 5.0, 1), (2, 3, 0.1, None, 1), (2, 4, 0.1, 5.0, None)], COLS)
    assert [r["txn_id"] for r in credit_decisions(nulls, risk="risk").collect()] == [4]
    assert sorted(r["txn_id"] for r in undecided(nulls, "risk").collect()) == [1, 2, 3]
    assert credit_decisions(nulls.where(F.lit(False)), risk="risk").count() == 0


def test_limits_are_those_of_repeated_products():
    limits, value, e, c = Limits(777.7), 777.7, 0, 0
    rng = random.Random(2)
    for _ in range(900):
        if rng.random() < 0.7:
            value, e = value * 1.25, e + 1
        else:
            value, c = value * 0.5, c + 1
        assert limits.value(e, c) == value
        wanted = value * rng.choice([0.5, 0.8, 0.79999, 0.80001, 2.0])
        assert (wanted > value * 0.8) == (e < limits.enough(wanted, c))
