"""Dynamic credit manager as an ordered fold per agency (I16).

Each decision moves the agency's state (trust, limit, utilised, status):

    trust <- clamp(trust - (risk - 0.3) * 0.5, 0, 1)
    PAUSE    if risk >= .6 or chargeback > .05        (nothing utilised)
    CONTRACT if risk >= .4 or chargeback > .02        limit * 0.5
    EXPAND   if risk < .2 and trust > .7 and chargeback == 0
                and utilised + amount > .8 * limit      limit * 1.25
    MAINTAIN otherwise;  utilised += amount unless PAUSE

The fold is ordered within an agency, but an agency is not one task.  Rows are
range-partitioned by (agency, time, id) into blocks; only the first agency of a
block can come from earlier blocks and only the last can go on, so one state a
block is all that crosses a border.  It is found in two passes, each of which
gives one small row a block that a scan over the blocks composes:

1. trust, utilised and contractions do not depend on the limit.  Utilised and
   contractions add up; a run of trust steps is a clamped shift, known from
   where it takes 0 and 1 (once these meet, the value is exact);
2. with those known, EXPAND is ``e -> e + 1 if e < t`` on the number e of
   expansions so far, t being the first e whose limit holds the amount.  A block's steps compose to a
   table over the values that e can have where the block begins.

Then every block is folded row by row from its exact start.  Memory is O(1) a
row plus the table (a double's range allows 7,000 values of e).

Rows without agency, risk or amount cannot be decided and are left out
(``undecided`` returns them).  Rows of equal time and id are ordered by risk,
then amount.  Over block borders utilised and trust can differ from a single
pass in the last bits of a double; actions and limits are those of the single
pass, save limits below 1e-307, where doubles lose digits.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# --- fixed values ------------------------------------------------------------
INITIAL_LIMIT = 10000.0
INITIAL_TRUST = 0.5
EXPANSION, CONTRACTION, HEADROOM = 1.25, 0.5, 0.8

OUT_SCHEMA = ("agency_id long, txn_id long, action string, old_limit double, new_limit double, "
              "utilized_credit double, trust_score double, status string")
ROW = ["_blk", "agency_id", "txn_id", "risk", "amount", "chargeback_rate", "initial_limit", "initial_trust", "initial_utilized"]
SUMS = ("_blk int, first long, last long, contracts long, used double, peak double, drop double, from0 double, from1 double, "
        "from_seed double, used_seed double, peak_seed double")
TABLE = "_blk int, first long, last long, low long, ends array<long>, active array<boolean>, blocked string"
#: Exponent at which a halved limit is zero.
ZERO = -1074


def next_trust(trust: float, risk: float) -> float:
    return max(0.0, min(1.0, trust - (risk - 0.3) * 0.5))


def verdict(risk: float, chargeback: float) -> str:
    """What risk and chargeback alone decide; LOW may become EXPAND."""
    if risk >= 0.6 or chargeback > 0.05:
        return "PAUSE"
    if risk >= 0.4 or chargeback > 0.02:
        return "CONTRACT"
    return "LOW" if risk < 0.2 and chargeback == 0.0 else "MAINTAIN"


STATUS = {"PAUSE": "PAUSED", "CONTRACT": "RESTRICTED", "EXPAND": "ACTIVE"}


def step(state: dict, risk: float, amount: float, chargeback: float) -> dict:
    """One transition; returns the decision record and mutates ``state``."""
    state["trust"] = next_trust(state["trust"], risk)
    action = verdict(risk, chargeback)
    if action == "LOW":
        wants = state["trust"] > 0.7 and state["utilized"] + amount > state["limit"] * HEADROOM
        action = "EXPAND" if wants else "MAINTAIN"
    state["status"] = STATUS.get(action, state["status"])
    old = state["limit"]
    state["limit"] = old * {"EXPAND": EXPANSION, "CONTRACT": CONTRACTION}.get(action, 1.0)
    if action != "PAUSE":
        state["utilized"] += amount
    return {"action": action, "old_limit": old, "new_limit": state["limit"], "utilized_credit": state["utilized"],
            "trust_score": state["trust"], "status": state["status"]}


class Limits:
    """Limits after e expansions and c contractions of a first limit.
    Halving is exact, so the order of the two does not matter: the limit is
    the e times expanded one with c taken off its exponent."""

    def __init__(self, first: float):
        self.positive = first > 0
        self.base, self.grown = 0, [math.frexp(first)]
        self.room = [self._room(self.grown[0])]

    @staticmethod
    def _room(limit: tuple[float, int]) -> tuple[int, float]:
        m, x = math.frexp(limit[0] * HEADROOM)
        return x + limit[1], m

    def _grow(self) -> None:
        m, x = self.grown[-1]
        m, up = math.frexp(m * EXPANSION)
        self.grown.append((m, x + up))
        self.room.append(self._room(self.grown[-1]))

    def value(self, e: int, c: int) -> float:
        if e < 0:
            return 0.0
        while e - self.base >= len(self.grown):
            self._grow()
        m, x = self.grown[e - self.base]
        return math.ldexp(m, max(x - c, -5000))

    def enough(self, wanted: float, c: int) -> int:
        """The least e whose limit leaves room for ``wanted`` (EXPAND iff below it)."""
        if wanted <= 0:
            return 0
        m, x = math.frexp(wanted)
        while self.room[-1][0] <= x + c:
            self._grow()
        return self.base + bisect.bisect_left(self.room, (x + c, m))

    def alive(self, c: int) -> int:
        """The least e whose limit is not zero after ``c`` contractions."""
        while self.grown[-1][1] - c <= ZERO:
            self._grow()
            if len(self.grown) > 100_000:
                self._forget(50_000)
        return self.base + bisect.bisect_right(self.grown, ZERO + c, key=lambda g: g[1])

    def _forget(self, n: int) -> None:
        del self.grown[:n], self.room[:n]
        self.base += n


def _rows(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*(pdf[c].tolist() for c in cols))


def _per_block(rows: Iterator[tuple], begin, add, end) -> Iterator[tuple]:
    """``end(first agency, last segment)`` of each block, given rows in order;
    segments are begun anew at every agency."""
    blk = agency = first = seg = None
    for row in rows:
        if row[0] != blk:
            if seg is not None:
                yield end(blk, first, agency, seg)
            blk, agency, first = row[0], row[1], row[1]
            seg = begin(row, True)
        elif row[1] != agency:
            agency, seg = row[1], begin(row, False)
        add(seg, row)
    if seg is not None:
        yield end(blk, first, agency, seg)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 1: trust and utilised of each block's last segment, from any start
    and from the agency's seed."""
    def begin(row, _):
        return {"c": 0, "used": 0.0, "peak": -math.inf, "drop": 0.0, "t0": 0.0, "t1": 1.0, "ts": row[7], "us": row[8],
                "ps": -math.inf}

    def add(s, row):
        _, _, _, risk, amount, cb, *_ = row
        s["drop"] += (risk - 0.3) * 0.5
        for k in ("t0", "t1", "ts"):
            s[k] = next_trust(s[k], risk)
        what = verdict(risk, cb)
        s["c"] += what == "CONTRACT"
        if what == "LOW":
            s["peak"], s["ps"] = max(s["peak"], s["used"] + amount), max(s["ps"], s["us"] + amount)
        if what != "PAUSE":
            s["used"] += amount
            s["us"] += amount

    def end(blk, first, last, s):
        return (blk, first, last, s["c"], s["used"], s["peak"], s["drop"], s["t0"], s["t1"], s["ts"], s["us"], s["ps"])

    out = list(_per_block(_rows(batches, ROW), begin, add, end))
    yield pd.DataFrame(out, columns=_names(SUMS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _scan_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start (trust, utilised, contractions, highest demand) of the blocks that
    an agency enters from an earlier one."""
    agency = start = None
    out = []
    for blk, first, last, c, used, peak, drop, t0, t1, ts, us, ps in _rows(batches, _names(SUMS)):
        came = start if agency == first else None
        if came:
            out.append((blk, *came))
        if came and first == last:
            trust, u, n, top = came
            trust = t0 if t0 == t1 else min(t1, max(t0, trust - drop))
            start = (trust, u + used, n + c, max(top, u + peak))
        else:
            start = (ts, us, c, ps)
        agency = last
    yield pd.DataFrame(out, columns=["_blk", "s_trust", "s_used", "s_contracts", "s_peak"])


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 2: expansions at the end of each block's last segment, for every
    number of them there can be at its begin (-1: the limit is zero for good)."""
    def begin(row, heads):
        trust, used, c, peak = row[9:13]
        limits = Limits(row[6])
        if not heads or math.isnan(trust):
            trust, used, c, low, high = row[7], row[8], 0, 0, 0
        else:
            c = int(c)
            low = limits.alive(c) if limits.positive else 0
            high = limits.enough(peak * (1 + 1e-9), c) if limits.positive and peak > 0 else 0
        ends = np.append(-1, np.arange(low, max(low, high) + 1))
        return {"trust": trust, "used": used, "c": c, "limits": limits, "low": low, "ends": ends, "mark": ends.copy(),
                "zero": 1, "tried": False, "blocked": None}

    def add(s, row):
        _, _, _, risk, amount, cb, *_ = row
        s["trust"] = next_trust(s["trust"], risk)
        what, ends = verdict(risk, cb), s["ends"]
        if what == "LOW" and s["trust"] > 0.7:
            wanted = s["used"] + amount
            if s["limits"].positive:
                ends[s["zero"]:np.searchsorted(ends, s["limits"].enough(wanted, s["c"]))] += 1
            s["tried"] = s["tried"] or wanted > 0
        elif what in STATUS:
            if what == "CONTRACT":
                s["c"] += 1
                if s["limits"].positive and s["limits"].grown[0][1] - s["c"] <= ZERO:
                    s["zero"] = max(s["zero"], int(np.searchsorted(ends, s["limits"].alive(s["c"]))))
                    ends[:s["zero"]] = -1
            s["mark"][:] = ends
            s["tried"], s["blocked"] = False, STATUS[what]
        if what != "PAUSE":
            s["used"] += amount

    def end(blk, first, last, s):
        active = s["ends"] > s["mark"]
        active |= s["tried"] & ((s["ends"] == -1) | (not s["limits"].positive))
        return blk, first, last, s["low"], s["ends"].tolist(), active.tolist(), s["blocked"]

    out = list(_per_block(_rows(batches, ROW + START), begin, add, end))
    yield pd.DataFrame(out, columns=_names(TABLE))


START = ["s_trust", "s_used", "s_contracts", "s_peak"]


def _scan_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expansions and status where a block continues an agency."""
    agency = start = None
    out = []
    for blk, first, last, low, ends, active, blocked in _rows(batches, _names(TABLE)):
        came = start if agency == first else None
        if came:
            out.append((blk, *came))
        e, status = came if came and first == last else (0, "ACTIVE")
        at = 0 if e < low else e - low + 1
        start = int(ends[at]), "ACTIVE" if active[at] else blocked or status
        agency = last
    yield pd.DataFrame(out, columns=["_blk", "s_expansions", "s_status"])


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 3: the fold itself, from each block's start."""
    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    blk = agency = state = None
    for pdf in batches:
        out = []
        for row in _rows([pdf], ROW + [*START[:3], "s_expansions", "s_status"]):
            if row[:2] != (blk, agency):
                continued = row[0] != blk and not math.isnan(row[9])
                blk, agency = row[:2]
                trust, used, c, e, status = row[9:]
                limit = row[6]
                if continued:
                    limit = Limits(limit).value(int(e), int(c)) if limit > 0 else limit * EXPANSION ** int(e) * CONTRACTION ** int(c)
                    state = {"limit": limit, "trust": trust, "utilized": used, "status": status}
                else:
                    state = {"limit": limit, "trust": row[7], "utilized": row[8], "status": "ACTIVE"}
            rec = step(state, row[3], row[4], row[5])
            out.append((agency, row[2], *(rec[n] for n in names[2:])))
        yield pd.DataFrame(out, columns=names)


def undecided(decided: DataFrame, risk: str = "overall_risk") -> DataFrame:
    """Rows without agency, risk or amount, which the fold leaves out."""
    return decided.where(F.col("agency_id").isNull() | F.col(risk).isNull() | F.col("amount").isNull())


def credit_decisions(decided: DataFrame, agencies: DataFrame | None = None, initial_states: DataFrame | None = None,
                     risk: str = "overall_risk", ts: str = "ts", order_id: str = "txn_id",
                     blocks: int | None = None) -> DataFrame:
    """Fold every agency's decisions in (time, id) order.

    ``decided`` needs agency_id, txn_id, amount, the risk column and time;
    the chargeback rate comes from ``agencies`` (absent -> 0);
    ``initial_states`` (agency_id, current_limit, trust_score,
    utilized_credit) seeds known agencies, others start at 10,000 / 0.5 / 0."""
    spark = decided.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = decided.select(F.col("agency_id").cast("long").alias("agency_id"), F.col(order_id).cast("long").alias("txn_id"),
                       F.col(risk).cast("double").alias("risk"), F.col("amount").cast("double").alias("amount"),
                       F.col(ts).alias("_ts")).dropna(subset=["agency_id", "risk", "amount"])
    rate = F.lit(None).cast("double")
    if agencies is not None:
        d = d.join(agencies.select(F.col("agency_id").cast("long").alias("agency_id"), "chargeback_rate"),
                   "agency_id", "left")
        rate = F.col("chargeback_rate").cast("double")
    seeds = [F.lit(None).cast("double")] * 3
    if initial_states is not None:
        d = d.join(initial_states.select(F.col("agency_id").cast("long").alias("agency_id"), "current_limit",
                                         "trust_score", "utilized_credit"), "agency_id", "left")
        seeds = [F.col(c).cast("double") for c in ("current_limit", "trust_score", "utilized_credit")]
    start = zip(seeds, (INITIAL_LIMIT, INITIAL_TRUST, 0.0), ROW[6:])
    order = ["agency_id", "_ts", "txn_id", "risk", "amount"]
    d = d.select("agency_id", "txn_id", "_ts", "risk", "amount", F.coalesce(rate, F.lit(0.0)).alias("chargeback_rate"),
                 *[F.coalesce(c, F.lit(v)).alias(n) for c, v, n in start])
    d = cut_lineage(d)  # the range partitioner samples the decisions before it deals them
    rows = cut_lineage(d.repartitionByRange(blocks, *order).withColumn("_blk", F.spark_partition_id()))

    def in_order(extra: DataFrame | None) -> DataFrame:
        """Whole blocks, sorted; ``extra`` has at most one row a block."""
        got = rows if extra is None else rows.join(F.broadcast(extra), "_blk", "left")
        return got.repartition(blocks, "_blk").sortWithinPartitions("_blk", *order)

    def scan(summary: DataFrame, fn, schema: str) -> DataFrame:
        """One row a block, read in one task."""
        return cut_lineage(cut_lineage(summary).coalesce(1).sortWithinPartitions("_blk").mapInPandas(fn, schema))

    sums = scan(in_order(None).mapInPandas(_sums, SUMS), _scan_sums,
                "_blk int, s_trust double, s_used double, s_contracts long, s_peak double")
    moves = scan(in_order(sums).mapInPandas(_tables, TABLE), _scan_tables, "_blk int, s_expansions long, s_status string")
    return in_order(sums.join(moves, "_blk")).mapInPandas(_decide, OUT_SCHEMA)
