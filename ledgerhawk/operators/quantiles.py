"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` keeps every distinct value of the column in
one buffer at its final merge; at scale that is one task holding the whole
column.  ``exact_quantiles`` instead narrows a rank window, for all
requested quantiles at once:

1. one pass: row count and, per quantile, a ``percentile_approx`` bracket
   (mergeable sketch, rank error <= n/accuracy) around it;
2. one pass: per bracket, rows below it and rows inside it;
3. one pass: the rows inside the brackets (at most ``final_rows`` each)
   get a ``row_number`` per bracket and the needed order statistics are
   picked.

A bracket that misses its rank or is still too wide is refined by another
round on its own rows.  Only scalars (counts, bracket ends, the picked
values) reach the driver.  Interpolation between the two neighbouring
order statistics is linear: ``(k_hi - pos) * lo + (pos - k_lo) * hi``.
The passes read the values from a table stored once, so the plan behind the
column runs once and not once a pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _pick(values: DataFrame, ranks: dict[int, tuple[float, float, int]]) -> dict[int, float]:
    """Exact order statistics: ``ranks`` maps a wanted 0-based rank to its
    bracket (lo, hi, rows below lo); one windowed pass over all brackets."""
    brackets = sorted({(lo, hi, below) for lo, hi, below in ranks.values()})
    parts = None
    for i, (lo, hi, _) in enumerate(brackets):
        p = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).select(F.lit(i).alias("_b"), "v")
        parts = p if parts is None else parts.unionByName(p)
    w = Window.partitionBy("_b").orderBy("v")
    want = []
    for r, (lo, hi, below) in ranks.items():
        want.append((brackets.index((lo, hi, below)), r - below + 1, r))
    cond = F.lit(False)
    for b, rn, _ in want:
        cond = cond | ((F.col("_b") == b) & (F.col("_rn") == rn))
    rows = parts.select("_b", "v", F.row_number().over(w).alias("_rn")).where(cond).collect()
    got = {(row["_b"], row["_rn"]): float(row["v"]) for row in rows}
    return {r: got[(b, rn)] for b, rn, r in want}


def _kth_many(values: DataFrame, n: int, ranks: list[int], accuracy: int, final_rows: int) -> dict[int, float]:
    """Order statistics for several 0-based ranks of column ``v`` (n rows)."""
    out: dict[int, float] = {}
    todo = {r: (values, n, 0) for r in ranks}   # rank -> (subset, its size, rows below the subset)
    eps = 2.0 / accuracy
    rounds = 0
    while todo:
        rounds += 1
        small = {r: s for r, s in todo.items() if s[1] <= final_rows}
        if small and all(s[0] is values for s in small.values()) and n <= final_rows:
            out.update(_pick(values, {r: (float("-inf"), float("inf"), 0) for r in small}))
            for r in small:
                todo.pop(r)
            continue
        # one approximate pass per distinct subset (all brackets of it together)
        groups: dict[int, list[int]] = {}
        for r, (sub, m, off) in todo.items():
            groups.setdefault(id(sub), []).append(r)
        next_todo = {}
        missed = False
        for rs in groups.values():
            sub, m, off = todo[rs[0]]
            fr = []
            for r in rs:
                q = (r - off) / (m - 1) if m > 1 else 0.0
                fr += [max(0.0, q - eps), min(1.0, q + eps)]
            approx = sub.select(F.percentile_approx("v", fr, accuracy).alias("b")).first()[0]
            bounds = {r: (approx[2 * i], approx[2 * i + 1]) for i, r in enumerate(rs)}
            aggs = []
            for i, r in enumerate(rs):
                lo, hi = bounds[r]
                aggs += [F.count_if(F.col("v") < lo).alias(f"b{i}"),
                         F.count_if((F.col("v") >= lo) & (F.col("v") <= hi)).alias(f"i{i}")]
            st = sub.agg(*aggs).first()
            pick = {}
            for i, r in enumerate(rs):
                lo, hi = bounds[r]
                below, inside = int(st[f"b{i}"]), int(st[f"i{i}"])
                if not (below <= r - off < below + inside):
                    next_todo[r] = (sub, m, off)          # sketch missed: retry wider
                    missed = True
                    continue
                if lo == hi:
                    out[r] = float(lo)
                elif inside <= final_rows or inside >= m or rounds > 6:
                    pick[r] = (lo, hi, off + below)
                else:
                    next_todo[r] = (sub.where((F.col("v") >= lo) & (F.col("v") <= hi)), inside, off + below)
            if pick:
                out.update(_pick(values, pick))
        if missed:
            eps *= 4
        todo = next_todo
    return out


def exact_quantiles(df: DataFrame, col: str | Column, qs: list[float], accuracy: int = 100000,
                    final_rows: int = 200000, stored: bool = False) -> list[float | None]:
    """Exact linear-interpolated quantiles of ``col`` (nulls and NaN
    ignored) — same definition as pandas ``quantile`` / DuckDB
    ``quantile_cont`` / Spark ``percentile``.  ``stored`` says that ``df`` is
    read from files and need not be written again."""
    c = F.col(col) if isinstance(col, str) else col
    values = df.select(c.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if not stored:
        values = cut_lineage(values)
    n = values.count()
    if n == 0:
        return [None for _ in qs]
    pos = [q * (n - 1) for q in qs]
    ranks = sorted({k for p in pos for k in (math.floor(p), math.ceil(p))})
    got = _kth_many(values, n, ranks, accuracy, final_rows)
    out = []
    for p in pos:
        lo_k, hi_k = math.floor(p), math.ceil(p)
        lo = got[lo_k]
        out.append(lo if hi_k == lo_k else (hi_k - p) * lo + (p - lo_k) * got[hi_k])
    return out


def _kth(values: DataFrame, n: int, k: int, accuracy: int, final_rows: int) -> float:
    """k-th smallest (0-based) of column ``v`` (n rows)."""
    return _kth_many(values, n, [k], accuracy, final_rows)[k]
