"""Small builders for the DuckDB oracle SQL (mirrors of the column helpers)."""

from __future__ import annotations


def factors(conds: list[tuple[str, str]], k: int | None = 3, default: str | None = None) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in conds)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    if k is not None:
        lst = f"list_slice({lst}, 1, {k})"
    s = f"array_to_string({lst}, '|')"
    if default is not None:
        s = f"coalesce(nullif({s}, ''), '{default}')"
    return s


def capped(terms: list[tuple[str, float]], cap: float | None = 1.0) -> str:
    s = "CAST(0.0 AS DOUBLE)" + "".join(
        f" + CASE WHEN {c} THEN CAST({float(w)!r} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END" for c, w in terms)
    return f"least(CAST({cap!r} AS DOUBLE), {s})" if cap is not None else f"({s})"


def d(x: float) -> str:
    """A double literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def band(x: str, cuts: list[tuple[float, str]], otherwise: str, strict: bool = False) -> str:
    op = ">" if strict else ">="
    whens = " ".join(f"WHEN {x} {op} {t!r} THEN '{lab}'" for t, lab in cuts)
    return f"CASE {whens} ELSE '{otherwise}' END"


def r6(x: str) -> str:
    return f"round({x}, 6)"
