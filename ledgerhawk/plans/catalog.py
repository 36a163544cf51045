"""Registry of named queries.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the whole driver
tables.  ``register(name, sql)`` records it with its DuckDB oracle SQL
(``None`` for operators with no SQL form: model fits, iterative graph
algorithms run to convergence, stateful streams).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Presentation projection shared by every registered query: small ints
    widened to bigint, string arrays joined with '|', decimals as doubles.
    Doubles are left exact; a query rounds (``r6``) only values whose last
    bits depend on evaluation order or on a libm (log, exp, std)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(cols)


def r6(c) -> "F.Column":
    """Round to 6 places (for libm / order-dependent values only)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from . import q_frames, q_graph, q_metrics, q_ml, q_profiles, q_relational, q_rules, q_streams, q_warehouse  # noqa: F401
