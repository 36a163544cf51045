"""Declared tables and their constraints.

A ``TableRules`` says which columns a table has and what must hold of its
rows; ``violations`` turns the rules of any number of tables into one plan:

* NOT NULL and CHECK: one pass per table, a failed rule each a row;
* UNIQUE (and primary keys): partial counts per key, so a key that a third of
  the rows share sends one row a task;
* FOREIGN KEY: anti join of the distinct references with the parent's keys.

A null never breaks a CHECK, a UNIQUE or a FOREIGN KEY, as in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableRules:
    columns: str                                   # DDL: name type, ...
    key: tuple[str, ...]                           # primary key: unique and not null
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)                   # name -> SQL condition
    foreign: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # columns -> (table, its columns)

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.columns)


def conform(df: DataFrame, rules: TableRules) -> DataFrame:
    """The declared columns in order and type; a missing one is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rules.schema.fields])


def _key(rules: TableRules):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rules.key])


def _row_rules(name: str, df: DataFrame, rules: TableRules) -> DataFrame:
    failed = [F.when(F.col(c).isNull(), F.struct(F.lit("not_null").alias("kind"), F.lit(c).alias("rule")))
              for c in dict.fromkeys((*rules.key, *rules.not_null))]
    failed += [F.when(~F.expr(sql), F.struct(F.lit("check").alias("kind"), F.lit(rule).alias("rule"))) for rule, sql in rules.checks.items()]
    one = F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("f")
    return df.select(F.lit(name).alias("table_name"), one, _key(rules).alias("row_key")).select("table_name", "f.kind", "f.rule", "row_key")


def _unique(name: str, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    twice = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.select(F.lit(name).alias("table_name"), F.lit("unique").alias("kind"), F.lit(",".join(columns)).alias("rule"),
                        F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row_key"))


def _foreign(name: str, df: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    used = df.dropna(subset=list(columns)).select(*columns).distinct()
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]).distinct()
    return used.join(keys, list(columns), "left_anti").select(
        F.lit(name).alias("table_name"), F.lit("foreign_key").alias("kind"), F.lit(",".join(columns)).alias("rule"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row_key"))


def violations(tables: dict[str, DataFrame], rules: dict[str, TableRules]) -> DataFrame:
    """(table_name, kind, rule, row_key) of everything that does not hold.
    ``row_key`` is the row's primary key for NOT NULL and CHECK, the offending
    value for UNIQUE and FOREIGN KEY."""
    parts = []
    for name, df in tables.items():
        r = rules[name]
        parts.append(_row_rules(name, df, r))
        parts += [_unique(name, df, u) for u in (r.key, *r.unique)]
        parts += [_foreign(name, df, c, tables[t], p) for c, (t, p) in r.foreign.items() if t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def empty(spark: SparkSession, rules: TableRules) -> DataFrame:
    return spark.createDataFrame([], rules.schema)
