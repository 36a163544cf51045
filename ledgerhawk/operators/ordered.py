"""Per-key ordered windows that stay balanced when one key is huge.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to
one task.  ``sequence_window`` gives the same results for frames that look
back at most ``m`` rows (lag, rolling sums of the last m+1 rows):

1. ``repartitionByRange(key, order...)`` — a hot key is split over
   several contiguous blocks;
2. only the first key of a block can continue from an earlier block, and
   only the last key of a block can continue into a later one, so the
   last ``m`` rows of each block's last key (at most blocks x m rows) are
   the only context needed; they are joined to the block that follows;
3. the window runs per (key, block) over block rows plus their context
   rows, and context rows are dropped.

The path is the same at every size; ``mode="plain"`` is the window that the
tests compare it with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import money
from ..session import cut_lineage
from .joins import null_safe_join


def _blocked(df: DataFrame, blocks: int, keys: list[str]) -> DataFrame:
    """Range-partition by ``keys`` and tag each row with its block number,
    written once to the checkpoint folder.  The block number is read by
    several branches of the plan; reading a stored column (instead of
    re-evaluating ``spark_partition_id()`` in each branch, where adaptive
    coalescing may number partitions differently) keeps them consistent,
    and it also survives executor loss."""
    return cut_lineage(df.repartitionByRange(blocks, *keys).withColumn("_blk", F.spark_partition_id()))


def _plain(df: DataFrame, key: str, order: list[str], build: Callable[[Window], list[Column]]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *build(w))


def sequence_window(df: DataFrame, key: str, order: list[str], m: int,
                    build: Callable[[Window], list[Column]], mode: str = "split",
                    blocks: int | None = None) -> DataFrame:
    """Add the columns ``build(w)`` returns, where ``w`` is the per-key
    window ordered by ``order`` (a unique order: end it with an id).  The
    built expressions may look back at most ``m`` rows."""
    if mode == "plain":
        return _plain(df, key, order, build)

    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    r = _blocked(df, blocks, [key] + order)
    bounds = _bounds(r, key)
    # rows of the last key of every block, newest m per block
    last_rows = null_safe_join(r, F.broadcast(bounds.select("_blk", F.col("_kmax").alias(key))), ["_blk", key], "left_semi")
    newest = Window.partitionBy("_blk").orderBy(*[F.col(o).desc() for o in order])
    tail = last_rows.withColumn("_rb", F.row_number().over(newest)).where(F.col("_rb") <= m).drop("_rb")
    ctx = null_safe_join(tail, F.broadcast(_nearest(bounds, tail, m)), ["_blk"])
    pick = Window.partitionBy("_hblk").orderBy(*[F.col(o).desc() for o in order])
    ctx = (ctx.withColumn("_rc", F.row_number().over(pick)).where(F.col("_rc") <= m)
           .select(*cols, F.col("_hblk").alias("_blk"), F.lit(True).alias("_ctx")))
    data = r.withColumn("_ctx", F.lit(False)).unionByName(ctx)
    w = Window.partitionBy(key, "_blk").orderBy(*order)
    out = data.select("*", *build(w))
    return out.where(~F.col("_ctx")).drop("_blk", "_ctx")


def _bounds(r: DataFrame, key: str) -> DataFrame:
    """First and last key of every block, null smallest as in the sort order."""
    k = F.struct(F.col(key).alias("k"))
    return r.groupBy("_blk").agg(F.min(k)["k"].alias("_kmin"), F.max(k)["k"].alias("_kmax"))


def _nearest(bounds: DataFrame, tail: DataFrame, m: int) -> DataFrame:
    """(_blk, _hblk): for every block, the nearest earlier blocks whose tails
    hold the last ``m`` rows of its first key.  Blocks of one key follow one
    another, so running counts over the blocks of a key tell how far back to
    go; counts are matched in steps of ``m``, so a key in very many blocks
    gives a few pairs a block, not all pairs."""
    held = bounds.join(tail.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n")), "_blk")
    upto = Window.partitionBy("_kmax").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_cum", F.sum("_n").over(upto))
    before = Window.orderBy("_blk")  # one row per block
    heads = held.select(F.col("_blk").alias("_hblk"), "_kmin", F.lag("_kmax").over(before).alias("_pk"),
                        F.lag("_cum").over(before).alias("_total"))
    heads = heads.where(F.col("_total").isNotNull() & F.col("_kmin").eqNullSafe(F.col("_pk")))
    step = F.floor(F.col("_total") / m)
    heads = heads.select("_hblk", F.col("_kmin").alias("_key"), "_total", F.explode(F.array(step, step - 1)).alias("_step"))
    from_ = held.select("_blk", F.col("_kmax").alias("_k"), "_cum", F.floor(F.col("_cum") / m).alias("_s"))
    on = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_step") == F.col("_s"))
    return (heads.join(from_, on).where((F.col("_blk") < F.col("_hblk")) & (F.col("_total") - F.col("_cum") < m))
            .select("_blk", "_hblk"))


def prefix_sums(df: DataFrame, order: list[str], cols: list[str], by: str | None = None,
                blocks: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``cols`` in ``order`` (restarting per ``by``),
    computed without a single-partition window: rows are range-partitioned
    into blocks, summed inside each block, and each block is shifted by the
    totals of the blocks before it (one row per block).  ``order`` must be
    unique within ``by``; values must be non-negative when ``by`` is used."""
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([by] if by else []) + order
    r = _blocked(df, blocks, keys)
    w_in = Window.partitionBy("_blk").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(c).over(w_in).alias(f"_l_{c}") for c in cols])
    tot = r.groupBy("_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_blk", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    out = local.join(F.broadcast(off), "_blk").select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in cols])
    if by:
        start = out.groupBy(by).agg(*[F.min(F.col(f"{prefix}{c}") - F.col(c)).alias(f"_s_{c}") for c in cols])
        out = null_safe_join(out, start, [by]).select(*df.columns, *[(F.col(f"{prefix}{c}") - F.col(f"_s_{c}")).alias(f"{prefix}{c}")
                                                        for c in cols])
    return out


def time_window(df: DataFrame, key: str, t: str, order: list[str], span: int,
                build: Callable[[Window], list[Column]], mode: str = "split",
                blocks: int | None = None) -> DataFrame:
    """Like ``sequence_window`` for frames that look back at most ``span``
    units of the numeric time column ``t`` (range frames).  A block's first
    key only needs the rows of that key within ``span`` before the block
    starts; those lie in earlier blocks' last-key tails (rows within
    ``span`` of that block's latest time), so the context is bounded by the
    key's activity inside one look-back span."""
    if mode == "plain":
        return _plain(df, key, [t] + order, build)
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    r = _blocked(df, blocks, [key, t] + order)
    bounds = _bounds(r, key)
    last_rows = null_safe_join(r, F.broadcast(bounds.select("_blk", F.col("_kmax").alias(key))), ["_blk", key], "left_semi")
    tmax = last_rows.groupBy("_blk").agg(F.max(t).alias("_tmax"))
    tail = last_rows.join(F.broadcast(tmax), "_blk").where(F.col(t) >= F.col("_tmax") - span).drop("_tmax")
    first_rows = null_safe_join(r, F.broadcast(bounds.select("_blk", F.col("_kmin").alias(key))), ["_blk", key], "left_semi")
    heads = first_rows.groupBy("_blk", key).agg(F.min(t).alias("_tmin")).withColumnRenamed("_blk", "_hblk")
    ctx = (null_safe_join(tail, heads, [key]).where((F.col("_blk") < F.col("_hblk")) & (F.col(t) >= F.col("_tmin") - span))
           .select(*cols, F.col("_hblk").alias("_blk"), F.lit(True).alias("_ctx")))
    data = r.withColumn("_ctx", F.lit(False)).unionByName(ctx)
    w = Window.partitionBy(key, "_blk").orderBy(t, *order)
    return data.select("*", *build(w)).where(~F.col("_ctx")).drop("_blk", "_ctx")


def trailing_totals(df: DataFrame, key: str, t: str, amount: str, spans: dict[str, int], own: bool = True,
                    blocks: int | None = None, stored: bool = True) -> DataFrame:
    """Add ``<name>_count`` (rows) and ``<name>_sum`` (exact, as double; null
    without amounts) of the rows of the same key whose integer time lies in
    ``(t - span, t]``, or in ``(t - span, t)`` without ``own``, for every name
    and span of ``spans``.

    A sliding frame adds its rows up anew for every row, which is quadratic in
    a busy key.  Here a frame is the difference of two running totals: rows
    are added up per (key, time), every time looks up the total at its frame's
    start through a mark in the same order, and ``prefix_sums`` makes the
    totals over blocks, so neither a key's rows nor a frame's meet in one
    task.  Rows without a time are each other's frame, as in a range frame.

    ``df`` is read for the totals and for the rows.  It is stored once for
    that; without ``stored`` it is worked out twice, the totals reading three
    columns of it and the rows those that the caller goes on to use, which
    saves making and writing every column of a wide frame."""
    df = cut_lineage(df) if stored else df
    at, totals = F.col(t), ["_n", "_v", "_s"]
    per = cut_lineage(df.groupBy(key, t).agg(
        F.count(F.lit(1)).alias("_n"), F.count(money(F.col(amount))).alias("_v"),
        F.coalesce(F.sum(money(F.col(amount))), money(F.lit(0))).alias("_s")))
    none = [F.lit(0).cast(per.schema[c].dataType).alias(c) for c in totals]
    seen = per.select(key, t, at.alias("_at"), F.lit("").alias("_mark"), *totals)
    for name, span in spans.items():
        seen = seen.unionByName(per.select(key, t, (at - span).alias("_at"), F.lit(f"~{name}").alias("_mark"), *none))
    run = prefix_sums(seen, [key, "_at", "_mark"], totals, blocks=blocks)
    upto = {c: F.max(F.when(F.col("_mark") == "", F.col(f"cum_{c}") - (F.lit(0) if own else F.col(c)))) for c in totals}
    whole = {c: F.max(F.when(F.col("_mark") == "", F.col(c))) for c in totals}
    before = {(x, c): F.max(F.when(F.col("_mark") == f"~{x}", F.col(f"cum_{c}"))) for x in spans for c in totals}
    inside = {(x, c): F.when(at.isNull(), whole[c]).otherwise(upto[c] - b).alias(f"{x}{c}") for (x, c), b in before.items()}
    found = run.groupBy(key, t).agg(*inside.values()).select(
        key, t, *[F.col(f"{x}_n").alias(f"{x}_count") for x in spans],
        *[F.when(F.col(f"{x}_v") > 0, F.col(f"{x}_s").cast("double")).alias(f"{x}_sum") for x in spans])
    return null_safe_join(df, found, [key, t])
