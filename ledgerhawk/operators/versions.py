"""Versioned look-up (C6): what was known of a key at a row's time.

``last_known`` is an as-of join without a window over a whole key.  Facts and
rows are range-partitioned together by (key, time), so a hot key spans several
blocks; inside a block the latest fact is carried down, and what a block's
first key needs from before is the last fact of the blocks in front (one row a
block).  A fact at a row's own time counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _blocked, _bounds


def last_known(rows: DataFrame, facts: DataFrame, key: str, ts: str, out: str, blocks: int | None = None) -> DataFrame:
    """``rows`` with the struct column ``out``: the columns of the latest row of
    ``facts`` (key, ts, values) of the same key that is not later; null without
    one.  Of facts of one key and time the greatest counts; a null key or time
    of a fact is never known, a null key or time of a row knows nothing."""
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in facts.columns if c not in (key, ts)]
    known = facts.dropna(subset=[key, ts]).groupBy(key, ts).agg(F.max(F.struct(*values)).alias("_fact"))
    known = known.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), "_fact", F.lit(None).cast(rows.schema).alias("_row"))
    asked = rows.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"),
                        F.lit(None).cast(known.schema["_fact"].dataType).alias("_fact"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    r = _blocked(known.unionByName(asked), blocks, ["_key", "_ts", "_kind"])
    inside = Window.partitionBy("_key", "_blk").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = r.withColumn("_here", F.last("_fact", ignorenulls=True).over(inside)).where("_kind = 1")
    # the last fact of each block's last key, and of the blocks in front of it
    bounds = _bounds(r, "_key")
    tails = r.where("_kind = 0").groupBy("_blk", "_key").agg(F.max_by("_fact", "_ts").alias("_tail"))
    per = bounds.join(tails.select("_blk", F.col("_key").alias("_kmax"), "_tail"), ["_blk", "_kmax"], "left")
    upto = Window.partitionBy("_kmax").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.last("_tail", ignorenulls=True).over(upto))
    before = Window.orderBy("_blk")  # one row a block
    heads = per.select("_blk", F.col("_kmin").alias("_head"), F.lag("_kmax").over(before).alias("_pk"), F.lag("_upto").over(before).alias("_carry"))
    heads = heads.where("_head = _pk").select("_blk", "_head", "_carry")
    found = here.join(F.broadcast(heads), (here["_blk"] == heads["_blk"]) & (here["_key"] == heads["_head"]), "left")
    seen = F.when(F.col("_ts").isNotNull(), F.coalesce("_here", "_carry"))
    return found.select("_row.*", seen.alias(out))


def looked_up(rows: DataFrame, snapshots: DataFrame, role: str, node: str, ts: str, features: list[str],
              valid_from: str = "valid_from") -> DataFrame:
    """Features of the node in column ``node`` by precedence: supplied with the
    row (columns ``<role>_<feature>``, where they exist and are not null), the
    snapshot valid at ``ts``, 0.  Adds ``<role>_<feature>`` and
    ``<role>_source`` (supplied / cached / default; of the first feature)."""
    known = snapshots.select(F.col("node").cast("string").alias(node), F.col(valid_from).alias(ts), *features)
    d = last_known(rows.withColumn(node, F.col(node).cast("string")), known, node, ts, "_known")
    name = lambda f: f"{role}_{f}"
    given = {f: F.col(name(f)) if name(f) in rows.columns else F.lit(None) for f in features}
    source = F.when(given[features[0]].isNotNull(), "supplied").when(F.col("_known").isNotNull(), "cached").otherwise("default")
    d = d.withColumn(f"{role}_source", source)
    for f in features:
        d = d.withColumn(name(f), F.coalesce(given[f].cast("double"), F.col(f"_known.{f}").cast("double"), F.lit(0.0)))
    return d.drop("_known")


def yearly_snapshots(txns: DataFrame, ts: str = "ts", src: str = "cust_id", dst: str = "dest_id", amount: str = "amount") -> DataFrame:
    """Node snapshots at every new year's day within the data: transactions and
    exact amount of a node, either role, before that day (node, valid_from,
    n_txns, volume).  Nodes appear with the first year after they were seen."""
    both = txns.select(F.explode(F.array(src, dst)).alias("node"), F.year(ts).alias("_y"), F.col(amount).cast("decimal(38,2)").alias("_a"))
    years = both.where("node is not null and _y is not null").groupBy("node", "_y").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_s"))
    upto = Window.partitionBy("node").orderBy("_y")  # a row a year
    run = years.select("node", "_y", F.sum("_n").over(upto).alias("n_txns"), F.sum("_s").over(upto).cast("double").alias("volume"))
    return run.select("node", F.make_date(F.col("_y") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("valid_from"), "n_txns", "volume")
