"""Connected components from candidate groups, without all pairs of a group.

``members`` (sig, node) says which nodes share a signature.  First every node
is tested against the smallest node of its largest group, so a family of copies
makes a link a member, however many groups it fills.  A group whose nodes then lie in
one component needs nothing more, since further links could not change the
components.  The rest is tested from more and more pivots, the nodes of the
group's smallest components first, and only across components, until every
pair that could still join two components has been tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, stored


def _roots(edges: DataFrame) -> DataFrame:
    """(node, comp) of stored edges: every node goes to its least neighbour, if
    that is smaller, and on to where that one went, up to a node that stays."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), "labels")
    while True:
        after = stored(_followed(labels, labels).withColumn("_moved", F.col("comp") != F.col("_was")), "labels")
        moved = after.where("_moved").limit(1).count()
        removed(labels)
        labels = after.select("node", "comp")
        if not moved:
            return labels


def _followed(labels: DataFrame, to: DataFrame) -> DataFrame:
    """``labels`` after each label took its own label of ``to``, if it has one."""
    to = to.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
    return labels.join(to, "comp", "left").select("node", F.col("comp").alias("_was"), F.coalesce("_next", "comp").alias("comp"))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links as pairs (a, b) of the labels of their ends, each pair once; links
    inside a label are gone."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end, "left")
    ends = [F.coalesce(f"_{end}", end) for end in ("a", "b")]
    return links.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp) of an edge list (a, b): the smallest node that can be
    reached; ``labels`` are the components of earlier edges.  Each round reads
    the edges between components once, joins components along them and keeps
    the edges between what came out, so an edge inside a component is read once."""
    edges = edges.select("a", "b")
    edges = stored(_between(edges, labels) if labels is not None else edges.distinct(), "edges")
    while labels is None or edges.limit(1).count():
        roots = _roots(edges)
        rest = stored(_between(edges, roots), "edges")
        removed(edges)
        edges = rest
        if labels is None:
            labels = roots
        else:
            fresh = roots.join(labels, "node", "left_anti").select("node", "comp")
            labels = stored(_followed(labels, roots).select("node", "comp").union(fresh), "labels")
            removed(roots)
    removed(edges)
    return labels


def _without_few(rows: DataFrame, apart: str) -> DataFrame:
    """Of a stored table (sig, node, part, sure, ...): leave out nodes that have
    fewer than ``sure`` signatures of a part, and signatures that then hold one
    value of ``apart`` only; again while that spares a tenth of the rows (rows
    that stay cost time, never a result)."""
    n = rows.count()
    while True:
        few = rows.groupBy("node", "part").agg((F.count(F.lit(1)) < F.first("sure")).alias("_few")).where("_few").select("node", "part")
        left = rows.join(few, ["node", "part"], "left_anti")
        split = left.groupBy("sig").agg(F.min(apart).alias("_lo"), F.max(apart).alias("_hi")).where("_lo <> _hi").select("sig")
        after = stored(left.join(split, "sig", "left_semi"), "members")
        removed(rows)
        rows, was, n = after, n, after.count()
        if n >= 0.9 * was:
            return rows


def _once(rows: DataFrame) -> DataFrame:
    """Of signatures that hold exactly the same nodes, one is enough."""
    node = F.xxhash64("node")
    sets = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(node).alias("_x"), F.sum(node.cast("decimal(38,0)")).alias("_s"))
    return rows.join(sets.groupBy("_n", "_x", "_s").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def pruned(members: DataFrame) -> DataFrame:
    """Leave out memberships that no link needs, as a stored table.  ``sure``
    says how many signatures of a part a node shares with any partner, so a node
    with fewer has none."""
    return _without_few(stored(members, "members"), "node")


def _trimmed(rows: DataFrame) -> DataFrame:
    """Leave out of each node's signatures of a part the ``sure`` - 1 that most
    nodes have.  A pair shares ``sure`` of them, so the least crowded one they
    share stays with both."""
    sizes = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy("node", "part").orderBy(F.desc("_size"), "sig")  # as many rows as a node has keys
    ranked = rows.join(sizes, "sig").withColumn("_crowd", F.row_number().over(order))
    return ranked.where(F.col("_crowd") >= F.col("sure")).select("sig", "node", "comp")


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], pivots: int = 8,
           met: tuple[DataFrame, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components (node, comp) and the links (a, b) that were verified.
    ``members`` has sig, node and, if it comes from ``pruned``, part and sure; ``verify``
    keeps the pairs (a, b), a < b, that are links.  ``met`` gives columns of the
    nodes and a condition on structs x and y of them, without which two nodes
    that meet in a group cannot be linked."""
    counted = "sure" in members.columns
    members = members if counted else stored(members, "members")
    once = stored(_once(members.select("sig", "node")), "once")
    star = once.groupBy("sig").agg(F.min("node").alias("_lead"), F.count(F.lit(1)).alias("_size"))
    star = once.join(star, "sig").where("node <> _lead")
    first = star.groupBy("node").agg(F.max(F.struct("_size", "sig", "_lead")).alias("_to")).select(F.col("_to._lead").alias("a"), F.col("node").alias("b"))
    tested = stored(first, "pairs")
    links = stored(verify(tested), "links")
    labels = components(links)

    def still_open(rows: DataFrame, now: DataFrame) -> DataFrame:
        """Rows with their component, of groups that have several."""
        rows = rows.join(now, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = rows.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("sig")
        return rows.join(split, "sig", "left_semi")

    rows = stored(still_open(members, labels), "open")
    if counted:  # a node shares as many signatures with a partner in another component, all of them open
        rows = _trimmed(_without_few(rows, "comp"))
    rows = stored(_once(rows), "once")
    sized = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("sig").orderBy("_n", "comp", "node")
    rows = stored(rows.join(sized, ["sig", "comp"]).select("sig", "node", F.row_number().over(order).alias("_rank")), "ranked")
    about, allowed = met or (None, "true")
    done, upto = 0, pivots
    while True:
        now = stored(still_open(rows, labels), "round")
        wide = now.withColumn("x", F.lit(None).cast("int"))
        if about is not None:
            wide = now.join(about.select("node", F.struct(*[c for c in about.columns if c != "node"]).alias("x")), "node")
        pivot = wide.where(F.col("_rank").between(done + 1, upto)).select("sig", F.col("node").alias("_p"), F.col("comp").alias("_pc"),
                                                                         F.col("_rank").alias("_pr"), F.col("x").alias("y"))
        near = wide.join(pivot, "sig").where(f"comp <> _pc and _rank > _pr and {allowed}")
        pairs = near.select(F.least("node", "_p").alias("a"), F.greatest("node", "_p").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            more = stored(verify(pairs), "links")
            if more.limit(1).count():
                links = stored(links.union(more), "links")
                labels = components(more, labels)
        rest = now.where(F.col("_rank") > upto + 1).limit(1).count()
        removed(now)
        if not rest:
            return labels, links
        tested = tested.union(pairs)
        done, upto = upto, upto * 8
