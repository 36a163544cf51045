"""Account graph as DataFrames.

* ``directed``   (src, dst, weight, count) — one row per ordered pair.
* ``undirected`` (u, v, weight, count) with u < v — both directions summed.
* ``adjacency``  (node, nbr, weight, count) — undirected edges both ways.
* ``nodes``      (node) — every endpoint.

Self-transfers are dropped (a self-loop is not an account relation).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import money


@dataclass
class Graph:
    directed: DataFrame
    undirected: DataFrame
    adjacency: DataFrame
    nodes: DataFrame
    frozen: bool = False
    numbers: tuple[DataFrame, DataFrame] | None = None

    def numbered(self) -> tuple[DataFrame, DataFrame]:
        """(node, no) with the nodes numbered in their order, and the adjacency
        (node, nbr) by these numbers; stored once.  Rounds that join and count
        edges over and over take a fraction of the time over numbers."""
        if self.numbers is None:
            from ...session import cut_lineage
            from .paths import prefix_number
            ids = cut_lineage(prefix_number(self.nodes, "node").select("node", F.col("_no").cast("long").alias("no")))
            a, b = ids.select(F.col("node").alias("u"), F.col("no").alias("node")), ids.select(F.col("node").alias("v"), F.col("no").alias("nbr"))
            pairs = cut_lineage(self.undirected.select("u", "v").join(a, "u").join(b, "v").select("node", "nbr"))
            self.numbers = ids, pairs.unionByName(pairs.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")))
        return self.numbers

    def checkpointed(self) -> "Graph":
        """The same graph with its frames written once to the checkpoint
        folder: iterative algorithms re-read edges every round, and a lost
        executor then re-reads files instead of rebuilding the graph.  The
        transactions are read once, for the directed edges; the other frames
        are made of those, and the adjacency is the undirected edges read twice."""
        if self.frozen:
            return self
        from ...session import cut_lineage
        g = graph_of(cut_lineage(self.directed))
        und = cut_lineage(g.undirected)
        return Graph(g.directed, und, both_ways(und), cut_lineage(g.nodes), True)


def build_graph(txns: DataFrame, src: str = "cust_id", dst: str = "dest_id", amount: str = "amount") -> Graph:
    t = txns.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    directed = t.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        F.sum(money(F.col(amount))).alias("_w"), F.count(F.lit(1)).alias("count"))
    directed = directed.select("src", "dst", F.col("_w").cast("double").alias("weight"), "count")
    return graph_of(directed)


def graph_of(directed: DataFrame) -> Graph:
    """The graph of its directed edges."""
    und = (directed.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"),
                           money(F.col("weight")).alias("_w"), "count")
           .groupBy("u", "v").agg(F.sum("_w").cast("double").alias("weight"), F.sum("count").alias("count")))
    nodes = directed.select(F.col("src").alias("node")).union(directed.select(F.col("dst").alias("node"))).distinct()
    return Graph(directed, und, both_ways(und), nodes)


def both_ways(und: DataFrame) -> DataFrame:
    """Undirected edges as (node, nbr, weight, count) from both ends."""
    return und.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "weight", "count").unionByName(
        und.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "weight", "count"))


def per_dataset_edges(txns: DataFrame, src: str = "cust_id", dst: str = "dest_id",
                      dataset: str = "dataset") -> DataFrame:
    """Distinct directed edges per dataset (the per-dataset subgraphs)."""
    t = txns.where(F.col(src) != F.col(dst))
    return t.select(F.col(dataset).alias("dataset"), F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
