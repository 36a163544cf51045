"""One-pass graph measures.

Triangles use the degree-ordered wedge join: every undirected edge is
oriented from the endpoint of lower (degree, id) rank to the higher one,
so each node's out-list has at most sqrt(2m) entries and a hub's
neighbourhood is never paired up; each triangle is found once, at its
lowest-ranked corner, and credited to its three corners.  Wedges that no edge
closes stay in the task that makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from .build import Graph

#: Bits (power of two) of the bitmap of closing edges at most, and wedges made at a time.
MOST_BITS = 29
SLICE = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def degrees(g: Graph) -> DataFrame:
    """Undirected degree (distinct neighbours) of every node."""
    d = g.adjacency.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.join(d, "node", "left").fillna(0, ["degree"])


def node_count(g: Graph) -> DataFrame:
    """One-row frame with n (to be cross-joined; its size is one row)."""
    return g.nodes.agg(F.count(F.lit(1)).alias("n"))


def degree_centrality(g: Graph) -> DataFrame:
    """degree / (n - 1)."""
    d = degrees(g).crossJoin(F.broadcast(node_count(g)))
    return d.select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1))
                    .otherwise(F.lit(0.0)).alias("degree_centrality"))


def flow(g: Graph) -> DataFrame:
    """Weighted / count in- and out-degree, flow ratio, velocity and the
    concentration index (J15)."""
    out_ = g.directed.groupBy(F.col("src").alias("node")).agg(
        F.sum(F.col("weight").cast("decimal(38,2)")).cast("double").alias("out_degree_weighted"),
        F.sum("count").alias("out_degree_count"))
    in_ = g.directed.groupBy(F.col("dst").alias("node")).agg(
        F.sum(F.col("weight").cast("decimal(38,2)")).cast("double").alias("in_degree_weighted"),
        F.sum("count").alias("in_degree_count"))
    d = g.nodes.join(in_, "node", "left").join(out_, "node", "left").fillna(
        0, ["in_degree_weighted", "out_degree_weighted", "in_degree_count", "out_degree_count"])
    iw, ow = F.col("in_degree_weighted"), F.col("out_degree_weighted")
    tw = iw + ow
    tc = F.col("in_degree_count") + F.col("out_degree_count")
    return d.select(
        "node", "in_degree_weighted", "out_degree_weighted", "in_degree_count", "out_degree_count",
        F.when(tw > 0, ow / tw).otherwise(F.lit(0.5)).alias("flow_ratio"),
        F.when(tc > 0, tw / tc).otherwise(F.lit(0.0)).alias("velocity_score"),
        F.when(ow > 0, F.least(F.lit(1.0), ow / (iw + ow + 1))).otherwise(F.lit(0.0)).alias("concentration_index"))


def herfindahl(g: Graph) -> DataFrame:
    """Concentration of out-flow as sum of squared shares (J15 v2)."""
    tot = g.directed.groupBy("src").agg(F.sum("weight").alias("_t"))
    s = g.directed.join(tot, "src").select("src", ((F.col("weight") / F.col("_t")) ** 2).alias("_p2"))
    return s.groupBy(F.col("src").alias("node")).agg(F.sum("_p2").alias("concentration_hhi"))


def oriented_edges(g: Graph) -> DataFrame:
    """Undirected edges oriented low -> high by (degree, id) rank."""
    d = degrees(g)
    e = (g.undirected.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u")
         .join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v"))
    u_first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return e.select(F.when(u_first, F.col("u")).otherwise(F.col("v")).alias("a"),
                    F.when(u_first, F.col("v")).otherwise(F.col("u")).alias("b"), F.greatest("du", "dv").alias("db"))


def _places(one: np.ndarray, two: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap of ``2 ** bits`` bits for pairs of node hashes."""
    pair = one * _MIX + two
    return pair >> np.uint64(64 - bits), ((pair ^ (pair >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = np.concatenate(_places(_hashes(rows.column("hb")), _hashes(rows.column("hc")), bits))
            mask = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["cell", "mask"])
    return run


def _pair_bitmap(pairs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bitmap that has both places of all ``n`` pairs (hb, hc), and of few others:
    16 bits a pair or more, up to ``2 ** MOST_BITS`` (64 MB)."""
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    cells = pairs.mapInArrow(_marks(bits), "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    held = np.zeros(1 << (bits - 6), np.uint64)  # at most so many rows reach the driver
    held[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return held, bits


def _wedges(bitmap, bits: int):
    """Pairs of each node's list, in order, that the bitmap may hold."""
    def has(held: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (held[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for rows in batches:
            lists = rows.column("out")
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            b, h = flat.field("b"), _hashes(flat.field("h"))
            own = np.repeat(np.arange(len(size)), size)
            later = np.repeat(np.cumsum(size), size) - np.arange(len(own)) - 1
            done = np.append(0, np.cumsum(later))
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(done, done[at] + SLICE, "right")) - 1)
                first = np.repeat(np.arange(at, to), later[at:to])
                second = np.arange(len(first)) - np.repeat(done[at:to] - done[at], later[at:to]) + first + 1
                one, two = _places(h[first], h[second], bits)
                some = np.flatnonzero(has(held, one))
                some = some[has(held, two[some])]
                i, j = first[some], second[some]
                yield pa.RecordBatch.from_arrays([rows.column("a").take(pa.array(own[i])), b.take(pa.array(i)), b.take(pa.array(j))], ["a", "b", "c"])
                at = to
    return run


def triangle_list(g: Graph) -> DataFrame:
    """Every triangle once as (a, b, c) in order of rank: a wedge at its
    lowest-ranked corner is closed by the one edge b -> c.  Wedges are made node
    by node from its list of higher neighbours and only those leave the task
    that a bitmap of the closing edges may hold (it misses none); the join with
    these edges decides."""
    o = oriented_edges(g)
    lists = cut_lineage(o.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("db", "b", F.xxhash64("b").alias("h")))).alias("out")))
    middle = lists.select(F.explode("out.b").alias("a")).distinct()  # only edges of these can close a wedge
    closing = cut_lineage(lists.join(middle, "a", "left_semi").select(F.col("a").alias("b"), F.explode("out").alias("_o"))
                          .select("b", F.col("_o.b").alias("c"), F.xxhash64("b").alias("hb"), F.col("_o.h").alias("hc")))
    held, bits = _pair_bitmap(closing.select("hb", "hc"), closing.count())
    bitmap, node = lists.sparkSession.sparkContext.broadcast(held), lists.schema["a"].dataType.simpleString()
    w = lists.where(F.size("out") > 1).mapInArrow(_wedges(bitmap, bits), f"a {node}, b {node}, c {node}")
    return w.join(closing.select("b", "c"), ["b", "c"]).select("a", "b", "c")


def triangles(g: Graph) -> DataFrame:
    """Triangle count per node."""
    tri = triangle_list(g).select(F.explode(F.array("a", "b", "c")).alias("node"))
    cnt = tri.groupBy("node").agg(F.count(F.lit(1)).alias("triangle_count"))
    return g.nodes.join(cnt, "node", "left").fillna(0, ["triangle_count"])


def structural(g: Graph) -> DataFrame:
    """Clustering, triangles, square clustering (linked neighbour pairs /
    degree), constraint 1/degree and effective size d - tri/d (J8, J11-J13)."""
    t = triangles(g).join(degrees(g), "node")
    d, tr = F.col("degree"), F.col("triangle_count")
    return t.select(
        "node", "degree", "triangle_count",
        F.when(d > 1, 2.0 * tr / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering_coefficient"),
        F.when(d >= 2, tr / d).otherwise(F.lit(0.0)).alias("square_clustering"),
        F.when(d > 0, 1.0 / d).otherwise(F.lit(0.0)).alias("constraint"),
        F.when(d > 0, d - tr / d).otherwise(F.lit(0.0)).alias("effective_size"))


def local_anomaly(g: Graph, cap: float | None = 5.0) -> DataFrame:
    """|d - mean neighbour degree| / (mean + 1), capped; isolated nodes 1.0."""
    d = degrees(g)
    nd = (g.adjacency.join(d.select(F.col("node").alias("nbr"), F.col("degree").alias("nd")), "nbr")
          .groupBy("node").agg(F.avg("nd").alias("avg_neighbor_degree")))
    x = d.join(nd, "node", "left")
    dev = F.abs(F.col("degree") - F.col("avg_neighbor_degree")) / (F.col("avg_neighbor_degree") + 1)
    if cap is not None:
        dev = F.least(dev, F.lit(cap))
    return x.select("node", "degree", "avg_neighbor_degree",
                    F.when(F.col("degree") > 0, dev).otherwise(F.lit(1.0)).alias("local_anomaly_score"))


def modularity_share(g: Graph, communities: DataFrame) -> DataFrame:
    """(internal - external) / degree for a node -> community map."""
    c = communities.select("node", "community_id")
    e = (g.adjacency.join(c, "node")
         .join(c.select(F.col("node").alias("nbr"), F.col("community_id").alias("nbr_c")), "nbr", "left"))
    agg = e.groupBy("node").agg(F.count_if(F.col("community_id") == F.col("nbr_c")).alias("_in"),
                                F.count(F.lit(1)).alias("_d"))
    x = g.nodes.join(agg, "node", "left")
    return x.select("node", F.when(F.col("_d") > 0, (F.col("_in") - (F.col("_d") - F.col("_in"))) / F.col("_d"))
                    .otherwise(F.lit(0.0)).alias("modularity_contribution"))


def dataset_stability(g: Graph, ds_edges: DataFrame) -> DataFrame:
    """Dataset presence, population variance of per-dataset degree (absent
    = 0) and stability 1/(1+var); a single dataset gives 1, 0, 1 (J18)."""
    per = (ds_edges.select("dataset", F.col("src").alias("node"), F.col("dst").alias("other"))
           .unionByName(ds_edges.select("dataset", F.col("dst").alias("node"), F.col("src").alias("other")))
           .groupBy("dataset", "node").agg(F.count(F.lit(1)).alias("deg")))
    # distinct (dataset, src, dst) rows; degree in a directed subgraph = in + out neighbours
    k = ds_edges.select("dataset").distinct().agg(F.count(F.lit(1)).alias("k"))
    s = per.groupBy("node").agg(F.count(F.lit(1)).alias("dataset_presence"), F.sum("deg").alias("_s"),
                                F.sum(F.col("deg") * F.col("deg")).alias("_s2"))
    x = g.nodes.join(s, "node", "left").fillna(0, ["dataset_presence", "_s", "_s2"]).crossJoin(F.broadcast(k))
    kk = F.col("k").cast("double")
    mean = F.col("_s") / kk
    var = F.greatest(F.lit(0.0), F.col("_s2") / kk - mean * mean)
    multi = F.col("k") > 1
    return x.select("node",
                    F.when(multi, F.col("dataset_presence")).otherwise(F.lit(1)).alias("dataset_presence"),
                    F.when(multi, var).otherwise(F.lit(0.0)).alias("degree_variance"),
                    F.when(multi, 1.0 / (1.0 + var)).otherwise(F.lit(1.0)).alias("degree_stability"))


def structural_v2(g: Graph) -> DataFrame:
    """Second-pipeline structural variants from the triangle list (J11-J13 v2):
    square clustering = sum over triangles (v, x, y) of (triangles on edge
    x-y minus 1) / (d(d-1)/2); Burt constraint = sum over neighbours j of
    (1/d + (1/d) * sum over common neighbours q of 1/d_q)^2; effective size
    = d - 2 * triangles / d."""
    g = g.checkpointed()
    t = cut_lineage(triangle_list(g))   # read three times below
    corners = (t.select(F.col("a").alias("v"), F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"))
               .unionByName(t.select(F.col("b").alias("v"), F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y")))
               .unionByName(t.select(F.col("c").alias("v"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))))
    te = corners.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_te"))
    sq = corners.join(te, ["x", "y"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("_te") - 1).alias("_sq"))
    d = degrees(g)
    dq = d.select(F.col("node").alias("q"), F.col("degree").alias("_dq"))
    # ordered (v, j, q) for every triangle: q is a common neighbour of v and j
    trip = None
    for v, j, q in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")):
        x = t.select(F.col(v).alias("node"), F.col(j).alias("nbr"), F.col(q).alias("q"))
        trip = x if trip is None else trip.unionByName(x)
    ind = trip.join(dq, "q").groupBy("node", "nbr").agg(F.sum(1.0 / F.col("_dq")).alias("_s"))
    con = (g.adjacency.select("node", "nbr").join(ind, ["node", "nbr"], "left").join(d, "node")
           .groupBy("node").agg(F.sum(F.pow(1.0 / F.col("degree") + F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("degree"),
                                            2)).alias("constraint_v2")))
    tri = corners.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("triangle_count"))
    x = d.join(tri, "node", "left").fillna(0, ["triangle_count"]).join(sq, "node", "left").join(con, "node", "left")
    dd = F.col("degree")
    return x.select("node", F.when(dd > 1, F.coalesce(F.col("_sq"), F.lit(0)) / (dd * (dd - 1) / 2.0))
                    .otherwise(F.lit(0.0)).alias("square_clustering_v2"),
                    F.coalesce(F.col("constraint_v2"), F.lit(0.0)).alias("constraint_v2"),
                    F.when(dd > 0, dd - 2.0 * F.col("triangle_count") / dd).otherwise(F.lit(0.0)).alias("effective_size_v2"))


def fraud_exposure(g: Graph, txns: DataFrame, communities: DataFrame, src: str = "cust_id", dst: str = "dest_id",
                   label: str = "label") -> DataFrame:
    """Neighbour fraud rate (share of a node's neighbours that took part in
    a fraud-labelled transfer) and community fraud rate (share of
    fraud-labelled transfers among those touching the node's community)."""
    flagged = (txns.where(F.col(label) == 1).select(F.col(src).alias("node"))
               .union(txns.where(F.col(label) == 1).select(F.col(dst).alias("node"))).distinct()
               .withColumn("_f", F.lit(1)))
    nb = (g.adjacency.join(flagged.withColumnRenamed("node", "nbr"), "nbr", "left")
          .groupBy("node").agg(F.avg(F.coalesce(F.col("_f"), F.lit(0)).cast("double")).alias("neighbor_fraud_rate")))
    c = communities.select("node", "community_id")
    t = txns.select(F.col(src).alias("node"), F.col(label).alias("_l"))
    ct = (t.join(c, "node").groupBy("community_id")
          .agg((F.sum("_l") / F.count(F.lit(1))).alias("community_fraud_rate")))
    return (g.nodes.join(nb, "node", "left").join(c, "node", "left").join(ct, "community_id", "left")
            .select("node", F.coalesce("neighbor_fraud_rate", F.lit(0.0)).alias("neighbor_fraud_rate"),
                    F.coalesce("community_fraud_rate", F.lit(0.0)).alias("community_fraud_rate")))
