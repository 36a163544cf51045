"""Shortest-path measures (J3 betweenness, J5 closeness) by multi-source
breadth-first search.

``shortest_paths`` takes sources in batches over all nodes (unless the caller
asks for ``k`` pivots, the ``k`` smallest ``xxhash64`` of the node id).  Nodes
are numbered by degree; a node numbered below all its neighbours is free.  Free
nodes touch each other nowhere, so what they know follows from their neighbours
and only the others, the kept nodes, have stored vectors over a batch: path
counts, distances, dependencies.  Edges lie in blocks of about ``BLOCK``; one
step of the search is a join of the kept nodes' vectors with every block they
touch, where numpy passes them on through the block's free nodes and edges, and
a second one that adds the blocks' sums up.  Dependencies are pushed back level
by level the same way (Brandes).  Distances are symmetric, so the same search
gives closeness.  Work is O(sources * edges) additions a level; a group holds
``pairs`` numbers of a batch, and as many batches as fit ``WAVE`` run side by side.
``closeness`` alone sends bitmaps of sources the same way, without path counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from .build import Graph


#: Numbers (source, node) of one batch of betweenness sources, and (source, kept
#: node) of the batches that run side by side, at most.
PAIRS = 6_000_000
WAVE = 50_000_000
#: Edges of one block, about, and kept nodes whose sums are added up in one group.
BLOCK = 500_000
ADDED = 50_000


def _removed(tables: list[DataFrame]) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LISTS = ("own", "source", "known", "ptr", "idx", "kptr", "kidx", "mptr", "midx")
_BLOCK = "part int, " + ", ".join(f"{c} binary" for c in _LISTS)
_TOLD = "v long, delta double, reached long, far long"
_STATE = "b int, g int, v long, sigma binary, dist binary, back binary, live boolean, fresh boolean, delta double, reached long, far long"
_SENT = "b int, g int, part int, v long, total binary, delta double, reached long, far long"


def _packed(key: tuple[pa.Scalar, ...], ends: pa.Table) -> pa.Table:
    """One block: its free nodes ``own`` with their neighbours (``ptr``, ``idx``),
    its kept nodes ``known`` with their free neighbours (``kptr``, ``kidx``) and
    the kept ones they hear from (``mptr``, ``midx``), by place in the block."""
    v, w, free, source = (ends[c].to_numpy() for c in ("v", "w", "free", "source"))
    known = np.unique(np.concatenate([v[~free], w]))
    own, first = np.unique(v[free], return_index=True)
    i, k = np.searchsorted(own, v[free]), np.searchsorted(known, w[free])
    a, b = np.searchsorted(known, v[~free]), np.searchsorted(known, w[~free])

    def lists(of, to, n):
        return np.append(0, np.cumsum(np.bincount(of, minlength=n))), to[np.lexsort((to, of))]

    found = (own, source[free][first], known, *lists(i, k, len(own)), *lists(k, i, len(known)), *lists(b, a, len(known)))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32())}
                    | {c: pa.array([x.astype(np.int64).tobytes()], pa.binary()) for c, x in zip(_LISTS, found)})


def _matrix(column, kind, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _over(add, x: np.ndarray, ptr: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """``add`` over the rows of ``x`` that each list names."""
    out = np.zeros((len(ptr) - 1, x.shape[1]), x.dtype)
    if x.any():
        for i in np.flatnonzero(np.diff(ptr)):
            add.reduce(x.take(idx[ptr[i]:ptr[i + 1]], axis=0), axis=0, out=out[i])
    return out


def _spread(size: int, level: int, back: bool, groups: int):
    """What a block's edges and free nodes bring the kept nodes of the next level,
    or bring back to those of this one, and what its free nodes beyond know."""
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, state: pa.Table) -> pa.Table:
        b, part = key[0].as_py(), key[1].as_py()
        own, source, known, ptr, idx, kptr, kidx, mptr, midx = (np.frombuffer(block[c][0].as_py(), np.int64) for c in _LISTS)
        sigma, dist, delta = np.zeros((len(known), size)), np.full((len(known), size), -1, np.int32), np.zeros((len(known), size))
        if state.num_rows:
            at = np.searchsorted(known, state["v"].to_numpy())
            sigma[at], dist[at] = _matrix(state["sigma"], np.float64, size), _matrix(state["dist"], np.int32, size)
            if back:
                delta[at] = _matrix(state["back"], np.float64, size)
        near = level if back else level - 1  # of the kept nodes before the free ones in question
        paths = _over(np.add, np.where(dist == near, sigma, 0.0), ptr, idx)
        fresh = paths > 0
        if fresh.any():
            fresh &= _over(np.maximum, ((dist >= 0) & (dist < near)).view(np.uint8), ptr, idx) == 0
        start = np.flatnonzero((source >= b * size) & (source < (b + 1) * size))
        fresh[start, source[start] - b * size] = False
        if back:
            told = lambda of: np.where(dist == of, (1 + delta) / np.where(sigma > 0, sigma, 1.0), 0.0)
            below = _over(np.add, told(level + 2), ptr, idx)
            sent = np.where(fresh, 1 / np.where(fresh, paths, 1.0) + below, 0.0)
            between = told(level + 1)
        else:
            sent, between = np.where(fresh, paths, 0.0), np.where(dist == level, sigma, 0.0)
            if level == 0:
                sent[start, source[start] - b * size] = 1.0
        total = _over(np.add, sent, kptr, kidx)
        total += _over(np.add, between, mptr, midx)
        some = np.flatnonzero(total.any(axis=1))
        reached = fresh.sum(axis=1) if back else np.zeros(len(own), np.int64)
        mine = np.flatnonzero(reached)
        n, v = len(some) + len(mine), np.concatenate([known[some], own[mine]])
        gap = [None] * len(some)
        ends = np.where(fresh, paths * below, 0.0).sum(axis=1)[mine].tolist() if back else []
        return pa.table({"b": pa.array([b] * n, pa.int32()), "g": pa.array(v % groups, pa.int32()), "part": pa.array([part] * n, pa.int32()),
                         "v": pa.array(v, pa.int64()), "total": pa.array([x.tobytes() for x in total[some]] + [None] * len(mine), pa.binary()),
                         "delta": pa.array(gap + ends, pa.float64()), "reached": pa.array(gap + reached[mine].tolist(), pa.int64()),
                         "far": pa.array(gap + (reached[mine] * (level + 1)).tolist(), pa.int64())})
    return run


def _stored(b: int, g: int, v: np.ndarray, sigma, dist, delta, fresh) -> pa.Table:
    n, none = len(v), pa.nulls(len(v))
    return pa.table({"b": pa.array([b] * n, pa.int32()), "g": pa.array([g] * n, pa.int32()), "v": pa.array(v, pa.int64()), "sigma": _rows(sigma),
                     "dist": _rows(dist), "back": _rows(delta), "live": pa.array((dist >= 0).any(axis=1)), "fresh": pa.array(fresh),
                     "delta": none.cast(pa.float64()), "reached": none.cast(pa.int64()), "far": none.cast(pa.int64())})


def _gathered(size: int, level: int, back: bool):
    """The kept nodes of a group after what the blocks sent them; what free nodes
    know goes along."""
    def run(key: tuple[pa.Scalar, ...], state: pa.Table, sent: pa.Table) -> pa.Table:
        b, g = key[0].as_py(), key[1].as_py()
        ends = sent.filter(sent["total"].is_null())
        sent = sent.filter(sent["total"].is_valid())
        v = state["v"].to_numpy()
        sigma, dist, delta = (_matrix(state[c], t, size) for c, t in (("sigma", np.float64), ("dist", np.int32), ("back", np.float64)))
        total = np.zeros(sigma.shape)
        if sent.num_rows:
            to, order = sent["v"].to_numpy(), np.lexsort((sent["part"].to_numpy(), sent["v"].to_numpy()))
            first = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
            sums, by = np.add.reduceat(_matrix(sent["total"], np.float64, size)[order], first, axis=0), np.argsort(v)
            total[by[np.searchsorted(v, to[order][first], sorter=by)]] = sums
        if back:
            delta, fresh = np.where(dist == level, sigma * total, delta), np.zeros(len(v), bool)
        else:
            new = (dist < 0) & (total > 0)
            sigma, dist, fresh = np.where(new, total, sigma), np.where(new, level + 1, dist).astype(np.int32), new.any(axis=1)
        n, none = ends.num_rows, pa.nulls(ends.num_rows)
        known = {"b": ends["b"], "g": ends["g"], "v": ends["v"]} | dict.fromkeys(("sigma", "dist", "back"), none.cast(pa.binary()))
        no = pa.array([False] * n, pa.bool_())
        known |= {"live": no, "fresh": no} | {c: ends[c] for c in ("delta", "reached", "far")}
        return pa.concat_tables([_stored(b, g, v, sigma, dist, delta, fresh), pa.table(known)])
    return run


def _begun(size: int):
    """A batch's kept nodes before the search."""
    def run(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        b, g = key[0].as_py(), key[1].as_py()
        v, source = nodes["v"].to_numpy(), np.array([-1 if x is None else x for x in nodes["source"].to_pylist()])
        sigma, dist = np.zeros((len(v), size)), np.full((len(v), size), -1, np.int32)
        mine = np.flatnonzero((source >= b * size) & (source < (b + 1) * size))
        sigma[mine, source[mine] - b * size], dist[mine, source[mine] - b * size] = 1.0, 0
        return _stored(b, g, v, sigma, dist, np.zeros(sigma.shape), (dist == 0).any(axis=1))
    return run


def _told(size: int):
    """Per kept node: dependency, nodes reached and their distances, over a batch."""
    def run(batches):
        for rows in batches:
            dist, delta = _matrix(rows["dist"], np.int32, size), _matrix(rows["back"], np.float64, size)
            there = dist > 0
            yield pa.RecordBatch.from_pydict({"v": rows["v"], "delta": np.where(there, delta, 0.0).sum(axis=1), "reached": there.sum(axis=1),
                                              "far": np.where(there, dist, 0).sum(axis=1, dtype=np.int64)})
    return run


def _laid_out(g: Graph, k: int, n: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Nodes with their numbers, the edges in blocks of about ``block``, the blocks
    each kept node touches, the kept nodes and the number of blocks."""
    adj = g.adjacency.select("node", "nbr")
    keyed = adj.groupBy("node").count().select(F.struct("count", "node").alias("key"))
    names = cut_lineage(prefix_number(keyed, "key").select("key.node", F.col("_no").cast("long").alias("v")))
    picked = names if k == n else names.orderBy(F.xxhash64("node"), "node").limit(k)
    order = prefix_number(picked.select("v"), "v").withColumnRenamed("_no", "source")
    nodes = cut_lineage(names.join(order, "v", "left").select("node", "v", F.col("source").cast("long").alias("source")))
    pairs_of = cut_lineage(adj.join(names, "node").join(names.select(F.col("node").alias("nbr"), F.col("v").alias("w")), "nbr").select("v", "w"))
    marked = cut_lineage(nodes.join(pairs_of.groupBy("v").agg(F.min("w").alias("w")), "v").select("v", "source", (F.col("v") < F.col("w")).alias("free")))
    ends = (pairs_of.join(marked, "v").join(marked.select(F.col("v").alias("w"), F.col("free").alias("_other")), "w").where("NOT _other")
            .select("v", "w", "free", F.coalesce("source", F.lit(-1)).alias("source")))
    ends = cut_lineage(ends)
    parts = -(-ends.count() // block)
    ends = ends.withColumn("part", F.when(F.col("free"), F.col("v") % parts).otherwise(F.pmod(F.xxhash64("v", "w"), F.lit(parts))).cast("int"))
    blocks = cut_lineage(ends.groupBy("part").applyInArrow(_packed, _BLOCK))
    known = ends.where("NOT free").select("v", "part").union(ends.select("w", "part")).distinct()
    touched = cut_lineage(known.groupBy("v").agg(F.collect_list("part").alias("parts")))
    kept = marked.where("NOT free").select("v", "source")
    return nodes, blocks, touched, kept, parts


def shortest_paths(g: Graph, k: int | None = None, normalized: bool = True, pairs: int = PAIRS) -> DataFrame:
    """(node, betweenness_centrality, closeness_centrality): Brandes betweenness,
    exact over all sources, or from ``k`` pivots scaled like the reference
    library (1/((n-1)(n-2)) when normalised, x n/k when sampled) (J3), and, over
    all sources, closeness with the component scaling (J5; null with pivots).
    A batch holds at most ``pairs`` numbers (source, node); a level's table goes
    as soon as the next one is stored."""
    g = g.checkpointed()
    n = g.nodes.count()
    if n == 0:
        return g.nodes.select("node", F.lit(0.0).alias("betweenness_centrality"), F.lit(0.0).alias("closeness_centrality"))
    k = n if k is None or k >= n else k
    size = min(k, max(1, pairs // n))
    spark = g.nodes.sparkSession
    nodes, blocks, touched, kept, parts = _laid_out(g, k, n, BLOCK)
    many = kept.count()
    groups, width = 1 + many // ADDED, max(1, WAVE // (many * size))
    sums = []
    for first in range(0, -(-k // size), width):
        batches = spark.range(first, min(first + width, -(-k // size))).select(F.col("id").cast("int").alias("b"))
        tasks = min(1000, 2 * parts * min(width, -(-k // size) - first))
        dealt = lambda rows, by: rows.repartition(tasks, "b", by).groupBy("b", by)
        own = batches.crossJoin(kept).withColumn("g", (F.col("v") % groups).cast("int"))
        state = cut_lineage(dealt(own, "g").applyInArrow(_begun(size), _STATE))
        wide = batches.crossJoin(blocks)

        def step(state, level, back):
            live = state.where("live").join(touched, "v").select("b", F.explode("parts").alias("part"), "v", "sigma", "dist", *["back"] * back)
            sent = dealt(wide, "part").cogroup(dealt(live, "part")).applyInArrow(_spread(size, level, back, groups), _SENT)
            after = cut_lineage(dealt(state.where("sigma is not null"), "g").cogroup(dealt(sent, "g")).applyInArrow(_gathered(size, level, back), _STATE))
            _removed([state])
            return after

        level, still = 0, 0
        while still < 2:  # kept nodes may lie two levels apart
            state, level = step(state, level, False), level + 1
            still = still + 1 if state.where("fresh").isEmpty() else 0
        for back in range(level - 2, -1, -1):
            state = step(state, back, True)
            sums.append(cut_lineage(_added([state.where("sigma is null")])))
        sums.append(cut_lineage(_added([state.where("sigma is not null").select("v", "dist", "back").mapInArrow(_told(size), _TOLD)])))
        _removed([state])
        if len(sums) >= 50:
            sums = [cut_lineage(_added(sums))]
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 0.5
    scale = scale * n / k if 0 < k < n else scale
    near = F.when(F.col("far") > 0, F.col("reached") / F.col("far") * (F.col("reached") / (n - 1))).otherwise(F.lit(0.0))
    return nodes.join(_added(sums), "v", "left").select("node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness_centrality"),
                                                        (near if k == n else F.lit(None).cast("double")).alias("closeness_centrality"))


def _added(tables: list[DataFrame]) -> DataFrame:
    tables = [t.select("v", "delta", "reached", "far") for t in tables]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("delta", "reached", "far")])


def betweenness(g: Graph, k: int | None = None, normalized: bool = True, pairs: int = PAIRS) -> DataFrame:
    """(node, betweenness_centrality) of ``shortest_paths``."""
    return shortest_paths(g, k, normalized, pairs).select("node", "betweenness_centrality")


#: Sources of one batch, bits (source, kept node) of one batch and of the batches
#: that run side by side, at most.
BATCH = 4096 * 8
BITS = 256_000_000
ABREAST = 2_000_000_000

_REACHED = "b int, g int, v long, had binary, bits binary, live boolean, fresh long, moved boolean"
_HEARD = "b int, g int, v long, bits binary, fresh long"


def _own_bits(b: int, size: int, source: np.ndarray) -> np.ndarray:
    """A row a node, with the bit of its own source if that is one of batch ``b``."""
    out = np.zeros((len(source), -(-size // 64)), np.uint64)
    mine = np.flatnonzero((source >= b * size) & (source < (b + 1) * size))
    bit = source[mine] - b * size
    out[mine, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    return out


def _more(now: np.ndarray, was: np.ndarray) -> np.ndarray:
    return np.bitwise_count(now & ~was).sum(axis=1, dtype=np.int64)


def _reach(size: int, groups: int):
    """From sources within d - 2 steps (``had``) and d - 1 steps (``bits``) of the
    kept nodes: those within d steps that a block's free nodes and edges bring
    them, and how many more its free nodes have within d than within d - 1."""
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, state: pa.Table) -> pa.Table:
        b = key[0].as_py()
        own, source, known, ptr, idx, kptr, kidx, mptr, midx = (np.frombuffer(block[c][0].as_py(), np.int64) for c in _LISTS)
        words = -(-size // 64)
        had, bits = np.zeros((len(known), words), np.uint64), np.zeros((len(known), words), np.uint64)
        if state.num_rows:
            at = np.searchsorted(known, state["v"].to_numpy())
            had[at], bits[at] = _matrix(state["had"], np.uint64, words), _matrix(state["bits"], np.uint64, words)
        was = _over(np.bitwise_or, had, ptr, idx) | _own_bits(b, size, source)
        more = _more(_over(np.bitwise_or, bits, ptr, idx), was)
        total = _over(np.bitwise_or, was, kptr, kidx) | _over(np.bitwise_or, bits, mptr, midx)
        some, mine = np.flatnonzero(total.any(axis=1)), np.flatnonzero(more)
        v = np.concatenate([known[some], own[mine]])
        return pa.table({"b": pa.array([b] * len(v), pa.int32()), "g": pa.array(v % groups, pa.int32()), "v": pa.array(v, pa.int64()),
                         "bits": pa.array([x.tobytes() for x in total[some]] + [None] * len(mine), pa.binary()),
                         "fresh": pa.array([None] * len(some) + more[mine].tolist(), pa.int64())})
    return run


def _reached(b: int, g: int, v: np.ndarray, had, bits, fresh) -> pa.Table:
    return pa.table({"b": pa.array([b] * len(v), pa.int32()), "g": pa.array([g] * len(v), pa.int32()), "v": pa.array(v, pa.int64()), "had": _rows(had),
                     "bits": _rows(bits), "live": pa.array(bits.any(axis=1)), "fresh": pa.array(fresh, pa.int64()), "moved": pa.array(fresh > 0)})


def _starting(size: int):
    """A batch's kept nodes before the first step: sources know themselves."""
    def run(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        b, v = key[0].as_py(), nodes["v"].to_numpy()
        bits = _own_bits(b, size, nodes["source"].to_numpy())
        return _reached(b, key[1].as_py(), v, np.zeros_like(bits), bits, np.zeros(len(v), np.int64))
    return run


def _merged(size: int):
    """The kept nodes of a group with what the blocks brought them; the free nodes' numbers go along."""
    def run(key: tuple[pa.Scalar, ...], state: pa.Table, heard: pa.Table) -> pa.Table:
        b, g, words = key[0].as_py(), key[1].as_py(), -(-size // 64)
        ends, heard = heard.filter(heard["bits"].is_null()), heard.filter(heard["bits"].is_valid())
        v, had = state["v"].to_numpy(), _matrix(state["bits"], np.uint64, words)
        bits = had.copy()
        if heard.num_rows:
            to, by = heard["v"].to_numpy(), np.argsort(v)
            order = np.argsort(to)
            first = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
            bits[by[np.searchsorted(v, to[order][first], sorter=by)]] |= np.bitwise_or.reduceat(_matrix(heard["bits"], np.uint64, words)[order], first, axis=0)
        n, no = ends.num_rows, pa.array([False] * ends.num_rows, pa.bool_())
        free = {"b": ends["b"], "g": ends["g"], "v": ends["v"]} | dict.fromkeys(("had", "bits"), pa.nulls(n, pa.binary()))
        return pa.concat_tables([_reached(b, g, v, had, bits, _more(bits, had)), pa.table(free | {"live": no, "fresh": ends["fresh"], "moved": no})])
    return run


def _far(tables: list[DataFrame]) -> DataFrame:
    """Sums of distances and of nodes reached, per node."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("v").agg(F.sum("tot").alias("tot"), F.sum("fresh").alias("fresh"))


def closeness(g: Graph) -> DataFrame:
    """Exact closeness with the reference library's component scaling:
    (r-1)/sum(d) * (r-1)/(n-1), r = nodes reached (J5).

    Sources are taken in batches of at most ``BATCH``; a node's bitmap holds the
    batch's sources within d steps of it, and a step ORs the neighbours'
    bitmaps.  As in ``shortest_paths`` only kept nodes have stored bitmaps, sent
    to the blocks of edges they touch; a block's free nodes only count.
    Distances are symmetric, so the new bits of a step are nodes at distance d.
    Ends when two steps bring no kept node a bit (they may lie two steps apart).
    A step's bitmaps go as soon as the next ones are stored."""
    g = g.checkpointed()
    n = g.nodes.count()
    if n == 0:
        return g.nodes.select("node", F.lit(0.0).alias("closeness_centrality"))
    nodes, blocks, touched, kept, parts = _laid_out(g, n, n, 4 * BLOCK)
    many = kept.count()
    size = max(1, min(n, BATCH, BITS // many))
    groups, width, last = 1 + many // ADDED, max(1, ABREAST // (many * size)), -(-n // size)
    spark, sums = g.nodes.sparkSession, []
    for first in range(0, last, width):
        batches = spark.range(first, min(first + width, last)).select(F.col("id").cast("int").alias("b"))
        tasks = min(1000, 2 * parts * min(width, last - first))
        dealt = lambda rows, by: rows.repartition(tasks, "b", by).groupBy("b", by)
        own = batches.crossJoin(kept).withColumn("g", (F.col("v") % groups).cast("int"))
        state = cut_lineage(dealt(own, "g").applyInArrow(_starting(size), _REACHED))
        wide = batches.crossJoin(blocks)
        d, still = 0, 0
        while still < 2:
            d += 1
            live = state.where("live").join(touched, "v").select("b", F.explode("parts").alias("part"), "v", "had", "bits")
            heard = dealt(wide, "part").cogroup(dealt(live, "part")).applyInArrow(_reach(size, groups), _HEARD)
            after = cut_lineage(dealt(state.where("bits is not null"), "g").cogroup(dealt(heard, "g")).applyInArrow(_merged(size), _REACHED))
            _removed([state])
            state, still = after, still + 1 if after.where("moved").isEmpty() else 0
            sums.append(cut_lineage(after.where("fresh > 0").groupBy("v").agg(F.sum(F.col("fresh") * d).alias("tot"), F.sum("fresh").alias("fresh"))))
        _removed([state])
        if len(sums) >= 50:
            sums = [cut_lineage(_far(sums))]
    per = _far(sums).select("v", F.col("tot").alias("_tot"), F.col("fresh").alias("_r"))
    c = F.when((F.col("_tot") > 0) & (n > 1), F.col("_r") / F.col("_tot") * (F.col("_r") / (n - 1))).otherwise(F.lit(0.0))
    return nodes.join(per, "v", "left").select("node", F.coalesce(c, F.lit(0.0)).alias("closeness_centrality"))


def prefix_number(nodes: DataFrame, by: str) -> DataFrame:
    """Number rows 0, 1, ... in order of ``by``: number within a range block plus the block's offset."""
    from pyspark.sql import Window
    blocks = cut_lineage(nodes.repartitionByRange(by).withColumn("_block", F.spark_partition_id()))
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_start"))  # a row per block
    own = F.row_number().over(Window.partitionBy("_block").orderBy(by)) - 1
    return blocks.withColumn("_own", own).join(F.broadcast(starts), "_block").select(by, (F.col("_own") + F.col("_start")).alias("_no"))
