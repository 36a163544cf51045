"""Textbook graphs (FIXTURES.md 2.6)."""
import pytest
from pyspark.sql import functions as F

from ledgerhawk.operators.graph import iterative as it
from ledgerhawk.operators.graph import local as lc
from ledgerhawk.operators.graph.build import build_graph


def graph(spark, edges):
    df = spark.createDataFrame([(str(a), str(b), 1.0) for a, b in edges], ["cust_id", "dest_id", "amount"])
    return build_graph(df)


def as_map(df, col):
    return {r["node"]: r[col] for r in df.collect()}


def test_path_of_four(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4)])
    dc = as_map(lc.degree_centrality(g), "degree_centrality")
    assert dc["2"] == pytest.approx(2 / 3) and dc["1"] == pytest.approx(1 / 3)
    assert set(as_map(lc.triangles(g), "triangle_count").values()) == {0}
    assert set(as_map(it.kcore(g), "core_number").values()) == {1}


def test_clique_of_four(spark):
    g = graph(spark, [(a, b) for a in range(4) for b in range(a + 1, 4)])
    s = lc.structural(g).collect()
    assert all(r["triangle_count"] == 3 and r["clustering_coefficient"] == pytest.approx(1.0) for r in s)
    assert set(as_map(it.kcore(g), "core_number").values()) == {3}


def test_reciprocal_edges_sum_and_no_clustering(spark):
    df = spark.createDataFrame([("A", "B", 2.0), ("B", "A", 3.0)], ["cust_id", "dest_id", "amount"])
    g = build_graph(df)
    u = g.undirected.first()
    assert u["weight"] == pytest.approx(5.0) and u["count"] == 2
    assert set(as_map(lc.structural(g), "clustering_coefficient").values()) == {0.0}


def test_directed_cycle_pagerank(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 1)])
    pr = as_map(it.pagerank(g, tol=1e-6), "pagerank")
    assert all(v == pytest.approx(1 / 3, abs=1e-6) for v in pr.values())


def test_two_cliques_label_propagation(spark):
    e = [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, b) for a in range(4, 8) for b in range(a + 1, 8)]
    g = graph(spark, e + [(3, 4)])
    c = as_map(it.label_propagation(g), "community_id")
    assert len(set(c.values())) == 2
    assert len({c[str(i)] for i in range(4)}) == 1 and len({c[str(i)] for i in range(4, 8)}) == 1


def test_star_degree(spark):
    g = graph(spark, [(0, i) for i in range(1, 5)])
    dc = as_map(lc.degree_centrality(g), "degree_centrality")
    assert dc["0"] == pytest.approx(1.0)
    an = as_map(lc.local_anomaly(g), "local_anomaly_score")
    assert an["0"] == pytest.approx(abs(4 - 1) / 2)


def test_triangle_sum_is_three_t(spark):
    e = [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (4, 5)]
    g = graph(spark, e)
    tri = as_map(lc.triangles(g), "triangle_count")
    assert sum(tri.values()) == 3 * 2


def test_star_betweenness_closeness(spark):
    from ledgerhawk.operators.graph.paths import betweenness, closeness
    g = graph(spark, [(0, i) for i in range(1, 5)])
    b = as_map(betweenness(g, k=None), "betweenness_centrality")
    assert b["0"] == pytest.approx(1.0) and b["1"] == pytest.approx(0.0)
    c = as_map(closeness(g), "closeness_centrality")
    assert c["0"] == pytest.approx(1.0) and c["1"] == pytest.approx(4 / 7)


def test_bridge_has_highest_betweenness(spark):
    from ledgerhawk.operators.graph.paths import betweenness
    e = [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, b) for a in range(4, 8) for b in range(a + 1, 8)]
    b = as_map(betweenness(graph(spark, e + [(3, 4)]), k=None), "betweenness_centrality")
    top = sorted(b, key=lambda x: -b[x])[:2]
    assert set(top) == {"3", "4"}


def test_path_betweenness_exact(spark):
    from ledgerhawk.operators.graph.paths import betweenness
    b = as_map(betweenness(graph(spark, [(1, 2), (2, 3), (3, 4)]), k=None), "betweenness_centrality")
    # networkx: path of 4, normalised -> middle nodes 2/3, ends 0
    assert b["2"] == pytest.approx(2 / 3) and b["1"] == pytest.approx(0.0)


def test_label_propagation_settles_on_edge_star_and_bipartite(spark):
    for edges in ([(1, 2)], [(0, i) for i in range(1, 7)], [(a, b) for a in (1, 2) for b in (11, 12, 13)]):
        c = as_map(it.label_propagation(graph(spark, edges)), "community_id")
        assert len(set(c.values())) == 1


def test_unfinished_iterations_raise(spark):
    path = [(i, i + 1) for i in range(12)]
    with pytest.raises(it.NotConverged):
        it.pagerank(graph(spark, path), max_iter=2)
    with pytest.raises(it.NotConverged):
        it.kcore(graph(spark, path), max_iter=1)
    assert set(as_map(it.kcore(graph(spark, path)), "core_number").values()) == {1}


def test_katz_without_a_limit_is_zero(spark):
    clique = [(a, b) for a in range(12) for b in range(12) if a != b]
    assert set(as_map(it.katz(graph(spark, clique), alpha=0.5), "katz_centrality").values()) == {0.0}
    k = as_map(it.katz(graph(spark, clique), alpha=0.05, tol=1e-9), "katz_centrality")
    assert all(v == pytest.approx(1 / 12 ** 0.5) for v in k.values())


def test_closeness_leaves_no_bitmaps_behind(spark, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    from ledgerhawk.operators.graph import paths
    from ledgerhawk.session import cut_lineage
    stored = []

    def kept(df):
        out = cut_lineage(df)
        if "bits" in df.columns:
            stored.append(Path(urlparse(out.inputFiles()[0]).path).parent)
        return out

    monkeypatch.setattr(paths, "cut_lineage", kept)
    monkeypatch.setattr(paths, "BATCH", 4)
    c = as_map(paths.closeness(graph(spark, [(i, i + 1) for i in range(1, 6)])), "closeness_centrality")
    assert c["1"] == pytest.approx(5 / 15) and c["3"] == pytest.approx(5 / 9)
    assert len(stored) > 6 and not any(f.exists() for f in stored)


def test_closeness_of_parts_and_of_a_path(spark):
    from ledgerhawk.operators.graph.paths import closeness
    c = as_map(closeness(graph(spark, [(1, 2), (2, 3), (3, 4), (11, 12)])), "closeness_centrality")
    assert c["1"] == pytest.approx(3 / 6 * 3 / 5) and c["2"] == pytest.approx(3 / 4 * 3 / 5)
    assert c["11"] == pytest.approx(1 / 1 * 1 / 5)


def test_betweenness_in_batches_is_exact_and_registered(spark):
    from ledgerhawk.operators.graph.paths import betweenness
    from ledgerhawk.plans import q_graph
    g = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)])
    b = as_map(betweenness(g, normalized=False, pairs=15), "betweenness_centrality")  # three sources a batch
    assert b == pytest.approx({"1": 1.0, "2": 0.5, "3": 1.0, "4": 3.5, "5": 0.0})
    assert callable(q_graph.q_betweenness)


def test_a_stored_graph_reads_its_transactions_once(spark):
    """Undirected edges, adjacency and nodes are made of the stored directed edges."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    t = spark.range(40).select((F.col("id") % 5).cast("string").alias("cust_id"), (F.col("id") % 8 + 3).cast("string").alias("dest_id"),
                               F.lit(1.0).alias("amount")).mapInPandas(seen, "cust_id string, dest_id string, amount double")
    g = build_graph(t).checkpointed()
    assert runs.value == 40
    plain = build_graph(t)
    for name in ("directed", "undirected", "adjacency", "nodes"):
        assert sorted(map(str, getattr(g, name).collect())) == sorted(map(str, getattr(plain, name).collect()))


def test_label_propagation_counts_what_moved(spark):
    """Labels equal those of a plain count over all neighbours in every round,
    and the edges are joined without being shuffled."""
    import hashlib
    from collections import Counter
    from ledgerhawk.session import placed
    from ledgerhawk.operators.graph.iterative import label_propagation
    pairs = {(i, (i * 7 + j * j) % 60) for i in range(60) for j in range(1, 4)} | {(100, 101), (101, 102)}
    t = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in sorted(pairs) if a != b], "cust_id string, dest_id string, amount double")
    g = build_graph(t).checkpointed()
    near = {}
    for r in g.adjacency.collect():
        near.setdefault(r["node"], []).append(r["nbr"])
    lab = {v: v for v in near}
    for it in range(1, 1001):
        want = {}
        for v, ws in near.items():
            c = Counter(lab[w] for w in ws)
            want[v] = min((-k, x != lab[v], x) for x, k in c.items())[2]
        open_ = sum(want[v] != lab[v] for v in near)
        lab = {v: want[v] if hashlib.md5(f"{v}:{it}".encode()).hexdigest() < "8" else lab[v] for v in near}
        if not open_:
            break
    groups = {}
    for v, x in lab.items():
        groups.setdefault(x, []).append(v)
    expected = {v: (min(vs), len(vs)) for vs in groups.values() for v in vs}
    assert {r["node"]: (r["community_id"], r["community_size"]) for r in label_propagation(g).collect()} == expected
    with placed(g.adjacency.select("node", "nbr"), "nbr") as adj:
        joined = adj.join(g.nodes.withColumnRenamed("node", "nbr").hint("shuffle_hash"), "nbr")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_kcore_counts_again_only_where_a_neighbour_fell_below(spark, monkeypatch):
    """Cores equal plain peeling; rounds after the first read few nodes' edges,
    and the vector, not the edges, is what a round of the power iterations moves."""
    import random
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(400)} | {(i, i + 1) for i in range(200, 240)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, want, k = {v: set(ws) for v, ws in near.items()}, {}, 0
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[v]))
        want[str(v)] = k
        for u in left.pop(v):
            left[u].discard(v)
    lost, cut = [], it.cut_lineage

    def counting(df):
        out = cut(df)
        if out.columns == ["node"]:
            lost.append(out.count())
        return out

    monkeypatch.setattr(it, "cut_lineage", counting)
    assert as_map(it.kcore(graph(spark, sorted(pairs)).checkpointed()), "core_number") == want
    assert lost and max(lost) < len(near) and sum(lost) < len(near) * len(lost) / 2


@pytest.mark.parametrize("measure", ["pagerank", "hits", "katz", "eigenvector", "kcore"])
def test_rounds_store_their_edges_in_buckets(spark, monkeypatch, measure):
    used, placed = [], it.placed
    monkeypatch.setattr(it, "placed", lambda df, key: used.append(key) or placed(df, key))
    g = graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert getattr(it, measure)(g, **({} if measure == "kcore" else {"max_iter": 2, "tol": None})).count() == 4
    assert len(used) == 1


def _plain_paths(edges):
    """Brandes, one source at a time: unnormalised betweenness and closeness."""
    nbr = {}
    for a, b in edges:
        nbr.setdefault(str(a), set()).add(str(b))
        nbr.setdefault(str(b), set()).add(str(a))
    between, close = dict.fromkeys(nbr, 0.0), {}
    for s in nbr:
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in nbr[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in nbr[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            between[w] += delta[w] / 2
        close[s] = (len(order) - 1) ** 2 / sum(dist.values()) / (len(nbr) - 1)
    return between, close


def test_shortest_paths_over_blocks_waves_and_groups_are_brandes(spark, monkeypatch):
    """Free and kept nodes, edges between kept ones, a long path, a second part,
    a few edges a block, a few sources a batch, two batches a wave."""
    import random

    from ledgerhawk.operators.graph import paths
    rnd = random.Random(5)
    edges = {(h, rnd.randrange(10, 30)) for h in range(5) for _ in range(7)} | {(0, 1), (1, 2), (0, 3)}
    edges |= {(i, i + 1) for i in range(29, 36)} | {(50, i) for i in range(51, 55)} | {(60, 61), (61, 62), (62, 60)}
    between, close = _plain_paths(edges)
    monkeypatch.setattr(paths, "BLOCK", 20)
    monkeypatch.setattr(paths, "ADDED", 6)
    monkeypatch.setattr(paths, "WAVE", 900)
    g = graph(spark, sorted(edges)).checkpointed()
    got = paths.shortest_paths(g, normalized=False, pairs=20 * len(between)).collect()
    assert {r["node"]: r["betweenness_centrality"] for r in got} == pytest.approx(between)
    assert {r["node"]: r["closeness_centrality"] for r in got} == pytest.approx(close)
    assert as_map(paths.closeness(g), "closeness_centrality") == pytest.approx(close)


def test_shortest_paths_store_vectors_of_kept_nodes_only(spark, monkeypatch):
    """Thirty accounts around two hubs: only the hubs' vectors are stored."""
    from ledgerhawk.operators.graph import paths
    from ledgerhawk.session import cut_lineage
    rows = []

    def counted(df):
        out = cut_lineage(df)
        if "sigma" in df.columns:
            rows.append(out.where("sigma is not null").count())
        return out

    monkeypatch.setattr(paths, "cut_lineage", counted)
    edges = [(h, i) for h in (1, 2) for i in range(10, 40)]
    got = paths.shortest_paths(graph(spark, edges), normalized=False).collect()
    assert {r["node"]: r["betweenness_centrality"] for r in got} == pytest.approx(_plain_paths(edges)[0])
    assert rows and max(rows) == 2


def test_pivots_beyond_reach_leave_zeros(spark):
    """One pivot: nodes of other parts hear nothing and count as 0."""
    from ledgerhawk.operators.graph.paths import betweenness
    b = as_map(betweenness(graph(spark, [(1, 2), (2, 3), (11, 12), (12, 13)]), k=1, normalized=False), "betweenness_centrality")
    assert len(b) == 6 and None not in b.values() and sum(b.values()) in (0.0, 3.0)


def test_wedges_that_no_edge_closes_stay_in_their_task(spark, monkeypatch):
    """Triangles equal a plain count with a roomy bitmap and with one of 64 bits;
    with the roomy one hardly more than the triangles leaves the tasks."""
    import random
    from itertools import combinations

    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(12), 2))) for _ in range(30)} | {(h, i) for i in range(100, 220) for h in rnd.sample(range(12), 6)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {tuple(sorted((str(a), str(b), str(c)))) for a in near for b, c in combinations(sorted(near[a]), 2) if c in near[b]}
    rows, made = spark.sparkContext.accumulator(0), lc._wedges

    def counted(bitmap, bits):
        def run(batches):
            for out in made(bitmap, bits)(batches):
                rows.add(out.num_rows)
                yield out
        return run

    monkeypatch.setattr(lc, "_wedges", counted)
    monkeypatch.setattr(lc, "SLICE", 50)
    g = graph(spark, sorted(edges)).checkpointed()
    got = [tuple(sorted(r)) for r in lc.triangle_list(g).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) <= rows.value < len(want) + 100
    monkeypatch.setattr(lc, "MOST_BITS", 6)
    assert {tuple(sorted(r)) for r in lc.triangle_list(g).collect()} == want
    assert lc.triangle_list(graph(spark, [(1, 2)])).count() == 0


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from ledgerhawk.session import cut_lineage

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    t = cut_lineage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not {f for f in files() - before if f.endswith(".data")}
    assert t.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_eigenvector_needs_few_products_where_eigenvalues_are_near(spark, monkeypatch):
    """A path of thirty (next eigenvalue 1 % below, one near it below zero), where
    single rounds would take over a thousand; parts with a smaller and an equal eigenvalue."""
    from math import pi, sin
    g = graph(spark, [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52)]).checkpointed()
    products, along = [], it._along
    monkeypatch.setattr(it, "_along", lambda *a: products.append(1) or along(*a))
    got = as_map(it.eigenvector(g, max_iter=100, tol=1e-10), "eigenvector")
    norm = sum(sin(pi * i / 31) ** 2 for i in range(1, 31)) ** 0.5
    assert got == pytest.approx({str(i): sin(pi * i / 31) / norm for i in range(1, 31)} | {"50": 0.0, "51": 0.0, "52": 0.0}, abs=1e-8)
    assert len(products) < 60 and min(got.values()) >= 0
    twice = as_map(it.eigenvector(graph(spark, [(1, 2), (2, 3), (11, 12), (12, 13)]), tol=1e-10), "eigenvector")
    assert twice == pytest.approx({"1": 8 ** -0.5, "2": 0.5, "3": 8 ** -0.5, "11": 8 ** -0.5, "12": 0.5, "13": 8 ** -0.5})
    with pytest.raises(it.NotConverged):
        it.eigenvector(g, max_iter=5, tol=1e-10)


@pytest.mark.parametrize("measure", ["pagerank", "eigenvector", "kcore", "label_propagation"])
def test_rounds_join_numbers_and_leave_few_tables(spark, monkeypatch, measure):
    """Edges are placed by number, in the order of the names, and tables of rounds gone by are deleted."""
    from pathlib import Path
    from urllib.parse import urlparse
    kinds, stored, placed, cut = [], [], it.placed, it.cut_lineage

    def kept(df):
        out = cut(df)
        stored.append(Path(urlparse(out.inputFiles()[0]).path).parent)
        return out

    monkeypatch.setattr(it, "placed", lambda df, key: kinds.append(dict(df.dtypes)) or placed(df, key))
    g = graph(spark, [(i, i + 1) for i in range(1, 14)] + [(20, 21)]).checkpointed()
    names = {r["node"]: r["no"] for r in g.numbered()[0].collect()}
    assert [v for _, v in sorted(names.items())] == list(range(16))
    monkeypatch.setattr(it, "cut_lineage", kept)
    out = getattr(it, measure)(g)
    assert {r["node"] for r in out.collect()} == set(names)
    assert [{t for c, t in k.items() if c != "p"} for k in kinds] == [{"bigint"}]
    assert len(stored) > 3 and sum(f.exists() for f in stored) <= 3


def test_closeness_over_blocks_and_batches_stores_kept_nodes_only(spark, monkeypatch):
    """Equal to a plain search over a few edges a block, batches of seven sources, two abreast;
    of thirty accounts around two hubs only the hubs have bitmaps."""
    import random

    from ledgerhawk.operators.graph import paths
    from ledgerhawk.session import cut_lineage
    rnd, rows = random.Random(8), []

    def counted(df):
        out = cut_lineage(df)
        if "bits" in df.columns:
            rows.append(out.where("bits is not null").count())
        return out

    edges = {(h, rnd.randrange(10, 30)) for h in range(5) for _ in range(7)} | {(0, 1), (1, 2), (0, 3)}
    edges |= {(i, i + 1) for i in range(29, 36)} | {(50, i) for i in range(51, 55)} | {(60, 61), (61, 62), (62, 60)}
    with monkeypatch.context() as m:
        m.setattr(paths, "BLOCK", 3)
        m.setattr(paths, "ADDED", 6)
        m.setattr(paths, "BATCH", 7)
        m.setattr(paths, "ABREAST", 500)
        got = as_map(paths.closeness(graph(spark, sorted(edges)).checkpointed()), "closeness_centrality")
    assert got == pytest.approx(_plain_paths(edges)[1])
    monkeypatch.setattr(paths, "cut_lineage", counted)
    hubs = [(h, i) for h in (1, 2) for i in range(10, 40)]
    assert as_map(paths.closeness(graph(spark, hubs)), "closeness_centrality") == pytest.approx(_plain_paths(hubs)[1])
    assert rows and max(rows) == 2
