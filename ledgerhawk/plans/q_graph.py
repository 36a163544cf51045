"""Account-graph queries (2.J) over the graph of all transactions.

Iterative measures run until they settle; their oracle unrolls as many
rounds in SQL as bring the same values past the last place compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import iterative as it
from ..operators.graph import local as lc
from ..operators.graph.build import build_graph, per_dataset_edges
from ..sources import adapters as ad
from .catalog import finish, register
from .oracle_views import with_views

#: Rounds unrolled in the oracle SQL, well past convergence.
PR_ROUNDS, HITS_ROUNDS, KATZ_ROUNDS, EIGEN_ROUNDS, CORE_ROUNDS, LABEL_ROUNDS = 40, 24, 24, 100, 60, 40
R = 10  # decimals kept for values that are sums in data-dependent order
C = 8   # decimals kept for values at convergence


def _g(spark, sf):
    return build_graph(ad.graph_transactions(spark, sf)).checkpointed()


def rr(c):
    return F.round(F.col(c), C).alias(c)


G_BASE = [
    ("de", """SELECT cust_id AS src, dest_id AS dst, CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE) AS weight,
              count(*) AS cnt FROM gtxn GROUP BY cust_id, dest_id"""),
    ("nodes", "SELECT src AS node FROM de UNION SELECT dst FROM de"),
    ("ue", """SELECT least(src, dst) AS u, greatest(src, dst) AS v,
              CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS weight, sum(cnt) AS cnt FROM de GROUP BY 1, 2"""),
    ("adj", "SELECT u AS node, v AS nbr FROM ue UNION ALL SELECT v, u FROM ue"),
    ("deg", """SELECT n.node, coalesce(d.degree, 0) AS degree FROM nodes n
               LEFT JOIN (SELECT node, count(*) AS degree FROM adj GROUP BY node) d USING (node)"""),
    ("nn", "SELECT count(*) AS n FROM nodes"),
]


def gsql(sql: str, extra=None, materialize_extra=None) -> str:
    base = with_views("SELECT 1", ["txn", "gtxn"], G_BASE + (extra or []))
    head = base[: base.rindex("\nSELECT 1")]
    if materialize_extra:
        head += ",\n" + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in materialize_extra)
    return head + "\n" + sql


@register("degree_centrality", gsql("""
SELECT node, degree, CASE WHEN n > 1 THEN degree / (n - 1) ELSE 0.0 END AS degree_centrality FROM deg, nn"""))
def q_degree_centrality(spark, sf):
    return finish(lc.degree_centrality(_g(spark, sf)))


@register("flow_features", gsql("""
SELECT node, iw AS in_degree_weighted, ow AS out_degree_weighted, ic AS in_degree_count, oc AS out_degree_count,
       CASE WHEN iw + ow > 0 THEN ow / (iw + ow) ELSE 0.5 END AS flow_ratio,
       CASE WHEN ic + oc > 0 THEN (iw + ow) / (ic + oc) ELSE 0.0 END AS velocity_score,
       CASE WHEN ow > 0 THEN least(1.0, ow / (iw + ow + 1)) ELSE 0.0 END AS concentration_index
FROM (SELECT n.node, coalesce(i.w, 0.0) AS iw, coalesce(o.w, 0.0) AS ow, CAST(coalesce(i.c, 0) AS BIGINT) AS ic, CAST(coalesce(o.c, 0) AS BIGINT) AS oc
      FROM nodes n
      LEFT JOIN (SELECT dst AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w, sum(cnt) AS c
                 FROM de GROUP BY dst) i USING (node)
      LEFT JOIN (SELECT src AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w, sum(cnt) AS c
                 FROM de GROUP BY src) o USING (node)) x"""))
def q_flow(spark, sf):
    f = lc.flow(_g(spark, sf))
    return finish(f.select("node", "in_degree_weighted", "out_degree_weighted",
                           F.col("in_degree_count").cast("long").alias("in_degree_count"),
                           F.col("out_degree_count").cast("long").alias("out_degree_count"),
                           "flow_ratio", "velocity_score", "concentration_index"))


TRI = ("tri", """SELECT n.node, coalesce(t.c, 0) AS triangle_count FROM nodes n LEFT JOIN (
  SELECT node, count(*) AS c FROM (
    SELECT a.node AS node FROM adj a JOIN adj b ON a.nbr = b.node JOIN adj c ON b.nbr = c.node AND c.nbr = a.node
    WHERE a.node <> b.node) t0 GROUP BY node) t USING (node)""")


@register("triangles", gsql("SELECT node, CAST(triangle_count / 2 AS BIGINT) AS triangle_count FROM tri", [TRI]))
def q_triangles(spark, sf):
    return finish(lc.triangles(_g(spark, sf)))


@register("clustering", gsql("""
SELECT node, degree, triangle_count,
       CASE WHEN degree > 1 THEN 2.0 * triangle_count / (degree * (degree - 1)) ELSE 0.0 END AS clustering_coefficient,
       CASE WHEN degree >= 2 THEN triangle_count / degree ELSE 0.0 END AS square_clustering,
       CASE WHEN degree > 0 THEN 1.0 / degree ELSE 0.0 END AS constraint,
       CASE WHEN degree > 0 THEN degree - triangle_count / degree ELSE 0.0 END AS effective_size
FROM (SELECT node, degree, CAST(triangle_count / 2 AS BIGINT) AS triangle_count FROM tri JOIN deg USING (node)) x""",
                             [TRI]))
def q_clustering(spark, sf):
    return finish(lc.structural(_g(spark, sf)))


@register("local_anomaly", gsql("""
SELECT node, degree, avg_neighbor_degree,
       CASE WHEN degree > 0 THEN least(abs(degree - avg_neighbor_degree) / (avg_neighbor_degree + 1), 5.0)
            ELSE 1.0 END AS local_anomaly_score
FROM deg LEFT JOIN (SELECT a.node, avg(d.degree) AS avg_neighbor_degree FROM adj a
                    JOIN deg d ON a.nbr = d.node GROUP BY a.node) x USING (node)"""))
def q_local_anomaly(spark, sf):
    return finish(lc.local_anomaly(_g(spark, sf)))


@register("temporal_presence", gsql("""
SELECT node,
       CASE WHEN k > 1 THEN coalesce(p, 0) ELSE 1 END AS dataset_presence,
       round(CASE WHEN k > 1 THEN greatest(0.0, s2 / k - (s / k) * (s / k)) ELSE 0.0 END, 9) AS degree_variance,
       round(CASE WHEN k > 1 THEN 1.0 / (1.0 + greatest(0.0, s2 / k - (s / k) * (s / k))) ELSE 1.0 END, 9)
         AS degree_stability
FROM (SELECT n.node, x.p, coalesce(x.s, 0) AS s, coalesce(x.s2, 0) AS s2, kk.k FROM nodes n
      LEFT JOIN (SELECT node, count(*) AS p, sum(deg) AS s, sum(deg * deg) AS s2 FROM (
                   SELECT dataset, node, count(*) AS deg FROM (
                     SELECT dataset, src AS node FROM dse UNION ALL SELECT dataset, dst FROM dse) a
                   GROUP BY dataset, node) b GROUP BY node) x USING (node),
      (SELECT count(DISTINCT dataset) AS k FROM dse) kk) y""",
                                     [("dse", "SELECT DISTINCT dataset, cust_id AS src, dest_id AS dst FROM gtxn")]))
def q_temporal(spark, sf):
    t = ad.graph_transactions(spark, sf)
    g = build_graph(t)
    d = lc.dataset_stability(g, per_dataset_edges(t))
    return finish(d.select("node", "dataset_presence", F.round("degree_variance", 9).alias("degree_variance"),
                           F.round("degree_stability", 9).alias("degree_stability")))


# ------------------------------------------------------------ iterative, fixed rounds
def _pagerank_sql(n_rounds: int, alpha: float = 0.85) -> str:
    ctes, loop = _pagerank_ctes(n_rounds, alpha)
    return gsql(f"SELECT node, round(pr, {C}) AS pagerank FROM x{n_rounds}", ctes, loop)


def _pagerank_ctes(n_rounds: int, alpha: float = 0.85):
    a, b = repr(alpha), repr(1 - alpha)
    ctes = [("ow", "SELECT src, sum(weight) AS ow FROM de GROUP BY src"),
            ("pe", "SELECT de.src, dst, weight / ow AS p FROM de JOIN ow USING (src)"),
            ("dang", "SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM ow)")]
    loop = [("x0", "SELECT node, 1.0 / (SELECT n FROM nn) AS pr FROM nodes")]
    for i in range(1, n_rounds + 1):
        p = f"x{i - 1}"
        loop.append((f"x{i}", f"""SELECT nodes.node,
  CAST({a} AS DOUBLE) * (coalesce(c.s, 0.0) + (SELECT coalesce(sum(pr), 0.0) FROM {p} JOIN dang USING (node)) / nn.n)
  + CAST({b} AS DOUBLE) / nn.n AS pr
FROM nodes LEFT JOIN (SELECT dst AS node, sum(pr * p) AS s FROM pe JOIN {p} ON pe.src = {p}.node GROUP BY dst) c
  USING (node), nn"""))
    return ctes, loop


@register("pagerank_n", _pagerank_sql(PR_ROUNDS))
def q_pagerank_n(spark, sf):
    p = it.pagerank(_g(spark, sf))
    return finish(p.select("node", rr("pagerank")))


@register("pagerank", _pagerank_sql(PR_ROUNDS, 0.5))
def q_pagerank(spark, sf):
    """PageRank with a damping of one half."""
    p = it.pagerank(_g(spark, sf), alpha=0.5)
    return finish(p.select("node", rr("pagerank")))


def _hits_sql(n_rounds: int) -> str:
    loop = [("h0", "SELECT node, 1.0 / (SELECT n FROM nn) AS hub FROM nodes")]
    for i in range(1, n_rounds + 1):
        p = f"h{i - 1}"
        loop.append((f"ar{i}", f"""SELECT nodes.node, coalesce(s, 0.0) AS authority FROM nodes LEFT JOIN (
  SELECT dst AS node, sum(hub * weight) AS s FROM de JOIN {p} ON de.src = {p}.node GROUP BY dst) x USING (node)"""))
        loop.append((f"hr{i}", f"""SELECT nodes.node, coalesce(s, 0.0) AS hub FROM nodes LEFT JOIN (
  SELECT src AS node, sum(authority * weight) AS s FROM de JOIN ar{i} ON de.dst = ar{i}.node GROUP BY src) x
  USING (node)"""))
        loop.append((f"h{i}", f"""SELECT node, CASE WHEN t > 0 THEN hub / t ELSE 0.0 END AS hub FROM hr{i},
  (SELECT sum(hub) AS t FROM hr{i}) z"""))
    loop.append(("an", f"""SELECT node, CASE WHEN t > 0 THEN authority / t ELSE 0.0 END AS authority FROM ar{n_rounds},
  (SELECT sum(authority) AS t FROM ar{n_rounds}) z"""))
    return gsql(f"SELECT node, round(hub, {C}) AS hub, round(authority, {C}) AS authority FROM h{n_rounds} "
                f"JOIN an USING (node)", None, loop)


@register("hits_n", _hits_sql(HITS_ROUNDS))
def q_hits_n(spark, sf):
    h = it.hits(_g(spark, sf))
    return finish(h.select("node", rr("hub"), rr("authority")))


def _katz_sql(n_rounds: int, alpha: float = 0.1, beta: float = 1.0) -> str:
    loop = [("k0", "SELECT node, 0.0::DOUBLE AS katz FROM nodes")]
    for i in range(1, n_rounds + 1):
        p = f"k{i - 1}"
        loop.append((f"k{i}", f"""SELECT nodes.node, CAST({alpha!r} AS DOUBLE) * coalesce(s, 0.0) + CAST({beta!r} AS DOUBLE)
  AS katz FROM nodes LEFT JOIN (SELECT dst AS node, sum(katz) AS s FROM de JOIN {p} ON de.src = {p}.node
  GROUP BY dst) x USING (node)"""))
    # no limit (the last round still moved): 0 by definition
    return gsql(f"""SELECT node, round(CASE WHEN nrm > 0 AND moved < 1e-3 THEN katz / nrm ELSE 0.0 END, {C}) AS katz_centrality
FROM k{n_rounds}, (SELECT sqrt(sum(katz * katz)) AS nrm FROM k{n_rounds}) z,
  (SELECT sum(abs(a.katz - b.katz)) AS moved FROM k{n_rounds} a JOIN k{n_rounds - 1} b USING (node)) y""", None, loop)


KATZ_ALPHA = 0.001


@register("katz_n", _katz_sql(KATZ_ROUNDS, KATZ_ALPHA))
def q_katz_n(spark, sf):
    """Katz with an attenuation below the inverse of the largest eigenvalue of
    these dense graphs, where the usual 0.1 has no limit (then 0 everywhere)."""
    k = it.katz(_g(spark, sf), alpha=KATZ_ALPHA, tol=1e-9)
    return finish(k.select("node", rr("katz_centrality")))


def _eigen_sql(n_rounds: int) -> str:
    loop = [("e0", "SELECT node, 1.0 / (SELECT n FROM nn) AS ev FROM nodes")]
    for i in range(1, n_rounds + 1):
        p = f"e{i - 1}"
        loop.append((f"er{i}", f"""SELECT {p}.node, {p}.ev + coalesce(s, 0.0) AS r FROM {p} LEFT JOIN (
  SELECT adj.node, sum(ev) AS s FROM adj JOIN {p} x ON adj.nbr = x.node GROUP BY adj.node) y USING (node)"""))
        loop.append((f"e{i}", f"""SELECT node, CASE WHEN nrm > 0 THEN r / nrm ELSE r END AS ev FROM er{i},
  (SELECT sqrt(sum(r * r)) AS nrm FROM er{i}) z"""))
    return gsql(f"SELECT node, round(ev, 7) AS eigenvector FROM e{n_rounds}", None, loop)


@register("eigen_n", _eigen_sql(EIGEN_ROUNDS))
def q_eigen_n(spark, sf):
    e = it.eigenvector(_g(spark, sf), tol=1e-10)
    return finish(e.select("node", F.round("eigenvector", 7).alias("eigenvector")))


def _kcore_sql(n_rounds: int) -> str:
    loop = [("c0", "SELECT node, degree AS core FROM deg")]
    for i in range(1, n_rounds + 1):
        p = f"c{i - 1}"
        loop.append((f"c{i}", f"""SELECT {p}.node, least({p}.core, coalesce(h.h, 0)) AS core FROM {p} LEFT JOIN (
  SELECT node, max(least(c, ge)) AS h FROM (
    SELECT node, c, sum(k) OVER (PARTITION BY node ORDER BY c DESC) AS ge FROM (
      SELECT adj.node, x.core AS c, count(*) AS k FROM adj JOIN {p} x ON adj.nbr = x.node GROUP BY 1, 2) t) u
  GROUP BY node) h USING (node)"""))
    return gsql(f"SELECT node, CAST(core AS BIGINT) AS core_number FROM c{n_rounds}", None, loop)


@register("kcore", _kcore_sql(CORE_ROUNDS))
def q_kcore(spark, sf):
    return finish(it.kcore(_g(spark, sf)))


def _lp_sql(n_rounds: int) -> str:
    loop = [("l0", "SELECT node, node AS label FROM nodes")]
    for i in range(1, n_rounds + 1):
        p = f"l{i - 1}"
        loop.append((f"lc{i}", f"""SELECT adj.node, x.label AS nl, count(*) AS k FROM adj JOIN {p} x ON adj.nbr = x.node
  GROUP BY 1, 2"""))
        loop.append((f"l{i}", f"""SELECT o.node, CASE WHEN md5(o.node || ':{i}') < '8' AND any_value(c.nl) IS NOT NULL
    THEN min(struct_pack(k := -c.k, other := c.nl <> o.label, nl := c.nl)).nl ELSE o.label END AS label
  FROM {p} o LEFT JOIN lc{i} c USING (node) GROUP BY o.node, o.label"""))
    loop.append(("comm", f"""SELECT l.node, s.community_id, s.community_size FROM l{n_rounds} l JOIN (
  SELECT label, min(node) AS community_id, count(*) AS community_size FROM l{n_rounds} GROUP BY label) s USING (label)"""))
    return loop


@register("label_prop_n", gsql("SELECT node, community_id, community_size FROM comm", None, _lp_sql(LABEL_ROUNDS)))
def q_label_prop_n(spark, sf):
    return finish(it.label_propagation(_g(spark, sf)))


@register("modularity", gsql("""
SELECT n.node, CASE WHEN d > 0 THEN (i - (d - i)) / d ELSE 0.0 END AS modularity_contribution
FROM nodes n LEFT JOIN (
  SELECT a.node, count(*) AS d, count(*) FILTER (WHERE c1.community_id = c2.community_id) AS i
  FROM adj a JOIN comm c1 ON a.node = c1.node LEFT JOIN comm c2 ON a.nbr = c2.node GROUP BY a.node) x USING (node)""",
                             None, _lp_sql(LABEL_ROUNDS)))
def q_modularity(spark, sf):
    g = _g(spark, sf)
    return finish(lc.modularity_share(g, it.label_propagation(g)))


# ------------------------------------------------------------ paths, node table, role joins
def _closeness_sql(levels: int) -> str:
    loop = [("num", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM nodes"),
            ("s0", "SELECT node, set_bit(bitstring('0', CAST(n AS INTEGER)), CAST(i AS INTEGER), 1) AS b FROM num, nn")]
    for i in range(1, levels + 1):
        loop.append((f"s{i}", f"""SELECT node, bit_or(b) AS b FROM (SELECT adj.node, b FROM adj JOIN s{i - 1} x ON adj.nbr = x.node
  UNION ALL SELECT node, b FROM s{i - 1}) y GROUP BY node"""))
    loop += [(f"sc{i}", f"SELECT node, bit_count(b) AS c FROM s{i}") for i in range(levels + 1)]
    total = " + ".join(f"{i} * (sc{i}.c - sc{i - 1}.c)" for i in range(1, levels + 1))
    joins = " ".join(f"JOIN sc{i} USING (node)" for i in range(1, levels + 1))
    return gsql(f"""SELECT node, CASE WHEN t > 0 AND n > 1 THEN round((r / t) * (r / (n - 1)), {R}) ELSE 0.0 END AS closeness_centrality
FROM (SELECT node, CAST({total} AS DOUBLE) AS t, CAST(sc{levels}.c - 1 AS DOUBLE) AS r FROM sc0 {joins}) x, nn""", None, loop)


@register("closeness", _closeness_sql(8))
def q_closeness(spark, sf):
    """Exact closeness."""
    from ..operators.graph.paths import closeness
    return finish(closeness(_g(spark, sf)).select("node", F.round("closeness_centrality", R).alias("closeness_centrality")))


@register("betweenness")
def q_betweenness(spark, sf):
    """Exact betweenness over all sources."""
    from ..operators.graph.paths import betweenness
    return finish(betweenness(_g(spark, sf)).select("node", F.round("betweenness_centrality", R).alias("betweenness_centrality")))


@register("node_features")
def q_node_features(spark, sf):
    """The node table."""
    from ..operators.graph.table import node_features
    return finish(node_features(ad.graph_transactions(spark, sf)))


ROLE_COLS = ["degree_centrality", "clustering_coefficient", "triangle_count", "in_degree_weighted",
             "out_degree_weighted", "local_anomaly_score"]
NODE_LOCAL = ("nloc", """SELECT d.node, CASE WHEN n > 1 THEN d.degree / (n - 1) ELSE 0.0 END AS degree_centrality,
       CASE WHEN d.degree > 1 THEN 2.0 * t.tc / (d.degree * (d.degree - 1)) ELSE 0.0 END AS clustering_coefficient,
       t.tc AS triangle_count, coalesce(i.w, 0.0) AS in_degree_weighted, coalesce(o.w, 0.0) AS out_degree_weighted,
       CASE WHEN d.degree > 0 THEN least(abs(d.degree - a.avg_nd) / (a.avg_nd + 1), 5.0) ELSE 1.0 END
         AS local_anomaly_score
FROM deg d, nn
JOIN (SELECT node, CAST(triangle_count / 2 AS BIGINT) AS tc FROM tri) t ON t.node = d.node
LEFT JOIN (SELECT dst AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w FROM de GROUP BY dst) i
  ON i.node = d.node
LEFT JOIN (SELECT src AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w FROM de GROUP BY src) o
  ON o.node = d.node
LEFT JOIN (SELECT a.node, avg(x.degree) AS avg_nd FROM adj a JOIN deg x ON a.nbr = x.node GROUP BY a.node) a
  ON a.node = d.node""")


@register("graph_txn_features", gsql(
    "SELECT t.txn_id, " + ", ".join(f"coalesce(c.{x}, 0) AS cust_{x}, coalesce(d.{x}, 0) AS dest_{x}" for x in ROLE_COLS)
    + " FROM txn t LEFT JOIN nloc c ON c.node = t.cust_id LEFT JOIN nloc d ON d.node = t.dest_id",
    [TRI, NODE_LOCAL]))
def q_graph_txn_features(spark, sf):
    """Every transaction with its two accounts' graph features."""
    from ..operators.graph.table import attach_node_features, local_node_table
    nodes = local_node_table(_g(spark, sf))
    t = attach_node_features(ad.transactions(spark, sf).select("txn_id", "cust_id", "dest_id"), nodes, ROLE_COLS)
    return finish(t.select("txn_id", *[f"{p}_{x}" for x in ROLE_COLS for p in ("cust", "dest")]))


_PR_CTES, _PR_LOOP = _pagerank_ctes(PR_ROUNDS)


@register("network_statistics", gsql(f"""
SELECT count(*) AS total_nodes, count(*) FILTER (WHERE is_user) AS user_nodes,
       count(*) FILTER (WHERE NOT is_user) AS agency_nodes, round(avg(dc), 12) AS avg_degree_centrality,
       max(dc) AS max_degree_centrality, round(avg(pr), {C}) AS avg_pagerank,
       count(DISTINCT community_id) AS total_communities, round(avg(community_size), 12) AS avg_community_size
FROM (SELECT d.node, d.node IN (SELECT src FROM de) AS is_user,
             CASE WHEN nn.n > 1 THEN d.degree / (nn.n - 1) ELSE 0.0 END AS dc, x.pr, c.community_id, c.community_size
      FROM deg d, nn JOIN x{PR_ROUNDS} x ON x.node = d.node JOIN comm c ON c.node = d.node) t""",
    _PR_CTES, _PR_LOOP + _lp_sql(LABEL_ROUNDS)))
def q_network_statistics(spark, sf):
    """Network statistics view over the node table (D8): node counts by
    role, mean / max degree centrality, mean PageRank, communities."""
    g = _g(spark, sf).checkpointed()
    users = g.directed.select(F.col("src").alias("node")).distinct().withColumn("is_user", F.lit(True))
    t = (lc.degree_centrality(g).join(it.pagerank(g), "node")
         .join(it.label_propagation(g), "node").join(users, "node", "left"))
    u = F.coalesce(F.col("is_user"), F.lit(False))
    s = t.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(u).alias("user_nodes"),
              F.count_if(~u).alias("agency_nodes"), F.round(F.avg("degree_centrality"), 12).alias("avg_degree_centrality"),
              F.max("degree_centrality").alias("max_degree_centrality"),
              F.round(F.avg("pagerank"), C).alias("avg_pagerank"),
              F.countDistinct("community_id").alias("total_communities"),
              F.round(F.avg("community_size"), 12).alias("avg_community_size"))
    return finish(s)


TRI_LIST = ("tl", """SELECT a.node AS a, b.node AS b, c.node AS c FROM adj a JOIN adj b ON a.nbr = b.node
  JOIN adj c ON b.nbr = c.node AND c.nbr = a.node WHERE a.node < b.node AND b.node < c.node""")
CORNERS = ("cr", """SELECT a AS v, least(b, c) AS x, greatest(b, c) AS y FROM tl UNION ALL
  SELECT b, least(a, c), greatest(a, c) FROM tl UNION ALL SELECT c, least(a, b), greatest(a, b) FROM tl""")
TRIP = ("tp", """SELECT a AS node, b AS nbr, c AS q FROM tl UNION ALL SELECT a, c, b FROM tl UNION ALL
  SELECT b, a, c FROM tl UNION ALL SELECT b, c, a FROM tl UNION ALL SELECT c, a, b FROM tl UNION ALL
  SELECT c, b, a FROM tl""")


@register("structural_v2", gsql(f"""
SELECT d.node,
  CASE WHEN d.degree > 1 THEN coalesce(sq.s, 0) / (d.degree * (d.degree - 1) / 2.0) ELSE 0.0 END AS square_clustering_v2,
  round(coalesce(cn.c, 0.0), {R}) AS constraint_v2,
  CASE WHEN d.degree > 0 THEN d.degree - 2.0 * coalesce(tc.t, 0) / d.degree ELSE 0.0 END AS effective_size_v2
FROM deg d
LEFT JOIN (SELECT v AS node, sum(te - 1) AS s FROM cr JOIN (SELECT x, y, count(*) AS te FROM cr GROUP BY x, y) e
           USING (x, y) GROUP BY v) sq ON sq.node = d.node
LEFT JOIN (SELECT v AS node, count(*) AS t FROM cr GROUP BY v) tc ON tc.node = d.node
LEFT JOIN (SELECT a.node, sum(pow(1.0 / dg.degree + coalesce(i.s, 0.0) / dg.degree, 2)) AS c
           FROM adj a JOIN deg dg ON dg.node = a.node
           LEFT JOIN (SELECT tp.node, tp.nbr, sum(1.0 / dq.degree) AS s FROM tp JOIN deg dq ON dq.node = tp.q
                      GROUP BY 1, 2) i ON i.node = a.node AND i.nbr = a.nbr
           GROUP BY a.node) cn ON cn.node = d.node""", [TRI_LIST, CORNERS, TRIP]))
def q_structural_v2(spark, sf):
    s = lc.structural_v2(_g(spark, sf))
    return finish(s.withColumn("constraint_v2", F.round("constraint_v2", R)))


@register("flow_concentration_v2", gsql(f"""
SELECT src AS node, round(sum(pow(weight / t, 2)), {R}) AS concentration_hhi
FROM de JOIN (SELECT src, sum(weight) AS t FROM de GROUP BY src) USING (src) GROUP BY src"""))
def q_flow_hhi(spark, sf):
    """Herfindahl concentration of each account's out-flow (J15 v2)."""
    return finish(lc.herfindahl(_g(spark, sf)).withColumn("concentration_hhi", F.round("concentration_hhi", R)))


@register("fraud_exposure", gsql("""
SELECT n.node, coalesce(nb.r, 0.0) AS neighbor_fraud_rate, coalesce(ct.r, 0.0) AS community_fraud_rate
FROM nodes n
LEFT JOIN (SELECT a.node, avg(CASE WHEN f.node IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r FROM adj a
           LEFT JOIN (SELECT cust_id AS node FROM gtxn WHERE label = 1 UNION SELECT dest_id FROM gtxn WHERE label = 1) f
             ON f.node = a.nbr GROUP BY a.node) nb ON nb.node = n.node
LEFT JOIN comm c ON c.node = n.node
LEFT JOIN (SELECT c.community_id, sum(t.label) / count(*) AS r FROM gtxn t JOIN comm c ON c.node = t.cust_id
           GROUP BY c.community_id) ct ON ct.community_id = c.community_id""", None, _lp_sql(LABEL_ROUNDS)))
def q_fraud_exposure(spark, sf):
    """Neighbour and community fraud rates on the account graph (survey
    §2.E documented-only features)."""
    t = ad.graph_transactions(spark, sf)
    g = build_graph(t).checkpointed()
    return finish(lc.fraud_exposure(g, t, it.label_propagation(g)))


FROZEN_COLS = ["degree_centrality", "in_degree_weighted", "out_degree_weighted"]
_G_TRAIN = [(n, b.replace("FROM gtxn", "FROM gtr")) for n, b in G_BASE]


@register("frozen_graph_join", with_views(
    "SELECT v.txn_id, " + ", ".join(f"coalesce(c.{x}, 0) AS cust_{x}, coalesce(d.{x}, 0) AS dest_{x}"
                                    for x in FROZEN_COLS)
    + " FROM (SELECT * FROM sp WHERE NOT is_train) v LEFT JOIN nf c ON c.node = v.cust_id"
      " LEFT JOIN nf d ON d.node = v.dest_id",
    ["txn"],
    [("sp", "SELECT *, row_number() OVER (ORDER BY ts, txn_id) <= floor(count(*) OVER () * 0.8) AS is_train FROM txn"),
     ("gtr", "SELECT * FROM sp WHERE is_train AND cust_id <> dest_id")] + _G_TRAIN + [
        ("nf", """SELECT d.node, CASE WHEN nn.n > 1 THEN d.degree / (nn.n - 1) ELSE 0.0 END AS degree_centrality,
                  coalesce(i.w, 0.0) AS in_degree_weighted, coalesce(o.w, 0.0) AS out_degree_weighted
           FROM deg d, nn
           LEFT JOIN (SELECT dst AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w FROM de GROUP BY dst) i
             ON i.node = d.node
           LEFT JOIN (SELECT src AS node, CAST(sum(CAST(weight AS DECIMAL(38,2))) AS DOUBLE) AS w FROM de GROUP BY src) o
             ON o.node = d.node""")]))
def q_frozen_graph_join(spark, sf):
    """Leakage-safe order (C3): split in time first, build the graph and its
    node features from the earlier 80 % only, attach them to the later 20 %
    (unknown accounts -> 0)."""
    from ..operators.graph.table import attach_node_features
    from ..operators.sampling import time_split
    s = time_split(ad.transactions(spark, sf), "ts", "txn_id", 0.8)
    train = s.where(F.col("is_train") & (F.col("cust_id") != F.col("dest_id")))
    g = build_graph(train)
    nodes = lc.degree_centrality(g).join(lc.flow(g).select("node", "in_degree_weighted", "out_degree_weighted"), "node")
    val = s.where(~F.col("is_train")).select("txn_id", "cust_id", "dest_id")
    out = attach_node_features(val, nodes, FROZEN_COLS)
    return finish(out.select("txn_id", *[f"{p}_{x}" for x in FROZEN_COLS for p in ("cust", "dest")]))
