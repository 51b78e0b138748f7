"""Queries: dependency-graph metrics over the derived block graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators import graph as G
from failscope.plans.derived import edges, table, with_tables
from failscope.plans.features import _rounded
from failscope.plans.registry import query
from failscope.session import materialize

LONGEST = 19  # a block of 20 nodes has no longer path

NODES = """nodes AS (SELECT upstream AS node FROM edges UNION SELECT downstream FROM edges)"""
DEGREE = """degree AS (
SELECT node, CAST((SELECT count(*) FROM edges WHERE downstream = node) AS BIGINT) AS in_degree,
  CAST((SELECT count(*) FROM edges WHERE upstream = node) AS BIGINT) AS out_degree FROM nodes)"""
REACH = """reach AS (
SELECT upstream AS source, downstream AS node FROM edges
UNION SELECT r.source, e.downstream FROM reach r JOIN edges e ON e.upstream = r.node)"""
_WALKS = ["w1 AS MATERIALIZED (SELECT upstream AS s, downstream AS t, 1.0::DOUBLE AS c FROM edges)"]
for _k in range(2, LONGEST + 1):
    _WALKS.append(
        f"w{_k} AS MATERIALIZED (SELECT w.s, e.downstream AS t, sum(w.c) AS c FROM w{_k - 1} w "
        "JOIN edges e ON e.upstream = w.t GROUP BY 1, 2)")
WALKS = ",\n".join(_WALKS)
PATHS = "paths AS MATERIALIZED (SELECT s, t, min(d) AS d, arg_min(c, d) AS c FROM (" + " UNION ALL ".join(
    f"SELECT s, t, {_k} AS d, c FROM w{_k}" for _k in range(1, LONGEST + 1)) + ") u GROUP BY s, t)"
BETWEEN = """between_sum AS (
SELECT a.t AS node, sum(a.c * b.c / p.c) AS total FROM paths a JOIN paths b ON a.t = b.s
JOIN paths p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d GROUP BY 1),
betw AS (SELECT n.node, coalesce(total, 0.0) / ((k.n - 1) * (k.n - 2)) AS betweenness
FROM nodes n CROSS JOIN (SELECT count(*) AS n FROM nodes) k LEFT JOIN between_sum b ON b.node = n.node)"""
LEVELS = """lev AS (
SELECT node, 0 AS depth FROM degree WHERE in_degree = 0
UNION SELECT e.downstream, l.depth + 1 FROM lev l JOIN edges e ON e.upstream = l.node),
depth AS (SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM lev GROUP BY node)"""
COMPONENT = """links AS (SELECT upstream AS a, downstream AS b FROM edges
UNION SELECT downstream, upstream FROM edges),
und AS (SELECT node AS a, node AS b FROM nodes
UNION SELECT u.a, l.b FROM und u JOIN links l ON l.a = u.b),
comp AS (SELECT a AS node, min(b) AS component, count(*) AS component_size FROM und GROUP BY a)"""
RANK_ROUNDS = 40
_PR = ["""stat AS MATERIALIZED (SELECT count(*) AS n FROM nodes),
pr0 AS MATERIALIZED (SELECT d.node, d.out_degree, 1.0::DOUBLE / n AS r, 1.0::DOUBLE AS err FROM degree d CROSS JOIN stat)"""]
for _k in range(1, RANK_ROUNDS + 1):
    _PR.append(f"""q{_k} AS MATERIALIZED (
SELECT p.node, p.out_degree, p.r AS old, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0.0) FROM pr{_k - 1} WHERE out_degree = 0) / n
  + 0.85::DOUBLE * coalesce(g.s, 0.0) AS r
FROM pr{_k - 1} p CROSS JOIN stat LEFT JOIN (SELECT e.downstream AS node, sum(u.r / u.out_degree) AS s
  FROM edges e JOIN pr{_k - 1} u ON u.node = e.upstream GROUP BY 1) g ON g.node = p.node),
pr{_k} AS MATERIALIZED (SELECT node, out_degree, CASE WHEN done THEN old ELSE r END AS r,
  CASE WHEN done THEN 0.0::DOUBLE ELSE err2 END AS err
FROM q{_k} CROSS JOIN (SELECT (SELECT max(err) FROM pr{_k - 1}) < (SELECT n FROM stat) * 1e-6::DOUBLE AS done,
  (SELECT sum(abs(r - old)) FROM q{_k}) AS err2) z)""")
PAGERANK = ",\n".join(_PR) + f""",
pager AS (SELECT node, r AS pagerank FROM pr{RANK_ROUNDS})"""


def graph(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(G.build_graph(edges(spark, folder)), "edges")


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = graph(spark, folder)
    return e, G.closure(G.shortest_paths(e))


@query("dependency_edges", """
WITH typed AS (SELECT concat('n', CAST(o_custkey AS VARCHAR)) AS upstream,
  concat('n', CAST(o_custkey + 1 + o_orderkey % 5 AS VARCHAR)) AS downstream,
  o_orderpriority AS dependency_type FROM orders)
SELECT upstream, downstream, max(dependency_type) AS dependency_type FROM typed GROUP BY 1, 2""")
def q_edges(spark: SparkSession, folder: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    key = F.col("o_custkey")
    return G.build_graph(table(spark, folder, "orders").select(
        node(key).alias("upstream"), node(key + 1 + F.col("o_orderkey") % 5).alias("downstream"),
        F.col("o_orderpriority").alias("dependency_type")))


@query("nodes", with_tables("edges", NODES, select="SELECT node FROM nodes"))
def q_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.nodes(edges(spark, folder))


@query("degree", with_tables("edges", NODES, DEGREE, select="""
SELECT node, in_degree, out_degree, in_degree + out_degree AS total_degree,
  CAST(in_degree = 0 AS INTEGER) AS is_root, CAST(out_degree = 0 AS INTEGER) AS is_leaf FROM degree"""))
def q_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(edges(spark, folder))


@query("graph_summary", with_tables("edges", NODES, DEGREE, select="""
SELECT count(*) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges,
  count(*) FILTER (in_degree = 0) AS n_roots, count(*) FILTER (out_degree = 0) AS n_leaves FROM degree"""))
def q_summary(spark: SparkSession, folder: str) -> DataFrame:
    return G.graph_summary(edges(spark, folder))


@query("direct_neighbours", with_tables("edges", select="""
SELECT upstream AS node, 'downstream' AS direction, downstream AS neighbour FROM edges
UNION ALL SELECT downstream, 'upstream', upstream FROM edges"""))
def q_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return G.neighbours(edges(spark, folder))


@query("closure", with_tables("edges", WALKS, PATHS, select="""
SELECT s AS source, t AS node, CAST(d AS INTEGER) AS distance FROM paths"""))
def q_closure(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)[1]


@query("reach_counts", with_tables("edges", NODES, REACH, select="""
SELECT n.node, CAST((SELECT count(*) FROM reach r WHERE r.source = n.node) AS BIGINT) AS downstream_count,
  CAST((SELECT count(*) FROM reach r WHERE r.node = n.node) AS BIGINT) AS upstream_count FROM nodes n"""))
def q_counts(spark: SparkSession, folder: str) -> DataFrame:
    return G.reach_counts(_pairs(spark, folder)[1])


@query("depth", with_tables("edges", NODES, DEGREE, LEVELS, select="SELECT node, depth FROM depth"))
def q_depth(spark: SparkSession, folder: str) -> DataFrame:
    return G.depths(graph(spark, folder))


@query("betweenness", with_tables("edges", NODES, WALKS, PATHS, BETWEEN, select="""
SELECT node, round(betweenness, 12) AS betweenness FROM betw"""))
def q_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    e = graph(spark, folder)
    return _rounded(G.betweenness(e, G.shortest_paths(e)), 12)


@query("pagerank", with_tables("edges", NODES, DEGREE, PAGERANK, select="""
SELECT node, round(pagerank, 10) AS pagerank FROM pager"""))
def q_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(G.pagerank(graph(spark, folder)), 10)


@query("components", with_tables("edges", NODES, COMPONENT, select="""
SELECT node, component, component_size FROM comp"""))
def q_components(spark: SparkSession, folder: str) -> DataFrame:
    return G.component_sizes(G.components(graph(spark, folder)))


FEATURES = """feats AS (
SELECT d.node, in_degree AS graph_in_degree, out_degree AS graph_out_degree,
  in_degree + out_degree AS graph_total_degree, CAST(in_degree = 0 AS INTEGER) AS graph_is_root,
  CAST(out_degree = 0 AS INTEGER) AS graph_is_leaf, round(betweenness, 10) AS graph_betweenness,
  round(pagerank, 10) AS graph_pagerank,
  CAST((SELECT count(*) FROM paths p WHERE p.s = d.node) AS BIGINT) AS graph_downstream_count,
  CAST((SELECT count(*) FROM paths p WHERE p.t = d.node) AS BIGINT) AS graph_upstream_count,
  depth AS graph_depth, component_size AS graph_component_size
FROM degree d JOIN betw b ON b.node = d.node JOIN pager r ON r.node = d.node
JOIN depth t ON t.node = d.node JOIN comp c ON c.node = d.node)"""
_ALL = (NODES, DEGREE, WALKS, PATHS, BETWEEN, PAGERANK, LEVELS, COMPONENT, FEATURES)


@query("node_features", with_tables("edges", *_ALL, select="SELECT * FROM feats"))
def q_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(G.node_features(edges(spark, folder)), 10)


@query("event_node_features", with_tables("edges", *_ALL, select=f"""
SELECT e.event_id, concat('n', CAST(e.user_id AS VARCHAR)) AS pipeline_name,
  {", ".join(f"coalesce(f.{c}, {1 if c in ('graph_is_leaf', 'graph_component_size') else 0}) AS {c}" for c in G.NODE_FEATURES)}
FROM events e LEFT JOIN feats f ON f.node = concat('n', CAST(e.user_id AS VARCHAR))"""))
def q_event_features(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("pipeline_name"))
    features = materialize(_rounded(G.node_features(edges(spark, folder)), 10), "features")
    return G.with_node_features(events, features, "pipeline_name")


@query("cascade_risk", with_tables("edges", NODES, DEGREE, REACH, select="""
SELECT node AS failed_pipeline, out_degree AS direct_dependents, k AS blast_radius,
  CASE WHEN k = 0 THEN 'low' WHEN k <= 2 THEN 'medium' ELSE 'high' END AS severity
FROM (SELECT g.node, out_degree, CAST((SELECT count(*) FROM reach r WHERE r.source = g.node) AS BIGINT) AS k
  FROM degree g) d"""))
def q_cascade(spark: SparkSession, folder: str) -> DataFrame:
    e, pairs = _pairs(spark, folder)
    return G.cascade_risk(e, pairs)


@query("dependents", with_tables("edges", REACH, select="""
SELECT r.source AS failed_pipeline, r.node AS at_risk, EXISTS (SELECT 1 FROM edges e
  WHERE e.upstream = r.source AND e.downstream = r.node) AS is_direct FROM reach r"""))
def q_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return G.dependents(_pairs(spark, folder)[1])


@query("blast_overlap", with_tables("edges", REACH, select="""
SELECT e.upstream AS a, e.downstream AS b, r.node AS at_risk,
  CASE WHEN bool_or(r.source = e.upstream) AND bool_or(r.source = e.downstream) THEN 'both'
       WHEN bool_or(r.source = e.upstream) THEN 'only_a' ELSE 'only_b' END AS zone
FROM edges e JOIN reach r ON r.source = e.upstream OR r.source = e.downstream GROUP BY 1, 2, 3"""))
def q_overlap(spark: SparkSession, folder: str) -> DataFrame:
    e, pairs = _pairs(spark, folder)
    return G.blast_overlap(pairs, e.select(
        F.col("upstream").alias("a"), F.col("downstream").alias("b")))


@query("node_groups", with_tables("edges", NODES, REACH, select="""
SELECT n.node, CASE WHEN n.node = f.a THEN 'failed' WHEN n.node = f.b THEN 'compare'
  WHEN EXISTS (SELECT 1 FROM reach r WHERE r.source = f.a AND r.node = n.node) THEN 'at_risk'
  WHEN EXISTS (SELECT 1 FROM reach r WHERE r.source = f.b AND r.node = n.node) THEN 'compare_risk'
  ELSE 'normal' END AS node_group
FROM nodes n CROSS JOIN (SELECT min(upstream) AS a, max(upstream) AS b FROM edges) f"""))
def q_groups(spark: SparkSession, folder: str) -> DataFrame:
    e = graph(spark, folder)
    ends = e.agg(F.min("upstream"), F.max("upstream")).first()
    return G.node_groups(e, ends[0], ends[1])


@query("layout", with_tables("edges", NODES, DEGREE, LEVELS, select="""
SELECT node, depth, round((row_number() OVER (PARTITION BY depth ORDER BY encode(node)) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY depth), 10) AS x,
  round(1.0::DOUBLE - CAST(depth AS DOUBLE) / greatest(max(depth) OVER (), 1), 10) AS y FROM depth"""))
def q_layout(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(G.layout(graph(spark, folder)), 10)
