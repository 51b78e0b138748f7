"""Dependency-graph metrics for all nodes at once.

A graph is a table of edges (upstream, downstream). Loops go level by level: each
level is one join with the edges and one aggregate, written to the shared folder,
so lineage stays flat and every step is as parallel as its rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.operators.ranking import with_rank
from failscope.session import Parts, materialize

NODE_FEATURES = [
    "graph_in_degree", "graph_out_degree", "graph_total_degree", "graph_is_root",
    "graph_is_leaf", "graph_betweenness", "graph_pagerank", "graph_downstream_count",
    "graph_upstream_count", "graph_depth", "graph_component_size",
]


def build_graph(edges: DataFrame) -> DataFrame:
    """One row per (upstream, downstream). Of duplicates the last type by name is kept."""
    if "dependency_type" in edges.columns:
        return edges.groupBy("upstream", "downstream").agg(
            F.max("dependency_type").alias("dependency_type"))
    return edges.select("upstream", "downstream").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree, root and leaf flag of every node: one shuffle."""
    ends = F.array(
        F.struct(F.col("upstream").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("downstream").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n_in, n_out = F.sum("i"), F.sum("o")
    return edges.select(F.inline(ends)).groupBy("node").agg(
        n_in.alias("in_degree"), n_out.alias("out_degree"),
        (n_in + n_out).alias("total_degree"),
        (n_in == 0).cast("int").alias("is_root"), (n_out == 0).cast("int").alias("is_leaf"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("upstream", "downstream")).alias("node")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Direct neighbours of every node, one per row, with their direction."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("upstream").alias("node"), F.lit("downstream").alias("direction"),
                 F.col("downstream").alias("neighbour")),
        F.struct(F.col("downstream").alias("node"), F.lit("upstream").alias("direction"),
                 F.col("upstream").alias("neighbour")))))


def graph_summary(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(
        F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"),
        F.sum("is_root").alias("n_roots"), F.sum("is_leaf").alias("n_leaves"))


def _written(edges: DataFrame, written: bool) -> DataFrame:
    """Distinct edges as a table, which they are already if ``written``."""
    if written:
        return edges
    return materialize(edges.select("upstream", "downstream").distinct(), "edges")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges between numbers, and the (code, name) of the nodes, both written once.

    Loops shuffle and compare whole numbers instead of names. A missing end stays missing.
    """
    codes = materialize(nodes(edges).where("node IS NOT NULL").select(
        F.monotonically_increasing_id().alias("code"), F.col("node").alias("name")), "codes")
    up, down = (codes.select(F.col("code").alias(code), F.col("name").alias(end))
                for code, end in (("up", "upstream"), ("down", "downstream")))
    return materialize(edges.join(up, "upstream", "left").join(down, "downstream", "left").select(
        F.col("up").alias("upstream"), F.col("down").alias("downstream")), "edges"), codes


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, written: bool = False) -> Parts:
    """Breadth-first levels from every source (default: every node).

    Part d - 1 holds (source, node, distance d, number of shortest paths). A pair is
    in exactly one part. Give ``sources`` (one column, ``node``) to pay only for them.
    ``written``: ``edges`` is a written table without repeated rows, here and below.
    """
    edges = _written(edges, written)
    level = edges.where("upstream <> downstream").select(
        F.col("upstream").alias("source"), F.col("downstream").alias("node"),
        F.lit(1).alias("distance"), F.lit(1.0).alias("paths"))
    if sources is not None:
        level = level.join(sources.select(F.col("node").alias("source")), "source", "left_semi")
    levels = Parts(edges.sparkSession, "levels")
    while True:
        level = levels.add(level)
        if levels.seen["rows"] == 0:
            levels.drop_last()
            return levels
        known = levels.all().select("source", "node")
        level = (
            level.join(edges, F.col("node") == F.col("upstream"))
            .where("downstream <> source")
            .groupBy("source", F.col("downstream").alias("node"))
            .agg(F.lit(len(levels.paths) + 1).alias("distance"), F.sum("paths").alias("paths"))
            .join(known, ["source", "node"], "left_anti"))


def closure(levels: Parts) -> DataFrame:
    """All (source, node) pairs with their distance; a node never reaches itself."""
    return levels.all().select("source", "node", "distance")


def reach_counts(pairs: DataFrame) -> DataFrame:
    """Number of nodes below and above each node that has any."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("u")),
        F.struct(F.col("node").alias("node"), F.lit(0).alias("d"), F.lit(1).alias("u")))
    return pairs.select(F.inline(ends)).groupBy("node").agg(
        F.sum("d").alias("downstream_count"), F.sum("u").alias("upstream_count"))


def depths(edges: DataFrame, detached: int | None = None, written: bool = False) -> DataFrame:
    """Longest path from any root, by peeling nodes whose upstreams are all peeled.

    A node's round is its depth. Every round joins only the newest layer with its outgoing
    edges and subtracts what arrives from the open in-degrees, in one job; peeled nodes leave
    the table. A cycle can never be peeled: it raises ValueError, unless no root reaches it
    and ``detached`` names the depth of such nodes.
    """
    edges = _written(edges, written)
    rounds = Parts(edges.sparkSession, "rounds")
    is_open = F.col("open") > 0
    counts = {"peeled": F.count(F.when(~is_open, 1)), "left": F.count(F.when(is_open, 1))}
    now = rounds.add(degrees(edges).select(
        "node", "in_degree", F.col("in_degree").cast("bigint").alias("open"),
        F.lit(0).alias("depth")), **counts)
    while rounds.seen["left"] and rounds.seen["peeled"]:
        arrived = edges.join(
            now.where(~is_open).select(F.col("node").alias("upstream")), "upstream"
        ).groupBy(F.col("downstream").alias("node")).agg(F.count(F.lit(1)).alias("arrived"))
        now = rounds.add(now.where(is_open).join(arrived, "node", "left").select(
            "node", "in_degree", (F.col("open") - F.coalesce("arrived", F.lit(0))).alias("open"),
            F.lit(len(rounds.paths)).alias("depth")), **counts)
    peeled = rounds.all().where(~is_open).select("node", "depth")
    if not rounds.seen["left"]:
        return peeled
    stuck = now.where(is_open)
    if detached is None or not stuck.where("open < in_degree").isEmpty():
        raise ValueError("the graph has a cycle: depth is not defined")
    return peeled.union(stuck.select("node", F.lit(detached)))


def betweenness(edges: DataFrame, levels: Parts, written: bool = False) -> DataFrame:
    """Share of shortest paths through each node, end points excluded.

    Dependencies flow back from the deepest level, one edge join per level (Brandes);
    no (source, middle, target) triples are formed. Scaled by (n - 1)(n - 2).
    """
    edges = _written(edges, written)
    all_nodes = nodes(edges)
    n = all_nodes.count()
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    flows = Parts(edges.sparkSession, "flows")
    below = None
    for at in reversed(range(len(levels.paths))):
        level = levels.part(at)
        if below is None:
            flow = level.select("source", "node", "paths", F.lit(0.0).alias("flow"))
        else:
            back = (
                below.select("source", F.col("node").alias("downstream"),
                             ((1 + F.col("flow")) / F.col("paths")).alias("part"))
                .join(edges, "downstream")
                .groupBy("source", F.col("upstream").alias("node"))
                .agg(F.sum("part").alias("part")))
            flow = level.join(back, ["source", "node"], "left").select(
                "source", "node", "paths",
                F.coalesce(F.col("paths") * F.col("part"), F.lit(0.0)).alias("flow"))
        below = flows.add(flow)
    out = all_nodes.select("node", F.lit(0.0).alias("flow"))
    if flows.paths:
        out = out.union(flows.all().select("node", "flow"))
    return out.groupBy("node").agg(
        (F.sum("flow") / F.lit(scale)).alias("betweenness"))


def pagerank(
    edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100,
    written: bool = False,
) -> DataFrame:
    """PageRank by power iteration; the mass of nodes without out-edges is spread evenly.

    Stops when the summed change is below n * tolerance; if it never is, every rank
    is 0. A round is one join and one aggregate; the stop test comes out of the same job.
    """
    if not written:
        edges = edges.select("upstream", "downstream").distinct()
    degree = materialize(degrees(edges).select("node", "out_degree"), "degree")
    links = materialize(
        edges.join(degree, F.col("upstream") == F.col("node")).select(
            "upstream", "downstream", (F.lit(1.0) / F.col("out_degree")).alias("share")), "links")
    start = degree.agg(F.count("*"), F.count_if(F.col("out_degree") == 0)).first()
    n, loose = start[0], start[1] / max(start[0], 1)
    ranks = degree.select(
        "node", F.lit(1.0 / max(n, 1)).alias("rank"), (F.col("out_degree") == 0).alias("loose"))
    rounds = Parts(edges.sparkSession, "ranks")
    for _ in range(max_rounds):
        sent = links.join(ranks, F.col("upstream") == F.col("node")).select(
            F.col("downstream").alias("node"), (F.col("rank") * F.col("share")).alias("got"),
            F.lit(0.0).alias("old"), F.lit(False).alias("loose"))
        kept = ranks.select("node", F.lit(0.0).alias("got"), F.col("rank").alias("old"), "loose")
        base = (1 - alpha) / n + alpha * loose / n
        ranks = rounds.add(
            sent.union(kept).groupBy("node").agg(
                (F.lit(base) + F.lit(alpha) * F.sum("got")).alias("rank"),
                F.sum("old").alias("old"), F.max("loose").alias("loose")),
            change=F.sum(F.abs(F.col("rank") - F.col("old"))),
            loose=F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)))
        loose = rounds.seen["loose"]
        if rounds.seen["change"] < n * tolerance:
            return ranks.select("node", F.col("rank").alias("pagerank"))
    return degree.select("node", F.lit(0.0).alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected component of every node, named by its smallest node.

    Alternates the two star steps: neighbours hang onto the smallest node they see,
    which shortens any chain by a constant factor, so rounds grow with log(n).
    """
    pairs = materialize(
        edges.where("upstream <> downstream").select(
            F.greatest("upstream", "downstream").alias("a"),
            F.least("upstream", "downstream").alias("b")).distinct(), "stars")
    before, rounds = None, Parts(edges.sparkSession, "stars")
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = rounds.add(
            hung.where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(),
            content=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if rounds.seen == before:
            break
        before = rounds.seen
    return nodes(edges).join(pairs, F.col("node") == F.col("a"), "left").select(
        "node", F.coalesce("b", "node").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("component").agg(F.count("*").alias("component_size"))
    return labels.join(sizes, "component").select("node", "component", "component_size")


def node_features(edges: DataFrame) -> DataFrame:
    """The eleven graph features of every node, in fixed order.

    The four loops do not depend on each other, so their jobs run side by side: the
    short rounds of one fill the cores that the others leave idle. They see nodes as numbers
    and share one table of edges.
    """
    edges, codes = numbered(materialize(build_graph(edges).select("upstream", "downstream"), "edges"))

    def paths() -> tuple[DataFrame, DataFrame]:
        levels = shortest_paths(edges, written=True)
        return betweenness(edges, levels, written=True), reach_counts(closure(levels))

    with ThreadPoolExecutor(4) as pool:
        loops = [pool.submit(paths), pool.submit(pagerank, edges, written=True),
                 pool.submit(depths, edges, written=True), pool.submit(components, edges)]
        (between, reach), rank, depth, component = [loop.result() for loop in loops]
    out = (
        degrees(edges).join(between, "node").join(rank, "node").join(reach, "node", "left")
        .join(depth, "node").join(component_sizes(component), "node")
        .join(codes, F.col("node") == F.col("code")))
    return out.select(
        F.col("name").alias("node"),
        *[F.col(c).alias(f"graph_{c}") for c in (
            "in_degree", "out_degree", "total_degree", "is_root", "is_leaf", "betweenness",
            "pagerank")],
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"graph_{c}") for c in (
            "downstream_count", "upstream_count")],
        F.col("depth").alias("graph_depth"), F.col("component_size").alias("graph_component_size"))


def with_node_features(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; an unknown node is a leaf in a component of its own."""
    joined = df.join(features.withColumnRenamed("node", key), key, "left")
    default = {name: 0 for name in NODE_FEATURES}
    default.update(graph_is_leaf=1, graph_component_size=1)
    return joined.na.fill(default)


def cascade_risk(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blast radius, number of direct dependents and severity of every node."""
    counts = reach_counts(pairs).select("node", "downstream_count")
    radius = F.coalesce("downstream_count", F.lit(0).cast("bigint"))
    severity = F.when(radius == 0, "low").when(radius <= 2, "medium").otherwise("high")
    return degrees(edges).join(counts, "node", "left").select(
        F.col("node").alias("failed_pipeline"), F.col("out_degree").alias("direct_dependents"),
        radius.alias("blast_radius"), severity.alias("severity"))


def dependents(pairs: DataFrame) -> DataFrame:
    """At-risk nodes of every failed node, one per row in name order."""
    return pairs.select(
        F.col("source").alias("failed_pipeline"), F.col("node").alias("at_risk"),
        (F.col("distance") == 1).alias("is_direct")).orderBy("failed_pipeline", "at_risk")


def blast_overlap(pairs: DataFrame, requests: DataFrame) -> DataFrame:
    """Nodes at risk from two failures (a, b): 'both', 'only_a' or 'only_b', one per row."""
    reach = pairs.select("source", F.col("node").alias("at_risk"))
    from_a = requests.join(reach, F.col("a") == F.col("source")).select(
        "a", "b", "at_risk", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    from_b = requests.join(reach, F.col("b") == F.col("source")).select(
        "a", "b", "at_risk", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    found = from_a.union(from_b).groupBy("a", "b", "at_risk").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    zone = F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "both").when(
        F.col("in_a") == 1, "only_a").otherwise("only_b")
    return found.select("a", "b", "at_risk", zone.alias("zone"))


def node_groups(edges: DataFrame, failed: str, compare: str | None = None) -> DataFrame:
    """Group of every node for one or two failures; the first matching group wins."""
    spark = edges.sparkSession
    chosen = [(failed,)] + ([(compare,)] if compare else [])
    starts = spark.createDataFrame(chosen, "node string")
    pairs = closure(shortest_paths(edges, starts))
    flags = pairs.groupBy("node").agg(
        F.max(F.col("source") == failed).alias("risk_a"),
        F.max(F.col("source") == F.lit(compare)).alias("risk_b"))
    group = (
        F.when(F.col("node") == failed, "failed")
        .when(F.col("node") == F.lit(compare), "compare")
        .when(F.col("risk_a"), "at_risk").when(F.col("risk_b"), "compare_risk")
        .otherwise("normal"))
    return nodes(edges).join(flags, "node", "left").select("node", group.alias("node_group"))


def layout(edges: DataFrame) -> DataFrame:
    """Layered positions: y by depth from the roots, x by name order inside a layer.

    Nodes that no root reaches are on layer 0.
    """
    placed = materialize(depths(edges, detached=0), "depths")
    sizes = placed.groupBy("depth").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumn(
        "deepest", F.max("depth").over(Window.partitionBy(F.lit(1)))), "layers")
    ranked = with_rank(placed, ["depth"], ["node"]).join(sizes, "depth")
    return ranked.select(
        "node", "depth", ((F.col("rank") + 0.5) / F.col("n")).cast("double").alias("x"),
        (1.0 - F.col("depth") / F.greatest("deepest", F.lit(1))).alias("y"))
