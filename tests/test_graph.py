import pytest

from failscope.operators import graph as G
from failscope.sources.tables import registry_edges

FIVE = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("C", "E")]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "upstream string, downstream string")


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_five_node_features(five):
    got = _by(G.node_features(five), "node")
    want = {  # in, out, betweenness, pagerank, downstream, upstream, depth, component
        "A": (0, 2, 0, 0.120883, 4, 0, 0, 5),
        "B": (1, 1, 0.041667, 0.172257, 1, 1, 1, 5),
        "C": (1, 2, 0.125, 0.172257, 2, 1, 1, 5),
        "D": (2, 0, 0, 0.340511, 0, 3, 2, 5),
        "E": (1, 0, 0, 0.194092, 0, 2, 2, 5),
    }
    names = ["in_degree", "out_degree", "betweenness", "pagerank", "downstream_count",
             "upstream_count", "depth", "component_size"]
    for node, values in want.items():
        for name, value in zip(names, values):
            assert got[node][f"graph_{name}"] == pytest.approx(value, abs=5e-6), (node, name)
        assert got[node]["graph_is_root"] == int(values[0] == 0)
        assert got[node]["graph_is_leaf"] == int(values[1] == 0)


def test_cascade(five):
    got = _by(G.cascade_risk(five, G.closure(G.shortest_paths(five))), "failed_pipeline")
    assert (got["A"]["blast_radius"], got["A"]["severity"]) == (4, "high")
    assert (got["C"]["blast_radius"], got["C"]["severity"]) == (2, "medium")
    assert (got["E"]["blast_radius"], got["E"]["severity"]) == (0, "low")
    assert "unknown" not in got


def test_registry(spark):
    edges = registry_edges(spark)
    summary = G.graph_summary(G.build_graph(edges)).first()
    assert tuple(summary) == (30, 32, 9, 10)
    got = _by(G.node_features(edges), "node")
    assert sorted({r["graph_component_size"] for r in got.values()}) == [2, 28]
    mesh = got["service_mesh_pipeline"]
    assert mesh["graph_betweenness"] == pytest.approx(0.014778, abs=1e-6)
    assert mesh["graph_pagerank"] == pytest.approx(0.071893, abs=1e-6)
    assert (mesh["graph_downstream_count"], mesh["graph_upstream_count"]) == (3, 4)
    assert got["error_tracking_pipeline"]["graph_upstream_count"] == 10
    assert got["error_tracking_pipeline"]["graph_depth"] == 4
    assert got["cost_tracking_pipeline"]["graph_depth"] == 3
    assert got["user_etl_pipeline"]["graph_out_degree"] == 5
    risk = G.cascade_risk(edges, G.closure(G.shortest_paths(edges)))
    count = {r[0]: r[1] for r in risk.groupBy("severity").count().collect()}
    assert count == {"high": 12, "medium": 8, "low": 10}


def test_unknown_node_gets_the_default_row(spark, five):
    features = G.node_features(five)
    events = spark.createDataFrame([(1, "A"), (2, "nobody")], "event_id int, pipeline_name string")
    got = _by(G.with_node_features(events, features, "pipeline_name"), "event_id")
    assert got[1]["graph_out_degree"] == 2
    assert got[2]["graph_is_leaf"] == 1 and got[2]["graph_component_size"] == 1
    assert got[2]["graph_pagerank"] == 0 and got[2]["graph_is_root"] == 0


def test_cycle(spark):
    ring = spark.createDataFrame(
        [("R", "A"), ("A", "B"), ("B", "C"), ("C", "A")], "upstream string, downstream string")
    with pytest.raises(ValueError, match="cycle"):
        G.depths(ring).collect()
    pairs = {(r["source"], r["node"]) for r in G.closure(G.shortest_paths(ring)).collect()}
    assert ("A", "A") not in pairs and len(pairs) == 3 + 6


def test_components_of_long_and_star_shapes(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:03d}") for i in range(60)] + [(f"s{i:03d}", "end") for i in range(60)]
    edges = spark.createDataFrame(chain + star, "upstream string, downstream string")
    sizes = {r["component"]: r["component_size"]
             for r in G.component_sizes(G.components(edges)).collect()}
    assert sizes == {"c000": 61, "end": 62}


def test_overlap_groups_layout(spark, five):
    pairs = G.closure(G.shortest_paths(five))
    asked = spark.createDataFrame([("B", "C")], "a string, b string")
    zones = {r["at_risk"]: r["zone"] for r in G.blast_overlap(pairs, asked).collect()}
    assert zones == {"D": "both", "E": "only_b"}
    groups = {r["node"]: r["node_group"] for r in G.node_groups(five, "B", "C").collect()}
    assert groups == {"A": "normal", "B": "failed", "C": "compare", "D": "at_risk",
                      "E": "compare_risk"}
    alone = {r["node"]: r["node_group"] for r in G.node_groups(five, "B").collect()}
    assert alone["D"] == "at_risk" and alone["E"] == "normal"
    spots = _by(G.layout(five), "node")
    assert (spots["A"]["x"], spots["A"]["y"]) == (0.5, 1.0)
    assert (spots["C"]["x"], spots["C"]["y"]) == (0.75, 0.5)


def test_pagerank_that_does_not_settle_is_zero(five):
    assert {r["pagerank"] for r in G.pagerank(five, max_rounds=2).collect()} == {0.0}


def test_duplicate_edges_overwrite(spark):
    edges = spark.createDataFrame(
        [("A", "B", "data"), ("A", "B", "sensor")],
        "upstream string, downstream string, dependency_type string")
    assert G.build_graph(edges).count() == 1


def test_depth_of_detached_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "c")], "upstream string, downstream string")
    with pytest.raises(ValueError):
        G.depths(df).count()
    assert {(r.node, r.depth) for r in G.layout(df).collect()} == {("a", 0), ("b", 1), ("c", 0), ("d", 0)}
    reached = spark.createDataFrame([("a", "c"), ("c", "d"), ("d", "c")], df.schema)
    with pytest.raises(ValueError):
        G.layout(reached).count()


def test_loops_of_node_features_see_numbers_and_one_table_of_edges(spark, monkeypatch):
    seen, written = [], []
    for name in ("shortest_paths", "pagerank", "depths", "components"):
        loop = getattr(G, name)
        monkeypatch.setattr(G, name, lambda edges, loop=loop, **options: (
            seen.append(dict(edges.dtypes)["upstream"]), loop(edges, **options))[1])
    write = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    rows = [("a", "b"), ("b", "c"), ("a", "b"), ("x", "y"), ("x", "z")]
    edges = spark.createDataFrame(rows, "upstream string, downstream string")
    got = {r.node: r for r in G.node_features(edges).collect()}
    assert set(got) == set("abcxyz") and got["c"].graph_upstream_count == 2
    assert got["c"].graph_depth == 2 and got["z"].graph_component_size == 3
    assert seen == ["bigint"] * 4 and written.count("edges") == 2


def test_numbered_edges_keep_missing_ends(spark):
    edges = spark.createDataFrame([("a", "b"), (None, "b"), ("c", None)], "upstream string, downstream string")
    numbers, codes = G.numbered(edges)
    name = {r.code: r.name for r in codes.collect()} | {None: None}
    got = {(name[r.upstream], name[r.downstream]) for r in numbers.collect()}
    assert got == {("a", "b"), (None, "b"), ("c", None)}
