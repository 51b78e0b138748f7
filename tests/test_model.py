import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import attribution as A
from failscope.operators import forest
from failscope.operators import metrics as M
from failscope.operators import model as MM
from failscope.operators.feature_engineer import FIXED, FeatureEngineer, FeatureModel
from failscope.plans.derived import timed_events
from failscope.session import materialize
from failscope.sources import artifacts
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    events = timed_events(spark, SMALL)
    engineer, features, names = FeatureEngineer().fit_transform(events)
    features = materialize(features, "test-features")
    model, scored = MM.split_train_evaluate(features, names, n_trees=8, partitions=4)
    return events, engineer, features, names, model, materialize(
        scored.drop("features"), "test-scored")


def test_feature_matrix_shape(fitted):
    events, engineer, features, names, *_ = fitted
    assert 90 <= len(names) <= 110 and len(set(names)) == len(names)
    assert names[:len(FIXED)] == FIXED and len(FIXED) == 12 + 5 + 11 + 2 + 23
    assert features.count() == events.count()


def test_transform_needs_its_columns(fitted):
    events, engineer, *_ = fitted
    with pytest.raises(ValueError, match="runtime"):
        engineer.transform(events.drop("runtime"))
    with pytest.raises(ValueError, match="root_cause"):
        FeatureEngineer().fit_transform(events.drop("root_cause"))


def test_saved_features_are_the_same(spark, fitted, tmp_path):
    events, engineer, features, names, *_ = fitted
    engineer.save(str(tmp_path / "e"))
    again = FeatureModel.load(spark, str(tmp_path / "e")).transform(events)
    assert again.columns == features.columns
    assert again.exceptAll(features).count() == 0


def test_quality_of_the_model(fitted):
    scored = fitted[-1]
    overall = M.overall_metrics(M.class_report(M.confusion_matrix(scored))).first()
    assert overall["accuracy"] > 0.9 and overall["macro_f1"] > 0.9
    row = scored.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= row[0] <= row[1] <= 1
    total = scored.select(F.aggregate(
        F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert total.where("abs(t - 1) > 1e-9").count() == 0


def test_same_seed_same_predictions(fitted):
    _, _, features, names, model, scored = fitted
    _, again = MM.split_train_evaluate(features.repartition(3), names, n_trees=8, partitions=4)
    pick = ["event_id", "predicted_root_cause", "confidence"]
    assert again.select(pick).exceptAll(scored.select(pick)).count() == 0


def test_contributions_take_only_leaves_of_the_class(monkeypatch):
    rng = np.random.default_rng(4)
    x, cls = rng.integers(0, 5, (200, 6)).astype(float), rng.choice([0, 2], 200)
    leaves = []
    for _ in range(30):
        f = rng.choice(6, rng.integers(1, 5), replace=False)
        low = np.where(rng.random(len(f)) < 0.5, -math.inf, 1.5)
        high = np.where((rng.random(len(f)) < 0.5) & np.isfinite(low), math.inf, 3.5)
        leaves.append((f, low, high, A._leaf_table(rng.random(len(f))), np.eye(3)[rng.integers(0, 3)] * 0.1))
    want = np.zeros((200, 6))
    for at in range(200):
        for f, low, high, table, value in leaves:
            pattern = sum(int(low[j] < x[at, f[j]] <= high[j]) << j for j in range(len(f)))
            want[at, f] += table[pattern] * value[cls[at]]
    assert np.array_equal(A.contributions(leaves, x, cls), want)
    taken = []
    take = np.take
    monkeypatch.setattr(A.np, "take", lambda a, at, **how: (taken.append(len(at)), take(a, at, **how))[1])
    A.contributions(leaves, x, cls)
    n = np.bincount(cls, minlength=3)
    assert sum(taken) == sum(n[np.flatnonzero(leaf[-1])].sum() for leaf in leaves)
    assert A.contributions(leaves, x[:0], cls[:0]).shape == (0, 6)


def _no_scan_per_node(*args):
    raise AssertionError("MLlib scans all rows once for every few nodes")


@pytest.mark.parametrize("count_bytes", [1 << 25, 1 << 16])
def test_forest_on_many_rows_grows_by_levels(spark, fitted, tmp_path, monkeypatch, count_bytes):
    _, _, features, names, few, _ = fitted
    monkeypatch.setattr(MM, "LEVEL_ROWS", 100)
    monkeypatch.setattr(forest, "COUNT_BYTES", count_bytes)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 97)
    monkeypatch.setattr(RandomForestClassifier, "fit", _no_scan_per_node)
    model, scored = MM.split_train_evaluate(features, names, n_trees=8, partitions=3)
    assert M.overall_metrics(M.class_report(M.confusion_matrix(scored))).first()["accuracy"] > 0.9
    assert model.trees.getNumTrees == 8 and model.trees.getMaxDepth() == K.TREE_PARAMS["max_depth"]
    assert all(1 <= t.depth <= 6 for t in model.trees.trees)
    n = scored.count()
    rows = features.count() - n
    for tree in A.tree_nodes(model.trees).values():
        for node in tree.values():
            if node["left"] >= 0:
                sides = [tree[node[s]]["stats"] for s in ("left", "right")]
                assert np.allclose(np.sum(sides, axis=0), node["stats"])
        assert 0.7 < sum(tree[0]["stats"]) / rows / K.TREE_PARAMS["subsample"] < 1.3

    pick = ["event_id", "predicted_root_cause", "confidence"]
    _, again = MM.split_train_evaluate(features.repartition(5), names, n_trees=8, partitions=3)
    assert again.select(pick).exceptAll(scored.select(pick)).count() == 0
    artifacts.save_model(model, str(tmp_path), artifacts.evaluation(scored), rows, "2024-01-31T00:00:00+00:00")
    loaded = artifacts.load_model(spark, str(tmp_path)).score(features.join(scored.select("event_id"), "event_id"))
    assert loaded.select(pick).exceptAll(scored.select(pick)).count() == 0
    explained = A.attributions(model, features, all_classes=True).join(
        model.score(features).select("event_id", F.explode("probabilities").alias("root_cause", "p")),
        ["event_id", "root_cause"])
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    assert explained.where(F.abs(total - F.col("p")) > 1e-9).count() == 0


def test_forest_on_many_rows_refuses_missing_values(spark, monkeypatch):
    monkeypatch.setattr(MM, "LEVEL_ROWS", 10)
    df = spark.range(60).selectExpr("id AS event_id", "if(id % 2 = 0, 'a', 'b') AS root_cause",
                                    "if(id = 7, NULL, cast(id % 5 AS double)) AS x")
    with pytest.raises(Exception, match="null or NaN"):
        MM.train(df, ["x"], n_trees=2)


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        bins, labels = rng.integers(0, 4, (3, 40)), rng.integers(0, 3, 40)
        times, weights = rng.integers(0, 3, 40), rng.random(3) + 0.1
        feature, place = np.repeat(np.arange(3), 3), np.tile(np.arange(3), 3)
        left = np.array([[times[(labels == c) & (bins[f] <= p)].sum() for f, p in zip(feature, place)] for c in range(3)])
        counts = np.bincount(labels, times, 3).astype(int)
        order = rng.permutation(3)[:2]

        def impurity(rows):
            w = np.array([times[rows & (labels == c)].sum() * weights[c] for c in range(3)])
            return (1 - ((w / w.sum()) ** 2).sum(), w.sum()) if w.sum() else (0.0, 0.0)

        want = (0.0, 0)
        for f, p in zip(feature, place):
            low = bins[f] <= p
            if f in order and min(times[low].sum(), times[~low].sum()) >= 3:
                (whole, n), (a, x), (b, y) = impurity(labels >= 0), impurity(low), impurity(~low)
                want = max(want, (whole - a * x / n - b * y / n, 0))
        at, gain = forest.best_split(left, counts, weights, feature, order, 3)
        assert gain == pytest.approx(max(want[0], 0.0), abs=1e-12)
        assert at < 0 or feature[at] in order


def test_sample_counts_and_thresholds():
    table = forest._poisson_table(0.8)
    assert [np.mean(table == k) for k in range(4)] == pytest.approx(
        [math.exp(-0.8) * 0.8 ** k / math.factorial(k) for k in range(4)], abs=1e-4)
    assert forest.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4)).tolist() == [1.5, 2.5]
    assert forest.thresholds(np.full(5, 2.0), np.ones(5)).tolist() == []
    many = forest.thresholds(np.arange(1000.0), np.ones(1000))
    assert len(many) == 31 and np.abs(many - 1000 / 32 * np.arange(1, 32)).max() < 2


def test_importances_sum_to_one(fitted):
    rows = fitted[4].importances().collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert rows[0]["importance"] >= rows[-1]["importance"]


def test_attributions_add_up(fitted):
    _, _, features, names, model, _ = fitted
    explained = A.attributions(model, features, all_classes=True)
    truth = model.score(features).select("event_id", F.explode("probabilities").alias("root_cause", "p"))
    gap = explained.join(truth, ["event_id", "root_cause"]).select(F.abs(
        F.col("base_value") - F.col("p")
        + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)).alias("gap"))
    row = gap.agg(F.count("*"), F.max("gap")).first()
    assert row[0] == features.count() * 6 and row[1] < 1e-9


def _expected(tree, x, known):
    """Tree output when only the ``known`` features are given."""
    def walk(at):
        node = tree[at]
        stats = np.array(node["stats"], dtype=float)
        if node["left"] < 0:
            return stats / stats.sum()
        if node["feature"] in known:
            return walk(node["left"] if x[node["feature"]] <= node["threshold"] else node["right"])
        parts = [sum(tree[c]["stats"]) for c in (node["left"], node["right"])]
        return sum(w * walk(c) for w, c in zip(parts, (node["left"], node["right"]))) / sum(parts)

    return walk(0)


def test_attributions_equal_brute_force_shapley(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, size=(300, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 2) > 5).astype(float) + (x[:, 3] > 4)
    df = spark.createDataFrame(
        [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))],
        "event_id int, a double, b double, c double, d double, _label double")
    names = ["a", "b", "c", "d"]
    forest = RandomForestClassifier(labelCol="_label", numTrees=4, maxDepth=6, seed=1).fit(
        MM.assemble(df, names))
    leaves, base = A.leaf_tables(forest)
    trees = A.tree_nodes(forest)
    sample = x[:25]
    for cls in range(3):
        got = A.contributions(leaves, sample, np.full(len(sample), cls))
        for row, phi in zip(sample, got):
            def value(known):
                return np.mean([_expected(t, row, known)[cls] for t in trees.values()])
            for j in range(4):
                others = [i for i in range(4) if i != j]
                want = sum(
                    math.factorial(k) * math.factorial(3 - k) / 24
                    * (value({*s, j}) - value(set(s)))
                    for k in range(4) for s in itertools.combinations(others, k))
                assert phi[j] == pytest.approx(want, abs=1e-9)
            assert base[cls] == pytest.approx(value(set()), abs=1e-9)


def test_save_and_load(spark, fitted, tmp_path):
    _, _, features, names, model, scored = fitted
    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, folder)
    metrics = artifacts.evaluation(scored)
    artifacts.save_model(model, folder, metrics, 800, "2026-01-01T00:00:00+00:00")
    meta = artifacts.read_metadata(spark, folder).first()
    assert meta["feature_names"] == names and meta["class_names"] == K.ROOT_CAUSES
    assert meta["metrics"]["accuracy"] == pytest.approx(metrics["accuracy"])
    assert meta["confusion_matrix"] == metrics["confusion_matrix"]
    for version in (None, "v1"):
        loaded = artifacts.load_model(spark, folder, version)
        pick = ["event_id", "predicted_root_cause", "confidence"]
        assert loaded.score(features).select(pick).exceptAll(
            model.score(features).select(pick)).count() == 0
    assert artifacts.model_info(spark, folder).first()["n_classes"] == 6


def test_gate_before_save(fitted, tmp_path):
    metrics = {**artifacts.evaluation(fitted[-1]), "macro_f1": 0.5}
    with pytest.raises(ValueError, match="not saved"):
        artifacts.save_model(fitted[4], str(tmp_path / "m"), metrics, 1, "now")
    assert not (tmp_path / "m").exists()


def test_boosted_option(fitted):
    _, _, features, names, *_ = fitted
    _, scored = MM.split_train_evaluate(
        features, names, kind=MM.BOOSTED, n_trees=2, partitions=4)
    row = scored.agg(F.avg((F.col("actual_root_cause") == F.col("predicted_root_cause")).cast("int")),
                     F.max("confidence")).first()
    assert row[0] > 0.8 and row[1] <= 1


def test_boosted_attributions_add_up_to_margins(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)).round(2)
    y = np.where(x[:, 0] + x[:, 1] > 0.5, "late", np.where(x[:, 2] > 0.3, "lost", "fine"))
    df = spark.createDataFrame([(f"e{i:03d}", *map(float, r), str(c)) for i, (r, c) in enumerate(zip(x, y))],
                               "event_id string, a double, b double, c double, d double, root_cause string")
    names = ["a", "b", "c", "d"]
    model = MM.train(df, names, kind=MM.BOOSTED, n_trees=3, partitions=2)
    got = A.attributions(model, df, all_classes=True).select("event_id", "root_cause", (
        F.aggregate("contributions", F.col("base_value"), lambda a, v: a + v)).alias("total"))
    got = {(r.event_id, r.root_cause): r.total for r in got.collect()}
    rows = MM.assemble(df, names)
    for name, booster in zip(model.classes, model.trees):
        raw = booster.transform(rows).select("event_id", "rawPrediction").collect()
        assert all(abs(got[r.event_id, name] - r.rawPrediction[1]) < 1e-9 for r in raw)
    assert len(got) == 3 * 400


def test_boosted_attributions_equal_brute_force_shapley(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(200, 4)).astype(float)
    y = (x[:, 0] * x[:, 1] - 2 * x[:, 2] > 3).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))],
                               "event_id int, a double, b double, c double, d double, _label double")
    booster = GBTClassifier(labelCol="_label", maxIter=3, maxDepth=4, seed=1).fit(MM.assemble(df, ["a", "b", "c", "d"]))
    leaves, base = A.boosted_tables([booster])
    trees, steps = A.tree_nodes(booster), booster.treeWeights

    def walk(tree, at, row, known):
        node = tree[at]
        if node["left"] < 0:
            return node["prediction"]
        if node["feature"] in known:
            return walk(tree, node["left"] if row[node["feature"]] <= node["threshold"] else node["right"], row, known)
        sides = node["left"], node["right"]
        return sum(tree[c]["stats"][0] * walk(tree, c, row, known) for c in sides) / sum(tree[c]["stats"][0] for c in sides)

    got = A.contributions(leaves, x[:20], np.zeros(20, int))
    for row, phi in zip(x[:20], got):
        def value(known):
            return sum(steps[i] * walk(t, 0, row, known) for i, t in trees.items())
        for j in range(4):
            others = [i for i in range(4) if i != j]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value({*s, j}) - value(set(s)))
                       for k in range(4) for s in itertools.combinations(others, k))
            assert phi[j] == pytest.approx(want, abs=1e-9)
        assert base[0] == pytest.approx(value(set()), abs=1e-9)


def test_class_contributions_equal_those_of_one_class():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(50, 5)).astype(float)
    leaves = []
    for _ in range(30):
        features = rng.choice(5, size=3, replace=False)
        leaves.append((features, np.array([-math.inf, 1.0, 2.0]), np.array([3.0, math.inf, 4.0]),
                       rng.normal(size=(8, 3)), rng.random(3) * (rng.random(3) < 0.6)))
    found = A.class_contributions(leaves, x, 3)
    for cls in range(3):
        assert np.array_equal(found[:, cls], A.contributions(leaves, x, np.full(50, cls)))


def test_rows_cross_to_python_once_for_all_classes(fitted):
    _, _, features, _, model, _ = fitted
    plan = A.attributions(model, features, all_classes=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_many_rows_are_trained_in_small_passes(spark, fitted, monkeypatch):
    _, _, features, names, *_ = fitted
    passes = []
    fit = MM.RandomForestClassifier.fit
    monkeypatch.setattr(MM.RandomForestClassifier, "fit", lambda self, rows: (
        passes.append((self.getMaxMemoryInMB(), rows.rdd.getNumPartitions())), fit(self, rows))[1])
    monkeypatch.setattr(MM, "MANY_ROWS", 10, raising=False)
    monkeypatch.setattr(MM, "ROWS_PER_PARTITION", 50)
    n = features.count()
    MM.train(features, names, n_trees=2)
    assert passes == [(MM.PASS_MB_MANY_ROWS, max(8, math.ceil(n / 50)))]
    assert MM.PASS_MB_MANY_ROWS < 16
