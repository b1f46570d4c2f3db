import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from columnary import Dataset
from columnary.operators import features, isolation, metrics, probe, sampling, slices, supervised, targets, unsupervised
from columnary.operators.extra_trees import ExtraTrees, Forest


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        x1, x2 = float(rng.normal()), float(rng.normal())
        cat = f"c{i % 10}" if i % 20 else f"rare{i // 75}"
        rows.append((i, x1, None if i % 15 == 0 else x2, cat, f"2024-03-{i % 28 + 1:02d}", "yes" if x1 + 0.3 * rng.normal() > 0.6 else "no"))
    df = spark.createDataFrame(rows, "row_id long, x1 double, x2 double, cat string, d string, y string").withColumn("when_ts", F.col("d").cast("timestamp_ntz")).drop("d")
    return Dataset(df, "binary", ["row_id"])


def test_benchmark_finds_the_signal(binary):
    b = supervised.supervised_benchmark(binary, "y", trees=8, extra=8, depth=5)
    d = b.diagnostics.first()
    assert (d.rows_used, d.training_rows, d.test_rows, d.task_type) == (600, 480, 120, "classification")
    wide = {(r.model, r.metric): r.value for r in b.model_comparison.collect()}
    assert wide["Logistic Regression", "roc_auc"] > 0.9
    assert {m for m, _ in wide} == {"Logistic Regression", "Random Forest", "Extra Trees"}
    assert b.feature_importance.first().feature == "numeric__x1"
    preview = supervised.prediction_preview(b).collect()
    assert len(preview) == 40 and [r.key_0 for r in preview] == sorted(r.key_0 for r in preview)
    assert supervised.exact_matches(supervised.prediction_preview(b)).first().preview_rows == 40
    found = b.target_slices()
    assert found.where("feature_type = 'numeric'").select("feature").distinct().count() <= 4 and found.first().target_label == "yes rate"


def test_regression_benchmark(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 3.0 * float(a) + float(e)) for i, (a, b, e) in enumerate(rng.normal(size=(300, 3)) * [1, 1, 0.1])]
    ds = Dataset(spark.createDataFrame(rows, "row_id long, x1 double, x2 double, y double"), order_by=["row_id"])
    b = supervised.supervised_benchmark(ds, "y", trees=5, extra=5, depth=4)
    assert b.best_model == "Linear Regression" and b.task == "regression"
    assert b.model_comparison.where("metric = 'r2' and model = 'Linear Regression'").first().value > 0.98


def test_extra_trees_grow_alike_in_one_task_and_by_levels(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=(400, 3)), np.ones(400), rng.integers(0, 2, 400)])
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float) + (x[:, 4] > 0)
    rows = [(v.tolist(), float(t), float(1 + i % 2)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label double, weight double").select(array_to_vector("x").alias("features"), "label", "weight")
    for classes, share in ((3, "sqrt"), (0, 0.9)):
        fits = [ExtraTrees(classes, 5, 6, share, 42, local_bytes=b).fit(df.repartition(p)) for b, p in ((1 << 30, 3), (0, 5), (0, 1))]
        for other in fits[1:]:
            same = ["tree", "node", "feature", "n"]
            assert (fits[0].nodes[same].values == other.nodes[same].values).all()
            assert np.allclose(fits[0].nodes["threshold"], other.nodes["threshold"])
        nodes = fits[0].nodes
        inner = nodes[nodes["feature"] >= 0]
        assert nodes[nodes["feature"] < 0]["n"].sum() == 5 * 400
        assert ((inner["low"] <= inner["threshold"]) & (inner["threshold"] < inner["high"])).all() and (inner["gain"] > -1e-9).all()
        assert 3 not in set(inner["feature"]) and nodes["node"].max() < 2**7
        importance = fits[0].featureImportances.toArray()
        assert importance[3] == 0 and abs(importance.sum() - 1) < 1e-9 and {int(f) for f in importance.argsort()[-2:]} == {0, 4}  # the two that make most of the label
        made = fits[0].transform(df)
        assert made.where("abs(prediction - label) < 0.5").count() > 340
        if classes:
            assert made.select(F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v) - 1).alias("e")).where("e > 1e-9").count() == 0


def test_extra_trees_of_rows_that_agree_are_leaves(spark):
    df = spark.createDataFrame([([1.0, 2.0], float(i % 2), 1.0) for i in range(10)] , "x array<double>, label double, weight double")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight")
    for local in (0, 1 << 30):
        model = ExtraTrees(2, 3, 5, "sqrt", 1, local_bytes=local).fit(df)
        assert list(model.nodes["feature"]) == [-1, -1, -1] and list(model.nodes["n"]) == [10, 10, 10]
        assert not model.featureImportances.toArray().any()
        assert model.transform(df).first().probability.toArray().tolist() == [0.5, 0.5]
        pure = ExtraTrees(2, 3, 5, "sqrt", 1, local_bytes=local).fit(df.where("label = 1"))
        assert pure.transform(df).select("prediction").distinct().collect() == [(1.0,)]
        with pytest.raises(ValueError, match="need rows"):
            ExtraTrees(2, 3, 5, "sqrt", 1, local_bytes=local).fit(df.limit(0))


def test_too_few_rows_and_unknown_targets_are_refused(spark):
    ds = Dataset(spark.createDataFrame([(i, "a") for i in range(39)], "x long, y string"))
    with pytest.raises(ValueError):
        supervised.prepare(ds, "y")
    with pytest.raises(ValueError):
        supervised.prepare(ds, "nope")


def test_split_is_exact_and_survives_repartitioning(spark):
    rows = [(i, "abc"[0 if i % 3 else 1 + i % 2]) for i in range(1001)]
    sides = []
    for parts in (1, 9):
        ds = Dataset(spark.createDataFrame(rows, "k long, y string").repartition(parts), order_by=["k"], hold=False)
        held_out, _, train, test = supervised.holdout(ds, ds.rows, 0.2, features.class_sizes(ds, ds.rows, "y"), "y")
        chosen = {r.k for r in held_out.collect()}
        assert (train, test, len(chosen)) == (800, 201, 201)
        sides.append(chosen)
    assert sides[0] == sides[1]


def test_hash_cuts_keep_exactly_the_wanted_rows(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.shiftrightunsigned(F.xxhash64("id"), 12).alias("h"))
    cut = sampling.hash_cuts(df, F.col("g"), F.col("h"), {"g": 1234})["g"]
    assert df.where(F.col("h") <= cut).count() == 1234


def test_categories_are_pooled(spark):
    counts = [(f"v{i:02d}", 100 - i) for i in range(20)]
    kept, pooled = features.keep_categories(counts, 20, 2000, 12, 0.01)
    assert len(kept) == 11 and pooled and kept[0] == "v00"
    assert features.keep_categories([("a", 50), ("b", 50)], 2, 100, 12, 0.01) == (["a", "b"], False)
    assert features.keep_categories([("a", 991), ("b", 9)], 2, 1000, 12, 0.01) == (["a"], True)


def test_positive_label_rules():
    assert supervised.positive_label({"no": 5, "Yes": 50}) == "Yes"
    assert supervised.positive_label({"stay": 90, "leave": 10}) == "leave"
    assert supervised.positive_label({"a": 1, "b": 1, "c": 1}) is None


def brute_auc(positive, score):
    p, n = [s for s, y in zip(score, positive) if y], [s for s, y in zip(score, positive) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_auc_and_precision_by_brute_force(spark):
    rng = np.random.default_rng(8)
    positive = (rng.random(400) < 0.3).tolist()
    score = [round(float(rng.random()) + 0.3 * y, 2) for y in positive]
    df = spark.createDataFrame(list(zip(positive, score)), "positive boolean, score double")
    assert math.isclose(metrics.roc_auc(df).first()[0], brute_auc(positive, score), rel_tol=1e-12)
    total, want, last = sum(positive), 0.0, 0
    for t in sorted(set(score), reverse=True):
        hits = sum(y for y, s in zip(positive, score) if s >= t)
        want += (hits - last) / total * hits / sum(s >= t for s in score)
        last = hits
    assert math.isclose(metrics.average_precision(df).first()[0], want, rel_tol=1e-12)


def test_confusion_of_many_cells(spark):
    rows = spark.range(600_000).select(F.col("id").cast("string").alias("actual"), (F.col("id") + F.col("id") % 2).cast("string").alias("prediction"))
    m = metrics.classification_metrics(rows).first()
    assert math.isclose(m.accuracy, 0.5) and math.isclose(m.balanced_accuracy, 0.5)


def test_split_sizes_with_a_repeated_key(spark):
    rows = spark.createDataFrame([(i % 3, float(i), "ab"[i % 2]) for i in range(1000)], "day int, x double, y string")
    for order in (["day"], None):
        ds = Dataset(rows, "t", order)
        test, train, n_train, n_test = supervised.holdout(ds, ds.rows, 0.2, {"a": 500, "b": 500}, "y")
        assert (n_train, n_test, train.count(), test.count()) == (800, 200, 800, 200)


def test_equal_rows_are_split_exactly(spark):
    """Rows of four kinds, one of them half of all: announced and delivered sizes are the same."""
    rows = spark.createDataFrame([("ab"[i % 2], [1, 1, 2, 3][i % 4]) for i in range(1000)], "y string, x int").repartition(5)
    ds = Dataset(rows, "t", None)
    sizes = {"a": 500, "b": 500}
    test, train, n_train, n_test = supervised.holdout(ds, ds.rows, 0.2, sizes, "y")
    assert (n_train, n_test, train.count(), test.count()) == (800, 200, 800, 200)
    count = lambda df: {(r.y, r.x): r["count"] for r in df.groupBy("y", "x").count().collect()}
    a, b = count(test), count(train)
    assert sum(n for (y, _), n in a.items() if y == "a") == 100
    assert {k: a.get(k, 0) + b.get(k, 0) for k in a | b} == count(rows)
    assert sampling.sample_rows(ds, ds.rows, 77, sizes, F.col("y")).count() == 77


def test_many_classes_join_instead_of_literals(spark):
    ds = Dataset(spark.range(4000).selectExpr("id AS k", "concat('c', id % 1000) AS y", "id * 1.0D AS x"), "t", ["k"])
    p = supervised.prepare(ds, "y")
    assert (p.train.count(), p.test.count()) == (3200, 800)
    plan = p.train._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    assert p.train.select("label").distinct().count() > 900


def test_classes_beyond_the_pin_are_numbered_and_weighted(spark, monkeypatch):
    """The table of classes is the one made on the driver, and does not pass through it."""
    ds = Dataset(spark.range(5000).selectExpr("id AS k", "concat('c', id * id % 1009) AS y"), "t", ["k"])
    sizes = features.class_sizes(ds, ds.rows, "y")
    want = {r[0]: (r[1], r[2]) for r in supervised.class_table(ds, sorted(sizes), features.class_weights(sizes)).collect()}
    monkeypatch.setattr("columnary.operators.dataset.PIN_ROWS", 100)
    counts = features.class_counts(ds, ds.rows, "y")
    found = {r[0]: (r[1], r[2]) for r in supervised.numbered_classes(counts, features.counted_weights(counts)).collect()}
    assert len(found) == 505 and found.keys() == want.keys()
    assert all(found[g][0] == want[g][0] and math.isclose(found[g][1], want[g][1]) for g in want)


def test_forests_hold_few_trees_at_a_time(spark, monkeypatch):
    """Groups of trees together are a forest: votes, shares of importance and stored nodes are those of all trees."""
    from pyspark.ml.classification import RandomForestClassificationModel

    df = spark.range(300).selectExpr("array(id % 7 * 1.0D, id % 2 * 1.0D) AS x", "id % 2 * 1.0D AS label", "1.0D AS weight")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight")
    model = dict(supervised.class_models(300, 2, 10, 1, 4))["Random Forest"].fit(df)
    parts = [RandomForestClassificationModel.load(p) for p in model.paths]
    assert [m.getNumTrees for m in parts] == [4, 4, 2]
    made = model.transform(df).collect()
    x = df.select("features").distinct().collect()
    for r in x:
        mean = sum(m.predictRaw(r.features).toArray() for m in parts) / 10
        assert {tuple(np.round(m.probability.toArray(), 9)) for m in made if m.features == r.features} == {tuple(np.round(mean, 9))}
    assert all(m.prediction == m.label for m in made) and abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    held = []
    monkeypatch.setattr("columnary.operators.extra_trees.Forest.of", lambda nodes, trees, of=Forest.of: held.append(nodes["tree"].nunique()) or of(nodes, trees))
    extra = ExtraTrees(2, 30, 3, "sqrt", 1).fit(df)
    assert all(m.prediction == m.label for m in extra.transform(df).collect())
    assert held == [12, 12, 6]


def test_groups_of_small_trees_are_in_work_together(spark, monkeypatch):
    """Two groups are fitted at a time where their trees are small, one where they may be large; the forest is the same."""
    from threading import Barrier, BrokenBarrierError

    from pyspark.ml.classification import RandomForestClassifier

    from columnary.operators import forests

    df = spark.range(300).selectExpr("array(id % 7 * 1.0D, id % 11 * 1.0D) AS x", "id % 2 * 1.0D AS label", "1.0D AS weight")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight").coalesce(3).persist()
    fit, made = RandomForestClassifier.fit, []
    for bound, seconds in ((forests.HELD_NODES, 120), (1, 1)):
        met, gate = [], Barrier(2)

        def waits(self, rows, own, met=met, gate=gate, seconds=seconds):
            try:
                gate.wait(seconds)
                met.append(True)
            except BrokenBarrierError:
                met.append(False)
            return fit(self, rows, own)

        monkeypatch.setattr(forests, "HELD_NODES", bound)
        monkeypatch.setattr(RandomForestClassifier, "fit", waits)
        model = dict(supervised.class_models(300, 2, 8, 1, 4))["Random Forest"].fit(df)
        assert met == [bound > 1] * 2
        scores = sorted((tuple(r.features), r.label, tuple(r.probability)) for r in model.transform(df).collect())
        made.append((tuple(model.featureImportances), scores))
    assert made[0] == made[1]
    assert forests.batches([3, 3, 9, 1, 1, 1], 6, 2) == [range(0, 2), range(2, 3), range(3, 5), range(5, 6)]


def test_extra_trees_score_together_where_they_are_small(spark, monkeypatch):
    """One function holds all groups of small trees; held apart they say the same."""
    from columnary.operators import extra_trees

    df = spark.range(200).selectExpr("array(id % 7 * 1.0D, id * 1.0D) AS x", "id % 13 * 1.0D AS label", "1.0D AS weight")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight").persist()
    model, made = ExtraTrees(0, 30, 6, 0.9, 1).fit(df), []
    for bound, times in ((extra_trees.SCORED_NODES, 1), (1, 3)):
        monkeypatch.setattr(extra_trees, "SCORED_NODES", bound)
        sent = []
        monkeypatch.setattr(extra_trees, "collect_garbage", sent.append)
        made.append(sorted((tuple(r.features), r.prediction) for r in model.transform(df).collect()))
        assert len(sent) == times
    assert [x for x, _ in made[0]] == [x for x, _ in made[1]] and np.allclose([v for _, v in made[0]], [v for _, v in made[1]], rtol=1e-12)


def test_forest_rows_are_drawn_exactly(spark):
    """Above trees x 256 rows every tree gets its rows, whatever the partitioning."""
    rows = lambda n: spark.range(n).selectExpr("shiftrightunsigned(xxhash64(id), 12) AS place", "array(cast(id % 97 AS double), cast(id AS double)) AS x")
    seen = []
    for parts in (3, 11):
        vectors = rows(60_000).repartition(parts)
        drawn = isolation.draw_rows(vectors, 60_000, 80, 256).collect()
        assert len(drawn) == 80 * 256 and len({(r.tree, r.place) for r in drawn}) == 80 * 256
        seen.append({(r.tree, r.place, tuple(r.x)) for r in drawn})
    assert seen[0] == seen[1]
    for n, size in ((300, 256), (12, 12)):
        drawn = isolation.draw_rows(rows(n), n, 80, size)
        assert drawn.groupBy("tree").count().where(f"count = {size}").count() == 80


def test_scan_keeps_vectors_once_in_small_parts(spark, monkeypatch):
    """What a scan keeps holds each vector once; parts of a large table are small, and all rows are scored."""
    from pyspark.ml.clustering import KMeans

    kept, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: kept.append(rows) or fit(self, rows))
    assert unsupervised.PART_ROWS <= 200_000
    monkeypatch.setattr(unsupervised, "PART_ROWS", 50)
    rows = spark.range(1000).selectExpr("id AS k", "id % 7 * 1.0D AS a", "id % 11 * 1.0D AS b")
    scan = unsupervised.unsupervised_scan(Dataset(rows, "t", ["k"], hold=False), 3)
    assert sorted(kept[0].columns) == ["features", "key_0", "place", "record"]
    assert scan.rows.count() == 1000 and scan.rows.rdd.getNumPartitions() == 20


def test_class_never_predicted_has_zero_precision(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("b", "b")], "actual string, prediction string")
    m = metrics.classification_metrics(df).first()
    assert math.isclose(m.accuracy, 0.5) and math.isclose(m.balanced_accuracy, (0.5 + 0 + 1) / 3)


def test_target_rules_and_blend(spark):
    rows = [(i, "yes" if i % 5 == 0 else "no", "ABC"[i % 3], f"s{i % 4}", float(i % 37) * 1.5, f"{10000 + i % 50}") for i in range(600)]
    ds = Dataset(spark.createDataFrame(rows, "order_id long, churn string, plan string, segment string, score double, zip_code string"), order_by=["order_id"])
    t = {r.column: r for r in targets.heuristic_targets(ds).collect()}
    assert t["churn"].recommended_task == "classification" and t["churn"].score > t["plan"].score
    assert t["order_id"].verdict == "bad target" and t["order_id"].score == 0.0
    assert any("business outcome, so it is more likely" in r for r in t["churn"].reasons)
    assert targets.preferred_target(ds).first().column == "churn"
    blended = probe.blend(targets.heuristic_targets(ds), spark.createDataFrame([("churn", 0.5, "probe")], "column string, probe_score double, reason string"))
    assert math.isclose(blended.where("column = 'churn'").first().score, t["churn"].score * 0.78 + 0.11, abs_tol=1e-4)


def test_class_targets_are_probed(binary):
    """A text target is fitted for the probe: two classes give balanced accuracy and ROC AUC."""
    score, reason = probe.probe_target(binary, "y", "classification")
    assert score > 0.8 and "ROC AUC" in reason
    probed = {r.column: r for r in targets.target_recommendations(binary).collect()}
    assert probed["y"].probe_score is not None and any("Quick probe" in r for r in probed["y"].reasons)


def test_multiclass_slices_take_the_smallest_label_on_a_tie(spark):
    rows = [(float(i), "g1" if i % 2 else "g2", "ab"[(i // 2) % 2] if i < 80 else "c") for i in range(100)]
    ds = Dataset(spark.createDataFrame(rows, "x double, g string, y string"))
    found = slices.target_slices(ds, "y", "classification", ["x", "g"])
    assert {r.target_class for r in found.where("feature = 'g'").collect()} == {"a"}
    assert found.where("feature = 'x'").count() == 5


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c, (a, b) in enumerate([(0, 0), (10, 10), (-10, 10)]):
        rows += [(len(rows) + i, float(a + x), float(b + y)) for i, (x, y) in enumerate(rng.normal(size=(100, 2)))]
    rows += [(300 + i, float(60 + 5 * i), float(-60 - 5 * i)) for i in range(10)]
    return rows


def test_scan_separates_blobs_and_flags_the_far_points(spark, blobs):
    results = []
    for parts in (2, 7):
        ds = Dataset(spark.createDataFrame(blobs, "row_id long, a double, b double").select("row_id", "a", "b").repartition(parts), order_by=["row_id"])
        s = unsupervised.unsupervised_scan(ds, 4)
        rows = {r.key_0: r for r in s.rows.collect()}
        flagged = {k for k, r in rows.items() if r.anomaly_flag}
        assert abs(len(flagged) - 0.05 * 310) <= 1 and set(range(302, 310)) <= flagged
        assert sum(r["count"] for r in s.cluster_distribution().collect()) == 310
        assert 1 >= s.explained_variance[0] >= s.explained_variance[1] >= 0
        top = s.top_anomalies().collect()
        assert len(top) == 6 and top[0].severity == 1.0 and len(s.preview().collect()) == 120
        results.append({k: r.anomaly_score for k, r in rows.items()})
    assert results[0] == results[1]


def test_average_path_length():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert math.isclose(float(isolation.average_path(256)), 2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_scan_needs_two_numbers_and_ten_rows(spark):
    with pytest.raises(ValueError):
        unsupervised.unsupervised_scan(Dataset(spark.createDataFrame([(i, "a") for i in range(20)], "x long, s string")))
    with pytest.raises(ValueError):
        unsupervised.unsupervised_scan(Dataset(spark.createDataFrame([(i, i) for i in range(9)], "x long, y long")))


def test_exact_sample_size(spark):
    ds = Dataset(spark.range(3000).toDF("k"), order_by=["k"])
    rows = sampling.sample_rows(ds, ds.rows, 400, {"all": 3000}, F.lit("all"))
    assert rows.count() == 400


def test_extra_trees_leave_nothing_sent(spark, monkeypatch):
    """What tasks were sent for a level or a group of trees is dropped behind it; the driver held all of it before."""
    import os

    from pyspark import SparkContext

    sent = []
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value, of=SparkContext.broadcast: sent.append(of(self, value)) or sent[-1])
    df = spark.range(200).selectExpr("array(id % 7 * 1.0D, id * 1.0D) AS x", "id % 2 * 1.0D AS label", "1.0D AS weight")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight")
    model = ExtraTrees(2, 3, 4, "sqrt", 1, local_bytes=0).fit(df)
    assert model.transform(df).count() == 200
    assert len(sent) > 3 and not any(os.path.exists(b._path) for b in sent)


def test_scan_parts_are_bounded(spark, monkeypatch):
    """A task of a scan holds a bounded number of rows, however few parts the table comes in."""
    monkeypatch.setattr(unsupervised, "PART_ROWS", 20)
    rows = spark.range(0, 1000, 1, 2).selectExpr("id", "id % 13 * 1.0D AS a", "id % 7 * 2.0D AS b")
    scan = unsupervised.unsupervised_scan(Dataset(rows, "scan", ["id"], hold=False), 2)
    assert scan.rows.rdd.getNumPartitions() == 50 and scan.rows.count() == 1000


def test_forests_give_back_the_drivers_heap(spark):
    """The garbage of one group of trees is gone before the next is fitted, sent or read."""
    from columnary.operators import extra_trees

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def whole() -> int:
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    df = spark.range(60).selectExpr("array(id % 7 * 1.0D, id % 2 * 1.0D) AS x", "id % 2 * 1.0D AS label", "1.0D AS weight")
    df = df.select(array_to_vector("x").alias("features"), "label", "weight")
    before = whole()
    model = dict(supervised.class_models(60, 2, 8, 1, 2))["Random Forest"].fit(df)
    fitted = whole()
    model.transform(df)
    read = whole()
    extra_trees.ExtraTrees(2, 13, 2, "sqrt", 1).fit(df).transform(df)
    assert fitted - before >= 2 and read - fitted >= 2 and whole() - read >= 2
