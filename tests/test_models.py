"""Boosted models: signal learned, calibration monotone, contributions exact, registry."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import metrics
from wardline.operators.models import (
    RiskModel, apply_calibrator, available_models, fit_binary, fit_calibrator, fit_regression, get_estimator,
    register_model, uncertainty,
)
from wardline.operators.tree_paths import Forest, impacts, tree_contributions
from wardline.session import scratch_path

PARAMS = {"maxIter": 6, "maxDepth": 3}


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(1200).select(
        F.col("id").cast("string").alias("patient_id"),
        (F.rand(1) * 10).alias("age"),
        F.when(F.rand(2) > 0.3, F.rand(3)).alias("value__LAB/X.1"),
        F.rand(4).alias("count__A"),
    ).withColumn("label", ((F.col("age") + 3 * F.coalesce("`value__LAB/X.1`", F.lit(1.0)) > 7)).cast("double"))


FEATURES = ["age", "value__LAB/X.1", "count__A"]


@pytest.fixture(scope="module")
def model(data):
    return fit_binary(data.filter("patient_id < 900"), data.filter("patient_id >= 900"), FEATURES, params=PARAMS)


def test_learns_signal_and_stays_in_range(model, data):
    scored = model.score(data, ["patient_id", "label"])
    got = metrics.binary_metrics(scored, label="label", score="probability").first()
    assert got["auroc"] > 0.85
    low, high = scored.agg(F.min("uncertainty"), F.max("uncertainty")).first()
    assert 0.0 <= low <= high <= 1.0


def test_regression_learns(data):
    reg = fit_regression(data, FEATURES, label="age", params={"maxIter": 10, "stepSize": 0.3})
    scored = reg.score(data.withColumn("y", F.col("age")), ["patient_id", "y"])
    assert metrics.regression_metrics(scored, prediction="point_estimate").first()["r2"] > 0.8


def test_importance_and_round_trip(spark, model, data):
    weights = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert list(weights) == FEATURES and weights["age"] > weights["count__A"]
    path = scratch_path(spark, "model")
    model.save(path)
    again = RiskModel.load(spark, path)
    a = {r["patient_id"]: r["probability"] for r in model.score(data, ["patient_id"], spread_scope="row").collect()}
    b = {r["patient_id"]: r["probability"] for r in again.score(data, ["patient_id"], spread_scope="row").collect()}
    assert a == b


def test_contributions_add_up(model, data):
    from pyspark.ml.functions import vector_to_array

    margin = model.booster.transform(model.vectors(data)).select("patient_id", vector_to_array("rawPrediction")[1].alias("m"))
    total = tree_contributions(model, data, ["patient_id"]).groupBy("patient_id").agg((F.first("base") + F.sum("impact")).alias("t"))
    worst = total.join(margin, "patient_id").agg(F.max(F.abs(F.col("t") - F.col("m")))).first()[0]
    assert worst < 1e-9


def grown(rng, depth, slots):
    """A random tree as nested tuples (count, value) or (count, slot, cut, left, right)."""
    count = int(rng.integers(2 ** (depth + 1), 2 ** (depth + 6)))

    def node(count, depth):
        if depth == 0 or (count < 4 or rng.random() < 0.1):
            return count, float(rng.normal())
        left = int(rng.integers(1, count))
        return count, int(rng.integers(slots)), float(rng.random()), node(left, depth - 1), node(count - left, depth - 1)

    return node(count, depth)


def arrays_of(trees):
    rows, roots = [], []

    def put(tree):
        at = len(rows)
        rows.append(None)
        if len(tree) == 2:
            rows[at] = (-1, -1, -1, 0.0, *tree)
        else:
            count, slot, cut, left, right = tree
            rows[at] = (put(left), put(right), slot, cut, count, 0.0)
        return at

    for tree in trees:
        roots.append(put(tree))
    left, right, slot, cut, count, value = map(np.array, zip(*rows, strict=True))
    return Forest(np.array(roots), left, right, slot, cut, count.astype(float), value)


def worth(tree, x, known):
    """Expected value of a tree where only the slots in `known` are told."""
    if len(tree) == 2:
        return tree[1]
    count, slot, cut, left, right = tree
    if slot in known:
        return worth(left if x[slot] <= cut else right, x, known)
    return (left[0] * worth(left, x, known) + right[0] * worth(right, x, known)) / count


@pytest.mark.parametrize("depth,n_trees", [(0, 3), (1, 4), (3, 20), (6, 6)])
def test_contributions_equal_the_definition_by_subsets(depth, n_trees):
    rng = np.random.Generator(np.random.PCG64(depth))
    trees = [grown(rng, depth, 5) for _ in range(n_trees)]
    x = rng.random((7, 5))
    got = impacts(arrays_of(trees), x, np.arange(5), 5)
    for row, own in zip(x, got, strict=True):
        for i in range(5):
            rest = [j for j in range(5) if j != i]
            want = sum(
                factorial(k) * factorial(4 - k) / 120 * sum(worth(t, row, {*s, i}) - worth(t, row, set(s)) for t in trees)
                for k in range(5)
                for s in combinations(rest, k)
            )
            assert own[i] == pytest.approx(want, abs=1e-12)


def test_contributions_add_up_at_depth_ten():
    rng = np.random.Generator(np.random.PCG64(10))
    trees = [grown(rng, 10, 30) for _ in range(5)]
    forest, x = arrays_of(trees), rng.random((600, 30))
    owner = np.repeat(np.arange(15), 2)  # two slots of one column
    total = forest.paths[1] + impacts(forest, x, owner, 15).sum(axis=1)
    assert total == pytest.approx([sum(worth(t, row, range(30)) for t in trees) for row in x], abs=1e-9)


def test_only_forests_have_tree_contributions(spark, data):
    with pytest.raises(ValueError, match="made of trees"):
        tree_contributions(RiskModel("binary", FEATURES, dict.fromkeys(FEATURES, 0.0), object()), data, ["patient_id"])


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_calibration_is_monotone(spark, method):
    df = spark.range(400).select((F.col("id") / 400.0).alias("raw_probability")).withColumn(
        "label", (F.col("raw_probability") + F.rand(7) * 0.6 > 0.7).cast("double")
    )
    out = apply_calibrator(df, fit_calibrator(df, method)).orderBy("raw_probability").collect()
    p = [r["probability"] for r in out]
    assert all(0 <= x <= 1 for x in p) and all(a <= b + 1e-12 for a, b in zip(p, p[1:]))


def pooled(x, y):
    """Isotonic means of y in the order of x, equal x folded: pool neighbours until they rise."""
    blocks = []
    for value in np.unique(x):
        own = y[x == value]
        blocks.append([own.sum(), len(own), [value]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {v: s / n for s, n, xs in blocks for v in xs}


@pytest.mark.parametrize("scores,outlier", [(20, 0), (3000, 0), (3000, 1)])
def test_isotonic_fit_counts_all_rows_at_their_own_scores(spark, scores, outlier):
    rng = np.random.Generator(np.random.PCG64(scores))
    x = rng.integers(0, scores, 20_000) / scores
    y = (rng.random(20_000) < 0.2 + 0.6 * x**2).astype(float)
    if outlier:
        x[0] = 1e9
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "raw_probability double, label double").repartition(7)
    want = pooled(x, y)
    for r in apply_calibrator(df, fit_calibrator(df)).select("raw_probability", "probability").distinct().collect():
        assert r["probability"] == pytest.approx(want[r["raw_probability"]], abs=1e-9)


def test_one_class_is_not_calibrated(spark):
    df = spark.createDataFrame([(0.2, 1.0), (0.4, 1.0)], "raw_probability double, label double")
    assert fit_calibrator(df) is None
    assert [r["probability"] for r in apply_calibrator(df, None).collect()] == [0.2, 0.4]


def test_uncertainty_scopes(spark):
    df = spark.createDataFrame([(0.5, 2.0), (1.0, 4.0)], "probability double, spread double")
    assert [r["uncertainty"] for r in uncertainty(df).collect()] == pytest.approx([0.85, 0.3])
    assert [r["uncertainty"] for r in uncertainty(df, spread_scope="row").collect()] == pytest.approx([1.0, 0.3])
    with pytest.raises(ValueError):
        uncertainty(df, spread_scope="x")


def test_registry():
    register_model("mine", lambda kind, params: (kind, params))
    assert "mine" in available_models() and get_estimator("mine", "binary") == ("binary", {})
    with pytest.raises(KeyError, match="there are: gbt"):
        get_estimator("none", "binary")


@pytest.mark.parametrize("kind", ["binary", "regression"])
def test_boosting_in_one_task_is_mllibs_where_nothing_is_drawn(spark, data, kind):
    from wardline.operators import boosting
    from wardline.operators.models import feature_vector, vector_names

    fill = dict.fromkeys(FEATURES, 0.5)
    label = F.col("label") if kind == "binary" else F.col("age") * 2 + F.col("count__A")
    rows = data.select("patient_id", label.alias("label"), feature_vector(FEATURES, fill).alias("features"))
    estimator = get_estimator("gbt", kind, {"maxIter": 5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "stepSize": 0.3})
    slots = len(vector_names(FEATURES))
    theirs, ours = estimator.fit(rows), boosting.fit(estimator, rows, slots)
    margin = "rawPrediction" if kind == "binary" else "prediction"
    read = lambda m: {r["patient_id"]: r[margin] for r in m.transform(rows).collect()}
    a, b = read(theirs), read(ours)
    worst = max(np.abs(np.array(a[k]) - np.array(b[k])).max() for k in a)
    assert worst < 1e-9 and type(ours) is type(theirs)
    assert ours.treeWeights == theirs.treeWeights and ours.getNumTrees == theirs.getNumTrees
    # of two slots that split alike either may be taken
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-3)
    assert {p.name: v for p, v in ours.extractParamMap().items()} == {p.name: v for p, v in theirs.extractParamMap().items()}


def test_rounds_of_a_small_table_are_no_jobs_of_their_own(spark, data, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    rounds, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: rounds.append(self.getMaxIter()) or fit(self, *a))
    few = data.filter("patient_id < 300")
    made = fit_binary(few, None, FEATURES, params={"maxIter": 40}).booster
    assert made.getNumTrees == 40 and made.getMaxIter() == 40 and sum(rounds) <= 1
    again = fit_binary(few.repartition(5), None, FEATURES, params={"maxIter": 40}).booster
    read = lambda m: RiskModel("binary", FEATURES, dict.fromkeys(FEATURES, 0.5), m).score(data, ["patient_id"], spread_scope="row")
    key = lambda m: sorted((r["patient_id"], r["raw_probability"]) for r in read(m).collect())
    assert key(made) == key(again)  # however the rows are dealt


def test_tables_beyond_the_bound_go_to_mllib(spark, data, monkeypatch):
    from wardline.operators import boosting

    monkeypatch.setattr(boosting, "grown", None)
    rows = data.select("label", F.expr("count__A").alias("x"))
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("label", array_to_vector(F.array("x")).alias("features"))
    assert boosting.fit(get_estimator("gbt", "binary", {"maxIter": 2}), rows, 1, cells=1199).getNumTrees == 2


def test_split_candidates_are_those_of_equal_shares():
    from wardline.operators.boosting import cuts_between

    assert cuts_between(np.array([1.0, 2.0, 2.0, 4.0, np.nan]), 32).tolist() == [1.5, 3.0]
    assert cuts_between(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]
    assert cuts_between(np.full(9, 2.0), 4).tolist() == []


def test_spread_reads_the_leaves_once(spark):
    from pyspark.ml.functions import array_to_vector

    from wardline.operators.models import leaf_spread

    leaves = np.random.Generator(np.random.PCG64(1)).integers(0, 32, 300).astype(float)
    df = spark.range(1).select(array_to_vector(F.array(*[F.lit(float(x)) for x in leaves])).alias("leaf"))
    df = df.select(leaf_spread(F.col("leaf")).alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("UDF(leaf") == 1
    assert df.first()["s"] == pytest.approx(leaves.std(), abs=1e-12)


def test_contributions_of_short_paths_do_not_cost_by_row(monkeypatch):
    from wardline.operators import tree_paths as tp

    rng = np.random.Generator(np.random.PCG64(5))
    forest, rows = arrays_of([grown(rng, 5, 8) for _ in range(20)]), []
    own = tp.path_contributions
    monkeypatch.setattr(tp, "path_contributions", lambda agrees, *a: rows.append(agrees.shape[0]) or own(agrees, *a))
    x = rng.random((5000, 8))
    got = tp.impacts(forest, x, np.arange(8), 8)
    assert max(rows) <= 32 and len(rows) <= 5
    monkeypatch.setattr(tp, "_TABLED", 0)
    forest.__dict__.pop("tables")
    assert np.abs(tp.impacts(forest, x[:50], np.arange(8), 8) - got[:50]).max() < 1e-12
