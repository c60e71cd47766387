"""Boosted-tree risk models on MLlib: fit, calibrate, score, explain, keep."""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators import boosting
from wardline.operators.matrix import feature_medians, quoted
from wardline.session import inline_table, materialize, shared_dir

# Default boosting parameters.
GBT_DEFAULTS = {
    "maxIter": 300,
    "maxDepth": 5,
    "stepSize": 0.05,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}

#: Estimators by name: a maker is called with the task's kind ('binary' or 'regression') and parameters and returns an
#: unfitted MLlib estimator.
MAKERS: dict = {}


def register_model(name: str, maker) -> None:
    MAKERS[name] = maker


def available_models() -> list[str]:
    return sorted(MAKERS)


def get_estimator(name: str, kind: str, params: dict | None = None):
    if (maker := MAKERS.get(name)) is None:
        raise KeyError(f"no model is registered as {name!r}; there are: {', '.join(available_models())}")
    return maker(kind, {} if params is None else params)


def _boosted(kind: str, params: dict):
    estimator = {"regression": GBTRegressor, "binary": GBTClassifier}[kind]
    return estimator(featuresCol="features", labelCol="label", leafCol="leaf", **{**GBT_DEFAULTS, **params})


register_model("gbt", _boosted)


def imputation(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Fill-in value per column: the exact median of the training rows (0 for a column without values)."""
    found = {r["feature"]: float(r["median"]) for r in feature_medians(train, features).collect()}  # a row per column
    return {f: found.get(f, 0.0) for f in features}


def vector_names(features: list[str]) -> list[str]:
    """Vector slots: the features, then a missing-flag per column that may be null."""
    return features + [f"{f}__missing" for f in features if f.startswith("value__") or f == "age"]


def feature_vector(features: list[str], fill: dict[str, float]) -> Column:
    """Trees in MLlib take no missing values: filled in, with a flag that tells."""
    cells = [F.coalesce(quoted(f).cast("double"), F.lit(fill[f])) for f in features]
    cells += [quoted(n.removesuffix("__missing")).isNull().cast("double") for n in vector_names(features)[len(features):]]
    return array_to_vector(F.array(*cells))


def fit_calibrator(scored: DataFrame, method: str = "isotonic", *, label: str = "label", score: str = "raw_probability"):
    """Isotonic or logistic map from raw to observed rate; None if only one class occurs.

    All rows count: equal scores are folded exactly before the isotonic fit. MLlib pools neighbours in each range of
    scores where they are and joins the pools of the ranges on the driver, so what comes there are the steps of the fit.
    """
    seen = scored.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if seen["n"] == 0 or seen["lo"] == seen["hi"]:
        return None
    data = scored.select(F.col(label).cast("double").alias("label"), F.col(score).alias("x"))
    if method == "isotonic":
        folded = data.groupBy("x").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
        return IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w", predictionCol="calibrated").fit(folded)
    platt = LogisticRegression(
        featuresCol="v", labelCol="label", probabilityCol="platt", rawPredictionCol="platt_raw",
        predictionCol="platt_class", regParam=1.0 / seen["n"], standardization=False, tol=1e-12, maxIter=200,
    )
    return platt.fit(data.withColumn("v", array_to_vector(F.array("x"))))


def apply_calibrator(df: DataFrame, calibrator, score: str = "raw_probability") -> DataFrame:
    if calibrator is None:
        return df.withColumn("probability", F.col(score))
    if isinstance(calibrator, LogisticRegressionModel):
        out = calibrator.transform(df.withColumn("v", array_to_vector(F.array(score))))
        out = out.withColumn("probability", vector_to_array("platt")[1])
        return out.drop("v", "platt", "platt_raw", "platt_class")
    out = calibrator.setFeaturesCol("x").transform(df.withColumn("x", F.col(score)))
    return out.withColumn("probability", fn.clip01(F.col("calibrated"))).drop("x", "calibrated")


def leaf_spread(leaf: Column) -> Column:
    """Population deviation of the leaf numbers over the trees."""
    # one pass: what a lambda names of the outside is worked out again for each element. Leaf numbers are whole, so are the sums
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda acc, x: F.struct((acc["n"] + 1.0).alias("n"), (acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q"))
    return F.aggregate(vector_to_array(leaf), start, add, lambda acc: F.sqrt(acc["n"] * acc["q"] - acc["s"] * acc["s"]) / acc["n"])


def uncertainty(df: DataFrame, *, kind: str = "binary", spread_scope: str = "batch") -> DataFrame:
    """Adds `uncertainty` in [0, 1] from (probability, spread).

    `batch` divides the spread by the largest of the scored batch, `row` by its own (one record at a
    time, where the term is 0.3 as soon as there is any spread).
    """
    if spread_scope == "batch":
        top = df.agg(F.max("spread").alias("m")).scalar()
    elif spread_scope == "row":
        top = F.col("spread")
    else:
        raise ValueError(f"spread_scope is 'batch' or 'row', not {spread_scope!r}")
    relative = F.col("spread") / (top + F.lit(1e-9))
    if kind == "regression":
        return df.withColumn("uncertainty", fn.clip01(relative))
    boundary = 1.0 - F.abs(F.col("probability") - 0.5) * 2.0
    return df.withColumn("uncertainty", fn.clip01(0.7 * boundary + 0.3 * relative))


@dataclass
class RiskModel:
    kind: str
    features: list[str]
    fill: dict[str, float]
    booster: object
    calibrator: object | None = None

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", feature_vector(self.features, self.fill))

    def score(self, df: DataFrame, ids: list[str], *, spread_scope: str = "batch") -> DataFrame:
        """(ids, probability, raw_probability, point_estimate, spread, uncertainty) for any DataFrame
        with the feature columns."""
        return self.score_vectors(self.vectors(df), ids, spread_scope=spread_scope)

    def score_vectors(self, df: DataFrame, ids: list[str], *, spread_scope: str = "batch") -> DataFrame:
        """The same for rows that hold the assembled vector in `features`."""
        out = self.booster.transform(df)
        none = F.lit(None).cast("double")
        binary = self.kind == "binary"
        raw = vector_to_array("probability")[1] if binary else none
        estimate = none if binary else F.col("prediction")
        spread = leaf_spread(F.col("leaf")) if "leaf" in out.columns else F.lit(0.0)  # only trees have leaves
        out = out.select(*ids, raw.alias("raw_probability"), estimate.alias("point_estimate"), spread.alias("spread"))
        out = apply_calibrator(out, self.calibrator) if binary else out.withColumn("probability", none)
        if spread_scope == "batch":
            out = materialize(out, "scores")  # read twice below: once for the maximum
        return uncertainty(out, kind=self.kind, spread_scope=spread_scope)

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance); a missing-flag counts for its feature. A linear model's weights are the shares
        of its absolute coefficients; a model with neither weighs nothing."""
        weights: dict[str, float] = dict.fromkeys(self.features, 0.0)
        own = []
        if hasattr(self.booster, "featureImportances"):
            own = self.booster.featureImportances.toArray().tolist()
        elif hasattr(self.booster, "coefficients"):
            sizes = [abs(c) for c in self.booster.coefficients.toArray().tolist()]
            own = [s / (sum(sizes) or 1.0) for s in sizes]
        for name, w in zip(vector_names(self.features), own):
            weights[name.removesuffix("__missing")] += float(w)
        return inline_table(spark, weights.items(), "feature string, importance double")

    def save(self, path: str) -> None:
        spark = SparkSession.builder.getOrCreate()  # the one there is, in a task's thread too
        self.booster.write().overwrite().save(f"{path}/booster")
        kind = "none"
        if self.calibrator is not None:
            kind = "platt" if isinstance(self.calibrator, LogisticRegressionModel) else "isotonic"
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        cls = type(self.booster)
        meta = {
            "kind": self.kind, "features": self.features, "fill": self.fill, "calibrator": kind,
            "model_class": f"{cls.__module__}.{cls.__qualname__}",
        }
        spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        module, _, name = meta["model_class"].rpartition(".")
        booster = getattr(importlib.import_module(module), name).load(f"{path}/booster")
        calibrator = None
        if meta["calibrator"] != "none":
            loader = LogisticRegressionModel if meta["calibrator"] == "platt" else IsotonicRegressionModel
            calibrator = loader.load(f"{path}/calibrator")
        return cls(meta["kind"], meta["features"], meta["fill"], booster, calibrator)


def score_side_by_side(
    models: dict[str, RiskModel], df: DataFrame, ids: list[str], *, extra: dict[str, Column], spread_scope: str = "batch"
) -> DataFrame:
    """(ids, task, probability, raw_probability, point_estimate, spread, uncertainty, extra), a row per model and record.

    All models run over a row in one pass; their results lie side by side until the row is taken apart. `extra` has
    one more column per model. With `batch` the spreads are divided by the largest of their model.
    """
    none = F.lit(None).cast("double")
    out, entries = df, []
    for i, (name, model) in enumerate(models.items()):
        made = {p: f"__{p}_{i}" for p in ("features", "probability", "rawPrediction", "prediction", "leaf")}
        booster = model.booster
        renamed = {booster.getParam(f"{p}Col"): c for p, c in made.items() if booster.hasParam(f"{p}Col")}
        out = booster.copy(renamed).transform(out.withColumn(made["features"], feature_vector(model.features, model.fill)))
        binary = model.kind == "binary"
        out = out.withColumn(f"__raw_{i}", vector_to_array(made["probability"])[1] if binary else none)
        if binary:
            out = apply_calibrator(out.drop("probability"), model.calibrator, f"__raw_{i}").withColumnRenamed("probability", f"__p_{i}")
        else:
            out = out.withColumn(f"__p_{i}", none)
        entries.append(F.struct(
            F.lit(name).alias("task"), F.lit(model.kind).alias("kind"), F.col(f"__p_{i}").alias("probability"),
            F.col(f"__raw_{i}").alias("raw_probability"), (none if binary else F.col(made["prediction"])).alias("point_estimate"),
            (leaf_spread(F.col(made["leaf"])) if made["leaf"] in out.columns else F.lit(0.0)).alias("spread"),
            extra[name].alias("extra"),
        ))
    # made below the explode, which would work it out by interpretation; the outer form: before a plain one Spark tests its size
    beside = out.select(*ids, F.array(*entries).alias("e"))
    long = materialize(beside.select(*ids, F.explode_outer("e").alias("e")).select(*ids, "e.*"), "scores")
    top = F.col("spread")
    if spread_scope == "batch":
        largest = {r["task"]: r["m"] for r in long.groupBy("task").agg(F.max("spread").alias("m")).collect()}  # a row per model
        top = F.create_map(*[x for t, m in largest.items() for x in (F.lit(t), F.lit(m))])[F.col("task")] if largest else top
    relative = F.col("spread") / (top + F.lit(1e-9))
    boundary = 1.0 - F.abs(F.col("probability") - 0.5) * 2.0
    score = F.when(F.col("kind") == "regression", relative).otherwise(0.7 * boundary + 0.3 * relative)
    return long.withColumn("uncertainty", fn.clip01(score)).drop("kind")


def fit_model(
    train: DataFrame, val: DataFrame | None, features: list[str], kind: str, *, label: str = "label",
    params: dict | None = None, name: str = "gbt", calibration: str | None = "isotonic",
) -> RiskModel:
    """Fit on `train`; a binary model is then calibrated on `val`."""
    fill = imputation(train, features)
    ready = lambda df: df.select(F.col(label).cast("double").alias("label"), feature_vector(features, fill).alias("features"))
    return fit_vectors(
        ready(train), None if val is None else ready(val), features, fill, kind, params=params, name=name, calibration=calibration
    )


def fit_vectors(
    train: DataFrame, val: DataFrame | None, features: list[str], fill: dict[str, float], kind: str, *,
    params: dict | None = None, name: str = "gbt", calibration: str | None = "isotonic",
) -> RiskModel:
    """The same for rows (label, features) whose vector has the slots of `vector_names(features)`."""
    shared_dir(train.sparkSession)  # boosting checkpoints its lineage there
    booster = boosting.fit(get_estimator(name, kind, params), train, len(vector_names(features)))
    model = RiskModel(kind, list(features), fill, booster)
    if kind == "binary" and calibration and val is not None:
        scored = model.booster.transform(val).select("label", vector_to_array("probability")[1].alias("raw_probability"))
        model.calibrator = fit_calibrator(scored, calibration)
    return model


def fit_binary(train: DataFrame, val: DataFrame | None, features: list[str], **options) -> RiskModel:
    return fit_model(train, val, features, "binary", **options)


def fit_regression(train: DataFrame, features: list[str], **options) -> RiskModel:
    return fit_model(train, None, features, "regression", **options)
