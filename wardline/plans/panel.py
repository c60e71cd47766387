"""Train the panel of task models on shared matrices, score every stay, assemble the profiles."""

from __future__ import annotations

import json
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import events as ev
from wardline.operators import explain, matrix as mx, metrics, profiles
from wardline.operators import models as md
from wardline.operators.concepts import ALL_TASKS, concept_dim, task_dim, window_tag, windows_used
from wardline.operators.models import RiskModel, fit_vectors, imputation, score_side_by_side, vector_names
from wardline.operators.split import assign_split
from wardline.operators.tree_paths import has_trees, with_tree_impacts
from wardline.session import finished, inline_table, materialize, scratch_path

RECORD = ["patient_id", "label_time"]


def window_matrices(
    events: DataFrame, labels: DataFrame, *, tasks=ALL_TASKS, lookback_days: int = 3650, max_features: int = 400,
    numeric="auto", fit_on: str = "train", seed: int = 42,
) -> tuple[dict[int | None, DataFrame], dict[int | None, mx.Vocabulary]]:
    """One written matrix per observation window, with its vocabulary.

    The vocabulary is learned on training patients only, with `fit_on='all'` on all.
    """
    wide, vocab = {}, {}
    for hours in windows_used(tasks):
        ev_, lb = window_tables(events, labels, hours, tasks)
        folded = materialize(mx.fold(ev_, lb, lookback_days=lookback_days), f"folded-{window_tag(hours)}")
        learn, seen = lb, folded
        if fit_on == "train":
            train = assign_split(lb, seed=seed).filter(F.col("split") == "train").select("patient_id")
            learn, seen = (df.join(train, "patient_id", "left_semi") for df in (lb, folded))
        vocab[hours] = mx.fit_vocab(ev_, learn, max_features=max_features, numeric=numeric, folded=seen)
        wide[hours] = materialize(mx.matrix(ev_, lb, vocab[hours], folded=folded), f"matrix-{window_tag(hours)}")
    return wide, vocab


def window_tables(events: DataFrame, labels: DataFrame, hours: int | None, tasks=ALL_TASKS) -> tuple[DataFrame, DataFrame]:
    """Events of one observation window and the label rows, one per record, of a task that uses it."""
    anchor = next(t for t in tasks if t.window == hours)
    return (
        events.filter(F.col("obs_window") == anchor.tag).drop("obs_window"),
        labels.filter(F.col("task") == anchor.name).drop("task"),
    )


def train_panel(
    wide: dict[int | None, DataFrame],
    vocab: dict[int | None, mx.Vocabulary],
    labels: DataFrame,
    *,
    tasks=ALL_TASKS,
    params: dict | None = None,
    calibration: str | None = "isotonic",
    seed: int = 42,
    parallel: int = 3,
    run: str | None = None,
) -> tuple[dict[str, RiskModel], DataFrame, DataFrame]:
    """(models, metrics, manifest). One split for all windows; each task sees only the columns its exclusion list leaves.

    A window's training table holds its features as one vector, assembled once, and a column per label; a task takes
    the slots it may see. Tables, split, and every task's model and metrics are kept below `run` as soon as they are
    complete; a second call with the same folder and settings goes on where the first one ended. Tasks are
    independent jobs, `parallel` of them at a time.
    """
    first = next(iter(wide.values()))
    spark = first.sparkSession
    run = run or scratch_path(spark, "panel")
    settings = {
        "params": params, "calibration": calibration, "seed": seed, "tasks": [t.name for t in tasks],
        "columns": {window_tag(h): v.feature_names for h, v in vocab.items()},
    }
    if _kept_text(spark, f"{run}/settings", lambda: settings) != json.loads(json.dumps(settings)):
        raise ValueError(f"{run} holds a run with other settings")
    splits = _kept(spark, f"{run}/splits", lambda: assign_split(first, seed=seed))
    tables, fills = {}, {}
    for hours, df in wide.items():
        tag, names, own = window_tag(hours), vocab[hours].feature_names, [t for t in tasks if t.window == hours]
        aligned = mx.align_tasks(df, labels, splits, own)
        fills[hours] = _kept_text(
            spark, f"{run}/fill-{tag}", lambda: imputation(aligned.filter(F.col("split") == "train"), names)
        )
        slots = md.feature_vector(names, fills[hours])
        tables[hours] = _kept(spark, f"{run}/training-{tag}", lambda: aligned.select(
            *[c for c in RECORD if c in df.columns], "split", *[mx.quoted(f"label__{t.name}") for t in own], slots.alias("slots")
        ))

    def one(task):
        names = vocab[task.window].feature_names
        columns = mx.allowed_features(names, task.exclude_prefixes)
        place, at, made = f"{run}/tasks/{task.name}", {n: i for i, n in enumerate(vector_names(names))}, []

        def fit():
            mask = VectorSlicer(inputCol="slots", outputCol="features", indices=[at[n] for n in vector_names(columns)])
            rows = tables[task.window].withColumn("label", mx.quoted(f"label__{task.name}"))
            part = lambda name: mask.transform(rows.filter(F.col("split") == name)).select("label", "features")
            fill = {c: fills[task.window][c] for c in columns}
            model = fit_vectors(part("train"), part("val"), columns, fill, task.kind, params=params, calibration=calibration)
            model.save(f"{place}/model")
            made.append(model)
            # the metrics read the scores several times: keep them, not the forest's work
            test = materialize(model.score_vectors(part("test"), ["label"], spread_scope="row"), f"test-{task.name}")
            if task.kind == "regression":
                return metrics.regression_metrics(test, label="label", prediction="point_estimate").first().asDict()
            return metrics.binary_metrics(test, label="label", score="probability").first().asDict()

        row = _kept_text(spark, f"{place}/metrics", fit)  # written last: a task with metrics has its model
        return task, columns, made[0] if made else RiskModel.load(spark, f"{place}/model"), row

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, tasks))
    names = ("n", "positives", "auroc", "auprc", "brier", "calibration_error", "mae", "rmse", "r2")
    table = inline_table(
        spark,
        [(t.name, t.group, t.kind, *[row.get(c) for c in names]) for t, _, _, row in done],
        "task string, task_group string, kind string, n bigint, positives bigint, auroc double, auprc double,"
        " brier double, calibration_error double, mae double, rmse double, r2 double",
    )
    manifest = inline_table(
        spark,
        [(t.name, t.kind, t.group, t.label, t.positive_label, t.horizon, t.tag, json.dumps(cols), json.dumps(row)) for t, cols, _, row in done],
        "task string, kind string, task_group string, label string, positive_label string, horizon string,"
        " obs_window string, columns_json string, metrics_json string",
    )
    return {t.name: m for t, _, m, _ in done}, table, manifest


def _kept(spark: SparkSession, path: str, make) -> DataFrame:
    """What `make` gives, written to `path` unless a finished write stands there, read back."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _kept_text(spark: SparkSession, path: str, make):
    """The same for a small value, as JSON."""
    if not finished(spark, path):
        inline_table(spark, [(json.dumps(make()),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return json.loads(spark.read.text(path).first()["value"])


def store_panel(
    path: str, models: dict[str, RiskModel], vocab: dict[int | None, mx.Vocabulary], panel_metrics: DataFrame, manifest: DataFrame
) -> None:
    """Everything that scoring needs, below one folder: models, vocabularies, metrics and manifest. What stands there
    is replaced."""
    for name, model in models.items():
        model.save(f"{path}/models/{name}")
    content = {
        "tasks": list(models),
        "vocabularies": [{"window": h, "codes": v.codes, "numeric": v.numeric} for h, v in vocab.items()],
    }
    spark = panel_metrics.sparkSession
    inline_table(spark, [(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/content")
    panel_metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def load_panel(
    spark: SparkSession, path: str
) -> tuple[dict[str, RiskModel], dict[int | None, mx.Vocabulary], DataFrame, DataFrame]:
    """(models, vocabularies, metrics, manifest) as `store_panel` wrote them: serving is a job of its own."""
    content = json.loads(spark.read.text(f"{path}/content").first()["value"])
    models = {name: RiskModel.load(spark, f"{path}/models/{name}") for name in content["tasks"]}
    vocab = {v["window"]: mx.Vocabulary(tuple(v["codes"]), tuple(v["numeric"])) for v in content["vocabularies"]}
    return models, vocab, spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/manifest")


def attribution_method(models: dict[str, RiskModel], method: str = "auto") -> str:
    """The method all tasks share: `auto` takes exact tree contributions where every model is a forest, else the
    approximate ones; `tree` falls back with a warning; `approx` is always possible."""
    if method not in ("auto", "tree", "approx"):
        raise ValueError(f"the method is 'auto', 'tree' or 'approx', not {method!r}")
    if method == "approx" or all(map(has_trees, models.values())):
        return "approx" if method == "approx" else "tree"
    if method == "tree":
        warnings.warn("tree contributions need forests: approximate ones instead", stacklevel=2)
    return "approx"


def stay_numbers(wide: dict[int | None, DataFrame]) -> DataFrame:
    """(patient_id, label_time, obs_window, stay): a patient's records of each window, numbered by label time.

    A stay's label times differ between the windows, the order of the stays does not, so equal numbers are one stay.
    Only the keys of the matrices are read.
    """
    parts = [
        df.select(*RECORD, F.lit(window_tag(hours)).alias("obs_window"), mx.stay().alias("stay")) for hours, df in wide.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def score_panel(
    models: dict[str, RiskModel], wide: dict[int | None, DataFrame], *, tasks=ALL_TASKS, top_k: int = 5,
    method: str = "auto", use_directions: bool = True,
) -> DataFrame:
    """Scores and contributor views of all records and tasks, long: one row per record and task, with its window.

    A window's matrix is read once: all its models score the row side by side, and the strongest k contributions and
    their words are made inside it.
    """
    spark = next(iter(wide.values())).sparkSession
    method = attribution_method(models, method)
    dim = concept_dim(spark)
    parts = []
    for hours, df in wide.items():
        own = {t.name: models[t.name] for t in tasks if t.window == hours}
        names = [c for c in df.columns if c not in RECORD]
        words = explain.words_of(names, dim)
        if method == "tree":
            rows = with_tree_impacts({f"__tree_{n}": m for n, m in own.items()}, df, top_k=top_k)
            picked = {n: explain.named_impacts(m.features, F.col(f"__tree_{n}")) for n, m in own.items()}
        else:
            rows = df
            medians = {r["feature"]: r["median"] for r in mx.feature_medians(df, names).collect()}  # one row per column
            table = inline_table(spark, [(n,) for n in names], "feature string")
            signs = {r["feature"]: r["direction"] for r in (explain.directions(table, dim).collect() if use_directions else [])}
            weights = {n: {r["feature"]: r["importance"] for r in m.importance(spark).collect()} for n, m in own.items()}
            picked = {
                n: explain.top_k_array(explain.contribution_array(m.features, weights[n], medians, signs), top_k) for n, m in own.items()
            }
        views = {n: explain.views_of_row(picked[n], words, method=method) for n in own}
        scored = score_side_by_side(own, rows, RECORD, extra=views)
        parts.append(scored.select(*RECORD, "task", *[c for c in scored.columns if c not in (*RECORD, "task", "extra")],
                                   "extra.contributors", "extra.protective_factors", F.lit(window_tag(hours)).alias("obs_window")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def panel_profiles(
    models: dict[str, RiskModel], wide: dict[int | None, DataFrame], panel_metrics: DataFrame, *, events: DataFrame | None = None,
    labels: DataFrame | None = None, tasks=ALL_TASKS, top_k: int = 5, method: str = "auto", lookback_days: int = 3650,
    snapshot_window: int | None = None,
) -> DataFrame:
    """Nested panel per stay: arrays `forward` and `chronic`, each sorted by probability, the method and notes; with
    `events` and `labels` also the snapshot and demographics at the end of `snapshot_window`.

    Records of several windows meet by patient and stay (see `stay_numbers`), whatever their label times.
    """
    spark = next(iter(wide.values())).sparkSession
    method = attribution_method(models, method)
    numbers = materialize(stay_numbers(wide), "stays")
    scores = score_panel(models, wide, tasks=tasks, top_k=top_k, method=method).join(numbers, [*RECORD, "obs_window"])
    snapshots = None
    if events is not None and labels is not None:
        own = numbers.where(F.col("obs_window") == window_tag(snapshot_window)).drop("obs_window")
        shots = ev.snapshot(*window_tables(events, labels, snapshot_window, tasks), lookback_days=lookback_days)
        snapshots = shots.join(own, RECORD)
    return profiles.panel(scores, task_dim(spark, tasks), panel_metrics, snapshots=snapshots, method=method)


def record_inputs(
    wide: dict[int | None, DataFrame], vocab: dict[int | None, mx.Vocabulary]
) -> DataFrame:
    """(patient_id, stay, features): the model inputs of all windows, one map per window tag, as a response record keeps
    them."""
    parts = []
    for hours, df in wide.items():
        # the number is made beside the features: a table of all stays, joined to them, would be sent through the driver
        keyed = mx.feature_map(df.withColumn("stay", mx.stay()), vocab[hours].feature_names, beside=["stay"])
        one = F.struct(F.lit(window_tag(hours)).alias("key"), F.col("features").alias("value"))
        parts.append(keyed.select("patient_id", "stay", one.alias("one")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    # as many rows per stay as there are windows
    return every.groupBy("patient_id", "stay").agg(F.map_from_entries(F.collect_list("one")).alias("features"))
