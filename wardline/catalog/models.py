"""Queries that train: boosted trees, calibration, tree contributions, the whole panel."""

from __future__ import annotations

import zlib

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardline.catalog.hospital import stored
from wardline.catalog.registry import Views, query, step
from wardline.catalog.timeline import vocab, wide
from wardline.operators import matrix as mx
from wardline.operators import metrics
from wardline.operators.concepts import ALL_TASKS
from wardline.operators.models import RiskModel, fit_binary, fit_regression
from wardline.operators.split import assign_split
from wardline.operators.tree_paths import tree_contributions
from wardline.plans.panel import panel_profiles, train_panel, window_matrices
from wardline.session import finished, materialize, run_dir, scratch_path

#: None: the library's own parameters, 300 rounds at depth 5; for the ten models of the panel as well.
PARAMS: dict | None = None
RECORD = ["patient_id", "label_time"]


def training_rows(v: Views):
    """Event matrix with label and split, written once."""
    return materialize(mx.align(wide(v), v.lb, assign_split(v.lb)), "rows")


def part(rows, name: str):
    return rows.filter(F.col("split") == name)


def kept_model(v: Views, name: str, fit) -> RiskModel:
    """A model that one query has trained over a folder serves the others of the same run."""
    path = f"{run_dir(v.spark)}/models/{name}-{zlib.crc32(v.sf_dir.encode()):08x}"
    if not finished(v.spark, f"{path}/meta"):
        fit().save(path)
    return RiskModel.load(v.spark, path)


def binary_model(v: Views):
    rows = training_rows(v)
    # high count of errors: a target the matrix can tell
    rows = rows.withColumn("label", (mx.quoted("count__ENC/ED") > 9).cast("double"))
    return kept_model(v, "binary", lambda: fit_binary(part(rows, "train"), part(rows, "val"), vocab(v).feature_names, params=PARAMS)), rows


@query("train_binary")
def train_binary(v: Views):
    model, rows = binary_model(v)
    return model.score(rows, RECORD).select("patient_id", "probability", "raw_probability", "uncertainty")


@query("train_regression")
def train_regression(v: Views):
    rows = training_rows(v)
    names = [n for n in vocab(v).feature_names if n != "n_events"]
    rows = rows.withColumn("label", F.col("n_events"))
    model = kept_model(v, "regression", lambda: fit_regression(part(rows, "train"), names, params=PARAMS))
    return model.score(rows, RECORD).select("patient_id", "point_estimate", "uncertainty")


@query("calibrate")
def calibrate(v: Views):
    """Isotonic and logistic calibration of the given scores, side by side."""
    from wardline.operators.models import apply_calibrator, fit_calibrator

    scored = v.scored.select("patient_id", F.col("y").cast("double").alias("label"), F.col("p").alias("raw_probability"))
    isotonic = apply_calibrator(scored, fit_calibrator(scored)).withColumnRenamed("probability", "isotonic")
    both = apply_calibrator(isotonic, fit_calibrator(scored, "platt")).withColumnRenamed("probability", "platt")
    return both.select("patient_id", "raw_probability", "isotonic", "platt")


@query(
    "calibrate_isotonic",
    """
WITH folded AS (SELECT p AS x, count(*) AS n, sum(y) AS s FROM scored GROUP BY p),
placed AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM folded),
spans AS (
  SELECT a.i AS j, b.i AS k, (b.cs - coalesce(q.cs, 0)) / (b.cn - coalesce(q.cn, 0)) AS mean
  FROM placed a JOIN placed b ON b.i >= a.i LEFT JOIN placed q ON q.i = a.i - 1
),
lows AS (SELECT t.i, r.j, min(r.mean) AS m FROM placed t JOIN spans r ON r.j <= t.i AND r.k >= t.i GROUP BY t.i, r.j),
fit AS (SELECT i, max(m) AS isotonic FROM lows GROUP BY i)
SELECT patient_id, round(p, 6) AS raw_probability, round(isotonic, 6) AS isotonic
FROM scored JOIN placed ON x = p JOIN fit USING (i)""",
)
def calibrate_isotonic(v: Views):
    """Isotonic calibration of the given scores; the check is its max-min form."""
    from wardline.operators.models import apply_calibrator, fit_calibrator

    scored = v.scored.select("patient_id", F.col("y").cast("double").alias("label"), F.col("p").alias("raw_probability"))
    out = apply_calibrator(scored, fit_calibrator(scored))
    return out.select("patient_id", "raw_probability", F.col("probability").alias("isotonic"))


def _newton(steps: int = 12) -> str:
    """Newton's steps for intercept b and slope a of the logistic fit, the slope's square weighing 1 / (2 n)."""
    parts = ["s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"""s{k + 1} AS (
  SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
    SELECT any_value(a) AS a, any_value(b) AS b, sum((n * q - s) * x) + any_value(a) AS ga, sum(n * q - s) AS gb,
           sum(n * q * (1 - q) * x * x) + 1 AS haa, sum(n * q * (1 - q) * x) AS hab, sum(n * q * (1 - q)) AS hbb
    FROM (SELECT x, n, s, a, b, 1 / (1 + exp(-(a * x + b))) AS q FROM folded, s{k}) z) g)""")
    return ",\n".join(parts)


@query(
    "calibrate_logistic",
    f"""
WITH folded AS (SELECT p AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM scored GROUP BY p),
{_newton()}
SELECT patient_id, round(p, 6) AS raw_probability, round(1 / (1 + exp(-(a * p + b))), 6) AS platt FROM scored, s12""",
)
def calibrate_logistic(v: Views):
    """Logistic calibration of the given scores; the check runs Newton's method."""
    from wardline.operators.models import apply_calibrator, fit_calibrator

    scored = v.scored.select("patient_id", F.col("y").cast("double").alias("label"), F.col("p").alias("raw_probability"))
    out = apply_calibrator(scored, fit_calibrator(scored, "platt"))
    return out.select("patient_id", "raw_probability", F.col("probability").alias("platt"))


@query("feature_importance")
def feature_importance(v: Views):
    model, _ = binary_model(v)
    return model.importance(v.spark)


@query("tree_contributions", "SELECT patient_id, true AS adds_up FROM lb")
def tree_path_contributions(v: Views):
    """Base plus impacts must give the forest's own margin, for every record."""
    model, rows = binary_model(v)
    own = model.booster.transform(model.vectors(rows)).select(
        "patient_id", vector_to_array("rawPrediction")[1].alias("booster_margin")
    )
    explained = tree_contributions(model, rows, RECORD).groupBy("patient_id").agg(
        (F.first("base") + F.sum("impact")).alias("sum"), F.first("margin").alias("margin")
    )
    close = lambda c: F.abs(F.col(c) - F.col("booster_margin")) < 1e-9
    return explained.join(own, "patient_id").select("patient_id", (close("sum") & close("margin")).alias("adds_up"))


@query("model_persistence", "SELECT patient_id, true AS same FROM lb")
def model_persistence(v: Views):
    """A model written and read back scores every record as before."""
    model, rows = binary_model(v)
    path = scratch_path(v.spark, "model")
    model.save(path)
    again = RiskModel.load(v.spark, path).score(rows, RECORD, spread_scope="row").select("patient_id", F.col("probability").alias("p2"))
    first = model.score(rows, RECORD, spread_scope="row").select("patient_id", "probability")
    return first.join(again, "patient_id").select("patient_id", (F.abs(F.col("probability") - F.col("p2")) < 1e-12).alias("same"))


def trained(v: Views):
    """The panel over a folder. Its run is kept, so the queries that read it train it once between them."""
    if "panel" not in v.__dict__:
        parts = stored(v)
        matrices, vocabularies = window_matrices(parts["events"], parts["labels"])
        run = f"{run_dir(v.spark)}/panel-{zlib.crc32(v.sf_dir.encode()):08x}"
        v.panel = (parts, matrices, vocabularies, *train_panel(matrices, vocabularies, parts["labels"], params=PARAMS, run=run))
    return v.panel


@query("train_panel")
def panel_metrics(v: Views):
    """Held-out metrics of all ten tasks."""
    return trained(v)[4]


@query("manifest")
def manifest(v: Views):
    return trained(v)[5]


step(
    "hosp_rank",
    """
SELECT patient_id, row_number() OVER (ORDER BY md5('42:' || patient_id), patient_id) AS rank, count(*) OVER () AS n
FROM (SELECT DISTINCT patient_id FROM all_labels) i""",
)
step(
    "hosp_split",
    """
SELECT patient_id, CASE WHEN rank <= floor(n * 0.15) THEN 'test' WHEN rank <= floor(n * 0.15) + floor(n * 0.15) THEN 'val' ELSE 'train' END AS split
FROM hosp_rank""",
)
step(
    "hosp_column",
    """
SELECT obs_window, 'count__' || code AS feature, code FROM all_events WHERE patient_id IN (SELECT patient_id FROM hosp_split WHERE split = 'train')
UNION SELECT obs_window, 'value__' || code, code FROM all_events WHERE value IS NOT NULL AND patient_id IN (SELECT patient_id FROM hosp_split WHERE split = 'train')
UNION SELECT w.obs_window, f.feature, '' FROM (VALUES ('age'), ('sex_female'), ('n_events')) AS f(feature), (SELECT DISTINCT obs_window FROM all_events) w""",
)
step(
    "hosp_task",
    "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{t.kind}', '{t.tag}')" for t in ALL_TASKS) + ") AS t(task, kind, obs_window)",
)


@query(
    "panel_facts",
    """
SELECT t.task, t.kind, t.obs_window, held.n AS n_test, CASE WHEN t.kind = 'binary' THEN held.positives ELSE 0 END AS positives_test,
       kept.n AS n_columns, kept.digest AS columns_md5, true AS in_range
FROM hosp_task t
JOIN (SELECT l.task, count(*) AS n, CAST(sum(l.value) AS BIGINT) AS positives FROM all_labels l JOIN hosp_split s ON s.patient_id = l.patient_id
      WHERE s.split = 'test' GROUP BY l.task) held ON held.task = t.task
JOIN (SELECT h.task, count(*) AS n, md5(string_agg(c.feature, '|' ORDER BY c.feature)) AS digest FROM hosp_task h JOIN hosp_column c ON c.obs_window = h.obs_window
      WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.task = h.task AND starts_with(c.code, p.prefix)) GROUP BY h.task) kept ON kept.task = t.task""",
)
def panel_facts(v: Views):
    """What is exact about the trained panel: held-out rows and positives, the columns each task was left, and that
    every metric lies where it can."""
    _, _, _, _, table, kept = trained(v)
    names = F.array_sort(F.from_json("columns_json", "array<string>"))
    columns = kept.select("task", "obs_window", F.size(names).cast("bigint").alias("n_columns"), F.md5(F.array_join(names, "|").cast("binary")).alias("columns_md5"))
    share = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    sound = share("auroc") & share("auprc") & share("brier") & share("calibration_error") & F.coalesce(F.col("mae") <= F.col("rmse"), F.lit(True))
    return table.join(columns, "task").select(
        "task", "kind", "obs_window", F.col("n").alias("n_test"), F.coalesce("positives", F.lit(0)).alias("positives_test"), "n_columns", "columns_md5",
        sound.alias("in_range"),
    )


@query("panel_profile")
def panel_profile(v: Views):
    """Nested panel of every stay, shown by its strongest forward and chronic entry."""
    parts, matrices, _, models, table, _ = trained(v)
    nested = panel_profiles(models, matrices, table, events=parts["events"], labels=parts["labels"])
    return nested.select(
        "patient_id",
        F.size("forward").alias("n_forward"),
        F.size("chronic").alias("n_chronic"),
        F.col("forward")[0]["name"].alias("top_forward"),
        F.col("forward")[0]["probability_pct"].alias("top_pct"),
        F.array_join(F.transform(F.col("chronic")[0]["contributors"], lambda c: c["phrase"]), "|").alias("chronic_factors"),
        "demographics.age", "demographics.sex", F.size("snapshot.active_conditions").alias("n_conditions"), "attribution_method",
    )


@query(
    "panel_profile_parts",
    """
SELECT l.patient_id, l.age, l.sex, 4 AS n_forward, 6 AS n_chronic, 'tree' AS method FROM all_labels l WHERE l.task = 'mortality_1y'""".replace("4 AS", "CAST(4 AS BIGINT) AS").replace("6 AS", "CAST(6 AS BIGINT) AS"),
)
def panel_profile_parts(v: Views):
    """Every stay has one panel of all ten tasks, with its demographics and the exact contributions."""
    parts, matrices, _, models, table, _ = trained(v)
    nested = panel_profiles(models, matrices, table, events=parts["events"], labels=parts["labels"])
    return nested.select(
        "patient_id", "demographics.age", "demographics.sex", F.size("forward").alias("n_forward"), F.size("chronic").alias("n_chronic"),
        F.col("attribution_method").alias("method"),
    )
