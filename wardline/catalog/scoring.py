"""Queries over predictions: metrics, tiers, ranks, contributions, profiles, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import PANEL_FEATURES, PANEL_TASKS, Views, query, step
from wardline.catalog.timeline import CODES, NUMERIC, vocab, wide
from wardline.functions import clinical as fn
from wardline.operators import explain, metrics, profiles
from wardline.operators import events as ev
from wardline.operators import matrix as mx
from wardline.operators.concepts import ALL_TASKS, builtin_concepts, concept_dim, task_dim
from wardline.operators.models import uncertainty as add_uncertainty
from wardline.session import inline_table, materialize

step("panel_binary", "SELECT task, y, probability AS p FROM panel_scores WHERE kind = 'binary'")
step(
    "panel_auroc",
    """
SELECT task, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc
FROM (SELECT task, y, rank() OVER (PARTITION BY task ORDER BY p) + (count(*) OVER (PARTITION BY task, p) - 1) / 2.0 AS r FROM panel_binary) t
GROUP BY task""",
)
step(
    "panel_auprc",
    """
SELECT task, sum(pos * cum_pos / cum_n) / any_value(total) AS auprc
FROM (SELECT task, pos, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n, sum(pos) OVER (PARTITION BY task) AS total
      FROM (SELECT task, p, count(*) AS n, sum(y) AS pos FROM panel_binary GROUP BY task, p) g
      WINDOW w AS (PARTITION BY task ORDER BY p DESC)) c GROUP BY task""",
)
_edges = "[0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[]"
step(
    "panel_ece",
    f"""
SELECT task, sum(n * abs(conf - acc)) / sum(n) AS ece
FROM (SELECT task, len(list_filter({_edges}, lambda e: e <= p)) AS b, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM panel_binary GROUP BY 1, 2) t
GROUP BY task""",
)
step("panel_brier", "SELECT task, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg((p - y) * (p - y)) AS brier FROM panel_binary GROUP BY task")
step(
    "panel_regression",
    """
SELECT task, count(*) AS n, avg(abs(days - point_estimate)) AS mae, sqrt(avg((days - point_estimate) * (days - point_estimate))) AS rmse,
       1 - sum((days - point_estimate) * (days - point_estimate)) / (count(*) * var_pop(days)) AS r2
FROM panel_scores WHERE kind = 'regression' GROUP BY task""",
)


def binary_scores(v: Views):
    return v.panel_scores.filter(F.col("kind") == "binary").select("task", "y", F.col("probability").alias("p"))


# ---- metrics ----


@query(
    "auroc",
    """
SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc
FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored) t""",
)
def auroc(v: Views):
    return metrics.ranking_metrics(v.scored).select("auroc")


@query(
    "auprc",
    """
SELECT round(sum(pos * cum_pos / cum_n) / any_value(total), 6) AS auprc
FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cum_pos, sum(n) OVER (ORDER BY p DESC) AS cum_n, sum(pos) OVER () AS total
      FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p) g) c""",
)
def auprc(v: Views):
    return metrics.ranking_metrics(v.scored).select("auprc")


@query("brier", "SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg((p - y) * (p - y)), 6) AS brier FROM scored")
def brier(v: Views):
    return metrics.brier(v.scored)


@query(
    "ece",
    f"""
SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS calibration_error
FROM (SELECT len(list_filter({_edges}, lambda e: e <= p)) AS b, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM scored GROUP BY 1) t""",
)
def ece(v: Views):
    return metrics.calibration_error(v.scored)


@query("ece_bins", f"SELECT len(list_filter({_edges}, lambda e: e <= p)) AS bin, count(*) AS n FROM scored GROUP BY 1")
def ece_bins(v: Views):
    return v.scored.groupBy(metrics.ece_bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "binary_metrics",
    """
SELECT b.task, b.n, b.positives, round(a.auroc, 6) AS auroc, round(p.auprc, 6) AS auprc, round(b.brier, 6) AS brier, round(e.ece, 6) AS calibration_error
FROM panel_brier b JOIN panel_auroc a ON a.task = b.task JOIN panel_auprc p ON p.task = b.task JOIN panel_ece e ON e.task = b.task""",
)
def binary_metrics(v: Views):
    return metrics.binary_metrics(binary_scores(v), by=["task"])


@query("regression_metrics", "SELECT task, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM panel_regression")
def regression_metrics(v: Views):
    rows = v.panel_scores.filter(F.col("kind") == "regression")
    return metrics.regression_metrics(rows, by=["task"], label="days", prediction="point_estimate")


@query(
    "metrics_headline",
    """
SELECT t.task, t.task_group, t.kind, round(a.auroc, 3) AS auroc, round(p.auprc, 3) AS auprc, round(r.mae, 3) AS mae, round(r.r2, 3) AS r2
FROM (SELECT DISTINCT task, task_group, kind FROM panel_scores) t LEFT JOIN panel_auroc a ON a.task = t.task
LEFT JOIN panel_auprc p ON p.task = t.task LEFT JOIN panel_regression r ON r.task = t.task""",
)
def metrics_headline(v: Views):
    rows = v.panel_scores.filter(F.col("kind") == "regression")
    regression = metrics.regression_metrics(rows, by=["task"], label="days", prediction="point_estimate")
    return metrics.metrics_headline(metrics.ranking_metrics(binary_scores(v), by=["task"]), regression, task_dim(v.spark))


@query(
    "base_rate_recalibration",
    """
WITH RECURSIVE z AS (SELECT ln((p + 0.005) / (1.005 - p)) AS x, count(*) AS n FROM scored GROUP BY 1),
halving AS (
  SELECT 0 AS i, CAST(-20.0 AS DOUBLE) AS lo, CAST(20.0 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN m < 0.18 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < 0.18 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT h.i, h.lo, h.hi, sum(z.n / (1 + exp(-(z.x + (h.lo + h.hi) / 2)))) / sum(z.n) AS m FROM halving h JOIN z ON h.i < 60 GROUP BY h.i, h.lo, h.hi) s)
SELECT round((lo + hi) / 2, 6) AS intercept, 0.18::DOUBLE AS mean_probability FROM halving WHERE i = 60""",
)
def base_rate_recalibration(v: Views):
    """Shift of all logits that brings the mean probability to 18 percent, and the mean it gives."""
    latent = v.scored.select(F.ln((F.col("p") + 0.005) / (1.005 - F.col("p"))).alias("x"))
    b = metrics.solve_intercept(latent, "x", 0.18)
    return latent.agg(F.lit(b).alias("intercept"), F.avg(fn.sigmoid(F.col("x") + F.lit(b))).alias("mean_probability"))


# ---- scalar rules ----


@query(
    "score_rules",
    """
SELECT patient_id, CAST(round_even(p * 100, 0) AS BIGINT) AS pct, CASE WHEN p < 0.10 THEN 'low' WHEN p < 0.30 THEN 'moderate' ELSE 'elevated' END AS tier,
       CASE WHEN p < 0.34 THEN 'higher' WHEN p < 0.67 THEN 'moderate' ELSE 'lower' END AS confidence,
       CASE WHEN p > 0 AND p < 1 THEN round(ln(p / (1 - p)), 4) END AS logit, round(1 / (1 + exp(-(p * 8 - 4))), 6) AS sigmoid,
       round(greatest(0.0, least(1.0, p * 2 - 0.5)), 6) AS clipped
FROM scored""",
)
def score_rules(v: Views):
    p = F.col("p")
    return v.scored.select(
        "patient_id",
        fn.probability_pct(p).alias("pct"),
        fn.risk_tier(p).alias("tier"),
        fn.confidence_label(p).alias("confidence"),
        fn.logit(p).alias("logit"),
        fn.sigmoid(p * 8 - 4).alias("sigmoid"),
        fn.clip01(p * 2 - 0.5).alias("clipped"),
    )


@query("probability_pct", "SELECT patient_id, task, CAST(round_even(probability * 100, 0) AS BIGINT) AS pct FROM panel_scores WHERE kind = 'binary'")
def probability_pct(v: Views):
    rows = v.panel_scores.filter(F.col("kind") == "binary")
    return rows.select("patient_id", "task", fn.probability_pct(F.col("probability")).alias("pct"))


@query("risk_tier", "SELECT task, CASE WHEN probability < 0.10 THEN 'low' WHEN probability < 0.30 THEN 'moderate' ELSE 'elevated' END AS tier, count(*) AS n FROM panel_scores WHERE kind = 'binary' GROUP BY 1, 2")
def risk_tier(v: Views):
    rows = v.panel_scores.filter(F.col("kind") == "binary")
    return rows.groupBy("task", fn.risk_tier(F.col("probability")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("confidence_label", "SELECT task, CASE WHEN uncertainty < 0.34 THEN 'higher' WHEN uncertainty < 0.67 THEN 'moderate' ELSE 'lower' END AS confidence, count(*) AS n FROM panel_scores GROUP BY 1, 2")
def confidence_label(v: Views):
    return v.panel_scores.groupBy("task", fn.confidence_label(F.col("uncertainty")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("logit", "SELECT patient_id, task, CASE WHEN probability > 0 AND probability < 1 THEN round(ln(probability / (1 - probability)), 4) END AS logit FROM panel_scores")
def logit(v: Views):
    return v.panel_scores.select("patient_id", "task", fn.logit(F.col("probability")).alias("logit"))


@query("sigmoid", "SELECT patient_id, round(1 / (1 + exp(-(p * 8 - 4))), 6) AS sigmoid FROM scored")
def sigmoid(v: Views):
    return v.scored.select("patient_id", fn.sigmoid(F.col("p") * 8 - 4).alias("sigmoid"))


@query(
    "reliability_tier",
    """
SELECT t.task, t.kind, CASE WHEN t.kind = 'regression' THEN CASE WHEN r.r2 IS NULL THEN 'unknown' WHEN r.r2 >= 0.4 THEN 'reliable' WHEN r.r2 >= 0.2 THEN 'moderate' ELSE 'weak' END
  ELSE CASE WHEN a.auroc IS NULL THEN 'unknown' WHEN a.auroc >= 0.75 THEN 'reliable' WHEN a.auroc >= 0.65 THEN 'moderate' ELSE 'weak' END END AS reliability
FROM (SELECT DISTINCT task, kind FROM panel_scores) t LEFT JOIN panel_auroc a ON a.task = t.task LEFT JOIN panel_regression r ON r.task = t.task""",
)
def reliability_tier(v: Views):
    rows = v.panel_scores.filter(F.col("kind") == "regression")
    regression = metrics.regression_metrics(rows, by=["task"], label="days", prediction="point_estimate").select("task", "r2")
    both = metrics.ranking_metrics(binary_scores(v), by=["task"]).select("task", "auroc").unionByName(regression, allowMissingColumns=True)
    return both.join(task_dim(v.spark), "task").select(
        "task", "kind", fn.reliability_tier(F.col("kind"), F.col("auroc"), F.col("r2")).alias("reliability")
    )


# ---- picks and ranks ----


@query("uncertainty", "SELECT patient_id, round(greatest(0.0, least(1.0, 0.7 * (1 - 2 * abs(p - 0.5)) + 0.3 * (patient_id % 13) / (max(patient_id % 13) OVER () + 1e-9))), 6) AS uncertainty FROM scored")
def uncertainty(v: Views):
    scored = v.scored.select("patient_id", F.col("p").alias("probability"), (F.col("patient_id") % 13).cast("double").alias("spread"))
    return add_uncertainty(scored).select("patient_id", "uncertainty")


@query("uncertainty_row", "SELECT patient_id, round(greatest(0.0, least(1.0, 0.7 * (1 - 2 * abs(p - 0.5)) + 0.3 * (patient_id % 13) / (patient_id % 13 + 1e-9))), 6) AS uncertainty FROM scored")
def uncertainty_row(v: Views):
    scored = v.scored.select("patient_id", F.col("p").alias("probability"), (F.col("patient_id") % 13).cast("double").alias("spread"))
    return add_uncertainty(scored, spread_scope="row").select("patient_id", "uncertainty")


@query(
    "panel_rank",
    "SELECT patient_id, task, row_number() OVER (PARTITION BY patient_id, task_group ORDER BY coalesce(probability, -1) DESC, task) AS panel_rank FROM panel_scores",
)
def panel_rank(v: Views):
    return profiles.panel_rank(v.panel_scores, ["patient_id"]).select("patient_id", "task", "panel_rank")


@query(
    "top_forward_risk",
    """
SELECT patient_id, task, round(probability, 6) AS probability,
       CASE WHEN uncertainty < 0.34 THEN 'higher' WHEN uncertainty < 0.67 THEN 'moderate' ELSE 'lower' END AS confidence_label FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY probability DESC, task) AS nth FROM panel_scores
  WHERE task_group = 'forward' AND probability IS NOT NULL) t WHERE nth = 1""",
)
def top_forward_risk(v: Views):
    return profiles.top_forward_risk(profiles.score_columns(v.panel_scores), ["patient_id"])


@query("highest_risk", "SELECT patient_id, p FROM scored ORDER BY p DESC, patient_id LIMIT 1")
def highest_risk(v: Views):
    return v.scored.orderBy(F.desc("p"), "patient_id").limit(1).select("patient_id", "p")


@query("sample_first_n", "SELECT patient_id, p FROM scored ORDER BY patient_id LIMIT 20")
def sample_first_n(v: Views):
    """The first 20 of a fixed order: the size of a quality review is asked for by its caller."""
    return v.scored.orderBy("patient_id").limit(20).select("patient_id", "p")


# ---- contributions ----

_FEATURES = [f"count__{c}" for c in CODES] + [f"value__{c}" for c in NUMERIC] + ["age", "sex_female", "n_events"]
_MINUS = ("LAB/eGFR", "MED/STATIN")
step(
    "cells",
    " UNION ALL ".join(
        f"SELECT patient_id, '{f}' AS feature, \"{f}\" AS value, {1.0 / (len(f) - 2)!r}::DOUBLE AS importance,"
        f" {-1.0 if f.split('__')[-1] in _MINUS else 1.0} AS direction FROM matrix"
        for f in _FEATURES
    ),
)
step("cell_medians", "SELECT feature, median(value) AS median FROM cells GROUP BY feature")
step(
    "impacts",
    """
SELECT c.patient_id, c.feature, c.value, c.direction * c.importance * tanh(coalesce(c.value, 0) - coalesce(m.median, 0)) AS impact
FROM cells c JOIN cell_medians m ON m.feature = c.feature""",
)
step(
    "top5",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY round(abs(impact), 9) DESC, feature) AS rank FROM impacts) t WHERE rank <= 5""",
)


def impacts(v: Views):
    """Contributions over the whole event matrix; importance is a given number per column."""
    names = sorted(vocab(v).feature_names)
    table = materialize(wide(v), "matrix")  # read for the medians and for the impacts
    long = mx.matrix_long(table, names)
    weights = inline_table(v.spark, [(f, 1.0 / (len(f) - 2)) for f in names], "feature string, importance double")
    medians = mx.feature_medians(table, names)
    signs = explain.directions(weights, builtin_concepts(v.spark))
    return explain.attribution_approx(long, weights, medians, signs)


def strongest(v: Views):
    rounded = impacts(v).withColumn("impact", F.round("impact", 9))
    return explain.top_k(rounded, ["patient_id", "label_time"], 5)


@query("attribution_approx", "SELECT patient_id, feature, round(impact, 6) + 0.0 AS impact FROM impacts")
def attribution_approx(v: Views):
    return impacts(v).select("patient_id", "feature", "impact")


@query(
    "attribution_undirected",
    "SELECT c.patient_id, c.feature, round(c.importance * tanh(coalesce(c.value, 0) - coalesce(m.median, 0)), 6) + 0.0 AS impact FROM cells c JOIN cell_medians m ON m.feature = c.feature",
)
def attribution_undirected(v: Views):
    """Every column taken as 'higher is worse'."""
    names = sorted(vocab(v).feature_names)
    table = materialize(wide(v), "matrix")
    weights = inline_table(v.spark, [(f, 1.0 / (len(f) - 2)) for f in names], "feature string, importance double")
    out = explain.attribution_approx(mx.matrix_long(table, names), weights, mx.feature_medians(table, names))
    return out.select("patient_id", "feature", "impact")


@query("topk_contributors", "SELECT patient_id, feature, rank, round(impact, 6) + 0.0 AS impact FROM top5")
def topk_contributors(v: Views):
    return strongest(v).select("patient_id", "feature", "rank", "impact")


@query(
    "contributor_views",
    """
SELECT t.patient_id, t.rank, t.feature, coalesce(c.name, n.name) AS concept, coalesce(c.phrase, n.phrase) AS phrase,
       CASE WHEN t.impact > 0 THEN 'increases' ELSE 'decreases' END AS direction,
       round_even(round(abs(t.impact), 9) / t.strongest, 3) AS magnitude, round_even(coalesce(t.value, 0), 3) AS observed_value
FROM (SELECT *, max(round(abs(impact), 9)) OVER (PARTITION BY patient_id) AS strongest FROM top5) t
LEFT JOIN builtin_concept c ON c.code = regexp_replace(t.feature, '^(count__|value__)', '')
LEFT JOIN builtin_concept n ON n.code = t.feature
WHERE round(t.impact, 9) <> 0""",
)
def contributor_views(v: Views):
    views = explain.contributor_views(strongest(v), ["patient_id", "label_time"], builtin_concepts(v.spark))
    return views.drop("label_time", "method")


@query(
    "risk_profile",
    """
SELECT t.patient_id, round(l.value * 0.6 + 0.05 + t.h, 6) AS probability, CAST(round_even((l.value * 0.6 + 0.05 + t.h) * 100, 0) AS BIGINT) AS pct,
       CASE WHEN l.value * 0.6 + 0.05 + t.h < 0.1 THEN 'low' WHEN l.value * 0.6 + 0.05 + t.h < 0.3 THEN 'moderate' ELSE 'elevated' END AS tier,
       coalesce(t.up, '') AS up, coalesce(t.down, '') AS down
FROM (SELECT m.patient_id, (CAST(m.patient_id AS BIGINT) % 30) / 100.0::DOUBLE AS h,
             (SELECT string_agg(feature, '|' ORDER BY rank) FROM top5 x WHERE x.patient_id = m.patient_id AND round(impact, 9) > 0) AS up,
             (SELECT string_agg(feature, '|' ORDER BY rank) FROM top5 x WHERE x.patient_id = m.patient_id AND round(impact, 9) < 0) AS down
      FROM matrix m) t JOIN lb l ON l.patient_id = t.patient_id""",
)
def risk_profile(v: Views):
    """Profile assembly around given scores, flattened for the check."""
    scores = v.lb.select(
        "patient_id",
        "label_time",
        (F.col("value") * 0.6 + 0.05 + (F.col("patient_id").cast("bigint") % 30) / F.lit(100.0)).alias("probability"),
        F.lit(0.5).alias("raw_probability"),
        F.lit(0.4).alias("uncertainty"),
    )
    record = ["patient_id", "label_time"]
    nested = explain.nest_views(explain.contributor_views(strongest(v), record, builtin_concepts(v.spark)), record)
    out = profiles.risk_profile(scores, nested, ev.snapshot(v.ev, v.lb, lookback_days=14))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["feature"]), "|")
    return out.select(
        "patient_id",
        "probability",
        F.col("probability_pct").alias("pct"),
        F.col("risk_tier").alias("tier"),
        names("contributors").alias("up"),
        names("protective_factors").alias("down"),
    )


# ---- the panel ----

_RATINGS = (
    ("mortality_1y", 0.82, None), ("readmission_30d", 0.63, None), ("prolonged_stay", 0.7, None), ("los_days", None, 0.25),
    ("dx_diabetes", 0.75, None), ("dx_hypertension", None, None),
)
step(
    "panel_rating",
    "SELECT * FROM (VALUES ('mortality_1y', 'reliable'), ('readmission_30d', 'weak'), ('prolonged_stay', 'moderate'), ('los_days', 'moderate'),"
    " ('dx_diabetes', 'reliable'), ('dx_hypertension', 'unknown')) AS t(task, reliability)",
)
step(
    "panel_task",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{t.name}', '{t.label}', '{t.horizon}')" for t in ALL_TASKS if t.name in {p[1] for p in PANEL_TASKS})
    + ") AS t(task, label, horizon)",
)
step(
    "panel_view",
    """
SELECT patient_id, task, feature, impact, row_number() OVER (PARTITION BY patient_id, task ORDER BY abs(impact) DESC, pos) AS rank,
       CASE feature WHEN 'age' THEN 'your age' WHEN 'count__DX/DIABETES' THEN 'a history of diabetes mellitus' ELSE 'your sodium level' END AS phrase
FROM panel_impacts""",
)
step(
    "panel_impacts",
    " UNION ALL ".join(
        f"SELECT patient_id, task, {i} AS pos, '{f}' AS feature, impact_{i} AS impact FROM panel_scores"
        for i, f in enumerate(PANEL_FEATURES)
    ),
)


#: Rows of the scored panel that one task turns into profiles.
ROWS_PER_PIECE = 100_000


def panels(v: Views, snapshots=None):
    tasks = [t for t in ALL_TASKS if t.name in {p[1] for p in PANEL_TASKS}]
    cells = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"value_{i}").alias("value"), F.col(f"impact_{i}").alias("impact")
        )
        for i, f in enumerate(PANEL_FEATURES)
    ]
    words = explain.words_of(list(PANEL_FEATURES), concept_dim(v.spark))
    up, down = explain.views_in_row(explain.top_k_array(F.array(*cells), 5), words)
    ratings = inline_table(v.spark, _RATINGS, "task string, auroc double, r2 double")
    # shuffled while the rows are narrow: the views are made, and the tasks of a patient gathered, where they then lie. The
    # pieces follow the number of rows, as what a row becomes is many times its size
    pieces = max(1, -(-v.panel_scores.count() // ROWS_PER_PIECE))
    scores = v.panel_scores.repartition(pieces, "patient_id").select(
        "patient_id", "task", "probability", F.col("probability").alias("raw_probability"), "point_estimate", "uncertainty",
        up.alias("contributors"), down.alias("protective_factors"),
    )
    return profiles.panel(scores, task_dim(v.spark, tasks), ratings, snapshots=snapshots)


@query(
    "panel_profile_assembly",
    """
SELECT patient_id, coalesce(string_agg(CASE WHEN task_group = 'forward' THEN task END, '|' ORDER BY coalesce(probability, -1) DESC, task), '') AS forward,
       coalesce(string_agg(CASE WHEN task_group = 'chronic' THEN task END, '|' ORDER BY coalesce(probability, -1) DESC, task), '') AS chronic
FROM panel_scores GROUP BY patient_id""",
)
def panel_profile_assembly(v: Views):
    names = lambda c: F.array_join(F.transform(c, lambda t: t["name"]), "|")
    return panels(v).select("patient_id", names("forward").alias("forward"), names("chronic").alias("chronic"))


@query(
    "health_payload",
    """
SELECT s.patient_id, t.label AS outcome, CAST(round_even(s.probability * 100, 0) AS BIGINT) AS chance_percent,
       CASE WHEN s.uncertainty < 0.34 THEN 'higher' WHEN s.uncertainty < 0.67 THEN 'moderate' ELSE 'lower' END AS confidence,
       r.reliability AS model_reliability, t.horizon,
       coalesce((SELECT string_agg(phrase, '|' ORDER BY rank) FROM panel_view p WHERE p.patient_id = s.patient_id AND p.task = s.task AND p.impact > 0), '') AS top_factors
FROM panel_scores s JOIN panel_task t ON t.task = s.task JOIN panel_rating r ON r.task = s.task WHERE s.task_group = 'forward' AND s.kind = 'binary'""",
)
def health_payload(v: Views):
    """Forward risks of the payload, one row each."""
    risks = profiles.health_payload(panels(v)).select("patient_id", F.explode_outer("payload.forward_risks").alias("r"))
    risks = risks.filter(F.col("r").isNotNull())
    return risks.select("patient_id", "r.*").withColumn("top_factors", F.array_join("top_factors", "|"))


@query(
    "health_payload_expected",
    """
SELECT s.patient_id, t.label AS outcome, round_even(s.point_estimate, 1) AS estimate, r.reliability AS model_reliability
FROM panel_scores s JOIN panel_task t ON t.task = s.task JOIN panel_rating r ON r.task = s.task WHERE s.kind = 'regression'""",
)
def health_payload_expected(v: Views):
    rows = profiles.health_payload(panels(v)).select("patient_id", F.explode_outer("payload.expected_outcomes").alias("r"))
    rows = rows.filter(F.col("r").isNotNull())
    return rows.select("patient_id", "r.outcome", "r.estimate", "r.model_reliability")


@query(
    "payload_json",
    """
SELECT s.patient_id, t.label AS first_outcome, CAST(round_even(s.probability * 100, 0) AS VARCHAR) AS first_percent, '2' AS n_chronic
FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY probability DESC, task) AS nth FROM panel_scores
      WHERE task_group = 'forward' AND kind = 'binary') s JOIN panel_task t ON t.task = s.task WHERE s.nth = 1""".replace(
        "CAST(round_even(s.probability * 100, 0) AS VARCHAR)", "CAST(CAST(round_even(s.probability * 100, 0) AS BIGINT) AS VARCHAR)"
    ),
)
def payload_json(v: Views):
    """The payload as JSON text, read back by path."""
    text = profiles.health_payload(panels(v)).select("patient_id", "payload_json")
    at = lambda path: F.get_json_object("payload_json", path)
    chronic = F.json_array_length(at("$.chronic_profile")).cast("string")
    return text.select(
        "patient_id",
        at("$.forward_risks[0].outcome").alias("first_outcome"),
        at("$.forward_risks[0].chance_percent").alias("first_percent"),
        chronic.alias("n_chronic"),
    )


step(
    "panel_window",
    "SELECT e.* FROM panel_events e JOIN panel_labels l ON e.patient_id = l.patient_id WHERE e.time <= l.label_time AND e.time >= l.label_time - INTERVAL 90 DAY",
)


@query(
    "payload_snapshot",
    """
SELECT l.patient_id, l.age, l.sex,
       coalesce((SELECT string_agg(DISTINCT code, '|' ORDER BY code) FROM panel_window w WHERE w.patient_id = l.patient_id AND w.code LIKE 'ICD%'), '') AS conditions,
       (SELECT round_even(last_of.value, 1) FROM (
          SELECT value FROM panel_window w WHERE w.patient_id = l.patient_id AND w.value IS NOT NULL ORDER BY w.time DESC, w.value DESC LIMIT 1) last_of) AS hba1c,
       coalesce((SELECT count(*) FROM panel_window w WHERE w.patient_id = l.patient_id AND w.code LIKE 'ENC%'), 0) AS encounters, 'approx' AS method
FROM panel_labels l""",
)
def payload_snapshot(v: Views):
    """Demographics and recent snapshot of the payload, read back from its JSON text."""
    shots = ev.snapshot(v.panel_events, v.panel_labels, lookback_days=90)
    nested = panels(v, shots)
    text = profiles.health_payload(nested, keep=("attribution_method",)).select("patient_id", "payload_json", "attribution_method")
    at = lambda path: F.get_json_object("payload_json", path)
    conditions = F.from_json(F.coalesce(at("$.recent_snapshot.active_conditions"), F.lit("[]")), "array<string>")
    return text.select(
        "patient_id",
        at("$.demographics.age").cast("double").alias("age"),
        at("$.demographics.sex").alias("sex"),
        F.array_join(conditions, "|").alias("conditions"),
        at("$.recent_snapshot.recent_observations['LAB/HbA1c']").cast("double").alias("hba1c"),
        at("$.recent_snapshot.n_recent_encounters").cast("bigint").alias("encounters"),
        F.col("attribution_method").alias("method"),
    )


@query(
    "prediction_block",
    """
SELECT s.patient_id, s.task, t.label, s.task_group AS grp, s.kind, CASE WHEN s.uncertainty < 0.34 THEN 'higher' WHEN s.uncertainty < 0.67 THEN 'moderate' ELSE 'lower' END AS confidence,
       round_even(s.uncertainty, 4) AS uncertainty, round_even(s.probability, 4) AS probability, round_even(s.probability * 100, 0) AS probability_pct,
       CASE WHEN s.probability > 0 AND s.probability < 1 THEN round(ln(s.probability / (1 - s.probability)), 4) END AS logit,
       CASE WHEN s.probability < 0.1 THEN 'low' WHEN s.probability < 0.3 THEN 'moderate' WHEN s.probability IS NOT NULL THEN 'elevated' END AS risk_tier,
       round(s.point_estimate, 6) AS point_estimate, CASE WHEN s.kind = 'binary' THEN a.auroc END AS auroc,
       coalesce((SELECT string_agg(phrase, '|' ORDER BY rank) FROM panel_view p WHERE p.patient_id = s.patient_id AND p.task = s.task AND p.impact > 0), '') AS top_contributors
FROM panel_scores s JOIN panel_task t ON t.task = s.task JOIN (VALUES """
    + ", ".join(f"('{t}', {'NULL' if a is None else a})" for t, a, _ in _RATINGS)
    + """) AS a(task, auroc) ON a.task = s.task""",
)
def prediction_block(v: Views):
    """The prediction block of response records, an entry per row."""
    block = profiles.prediction_block(panels(v)).select("patient_id", F.explode(F.concat("predictions.forward", "predictions.chronic")).alias("p"))
    return block.select(
        "patient_id", "p.task", "p.label", F.col("p.group").alias("grp"), "p.kind", "p.confidence", "p.uncertainty", "p.probability",
        F.col("p.probability_pct").cast("double").alias("probability_pct"), "p.logit", "p.risk_tier", "p.point_estimate", "p.auroc",
        F.array_join(F.transform("p.top_contributors", lambda c: c["phrase"]), "|").alias("top_contributors"),
    )
