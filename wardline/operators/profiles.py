"""Nested profile records: single task, panel of tasks, payload, response record, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.functions import text as tx
from wardline.operators.concepts import Task

APPROX_NOTE = "Contributor estimates are approximate: read their order as a hint, not as exact."
# Fixed value: what stands in place of predictions where none were made.
BASELINE_NOTE = "LLM baseline — raw EHR fed directly to the model; no prediction model, score, or attribution."
# Fixed value: the note at the end of every payload.
PAYLOAD_NOTE = "All numbers are model estimates, not confirmed diagnoses."

VIEW = (
    "array<struct<rank:int,concept:string,phrase:string,direction:string,magnitude:double,"
    "observed_value:double,feature:string,method:string>>"
)


def _views(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(VIEW))


def score_columns(scores: DataFrame) -> DataFrame:
    """Adds tier, percent and confidence to (probability, uncertainty)."""
    return scores.withColumns(
        {
            "risk_tier": fn.risk_tier(F.col("probability")),
            "probability_pct": fn.probability_pct(F.col("probability")),
            "confidence_label": fn.confidence_label(F.col("uncertainty")),
        }
    )


SNAPSHOT = ("age", "sex", "active_conditions", "recent_observations", "n_recent_encounters")


def risk_profile(
    scores: DataFrame, nested_views: DataFrame, snapshots: DataFrame, *, method: str = "approx", task: Task | None = None
) -> DataFrame:
    """One profile per record of a single task.

    `scores` is (patient_id, label_time, probability, raw_probability, uncertainty) from any model; `task` adds the
    block that says what the probability is of.
    """
    record = ["patient_id", "label_time"]
    notes = F.array(F.lit(APPROX_NOTE)) if method == "approx" else F.array().cast("array<string>")
    block = []
    if task is not None:
        about = {"name": task.name, "description": task.label, "positive_label": task.positive_label, "horizon": task.horizon}
        block = [F.struct(*[F.lit(value).alias(key) for key, value in about.items()]).alias("task")]
    return (
        score_columns(scores)
        .join(nested_views, record, "left")
        .join(snapshots, record, "left")
        .select(
            *record,
            *block,
            "probability",
            "raw_probability",
            "probability_pct",
            "risk_tier",
            "uncertainty",
            "confidence_label",
            _views("contributors").alias("contributors"),
            _views("protective_factors").alias("protective_factors"),
            F.struct(*SNAPSHOT).alias("snapshot"),
            F.lit(method).alias("attribution_method"),
            notes.alias("notes"),
        )
    )


def panel_rank(scores: DataFrame, record: list[str]) -> DataFrame:
    """Order inside a panel group: probability falling, tasks without one last. A record has one row
    per task, so the window partitions are as small as the task list."""
    order = Window.partitionBy(*record, "task_group").orderBy(
        F.coalesce("probability", F.lit(-1.0)).desc(), "task"
    )
    return scores.withColumn("panel_rank", F.row_number().over(order))


def top_forward_risk(scores: DataFrame, record: list[str]) -> DataFrame:
    """The forward task with the highest probability per record, by name on a tie."""
    forward = scores.filter((F.col("task_group") == "forward") & F.col("probability").isNotNull())
    best = F.min(F.struct((-F.col("probability")).alias("o"), "task", "probability", "confidence_label"))
    return forward.groupBy(*record).agg(best.alias("b")).select(*record, "b.task", "b.probability", "b.confidence_label")


def panel(
    scores: DataFrame, tasks: DataFrame, metrics: DataFrame, *, snapshots: DataFrame | None = None, method: str = "approx"
) -> DataFrame:
    """One record per stay of a patient with the arrays `forward` and `chronic`.

    `scores` is (patient_id, task, probability, raw_probability, point_estimate, uncertainty, contributors,
    protective_factors), the views made inside the row; `metrics` is (task, auroc, r2). A column `stay`, where there is
    one, tells a patient's records apart, else a patient is one. `snapshots` (the same keys, age, sex, conditions,
    observations, encounters) adds `demographics` and `snapshot`. One shuffle, by these keys; a group is the tasks of
    one record.
    """
    keys = ["patient_id", *[c for c in ("stay",) if c in scores.columns]]
    rated = tasks.join(metrics.select("task", "auroc", "r2"), "task", "left").withColumn(
        "reliability", fn.reliability_tier(F.col("kind"), F.col("auroc"), F.col("r2"))
    )
    rows = score_columns(scores).join(rated.drop("r2"), "task")
    entry = F.struct(
        (-F.coalesce("probability", F.lit(-1.0))).alias("order"),
        F.col("task").alias("name"),
        "label", "kind", "positive_label", "horizon", "probability", "raw_probability", "probability_pct", "risk_tier",
        "point_estimate", "uncertainty", "confidence_label", "auroc", "reliability",
        _views("contributors").alias("contributors"),
        _views("protective_factors").alias("protective_factors"),
    )
    side = lambda group: F.array_sort(F.collect_list(F.when(F.col("task_group") == group, entry))).alias(group)
    out = rows.groupBy(*keys).agg(side("forward"), side("chronic"))
    if snapshots is not None:
        state = snapshots.select(
            *keys, F.struct(*SNAPSHOT).alias("snapshot"), F.struct("age", "sex").alias("demographics")
        )
        out = out.join(state, keys, "left")
    # a panel carries no notes of its own; what is approximate says so in `attribution_method`
    return out.withColumns({"attribution_method": F.lit(method), "notes": F.array().cast("array<string>")})


def _contributor_block(views: Column) -> Column:
    """The first five views as a response record keeps them."""
    fields = ("concept", "phrase", "direction", "magnitude", "observed_value", "feature")
    return F.transform(F.slice(views, 1, 5), lambda c: F.struct(*[c[f].alias(f) for f in fields]))


def _prediction_entry(t: Column, group: str) -> Column:
    binary = lambda value: F.when(t["kind"] == "binary", value)
    return F.struct(
        t["name"].alias("task"), t["label"].alias("label"), F.lit(group).alias("group"), t["kind"].alias("kind"),
        t["confidence_label"].alias("confidence"), F.bround(t["uncertainty"], 4).alias("uncertainty"),
        F.get(t["contributors"], F.lit(0))["method"].alias("attribution_method"),
        _contributor_block(t["contributors"]).alias("top_contributors"),
        t["point_estimate"].alias("point_estimate"),
        binary(F.bround(t["probability"], 4)).alias("probability"), binary(t["probability_pct"]).alias("probability_pct"),
        binary(fn.logit(t["raw_probability"])).alias("logit"),
        binary(F.bround(t["raw_probability"], 4)).alias("raw_probability"),
        binary(t["risk_tier"]).alias("risk_tier"), binary(t["auroc"]).alias("auroc"),
    )


def prediction_block(panels: DataFrame) -> DataFrame:
    """`panels` with `predictions`: the entries of both groups as a response record keeps them, numbers rounded to four
    digits, probabilities only for yes-or-no tasks."""
    side = lambda group: F.transform(group, lambda t: _prediction_entry(t, group)).alias(group)
    return panels.withColumn("predictions", F.struct(side("forward"), side("chronic")))


def single_prediction_block(profiles: DataFrame) -> DataFrame:
    """The same for a profile of one task (`risk_profile`)."""
    rounded = lambda c: F.bround(c, 4).alias(c)
    return profiles.withColumn("predictions", F.struct(
        *[c for c in ("task",) if c in profiles.columns], rounded("probability"), "probability_pct",
        fn.logit(F.col("raw_probability")).alias("logit"), rounded("raw_probability"), "risk_tier",
        F.col("confidence_label").alias("confidence"), rounded("uncertainty"),
        _contributor_block(F.col("contributors")).alias("top_contributors"),
        _contributor_block(F.col("protective_factors")).alias("protective_factors"),
    ))


def single_payload(profiles: DataFrame) -> DataFrame:
    """(keys, payload_json): all of a single-task profile, as a text writer is given it."""
    keys = [c for c in ("patient_id", "label_time") if c in profiles.columns]
    return profiles.select(*keys, F.to_json(F.struct(*[c for c in profiles.columns if c not in keys])).alias("payload_json"))


def health_payload(panels: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Compact JSON view of a panel: what a text writer is given, and nothing else. `keep` names columns of `panels` that
    stand beside it."""
    phrases = lambda t: F.transform(F.slice(t["contributors"], 1, 3), lambda c: c["phrase"])
    forward = F.transform(
        F.filter("forward", lambda t: t["kind"] == "binary"),
        lambda t: F.struct(
            t["label"].alias("outcome"), t["probability_pct"].alias("chance_percent"),
            t["confidence_label"].alias("confidence"), t["reliability"].alias("model_reliability"),
            t["horizon"].alias("horizon"), phrases(t).alias("top_factors"),
        ),
    )
    expected = F.transform(
        F.filter("forward", lambda t: (t["kind"] == "regression") & t["point_estimate"].isNotNull()),
        lambda t: F.struct(
            t["label"].alias("outcome"), F.bround(t["point_estimate"], 1).alias("estimate"),
            t["confidence_label"].alias("confidence"), t["reliability"].alias("model_reliability"),
            phrases(t).alias("top_factors"),
        ),
    )
    chronic = F.transform(
        "chronic",
        lambda t: F.struct(
            t["label"].alias("condition"), t["probability_pct"].alias("likelihood_percent"),
            t["confidence_label"].alias("confidence"), t["reliability"].alias("model_reliability"),
        ),
    )
    given = lambda column, name: [F.col(column).alias(name)] if column in panels.columns else []
    payload = F.struct(
        *given("demographics", "demographics"), forward.alias("forward_risks"), expected.alias("expected_outcomes"),
        chronic.alias("chronic_profile"), *given("snapshot", "recent_snapshot"), F.lit(PAYLOAD_NOTE).alias("note"),
    )
    keys = [c for c in ("patient_id", "stay") if c in panels.columns]
    return panels.select(*keys, *keep, payload.alias("payload")).withColumn("payload_json", F.to_json("payload"))


def response_records(
    responses: DataFrame, *, sections=("s1", "s2", "s3", "s4", "s5"), predictions: str | None = None,
    inputs: str | None = None, model: str | None = None, backend: str = "backend", mode: str = "template", generated_at: Column | None = None,
) -> DataFrame:
    """Nested record per response: metadata, report, predictions, input. The text comes with the table.

    `predictions` and `inputs` name columns of any kind (see `prediction_block`). Without predictions the record says
    that the text was made from the raw record alone.
    """
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if generated_at is None else generated_at
    names = [F.struct(F.lit(n).alias("key"), tx.text_or_empty(F.col(c)).alias("value")) for n, c in zip(tx.SECTIONS, sections)]
    json_of = lambda c: F.lit("{}") if c is None else F.to_json(F.col(c))
    return responses.select(
        F.col("patient_id").cast("string").alias("patient_id"),
        F.struct(
            F.col("patient_id").cast("string").alias("patient_id"), when.alias("generated_at"),
            F.lit(backend).alias("agent_backend"), F.lit(mode).alias("mode"),
            json_of(model).alias("model"),
        ).alias("metadata"),
        F.struct(F.map_from_entries(F.array(*names)).alias("sections"), F.lit(tx.DISCLAIMER).alias("disclaimer")).alias("report"),
        (F.to_json(F.struct(F.lit(BASELINE_NOTE).alias("note"))) if predictions is None else json_of(predictions)).alias("predictions"),
        json_of(inputs).alias("input"),
    )


def render_markdown(records: DataFrame) -> DataFrame:
    """(patient_id, markdown): report on top, predictions and input below it."""
    body = F.transform(
        F.map_entries("report.sections"), lambda e: F.concat(F.lit("### "), e["key"], F.lit("\n"), e["value"], F.lit("\n"))
    )
    meta = F.col("metadata")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Inference record — patient "), meta["patient_id"]),
        F.lit(""),
        F.concat(F.lit("- generated_at: "), meta["generated_at"]),
        F.concat(F.lit("- agent_backend: "), meta["agent_backend"], F.lit(" | mode: "), meta["mode"]),
        F.concat(F.lit("- model: "), meta["model"]),
        F.lit(""),
        F.lit("## Agent report"),
        F.lit(""),
        F.array_join(body, "\n"),
        F.lit("---"),
        F.concat(F.lit("_"), F.col("report.disclaimer"), F.lit("_")),
        F.lit(""),
        F.lit("## Predictions (model output — below the report)"),
        F.lit(""),
        F.lit("```json"),
        F.col("predictions"),
        F.lit("```"),
        F.lit(""),
        F.lit("## EHR feature input"),
        F.lit(""),
        F.lit("```json"),
        F.col("input"),
        F.lit("```"),
    )
    return records.select("patient_id", text.alias("markdown"))


def render_text(records: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("markdown", "```(json)?", ""), "#+ ?", "")
    return render_markdown(records).select("patient_id", plain.alias("text"))
