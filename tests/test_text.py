"""Guardrails, quality, parsing and records on hand-written responses."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.functions import text as tx
from wardline.operators import explain, guardrails as gr, profiles

SCHEMA = "patient_id bigint, s1 string, s2 string, s3 string, s4 string, s5 string, pct int, confidence_label string"
GOOD = (1, "About 42% of similar people.", "Your age plays a part.", "This is an estimate.", "Talk to your doctor.", "Call if it gets worse.", 42, "higher")


def first(spark, row, fn_, **kw):
    return fn_(spark.createDataFrame([row], SCHEMA), **kw).first()


def test_clean_response(spark):
    assert first(spark, GOOD, gr.guardrails)["warnings"] == []
    q = first(spark, GOOD, gr.summary_quality)
    assert q["passed"] and q["issues"] == [] and 0 < q["clarity_score"] <= 1


def test_everything_wrong(spark):
    bad = (2, "You have a problem. You will know.", "", None, " \n", "x", 42, "lower")
    got = first(spark, bad, gr.guardrails)["warnings"]
    assert got == [
        "missing or empty section: 'What may be contributing'",
        "missing or empty section: 'What this means'",
        "missing or empty section: 'What to do next'",
        "overclaiming/diagnostic phrase detected: 'you have'",
        "overclaiming/diagnostic phrase detected: 'you will'",
        "probability not faithfully stated",
        "low confidence not reflected in summary",
    ]
    q = first(spark, bad, gr.summary_quality)
    assert not q["passed"] and len(q["issues"]) == 4
    baseline = first(spark, bad, gr.guardrails, model_checks=False)["warnings"]
    assert baseline == got[:5]


def test_number_inside_a_number_passes_the_loose_check_only(spark):
    row = (3, "About 74% of people.", *GOOD[2:6], 7, "higher")
    assert first(spark, row, gr.guardrails)["warnings"] == []
    assert first(spark, row, gr.summary_quality)["factual_consistency"] is False


def test_free_text(spark):
    empty = (4, "", "", "", "", " ", 7, "higher")
    assert "empty summary" in first(spark, empty, gr.guardrails, template=False)["warnings"]


def test_panel_without_forward_risk_skips_model_checks(spark):
    row = (5, *GOOD[1:6], None, "lower")
    assert first(spark, row, gr.guardrails, panel=True)["warnings"] == []


def test_doubt_words(spark):
    row = (6, GOOD[1] + " The model is uncertain.", *GOOD[2:6], 42, "lower")
    assert first(spark, row, gr.guardrails)["warnings"] == ["low confidence not reflected in summary"]
    assert first(spark, row, gr.summary_quality)["uncertainty_faithful"] is True


@pytest.mark.parametrize(
    "section,phrases,want",
    [("Your Diabetes matters", ["a history of diabetes,"], True), ("Nothing here", ["a history of diabetes"], False),
     ("Nothing here", [], True), ("the age", ["the age"], False)],
)
def test_grounding(spark, section, phrases, want):
    df = spark.createDataFrame([(section, phrases)], "s string, p array<string>")
    assert df.select(tx.grounded(F.col("s"), F.col("p"))).first()[0] is want


def test_clarity_bounds(spark):
    none = (7, "", "", "", "", "", 1, "higher")
    assert first(spark, none, gr.summary_quality)["clarity_score"] == 0.0
    fifteen = " ".join(["word"] * 15) + "."
    best = (8, fifteen, fifteen, fifteen, fifteen, fifteen, 1, "higher")
    assert first(spark, best, gr.summary_quality)["clarity_score"] == 1.0


def test_rollup(spark):
    df = spark.createDataFrame([GOOD, (2, "", "", "", "", "", 42, "lower")], SCHEMA)
    got = gr.quality_rollup(gr.summary_quality(df)).first()
    assert got["n"] == 2 and got["passed"] == 0.5


def test_parse_sections(spark):
    texts = ['{"What we found": " a ", "What this means": 3}', "", "no json", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in gr.parse_sections(df, "t").collect()}
    assert (got[0]["s1"], got[0]["s3"], got[0]["s5"]) == ("a", "3", "")
    assert [got[i]["parse_error"] for i in range(5)] == [False, True, True, True, False]


def test_score_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.0999,), (0.1,), (0.3,), (0.34,), (0.67,), (1.0,), (None,)], "p double")
    got = df.select(fn.risk_tier(F.col("p")).alias("t"), fn.logit(F.col("p")).alias("l")).collect()
    assert [r["t"] for r in got] == ["low", "low", "moderate", "elevated", "elevated", "elevated", "elevated", None]
    assert got[0]["l"] is None and got[6]["l"] is None and got[2]["l"] == pytest.approx(-2.1972)
    pct = spark.createDataFrame([(0.025,), (0.035,), (0.5,)], "p double").select(fn.probability_pct(F.col("p"))).collect()
    assert [r[0] for r in pct] == [2, 4, 50]


def test_zero_impacts_give_no_views(spark):
    from wardline.operators.concepts import builtin_concepts

    df = spark.createDataFrame([("a", 0, "age", 1.0, 0.0), ("a", 1, "n_events", 2.0, 0.0)], "patient_id string, pos int, feature string, value double, impact double")
    top = explain.top_k(df, ["patient_id"], 5)
    assert explain.contributor_views(top, ["patient_id"], builtin_concepts(spark)).count() == 0


def test_views_are_relative_and_split_by_sign(spark):
    from wardline.operators.concepts import builtin_concepts

    df = spark.createDataFrame(
        [("a", 0, "age", 70.0, 0.2), ("a", 1, "n_events", None, -0.4), ("a", 2, "count__MED/STATIN", 1.0, 0.2)],
        "patient_id string, pos int, feature string, value double, impact double",
    )
    views = explain.contributor_views(explain.top_k(df, ["patient_id"], 2), ["patient_id"], builtin_concepts(spark))
    nested = explain.nest_views(views, ["patient_id"]).first()
    assert [(c["feature"], c["magnitude"]) for c in nested["contributors"]] == [("age", 0.5)]
    assert [(c["feature"], c["magnitude"], c["observed_value"]) for c in nested["protective_factors"]] == [("n_events", 1.0, 0.0)]


def test_markdown_and_text(spark):
    records = profiles.response_records(spark.createDataFrame([GOOD], SCHEMA), generated_at=F.lit("now"))
    md = profiles.render_markdown(records).first()["markdown"]
    assert md.startswith("# Inference record — patient 1\n\n- generated_at: now\n")
    assert md.index("### What we found") < md.index("### When to seek care urgently") < md.index("## Predictions")
    text = profiles.render_text(records).first()["text"]
    assert "#" not in text and "```" not in text
