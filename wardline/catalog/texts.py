"""Queries over generated responses: guardrails, quality, parsing, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.catalog.registry import BANNED, Views, query, step
from wardline.functions import text as tx
from wardline.operators import guardrails as gr
from wardline.operators import profiles
from wardline.session import scratch_path
from wardline.sources.sinks import read_texts, write_records

COLUMNS = [f"s{i}" for i in range(1, 6)]

step("blobs", "SELECT *, s1 || ' ' || s2 || ' ' || s3 || ' ' || s4 || ' ' || s5 AS blob FROM responses")

_quote = lambda t: "'" + t.replace("'", "''") + "'"
_missing = [f"CASE WHEN NOT regexp_matches({c}, '\\S') THEN {_quote(n)} END" for c, n in zip(COLUMNS, tx.SECTIONS)]
_missing_text = [
    f"CASE WHEN NOT regexp_matches({c}, '\\S') THEN {_quote(f'missing or empty section: {chr(39)}{n}{chr(39)}')} END"
    for c, n in zip(COLUMNS, tx.SECTIONS)
]


def _banned_text(phrases) -> list[str]:
    return [
        f"CASE WHEN contains(lower(blob), {_quote(p)}) THEN {_quote(f'overclaiming/diagnostic phrase detected: {chr(39)}{p.strip()}{chr(39)}')} END"
        for p in phrases
    ]


_number_text = ["CASE WHEN NOT contains(s1, CAST(pct AS VARCHAR)) THEN 'probability not faithfully stated' END"]
_doubt = "contains(lower(blob), 'caution') OR contains(lower(blob), 'less certain')"
_doubt_text = [f"CASE WHEN confidence_label = 'lower' AND NOT ({_doubt}) THEN 'low confidence not reflected in summary' END"]
_join = lambda items: f"concat_ws('|', {', '.join(items)})"


def flat(c) -> Column:
    return F.array_join(c, "|")


@query("guard_sections", f"SELECT patient_id, {_join(_missing)} AS missing FROM responses")
def guard_sections(v: Views):
    return v.responses.select("patient_id", flat(tx.missing_sections([F.col(c) for c in COLUMNS])).alias("missing"))


@query(
    "guard_banned",
    "SELECT patient_id, " + _join([f"CASE WHEN contains(lower(blob), {_quote(p)}) THEN {_quote(p.strip())} END" for p in BANNED]) + " AS hits FROM blobs",
)
def guard_banned(v: Views):
    blob = tx.joined([F.col(c) for c in COLUMNS])
    return v.responses.select("patient_id", flat(tx.banned_hits(blob, BANNED)).alias("hits"))


@query("guard_probability", "SELECT patient_id, contains(s1, CAST(pct AS VARCHAR)) AS stated FROM responses")
def guard_probability(v: Views):
    warned = gr.guardrails(v.responses, banned=())
    return warned.select("patient_id", (~F.array_contains("warnings", "probability not faithfully stated")).alias("stated"))


@query("guard_confidence", f"SELECT patient_id, confidence_label <> 'lower' OR {_doubt} AS reflected FROM blobs")
def guard_confidence(v: Views):
    warned = gr.guardrails(v.responses, banned=())
    return warned.select(
        "patient_id", (~F.array_contains("warnings", "low confidence not reflected in summary")).alias("reflected")
    )


@query(
    "guardrails",
    f"SELECT patient_id, {_join(_missing_text + _banned_text(BANNED) + _number_text + _doubt_text)} AS warnings FROM blobs",
)
def guardrails(v: Views):
    return gr.guardrails(v.responses, banned=BANNED).select("patient_id", flat("warnings").alias("warnings"))


@query("guard_baseline", f"SELECT patient_id, {_join(_missing_text + _banned_text(BANNED))} AS warnings FROM blobs")
def guard_baseline(v: Views):
    return gr.guardrails(v.responses, banned=BANNED, model_checks=False).select("patient_id", flat("warnings").alias("warnings"))


@query(
    "guard_free_text",
    f"""
SELECT patient_id, concat_ws('|', CASE WHEN NOT regexp_matches(blob, '\\S') THEN 'empty summary' END, {', '.join(_banned_text(tx.BANNED_PHRASES))},
  CASE WHEN NOT contains(blob, CAST(pct AS VARCHAR)) THEN 'probability not faithfully stated' END, {_doubt_text[0]}) AS warnings FROM blobs""",
)
def guard_free_text(v: Views):
    return gr.guardrails(v.responses, template=False).select("patient_id", flat("warnings").alias("warnings"))


@query(
    "guard_panel",
    f"""
SELECT patient_id, concat_ws('|', {', '.join(_missing_text)}, {', '.join(_banned_text(BANNED))},
  CASE WHEN confidence_label <> 'higher' AND NOT contains(s1, CAST(pct AS VARCHAR)) THEN 'top forward-risk percentage not faithfully stated' END, {_doubt_text[0]}) AS warnings
FROM blobs""",
)
def guard_panel(v: Views):
    """The panel form: without a forward risk (here: confidence 'higher') the number is not asked for."""
    rows = v.responses.withColumn("pct", F.when(F.col("confidence_label") != "higher", F.col("pct")))
    return gr.guardrails(rows, banned=BANNED, panel=True).select("patient_id", flat("warnings").alias("warnings"))


_stated = r"list_distinct(list_transform(regexp_extract_all(blob, '(\d{1,3})\s*%', 1), lambda x: CAST(x AS INT)))"


@query("factual_consistency", f"SELECT patient_id, list_contains({_stated}, CAST(pct AS INT)) AS consistent, len({_stated}) AS n_stated FROM blobs")
def factual_consistency(v: Views):
    stated = tx.percentages(tx.joined([F.col(c) for c in COLUMNS]))
    return v.responses.select(
        "patient_id", F.array_contains(stated, F.col("pct").cast("int")).alias("consistent"), F.size(stated).alias("n_stated")
    )


# phrases a faithful text names: here the words of the third section, so that both outcomes occur
step("named", "SELECT *, CASE WHEN regexp_matches(s3, '\\S') THEN [s3] ELSE CAST([] AS VARCHAR[]) END AS phrases FROM blobs")
_words = r"list_filter(list_transform(regexp_split_to_array(s3, '\s+'), lambda w: trim(lower(w), ',.()')), lambda w: length(w) > 3)"
_grounded = f"(len(phrases) = 0 OR len(list_filter({_words}, lambda w: contains(lower(s2), w))) > 0)"


def named(v: Views):
    nothing = F.array().cast("array<string>")
    return v.responses.withColumn("phrases", F.when(tx.stripped(F.col("s3")) != "", F.array("s3")).otherwise(nothing))


@query("grounded", f"SELECT patient_id, {_grounded} AS grounded FROM named")
def grounded(v: Views):
    return named(v).select("patient_id", tx.grounded(F.col("s2"), F.col("phrases")).alias("grounded"))


_faithful = f"(confidence_label <> 'lower' OR {_doubt} OR contains(lower(blob), 'uncertain'))"


@query("uncertainty_faithful", f"SELECT patient_id, {_faithful} AS uncertainty_faithful FROM blobs")
def uncertainty_faithful(v: Views):
    return gr.summary_quality(v.responses).select("patient_id", "uncertainty_faithful")


_sentences = r"list_filter(regexp_split_to_array(blob, '[.!?\n]'), lambda s: regexp_matches(s, '\S'))"
_n_words = rf"list_sum(list_transform({_sentences}, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))))"
_filled = " + ".join(f"CASE WHEN regexp_matches({c}, '\\S') THEN 1 ELSE 0 END" for c in COLUMNS)
_clarity = (
    f"CASE WHEN len({_sentences}) = 0 THEN 0.0 ELSE round_even(0.5 * greatest(0.0, 1.0 - abs(CAST({_n_words} AS DOUBLE) / len({_sentences}) - 15.0) / 25.0)"
    f" + 0.5 * CAST({_filled} AS DOUBLE) / 5.0, 3) END"
)


@query("clarity_score", f"SELECT patient_id, CAST({_clarity} AS DOUBLE) AS clarity FROM blobs")
def clarity_score(v: Views):
    return v.responses.select("patient_id", tx.clarity_score([F.col(c) for c in COLUMNS]).alias("clarity"))


_clean = " AND ".join(f"NOT contains(lower(blob), {_quote(p)})" for p in BANNED)
_present = " AND ".join(f"regexp_matches({c}, '\\S')" for c in COLUMNS)
step(
    "judged",
    f"""
SELECT patient_id, factual_consistency, no_unsupported_claims, uncertainty_faithful, all_sections_present, clarity_score,
       factual_consistency AND no_unsupported_claims AND uncertainty_faithful AND all_sections_present AS passed,
       CAST(NOT factual_consistency AS INT) + CAST(NOT clean AS INT) + CAST(NOT grounded AS INT) + CAST(NOT uncertainty_faithful AS INT)
         + CAST(NOT all_sections_present AS INT) AS n_issues
FROM (SELECT patient_id, list_contains({_stated}, CAST(pct AS INT)) AS factual_consistency, {_clean} AS clean, {_grounded} AS grounded,
             ({_clean}) AND {_grounded} AS no_unsupported_claims, {_faithful} AS uncertainty_faithful, {_present} AS all_sections_present,
             CAST({_clarity} AS DOUBLE) AS clarity_score FROM named) j""",
)


@query(
    "summary_quality",
    "SELECT patient_id, factual_consistency, no_unsupported_claims, uncertainty_faithful, all_sections_present, clarity_score, passed, CAST(n_issues AS BIGINT) AS n_issues FROM judged",
)
def summary_quality(v: Views):
    judged = gr.summary_quality(named(v), banned=BANNED, phrases="phrases")
    return judged.select(
        "patient_id", "factual_consistency", "no_unsupported_claims", "uncertainty_faithful", "all_sections_present",
        "clarity_score", "passed", F.size("issues").alias("n_issues"),
    )


@query(
    "quality_rollup",
    "SELECT count(*) AS n, "
    + ", ".join(f"round(avg(CAST({f} AS INT)), 6) AS {f}" for f in gr.QUALITY_FLAGS)
    + ", round(avg(clarity_score), 6) AS clarity_score FROM judged",
)
def quality_rollup(v: Views):
    return gr.quality_rollup(gr.summary_quality(named(v), banned=BANNED, phrases="phrases"))


# ---- JSON, records, Markdown ----


@query(
    "parse_sections",
    "SELECT patient_id, patient_id % 5 = 0 AS parse_error, "
    + ", ".join(
        f"CASE WHEN patient_id % 5 = 0 {missing.format(c)}THEN '' ELSE trim({c}, chr(32) || chr(9) || chr(10) || chr(13)) END AS {c}"
        for c, missing in zip(COLUMNS, ("", "", "", "OR patient_id % 3 = 0 ", ""))
    )
    + " FROM responses",
)
def parse_sections(v: Views):
    """Answers as JSON text with all sections, one with blanks around; every third lacks the fourth section; every
    fifth is cut off and no JSON at all."""
    texts = {c: F.col(c) for c in COLUMNS}
    texts["s2"] = F.concat(F.lit("  "), "s2", F.lit("\n"))
    texts["s4"] = F.when(F.col("patient_id") % 3 != 0, F.col("s4"))
    keys = [x for name, c in zip(tx.SECTIONS, COLUMNS) for x in (F.lit(name), texts[c])]
    answer = F.to_json(F.create_map(*keys))
    cut = F.when(F.col("patient_id") % 5 == 0, F.concat(F.lit('{"'), "s1")).otherwise(answer)
    parsed = gr.parse_sections(v.responses.select("patient_id", cut.alias("answer")), "answer")
    return parsed.select("patient_id", "parse_error", *COLUMNS)


def records(v: Views):
    scored = v.responses.withColumn("predictions", F.struct("pct", "confidence_label"))
    return profiles.response_records(scored, predictions="predictions", backend="table", generated_at=F.lit("2024-01-01T00:00:00"))


_md = (
    "'# Inference record — patient ' || patient_id || chr(10) || chr(10) || '- generated_at: 2024-01-01T00:00:00' || chr(10) || "
    "'- agent_backend: table | mode: template' || chr(10) || '- model: {}' || chr(10) || chr(10) || '## Agent report' || chr(10) || chr(10) || "
    + " || ".join(f"{_quote('### ' + n)} || chr(10) || {c} || chr(10) || chr(10)" for c, n in zip(COLUMNS, tx.SECTIONS))
    + f" || '---' || chr(10) || {_quote('_' + tx.DISCLAIMER + '_')} || chr(10) || chr(10) || '## Predictions (model output — below the report)' || chr(10) || chr(10) || "
    "'```json' || chr(10) || '{\"pct\":' || pct || ',\"confidence_label\":\"' || confidence_label || '\"}' || chr(10) || '```' || chr(10) || chr(10) || "
    "'## EHR feature input' || chr(10) || chr(10) || '```json' || chr(10) || '{}' || chr(10) || '```'"
)


@query("render_markdown", f"SELECT CAST(patient_id AS VARCHAR) AS patient_id, md5({_md}) AS digest, length({_md}) AS n_chars FROM responses")
def render_markdown(v: Views):
    """Whole Markdown text per response, compared by digest and length."""
    rendered = profiles.render_markdown(records(v))
    return rendered.select(
        "patient_id", F.md5(F.col("markdown").cast("binary")).alias("digest"), F.length("markdown").alias("n_chars")
    )


@query(
    "sink_response_json",
    "SELECT CAST(patient_id AS VARCHAR) AS patient_id, s1, s2, s3, s4, s5, 'conversations' AS dataset, 'table-baseline' AS provider FROM responses",
)
def sink_response_json(v: Views):
    """Records written as JSON by data set and provider, and read back."""
    path = write_records(records(v), scratch_path(v.spark, "records"), "json", dataset="conversations", provider="table", variant="baseline")
    schema = "patient_id string, report struct<sections: map<string,string>>, dataset string, provider string"
    read = v.spark.read.schema(schema).json(path)
    sections = [F.col("report.sections")[name].alias(c) for name, c in zip(tx.SECTIONS, COLUMNS)]
    return read.select("patient_id", *sections, "dataset", "provider")


@query("sink_response_text", f"SELECT md5({_md}) AS digest, length({_md}) AS n_chars, 'conversations' AS dataset, 'table' AS provider FROM responses")
def sink_response_text(v: Views):
    """Whole Markdown records written as text by data set and provider, and read back."""
    path = write_records(records(v), scratch_path(v.spark, "records"), "md", dataset="conversations", provider="table")
    read = read_texts(v.spark, path)
    return read.select(F.md5(F.col("value").cast("binary")).alias("digest"), F.length("value").alias("n_chars"), "dataset", "provider")
