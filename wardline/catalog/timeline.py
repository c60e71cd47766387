"""Queries over events + labels: lookback, vocabulary, matrix, snapshot, alignment, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.hospital import built, stored
from wardline.catalog.registry import Views, query, step
from wardline.functions import clinical as fn
from wardline.operators import events as ev
from wardline.operators import matrix as mx
from wardline.operators.concepts import (
    ALL_TASKS, DEFAULT_NUMERIC_CODES, concept_dim, excluded_prefix_dim, hospital_concepts, override_concepts,
    builtin_concepts, resolve_concepts, BUILTIN_CONCEPTS, VITAL_NAMES, VITAL_STATS, STAT_WORDS, LAB_NAMES, ICD_GROUPS,
)
from wardline.operators.ranking import hash_rank
from wardline.operators.split import assign_split
from wardline.session import inline_table, materialize

DAYS = 14
TOP = 4

step(
    "win",
    f"""
SELECT l.patient_id, l.label_time, e.time, e.code, e.value FROM lb l JOIN ev e ON e.patient_id = l.patient_id
WHERE e.time <= l.label_time AND e.time >= l.label_time - INTERVAL {DAYS} DAY""",
)
step("doc_freq", "SELECT code, count(DISTINCT patient_id) AS doc_freq FROM win GROUP BY code")
step(
    "latest",
    """
SELECT patient_id, code, value AS last FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, code ORDER BY time DESC, value DESC) AS nth
  FROM win WHERE value IS NOT NULL) w WHERE nth = 1""",
)
step("counted", "SELECT patient_id, code, count(*) AS n FROM win GROUP BY patient_id, code")

CODES = ("ENC/ED", "ICD10/E11.9", "LAB/HbA1c", "LAB/eGFR", "MED/STATIN")
NUMERIC = ("LAB/HbA1c", "LAB/eGFR")


def sql_matrix(codes=CODES, numeric=NUMERIC) -> str:
    """The wide matrix in plain SQL, for the five codes the given events carry."""
    counts = ", ".join(
        f"CAST(coalesce(max(CASE WHEN c.code = '{c}' THEN c.n END), 0) AS DOUBLE) AS \"count__{c}\"" for c in codes
    )
    values = ", ".join(f"max(CASE WHEN t.code = '{c}' THEN t.last END) AS \"value__{c}\"" for c in numeric)
    return f"""
SELECT l.patient_id, l.label_time, {counts}, {values}, l.age,
       CASE WHEN l.sex = 'female' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex_female,
       CAST(coalesce((SELECT count(*) FROM win w WHERE w.patient_id = l.patient_id), 0) AS DOUBLE) AS n_events
FROM lb l LEFT JOIN counted c ON c.patient_id = l.patient_id LEFT JOIN latest t ON t.patient_id = l.patient_id AND t.code = c.code
GROUP BY l.patient_id, l.label_time, l.age, l.sex"""


step("matrix", sql_matrix())
step(
    "id_rank",
    """
SELECT patient_id, row_number() OVER (ORDER BY md5('42:' || patient_id), patient_id) AS rank, count(*) OVER () AS n
FROM (SELECT DISTINCT patient_id FROM lb) i""",
)
step(
    "split_of",
    """
SELECT patient_id, CASE WHEN rank <= floor(n * 0.15) THEN 'test' WHEN rank <= floor(n * 0.15) + floor(n * 0.15) THEN 'val' ELSE 'train' END AS split
FROM id_rank""",
)


def folded(v: Views):
    """Events of the windows folded per code, written once per query: vocabulary and matrix read it."""
    if "folded_events" not in v.__dict__:
        v.folded_events = materialize(mx.fold(v.ev, v.lb, lookback_days=DAYS), "folded")
    return v.folded_events


def vocab(v: Views) -> mx.Vocabulary:
    """Learned once per query."""
    if "vocabulary" not in v.__dict__:
        v.vocabulary = mx.fit_vocab(v.ev, v.lb, max_features=200, numeric="auto", folded=folded(v))
    return v.vocabulary


def wide(v: Views):
    return mx.matrix(v.ev, v.lb, vocab(v), folded=folded(v))


@query(
    "load_event_label",
    """
SELECT l.patient_id, l.label_time, CAST(l.value AS BIGINT) AS label, l.age, l.sex, e.time, e.code, e.value
FROM lb l LEFT JOIN ev e ON e.patient_id = l.patient_id""",
)
def load_event_label(v: Views):
    joined = ev.labelled_events(v.ev, v.lb).withColumn("label", fn.label_value(F.col("label")))
    return joined.select("patient_id", "label_time", "label", "age", "sex", "time", "code", "value")


@query("lookback_filter", "SELECT patient_id, time, code, value FROM win")
def lookback_filter(v: Views):
    return ev.in_lookback(v.ev, v.lb, DAYS).select("patient_id", "time", "code", "value")


@query("events_before", "SELECT patient_id, time, code FROM ev WHERE time <= TIMESTAMP '2024-01-10 00:00:00'")
def events_before(v: Views):
    return ev.events_before(v.ev, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("patient_id", "time", "code")


@query("code_doc_freq", "SELECT code, doc_freq FROM doc_freq")
def code_doc_freq(v: Views):
    return mx.code_doc_freq(mx.fold(v.ev, v.lb, lookback_days=DAYS))


@query("vocab_topn", f"SELECT code, doc_freq FROM doc_freq ORDER BY doc_freq DESC, code LIMIT {TOP}")
def vocab_topn(v: Views):
    return mx.vocab_topn(mx.code_doc_freq(mx.fold(v.ev, v.lb, lookback_days=DAYS)), TOP)


@query(
    "numeric_codes_auto",
    "SELECT code FROM ev WHERE value IS NOT NULL AND patient_id IN (SELECT patient_id FROM lb) GROUP BY code",
)
def numeric_codes_auto(v: Views):
    return mx.numeric_codes(v.ev, v.lb)


@query(
    "numeric_codes_whitelist",
    f"""
SELECT w.pos, w.code FROM (VALUES (0, 'LAB/HbA1c'), (1, 'LAB/eGFR')) AS w(pos, code)
WHERE w.code IN (SELECT code FROM doc_freq ORDER BY doc_freq DESC, code LIMIT {TOP})""".replace("w.pos", "CAST(w.pos AS BIGINT) AS pos", 1),
)
def numeric_codes_whitelist(v: Views):
    """The white list, in its own order, cut down to the vocabulary."""
    listed = inline_table(v.spark, enumerate(DEFAULT_NUMERIC_CODES), "pos int, code string")
    top = mx.vocab_topn(mx.code_doc_freq(mx.fold(v.ev, v.lb, lookback_days=DAYS)), TOP)
    return listed.join(top.select("code"), "code", "left_semi").select("pos", "code")


@query("count_features", "SELECT patient_id, code, n FROM counted")
def count_features(v: Views):
    return mx.fold(v.ev, v.lb, lookback_days=DAYS).select("patient_id", "code", "n")


@query("value_features", "SELECT patient_id, code, last FROM latest")
def value_features(v: Views):
    folded = mx.fold(v.ev, v.lb, lookback_days=DAYS)
    return folded.filter(F.col("last").isNotNull()).select("patient_id", "code", "last")


@query("n_events", "SELECT patient_id, n_events FROM matrix")
def n_events(v: Views):
    return wide(v).select("patient_id", "n_events")


@query("matrix", "SELECT * FROM matrix")
def matrix(v: Views):
    return wide(v)


@query(
    "snapshot",
    """
SELECT l.patient_id, l.age, l.sex,
       coalesce((SELECT string_agg(code, '|' ORDER BY code) FROM (SELECT DISTINCT patient_id, code FROM win WHERE code LIKE 'ICD%') c
                 WHERE c.patient_id = l.patient_id), '') AS conditions,
       coalesce((SELECT string_agg(code || '=' || CAST(CAST(round(last * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY code)
                 FROM latest t WHERE t.patient_id = l.patient_id), '') AS observations,
       coalesce((SELECT count(*) FROM win w WHERE w.code LIKE 'ENC%' AND w.patient_id = l.patient_id), 0) AS encounters
FROM lb l""".replace("round(last * 100)", "round_even(last, 1) * 10"),
)
def snapshot(v: Views):
    shots = ev.snapshot(v.ev, v.lb, lookback_days=DAYS)
    tenths = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10).cast("bigint").cast("string"))
    return shots.select(
        "patient_id",
        "age",
        "sex",
        F.array_join("active_conditions", "|").alias("conditions"),
        F.array_join(F.transform(F.array_sort(F.map_entries("recent_observations")), tenths), "|").alias("observations"),
        F.col("n_recent_encounters").alias("encounters"),
    )


@query("split_ids", "SELECT patient_id, split FROM split_of")
def split_ids(v: Views):
    return assign_split(v.lb)


@query(
    "matrix_label_align",
    "SELECT m.*, l.value AS label, s.split FROM matrix m JOIN lb l ON l.patient_id = m.patient_id JOIN split_of s ON s.patient_id = m.patient_id",
)
def matrix_label_align(v: Views):
    return mx.align(wide(v), v.lb, assign_split(v.lb))


step(
    "hosp_wide",
    """
SELECT patient_id, obs_window, count(*) AS n_events,
       max(CASE WHEN code = 'VITAL/HR_mean' THEN value END) AS hr_mean, max(CASE WHEN code = 'LAB/SODIUM' THEN value END) AS sodium,
       count(*) FILTER (WHERE code = 'DX/DIABETES') AS n_diabetes
FROM all_events GROUP BY patient_id, obs_window""",
)


@query(
    "cross_window_align",
    """
SELECT d.patient_id, round(d.hr_mean, 6) AS hr_discharge, round(h.hr_mean, 6) AS hr_24h, round(d.sodium, 6) AS sodium_discharge,
       round(h.sodium, 6) AS sodium_24h, CAST(d.n_events AS DOUBLE) AS n_discharge, CAST(h.n_events AS DOUBLE) AS n_24h,
       CAST(d.n_diabetes AS DOUBLE) AS diabetes_discharge
FROM hosp_wide d JOIN hosp_wide h ON h.patient_id = d.patient_id AND d.obs_window = 'discharge' AND h.obs_window = '24h'""",
)
def cross_window_align(v: Views):
    """Hospital matrices of both windows, patient by patient."""
    from wardline.plans.panel import window_matrices

    parts = stored(v)
    matrices, _ = window_matrices(parts["events"], parts["labels"])
    both = mx.cross_window_align(matrices)
    pick = {
        "hr_discharge": "value__VITAL/HR_mean@discharge", "hr_24h": "value__VITAL/HR_mean@24h",
        "sodium_discharge": "value__LAB/SODIUM@discharge", "sodium_24h": "value__LAB/SODIUM@24h",
        "n_discharge": "n_events@discharge", "n_24h": "n_events@24h", "diabetes_discharge": "count__DX/DIABETES@discharge",
    }
    return both.select("patient_id", *[mx.quoted(c).alias(name) for name, c in pick.items()])


@query(
    "feature_map",
    "SELECT patient_id, feature, round(value, 4) AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT patient_id, '{f}' AS feature, \"{f}\" AS value FROM matrix"
        for f in [f"count__{c}" for c in CODES] + [f"value__{c}" for c in NUMERIC] + ["age", "sex_female", "n_events"]
    )
    + ") f",
)
def feature_map(v: Views):
    names = vocab(v).feature_names
    return mx.feature_map(wide(v), names).select("patient_id", F.explode("features").alias("feature", "value"))


@query(
    "record_inputs",
    """
SELECT patient_id, 1 AS stay, obs_window, round(hr_mean, 4) AS hr_mean, round(sodium, 4) AS sodium, CAST(n_diabetes AS DOUBLE) AS n_diabetes,
       CAST(n_events AS DOUBLE) AS n_events FROM hosp_wide""".replace("1 AS stay", "CAST(1 AS BIGINT) AS stay"),
)
def record_inputs(v: Views):
    """Model inputs of both windows per stay, by window tag."""
    from wardline.plans.panel import record_inputs as inputs
    from wardline.plans.panel import window_matrices

    parts = stored(v)
    matrices, vocabularies = window_matrices(parts["events"], parts["labels"])
    rows = inputs(matrices, vocabularies).select("patient_id", "stay", F.explode("features").alias("obs_window", "f"))
    names = {"hr_mean": "value__VITAL/HR_mean", "sodium": "value__LAB/SODIUM", "n_diabetes": "count__DX/DIABETES", "n_events": "n_events"}
    picked = rows.select("patient_id", "stay", "obs_window", *[F.col("f")[f].alias(c) for c, f in names.items()])
    return picked.where("n_events > 0")


@query(
    "feature_medians",
    "SELECT feature, round(median(value), 6) AS median FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, \"{f}\" AS value FROM matrix"
        for f in [f"count__{c}" for c in CODES] + [f"value__{c}" for c in NUMERIC] + ["age", "sex_female", "n_events"]
    )
    + ") f GROUP BY feature",
)
def feature_medians(v: Views):
    return mx.feature_medians(wide(v), vocab(v).feature_names)


@query(
    "lab_medians",
    "SELECT lab, round(median(valuenum), 6) AS median FROM (SELECT i.lab, l.valuenum FROM lab l JOIN lab_concept i ON l.itemid = i.itemid WHERE l.valuenum IS NOT NULL) r GROUP BY lab",
)
def lab_medians(v: Views):
    """The same exact median over every laboratory value of the star."""
    from wardline.operators.measurements import coded_labs
    from wardline.operators.ranking import exact_median

    return exact_median(coded_labs(v.lab, v.lab_items).select("lab", "value"), ["lab"], "value")


@query(
    "stride_sample",
    "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rank,"
    " greatest(1, floor(count(*) OVER () / 100)) AS step FROM documents) d WHERE (rank - 1) % step = 0",
)
def stride_sample(v: Views):
    return mx.stride_sample(v.base("documents").select("doc_id"), "doc_id", target=100)


@query("id_rank", "SELECT patient_id, rank FROM id_rank")
def id_rank(v: Views):
    return hash_rank(v.lb.select("patient_id").distinct(), "patient_id", seed=42)


# ---- leakage rule, concepts, raw payload over the built hospital events ----

_sql_text = lambda t: t.replace("'", "''")
step(
    "hospital_concept",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{c}', '{_sql_text(n)}', '{_sql_text(p)}', {d})"
        for c, n, p, d in [
            (
                f"VITAL/{code}_{s}", f"{text} ({s})",
                f"the {STAT_WORDS[s]} your {text.lower()}" if s == "std" else f"your {STAT_WORDS[s]} {text.lower()}",
                "false" if code == "SPO2" else "true",
            )
            for code, text in VITAL_NAMES.items()
            for s in VITAL_STATS
        ]
        + [(f"LAB/{c}", t, f"your {t.lower()} level", "true") for c, t in LAB_NAMES.items()]
        + [(f"DX/{g.code}", g.description, f"a history of {g.description.lower()}", "true") for g in ICD_GROUPS]
        + [("UTIL/N_PRIOR_ADM", "Prior hospital admissions", "your number of previous hospital admissions", "true")]
    )
    + ") AS t(code, name, phrase, higher_is_concerning)",
)
step(
    "builtin_concept",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{_sql_text(n)}', '{_sql_text(p)}', {str(d).lower()})" for c, n, p, d in BUILTIN_CONCEPTS)
    + ") AS t(code, name, phrase, higher_is_concerning)",
)
step("features", "SELECT DISTINCT 'count__' || code AS feature FROM all_events UNION SELECT DISTINCT 'value__' || code FROM all_events WHERE value IS NOT NULL")
step(
    "prefixes",
    "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{p}')" for t in ALL_TASKS for p in t.exclude_prefixes) + ") AS t(task, prefix)",
)


def hospital_features(v: Views):
    """Feature names the built events give rise to."""
    events = built(v)["events"].groupBy("code").agg(F.count("value").alias("n"))
    names = F.array(F.concat(F.lit("count__"), "code"), F.when(F.col("n") > 0, F.concat(F.lit("value__"), "code")))
    return events.select(F.explode(F.array_compact(names)).alias("feature"))


@query(
    "leakage_exclusion",
    """
SELECT t.task, f.feature FROM features f JOIN (SELECT DISTINCT task FROM prefixes) t ON true
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.task = t.task AND starts_with(substr(f.feature, 8), p.prefix))""",
)
def leakage_exclusion(v: Views):
    """(task, feature) pairs a chronic task may see."""
    tasks = [F.lit(t.name) for t in ALL_TASKS if t.exclude_prefixes]
    pairs = hospital_features(v).select(F.explode(F.array(*tasks)).alias("task"), "feature")
    return mx.leakage_exclusion(pairs, excluded_prefix_dim(v.spark))


@query("strip_prefix", "SELECT feature, substr(feature, 8) AS code, split_part(substr(feature, 8), '/', 1) AS family FROM features")
def strip_prefix(v: Views):
    code = fn.strip_prefix(F.col("feature"))
    return hospital_features(v).select("feature", code.alias("code"), fn.code_family(code).alias("family"))


@query(
    "concept_dim",
    "SELECT e.code, c.name, c.phrase, c.higher_is_concerning, e.n FROM (SELECT code, count(*) AS n FROM all_events GROUP BY code) e"
    " JOIN hospital_concept c ON c.code = e.code",
)
def concept_words(v: Views):
    """Words for every code the built events carry."""
    counted = built(v)["events"].groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(hospital_concepts(v.spark), "code").select("code", "name", "phrase", "higher_is_concerning", "n")


@query(
    "concept_override",
    """
SELECT e.code, coalesce(o.name, b.name) AS name, coalesce(o.phrase, o.name, b.phrase) AS phrase,
       CASE WHEN o.code IS NOT NULL THEN true ELSE b.higher_is_concerning END AS higher_is_concerning, e.n
FROM (SELECT code, count(*) AS n FROM ev GROUP BY code) e LEFT JOIN builtin_concept b ON b.code = e.code
LEFT JOIN (SELECT DISTINCT code, 'Code ' || code AS name, CAST(NULL AS VARCHAR) AS phrase FROM ev WHERE code LIKE 'MED%') o ON o.code = e.code""",
)
def concept_override(v: Views):
    """An override table (here: made of the medication codes on record) laid over the built-in map."""
    codes = v.ev.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    override = codes.filter(F.col("code").startswith("MED")).select(
        "code",
        F.concat(F.lit("Code "), "code").alias("name"),
        F.lit(None).cast("string").alias("phrase"),
        F.lit(None).cast("boolean").alias("higher_is_concerning"),
    )
    dim = override_concepts(builtin_concepts(v.spark), override)
    return codes.join(dim, "code").select("code", "name", "phrase", "higher_is_concerning", "n")


@query(
    "concept_resolve",
    """
SELECT f.feature, coalesce(h.name, b.name, n.name, f.code) AS concept,
       coalesce(h.phrase, b.phrase, n.phrase, 'a clinical factor recorded as ''' || f.code || '''') AS phrase,
       coalesce(h.higher_is_concerning, b.higher_is_concerning, n.higher_is_concerning, true) AS higher_is_concerning
FROM (SELECT DISTINCT 'count__' || code AS feature, code FROM ev UNION SELECT DISTINCT 'value__' || event_type, event_type FROM events
      UNION SELECT DISTINCT CASE WHEN turn = 0 THEN 'age' ELSE 'n_events' END, CASE WHEN turn = 0 THEN 'age' ELSE 'n_events' END FROM conversations) f
LEFT JOIN hospital_concept h ON h.code = f.code LEFT JOIN builtin_concept b ON b.code = f.code LEFT JOIN builtin_concept n ON n.code = f.feature""",
)
def concept_resolve(v: Views):
    """Known codes, unknown codes and bare feature names."""
    known = v.ev.select(F.concat(F.lit("count__"), "code").alias("feature"))
    unknown = v.base("events").select(F.concat(F.lit("value__"), "event_type").alias("feature"))
    bare = v.base("conversations").select(F.when(F.col("turn") == 0, "age").otherwise("n_events").alias("feature"))
    features = known.union(unknown).union(bare).distinct()
    return resolve_concepts(features, concept_dim(v.spark))


@query(
    "raw_payload",
    """
SELECT l.patient_id, l.age, l.sex,
  coalesce((SELECT string_agg(c.name || '=' || CAST(CAST(round_even(e.value, 2) * 100 AS BIGINT) AS VARCHAR), '|' ORDER BY c.name) FROM all_events e
    JOIN hospital_concept c ON c.code = e.code WHERE e.obs_window = 'discharge' AND e.patient_id = l.patient_id AND e.code LIKE 'VITAL/%'), '') AS vitals,
  coalesce((SELECT string_agg(c.name || '=' || CAST(CAST(round_even(e.value, 2) * 100 AS BIGINT) AS VARCHAR), '|' ORDER BY c.name) FROM all_events e
    JOIN hospital_concept c ON c.code = e.code WHERE e.obs_window = 'discharge' AND e.patient_id = l.patient_id AND e.code LIKE 'LAB/%'), '') AS labs,
  coalesce((SELECT string_agg(c.name, '|' ORDER BY c.name) FROM all_events e
    JOIN hospital_concept c ON c.code = e.code WHERE e.obs_window = 'discharge' AND e.patient_id = l.patient_id AND e.code LIKE 'DX/%'), '') AS history,
  (SELECT max(e.value) FROM all_events e WHERE e.obs_window = 'discharge' AND e.patient_id = l.patient_id AND e.code LIKE 'UTIL/%') AS admissions
FROM all_labels l WHERE l.task = 'mortality_1y'""".replace("CAST(round_even(e.value, 2) * 100 AS BIGINT)", "CAST(round(round_even(e.value, 2) * 100) AS BIGINT)"),
)
def raw_payload(v: Views):
    """Readable values of the discharge window, flattened for the check."""
    from wardline.plans.panel import window_matrices

    parts = stored(v)
    tasks = [t for t in ALL_TASKS if t.name == "mortality_1y"]
    matrices, vocabularies = window_matrices(parts["events"], parts["labels"], tasks=tasks, fit_on="all")
    named = parts["labels"].filter(F.col("task") == "mortality_1y")
    payload = mx.raw_payload(matrices[None], vocabularies[None].feature_names, hospital_concepts(v.spark), named)
    cents = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string"))
    flat = lambda name: F.array_join(F.transform(F.array_sort(F.map_entries(name)), cents), "|")
    return payload.select(
        "patient_id",
        "demographics.age",
        "demographics.sex",
        flat("vital_signs").alias("vitals"),
        flat("lab_results").alias("labs"),
        F.array_join("past_conditions", "|").alias("history"),
        F.col("prior_admissions").alias("admissions"),
    )
