"""Guardrail warnings and quality flags over a table of generated responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx

SECTION_COLUMNS = ("s1", "s2", "s3", "s4", "s5")


def _columns(names) -> list:
    return [F.col(n) for n in names]


def guardrails(
    responses: DataFrame,
    *,
    sections=SECTION_COLUMNS,
    banned=tx.BANNED_PHRASES,
    template: bool = True,
    model_checks: bool = True,
    panel: bool = False,
    pct: str = "pct",
    confidence: str = "confidence_label",
) -> DataFrame:
    """Adds `warnings`, an array of texts; empty means clean. Warnings never drop a response.

    `template=False` takes the sections as one narrative; `model_checks=False` is the variant without
    a model behind the text; `panel=True` words the number check for a panel, where a null `pct` means
    that no forward risk exists and both model checks are skipped.
    """
    cols = _columns(sections)
    blob = tx.joined(cols)
    found = []
    if template:
        found += [
            F.when(tx.stripped(c) == "", F.lit(f"missing or empty section: '{name}'"))
            for c, name in zip(cols, tx.SECTIONS)
        ]
    else:
        found.append(F.when(tx.stripped(blob) == "", F.lit("empty summary")))
    low = F.lower(blob)
    found += [
        F.when(F.contains(low, F.lit(p)), F.lit(f"overclaiming/diagnostic phrase detected: '{p.strip()}'")) for p in banned
    ]
    if model_checks:
        where = tx.text_or_empty(cols[0]) if template else blob
        stated = F.contains(where, F.col(pct).cast("string"))
        message = "top forward-risk percentage not faithfully stated" if panel else "probability not faithfully stated"
        applies = F.col(pct).isNotNull() if panel else F.lit(True)
        found.append(F.when(applies & ~F.coalesce(stated, F.lit(False)), F.lit(message)))
        doubtful = (F.col(confidence) == "lower") & ~tx.admits_doubt(blob)
        found.append(F.when(applies & doubtful, F.lit("low confidence not reflected in summary")))
    return responses.withColumn("warnings", tx.kept(*found))


def summary_quality(
    responses: DataFrame,
    *,
    sections=SECTION_COLUMNS,
    banned=tx.BANNED_PHRASES,
    pct: str = "pct",
    confidence: str = "confidence_label",
    phrases: str | None = None,
) -> DataFrame:
    """Quality flags per response, the clarity score, `passed`, and the list of issues.

    `phrases` names an array column with the words a faithful text would name (concepts and plain
    phrases of the contributors); without it there is nothing to ground against.
    """
    cols = _columns(sections)
    blob = tx.joined(cols)
    stated = tx.percentages(blob)
    hits = tx.banned_hits(blob, banned)
    factual = F.coalesce(F.array_contains(stated, F.col(pct).cast("int")), F.lit(False))
    grounded = F.lit(True) if phrases is None else tx.grounded(cols[1], F.col(phrases))
    doubt_ok = (F.col(confidence) != "lower") | tx.admits_doubt(blob, ("caution", "less certain", "uncertain"))
    doubt_ok = F.coalesce(doubt_ok, F.lit(True))
    present = F.size(tx.missing_sections(cols)) == 0
    flagged = responses.select(
        "*",
        stated.alias("_stated"),
        hits.alias("_hits"),
        grounded.alias("_grounded"),
        factual.alias("factual_consistency"),
        doubt_ok.alias("uncertainty_faithful"),
        present.alias("all_sections_present"),
        tx.clarity_score(cols).alias("clarity_score"),
    ).withColumn("no_unsupported_claims", (F.size("_hits") == 0) & F.col("_grounded"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ", "), F.lit("]"))
    numbers = F.concat(
        F.lit("stated percentages "), listed("_stated"), F.lit(" do not include profile value "),
        F.col(pct).cast("string"), F.lit("%"),
    )
    issues = tx.kept(
        F.when(~F.col("factual_consistency"), numbers),
        F.when(F.size("_hits") > 0, F.concat(F.lit("banned/overclaiming phrases: "), listed("_hits"))),
        F.when(~F.col("_grounded"), F.lit("contributing factors not grounded in the risk profile")),
        F.when(~F.col("uncertainty_faithful"), F.lit("low model confidence not reflected in the summary")),
        F.when(~F.col("all_sections_present"), F.lit("one or more required sections missing/empty")),
    )
    passed = (
        F.col("factual_consistency") & F.col("no_unsupported_claims")
        & F.col("uncertainty_faithful") & F.col("all_sections_present")
    )
    return flagged.withColumns({"issues": issues, "passed": passed}).drop("_stated", "_hits", "_grounded")


QUALITY_FLAGS = ("factual_consistency", "no_unsupported_claims", "uncertainty_faithful", "all_sections_present", "passed")


def quality_rollup(quality: DataFrame) -> DataFrame:
    """Share of responses that pass each check, and mean clarity."""
    return quality.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(f).cast("double")).alias(f) for f in QUALITY_FLAGS],
        F.avg("clarity_score").alias("clarity_score"),
    )


def parse_sections(df: DataFrame, text_col: str, names=tx.SECTIONS) -> DataFrame:
    """JSON text to five trimmed section columns s1..s5; `parse_error` marks text that is no JSON object.

    A section the JSON lacks is empty. A batch marks bad rows, it does not stop at them.
    """
    # as the one element of a list: text after the object then is an error
    parsed = F.from_json(F.concat(F.lit("["), F.col(text_col), F.lit("]")), "array<map<string,string>>")
    out = df.withColumn("_list", parsed).withColumn("_m", F.when(F.size("_list") == 1, F.get("_list", F.lit(0))))
    bad = F.col("_m").isNull() | (tx.stripped(F.col(text_col)) == "")
    # of a key given twice the last value counts
    value = lambda n: F.get(F.reverse(F.filter(F.map_entries("_m"), lambda e: e["key"] == n)), F.lit(0))["value"]
    sections = {f"s{i + 1}": tx.stripped(value(n)) for i, n in enumerate(names)}
    return out.withColumn("parse_error", bad).withColumns(sections).drop("_m", "_list")
