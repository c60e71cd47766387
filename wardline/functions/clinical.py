"""Scalar rules of the clinical timeline as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.operators.concepts import ICD_GROUPS

# Upper bounds of the risk tiers, of the confidence labels, of the reliability tiers.
RISK_TIERS = (("low", 0.10), ("moderate", 0.30), ("elevated", 1.01))
CONFIDENCE_LABELS = (("higher", 0.34), ("moderate", 0.67), ("lower", None))
RELIABILITY_CUTS = {"regression": (0.4, 0.2), "binary": (0.75, 0.65)}


def icd_normalize(code: Column) -> Column:
    """Dots out, blanks off both ends, upper case."""
    return F.upper(F.trim(F.replace(code, F.lit("."), F.lit("")), F.lit(" \t\r\n")))


def icd_version_number(version: Column) -> Column:
    """Anything that is no whole number counts as version 0, which has no groups."""
    return F.coalesce(version.try_cast("int"), F.lit(0))


def _starts_with(norm: Column, prefixes) -> Column:
    """One look-up per prefix length instead of one test per prefix."""
    out = F.lit(False)
    for size in sorted({len(p) for p in prefixes}):
        out = out | F.substring(norm, 1, size).isin([p for p in prefixes if len(p) == size])
    return out


def icd_group_slots(norm: Column, number: Column, groups=ICD_GROUPS) -> Column:
    """One array slot per group: its code if the normalised diagnosis code of that version belongs to
    it, else null. Free of lambdas, so that it stays in generated code.

    The code book is a fixed, short list, so the test is one expression per row: no join, no shuffle,
    and a code that fills a third of the table cannot skew anything.
    """
    head = F.substring(norm, 1, 3)
    ninth, tenth = [], []
    for group in groups:
        hit = _starts_with(norm, group.icd9_prefixes)
        if group.icd9_range:
            low, high = group.icd9_range
            # three digits compare as text just as they do as numbers
            hit = hit | (head.between(f"{low:03d}", f"{high:03d}") & head.rlike("^[0-9]{3}$"))
        ninth.append(F.when(hit, F.lit(group.code)))
        tenth.append(F.when(_starts_with(norm, group.icd10_prefixes), F.lit(group.code)))
    none = F.array().cast("array<string>")
    return F.when(number == 9, F.array(*ninth)).when(number == 10, F.array(*tenth)).otherwise(none)


def los_days(admit: Column, discharge: Column) -> Column:
    """Hour boundaries crossed between admission and discharge, in days.

    Calendar arithmetic on the wall clock: no session time zone takes part.
    """
    hours = F.datediff(discharge, admit) * 24 + F.hour(discharge) - F.hour(admit)
    return hours.cast("double") / F.lit(24.0)


def age_at(time: Column, anchor_year: Column, anchor_age: Column) -> Column:
    return F.year(time) - anchor_year + anchor_age


def sex_word(gender: Column) -> Column:
    return F.when(gender == "F", "female").when(gender == "M", "male").otherwise("unknown")


def sex_female(sex: Column) -> Column:
    return F.coalesce((sex == "female").cast("double"), F.lit(0.0))


def window_cutoff(admit: Column, discharge: Column, hours: int | None) -> Column:
    """End of the observation window: discharge, or `hours` after admission if that is earlier."""
    if hours is None:
        return discharge
    return F.least(admit + F.expr(f"INTERVAL {int(hours)} HOURS"), discharge)


def fahrenheit_to_celsius(value: Column, is_fahrenheit: Column) -> Column:
    return F.when(is_fahrenheit == 1, (value - 32.0) / 1.8).otherwise(value)


def died_within(dod: Column, discharge: Column, days: int) -> Column:
    """1 if death is recorded no more than `days` whole days after discharge (no lower bound)."""
    limit = discharge + F.expr(f"INTERVAL {int(days) + 1} DAYS")
    return F.coalesce((dod.cast("timestamp_ntz") < limit).cast("int"), F.lit(0))


def strip_prefix(feature: Column) -> Column:
    """Feature column name to event code: one `count__` or `value__` off the front."""
    return F.regexp_replace(feature, "^(count__|value__)", "")


def code_family(code: Column) -> Column:
    return F.split_part(code, F.lit("/"), F.lit(1))


def clean_double(value: Column) -> Column:
    """NaN to NULL, so that 'not measured' has one spelling."""
    return F.when(~F.isnan(value), value)


def null_to_zero(value: Column) -> Column:
    return F.coalesce(clean_double(value), F.lit(0.0))


def label_value(value: Column, kind: str = "binary") -> Column:
    value = clean_double(value.try_cast("double"))
    return value.cast("int") if kind == "binary" else value


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.round(F.ln(p / (F.lit(1.0) - p)), 4))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def probability_pct(p: Column) -> Column:
    return F.bround(p * 100.0, 0).cast("int")


def risk_tier(p: Column, tiers=RISK_TIERS) -> Column:
    """First tier whose bound lies above p; the last one if none does."""
    out = F.lit(tiers[-1][0])
    for name, bound in reversed(tiers):
        out = F.when(p < bound, F.lit(name)).otherwise(out)
    return F.when(p.isNotNull(), out)


def confidence_label(uncertainty: Column) -> Column:
    (top, a), (middle, b), (rest, _) = CONFIDENCE_LABELS
    return F.when(uncertainty < a, top).when(uncertainty < b, middle).otherwise(rest)


def reliability_tier(kind: Column, auroc: Column, r2: Column) -> Column:
    score = F.when(kind == "regression", r2).otherwise(auroc)
    high = F.when(kind == "regression", RELIABILITY_CUTS["regression"][0]).otherwise(RELIABILITY_CUTS["binary"][0])
    mid = F.when(kind == "regression", RELIABILITY_CUTS["regression"][1]).otherwise(RELIABILITY_CUTS["binary"][1])
    return (
        F.when(score.isNull(), "unknown").when(score >= high, "reliable").when(score >= mid, "moderate").otherwise("weak")
    )
