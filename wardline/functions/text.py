"""Checks on generated text as Column expressions.

A response has five sections in fixed order; `sections` is always the list of their columns in that
order. Every expression stays inside the row: no shuffle, no Python.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the five sections, in order.
SECTIONS = (
    "What we found",
    "What may be contributing",
    "What this means",
    "What to do next",
    "When to seek care urgently",
)

# Phrases no text may contain; the trailing blanks count.
BANNED_PHRASES = (
    "you have ",
    "you will ",
    "you are going to ",
    "diagnosed with",
    "you definitely",
    "is certain",
    "guaranteed",
    "i diagnose",
    "you must take",
    "stop taking",
    "no need to see",
)

# The closing note of every record.
DISCLAIMER = (
    "This summary is generated by a computer model to help you understand your "
    "health information. It is not a diagnosis and not a substitute for advice "
    "from a qualified clinician. Always talk to your healthcare provider about "
    "your results and any decisions."
)

#: Every blank of Unicode, and the four separators below the space: what splits words and does not count as text.
BLANK = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
_BLANKS = r"[\t-\r\x1C-\x20\x85\p{Z}]"
#: Decimal digits of all scripts: in each block ten in order, from zero on.
_ZEROS = [c for c in range(0x110000) if unicodedata.decimal(chr(c), None) == 0]
_DIGIT = "[" + "".join(f"\\x{{{c:X}}}-\\x{{{c + 9:X}}}" for c in _ZEROS) + "]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    return F.trim(text_or_empty(c), F.lit(BLANK))


def joined(sections: list[Column]) -> Column:
    return F.concat_ws(" ", *[text_or_empty(s) for s in sections])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def kept(*items: Column) -> Column:
    """Array of the items that are not null."""
    return F.array_compact(F.array(*items))


def missing_sections(sections: list[Column], names=SECTIONS) -> Column:
    return kept(*[F.when(stripped(s) == "", F.lit(name)) for s, name in zip(sections, names)])


def banned_hits(blob: Column, phrases=BANNED_PHRASES) -> Column:
    """Phrases contained in the lower-cased text, given without their blanks."""
    low = F.lower(blob)
    return kept(*[F.when(F.contains(low, F.lit(p)), F.lit(p.strip())) for p in phrases])


def admits_doubt(blob: Column, words=("caution", "less certain")) -> Column:
    low = F.lower(blob)
    return any_of(F.contains(low, F.lit(w)) for w in words)


def percentages(text: Column) -> Column:
    """Distinct numbers of one to three digits, of any script, before a percent sign."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(f"({_DIGIT}{{1,3}}){_BLANKS}*%"), 1)
    others = "".join(chr(c + i) for c in _ZEROS for i in range(10) if c > 0x30)
    plain = lambda x: F.translate(x, others, "0123456789" * (len(others) // 10))
    return F.array_distinct(F.transform(found, lambda x: plain(x).cast("int")))


def words_of(phrase: Column) -> Column:
    """Lower-case words with commas, periods and brackets off both ends."""
    parts = F.filter(F.split(text_or_empty(phrase), f"{_BLANKS}+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.trim(F.lower(w), F.lit(",.()")))


def grounded(section: Column, phrases: Column) -> Column:
    """True if a word of more than three letters from any phrase occurs in the section, or if there
    are no phrases to name."""
    low = F.lower(text_or_empty(section))
    words = F.filter(F.flatten(F.transform(phrases, words_of)), lambda w: F.length(w) > 3)
    hit = F.exists(words, lambda w: F.contains(low, w))
    return F.when(F.coalesce(F.size(phrases), F.lit(0)) <= 0, F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def clarity_score(sections: list[Column]) -> Column:
    """Mean of a sentence-length score (best at 15 words) and the share of sections filled."""
    sentences = F.filter(F.split(joined(sections), r"[.!?\n]"), lambda s: F.trim(s, F.lit(BLANK)) != "")
    n_words = F.aggregate(
        F.transform(sentences, lambda s: F.size(F.filter(F.split(s, f"{_BLANKS}+"), lambda w: w != ""))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    length = F.greatest(F.lit(0.0), 1.0 - F.abs(n_words / F.size(sentences) - 15.0) / 25.0)
    filled = reduce(lambda a, b: a + b, [(stripped(s) != "").cast("int") for s in sections]) / F.lit(float(len(sections)))
    return F.when(F.size(sentences) == 0, F.lit(0.0)).otherwise(F.bround(0.5 * length + 0.5 * filled, 3))
