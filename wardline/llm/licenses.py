"""License scans: ordered signature rules behind a prefilter on a literal of each, overlaps resolved by priority and containment."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.license_rules import Rule, rules
from wardline.llm.text import pieces, plain_words, table

#: Phrases that are always counted, and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


class Scanner:
    """All rules, and for each word or part of a text the rules that it lets through."""

    def __init__(self, chosen: list[Rule] | None = None):
        self.rules = rules() if chosen is None else chosen
        self.gates: dict[bytes, list[Rule]] = {}
        self.parts: dict[bytes, list[Rule]] = {}
        for rule in self.rules:
            (self.gates if rule.whole else self.parts).setdefault(rule.gate, []).append(rule)

    def detect(self, words: list[bytes], distinct: set[bytes]) -> list[tuple[str, int, int, int]]:
        """(label, rule, first word, end) of the places that stay, by place.

        Rules are tried in order of priority. A detection that lies within a kept one is suppressed.
        """
        line = b" ".join(words)
        padded = b" " + line + b" "
        let = {rule.priority: rule for word in self.gates.keys() & distinct for rule in self.gates[word]}
        let |= {rule.priority: rule for part, own in self.parts.items() if part in padded for rule in own}
        if not let:
            return []
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        kept: list[tuple[str, int, int, int]] = []
        covers: list[tuple[int, int]] = []  # kept places that no other one holds: their starts and their ends rise
        for priority in sorted(let):
            rule = let[priority]
            for found in rule.pattern.finditer(line):
                first = int(np.searchsorted(starts, found.start(), "right")) - 1
                end = int(np.searchsorted(starts, found.end(), "left"))
                at = bisect_right(covers, (first, len(line)))
                if at and end <= covers[at - 1][1]:
                    continue
                kept.append((rule.label, priority, first, end))
                low, high = bisect_left(covers, (first, 0)), at
                while high < len(covers) and covers[high][1] <= end:
                    high += 1
                covers[low:high] = [(first, end)]
        return sorted(kept, key=lambda x: (x[2], x[3], x[1]))


def base_places(words: list[bytes], distinct: set[bytes]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in BASE:
        parts = phrase.split()
        if all(p in distinct for p in parts):
            at = -1
            while True:
                try:
                    at = words.index(parts[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(parts)] == parts:
                    out.append((at, label))
    return sorted(out)


_FOUND = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("rule", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
])
_ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("base", T.ArrayType(T.StringType())), T.StructField("detections", T.ArrayType(_FOUND)),
]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, places (word indexes where a base phrase stands), base (their labels, sorted, distinct) and
    detections (label, rule, word range [s, e)) of the whole text.

    Null and empty texts have no words and nothing found; repeated rows are scanned each; columns of those names are
    replaced, others pass unchanged.
    """
    rows = docs.drop(*[f.name for f in _ADDED if f.name != text])
    place = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, *_ADDED])

    def run(batches):
        scanner = Scanner()
        kinds = [
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()),
            pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])),
        ]
        for batch in pieces(batches):
            columns: tuple[list, ...] = ([], [], [], [])
            for value in batch.column(place).to_pylist():
                words = plain_words(value)
                distinct = set(words)
                base = base_places(words, distinct)
                found = [dict(zip(("label", "rule", "s", "e"), x, strict=True)) for x in scanner.detect(words, distinct)]
                for column, one in zip(columns, (len(words), [p for p, _ in base], sorted({x for _, x in base}), found), strict=True):
                    column.append(one)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def op9_licenses(spark, sf_dir) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    specific = "size(filter(detections, x -> x.label not in ('unspecific', 'copyright-notice', 'proprietary', 'commercial')))"
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.expr("concat_ws(',', array_sort(array_distinct(concat(base, transform(detections, x -> x.label)))))").alias("labels"),
        F.expr(f"1D - pow(0.1D, {specific}) * pow(0.6D, size(detections) - {specific})").alias("score"),
    )
