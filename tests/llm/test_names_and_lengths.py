"""Columns named like the operators' own, texts that once took the square of their length, and a k-d tree by hand."""

import random
import re
import time

from wardline.llm import decontaminate, language, licenses, sharding
from wardline.llm.license_rules import rules
from wardline.llm.text import plain_words

CLASHING = ["key", "cut", "dimension", "low", "high", "step", "upper", "bin", "hash", "words", "items", "n"]


def clashing(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHING if c not in df.columns])


def test_shards_keep_columns_of_any_name(spark):
    df = clashing(spark, [(i, i % 7, 10) for i in range(500)], "x bigint, y int, size bigint")
    got = sharding.kd_shards(df, ["x", "y"], shards=8)
    assert got.columns == [*df.columns, "shard"]
    rows = got.collect()
    assert sorted(r["x"] for r in rows) == list(range(500)) and all(r["key"] == "key" and r["low"] == "low" for r in rows)
    assert {r["shard"] for r in rows} == set(range(8))


def by_hand(points, count, span):
    """Leaves of the k-d tree: split at the weighted median of the widest side, measured against all rows."""
    if count == 1:
        return [points]
    widest = max(range(len(span)), key=lambda i: ((max(p[i] for p in points) - min(p[i] for p in points)) / span[i], -i))
    ordered = sorted(points, key=lambda p: p[widest])
    half = len(points) * (count // 2) // count
    return by_hand(ordered[:half], count // 2, span) + by_hand(ordered[half:], count - count // 2, span)


def test_shards_are_the_boxes_of_a_tree_by_hand(spark):
    rng = random.Random(3)
    points = list({(rng.randrange(10_000), rng.randrange(300)) for _ in range(512)})[:480]
    points = [p for i, p in enumerate(points) if p[0] not in {q[0] for q in points[:i]}]
    points = points[: len(points) // 8 * 8]
    span = [max(p[i] for p in points) - min(p[i] for p in points) for i in range(2)]
    got = sharding.kd_shards(spark.createDataFrame([(*p, 1) for p in points], "x int, y int, size bigint"), ["x", "y"], shards=8).collect()
    want = by_hand(points, 8, span)
    for shard, leaf in enumerate(want):
        own = {(r["x"], r["y"]) for r in got if r["shard"] == shard}
        assert len(own ^ set(leaf)) <= 2 * len(leaf) // 10  # rows of one value are told apart by a hash
        box = [(min(p[i] for p in leaf), max(p[i] for p in leaf)) for i in range(2)]
        assert sum(all(lo <= v <= hi for v, (lo, hi) in zip(p, box, strict=True)) for p in own) >= 0.9 * len(own)


def test_joined_hits_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = clashing(spark, [(1, f"a b {text} c"), (2, "none of it"), (3, None)], "doc_id bigint, text string").drop("items")
    asked = spark.createDataFrame([("q", text)], "item_id string, text string")
    one, two = (decontaminate.benchmark_hits(docs, asked, broadcast_windows=n) for n in (100, 0))
    assert one.columns == two.columns and {"key", "hash", "words"} <= set(one.columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(one) == rows(two) and "n_hit=30" in rows(two)[0]


_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def test_hidden_markup_is_that_of_the_rule_and_takes_linear_time():
    rng = random.Random(7)
    parts = [b"<", b">", b"<!--", b"-->", b"<script", b"<SCRIPT ", b"</script >", b"</style>", b"<style", b"a", b" ", b"-", b"<scripts>", b"!"]
    for _ in range(20_000):
        raw = b"".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert language.visible(raw) == _HIDDEN.sub(b" ", raw), raw
    for raw in (b"<!-- x " * 200_000, b"<script x " * 100_000, b"<" * 1_000_000, b"</script   " * 100_000):
        start = time.perf_counter()
        language.visible(raw)
        assert time.perf_counter() - start < 2


def test_containment_is_that_of_all_pairs_and_takes_linear_time():
    scanner, rng = licenses.Scanner(), random.Random(9)
    texts = ["licensed under the mit license", "permission is hereby granted free of charge", "apache license version 2 0", "gnu general public license version 3 or later", "copyright 2020 some one", "all rights reserved", "mit", "word"]
    for _ in range(40):
        words = plain_words(" ".join(rng.choices(texts, k=30)))
        line, kept = b" ".join(words), []
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        for rule in rules():
            for found in rule.pattern.finditer(line):
                first = max(i for i, s in enumerate(starts) if s <= found.start())
                end = min(i for i, s in enumerate(starts) if s >= found.end())
                if not any(s <= first and end <= e for _, _, s, e in kept):
                    kept.append((rule.label, rule.priority, first, end))
        assert scanner.detect(words, set(words)) == sorted(kept, key=lambda x: (x[2], x[3], x[1]))
    words = plain_words("licensed under the mit license copyright 2020 x " * 12_000)
    start = time.perf_counter()
    assert len(scanner.detect(words, set(words))) >= 12_000 and time.perf_counter() - start < 20
