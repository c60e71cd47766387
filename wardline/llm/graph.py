"""Linked groups at scale: connected components and the checking of candidate pairs next to their texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import materialize

#: Candidate pairs that a task checks at once, with the texts they need.
PAIRS_OF_BUCKET = 500


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b: long); comp is the smallest node reachable.

    Alternating large and small stars: each round re-hangs every neighbour below the smallest one, so the number of
    edges never grows and the number of rounds is about the logarithm of the longest chain. Nothing is collected but
    one count and one check sum per round; each round is written to the shared folder, which cuts the lineage.
    Loops and nulls are left out; an empty input gives an empty result.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while (now := _state(stars)) != before:
        before = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        stars = materialize(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def beside_texts(
    pairs: DataFrame, texts: DataFrame, check: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str,
    per_side: int = 128,
) -> DataFrame:
    """Runs `check(pairs, {node: text})` on buckets of candidate pairs that stand next to the texts they need.

    `pairs`: a, b, cluster (pairs of one cluster share texts) and whatever `check` reads; `texts`: node, text, one row
    per node. A cluster's pairs are cut by hash into blocks of about `per_side` nodes on either side and blocks are
    dealt to buckets, so a text is sent once per block that needs it, a bucket is bounded, and a cluster or hub with a
    third of all rows fills many buckets.
    """
    sizes = pairs.groupBy("cluster").agg(
        F.ceil(F.approx_count_distinct("a") / per_side).alias("na"),
        F.ceil(F.approx_count_distinct("b") / per_side).alias("nb"),
    )
    blocked = pairs.join(sizes, "cluster").withColumn(
        "block", F.xxhash64("cluster", F.expr("pmod(xxhash64(a), na)"), F.expr("pmod(xxhash64(b), nb)"))
    )
    buckets = max(8, pairs.count() // PAIRS_OF_BUCKET + 1)
    dealt = blocked.withColumn("bucket", F.expr(f"pmod(block, {buckets})")).drop("block", "na", "nb")
    need = dealt.select(F.col("bucket").alias("needed"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return check(left, dict(zip(right["node"], right["text"], strict=True)))

    return dealt.groupBy("bucket").cogroup(need.join(texts, "node").groupBy("needed")).applyInPandas(run, schema)
