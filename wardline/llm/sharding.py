"""Sharding by a k-d tree over metadata: DataFrame functions only.

Every node is split at the weighted median of its widest dimension until the leaves reach the target bytes. Medians of
all nodes of a level are found together from histograms of bytes, refined inside the bin where the median lies.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import table
from wardline.session import inline_table, materialize

#: Bins of a histogram, and the share of a leaf's bytes by which a cut may miss its target.
BINS, MISS = 1024, 0.0005
#: Rows of a shard that are numbered in one task, on average.
SLOT_ROWS = 20_000
_VALUE_BITS, _TIE_BITS = 28, 34


@dataclass
class _Search:
    """Where the cut of one node lies: in [low, high) of the keys of its dimension, with `wanted` bytes of that range
    still to go to the low side."""

    first: int
    leaves: int
    dimension: int
    wanted: float
    leaf: float
    low: int = 0
    high: int = 1 << (_VALUE_BITS + _TIE_BITS)

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // BINS)

    def narrow(self, bins: list) -> None:
        for r in bins:
            if r["w"] <= self.wanted:
                self.wanted -= r["w"]
                continue
            self.low, self.high = self.low + r["bin"] * self.step, min(self.high, self.low + (r["bin"] + 1) * self.step)
            if r["w"] <= self.leaf * MISS:
                self.high = self.low
            elif self.high - self.low == 1 and 2 * self.wanted > r["w"]:
                self.low = self.high  # the rows of one key stay together, on the nearer side
            return
        self.low = self.high


def _ordered(column: str, kind: str) -> Column:
    """A number in the order of the values; text by its first six bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(f"`{column}`").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(f"`{column}`").cast("double")


def _split(rows: DataFrame, leaves: dict[int, int], weight: str, dimensions: int) -> tuple[DataFrame, dict[int, int]]:
    """Splits every node of more than one leaf once: rows with their new `__node`, and the leaves below each node."""
    spark = rows.sparkSession
    open_ = [n for n, count in leaves.items() if count > 1]
    key = "element_at(__keys, __dimension + 1)"
    spread = [
        F.expr(f"max(shiftright(__keys[{i}], {_TIE_BITS})) - min(shiftright(__keys[{i}], {_TIE_BITS}))").alias(f"s{i}")
        for i in range(dimensions)
    ]
    measured = rows.where(F.col("__node").isin(open_)).groupBy("__node").agg(F.sum(weight).alias("w"), *spread).collect()
    searches = {}
    for r in measured:
        first, count = r["__node"], leaves[r["__node"]]
        widest = max(range(dimensions), key=lambda i: (r[f"s{i}"], -i))
        searches[first] = _Search(first, count, widest, r["w"] * (count // 2) / count, r["w"] / count)
    while wide := [s for s in searches.values() if s.high - s.low > 1]:
        ranges = inline_table(
            spark, [(s.first, s.dimension, s.low, s.high, s.step) for s in wide],
            "__node int,__dimension int,__low bigint,__high bigint,__step bigint",
        )
        bins = (
            rows.join(F.broadcast(ranges), "__node").where(f"{key} >= __low and {key} < __high")
            .groupBy("__node", F.expr(f"int(({key} - __low) div __step)").alias("bin")).agg(F.sum(weight).alias("w"))
            .orderBy("__node", "bin").collect()
        )
        for s in wide:
            s.narrow([r for r in bins if r["__node"] == s.first])
    cuts = inline_table(
        spark, [(s.first, s.dimension, s.low, s.first + s.leaves // 2) for s in searches.values()],
        "__node int,__dimension int,__cut bigint,__upper int",
    )
    moved = rows.join(F.broadcast(cuts), "__node", "left").withColumn(
        "__node", F.expr(f"if(__cut is null or {key} < __cut, __node, __upper)")
    ).drop("__dimension", "__cut", "__upper")
    below = {}
    for first, count in leaves.items():
        half = count // 2 if count > 1 else count
        below[first] = half
        if count > 1:
            below[first + half] = count - half
    return materialize(moved, "nodes"), below


def kd_shards(
    rows: DataFrame, dimensions: list[str], weight: str = "size", shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """`rows` with `shard`: leaves of a k-d tree, in order, of nearly equal sums of `weight`.

    Give the number of shards or the bytes a shard should reach. Each dimension is scaled to its range over all rows
    (text by its first six bytes, null lowest); rows with one value are told apart by a hash of the whole row and its
    place, so a value, id or text that holds a third of all rows is split like any other. Nodes are split in proportion
    to the leaves on each side, to within 0.05 % of a leaf. To the driver come at most 1,024 sums per open node.

    A column `shard` of `rows` is replaced; its own working columns start with two underscores.
    """
    return _placed(rows, dimensions, weight, shards, target_bytes).drop("__tie")


def _placed(rows: DataFrame, dimensions: list[str], weight: str, shards: int | None, target_bytes: int | None) -> DataFrame:
    """`kd_shards` with `__tie`, a hash of the whole row and its place."""
    kinds = dict(rows.dtypes)
    values = {f"__v{i}": _ordered(d, kinds[d]) for i, d in enumerate(dimensions)}
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.monotonically_increasing_id())
    numbered = rows.withColumns(values | {"__tie": tie.bitwiseAND(F.lit((1 << _TIE_BITS) - 1))})
    numbered = materialize(numbered, "numbered")
    ranges = numbered.agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"),
        *[f(v).alias(f"{n}{v}") for v in values for n, f in (("min", F.min), ("max", F.max))],
    ).first()
    count = shards or max(1, ceil((ranges["w"] or 0) / target_bytes))
    keys = []
    for v in values:
        low, high = ranges[f"min{v}"] or 0.0, ranges[f"max{v}"] or 0.0
        scaled = (F.col(v) - F.lit(low)) * F.lit(((1 << _VALUE_BITS) - 2) / (high - low)) + 1 if high > low else F.lit(1.0)
        keys.append(F.coalesce(F.floor(scaled), F.lit(0)).cast("long") * F.lit(1 << _TIE_BITS) + F.col("__tie"))
    placed = numbered.withColumns({"__keys": F.array(*keys), "__node": F.lit(0)})
    leaves = {0: count}
    while max(leaves.values()) > 1:
        placed, leaves = _split(placed, leaves, weight, len(keys))
    return placed.withColumn("shard", F.col("__node").cast("int")).drop("__keys", "__node", *values)


def with_slots(rows: DataFrame, count: int, order: str = "__tie") -> DataFrame:
    """`rows` with `slot`: places from 0 without gaps in each shard. Shards are numbered in ranges of the order's hash,
    so no task sorts a whole shard."""
    parts = max(1, count // SLOT_ROWS)
    dealt = rows.withColumn("__part", F.expr(f"pmod({order}, {parts}L)"))
    counts = dealt.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = counts.selectExpr(
        "shard", "__part", "sum(__n) over (partition by shard order by __part) - __n as __before"
    )
    return dealt.join(before, ["shard", "__part"]).selectExpr(
        *[f"`{c}`" for c in rows.columns],
        f"__before + row_number() over (partition by shard, __part order by {order}) - 1 as slot",
    )


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`.

    size is the text's UTF-8 bytes (null: none) plus 16. The law is `bytes`: the shards' sums of size are nearly
    equal, whatever the rows; equal texts may lie in several shards, as copies may be a third of all bytes. The
    dimensions are those of lang, source, n_chars and the id that the table has. Repeated rows are rows of their own;
    no rows give no rows; a null id is the lowest.
    """
    dimensions = [c for c in ("lang", "source", "n_chars") if c in docs.columns and c not in (doc_id, text)]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *dimensions,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = materialize(_placed(rows, [*dimensions, "doc_id"], "size", shards, None), "placed")
    return with_slots(placed, placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
