"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept per group.

A cell's vectors meet those of another cell only where the cells' boundary allows a cosine at the threshold; the test is
exact, so no link is lost. Cells are cut into blocks of bounded size and each pair of blocks is one unit of work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.graph import components
from wardline.llm.text import table
from wardline.session import materialize

#: Vectors that k-means is fitted on at most, cells at most, and vectors of a cell that form one block.
SAMPLE, CELLS, BLOCK = 20_000, 256, 4096


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither squares overflow nor underflow to zero
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_means(units: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by Lloyd's rounds with cosine; an empty cell takes the vector worst served. Deterministic."""
    centres = units[np.random.Generator(np.random.PCG64(1)).permutation(len(units))[:cells]].copy()
    for _ in range(rounds):
        near = units @ centres.T
        own = near.argmax(axis=1)
        served = near[np.arange(len(units)), own]
        for c in range(len(centres)):
            mean = units[own == c].sum(axis=0)
            norm = np.sqrt(mean @ mean)
            if norm > 1e-12:
                centres[c] = mean / norm
            else:
                worst = served.argmin()
                centres[c], served[worst] = units[worst], 2.0
    return centres


def _nodes(batches):
    """(vec_id, node, width): node is a hash of the components; null for vectors that link with nothing."""
    for batch in batches:
        nodes, widths = [], []
        for value in batch.column(1):
            part = value.values if value.is_valid else None
            good = part is not None and len(part) and not part.null_count
            if good:
                numbers = part.to_numpy().astype(np.float64) + 0.0
                good = np.isfinite(numbers).all() and numbers.any()
            nodes.append(xxhash.xxh3_64_intdigest(numbers.tobytes()) - 2**63 if good else None)
            widths.append(len(part) if good else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(widths, pa.int32())],
            names=["vec_id", "embedding", "node", "width"],
        )


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _placing(centres: dict[int, np.ndarray], reach: float):
    """Adds the cell, and the other cells that hold vectors within `reach` (a chord) at most."""

    def run(batches):
        for batch in batches:
            widths = batch.column(batch.schema.get_field_index("width")).to_numpy()
            cells, others = np.zeros(len(widths), np.int32), [None] * len(widths)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                near = unit_vectors(_matrix(batch.column(1).take(pa.array(at)).to_pylist())) @ centres[width].T
                own = near.argmax(axis=1)
                # x and y are on different sides of the plane between two centres: |x - y| is at least x's distance to it
                gap = np.sqrt(np.maximum(2 - 2 * centres[width] @ centres[width].T, 0))[own]
                met = near[np.arange(len(at)), own][:, None] - near <= reach * gap + 1e-9
                met[np.arange(len(at)), own] = False
                for i, k in enumerate(at):
                    cells[k], others[k] = own[i], np.flatnonzero(met[i]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells), pa.array(others, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "others"]
            )

    return run


def _links(threshold: float):
    """Per vector of a unit: the rows it links with, and the first vector of its group in the unit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        units, nodes, times = unit_vectors(_matrix(rows["embedding"])), rows["node"].to_numpy(), rows["times"].to_numpy()
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if side.any() else one
        counts, label, pairs = np.zeros(len(rows), np.int64), np.arange(len(rows)), []
        for at in range(0, len(one), 512):
            part = one[at : at + 512]
            linked = units[part] @ units[two].T >= threshold
            if two is one:
                linked[np.arange(len(part)), at + np.arange(len(part))] = False
            counts[part] += linked @ times[two]
            if two is not one:
                counts[two] += times[part] @ linked
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                pairs.append((part[some], np.packbits(linked[some], axis=1)))
        changed = bool(pairs)
        while changed:
            before = label.copy()
            for part, packed in pairs:
                linked = np.unpackbits(packed, axis=1, count=len(two)).astype(bool)
                least = np.minimum(label[part], np.where(linked, label[two], len(rows)).min(axis=1))
                label[part] = least
                label[two] = np.minimum(label[two], np.where(linked, least[:, None], len(rows)).min(axis=0))
            changed = not np.array_equal(before, label)
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"a": nodes[hit], "b": nodes[label[hit]], "links": counts[hit]})

    return run


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9,
    sample: int = SAMPLE, cells: int = CELLS, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors`.

    Linked are vectors of equal length whose cosine, in double precision, is at least `threshold`. The centres are fitted
    on the `sample` vectors whose hashes are lowest; every vector is assigned, and every pair that can reach the
    threshold is multiplied out. Equal vectors are one node with a count, so copies in any number cost one row each.
    A cell may hold any share of the rows: it is cut into blocks by hash.

    Null, empty and zero vectors and those with null or non-finite components have no links and are their own component;
    null ids are never a component's name; repeated rows are vectors of their own; no rows give no rows.
    """
    rows = materialize(
        vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
        .mapInArrow(_nodes, f"vec_id bigint, embedding {dict(vectors.dtypes)[embedding]}, node bigint, width int"),
        "vectors",
    )
    nodes = materialize(
        rows.where("node is not null").groupBy("node").agg(
            F.first("embedding").alias("embedding"), F.first("width").alias("width"), F.count("*").alias("times")
        ),
        "nodes",
    )
    sizes = {r["width"]: r["n"] for r in nodes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    taken: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("width", "embedding").collect():
        taken.setdefault(r["width"], []).append(r["embedding"])
    centres = {}
    for width, n in sizes.items():
        units = unit_vectors(np.array(taken.get(width, [[1.0] * width]), np.float64))
        centres[width] = spherical_means(units, min(cells, -(-n // block), len(units)))
    placed = materialize(
        nodes.select("node", "embedding", "width", "times").mapInArrow(
            _placing(centres, float(np.sqrt(max(0.0, 2 - 2 * threshold)))),
            f"node bigint, embedding {dict(nodes.dtypes)['embedding']}, width int, times bigint, cell int, others array<int>",
        ),
        "placed",
    )
    blocks = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    all_blocks = blocks.select("width", F.col("cell").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))
    dealt = (
        placed.join(blocks, ["width", "cell"])
        .withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
        .withColumn("other", F.explode(F.concat(F.array("cell"), "others")))
        .join(all_blocks, ["width", "other"])
        .withColumns({"mine": F.struct("cell", "block"), "theirs": F.struct(F.col("other").alias("cell"), F.col("other_block").alias("block"))})
        .select("node", "embedding", "times", F.expr("int(mine > theirs)").alias("side"),
                F.xxhash64("width", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("unit"))
    )
    links = materialize(dealt.groupBy("unit").applyInPandas(_links(threshold), "a bigint, b bigint, links bigint"), "links")
    found = components(links.select("a", "b"))
    known = (
        nodes.select("node", "times").join(links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
        .join(found, "node", "left")
        .select("node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    )
    ids = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"))
    names = known.join(ids, "node").groupBy("comp").agg(F.min("least").alias("name"))
    joined = rows.select("vec_id", "node").join(known.join(names, "comp").select("node", "n_links", "name"), "node", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("name")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM embeddings v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""
