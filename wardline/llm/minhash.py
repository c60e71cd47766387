"""MinHash near-dedup by min-max hashing.

Each of 64 permutations of the shingle hashes gives its smallest and its largest value, so 128 signature values cost 64
hash evaluations. 25 bands of five values propose groups; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.graph import components
from wardline.llm.text import column, mixed, pieces, shingles, signed, table
from wardline.session import materialize

PERMUTATIONS, BANDS, BAND_ROWS = 64, 25, 5
_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64)
_STEP, BLOCK = 4096, 512


def min_max(items: np.ndarray) -> np.ndarray:
    """The 64 minima, then the 64 maxima, of a non-empty set of hashes."""
    low = np.full(PERMUTATIONS, np.uint64(2**64 - 1))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(items), _STEP):
        values = items[at : at + _STEP, None] * _ODD + _ADD
        low = np.minimum(low, values.min(axis=0))
        high = np.maximum(high, values.max(axis=0))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band of five values; the values of a band come from five permutations."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in signature[: BANDS * BAND_ROWS].reshape(BAND_ROWS, BANDS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


SIGNATURES = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary"


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, hash of the text, size of the shingle set, `node` (hash of the set; null when it is empty), the
    band keys, and one byte of each signature value. Null and blank texts have no node and no bands."""

    def run(batches):
        for batch in pieces(batches):
            sizes, nodes, bands, sketches = [], [], [], []
            for value in column(batch, "text"):
                found = shingles(value)
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None), bands.append(None), sketches.append(None)
                    continue
                full = min_max(found)
                nodes.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())))))
                bands.append(signed(band_keys(full)))
                sketches.append((full >> np.uint64(32)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"],
            )

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    return rows.mapInArrow(run, SIGNATURES)


def _links(percent: int, slack: float):
    """Confirms links inside a unit: nodes of one block, or of two blocks of a cluster, with texts and sketches.

    Only links that join two parts not yet joined here are looked for, likeliest first: the rest add nothing to the
    components. At most one link per node comes out.
    """

    def united(part: pd.DataFrame) -> list[tuple[int, int]]:
        nodes, sides = part["node"].tolist(), part["side"].to_numpy()
        sketch = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(nodes), -1)
        sizes = part["n_shingles"].to_numpy()
        pairs = []
        for x in range(len(nodes) - 1):
            alike = (sketch[x + 1 :] == sketch[x]).mean(axis=1)
            fit = 100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x])
            fit &= alike >= percent / 100 - slack
            if sides.any():
                fit &= sides[x + 1 :] != sides[x]  # two blocks: pairs inside either are another unit's
            pairs += [(-alike[y], x, x + 1 + y) for y in np.flatnonzero(fit).tolist()]
        above, sets, out = list(range(len(nodes))), {}, []

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        texts = part["text"].tolist()
        for _, x, y in sorted(pairs):
            one, two = root(x), root(y)
            if one == two:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingles(texts[k])
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                above[one] = two
                out.append((nodes[x], nodes[y]))
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [link for _, part in rows.groupby("cluster") for link in united(part)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _linkable(bands: DataFrame) -> DataFrame:
    """Rows of (node, band) in bands that two nodes share."""
    shared = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return bands.join(shared.select("band", "low"), "band")


def _texts_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text) for one row of each wanted node."""
    chosen = rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("one"))
    wanted = chosen.select("node", F.col("one.text_hash").alias("text_hash"), F.col("one.doc_id").alias("wanted"))
    return (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("text_hash", F.xxhash64("text")).join(wanted, "text_hash").where("doc_id <=> wanted")
        .dropDuplicates(["node"]).select("node", "text")
    )


def _own_shingles(texts: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles no other of these texts has."""

    def run(batches):
        for batch in pieces(batches):
            found = [shingles(t) for t in column(batch, "text")]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(signed(np.concatenate([np.empty(0, np.uint64), *found])))], names=["node", "shingle"]
            )

    rows = texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, slack: float = 0.17
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_shingles, component_id, kept.

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of five-word shingles (with fewer
    words the whole sequence is the one shingle). component_id is the smallest id reachable over links; kept says
    whether the row has that id. Rows with equal sets are one node from the start, so exact copies in any number cost
    one row each.

    Candidates share a band; a pair at 85 % is missed with probability 4e-7. A node of whose shingles more than 15 %
    occur in no other candidate can have no link and leaves, which takes out those that share but a line or a
    passage. What still hangs together over bands is a cluster; clusters are cut into blocks of 512 nodes and every pair
    of blocks is one unit of work. Inside a unit pairs whose sketches agree by the threshold less `slack` (five standard
    deviations) are confirmed on the full sets.

    Null, empty and blank texts link with nothing; a null id is never a component's name (a component of null ids only
    keeps a null name and is kept); rows that repeat an id are one document if their texts are equal, else texts of
    their own under one id; no rows give no rows. Only the id and text columns are read.
    """
    rows = materialize(signatures(docs, doc_id, text), "signatures")
    nodes = materialize(
        rows.where("node is not null").groupBy("node")
        .agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")),
        "nodes",
    )
    groups = materialize(_linkable(nodes.select("node", F.explode("bands").alias("band"))), "groups")
    texts = materialize(_texts_of(docs, rows, groups.select("node").distinct(), doc_id, text), "texts")
    open_nodes = materialize(
        texts.select("node").join(nodes.select("node", "n_shingles", "sketch"), "node")
        .join(_own_shingles(texts), "node", "left")
        .where(F.expr(f"100 * (n_shingles - coalesce(own, 0)) >= {percent} * n_shingles")).drop("own"),
        "open",
    )
    again = _linkable(groups.drop("low").join(open_nodes.select("node"), "node", "left_semi"))
    clusters = components(again.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    sizes = clusters.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    units = max(8, clusters.count() // BLOCK + 1)
    placed = (
        clusters.join(sizes, "comp").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
        .select("node", F.col("comp").alias("cluster"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks")
        .select(
            "node", "cluster", F.expr("int(block > other)").alias("side"),
            F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(cluster), {units}L)"))
            .otherwise(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))).alias("unit"),
        )
    )
    links = materialize(
        placed.join(open_nodes, "node").join(texts, "node").groupBy("unit").applyInPandas(_links(percent, slack), "a bigint, b bigint"),
        "links",
    )
    found = components(links)
    named = (
        rows.select("doc_id", "node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        .where("comp is not null").groupBy("comp", "node").agg(F.min("doc_id").alias("least"))
    )
    names = named.groupBy("comp").agg(F.min("least").alias("name"))
    by_node = named.join(names, "comp").select("node", F.col("name").alias("component_id"))
    return (
        rows.select("doc_id", "text_hash", "n_shingles", "node").join(by_node, "node", "left")
        .select(
            "doc_id", "text_hash", "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """`docs` without all but one document of each near-duplicate group; columns as they are.

    Rows that repeat both id and text are one document: one of them stays.
    """
    kept = near_duplicates(docs, doc_id, text, percent, slack=0.19).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct()
    names = docs.columns
    return (
        docs.withColumns({"__id": F.col(doc_id).cast("bigint"), "__hash": F.xxhash64(text)})
        .join(
            kept.withColumnsRenamed({"__id": "__kept_id", "__hash": "__kept_hash"}),
            F.expr("__id <=> __kept_id and __hash = __kept_hash"), "left_semi",
        )
        .dropDuplicates(["__id", "__hash"]).select(*[F.col(f"`{n}`") for n in names])
    )


def op6_minhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
