"""Benchmark decontamination: test n-grams in a hash set, training windows scanned against it, hits verified."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.text import column, gram_hashes, pieces, plain_words, signed, table, word_hashes
from wardline.session import materialize

WINDOW = 10
#: Windows that are sent to every executor at most (about 300 bytes each); more are joined instead.
BROADCAST_WINDOWS = 200_000


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """hash, n, words, items: each distinct window with the ids, as strings, of the items that hold it.

    An item of fewer words is one window; items without words have none; a null id counts as the empty string.
    """

    def run(batches):
        for batch in pieces(batches):
            hashes, sizes, texts, ids = [], [], [], []
            for one, value in zip(column(batch, "id"), column(batch, "text"), strict=True):
                words = plain_words(value)
                n = min(window, len(words))
                for i, h in enumerate(signed(gram_hashes(word_hashes(words), n)).tolist() if n else []):
                    hashes.append(h), sizes.append(n), texts.append(b" ".join(words[i : i + n])), ids.append(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(ids, pa.string())],
                names=["hash", "n", "words", "item"],
            )

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "hash bigint, n int, words binary, item string")
    return found.groupBy("hash", "n", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Windows:
    """Windows by length, each length's hashes sorted for a vectorised search."""

    def __init__(self, rows):
        self.by_length = {}
        for n in {r["n"] for r in rows}:
            own = sorted((r["hash"] % 2**64, r["words"], r["items"]) for r in rows if r["n"] == n)
            self.by_length[n] = (np.array([x[0] for x in own], np.uint64), own)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, the verified windows' word ranges, and the items they belong to, sorted."""
        words = plain_words(text)
        hashes = word_hashes(words)
        spans, items = [], set()
        for n, (known, own) in self.by_length.items():
            grams = gram_hashes(hashes, n)
            at = np.searchsorted(known, grams)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == grams).tolist():
                k, found = int(at[i]), b" ".join(words[i : i + n])
                while k < len(own) and own[k][0] == int(grams[i]):
                    if own[k][1] == found:
                        spans.append((i, i + n))
                        items.update(own[k][2])
                    k += 1
        return len(words), spans, sorted(items)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
_ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType())),
]


def _scanning(windows_of: Callable, names: list[str], place: int):
    def run(batches):
        for batch in pieces(batches):
            added = []
            for row, text in enumerate(batch.column(place).to_pylist()):
                n, spans, items = windows_of(batch, row).scan(text)
                spans = _joined(spans)
                added.append((n, sum(e - s for s, e in spans), [{"s": s, "e": e} for s, e in spans], items))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array([x[i] for x in added], kinds[i]) for i in range(4)],
                names=[*names, "n_words", "n_hit", "spans", "items"],
            )

    return run


def benchmark_hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, spans (word ranges hit) and items (ids found, sorted as strings).

    The benchmark's windows are counted first. Up to `broadcast_windows` go to every executor and documents are scanned
    where they are read; beyond, windows of documents are joined with windows of the benchmark by hash, and documents
    that share one are scanned with those alone. The result is the same.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows are scanned each;
    columns of `docs` named like the added ones are replaced; ids may be null.
    """
    rows = docs.drop(*[f.name for f in _ADDED if f.name != text])
    names, place = rows.columns, rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, *_ADDED])
    windows = materialize(benchmark_windows(items, item_id, item_text, window), "windows")
    if windows.select(F.size("items").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= broadcast_windows:
        sent = docs.sparkSession.sparkContext.broadcast(_Windows(windows.collect()))
        return rows.mapInArrow(_scanning(lambda batch, row: sent.value, names, place), schema)

    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())

    def hashes(batches):
        for batch in pieces(batches):
            out, keys = [], []
            for key, value in zip(column(batch, "key"), column(batch, "text"), strict=True):
                words = word_hashes(plain_words(value))
                grams = np.unique(np.concatenate([gram_hashes(words, n) for n in lengths]))
                out.append(signed(grams)), keys.append(np.full(len(grams), key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(out))], names=["key", "hash"])

    keyed = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    shared = (
        keyed.mapInArrow(hashes, "key bigint, hash bigint").distinct().join(windows, "hash")
        .groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("hash", "n", "words", "items")).alias("__windows"))
    )
    near = rows.withColumn("__key", F.xxhash64(text)).join(shared, "__key", "left")

    def own(batch, row):
        return _Windows(batch.column(len(names))[row].as_py() or [])

    return near.select(*[F.col(f"`{n}`") for n in names], "__windows").mapInArrow(_scanning(own, names, place), schema)


def without_benchmark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that hold a benchmark window; columns as they are."""
    return (
        benchmark_hits(docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col(text).alias("text")), items)
        .where("n_hit = 0").select("row.*")
    )


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM asked WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM wanted),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN wanted USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM cut LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
