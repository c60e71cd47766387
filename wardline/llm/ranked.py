"""Ranked lexical search without random access (NRA) over impact-sorted postings.

Documents are indexed in shards where they are read: a shard is one row that holds, per term, its documents and their
counts. A search reads the posting lists of an item's terms by falling impact, in blocks, and keeps for every document
of the shard an interval of its score: the sum of what was read, and that plus the best that the unread rest of each
other list can still add. It goes on until no document outside the k best can reach them or tie with them and the
scores of all that are left are final. The k-th score of the shards that a task has searched is the bound that the next
shard starts with; the k best per task are ranked at last.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardline.llm.text import column, pieces, plain_words, table
from wardline.session import materialize

#: Bytes of text in a shard, and (item, term) pairs in a slice of the items, about 100 bytes each, that goes to every task.
SHARD_BYTES, SLICE_PAIRS = 32 << 20, 500_000
_FIRST_READ = 256


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item. Rows of one item_id are one item; null texts have no terms."""

    def run(batches):
        for batch in pieces(batches):
            names, terms = [], []
            for i, value in enumerate(column(batch, "text")):
                own = sorted(set(plain_words(value)))
                names += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(names, pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "term"]
            )

    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["item_id"], T.StructField("term", T.BinaryType())])).distinct()


def index(docs: DataFrame, asked: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """Shards of documents, one row each: n_docs, n_terms (documents with terms, and all their terms), docs and lengths
    of those that are found below, and for each of `terms` its documents' places in `docs` and counts, up to `ends`.

    Given the terms that will be `asked` (a column `term`) and that there are at most `slice_pairs` of them, others are
    left out where they are read; the totals are those of whole documents all the same. Null and empty texts have no
    terms; repeated rows are documents each; ids may be null.
    """
    kind = docs.schema[doc_id].dataType
    wanted = None
    if asked is not None:
        few = asked.select("term").distinct().limit(slice_pairs + 1).collect()
        wanted = docs.sparkSession.sparkContext.broadcast({r["term"] for r in few}) if len(few) <= slice_pairs else None
    schema = T.StructType([
        T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("docs", T.ArrayType(kind)),
        *[T.StructField(n, T.ArrayType(t)) for n, t in (
            ("lengths", T.LongType()), ("terms", T.BinaryType()), ("ends", T.LongType()), ("places", T.IntegerType()), ("counts", T.LongType()),
        )],
    ])

    def run(batches):
        keep = None if wanted is None else wanted.value
        shard = _Building()
        for batch in pieces(batches):
            for name, value in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                shard.add(name, plain_words(value), keep)
                if shard.bytes >= shard_bytes:
                    yield shard.row(kind)
                    shard = _Building()
        if shard.n_docs:
            yield shard.row(kind)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


class _Building:
    """A shard while its documents are read."""

    def __init__(self):
        self.n_docs = self.n_terms = self.bytes = 0
        self.docs: list = []
        self.lengths: list[int] = []
        self.codes: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, name, words: list[bytes], keep: set[bytes] | None) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        self.bytes += sum(map(len, words))
        codes = self.codes
        own = [codes.setdefault(w, len(codes)) for w in words if keep is None or w in keep]
        if own:
            self.parts.append(np.unique(np.array(own, np.int32), return_counts=True))
            self.docs.append(name)
            self.lengths.append(len(words))

    def row(self, kind: T.DataType) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        code = np.concatenate([c for c, _ in self.parts] or [none])
        count = np.concatenate([n for _, n in self.parts] or [none])
        place = np.repeat(np.arange(len(self.parts)), [len(c) for c, _ in self.parts])
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(self.codes))) if len(code) else none
        values = [self.n_docs, self.n_terms, self.docs, self.lengths, list(self.codes), ends, place[order], count[order]]
        kinds = [pa.int64(), pa.int64(), *map(pa.list_, (to_arrow_type(kind), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))]
        names = ["n_docs", "n_terms", "docs", "lengths", "terms", "ends", "places", "counts"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, bound: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to n - 1) and final scores of all that are among the k best or tie with the k-th, if they reach `bound`.

    A list holds documents and what it adds to their scores, by falling addition. Each round reads as much of every
    list as all rounds before. A document is left as soon as its upper bound is below the k-th lower bound; the rounds
    end when the intervals of all that are left have closed.
    """
    lower = np.zeros(n, np.int64)
    read, step = [0] * len(lists), _FIRST_READ
    while True:
        seen, rest = np.zeros(n, np.int64), 0
        for j, (docs, adds) in enumerate(lists):
            end = min(len(docs), read[j] + step)
            if read[j] < end:
                lower[docs[read[j] : end]] += adds[read[j] : end]  # a document stands once in a list
                read[j] = end
            if end < len(docs):
                rest += int(adds[end])
                seen[docs[:end]] += adds[end]
        upper = lower + (rest - seen)
        least = max(bound, int(np.partition(lower, n - k)[n - k]) if n > k else 0, 1)
        left = np.flatnonzero(upper >= least)
        if (upper[left] == lower[left]).all():
            return left, lower[left]
        step = max(read)


def impacts(count: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to a document's score: falls with the document's length, levels off with
    the term's count."""
    m = 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


class _Shard:
    """A row of the index with the impact-sorted lists of the asked terms."""

    def __init__(self, row: dict, asked: dict[bytes, list], n_docs: int, n_terms: int):
        self.docs, starts = row["docs"], np.concatenate([[0], row["ends"]]).astype(np.int64)
        lengths, places, counts = (np.asarray(row[n], np.int64) for n in ("lengths", "places", "counts"))
        self.lists = {}
        for i, term in enumerate(row["terms"]):
            if term in asked:
                own, count = places[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]
                impact = impacts(count, lengths[own], n_docs, n_terms)
                order = np.argsort(-impact, kind="stable")
                self.lists[term] = own[order], impact[order]

    def best(self, terms: list[tuple[bytes, int]], k: int, bound: int) -> list[tuple[int, object]]:
        lists = [(docs, w * impact) for term, w in terms if term in self.lists and w > 0 for docs, impact in [self.lists[term]]]
        if not lists:
            return []
        found, scores = nra(lists, len(self.docs), k, bound)
        return [(s, self.docs[d]) for d, s in zip(found.tolist(), scores.tolist(), strict=True) if s > 0]


def _order(hit: tuple[int, object]) -> tuple:
    return -hit[0], hit[1] is None, hit[1]


def search(shards: DataFrame, terms: DataFrame, k: int = 50, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item of `terms` (see `item_terms`) its k best documents of an `index`.

    Scores above 0 only, equal scores by ascending doc_id (null last; rows of one id in no order). Items go to the
    tasks in slices of about `slice_pairs` (item, term) pairs; each slice reads the index once. A task returns at most
    k rows per item; these are ranked in bins, then as a whole, and both cut to k before their shuffle.
    """
    spark = shards.sparkSession
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    sizes = F.explode(F.arrays_zip(
        F.col("terms").alias("term"), F.zip_with("ends", F.concat(F.array(F.lit(0).cast("bigint")), "ends"), lambda a, b: a - b).alias("n")
    )).alias("x")
    held = shards.select(sizes).where("x.term IS NOT NULL").groupBy("x.term").agg(F.sum("x.n").alias("df"))
    asked = materialize(terms.join(held, "term").withColumn("number", F.xxhash64("item_id")), "asked")
    slices = int(asked.count() // slice_pairs) + 1
    doc_kind, item_kind = shards.schema["docs"].dataType.elementType, terms.schema["item_id"].dataType
    schema = T.StructType([
        T.StructField("item_id", item_kind), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType()), T.StructField("bin", T.LongType()),
    ])
    found = None
    for one in range(slices):
        of_item = defaultdict(list)
        for r in asked.where(F.expr(f"pmod(number, {slices})") == one).collect():
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            of_item[r["item_id"]].append((r["term"], weight))
        sent = spark.sparkContext.broadcast(dict(of_item))

        def run(batches, sent=sent):
            items = sent.value
            wanted = {term for own in items.values() for term, _ in own}
            best: dict = {item: [] for item in items}
            number = 0
            for batch in batches:
                for i in range(batch.num_rows):
                    number += 1
                    row = {n: v[0] for n, v in batch.slice(i, 1).to_pydict().items()}
                    shard = _Shard(row, wanted, n_docs, n_terms)
                    for item, own in items.items():
                        held = best[item]
                        more = shard.best(own, k, held[k - 1][0] if len(held) >= k else 0)
                        if more:
                            best[item] = sorted([*held, *more], key=_order)[:k]
            hits = [(item, doc, score, zlib.crc32(str(doc).encode()) % 64) for item, own in best.items() for score, doc in own]
            for at in range(0, len(hits), 10_000):
                columns = zip(*hits[at : at + 10_000], strict=True)
                kinds = (to_arrow_type(item_kind), to_arrow_type(doc_kind), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        rows = shards.mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    binned = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "bin").orderBy(*order))).where(F.col("rank") <= k)
    ranked = binned.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best of `docs` for each of `items`.

    Null and empty texts, of documents or items, have no terms and are in no result; repeated rows of `docs` are
    documents each, rows of one item_id are one item; an empty table of either gives no rows. Other columns are left out.
    """
    terms = materialize(item_terms(items, item_id, item_text), "terms")
    return search(materialize(index(docs, terms, doc_id, text, shard_bytes), "index"), terms, k)


def op12_ranked(spark, sf_dir) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM cut WHERE len(w) > 0),
postings AS (
  SELECT d, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM cut) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
