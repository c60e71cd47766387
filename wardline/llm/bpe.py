"""Byte-level BPE encoding and decoding by a rank file.

A piece's merges run on a segment tree over its byte positions: a leaf holds the rank of the pair that starts there, a
node the leftmost smallest rank below it. A merge takes the root and updates three leaves: the merged token's, its left
neighbour's, and that of the token it swallowed, each in logarithmic time, so a piece of n bytes costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.text import pieces, table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_NEVER = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece after all merges; a piece that is a token is that token."""
    n, rank = len(piece), ranks.get
    if (whole := rank(piece)) is not None:
        return [whole]
    none = _NEVER * n
    size = 1 << (n - 2).bit_length()
    tree = [none] * size
    tree += [rank(piece[i : i + 2], _NEVER) * n + i for i in range(n - 1)]  # the smallest is the leftmost of its rank
    tree += [none] * (2 * size - len(tree))
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    ends, befores = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) < none:
        here = best % n
        swallowed = ends[here]
        end = ends[here] = ends[swallowed]
        changed = []
        if end < n:
            befores[end] = here
            changed.append((here, rank(piece[here : ends[end]], _NEVER) * n + here))
            changed.append((swallowed, none))
        else:
            changed.append((here, none))
        if (before := befores[here]) >= 0:
            changed.append((before, rank(piece[before:end], _NEVER) * n + before))
        for leaf, value in changed:
            node = size + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    out, here = [], 0
    while here < n:
        out.append(ranks[piece[here : ends[here]]])
        here = ends[here]
    return out


class _Pieces(dict):
    """Ids of pieces seen, as little-endian bytes; emptied when full, so memory does not grow with the vocabulary."""

    LIMIT = 1 << 19

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = np.array(merge(piece.encode("utf-8"), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_KNOWN: dict[str, _Pieces] = {}  # per worker process, by rank file: tasks that follow find the pieces of those before


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _adding(df: DataFrame, fields: list[T.StructField], source: str, make, rows: int) -> DataFrame:
    """`df` with columns made from `source` in Arrow batches; columns of those names are replaced."""
    df = df.drop(*[f.name for f in fields if f.name != source])
    place = df.columns.index(source)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        do = make()
        for batch in pieces(batches, rows):
            yield pa.RecordBatch.from_arrays([*batch.columns, *do(batch.column(place))], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column of token ids of the whole text.

    Each match of `pattern` is merged on its own; special tokens are ordinary text. Null and empty texts give an empty
    list. Rows are handled one by one, so repeated rows and other columns pass unchanged.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        find = regex.compile(pattern).findall
        known = _KNOWN.setdefault(ranks_path, _Pieces(sent.value))
        return lambda texts: [_lists([b"".join(map(known.__getitem__, find(t or ""))) for t in texts.to_pylist()])]

    return _adding(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, make, 256)


def decode(
    docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", digest: str = "ids_sha256"
) -> DataFrame:
    """`docs` with the bytes that the ids stand for, and the sha256, in lowercase hex, of the ids as little-endian
    unsigned 32-bit integers. Null ids give no bytes. An id that no token has is an error."""
    sent = docs.sparkSession.sparkContext.broadcast({i: token for token, i in read_ranks(ranks_path).items()})

    def make():
        tokens = sent.value

        def do(lists):
            texts, sums = [], []
            for one in lists:
                numbers = one.values.to_numpy() if one.is_valid else np.empty(0, np.int32)
                texts.append(b"".join(map(tokens.__getitem__, numbers.tolist())))
                sums.append(hashlib.sha256(numbers.astype("<u4").tobytes()).hexdigest())
            return [pa.array(texts, pa.binary()), pa.array(sums, pa.string())]

        return do

    return _adding(docs, [T.StructField(decoded, T.BinaryType()), T.StructField(digest, T.StringType())], ids, make, 256)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's text encoded and decoded again."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoded = encode(rows, ranks_path, pattern).select("doc_id", "ids")
    return decode(encoded, ranks_path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def multilingual() -> tuple[str, str]:
    """Rank file and pattern of the public multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *multilingual())
