"""Words and hashes of whole texts, shared by the operators that run in Arrow batches.

Texts are handled as UTF-8 bytes: the two word definitions differ from ASCII only in what they leave alone, so
one table lookup per byte lower-cases A-Z and blanks the separators.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_LOWERED = bytes.maketrans(_UPPER, _LOWER)
_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
WORDED = bytes.maketrans(_UPPER + _SEPARATORS, _LOWER + b" " * len(_SEPARATORS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def blank_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return utf8(text).translate(_LOWERED).split()


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    return utf8(text).translate(WORDED).split()


class _Hashes(dict):
    """Hash of each word seen; emptied when full and without long words, so that what stays in a worker process between
    its tasks is some 20 MB at most."""

    LIMIT, LONGEST = 1 << 17, 64

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            self[word] = value
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of n consecutive words, in order; empty when there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
    return mixed(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence is one when the text has fewer words."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects of few texts are alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(id_column: str = "doc_id", share: int = 5) -> Column:
    """Remainder of crc32 of the id's digits; null ids fall in fold 0 of the empty string."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % share
