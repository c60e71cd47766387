"""Best-fit packing: token sequences are planned on the histogram of piece lengths, then pieces take planned slots.

A histogram has one count per length, however many documents there are, so best fit by falling length runs on counts:
groups of equally filled sequences are kept with their number, and a length fills whole groups at once. A piece learns
its rank among the pieces of its length from counts by task and length, and its rank names its slot.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm.text import column, pieces as slices, table
from wardline.session import materialize

SIZE = 2048
_END = "<|endoftext|>"


class Encoder:
    """Ids of whole texts by the vocabulary of a `tokenizers` file; the end mark's string in a text is its id.

    `tiktoken` knows the same vocabulary as a rank file and is five times faster, so it encodes what both read alike.
    Its look-ahead only matters where two blanks meet; texts without such a place go without it. Texts with the end mark's
    string or a run of blanks that overflows its stack are left to `tokenizers`.
    """

    _LOOK = r"|\s+(?!\S)"

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        plain, full = (tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                       for p in (pattern.replace(self._LOOK, ""), pattern))
        self._plain, self._full, self._path, self._slow = plain.encode_ordinary, full.encode_ordinary, tokenizer_path, None
        self._pair, self._run = re.compile(r"\s\s").search, re.compile(r"\s{20000}").search

    def __call__(self, text: str) -> np.ndarray:
        if _END in text or self._run(text):
            self._slow = self._slow or Tokenizer.from_file(self._path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(array("I", (self._full if self._pair(text) else self._plain)(text)), "<u4")


@lru_cache(1)
def _encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One per worker process, for all its tasks."""
    return Encoder(tokenizer_path, ranks_path, pattern)


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int = 0, size: int = SIZE, with_ids: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, with `task` and `seat`, its place among the
    pieces of its length that the same task made. `docs`: doc_id, text.

    A document is its text's ids and `end_id`. One longer than `size` is cut from its end, so the first piece may be
    shorter. Null and empty texts are the end mark alone; repeated rows are documents each; ids may be null.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encode = _encoder(tokenizer_path, ranks_path, pattern)
        task, seats = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, 256):
            rows: list[list] = [[] for _ in _PIECE]
            for name, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:b]
                    values = (name, piece, a, b - a, zlib.crc32(own), task, seats[b - a], own.view(np.int32))
                    seats[b - a] += 1
                    for to, value in zip(rows, values if with_ids else values[:-1], strict=False):
                        to.append(value)
            names = _PIECE if with_ids else _PIECE[:-1]
            kinds = [batch.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, rows[: len(names)], kinds)), names=names)

    schema = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, seat bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seat", "ids"]


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, times), ...]) of all groups of equally filled sequences.

    Lengths go from the longest down, each into the fullest sequences that still take it, as best fit does piece by
    piece. A length splits the last group that it touches into three at most and opens two, so there are at most four
    groups per length, whatever the counts.
    """
    open_groups: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(number: int, pattern: list[tuple[int, int]], room: int) -> None:
        if room == 0:
            done.append((number, pattern))
            return
        if room not in open_groups:
            open_groups[room] = []
            insort(rooms, room)
        open_groups[room].append([number, pattern])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                number, pattern, room = left, [], size
            else:
                room = rooms[at]
                number, pattern = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                    rooms.pop(at)
            times = room // length
            full = min(number, left // times)
            if full:
                put(full, [*pattern, (length, times)], room - times * length)
                left -= full * times
                number -= full
            if number and left and left < times:
                put(1, [*pattern, (length, left)], room - left * length)
                left, number = 0, number - 1
            if number and pattern:
                put(number, pattern, room)
    return done + [(number, pattern) for groups in open_groups.values() for number, pattern in groups]


class _Slots:
    """Slots of all groups, to be looked up by length and rank."""

    def __init__(self, groups: list[tuple[int, list[tuple[int, int]]]]):
        rows, taken, sequence = [], Counter(), 0
        for number, pattern in groups:
            offset = 0
            for length, times in pattern:
                rows.append((length, taken[length], times, sequence, offset))
                taken[length] += number * times
                offset += length * times
            sequence += number
        rows.sort()
        self.length, self.first, self.times, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for one in np.unique(length):
            own = np.flatnonzero(length == one)
            a, b = np.searchsorted(self.length, [one, one + 1])
            row = a + np.searchsorted(self.first[a:b], rank[own], "right") - 1
            seat, place = np.divmod(rank[own] - self.first[row], self.times[row])
            sequence[own], offset[own] = self.sequence[row] + seat, self.offset[row] + place * one
        return sequence, offset


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `cut_pieces` with sequence_id and offset in place of task and seat.

    The histogram, one row per length and so `size` rows at most, is planned on the driver; the plan has at most four
    groups per length and 63 lengths in a group. Ranks within a length are a task's first rank plus the seat; tasks
    are counted, no row is sorted, and equal rows only share a length, so a group of copies meets in no task.
    """
    pieces = materialize(pieces, "pieces")
    names = [c for c in pieces.columns if c not in ("task", "seat")]
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_Slots(best_fit(counts, size)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(*names, (F.col("base") + F.col("seat")).alias("rank"))

    def seat(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            found = slots.value.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, found)], names=[*names, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)
    return ranked.mapInArrow(seat, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, with their ids, packed into few sequences of at most `size` tokens.

    doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset; other columns of `docs` are left out. For nulls,
    empty texts and repeated rows see `cut_pieces`; an empty table gives no rows.
    """
    import public_tokenizers

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = cut_pieces(
        rows, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, size=size, with_ids=with_ids,
    )
    return pack(pieces, size)


def op13_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
