"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Conversations are sorted by their path, the digests of their turns one after the other, so a node's members stand
together and a range of conversations is a shard. A shard writes its trie as balanced parentheses. `findclose`, by the
least excess of blocks, delimits the subtree of every node; the rank of leaf pairs `()` counts its leaves; differences
of cumulative arrays give members and savings. Only nodes on a shard's first and last path can go on in the shards next
to it: these spines go out as partial sums and are added up by node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import column, table
from wardline.session import materialize

#: Turns in a shard, about; a shard's arrays take some 200 bytes a turn.
SHARD_TURNS = 100_000
_WIDTH = 16  # bytes of a turn's digest


class Minima:
    """Least values of ranges, and the first place from which on a value is below a bound, by runs of powers of two."""

    def __init__(self, values: np.ndarray):
        self.runs = [values]
        while (half := 1 << (len(self.runs) - 1)) * 2 <= len(values):
            last = self.runs[-1]
            self.runs.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low:high] for each pair; high > low."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), self.runs[0].dtype)
        for k, run in enumerate(self.runs):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(run[low[own]], run[high[own] - (1 << k)])
        return out

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First place from `start` on with a value below `bound`; len(values) where there is none."""
        at = start.copy()
        for k in range(len(self.runs) - 1, -1, -1):
            run = self.runs[k]
            inside = np.flatnonzero(at < len(run))
            skip = inside[run[at[inside]] >= bound[inside]]
            at[skip] += 1 << k
        return at


class Parentheses:
    """A sequence of 1 (open) and 0 (close), balanced, with the least excess of every block."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1)
        self.opens = np.flatnonzero(bits)
        pad = -len(bits) % self.BLOCK
        self._blocks = np.pad(self.excess, (0, pad), constant_values=np.iinfo(np.int32).max).reshape(-1, self.BLOCK)
        self._minima = Minima(self._blocks.min(axis=1))
        leaf = bits.astype(bool)
        leaf[:-1] &= bits[1:] == 0
        self._leaves = np.concatenate([[0], np.cumsum(leaf)])

    def close(self, opens: np.ndarray) -> np.ndarray:
        """Places of the closing marks: the first place after the opening one whose excess is lower."""
        out = np.empty(len(opens), np.int64)
        for at in range(0, len(opens), 1 << 14):
            own = opens[at : at + (1 << 14)]
            bound, block = self.excess[own], own // self.BLOCK
            inside = (self._blocks[block] < bound[:, None]) & (np.arange(self.BLOCK) > (own % self.BLOCK)[:, None])
            there = inside.any(axis=1)
            block = np.where(there, block, self._minima.first_below(block + 1, bound))
            inside[~there] = self._blocks[block[~there]] < bound[~there, None]
            out[at : at + (1 << 14)] = block * self.BLOCK + inside.argmax(axis=1)
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Pairs `()` between each opening and closing mark, these included."""
        return self._leaves[closes] - self._leaves[opens]


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that both paths have."""
    most = min(len(a), len(b)) // _WIDTH
    if a[: most * _WIDTH] == b[: most * _WIDTH]:
        return most
    low, high = 0, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _WIDTH] == b[: mid * _WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _keys(path: bytes, turns: int | None = None) -> list[bytes]:
    """Digests of a path's prefixes of no turn, one turn and so on."""
    keys = [b""]
    for d in range(len(path) // _WIDTH if turns is None else turns):
        keys.append(hashlib.blake2b(keys[-1] + path[d * _WIDTH : (d + 1) * _WIDTH], digest_size=16).digest())
    return keys


_NODE = [
    ("shard", pa.int32(), "int"), ("kind", pa.int32(), "int"), ("key", pa.binary(), "binary"), ("parent_key", pa.binary(), "binary"),
    ("conv_id", pa.int64(), "bigint"), ("depth", pa.int64(), "bigint"), ("parent_conv_id", pa.int64(), "bigint"),
    ("n_convs", pa.int64(), "bigint"), ("n_children", pa.int64(), "bigint"), ("n_leaves", pa.int64(), "bigint"),
    ("saved_tokens", pa.int64(), "bigint"), ("ends_sha256", pa.string(), "string"), ("ends", pa.string(), "string"),
    ("first", pa.binary(), "binary"), ("first_chars", pa.list_(pa.int32()), "array<int>"), ("last", pa.binary(), "binary"),
]
_INNER, _SPINE, _EDGE = 0, 1, 2


def _shard_rows(shard: int, ids: np.ndarray, paths: list[bytes], chars: list[list[int]]):
    """Record batches of a shard's nodes, its spines' partial sums, and its first and last path."""
    bits, spine = bytearray(b"\1"), [0]
    parent, depth, length, at = [-1], [0], [0], np.zeros(len(ids), np.int64)
    before = b""
    for i, path in enumerate(paths):
        if path != before:
            keep = _shared(before, path)
            bits += bytes(len(spine) - 1 - keep)
            del spine[keep + 1 :]
            new = len(path) // _WIDTH - keep
            bits += b"\1" * new
            for d in range(keep, keep + new):
                parent.append(spine[-1])
                spine.append(len(depth))
                depth.append(d + 1)
                length.append(chars[i][d])
            before = path
        at[i] = spine[-1]
    bits += bytes(len(spine))

    marks = Parentheses(np.frombuffer(bits, np.uint8))
    closes = marks.close(marks.opens)
    n = len(depth)
    node = np.arange(n)
    behind = node + (closes - marks.opens + 1) // 2  # the first node, in preorder, outside the subtree
    ended = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
    low, high = ended[:-1], ended[behind]
    n_convs, size = high - low, np.array(length, np.int64)
    saved = np.concatenate([[0], np.cumsum((n_convs - 1) * size)])
    parents = np.array(parent, np.int64)
    out = {
        "conv_id": Minima(ids).least(low, high), "depth": np.array(depth, np.int64), "n_convs": n_convs,
        "n_children": np.bincount(parents[1:], minlength=n), "n_leaves": marks.leaves(marks.opens, closes),
        "saved_tokens": saved[behind] - saved[:-1],
    }

    on_spine = np.zeros(n, bool)
    key: list[bytes | None] = [None] * n
    for end, path in ((at[0], paths[0]), (at[-1], paths[-1])):
        for k in reversed(_keys(path)):
            key[end], on_spine[end] = k, True
            end = parents[end]
    names = ids.astype("U20")

    def ends(i: int) -> str:
        return ",".join(names[low[i] : ended[i + 1]])

    def batch(own: np.ndarray, kind: int):
        held = parents[own]
        outside = (held >= 0) & on_spine[held]
        values = {name: pa.array(out[name][own]) for name in out}
        values["shard"], values["kind"] = pa.array(np.full(len(own), shard, np.int32)), pa.array(np.full(len(own), kind, np.int32))
        values["key"] = pa.array([key[i] for i in own], pa.binary())
        values["parent_key"] = pa.array([key[p] if o else None for p, o in zip(held, outside, strict=True)], pa.binary())
        values["parent_conv_id"] = pa.array(out["conv_id"][held], mask=outside | (held < 0))
        texts = [ends(i) for i in own]
        if kind == _INNER:
            values["ends_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
        else:
            values["ends"] = pa.array([t or None for t in texts], pa.string())
        return _batch(len(own), values)

    inner = np.flatnonzero(~on_spine)
    for start in range(0, len(inner), 1 << 14):
        yield batch(inner[start : start + (1 << 14)], _INNER)
    yield batch(np.flatnonzero(on_spine), _SPINE)
    yield _batch(1, {
        "shard": pa.array([shard], pa.int32()), "kind": pa.array([_EDGE], pa.int32()), "first": pa.array([paths[0]], pa.binary()),
        "first_chars": pa.array([chars[0]], pa.list_(pa.int32())), "last": pa.array([paths[-1]], pa.binary()),
    })


def _batch(rows: int, values: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values.get(n, pa.nulls(rows, kind)) for n, kind, _ in _NODE], names=[n for n, _, _ in _NODE])


def _build(batches):
    ids, paths, chars = [], [], []
    for batch in batches:
        ids += column(batch, "conv_id")
        paths += column(batch, "path")
        chars += column(batch, "chars")
    if ids:
        yield from _shard_rows(TaskContext.get().partitionId(), np.array(ids, np.int64), paths, chars)


def _overlaps(batches):
    """Per node that two neighbouring shards both opened: what was counted twice. A leaf of the first shard that the
    second one repeats or extends is no leaf of the first."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for last, first, chars in zip(*(column(batch, n) for n in ("last", "first", "first_chars")), strict=True):
            both = _shared(last, first)
            twice = np.cumsum([0, *chars[:both][::-1]])[::-1]  # code points from depth d + 1 on
            for d, key in enumerate(_keys(first, both)):
                rows[0].append(key)
                rows[1].append(-1 if d < both else 0)
                rows[2].append(-1 if both * _WIDTH == len(last) else 0)
                rows[3].append(int(twice[d]) + (chars[d - 1] if d else 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.binary()), *(pa.array(r, pa.int64()) for r in rows[1:])],
            names=["key", "n_children", "n_leaves", "saved_tokens"],
        )


def _digests(batches):
    """SHA-256 of the texts of each key, in order; a key's rows follow each other."""
    now, sha = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, text in zip(column(batch, "key"), column(batch, "ends"), strict=True):
            if sha is None or key != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.binary(), pa.string()))], names=["key", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "sha"])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: a conversation's turns in order, each with the digest (hex) of role and text and its code points.

    `conversations`: conv_id, turn, role, text; other columns are left out. A null role or text is empty, a null turn
    comes first, turns of one number follow each other by their digest, and repeated rows are turns each. Rows without
    a conv_id belong to no conversation and are left out. Texts are not shuffled, only their digests: a conversation
    is one row of some 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * _WIDTH)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("one"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """`conversation_turns` rebuilt: the first crc32(conv_id) % `most` turns are those of the group's first conversation."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    bases = turns.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("lead")
    )
    joined = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left").withColumn("h", head.cast("int"))
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (code points of last turns that members beyond the first repeat, summed over the
    subtree) and ends_sha256 (of the ids of the conversations that end here, ascending, comma-joined).

    `turns` as `conversation_turns` returns it, one row per conv_id. Conversations without turns are members of the root
    alone; without any conversation there is no node. Equal conversations are cut by conv_id, so a conversation that a
    third of all repeat fills many shards, whose spines are merged by sums that combine before the shuffle. To the
    driver come the numbers of the shards that hold rows.
    """
    spark = turns.sparkSession
    paths = materialize(turns.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    ), "paths")
    total = paths.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    dealt = paths.repartitionByRange(int(total // shard_turns) + 1, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    built = materialize(dealt.mapInArrow(_build, ", ".join(f"{n} {kind}" for n, _, kind in _NODE)), "tries")

    edges = built.where(F.col("kind") == _EDGE).select("shard", "first", "first_chars", "last")
    shards = sorted(r["shard"] for r in edges.select("shard").collect())
    follows = spark.createDataFrame(list(zip(shards, shards[1:], strict=False)), "shard int, next int")
    pairs = edges.select("shard", "last").join(follows, "shard").join(
        edges.select(F.col("shard").alias("next"), "first", "first_chars"), "next"
    )
    twice = pairs.select("last", "first", "first_chars").mapInArrow(
        _overlaps, "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint"
    )
    partial = built.where(F.col("kind") == _SPINE)
    ends = partial.where("ends IS NOT NULL").select("key", "shard", "ends")
    digests = ends.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_digests, "key binary, sha string")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = (
        partial.select("key", "parent_key", "conv_id", "depth", *sums)
        .unionByName(twice, allowMissingColumns=True)
        .groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums])
    )
    spines = materialize(merged.join(digests, "key", "left"), "spines")

    out = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    above = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = built.where(F.col("kind") == _INNER)
    here = partial.select("shard", F.col("key").alias("parent_key")).join(above, "parent_key")  # keyed by shard: no hot key
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(here, ["shard", "parent_key"])
    shared = spines.join(above, "parent_key", "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)))
    return inner.where("parent_key IS NULL").select(*out).unionByName(below.select(*out)).unionByName(shared.select(*out))


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie(with_shared_heads(conversation_turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS k
), own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
           lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM own, crc
), built AS (
  SELECT x.conv_id, list_concat(coalesce(b.turns, [])[1:h], x.turns[h + 1:]) AS p
  FROM headed x LEFT JOIN own b ON b.conv_id = x.conv_id - x.conv_id % 100
), digests AS (
  SELECT conv_id, len(p) AS n, list_transform(p, lambda x: length(x.t)) AS chars,
         array_to_string(list_transform(p, lambda x: md5(concat(length(x.r), ':', x.r, x.t))), '') AS path
  FROM built
), prefixes AS (
  SELECT conv_id, n, chars, path, unnest(range(0, n + 1)) AS depth FROM digests
), nodes AS (
  SELECT left(path, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN depth = 0 THEN 0 ELSE chars[depth] END) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), kids AS (
  SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)
), below AS (
  SELECT left(node, 32 * up) AS node, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (node)
LEFT JOIN nodes p ON c.depth > 0 AND p.node = left(c.node, 32 * (c.depth - 1)) AND p.depth = c.depth - 1
"""
