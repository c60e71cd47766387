"""Prefix trie, ranked search and packing against brute force, and on awkward and empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from wardline.llm import packing, prefix_trie, ranked

# 11 prefix trie


def awkward_conversations():
    """Nulls, empty roles and texts, ties, repeated rows and turns, hot conversations, ids without a group's first."""
    rng = random.Random(11)
    rows = [(None, 0, "user", "lost"), (1, None, None, "x"), (1, 2, "user", None), (1, 1, "", ""), (1, 1, "", ""), (7, 0, "a", "bc"), (8, 0, "ab", "c")]
    rows += [(c, t, "user", "hello there") for c in range(20, 90) for t in range(2)]  # equal conversations
    rows += [(c, t, rng.choice("ua"), rng.choice(["one", "two", "é🎉"])) for c in range(200, 260) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", f"t{t}") for c in (400, 401, 450) for t in range(300)]  # long ones
    rows += [(500, 0, "user", "z" * 100_000), (2**40 + 1, 0, "user", "far")]
    rng.shuffle(rows)
    return rows


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p))).encode()).hexdigest())
        for p, m in members.items()
    )


TURNS = "conv_id bigint, turn int, role string, text string, kind string, shard int, key string"


@pytest.mark.parametrize("shard_turns", [100_000, 400, 9])
def test_trie_is_that_of_brute_force_whatever_the_shards(spark, shard_turns):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, "mine", 1, "k") for r in rows], TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.conversation_turns(df)), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == trie_by_hand(rows)


def test_empty_and_turnless_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    build = lambda df: prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.conversation_turns(df))).collect()
    assert build(none) == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # its one turn gives way to a missing head
    (root,) = build(spark.createDataFrame([(alone, 0, "user", "x", "", 1, "")], TURNS))
    assert tuple(root)[:7] == (alone, 0, None, 1, 0, 1, 0)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 3000])
def test_parentheses_close_and_count_leaves(n):
    rng = random.Random(n)
    bits, depth, opened = [1], 1, 1
    while opened < n or depth:
        up = opened < n and (depth == 1 or rng.random() < 0.55)
        bits.append(int(up))
        opened, depth = opened + up, depth + (1 if up else -1)
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    marks = prefix_trie.Parentheses(np.array(bits, np.uint8))
    closes = marks.close(marks.opens)
    assert dict(zip(marks.opens.tolist(), closes.tolist(), strict=True)) == close
    pairs = [i for i in range(len(bits) - 1) if bits[i] and not bits[i + 1]]
    assert marks.leaves(marks.opens, closes).tolist() == [sum(o <= p < c for p in pairs) for o, c in sorted(close.items())]


# 12 ranked search


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranks_by_hand(docs, items, k):
    cut = [(i, words_of(t)) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    n_docs, n_terms = len(cut), sum(len(w) for _, w in cut)
    df = Counter(t for _, w in cut for t in set(w))
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words_of(t))
    out = {}
    for item, own in terms.items():
        scores = []
        for i, w in cut:
            tf, m = Counter(w), 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if t in tf)
            if s > 0:
                scores.append((-s, i is None, i))
        out[item] = [(-s, i) for s, _, i in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    docs += [(i, "W1, w2; w3 same-text") for i in range(400, 500)]  # ties
    docs += [(77, docs[77][1]), (501, "w5 " * 100_000), (502, None), (503, ""), (504, "--- \n"), (None, "w2 w7"), (505, "日本 É é")]
    items = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(12)] + [(20, "w1 w2 same"), (21, None), (22, ""), (23, "not there"), (24, "日本 é"), (0, "w9 w59")]
    return docs, items


@pytest.mark.parametrize("shard_bytes,slice_pairs", [(1 << 25, 500_000), (3000, 500_000), (3000, 20)])
def test_ranks_are_those_of_brute_force(spark, corpus, shard_bytes, slice_pairs):
    docs, items = corpus
    rows = spark.createDataFrame([(*d, "mine", 1) for d in docs], "doc_id bigint, text string, term string, rank int")
    asked = spark.createDataFrame([(*i, 2.0) for i in items], "item_id bigint, text string, score double")
    terms = ranked.item_terms(asked)
    shards = ranked.index(rows, terms, shard_bytes=shard_bytes, slice_pairs=slice_pairs)
    got = defaultdict(list)
    for r in ranked.search(shards, terms, 50, slice_pairs).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(got[r["item_id"]])
    want = {i: own for i, own in ranks_by_hand(docs, items, 50).items() if own}
    assert dict(got) == want


def test_nra_reads_on_until_ties_and_scores_are_final():
    rng = np.random.Generator(np.random.PCG64(12))
    for n, k in [(1, 5), (300, 5), (3000, 50)]:
        lists, scores = [], np.zeros(n, np.int64)
        for _ in range(6):
            own = rng.permutation(n)[: rng.integers(1, n + 1)]
            adds = np.sort(rng.integers(1, 8, len(own)))[::-1].astype(np.int64)
            lists.append((own, adds))
            scores[own] += adds
        found, got = ranked.nra(lists, n, k)
        least = max(1, np.sort(scores)[::-1][min(k, n) - 1])
        assert sorted(found) == np.flatnonzero(scores >= least).tolist() and (got == scores[found]).all()
        assert len(ranked.nra(lists, n, k, int(scores.max()) + 1)[0]) == 0


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranked.rank_documents(docs.where("false"), items).collect() == []
    assert ranked.rank_documents(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in ranked.rank_documents(docs, items).collect()] == [("x", 1, 1)]


# 13 packing


def test_ids_are_those_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    encode = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(13)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", " ", "　", "'s", "12", "!?", "é", "日本", "<|endoftext|>", "🎉", "\x0b", "\x85", "\x1c", " ", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + [" " * 200_000 + "b", "\n" * 50_000 + " x", "a b" * 50_000]
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def best_fit_by_hand(lengths, size):
    rooms, fill = [], []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(size - length)
    return Counter(rooms)


@pytest.mark.parametrize("size,n", [(10, 0), (10, 1), (10, 200), (64, 500), (50, 1000)])
def test_plan_on_counts_is_best_fit_piece_by_piece(size, n):
    rng = random.Random(n)
    lengths = [rng.choice([rng.randint(1, size), 1, size // 3]) for _ in range(n)]
    groups = packing.best_fit(Counter(lengths), size)
    rooms, placed = Counter(), Counter()
    for number, pattern in groups:
        rooms[size - sum(a * b for a, b in pattern)] += number
        for length, times in pattern:
            placed[length] += number * times
    assert placed == Counter(lengths) and +rooms == best_fit_by_hand(lengths, size)
    assert len(groups) <= 4 * max(1, len(set(lengths)))


def packed_well(rows, size):
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(fill)


@pytest.mark.parametrize("size", [2048, 16])
def test_pieces_hold_every_id_and_fill_sequences(spark, awkward, size):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = awkward.unionByName(awkward)
    got = packing.pack_documents(docs, size=size).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"] <= size and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc[(r["doc_id"], r["piece"])].append(r)
    texts = Counter((i, t or "") for i, t, *_ in AWKWARD for _ in range(2))
    made = Counter()
    for i, own in ((i, t) for (i, t), n in texts.items() for _ in range(n)):
        ids = [*whole.encode(own, add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        made.update((i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == made
    n = packed_well(got, size)
    assert n == sum(best_fit_by_hand([r["length"] for r in got], size).values())


def test_packing_of_the_table_and_of_none(spark, sf_dir, none):
    got = packing.op13_packing(spark, sf_dir).collect()
    assert list(got[0].asDict()) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed_well(got, 2048) == sum(best_fit_by_hand([r["length"] for r in got], 2048).values())
    assert packing.pack_documents(none).collect() == []
