"""The operators against brute force, and on awkward and empty tables."""

import hashlib
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import tiktoken

from tests.llm.conftest import AWKWARD, prose
from wardline.llm import bpe, decontaminate, embedding, language, licenses, minhash, ppm, sharding, substring, toxicity
from wardline.llm.text import blank_words, plain_words, table


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 substring dedup


@pytest.mark.parametrize("n,length", [(0, 3), (2, 3), (3, 3), (40, 5), (60, 1), (200, 46)])
def test_compact_windows_hold_every_subsequence_once(n, length):
    values = np.random.Generator(np.random.PCG64(n)).integers(0, 2**64 - 1, n, np.uint64, endpoint=True)
    windows = list(zip(*(x.tolist() for x in substring.compact_windows(values, length)), strict=True))
    for i in range(n):
        for j in range(i + length - 1, n):
            least = i + int(np.argmin(values[i : j + 1]))
            assert [c for left, c, right in windows if left <= i <= c <= j <= right] == [least]


def repeated_words(texts: dict) -> dict:
    """Word positions that lie in a run of 50 words which an earlier document (by id) has too."""
    seen, out = {}, {}
    for key in sorted(texts):
        words = blank_words(texts[key])
        own = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        out[key] = {p for i, w in enumerate(own) if w in seen for p in range(i, i + 50)}
        seen.update(dict.fromkeys(own, key))
    return out


def test_repeated_passages_are_cut_but_once(spark):
    passage, line = prose(900, 60), prose(901, 40)
    texts = {i: f"{prose(i, 80 + i)} {passage if i % 3 == 0 else ''} {line} {prose(50 + i, 40)}" for i in range(1, 40)}
    texts[40] = f"{prose(40, 10)} {passage.replace('x30', 'y30')} {prose(41, 12)}"  # one word of sixty differs
    texts[41] = texts[7]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = by_id(substring.substring_duplicates(df))
    for key, wanted in repeated_words(texts).items():
        cut = {p for c in got[key]["cuts"] for p in range(c["s"], c["e"])}
        if key == 40:
            assert len(cut) >= 50
        else:
            assert cut == wanted, key
    assert {got[i]["component_id"] for i in range(3, 40, 3)} == {3} and got[1]["component_id"] == 1
    left = by_id(substring.cut_repeats(df))
    assert passage in left[3]["text"] and all(passage not in left[i]["text"] for i in range(6, 40, 3))
    assert 41 not in left and left[1]["text"] == texts[1]


# 2 embeddings


def test_vectors_against_all_pairs(spark):
    random = np.random.Generator(np.random.PCG64(2))
    base = random.normal(size=(40, 16))
    rows = [(int(i), (base[i % 40] + random.normal(size=16) * random.choice([0.02, 0.3, 1])).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(50)] + [(700, rows[1][1])] * 2
    odd = [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] + [1.0] * 15), (804, [None] + [1.0] * 15), (None, rows[2][1]), (805, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    x = np.array([r[1] for r in [*rows, odd[5]]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in rows] + [None]
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    name = {k: min(i for i, own in zip(ids, label, strict=True) if own == k and i is not None) for k in set(label.tolist())}
    want = Counter((i, int(n), name[k]) for i, n, k in zip(ids, linked.sum(axis=1), label.tolist(), strict=True))
    want.update((r[0], 0, r[0]) for r in odd if r[0] is not None)
    for block in (64, 4096):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.near_vectors(df, block=block).collect())
        assert got == want
    assert embedding.near_vectors(df.where("false")).count() == 0


# 3 sharding


def test_shards_are_even_boxes_with_gapless_slots(spark, sf_dir, awkward, none):
    docs = table(spark, sf_dir, "documents")
    hot = docs.unionByName(docs.limit(1).crossJoin(spark.range(100)).drop("id"))
    got = sharding.shard_documents(hot).collect()
    assert len(got) == hot.count()
    bytes_of, slots = Counter(), {}
    for r in got:
        bytes_of[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(bytes_of.values()) / 40, max(r["size"] for r in got)
    assert all(abs(b - mean) <= 0.01 * mean + 6 * largest for b in bytes_of.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16 for r in got)
    assert sharding.shard_documents(awkward).count() == len(AWKWARD) and sharding.shard_documents(none).count() == 0


def test_shards_by_target_bytes_follow_the_dimension(spark):
    df = spark.range(1000).selectExpr("id as x", "10L as size")
    got = sharding.kd_shards(df, ["x"], target_bytes=2500).groupBy("shard").agg({"x": "min", "*": "count"}).orderBy("shard").collect()
    assert [r["count(1)"] for r in got] == [250] * 4 and [r["min(x)"] for r in got] == [0, 250, 500, 750]


# 4 byte-level BPE


def test_ids_are_those_of_the_tokenizer_library(spark, sf_dir, awkward, none):
    path, pattern = bpe.multilingual()
    ranks = bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    noise = np.random.Generator(np.random.PCG64(4))
    pieces = ["".join(noise.choice(list("abé日=✓"), 4000)), "a" * 5000, "=" * 777, "x\u0085 　y", "I'll we've 12345"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, p) for i, p in enumerate(pieces)], docs.schema))
    digests = by_id(bpe.round_trip(docs, path, pattern))
    for r in bpe.encode(docs, path, pattern).collect():
        assert r["ids"] == known.encode_ordinary(r["text"])
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(r["ids"]) and d["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    got = bpe.encode(awkward, path, pattern).collect()
    assert Counter(len(r["ids"]) for r in got)[0] == 2 and got[0]["kept"] == "mine"
    assert bpe.round_trip(none, path, pattern).count() == 0


# 5 decontamination


def test_hits_are_the_same_broadcast_or_joined(spark, sf_dir, awkward, none):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = items.unionByName(spark.createDataFrame([(None, prose(5, 12)), (77, "one"), (78, None), (79, "")], items.schema))
    for rows in (docs, awkward):
        one, two = (
            decontaminate.benchmark_hits(rows, items, broadcast_windows=n).select("doc_id", "text", "n_words", "n_hit", "items")
            for n in (10**6, 0)
        )
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    got = by_id(decontaminate.benchmark_hits(awkward, items))
    assert got[4]["items"] == ["77"] and got[5]["n_hit"] == 12 and got[5]["items"] == [""] and got[1]["n_words"] == 0
    assert decontaminate.benchmark_hits(awkward, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.without_benchmark(none, items).columns == none.columns
    asked = {tuple(w[i : i + min(10, len(w))]) for r in items.collect() for w in [plain_words(r["text"])] for i in range(max(1, len(w) - 9)) if w}
    for r in decontaminate.benchmark_hits(docs, items).collect():
        words, hit = plain_words(r["text"]), set()
        for n in {len(a) for a in asked}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in asked:
                    hit |= set(range(i, i + n))
        assert r["n_hit"] == len(hit)


# 6 MinHash near-dedup


def test_components_against_all_pairs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    near = prose(1, 200).split()
    docs += [(1000 + i, " ".join([*near[: 40 * i], f"new{i}", *near[40 * i + 1 :]])) for i in range(5)]
    sets = {}
    for key, text in docs:
        w = blank_words(text)
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert {k: r["component_id"] for k, r in got.items()} == label
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (k == label[k]) for k, r in got.items())


def test_min_max_agreement_is_unbiased():
    random = np.random.Generator(np.random.PCG64(6))
    errors = []
    for _ in range(60):
        x = random.integers(0, 2**64 - 1, 300, np.uint64)
        a, b = minhash.min_max(np.sort(x[:240])), minhash.min_max(np.sort(x[60:]))
        errors.append((a == b).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


# 7 language


def test_languages_of_held_out_documents_and_pages(spark, sf_dir, awkward):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    got = language.identify(docs, pages, language.train_texts(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"))).collect()
    assert len(got) == docs.count() + pages.count()
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["language"] == true[r["doc_id"]] for r in held]) > 0.95
    odd = language.identify(awkward, pages.where("false"), language.train_texts(awkward)).collect()
    assert len(odd) == len(AWKWARD) and all(0 < r["confidence"] <= 1 for r in odd)
    assert language.identify(awkward, pages, language.train_texts(awkward.where("false"))).where("language is not null").count() == 0


def test_declaration_and_host_settle_a_text_that_says_nothing(spark):
    docs = spark.createDataFrame([(i, t, k, "s") for i, (t, k) in enumerate([("the and of to this", "en"), ("der die und das nicht", "de")] * 20)], "doc_id bigint, text string, lang string, source string")
    rows = [(i, "http://a.example.de/x", f"<html lang='de'><p>der die und das nicht {i}</p>") for i in range(30)]
    rows += [(100, "http://a.example.de/y", "<html><p>42</p>"), (101, "http://b.example.de/z", None), (102, None, '<html lang="en-US"><p>1</p>')]
    got = by_id(language.identify(docs, spark.createDataFrame(rows, "page_id bigint, url string, html string"), language.train_texts(docs)), "page_id")
    assert got[100]["language"] == "de" and got[101]["language"] == "de" and got[102]["declared"] == "en"


# 8 toxicity


def test_held_out_toxicity(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = by_id(toxicity.score(docs.select("doc_id", "text"), model))
    pairs = [(scored[r["doc_id"]]["toxicity"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([s for s, t in pairs if t == k] for k in (0, 1))
    assert np.mean([[x > y for y in good] for x in bad]) > 0.8


def test_toxicity_of_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(4, None), (None, 1), (5, 1), (77, 0)], "doc_id bigint, toxic int")
    for given in (labels, labels.where("false")):
        scores = [r["toxicity"] for r in toxicity.score(awkward, toxicity.train(awkward, given)).collect()]
        assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_unlabelled_positives_do_not_pull_the_score_down():
    words = [f"clean{i}" for i in range(50)]
    random = np.random.Generator(np.random.PCG64(8))
    clean = [" ".join(random.choice(words, 30)) for _ in range(300)]
    bad = [f"{t} vile" for t in clean[:100]]
    model = toxicity.fit(bad[:50], bad[50:] + clean[100:], prior=0.2)
    assert np.mean([model.score(t) for t in bad[50:]]) > 0.6 and np.mean([model.score(t) for t in clean]) < 0.15


# 9 licences


def test_licence_places(spark, sf_dir, awkward, none):
    docs = table(spark, sf_dir, "documents")
    for r in licenses.scan_licenses(docs.select("doc_id", "text")).collect():
        words = plain_words(r["text"])
        places = sorted(
            i for p, _ in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        assert r["places"] == places and r["n_words"] == len(words)
    scanner = licenses.Scanner()
    assert len(scanner.rules) >= 200 and len({r.priority for r in scanner.rules}) == len(scanner.rules)

    def labels(text):
        words = plain_words(text)
        return [x[0] for x in scanner.detect(words, set(words))]

    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]  # the general rule lies within
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("Apache License 2.0 or the MIT License") == ["apache-2.0", "mit"]
    assert labels("emit licenses apache-like") == []
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD) and licenses.scan_licenses(none).count() == 0


# 10 language-model scoring


def brute_ppm(train: list, text: str) -> float:
    counts = {}
    for t in train:
        s = [256] * 4 + list(t.encode()) + [256]
        for i in range(4, len(s)):
            for k in range(5):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    s, total = [256] * 4 + list(text.encode()) + [256], 0.0
    for i in range(4, len(s)):
        excluded = set()
        for k in range(4, -1, -1):
            own = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in excluded}
            if not own:
                continue
            mass = sum(own.values()) + len(own)
            if s[i] in own:
                total += log10(own[s[i]] / mass)
                break
            total += log10(len(own) / mass)
            excluded |= set(own)
        else:
            total -= log10(257 - len(excluded))
    return total


def test_scores_against_a_plain_trie(spark, awkward, none):
    texts = {i: t for i, t in enumerate(["abracadabra " * 3, "the cat sat", "", None, "é日本 the hat", "zzz", "the mat the hat", "Q"] * 4)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    train = [t or "" for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in train for w in [*blank_words(t), None])
    got = by_id(ppm.score_texts(df))
    for i, t in texts.items():
        own = [*blank_words(t), None]
        r = got[i]
        assert abs(r["score"] - brute_ppm(train, t or "")) < 1e-9
        base = sum(log10((words[w] + 0.1) / (sum(words.values()) + 0.1 * (len(words) + 1))) for w in own)
        assert abs(r["base_score"] - base) < 1e-9 and r["n_known"] == sum(words[w] > 0 for w in own)
        assert r["n_tokens"] == len(own) and r["train_tokens"] == sum(words.values())
    assert ppm.score_texts(awkward).count() == len(AWKWARD) and ppm.score_texts(none).count() == 0


# awkward rows of the two dedups


def test_dedup_of_awkward_rows(awkward, none):
    near = minhash.near_duplicates(awkward).collect()
    assert len(near) == len(AWKWARD)
    assert {r["doc_id"]: r["component_id"] for r in near}[6] == 5
    left = minhash.keep_first(awkward)
    assert left.columns == awkward.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]
    sub = substring.substring_duplicates(awkward).collect()
    assert len(sub) == len(AWKWARD) and all(r["kept"] for r in sub)
    assert substring.cut_repeats(awkward).columns == awkward.columns
    for df in (minhash.near_duplicates(none), minhash.keep_first(none), substring.substring_duplicates(none), substring.cut_repeats(none)):
        assert df.count() == 0


def found_passages(spark, texts: dict) -> set:
    """(later, earlier) of all passages found among texts with ids."""
    owners, passages = substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    ids = {r["node"]: r["first_id"] for r in owners.collect()}
    return {(ids[r["a"]], ids[r["b"]]) for r in passages.collect()}


def test_most_windows_at_the_threshold_are_candidates(spark):
    texts, n = {}, 300
    for i in range(n):
        words = prose(1000 + i, 50).split()
        for j, w in enumerate((words, [*words[:25], f"new{i}", *words[26:]])):  # 41 of 51 shingles are common
            texts[2 * i + j] = " ".join([prose(2000 + 2 * i + j, 30), *w, prose(3000 + 2 * i + j, 30)])
    assert len(found_passages(spark, texts) & {(2 * i + 1, 2 * i) for i in range(n)}) >= 0.93 * n


def alike_starts(one, two) -> set:
    """(start, start) of all windows of two texts at a Jaccard similarity of 0.8, by sets."""
    a, b = ([set(x[i : i + 46].tolist()) for i in range(len(x) - 45)] for x in (one, two))
    return {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if 10 * len(x & y) >= 8 * len(x | y)}


@pytest.mark.parametrize("edit", ["insert", "drop", "replace", "every40", "repeats"])
def test_passages_with_an_inserted_or_dropped_word_against_all_windows(edit):
    words = prose(1, 70).split()
    if edit == "repeats":
        words = (words[:30] * 3)[:70]  # a window has 30 shingles, 30 of 35 are common
    if edit == "every40":
        words = prose(1, 170).split()
        other = [x for i, w in enumerate(words) for x in ([f"new{i}", w] if i % 40 == 20 else [w])]
    else:
        other = {"insert": [*words[:35], "new", *words[35:]], "drop": words[:35] + words[36:]}.get(edit, [*words[:35], "new", *words[36:]])
    one, two = (
        substring.text_shingles(" ".join([prose(a, 20), *w, prose(b, 20)])) for a, b, w in ((2, 3, words), (4, 5, other))
    )
    wanted = alike_starts(one, two)
    assert wanted
    once = all(len(set(x.tolist())) == len(x) for x in (one, two))
    # candidates share a min-hash at their offset
    mine_by = {}
    for i, j in wanted:
        if (one[i : i + 46] == two[j : j + 46]).any():
            mine_by.setdefault(i - j, []).append((i, j))
    assert mine_by
    for shift, mine in mine_by.items():
        found = substring.alike_passages(one, two, shift)
        hit = {i for x in found for i in range(x[0], x[1])}
        assert found and all(len(hit & set(range(i, i + 50))) >= 45 for i, _ in mine), shift
        assert min(x[0] for x in found) >= min(i for i, _ in mine) and max(x[1] for x in found) <= max(i for i, _ in mine) + 50
        assert not once or substring.alike_passages(one, two, shift, True) == found


def test_an_exact_passage_is_found_behind_a_common_header(spark):
    texts, n, m = {}, 12, 14
    for i in range(n):
        header, words = prose(5000 + i, 60), prose(6000 + i, 60).split()
        for j in range(m):  # all but the last two share min-hashes with those and are not near them
            edits = {j % 5 + k for k in (10, 25, 40)} if j < m - 2 else set()
            own = [f"new{i}x{j}x{k}" if k in edits else w for k, w in enumerate(words)]
            texts[m * i + j] = " ".join([header, prose(7000 + m * i + j, 60), *own, prose(8000 + m * i + j, 30)])
    owners, passages = substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    ids = {r["node"]: r["first_id"] for r in owners.collect()}
    last = {}
    for r in passages.collect():
        last[ids[r["a"]]] = max(last.get(ids[r["a"]], 0), r["a_end"])
    assert all(last[m * i + m - 1] >= 180 for i in range(n))


def some_matches(pattern: str) -> list[str]:
    """Texts a licence pattern can match: every choice of one group or repeat at a time, the rest at its least or most."""
    from re import _constants as sre
    from re import _parser as parser

    def of(items, pick):
        return "".join(one(kind, value, pick) for kind, value in items)

    def one(kind, value, pick):
        if kind is sre.LITERAL:
            return chr(value)
        if kind is sre.IN:
            kind, value = value[pick % len(value)]
            return chr(value) if kind is sre.LITERAL else chr(value[0]) if kind is sre.RANGE else "7"
        if kind is sre.MAX_REPEAT:
            low, high, inner = value
            return of(inner, pick // 2) * (min(high, low + 1) if pick % 2 else low)
        if kind is sre.SUBPATTERN:
            return of(value[3], pick)
        if kind is sre.BRANCH:
            return of(value[1][pick % len(value[1])], pick)
        assert kind is sre.ASSERT_NOT
        return ""

    items = list(parser.parse(pattern))
    out = {of(items, pick) for pick in range(6)}
    for k in range(len(items)):
        out |= {of(items[:k], rest) + of(items[k : k + 1], pick) + of(items[k + 1 :], rest) for pick in range(6) for rest in (0, 1)}
    return sorted({" ".join(x.split()) for x in out})


def test_the_gate_of_a_licence_rule_drops_no_match():
    from wardline.llm.license_rules import FAMILIES

    scanner, tried = licenses.Scanner(), 0

    def ungated(line):
        kept = []
        for rule in scanner.rules:
            for m in rule.pattern.finditer(line):
                first, end = line[: m.start()].count(b" "), line[: m.end()].count(b" ") + 1
                if line[m.end() - 1 : m.end()] == b" ":
                    end -= 1
                if not any(s <= first and end <= e for _, _, s, e in kept):
                    kept.append((rule.label, rule.priority, first, end))
        return sorted(kept, key=lambda x: (x[2], x[3], x[1]))

    for pattern in (p for family in FAMILIES for p in family[-1]):
        for text in some_matches(pattern):
            for around in (text, f"zq {text} zq"):
                words = plain_words(around)
                wanted = ungated(b" ".join(words))
                assert scanner.detect(words, set(words)) == wanted, text
                tried += bool(wanted)
    assert tried > 2 * len(scanner.rules)
    for text, label in (("agplv3 or later", "agpl-3.0-or-later"), ("gplv2 or later", "gpl-2.0-or-later"), ("same terms as perl itself", "artistic")):
        assert [x[0] for x in scanner.detect(text.encode().split(), set(text.encode().split()))] == [label]
