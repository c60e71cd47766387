"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of order four, kept as rows: a node's row holds its last symbols packed into one
integer and its count over all training texts. A symbol unseen in a context escapes to the next shorter one, where the
symbols already seen in the longer context are excluded from the counts. Texts are dealt to blocks of bounded size; a
block asks for the words and nodes that occur in it, so neither the vocabulary nor the trie is sent anywhere whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import blank_words, fold, signed, table, utf8, word_hashes
from wardline.session import materialize

ORDER, BITS = 4, 9
#: The symbol before and after a text; bytes are 0..255.
EDGE, SYMBOLS = 256, 257
BLOCK_BYTES = 16 << 20
#: Key of the token that ends a text.
_END = int(np.int64(word_hashes([b""]).view(np.int64)[0]))
_WORD, _NODE = 0, 1


def nodes_of(raw: bytes) -> np.ndarray:
    """One packed node (four context symbols and the next symbol) per byte, and one for the end."""
    symbols = np.full(len(raw) + ORDER + 1, EDGE, np.int64)
    symbols[ORDER : ORDER + len(raw)] = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(raw) + 1, np.int64)
    for i in range(ORDER + 1):
        out = out << BITS | symbols[i : i + len(out)]
    return out


def words_of(text: str | None) -> np.ndarray:
    return np.append(signed(word_hashes(blank_words(text))), _END)


class _Tally:
    """Counts of keys, folded whenever many have gathered."""

    def __init__(self):
        self.waiting, self.size = [], 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > 1 << 22:
            self.fold()

    def fold(self) -> None:
        keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.waiting]), return_counts=True)
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.keys, self.waiting, self.size = both, [], 0


def _asked(rows: pd.DataFrame) -> pd.DataFrame:
    """Every word and node of a block with its count in the block's training texts (0: only in held-out ones)."""
    parts = []
    for kind, of in ((_WORD, words_of), (_NODE, lambda t: nodes_of(utf8(t)))):
        tallies = {False: _Tally(), True: _Tally()}
        for text, held in zip(rows["text"], rows["held_out"], strict=True):
            tallies[bool(held)].add(of(text))
        for held, tally in tallies.items():
            tally.fold()
            keys, counts = tally.keys, tally.counts
            if held:
                keys = np.setdiff1d(keys, tallies[False].keys, assume_unique=True)
                counts = np.zeros(len(keys), np.int64)
            parts.append(pd.DataFrame({"kind": kind, "key": keys, "n": counts}))
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "block", rows["block"].iloc[0])
    return out


def _level(nodes: DataFrame, order: int) -> DataFrame:
    """Counts of the nodes with `order` context symbols."""
    return nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))


def node_scores(nodes: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each node's last symbol in its context, for the nodes (key, n) of full order.

    Method C: with N counts and D distinct symbols left in a context, a symbol has n / (N + D) and the escape
    D / (N + D); a context without any passes on unchanged. Below order 0 the symbols never seen share the rest evenly.
    """
    levels = {ORDER: materialize(nodes, "level4")}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = materialize(_level(levels[k + 1], k), f"level{k}")
    seen = {k: df.where("n > 0") for k, df in levels.items()}
    totals = {
        k: seen[k].groupBy(F.shiftright("key", BITS).alias("context"))
        .agg(F.sum("n").alias(f"N{k}"), F.count("*").alias(f"D{k}"))
        for k in levels
    }
    top = levels[ORDER].withColumn("context", F.shiftright("key", BITS)).join(totals[ORDER], "context", "left")
    known = top.where("n > 0").select("key", F.expr(f"log10(n / (N{ORDER} + D{ORDER}))").alias("value"))
    lost = top.where("n = 0").select(
        "key", F.coalesce(f"D{ORDER}", F.lit(0)).alias("above"),
        F.expr(f"coalesce(log10(D{ORDER} / (N{ORDER} + D{ORDER})), 0D)").alias("value"), F.lit(False).alias("done"),
    )
    for k in range(ORDER - 1, -1, -1):
        low = (1 << BITS * (k + 1)) - 1
        excluded = (
            seen[k + 1].select(F.shiftright("key", BITS).alias("longer"), F.col("key").bitwiseAND(F.lit(low)).alias("key"))
            .join(seen[k].select("key", "n"), "key").groupBy("longer").agg(F.sum("n").alias("X"))
        )
        shorter = F.col("whole").bitwiseAND(F.lit(low))
        lost = (
            lost.withColumnRenamed("key", "whole")
            .withColumns({"key": shorter, "context": F.shiftright(shorter, BITS),
                          "longer": F.shiftright(F.col("whole").bitwiseAND(F.lit((1 << BITS * (k + 2)) - 1)), BITS)})
            .join(seen[k], "key", "left").join(totals[k], "context", "left").join(excluded, "longer", "left")
            .selectExpr("whole as key", "above", "value", "done", "n", f"coalesce(D{k}, 0) as kinds", f"coalesce(N{k}, 0) - coalesce(X, 0) as mass")
            .selectExpr(
                "key", "kinds as above",
                "case when done then value when n is not null then value + log10(n / (mass + kinds - above)) "
                "when kinds > above then value + log10((kinds - above) / (mass + kinds - above)) else value end as value",
                "done or n is not null as done",
            )
        )
    rest = lost.selectExpr("key", f"if(done, value, value - log10({SYMBOLS} - above)) as value")
    return known.unionByName(rest)


def _scored(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    tables = []
    for kind in (_WORD, _NODE):
        own = found[found["kind"] == kind].sort_values("key")
        tables.append((own["key"].to_numpy(), own["value"].to_numpy(), own["known"].to_numpy()))
    out = []
    for text in rows["text"]:
        keys, values, known = tables[_WORD]
        at = np.searchsorted(keys, words_of(text))
        line = [len(at), int(known[at].sum()), float(values[at].sum())]
        keys, values, _ = tables[_NODE]
        out.append([*line, float(values[np.searchsorted(keys, nodes_of(utf8(text)))].sum())])
    made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
    return pd.concat([rows[["doc_id", "held_out"]].reset_index(drop=True), made], axis=1)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_share: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from the texts whose crc32(doc_id) mod `held_share` is not 0. base_score: words with 0.1 added to each count;
    score: log10 probability of the text's bytes and its end under the trie. Words are told apart by 64-bit hashes.

    Null and empty texts are an end only; null ids are in the held-out fold; repeated rows are scored each and counted
    each; no rows give no rows; without training texts every symbol costs log10 257 and a word costs nothing.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (fold(doc_id, held_share) == 0).alias("held_out")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("block", F.expr(f"pmod(xxhash64(doc_id, text), {max(8, size // block_bytes + 1)}L)"))
    asked = materialize(rows.groupBy("block").applyInPandas(_asked, "block bigint, kind int, key bigint, n bigint"), "asked")

    words = materialize(asked.where(f"kind = {_WORD}").groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    floor = 0.1 * (distinct + 1)
    nodes = asked.where(f"kind = {_NODE}").groupBy("key").agg(F.sum("n").alias("n"))
    values = words.selectExpr(
        f"{_WORD} as kind", "key", f"log10((n + 0.1D) / ({tokens} + {floor!r}D)) as value", "n > 0 as known"
    ).unionByName(node_scores(nodes).selectExpr(f"{_NODE} as kind", "key", "value", "true as known"))
    found = asked.select("block", "kind", "key").join(values, ["kind", "key"]).withColumnRenamed("block", "asking")
    scored = rows.groupBy("block").cogroup(found.groupBy("asking")).applyInPandas(_scored, SCORES)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))


def op10_lm_score(spark, sf_dir) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
