"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the text under a byte-trigram model of each language, the language that
the markup declares, the suffix of the address, and a prior of the host. Suffix, declaration and host tables are grouped
sums of the texts' own posteriors; a host's prior is smoothed towards its domain's, and that towards all pages'.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import WORDED, fold, pieces, table, utf8
from wardline.session import materialize

BUCKETS = 1 << 14
#: Trigrams that a text's evidence counts as at most (neighbours are not independent), and languages at most.
WEIGHT, MAX_LANGUAGES = 64, 512
#: Weight of the broader level in a host's and a domain's prior, in pages, and of each outcome in a likelihood.
PULL, EXTRA = 5.0, 0.5
_SCALE = 1_000_000


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text with blanks for ASCII separators."""
    b = np.frombuffer(b" " + raw.translate(WORDED) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def _counting(batches):
    """(lang, bucket, n) of a task's texts."""
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, own in counts.items():
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(own[hit])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts and len(counts) >= 64:
                yield from out()
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(utf8(text)), minlength=BUCKETS)
    yield from out()


def train_texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of every bucket in each, from all rows with a language.

    The model is one table for all languages; more than MAX_LANGUAGES distinct values are an error, as the column then
    holds something else.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    found = rows.mapInArrow(_counting, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = materialize(found, "trigrams")
    languages = sorted(r["lang"] for r in found.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the column holds something else")
    counts = np.full((BUCKETS, max(1, len(languages))), 0.5)
    for r in found.toLocalIterator():  # at most BUCKETS rows a language
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


_OPENS = re.compile(rb"(?i)<(?:(script|style)\b|(!--))?")
_CLOSES = re.compile(rb"(?i)</(script|style)\s*>")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,8})")
_CONTENT = re.compile(rb"(?is)<meta\b[^>]*content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,8})")


def visible(raw: bytes) -> bytes:
    """Markup with a blank in place of each script, style, comment and tag; one that is never closed ends as a tag.

    Closing marks are looked up once, in order, so the time follows the length whatever stays open.
    """
    ends: dict[bytes, list[tuple[int, int]]] = {b"script": [], b"style": []}
    for found in _CLOSES.finditer(raw):
        ends[found[1].lower()].append(found.span())
    parts, at, comments = [], 0, True
    while found := _OPENS.search(raw, at):
        stop = -1
        if kind := found[1]:
            own = ends[kind.lower()]
            nearest = bisect_left(own, (found.end(), 0))
            stop = own[nearest][1] if nearest < len(own) else -1
        elif found[2] and comments:
            stop = raw.find(b"-->", found.end()) + 3
            if stop == 2:
                stop, comments = -1, False
        if stop < 0:
            stop = raw.find(b">", found.start() + 1) + 1
            if not stop:
                break
        parts += [raw[at : found.start()], b" "]
        at = stop
    return b"".join([*parts, raw[at:]])


def _evidence(model: np.ndarray, markup: bool):
    """Adds `likelihood` (per language) and `declared`, for rows (…, text)."""

    def run(batches):
        for batch in pieces(batches):
            logs, declared = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                raw, said = utf8(text), None
                if markup:
                    if found := _DECLARED.search(raw) or _CONTENT.search(raw):
                        said = found[1].lower().decode()
                    raw = visible(raw)
                grams = trigrams(raw) if raw.strip() else np.empty(0, np.int64)
                total = model[grams].sum(axis=0, dtype=np.float64) * (min(1.0, WEIGHT / len(grams)) if len(grams) else 0)
                logs.append(total - total.max() if len(total) else total), declared.append(said)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(logs, pa.list_(pa.float64())), pa.array(declared, pa.string())],
                names=[*batch.schema.names[:-1], "likelihood", "declared"],
            )

    return run


def _softmax(logs: str) -> str:
    return f"transform({logs}, x -> exp(x - array_max({logs})) / aggregate({logs}, 0D, (s, y) -> s + exp(y - array_max({logs}))))"


def fuse(items: DataFrame, languages: list[str], pull: float = PULL) -> DataFrame:
    """`items` (host, domain, suffix, declared, likelihood, …) with `language`, `confidence` and `posterior`.

    An item's own share is taken out of the host and domain sums before they become its prior. A null declaration,
    suffix or host is no evidence.
    """
    n = len(languages)
    shares = materialize(items.withColumn("share", F.expr(f"transform({_softmax('likelihood')}, x -> cast(round(x * {_SCALE}) as bigint))")), "shares")

    def sums(key: str, name: str) -> DataFrame:
        by = shares.where(F.col(key).isNotNull()).groupBy(key)
        return by.agg(F.array(*[F.sum(F.col("share")[i]) for i in range(n)]).alias(name))

    total = shares.agg(*[F.sum(F.col("share")[i]).alias(f"t{i}") for i in range(n)]).first()
    world = np.array([(total[i] or 0) / _SCALE + 1 for i in range(n)])
    everywhere = "array(" + ", ".join(f"{x!r}D" for x in (world / world.sum()).tolist()) + ")"
    each = "array(" + ", ".join(f"{x!r}D" for x in world.tolist()) + ")"
    whole = f"/ {_SCALE}D"

    def smoothed(counts: str, broader: str) -> str:
        own = f"transform(zip_with(coalesce({counts}, share), share, (a, b) -> greatest(a - b, 0L)), x -> x {whole})"
        size = f"aggregate({own}, 0D, (s, x) -> s + x)"
        return f"zip_with({own}, {broader}, (x, p) -> (x + {pull}D * p) / ({size} + {pull}D))"

    def likelihood(counts: str, outcomes: int) -> str:
        """Of the outcome in each language; even where nothing was seen."""
        return f"coalesce(zip_with({counts}, {each}, (x, t) -> ln((x {whole} + {EXTRA}D) / (t + {EXTRA * (outcomes + 1)}D))), array_repeat(0D, {n}))"

    said, tails = (materialize(sums(k, f"{k}_sums"), k) for k in ("declared", "suffix"))
    logs = ["likelihood", likelihood("declared_sums", said.count()), likelihood("suffix_sums", tails.count()), "transform(prior, p -> ln(p))"]
    added = logs[0]
    for one in logs[1:]:
        added = f"zip_with({added}, {one}, (a, b) -> a + b)"
    return (
        shares.join(sums("host", "host_sums"), "host", "left").join(sums("domain", "domain_sums"), "domain", "left")
        .join(said, "declared", "left").join(tails, "suffix", "left")
        .withColumn("broader", F.expr(smoothed("domain_sums", everywhere)))
        .withColumn("prior", F.expr(smoothed("host_sums", "broader")))
        .withColumn("logs", F.expr(added)).withColumn("posterior", F.expr(_softmax("logs")))
        .withColumn("confidence", F.array_max("posterior"))
        .withColumn("language", F.element_at(F.array(*map(F.lit, languages)), F.array_position("posterior", F.col("confidence")).cast("int")))
        .drop("share", "host_sums", "domain_sums", "declared_sums", "suffix_sums", "broader", "logs")
    )


def _host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def identify(
    docs: DataFrame, pages: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", page_id: str = "page_id",
) -> DataFrame:
    """One row per page and per document: doc_id, page_id (one of them null), host, declared, language, confidence.

    A page's text is its markup without tags, scripts and styles; a document's `source` stands for its host and it has
    no declaration and no suffix; its `lang` is not read. Null and empty texts are judged by the other evidence, then by
    the prior. Repeated rows are judged each and counted each; without languages every language is null.
    """
    languages, logs = model
    if not languages:
        languages = [None]
    shape = "id bigint, host string, domain string, suffix string, likelihood array<double>, declared string"
    of_pages = pages.select(
        F.col(page_id).cast("bigint").alias("id"), _host(F.col("url")).alias("host"), F.col("html").alias("text")
    ).select(
        "id", "host", F.substring_index("host", ".", -2).alias("domain"),
        F.when(F.col("host").rlike(r"\.[a-z]+$"), F.substring_index("host", ".", -1)).alias("suffix"), "text",
    ).mapInArrow(_evidence(logs, True), shape).withColumn("page", F.lit(True))
    of_docs = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.col("source").cast("string").alias("host"), F.col("source").cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"), F.col("text").alias("text"),
    ).mapInArrow(_evidence(logs, False), shape).withColumn("page", F.lit(False))
    return fuse(of_pages.unionByName(of_docs), languages).select(
        F.when(~F.col("page"), F.col("id")).alias("doc_id"), F.when(F.col("page"), F.col("id")).alias("page_id"),
        "host", "declared", "language", "confidence",
    )


def op7_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taught = docs.where(fold() != 0)
    return identify(docs, table(spark, sf_dir, "pages"), train_texts(taught))
