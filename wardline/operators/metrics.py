"""Quality of predictions: ranking, calibration and error measures, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.ranking import running_totals
from wardline.session import materialize

# Inner edges of ten equal bins as doubles (a value on an edge goes to the upper bin).
ECE_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def bin_edges(n_bins: int) -> tuple[float, ...]:
    return ECE_EDGES if n_bins == 10 else tuple(i * (1.0 / n_bins) for i in range(1, n_bins))


def ece_bin(p: Column, n_bins: int = 10) -> Column:
    """Number of inner edges not above p."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    return F.size(F.filter(edges, lambda e: e <= p))


def _grouped(df: DataFrame, by) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def fold_scores(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """One row per (group, distinct score): `_p`, rows `_n` and positives `_pos`; map-side combined, written once."""
    return materialize(
        df.groupBy(*keys, F.col(score).alias("_p")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos")
        ),
        "scores",
    )


def _ranked(scores: DataFrame, keys: list[str]) -> DataFrame:
    """auroc and auprc per group of folded scores."""
    below = running_totals(scores, keys, "_p", {"_n": "_n_below", "_pos": "_pos_below"})
    whole = scores.groupBy(*keys).agg(F.sum("_n").alias("_all_n"), F.sum("_pos").alias("_all_pos"))
    ranked = below.join(whole, keys)
    neg, neg_below = F.col("_n") - F.col("_pos"), F.col("_n_below") - F.col("_pos_below")
    wins = F.sum(F.col("_pos") * (neg_below + neg / 2.0))
    precision = (F.col("_all_pos") - F.col("_pos_below")) / (F.col("_all_n") - F.col("_n_below"))
    area = F.sum(F.col("_pos") * precision)
    both = (F.col("_all_pos") > 0) & (F.col("_all_pos") < F.col("_all_n"))
    out = ranked.groupBy(*keys, "_all_pos", "_all_n").agg(wins.alias("_w"), area.alias("_a"))
    return out.select(
        *keys,
        F.when(both, F.col("_w") / (F.col("_all_pos").cast("double") * (F.col("_all_n") - F.col("_all_pos")))).alias("auroc"),
        F.when(both, F.col("_a") / F.col("_all_pos")).alias("auprc"),
    )


def ranking_metrics(df: DataFrame, *, by=(), label: str = "y", score: str = "p") -> DataFrame:
    """auroc and auprc per group, null where only one class occurs.

    Rows fold to one per distinct score first, map-side combined; ties are thereby exact (average
    rank, one threshold per score). Sums below a score come from `running_totals`, so a group of any
    size is ranked by many tasks.
    """
    df, keys = _grouped(df, by)
    return _ranked(fold_scores(df, keys, label, score), keys).select(*by, "auroc", "auprc")


def calibration_error(df: DataFrame, *, by=(), label: str = "y", score: str = "p", n_bins: int = 10) -> DataFrame:
    df, keys = _grouped(df, by)
    bins = df.groupBy(*keys, ece_bin(F.col(score), n_bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_conf"), F.avg(label).alias("_acc")
    )
    return (
        bins.groupBy(*keys)
        .agg((F.sum(F.col("_n") * F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n")).alias("calibration_error"))
        .select(*by, "calibration_error")
    )


def brier(df: DataFrame, *, by=(), label: str = "y", score: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"),
    )


def binary_metrics(df: DataFrame, *, by=(), label: str = "y", score: str = "p", n_bins: int = 10) -> DataFrame:
    """n, positives, auroc, auprc, brier, calibration_error: one row per group.

    All six follow from the folded scores, so the scored rows are read once. Labels are 0 and 1.
    """
    df, keys = _grouped(df, by)
    scores = fold_scores(df, keys, label, score)
    p, n, pos = F.col("_p"), F.col("_n"), F.col("_pos")
    bins = scores.groupBy(*keys, ece_bin(p, n_bins).alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"), F.sum(n * p).alias("_sum"),
        F.sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p).alias("_square"),
    )
    sums = bins.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_pos").alias("positives"),
        (F.sum("_square") / F.sum("_n")).alias("brier"),
        (F.sum(F.abs(F.col("_sum") - F.col("_pos"))) / F.sum("_n")).alias("calibration_error"),
    )
    return sums.join(_ranked(scores, keys), keys).select(
        *by, "n", "positives", "auroc", "auprc", "brier", "calibration_error"
    )


def regression_metrics(df: DataFrame, *, by=(), label: str = "y", prediction: str = "pred") -> DataFrame:
    """n, mae, rmse, r2; r2 is null for a single row; for a constant label it is 1 if all hit, else 0.

    One pass: total variation is n times the population variance, which Spark merges stably.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    n, sse, sst = F.col("n"), F.col("_sse"), F.col("n") * F.col("_var")
    constant = F.when(sse == 0, 1.0).otherwise(0.0)
    r2 = F.when(n > 1, F.when(sst > 0, 1.0 - sse / sst).otherwise(constant))
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(y - p)).alias("mae"),
            F.sum((y - p) * (y - p)).alias("_sse"),
            F.var_pop(y).alias("_var"),
        )
        .select(*by, "n", "mae", F.sqrt(sse / n).alias("rmse"), r2.alias("r2"))
    )


def metrics_headline(binary: DataFrame, regression: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, task_group, kind, auroc, auprc, mae, r2), rounded to 3 digits."""
    rows = binary.select("task", "auroc", "auprc").unionByName(
        regression.select("task", "mae", "r2"), allowMissingColumns=True
    )
    return rows.join(tasks.select("task", "task_group", "kind"), "task").select(
        "task", "task_group", "kind", *[F.round(c, 3).alias(c) for c in ("auroc", "auprc", "mae", "r2")]
    )


def solve_intercept(df: DataFrame, latent: str, rate: float, *, points: int = 64, tolerance: float = 1e-12) -> float:
    """b with mean sigmoid(latent + b) = rate, searched on [-20, 20].

    The mean is monotone in b. Each pass over the data tries `points` values of b at once and keeps
    the interval between two of them, so 8 passes do what halving does in 45. Equal latents are
    folded first. What returns to the driver is `points` means.
    """
    folded = materialize(df.groupBy(F.col(latent).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")), "latents")
    low, high = -20.0, 20.0
    while high - low > tolerance:
        step = (high - low) / (points + 1)
        tries = [low + step * (i + 1) for i in range(points)]
        mean = lambda b: F.sum(F.col("n") / (1.0 + F.exp(-(F.col("x") + F.lit(b))))) / F.sum("n")
        means = folded.agg(*[mean(b).alias(f"m{i}") for i, b in enumerate(tries)]).first()
        under = sum(1 for m in means if m < rate)
        new_low = tries[under - 1] if under else low
        new_high = tries[under] if under < points else high
        if (new_low, new_high) == (low, high):
            break
        low, high = new_low, new_high
    return (low + high) / 2.0
