"""Long events to the wide feature matrix: vocabulary, counts, latest values, alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators.concepts import DEFAULT_NUMERIC_CODES, window_tag
from wardline.operators.events import RECORD, standard_events, standard_labels, windowed_totals
from wardline.operators.ranking import exact_median, hash_rank
from wardline.session import inline_table

DEMOGRAPHIC = ("age", "sex_female", "n_events")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Vocabulary:
    """Ordered codes with a count column and those with a value column too."""

    codes: tuple[str, ...]
    numeric: tuple[str, ...]

    @property
    def labels(self) -> dict[str, str]:
        """The code as it stands in column names: codes that differ in case only get a number, as column
        names do not tell case apart."""
        seen: dict[str, int] = {}
        out = {}
        for code in self.codes:
            n = seen[code.lower()] = seen.get(code.lower(), 0) + 1
            out[code] = code if n == 1 else f"{code}~{n}"
        return out

    @property
    def feature_names(self) -> list[str]:
        labels = self.labels
        return (
            [f"count__{labels[c]}" for c in self.codes] + [f"value__{labels[c]}" for c in self.numeric]
            + list(DEMOGRAPHIC)
        )


def fold(events: DataFrame, labels: DataFrame, *, lookback_days: int) -> DataFrame:
    """(record, code, n, last), the one pass over the events: vocabulary and matrix both follow from it. Write it once
    (`materialize`) where both are wanted."""
    return windowed_totals(events, labels, lookback_days, {"code": F.col("code")}).drop("seen")


def code_doc_freq(folded: DataFrame) -> DataFrame:
    """(code, doc_freq): records with the code in their window."""
    return folded.groupBy("code").agg(F.count(F.lit(1)).alias("doc_freq"))


def vocab_topn(doc_freq: DataFrame, max_features: int) -> DataFrame:
    """The most frequent codes, by name on a tie; `max_features` is the width of the matrix."""
    return doc_freq.orderBy(F.desc("doc_freq"), "code").limit(max_features)


def numeric_codes(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Codes that carry a number in any event of a labelled patient, window or not.

    Reduced to distinct (patient, code) before the semi join, so no patient weighs more than its codes.
    """
    carried = standard_events(events).filter(F.col("value").isNotNull()).select("patient_id", "code").distinct()
    patients = standard_labels(labels).select("patient_id").distinct()
    return carried.join(patients, "patient_id", "left_semi").select("code").distinct()


def fit_vocab(
    events: DataFrame,
    labels: DataFrame,
    *,
    lookback_days: int = 365,
    max_features: int = 200,
    numeric: str | tuple[str, ...] | None = None,
    folded: DataFrame | None = None,
) -> Vocabulary:
    """Learn the columns. What comes to the driver is the column list, `max_features` names at most.

    `folded` is `fold(events, labels)` where it exists already.
    """
    if folded is None:
        folded = fold(events, labels, lookback_days=lookback_days)
    top = vocab_topn(code_doc_freq(folded), max_features)
    if numeric == "auto":
        found = numeric_codes(events, labels).withColumn("is_numeric", F.lit(True))
        top = top.join(found, "code", "left")
    else:
        top = top.withColumn("is_numeric", F.lit(None).cast("boolean"))
    rows = sorted(top.collect(), key=lambda r: (-r["doc_freq"], r["code"]))
    codes = tuple(r["code"] for r in rows)
    if numeric == "auto":
        return Vocabulary(codes, tuple(r["code"] for r in rows if r["is_numeric"]))
    wanted = DEFAULT_NUMERIC_CODES if numeric is None else tuple(numeric)
    return Vocabulary(codes, tuple(c for c in wanted if c in codes))


def matrix(
    events: DataFrame, labels: DataFrame, vocab: Vocabulary, *, lookback_days: int = 365, folded: DataFrame | None = None
) -> DataFrame:
    """One row per label row with the columns of `vocab.feature_names`.

    The folded events of a record, one per code, are gathered by position in the vocabulary: one shuffle, and
    as many cells as the matrix is wide. Codes outside the vocabulary count in `n_events` only.
    """
    if folded is None:
        folded = fold(events, labels, lookback_days=lookback_days)
    place = inline_table(folded.sparkSession, enumerate(vocab.codes), "pos int,code string")
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", F.struct("n", "last").alias("x")))
    wide = (
        folded.join(place, "code", "left").groupBy(*RECORD)
        .agg(F.map_from_entries(F.collect_list(cell)).alias("cells"), F.sum("n").alias("total"))
    )
    labels_of, at = vocab.labels, {c: i for i, c in enumerate(vocab.codes)}
    cell_of = lambda c: F.try_element_at("cells", F.lit(at[c]))
    return (
        standard_labels(labels)
        .join(wide, RECORD, "left")
        .select(
            *RECORD,
            *[F.coalesce(cell_of(c)["n"], F.lit(0)).cast("double").alias(f"count__{labels_of[c]}") for c in vocab.codes],
            *[cell_of(c)["last"].alias(f"value__{labels_of[c]}") for c in vocab.numeric],
            "age",
            fn.sex_female(F.col("sex")).alias("sex_female"),
            F.coalesce("total", F.lit(0)).cast("double").alias("n_events"),
        )
    )


def matrix_long(wide: DataFrame, features: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, pos, feature, value): a narrow unpivot, feature order kept in `pos`."""
    ids = RECORD if ids is None else ids
    cells = [
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), quoted(f).cast("double").alias("value"))
        for i, f in enumerate(features)
    ]
    return wide.select(*ids, F.explode(F.array(*cells)).alias("c")).select(*ids, "c.*")


def allowed_features(names: list[str], excluded_prefixes) -> list[str]:
    """Columns whose code starts with none of the prefixes: what a task may see."""
    hidden = tuple(excluded_prefixes)
    return [n for n in names if not n.partition("__")[2].startswith(hidden)] if hidden else list(names)


def leakage_exclusion(features: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same rule on tables: (task, feature) pairs that remain; `prefixes` is (task, prefix)."""
    code = fn.strip_prefix(F.col("feature"))
    return features.join(
        prefixes, (features["task"] == prefixes["task"]) & code.startswith(F.col("prefix")), "left_anti"
    )


def align(wide: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Matrix rows with label and split; a matrix row without either is an error when it is reached."""
    own = [c for c in RECORD if c in labels.columns]  # labels without a time hold for all of a patient's records
    keyed = labels.select(*own, F.col("value").alias("label"), F.lit(True).alias("_labelled"))
    joined = wide.join(keyed, own, "left").join(splits, "patient_id", "left")
    complete = F.col("_labelled").isNotNull() & F.col("split").isNotNull()
    message = F.concat(F.lit("no label or split for patient "), "patient_id")
    # raise_error rides on a column that is always read
    checked = F.when(complete, F.col("split")).otherwise(F.raise_error(message).cast("string"))
    return joined.withColumn("split", checked).drop("_labelled")


def align_tasks(wide: DataFrame, labels: DataFrame, splits: DataFrame, tasks) -> DataFrame:
    """The matrix with its split and one column `label__<task>` per task: what all tasks of a window
    train on, so the matrix is joined and written once, not once per task. A label belongs to the record
    (patient, label time); a record without one of the labels or a patient without a split is an error."""
    names = [t.name for t in tasks]
    own = labels.filter(F.col("task").isin(names))
    keys = [c for c in RECORD if c in labels.columns]
    values = own.groupBy(*keys).agg(
        *[F.max(F.when(F.col("task") == n, F.col("value"))).alias(f"label__{n}") for n in names]
    )
    joined = wide.join(values, keys, "left").join(splits, "patient_id", "left")
    complete = F.col("split").isNotNull()
    for n in names:
        complete = complete & quoted(f"label__{n}").isNotNull()
    message = F.concat(F.lit("no label or split for patient "), "patient_id")
    return joined.withColumn("split", F.when(complete, F.col("split")).otherwise(F.raise_error(message).cast("string")))


def cross_window_align(by_window: dict[int | None, DataFrame]) -> DataFrame:
    """Matrices of several windows side by side, one row per stay of a patient, columns suffixed by the window.

    A stay's label times differ between the windows. The order of a patient's stays does not, so the records of a
    patient are numbered by label time in each window and equal numbers meet (see `stay`).
    """
    out = None
    for hours, wide in by_window.items():
        tag = window_tag(hours)
        part = wide.withColumn("stay", stay()).select(
            "patient_id", "stay", *[quoted(c).alias(f"{c}@{tag}") for c in wide.columns if c not in RECORD]
        )
        out = part if out is None else out.join(part, ["patient_id", "stay"])
    return out


def stay() -> Column:
    """Number of a patient's record in the order of label time; a window partition is the records of one patient."""
    return F.row_number().over(Window.partitionBy("patient_id").orderBy("label_time"))


def feature_map(wide: DataFrame, features: list[str], *, beside: list[str] | None = None) -> DataFrame:
    """Feature vector as a map, rounded to 4 digits, missing values kept as null; columns of `beside` are kept too."""
    cells = [F.struct(F.lit(f).alias("key"), F.round(quoted(f).cast("double"), 4).alias("value")) for f in features]
    return wide.select(*RECORD, *(beside or []), F.map_from_entries(F.array(*cells)).alias("features"))


def stride_sample(ids: DataFrame, id_col: str, *, target: int = 4000, seed: int = 42) -> DataFrame:
    """Every step-th id in hash order, step = max(1, n // target): the background sample."""
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(ids, id_col, seed=seed)
    step = F.greatest(F.lit(1), F.floor(n.scalar() / F.lit(target)))
    return ranked.filter(F.pmod(F.col("rank") - 1, step) == 0).select(id_col, "rank")


def feature_medians(wide: DataFrame, features: list[str]) -> DataFrame:
    """Exact median per feature over the whole matrix, missing values skipped."""
    return exact_median(matrix_long(wide, features, ids=[]).drop("pos"), ["feature"], "value")


# Fixed value: the note of a raw payload.
RAW_NOTE = "Raw recorded clinical values. No model prediction or score is provided."


def raw_payload(wide: DataFrame, features: list[str], concepts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Readable raw values per record, without any score: demographics, vitals, labs, past conditions, admissions, note.

    `labels` (patient_id, label_time, sex) tells the sex as it was recorded; without it there is none, as the matrix
    only knows female from other.
    """
    # one row per matrix column and name comes to the driver: the entries are picked and put in order inside the row
    columns = inline_table(wide.sparkSession, enumerate(features), "pos int,feature string").withColumn("code", fn.strip_prefix(F.col("feature")))
    known = columns.join(concepts.select("code", F.col("name").alias("concept")), "code", "left").select(
        "pos", "feature", F.coalesce("concept", "code").alias("concept"), fn.code_family(F.col("code")).alias("family"),
    ).collect()
    known.sort(key=lambda r: (r["concept"].encode("utf-8"), r["pos"]))
    value = lambda r: quoted(r["feature"]).cast("double")
    of = lambda family, prefix: [r for r in known if r["family"] == family and r["feature"].startswith(prefix)]

    def measured(family: str) -> Column:
        entry = lambda r: F.struct(F.lit(r["concept"]).alias("concept"), F.lit(r["pos"]).alias("pos"), F.bround(value(r), 2).alias("value"))
        cells = [F.when(value(r).isNotNull(), entry(r)) for r in of(family, "value__")]
        return F.array_compact(F.array(*cells).cast("array<struct<concept:string,pos:int,value:double>>")).alias(family)

    past = [F.when(value(r) >= 1, F.lit(r["concept"])) for r in of("DX", "")]
    admissions = [F.bround(value(r), 1) for r in of("UTIL", "value__")]
    rows = wide.where(F.exists(F.array(*[quoted(f).cast("double") for f in features]), lambda x: x.isNotNull())).select(
        *RECORD, measured("VITAL"), measured("LAB"), F.array_compact(F.array(*past).cast("array<string>")).alias("past"),
        F.array_max(F.array(*admissions).cast("array<double>")).alias("admissions"),
        (F.col("age").cast("double") if "age" in features else F.lit(None).cast("double")).alias("age"),
    )
    # every group is one matrix row, or as many as repeat it
    joined = lambda name: F.flatten(F.collect_list(name))
    grouped = rows.groupBy(*RECORD).agg(
        F.sort_array(joined("VITAL")).alias("VITAL"), F.sort_array(joined("LAB")).alias("LAB"),
        F.sort_array(F.array_distinct(joined("past"))).alias("past_conditions"),
        F.max("admissions").alias("prior_admissions"), F.max("age").alias("age"),
    )

    def as_map(name: str) -> Column:
        """Of two columns with one name the later one counts."""
        cells = F.col(name)
        last = F.filter(cells, lambda x, i: F.coalesce(F.get(cells, i + 1)["concept"] != x["concept"], F.lit(True)))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["concept"], x["value"])))

    sexes = None if labels is None else standard_labels(labels).groupBy(*RECORD).agg(F.max("sex").alias("sex"))
    known = grouped.withColumn("sex", F.lit(None).cast("string")) if sexes is None else grouped.join(sexes, RECORD, "left")
    return known.select(
        *RECORD, "age", "sex", F.struct("age", "sex").alias("demographics"), as_map("VITAL").alias("vital_signs"),
        as_map("LAB").alias("lab_results"), "past_conditions", "prior_admissions", F.lit(RAW_NOTE).alias("note"),
    )
