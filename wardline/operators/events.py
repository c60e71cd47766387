"""The events + labels contract: union of feature parts, lookback, point-in-time joins, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.functions.ordered import latest_key
from wardline.operators.skew import salted_join
from wardline.session import materialize

#: Label rows of one patient up to which every event is held against each of them.
FEW_RECORDS = 8
#: Days that the running counts of a patient with more label rows are cut into.
SLICE_DAYS = 30

EVENT_COLUMNS = ["patient_id", "time", "code", "value", "description"]
RECORD = ["patient_id", "label_time"]


def union_events(windowed: list[DataFrame], fixed: list[DataFrame], anchors: DataFrame) -> DataFrame:
    """All feature parts as events stamped with the cutoff of their window.

    `windowed` parts carry `obs_window`; `fixed` parts hold for every window. `anchors` is
    (hadm_id, obs_window, cutoff), one row per stay and window.
    """
    columns = ["hadm_id", "obs_window", "cutoff", "code", "value", "description"]
    parts = [p.join(anchors, ["hadm_id", "obs_window"]).select(*columns) for p in windowed]
    parts += [p.join(anchors, "hadm_id").select(*columns) for p in fixed]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("hadm_id").cast("string").alias("patient_id"),
        F.col("cutoff").alias("time"),
        "code",
        "value",
        "description",
        "obs_window",
    )


def standard_events(events: DataFrame) -> DataFrame:
    """Ids as text, values as numbers where they are numbers, optional columns filled with null."""
    for name, kind in (("value", "double"), ("description", "string")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events.select(
        F.col("patient_id").cast("string").alias("patient_id"),
        F.col("time").cast("timestamp_ntz").alias("time"),
        F.col("code").cast("string").alias("code"),
        fn.clean_double(F.col("value").try_cast("double")).alias("value"),
        "description",
    )


def standard_labels(labels: DataFrame) -> DataFrame:
    for name, kind in (("age", "double"), ("sex", "string")):
        if name not in labels.columns:
            labels = labels.withColumn(name, F.lit(None).cast(kind))
    return labels.select(
        F.col("patient_id").cast("string").alias("patient_id"),
        F.col("label_time").cast("timestamp_ntz").alias("label_time"),
        fn.clean_double(F.col("value").try_cast("double")).alias("label"),
        F.col("age").cast("double").alias("age"),
        "sex",
    )


def within_lookback(days: int | None, time: str = "time", anchor: str = "label_time") -> Column:
    """`[anchor - days, anchor]`, both ends included; without `days` only the upper end."""
    upper = F.col(time) <= F.col(anchor)
    if days is None:
        return upper
    return upper & (F.col(time) >= F.col(anchor) - F.expr(f"INTERVAL {int(days)} DAYS"))


def events_before(events: DataFrame, time: Column) -> DataFrame:
    return events.filter(F.col("time") <= time)


def in_lookback(events: DataFrame, labels: DataFrame, days: int | None) -> DataFrame:
    """Events in the window of each label row. A patient with very many events is spread over tasks."""
    joined = salted_join(
        standard_events(events), standard_labels(labels), "patient_id", spread_by=["time", "code", "value"]
    )
    return joined.filter(within_lookback(days))


def windowed_totals(
    events: DataFrame, labels: DataFrame, days: int | None, by: dict[str, Column], *, few: int = FEW_RECORDS,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """(record, by..., n, seen, last): per label row the number of events in its window, and the time and value of the
    latest one that has a value, for each combination of `by` (columns made of an event's).

    Patients with up to `few` label rows are joined and folded. For all others an event would be paired with every
    label row, so their windows are differences of running counts (see `_sliced_totals`); the rows are the same.
    """
    records = standard_labels(labels).select(*RECORD).distinct()
    crowded = records.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select("patient_id")
    if crowded.limit(1).count() == 0:
        return _joined_totals(events, records, days, by)
    crowded = materialize(crowded, "crowded")
    return _joined_totals(events, records.join(crowded, "patient_id", "left_anti"), days, by).unionByName(
        _sliced_totals(events, records.join(crowded, "patient_id", "left_semi"), days, by, slice_days)
    )


def _latest(time: str) -> Column:
    return F.when(F.col("value").isNotNull(), F.struct(F.col(time).alias("seen"), F.col("value").alias("last")))


def _latest_of(df: DataFrame, time: str) -> tuple[Column, Column]:
    """Aggregates: time and value of the latest row that has a value, of equal times the larger value."""
    seen = F.when(F.col("value").isNotNull(), F.col(time))
    return F.max(seen).alias("seen"), F.max_by("value", latest_key(df, time, "value")).alias("last")


def _joined_totals(events: DataFrame, records: DataFrame, days: int | None, by: dict[str, Column]) -> DataFrame:
    window = in_lookback(events, records.withColumn("value", F.lit(None).cast("double")), days).withColumns(by)
    return window.groupBy(*RECORD, *by).agg(F.count(F.lit(1)).alias("n"), *_latest_of(window, "time"))


def _sliced_totals(events: DataFrame, records: DataFrame, days: int | None, by: dict[str, Column], slice_days: int) -> DataFrame:
    """The events up to a label time less those before its window's start, both read off running counts.

    Per patient and `by` the events and the two ends of every window are put in order inside slices of time; what all
    earlier slices hold is added to the counts of a slice. So an event is read once, whatever the number of label rows,
    and no task holds more than a slice of one patient and combination.
    """
    keys = ["patient_id", *by]
    dated = standard_events(events).where("time IS NOT NULL")
    own = dated.join(records.select("patient_id").distinct(), "patient_id", "left_semi").withColumns(by)
    own = materialize(own.select(*keys, F.col("time").alias("at"), "value"), "crowded-events")
    ends = [F.struct(F.col("label_time").alias("at"), F.lit(1).alias("end"))]
    if days is not None:
        start = F.col("label_time") - F.expr(f"INTERVAL {int(days)} DAYS")
        ends.append(F.struct(start.alias("at"), F.lit(-1).alias("end")))
    asked = records.join(own.select(*keys).distinct(), "patient_id").select(*keys, "label_time", F.inline(F.array(*ends)))
    # at one time the start of a window comes before the events, its end after them
    rows = own.withColumn("end", F.lit(0)).unionByName(asked, allowMissingColumns=True).withColumn(
        "slice", F.floor(F.datediff(F.to_date("at"), F.lit("1970-01-01")) / slice_days)
    )
    event = (F.col("end") == 0).cast("bigint")
    whole = rows.groupBy(*keys, "slice").agg(F.sum(event).alias("_n"), *_latest_of(rows, "at")).select(
        *keys, "slice", "_n", F.when(F.col("seen").isNotNull(), F.struct("seen", "last")).alias("_l")
    )
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(
        *keys, "slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.max("_l").over(earlier).alias("_l_before")
    )
    running = Window.partitionBy(*keys, "slice").orderBy("at", "end", "value").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(
        *keys, "slice", "label_time", "end", F.sum(event).over(running).alias("_inside"),
        F.last(_latest("at"), ignorenulls=True).over(running).alias("_l_inside"),
    ).where("end <> 0")
    read = inside.join(before, [*keys, "slice"])
    upto = F.when(F.col("end") == 1, F.coalesce("_l_inside", "_l_before"))
    # a record has one end row, so both maxima are of that row
    out = read.withColumn("_l", upto).groupBy(*RECORD, *by).agg(
        F.sum(F.col("end") * (F.col("_before") + F.col("_inside"))).alias("n"), F.max("_l.seen").alias("_seen"), F.max("_l.last").alias("_last")
    ).where("n > 0")
    within = F.lit(True) if days is None else F.col("_seen") >= F.col("label_time") - F.expr(f"INTERVAL {int(days)} DAYS")
    return out.select(*RECORD, *by, "n", *[F.when(within, F.col(f"_{c}")).alias(c) for c in ("seen", "last")])


def labelled_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Every label row with every event of its patient; a label row without events keeps one row.

    The inner part is salted; the rest are the label rows whose patient is absent from the distinct
    patients of `events`. Together they are the left join, with no task holding one patient's events.
    """
    ev, lb = standard_events(events), standard_labels(labels)
    inner = salted_join(ev, lb, "patient_id", spread_by=["time", "code", "value"])
    alone = lb.join(ev.select("patient_id").distinct(), "patient_id", "left_anti")
    for field in ev.schema.fields:
        if field.name != "patient_id":
            alone = alone.withColumn(field.name, F.lit(None).cast(field.dataType))
    return inner.unionByName(alone)


def snapshot(events: DataFrame, labels: DataFrame, *, lookback_days: int) -> DataFrame:
    """Current state per record: conditions, latest observations, recent encounters.

    Rows are first reduced to one per (record, label text), map-side combined; only these few reach
    the nested arrays.
    """
    text = F.coalesce(F.nullif("description", F.lit("")), F.col("code"))
    by = {"name": text, "is_icd": F.col("code").startswith("ICD"), "is_enc": F.col("code").startswith("ENC")}
    per_label = windowed_totals(events, labels, lookback_days, by)
    # one name may come from ICD and other codes alike: the later reading wins over both
    observed = per_label.groupBy(*RECORD, "name").agg(
        F.max("is_icd").alias("is_icd"),
        F.max_by("last", latest_key(per_label, "seen", "last")).alias("latest"),
        F.sum(F.when(F.col("is_enc"), F.col("n")).otherwise(0)).alias("n_enc"),
    )
    entry = F.when(F.col("latest").isNotNull(), F.struct("name", F.bround("latest", 1).alias("value")))
    per_record = observed.groupBy(*RECORD).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_icd"), F.col("name")))).alias("active_conditions"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("recent_observations"),
        F.sum("n_enc").cast("int").alias("n_recent_encounters"),
    )
    none = F.array().cast("array<string>")
    return (
        standard_labels(labels)
        .join(per_record, RECORD, "left")
        .select(
            *RECORD,
            "age",
            "sex",
            F.coalesce("active_conditions", none).alias("active_conditions"),
            F.coalesce("recent_observations", F.create_map().cast("map<string,double>")).alias("recent_observations"),
            F.coalesce("n_recent_encounters", F.lit(0)).alias("n_recent_encounters"),
        )
    )
