"""Star tables to events and labels: one pass over each fact table for all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.operators import cohort as co
from wardline.operators import events as ev
from wardline.operators import history as hi
from wardline.operators import labels as lb
from wardline.operators import measurements as ms
from wardline.operators.concepts import ALL_TASKS, LAB_ITEMS, LAB_NAMES, VITAL_ITEMS, VITAL_NAMES, windows_used
from wardline.session import materialize
from wardline.sources.sinks import write_events, write_labels
from wardline.sources.star import bucket_by_stay


def build_all(
    star: dict[str, DataFrame],
    *,
    tasks=ALL_TASKS,
    min_age: int = 18,
    readmit_days: int = 30,
    los_long_days: float = 7.0,
    mortality_days: int = 365,
    limit: int | None = None,
    vital_items=VITAL_ITEMS,
    lab_items=LAB_ITEMS,
    vital_names=VITAL_NAMES,
    lab_names=LAB_NAMES,
    keep_cohort: bool = True,
    buckets: tuple[str, int] | None = None,
) -> dict[str, DataFrame]:
    """{cohort, events, labels} from {patients, admissions, icustays, chartevents, labevents, diagnoses_icd}.

    Of a star from `bucket_star`, `buckets` names the database and its number of buckets: the cohort is then kept as a
    table in the same buckets, and the facts are neither shuffled nor counted for hot stays.

    The cohort feeds every later step. With `keep_cohort` it is written once and read back, so it is
    not derived again per step and its exact size decides whether the facts are shuffled at all.
    """
    windows = windows_used(tasks)
    index = co.cohort(star["admissions"], star["patients"], star["icustays"], min_age=min_age, limit=limit)
    if buckets:
        index = bucket_by_stay(index, f"{buckets[0]}.cohort", buckets[1], ["hadm_id"])
    elif keep_cohort:
        index = materialize(index, "cohort")
    hot = {name: star.get(f"{name}_hot") for name in ("chartevents", "labevents")}
    anchors = co.stay_windows(index, windows)
    history = hi.admission_history(index, star["admissions"], readmit_days=readmit_days)
    groups = hi.dx_by_index(index, star["admissions"], star["diagnoses_icd"])
    vitals = ms.vital_events(ms.vital_summary(star["chartevents"], index, items=vital_items, windows=windows, hot=hot["chartevents"]), vital_names)
    labs = ms.lab_events(ms.lab_latest(star["labevents"], index, items=lab_items, windows=windows, hot=hot["labevents"]), lab_names)
    events = ev.union_events([vitals, labs], [hi.dx_history_events(groups), hi.utilization_events(history)], anchors)
    labels = lb.labels_long(
        index, history, groups, tasks=tasks, los_long_days=los_long_days, mortality_days=mortality_days
    )
    return {"cohort": index, "events": events, "labels": labels}


def store(parts: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write events and labels, or the one of them that `parts` holds, and read them back: what trains and scores reads
    files, partitioned by window and task, and never runs the build again."""
    writers = {name: write for name, write in (("events", write_events), ("labels", write_labels)) if name in parts}
    for name, write in writers.items():
        write(parts[name], f"{path}/{name}")
    read = lambda name: parts[name].sparkSession.read.schema(parts[name].schema).parquet(f"{path}/{name}")
    return {**parts, **{name: read(name) for name in writers}}
