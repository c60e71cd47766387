"""Where results go: partitioned Parquet, CSV, JSON, Markdown and text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.profiles import render_markdown, render_text


def write_events(events: DataFrame, path: str) -> None:
    """All windows in one table, partitioned by window. Clustered on disk by patient within a file;
    the partition count is Spark's, not one task per window."""
    events.sortWithinPartitions("patient_id", "code").write.mode("overwrite").partitionBy("obs_window").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").partitionBy("task").parquet(path)


def iso_time(c: Column) -> Column:
    """ISO 8601, with microseconds only where there are any."""
    micros = F.date_format(c, "SSSSSS")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def csv_view(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text; null becomes an empty field when written."""
    return df.select(
        *[
            iso_time(F.col(f.name)).alias(f.name) if "timestamp" in f.dataType.typeName() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_csv(events: DataFrame, labels: DataFrame, path: str) -> None:
    for name, df in (("events", events), ("labels", labels)):
        csv_view(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/{name}.csv")


#: Stands between two records of a text file: a line of its own that no record holds.
RECORD_END = "\n\x1e\n"


def write_records(records: DataFrame, path: str, fmt: str, *, dataset: str, provider: str, variant: str | None = None) -> str:
    """`<path>/<fmt>/dataset=<dataset>/provider=<provider>[-<variant>]`: JSON records one per line, Markdown and plain
    text as they are, each ended by `RECORD_END`. A second run replaces the records of its provider."""
    label = f"{provider}-{variant}" if variant else provider
    views = {
        "json": lambda: records, "md": lambda: render_markdown(records).select("markdown"),
        "txt": lambda: render_text(records).select("text"),
    }
    if fmt not in views:
        raise ValueError(f"format is one of {sorted(views)}, not {fmt!r}")
    out = f"{path}/{fmt}"
    keyed = views[fmt]().withColumns({"dataset": F.lit(dataset), "provider": F.lit(label)})
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "provider")
    if fmt == "json":
        writer.json(out)
    else:
        writer.option("lineSep", RECORD_END).text(out)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value, dataset, provider): the records that `write_records` wrote as Markdown or plain text, whole."""
    return spark.read.option("lineSep", RECORD_END).text(path)
