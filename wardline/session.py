"""Session set-up, shared folder, inline tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName("wardline")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only where that is unset and the master is local (tests on one machine) a folder of our own is made
    and set; on a cluster its absence is an error, as other machines do not see a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def run_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one; all that is written between steps lies there."""
    return f"{shared_dir(spark)}/wardline-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the application's folder. Call it when all results are written: frames made by
    `materialize` read from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts lineage so that a lost executor costs a re-read and not a re-run, and gives Catalyst exact
    file sizes, by which it chooses broadcast or shuffle for what follows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to `path` has ended well: Spark sets its mark when all tasks have committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed dimension as a VALUES relation.

    Catalyst knows its exact size, so joins to it are broadcast without a hint.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    rows = list(rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS `{name}`" for i, (name, kind) in enumerate(fields))
    if not rows:
        nulls = ", ".join("NULL" for _ in fields)
        return spark.sql(f"SELECT {casts} FROM VALUES ({nulls}) AS t({names}) WHERE false")
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
