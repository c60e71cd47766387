"""The hospital star: gzipped CSV with fixed schemas, converted once to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.operators.skew import ROWS_PER_SALT, hot_keys

# The columns read, with their types. Code columns stay text: their leading zeros and
# letters count, and inference would cost a pass over files that cannot be split.
STAR_SCHEMAS = {
    "hosp/patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, dod date",
    "hosp/admissions": "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz,"
    " hospital_expire_flag int",
    "icu/icustays": "hadm_id bigint",
    "icu/chartevents": "hadm_id bigint, itemid bigint, valuenum double, charttime timestamp_ntz",
    "hosp/labevents": "hadm_id bigint, itemid bigint, valuenum double, charttime timestamp_ntz",
    "hosp/diagnoses_icd": "hadm_id bigint, icd_code string, icd_version string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def resolve_root(spark: SparkSession, root: str) -> str:
    """The folder that holds hosp/ and icu/: `root` itself, or the first by name one level below a
    `mimiciv` folder at any depth under it."""
    if _exists(spark, f"{root}/hosp") and _exists(spark, f"{root}/icu"):
        return root
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [top] if files.exists(top) else []
    while level:
        below = [s.getPath() for path in level for s in files.listStatus(path) if s.isDirectory()]
        found += [p for p in below if p.getParent().getName() == "mimiciv"]
        level = below
    for parent in sorted(p.toString() for p in found):
        if _exists(spark, f"{parent}/hosp") and _exists(spark, f"{parent}/icu"):
            return parent
    raise FileNotFoundError(f"no folder with hosp/ and icu/ under {root}")


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table by logical name. Only the listed columns are parsed, by header name."""
    schema = STAR_SCHEMAS[table]
    path = f"{root}/{table}.csv.gz"
    if not _exists(spark, path):
        raise FileNotFoundError(f"star table not found: {path}")
    wanted = [c.strip().split(" ") for c in schema.split(",")]
    raw = spark.read.option("header", True).csv(path)  # all text; the header alone is read here
    require = sorted({name for name, _ in wanted} - set(raw.columns))
    if require:
        raise ValueError(f"{path}: missing required columns {require}")
    return raw.selectExpr(*[f"CAST({name} AS {kind}) AS {name}" for name, kind in wanted])


def read_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables by short name (`patients`, `admissions`, ...)."""
    base = resolve_root(spark, root)
    return {name.split("/")[1]: scan(spark, base, name) for name in STAR_SCHEMAS}


def convert_star(spark: SparkSession, root: str, out: str, *, fact_partitions: int | None = None) -> None:
    """One-off conversion to Parquet. A gz file is one task to read; facts in fewer files than there are cores, or than
    `fact_partitions`, are spread out before they are written, so every later scan splits, prunes columns and skips row
    groups by item. Facts in more files are written as they are read, without a shuffle."""
    enough = fact_partitions or spark.sparkContext.defaultParallelism
    for name, df in read_star(spark, root).items():
        if name in ("chartevents", "labevents"):
            if len(df.inputFiles()) < enough:
                df = df.repartition(*([fact_partitions] if fact_partitions else []), "hadm_id", "itemid", "charttime")
            df = df.sortWithinPartitions("itemid")
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def bucket_star(
    star: dict[str, DataFrame], database: str, *, buckets: int, rows_per_salt: int = ROWS_PER_SALT,
) -> dict[str, DataFrame]:
    """The star as tables of `database` in the session's warehouse, for builds that run more than once.

    The facts lie in `buckets` buckets by stay, each sorted by stay and time, so a join with a cohort in the same buckets
    (`bucket_by_stay`) and the aggregate above it move no row of a fact. Beside each fact stands the table of its
    hot stays, `<fact>_hot`: whoever reads the fact need not count its keys again. Tables that stand there are replaced.
    """
    spark = next(iter(star.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in star.items():
        if name not in ("chartevents", "labevents"):
            df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
            continue
        bucket_by_stay(df, f"{database}.{name}", buckets, ["hadm_id", "charttime"])
        hot = hot_keys(spark.table(f"{database}.{name}"), "hadm_id", rows_per_salt=rows_per_salt)
        hot.write.mode("overwrite").saveAsTable(f"{database}.{name}_hot")
    return bucketed_star(spark, database)


def bucket_by_stay(df: DataFrame, table: str, buckets: int, order: list[str]) -> DataFrame:
    """`df` as a table in buckets by stay. One task writes one bucket's file, so the sort of the files is the table's."""
    df.repartition(buckets, "hadm_id").write.mode("overwrite").bucketBy(buckets, "hadm_id").sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def bucketed_star(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """What `bucket_star` wrote, by short name; the hot stays of a fact as `<fact>_hot`."""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{database}`").collect()]
    return {n: spark.table(f"{database}.{n}") for n in names}
