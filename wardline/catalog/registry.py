"""Views of the given tables in the shape of clinical inputs, and the register of queries.

The view texts run in Spark and in the checking database alike; `{STR}` and `{TS}` stand for the type
names, `{LATER}` for all turns from the fifth on as one text, `{table}` for a base table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "adm": """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
       o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440) AS admittime,
       o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440 + 30 + (o_orderkey * 37) % 28800) AS dischtime,
       CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
FROM {orders}""",
    "pat": """
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' WHEN c_custkey % 17 = 1 THEN NULL ELSE 'M' END AS gender,
       CAST(10 + c_custkey % 80 AS INT) AS anchor_age, 1995 AS anchor_year,
       CASE WHEN c_custkey % 3 = 0
            THEN CAST(TIMESTAMP '1997-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 1500) AS DATE) END AS dod
FROM {customer}""",
    "icu": "SELECT l_orderkey AS hadm_id FROM {lineitem} WHERE l_returnflag = 'R'",
    "chart": """
SELECT l_orderkey AS hadm_id, 220000 + l_linenumber AS itemid,
       CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_quantity END AS valuenum,
       o_orderdate + INTERVAL '1' MINUTE * ((l_partkey * 13) % 20000) AS charttime
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "lab": """
SELECT l_orderkey AS hadm_id, 50000 + (l_suppkey + l_linenumber) % 17 AS itemid,
       CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_extendedprice END AS valuenum,
       o_orderdate + INTERVAL '1' MINUTE * ((l_partkey * 7) % 20000 - 1440) AS charttime
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "dx": """
SELECT l_orderkey AS hadm_id,
       CASE l_partkey % 9 WHEN 0 THEN '25000' WHEN 1 THEN '4019' WHEN 2 THEN '2724' WHEN 3 THEN '51881'
            WHEN 4 THEN 'V4581' WHEN 5 THEN 'E11.9' WHEN 6 THEN 'I10 ' WHEN 7 THEN 'j449' ELSE 'F329' END AS icd_code,
       CASE WHEN l_partkey % 9 <= 4 THEN 9 ELSE 10 END AS icd_version
FROM {lineitem}""",
    "ev": """
SELECT CAST(user_id AS {STR}) AS patient_id, ts AS time,
       CASE event_type WHEN 'click' THEN 'ICD10/E11.9' WHEN 'error' THEN 'ENC/ED'
            WHEN 'purchase' THEN 'LAB/HbA1c' WHEN 'signup' THEN 'LAB/eGFR' ELSE 'MED/STATIN' END AS code,
       CASE WHEN event_type IN ('purchase','signup') AND event_id % 10 <> 0 THEN value END AS value,
       CAST(NULL AS {STR}) AS description
FROM {events}""",
    "lb": """
SELECT CAST(user_id AS {STR}) AS patient_id, CAST('2024-01-20 00:00:00' AS {TS}) AS label_time,
       CAST(user_id % 2 AS DOUBLE) AS value, CAST(20 + user_id % 60 AS DOUBLE) AS age,
       CASE WHEN user_id % 3 = 0 THEN 'female' ELSE 'male' END AS sex
FROM (SELECT DISTINCT user_id FROM {events}) u""",
    "scored": "SELECT doc_id AS patient_id, quality AS y, CAST((doc_id * 7919) % 101 AS DOUBLE) / 100 AS p FROM {labels}",
    "responses": """
SELECT conv_id AS patient_id,
       concat('The estimate is about ', CAST(conv_id % 101 AS {STR}), '%. ',
              coalesce(max(CASE WHEN turn = 0 THEN text END), '')) AS s1,
       coalesce(max(CASE WHEN turn = 1 THEN text END), '') AS s2,
       coalesce(max(CASE WHEN turn = 2 THEN text END), '') AS s3,
       coalesce(max(CASE WHEN turn = 3 THEN text END), '') AS s4,
       coalesce({LATER}, '') AS s5,
       CASE WHEN conv_id % 4 = 0 THEN (conv_id + 1) % 101 ELSE conv_id % 101 END AS pct,
       CASE conv_id % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'moderate' ELSE 'higher' END AS confidence_label
FROM {conversations} GROUP BY conv_id""",
}

# predictions of six tasks for every order, and three contributions to each: a scored panel
PANEL_TASKS = (
    (1, "mortality_1y", "forward", "binary"), (2, "readmission_30d", "forward", "binary"),
    (3, "prolonged_stay", "forward", "binary"), (4, "los_days", "forward", "regression"),
    (5, "dx_diabetes", "chronic", "binary"), (6, "dx_hypertension", "chronic", "binary"),
)
PANEL_FEATURES = ("value__LAB/SODIUM", "count__DX/DIABETES", "age")
VIEWS["panel_scores"] = f"""
SELECT CAST(o_orderkey AS {{STR}}) AS patient_id, task, task_group, kind,
       CASE WHEN kind = 'binary' THEN CAST((o_orderkey * 7919 + k * 104729) % 1009 AS DOUBLE) / 1008 END AS probability,
       CASE WHEN kind = 'regression' THEN CAST((o_orderkey * 31) % 977 AS DOUBLE) / 37 END AS point_estimate,
       CAST((o_orderkey * 13 + k * 7) % 100 AS DOUBLE) / 100 AS uncertainty,
       CASE WHEN (o_orderkey * 17 + k * 5) % 100 < 30 THEN 1 ELSE 0 END AS y,
       CAST((o_orderkey * 29) % 1013 AS DOUBLE) / 41 AS days,
       {', '.join(f'CAST((o_orderkey + {i}) % 90 AS DOUBLE) AS value_{i}, CAST((o_orderkey * {17 + i} + k) % 41 - 20 AS DOUBLE) / 20 AS impact_{i}' for i in range(3))}
FROM {{orders}} CROSS JOIN (VALUES {', '.join(f"({k}, '{task}', '{group}', '{kind}')" for k, task, group, kind in PANEL_TASKS)}) AS asked(k, task, task_group, kind)"""
# what was recorded of the same patients in the ninety days before
VIEWS["panel_events"] = """
SELECT CAST(l_orderkey AS {STR}) AS patient_id, CAST(l_shipdate AS {TS}) AS time,
       CASE l_linenumber % 3 WHEN 0 THEN 'ICD10/E11.9' WHEN 1 THEN 'LAB/HbA1c' ELSE 'ENC/ED' END AS code,
       CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END AS value
FROM {lineitem}"""
VIEWS["panel_labels"] = """
SELECT CAST(o_orderkey AS {STR}) AS patient_id, CAST(o_orderdate AS {TS}) + INTERVAL '60' DAY AS label_time,
       CAST(20 + o_orderkey % 60 AS DOUBLE) AS age, CASE WHEN o_orderkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
       CAST(0 AS DOUBLE) AS value
FROM {orders}"""
# item ids of the given tables; the library's own dictionaries hold those of the hospital system
CHART_ITEMS = (
    (220001, "HR", 0), (220002, "RR", 0), (220003, "SPO2", 0), (220004, "TEMP_C", 1),
    (220005, "SBP", 0), (220006, "DBP", 0), (220007, "MBP", 0),
)
BANNED = ("you have ", "the ", " and ")


class Views:
    """The views of one data folder as DataFrames: `v.adm`, `v.chart`, ..., or a base table `v.base('orders')`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        later = "listagg(text, ' ') WITHIN GROUP (ORDER BY turn) FILTER (WHERE turn >= 4)"
        text = VIEWS[name].replace("{STR}", "STRING").replace("{TS}", "TIMESTAMP_NTZ").replace("{LATER}", later)
        view = self.spark.sql(text, **{t: self.base(t) for t in re.findall(r"{(\w+)}", text)})
        setattr(self, name, view)
        return view

    @cached_property
    def cohort(self) -> DataFrame:
        from wardline.operators.cohort import cohort

        return cohort(self.adm, self.pat, self.icu)

    @cached_property
    def lab_items(self):
        from wardline.operators.concepts import LAB_NAMES

        return tuple((50000 + i, code) for i, code in enumerate(LAB_NAMES))

    @cached_property
    def star(self) -> dict[str, DataFrame]:
        return {
            "patients": self.pat, "admissions": self.adm, "icustays": self.icu, "chartevents": self.chart,
            "labevents": self.lab, "diagnoses_icd": self.dx,
        }


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}  # named SQL steps that checks share, beside VIEWS


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def _text(name: str) -> str:
    if name in STEPS:
        return STEPS[name]
    later = "string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn >= 4)"
    text = VIEWS[name].replace("{STR}", "VARCHAR").replace("{TS}", "TIMESTAMP").replace("{LATER}", later)
    return re.sub(r"{(\w+)}", r"\1", text)


def with_steps(sql: str) -> str:
    """Puts the views and steps a check mentions in front of it, in order of need."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if (name in VIEWS or name in STEPS) and name not in order:
                visit(_text(name))
                order.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({_text(n)})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in the types the check compares: whole numbers as bigint, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)  # no negative zero
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    """Registers `fn(views) -> DataFrame` under `name`, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Views(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_steps(oracle)
        return fn

    return add
