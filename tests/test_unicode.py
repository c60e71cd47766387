"""Text rules where blanks and digits are not ASCII, and the concept override file."""

import json
import re

import pytest
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import guardrails as gr
from wardline.operators.concepts import builtin_concepts, override_concepts
from wardline.session import scratch_path
from wardline.sources.tables import read_overrides

TEXTS = [
    "", " ", " 　", " \n\x1c", "\x0b", "about 42 % of", "٤٢% and ٧ %", "१२३४%", "𝟕𝟖%", "x　 9 %", "100%200 %",
    "One　two three. Four five!", "​word", " a᠎b", "your (sodium), level.", None,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def test_rules_are_those_of_unicode(rows):
    got = {
        r["i"]: r for r in rows.select(
            "i", tx.stripped(F.col("t")).alias("stripped"), tx.percentages(F.col("t")).alias("percentages"),
            tx.words_of(F.col("t")).alias("words"), tx.clarity_score([F.col("t")]).alias("clarity"),
        ).collect()
    }
    for i, text in enumerate(TEXTS):
        text = text or ""
        assert got[i]["stripped"] == text.strip()
        assert set(got[i]["percentages"]) == {int(m) for m in re.findall(r"(\d{1,3})\s*%", text)}
        assert got[i]["words"] == [w.lower().strip(",.()") for w in text.split()]
        sentences = [s for s in re.split(r"[.!?\n]", text) if s.strip()]
        want = 0.0
        if sentences:
            mean = sum(len(s.split()) for s in sentences) / len(sentences)
            want = round(0.5 * max(0.0, 1.0 - abs(mean - 15) / 25.0) + 0.5 * bool(text.strip()), 3)
        assert got[i]["clarity"] == pytest.approx(want)


def test_a_section_of_blanks_is_empty(spark):
    df = spark.createDataFrame([(" 　", "x")], "a string, b string")
    assert df.select(tx.missing_sections([F.col("a"), F.col("b")], ("A", "B")).alias("m")).first()["m"] == ["A"]
    parsed = gr.parse_sections(spark.createDataFrame([(" ",), ('　{"A":" text "}',)], "t string"), "t", ("A",) * 5)
    assert [r["parse_error"] for r in parsed.collect()][0] is True


@pytest.mark.parametrize("kind", ["json", "yaml", "csv", "parquet"])
def test_overrides_from_a_file(spark, tmp_path, kind):
    entries = {"age": {"name": "Years", "patient_phrase": "your years", "higher_is_concerning": False}, "NEW/1": {"name": "New"}}
    path = str(tmp_path / f"over.{kind}")
    if kind in ("json", "yaml"):
        with open(path, "w") as out:
            out.write(json.dumps(entries))
    else:
        path = f"{scratch_path(spark, 'over')}.{kind}"
        table = spark.createDataFrame([("age", "Years", "your years", False), ("NEW/1", "New", None, None)], "code string, name string, patient_phrase string, higher_is_concerning boolean")
        (table.write.option("header", True).csv if kind == "csv" else table.write.parquet)(path)
    got = {r["code"]: r for r in override_concepts(builtin_concepts(spark), read_overrides(spark, path)).collect()}
    assert tuple(got["age"])[1:] == ("Years", "your years", False) and tuple(got["NEW/1"])[1:] == ("New", "New", True)


def test_overrides_need_a_name_and_a_file(spark, tmp_path):
    path = tmp_path / "over.json"
    path.write_text('{"age": {"patient_phrase": "x"}}')
    with pytest.raises(Exception, match="without a name: age"):
        read_overrides(spark, str(path)).collect()
    with pytest.raises(FileNotFoundError):
        read_overrides(spark, str(tmp_path / "none.json"))
    bad = f"{scratch_path(spark, 'over')}.parquet"
    spark.createDataFrame([("age",)], "code string").write.parquet(bad)
    with pytest.raises(ValueError, match="name"):
        read_overrides(spark, bad)
