"""Edge rows of cohort, measurements, history and labels."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators import cohort as co
from wardline.operators import history as hi
from wardline.operators import labels as lb
from wardline.operators import measurements as ms
from wardline.operators.concepts import ALL_TASKS, LAB_ITEMS, VITAL_ITEMS, get_task, windows_used

T0 = datetime(2020, 3, 1, 10, 0)
ADM = "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, hospital_expire_flag int"
PAT = "subject_id bigint, gender string, anchor_age int, anchor_year int, dod date"
FACT = "hadm_id bigint, itemid bigint, valuenum double, charttime timestamp_ntz"


def at(hours=0.0, **kw):
    return T0 + timedelta(hours=hours, **kw)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one_stay(spark, admit=T0, disch=at(240), hadm=1, dod=None, gender="F"):
    return spark.createDataFrame(
        [(1, hadm, admit, disch, gender, dod, 50, 10.0, disch)],
        "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, gender string, dod date,"
        " age_at_admit int, hosp_los_days double, prediction_time timestamp_ntz",
    )


def cohort_ids(spark, adm, ages=None):
    ids = {a[0] for a in adm}
    pat = [(i, "F", (ages or {}).get(i, 40), 2020, None) for i in ids]
    icu = spark.createDataFrame([(a[1],) for a in adm], "hadm_id bigint")
    out = co.cohort(spark.createDataFrame(adm, ADM), spark.createDataFrame(pat, PAT), icu)
    return [r["hadm_id"] for r in out.orderBy("hadm_id").collect()]


def test_los_counts_hour_boundaries(spark):
    df = spark.createDataFrame(
        [(datetime(2020, 3, 1, 10, 59), datetime(2020, 3, 1, 11, 1)), (datetime(2020, 3, 1, 10, 5), datetime(2020, 3, 1, 10, 55)),
         (datetime(2020, 2, 28, 23, 0), datetime(2020, 3, 1, 0, 0))],
        "a timestamp_ntz, d timestamp_ntz",
    )
    got = [r[0] for r in df.select(fn.los_days(F.col("a"), F.col("d"))).collect()]
    assert got == pytest.approx([1 / 24, 0.0, 25 / 24])


def test_stay_inside_one_clock_hour_is_dropped(spark):
    kept = (1, 11, datetime(2020, 3, 1, 10, 59), datetime(2020, 3, 1, 11, 1), 0)
    gone = (2, 21, datetime(2020, 3, 1, 10, 5), datetime(2020, 3, 1, 10, 55), 0)
    assert cohort_ids(spark, [kept, gone]) == [11]


def test_subject_whose_first_stay_died_is_out(spark):
    first, second = (1, 11, at(0), at(48), 1), (1, 12, at(100), at(200), 0)
    assert cohort_ids(spark, [first, second]) == []


def test_tie_on_admission_takes_lower_id_and_minors_are_out(spark):
    adm = [(1, 12, at(0), at(48), 0), (1, 11, at(0), at(48), 0), (2, 21, at(0), at(48), 0)]
    assert cohort_ids(spark, adm, ages={2: 17}) == [11]


def test_cohort_limit(spark):
    adm = spark.createDataFrame([(i, 10 + i, at(0), at(48), 0) for i in range(5)], ADM)
    pat = spark.createDataFrame([(i, "F", 40, 2020, None) for i in range(5)], PAT)
    got = co.cohort(adm, pat, adm.select("hadm_id"), limit=2)
    assert rows(got.select("subject_id")) == [(0,), (1,)]


def test_cutoff_is_discharge_for_short_stays(spark):
    stay = one_stay(spark, disch=at(10))
    got = {r["obs_window"]: r["cutoff"] for r in co.stay_windows(stay, [None, 24]).collect()}
    assert got == {"discharge": at(10), "24h": at(10)}
    assert co.with_cutoff(one_stay(spark), 24).first()["cutoff"] == at(24)


def test_single_reading_has_no_std_and_tie_takes_larger_value(spark):
    chart = spark.createDataFrame(
        [(1, 220045, 80.0, at(1)), (1, 220210, 10.0, at(2)), (1, 220210, 14.0, at(2)), (1, 220277, None, at(2))], FACT
    )
    got = {r["vital"]: r.asDict() for r in ms.vital_summary(chart, one_stay(spark)).collect()}
    assert set(got) == {"HR", "RR"}
    assert got["HR"]["std"] is None and got["HR"]["mean"] == 80.0
    assert got["RR"]["last"] == 14.0
    codes = {r["code"] for r in ms.vital_events(ms.vital_summary(chart, one_stay(spark))).collect()}
    assert "VITAL/HR_std" not in codes and len(codes) == 9


def test_window_ends_are_inclusive_and_labs_have_no_lower_bound(spark):
    before, first, cut, after = at(-1), at(0), at(24), at(24, seconds=1)
    chart = spark.createDataFrame([(1, 220045, float(i), t) for i, t in enumerate([before, first, cut, after])], FACT)
    got = {r["obs_window"]: r for r in ms.vital_summary(chart, one_stay(spark), windows=(None, 24)).collect()}
    assert (got["24h"]["min"], got["24h"]["max"], got["24h"]["last"]) == (1.0, 2.0, 2.0)
    assert (got["discharge"]["min"], got["discharge"]["max"]) == (1.0, 3.0)
    lab = spark.createDataFrame([(1, 50931, 7.0, before)], FACT)
    assert ms.lab_latest(lab, one_stay(spark)).first()["last"] == 7.0


def test_no_reading_after_the_cutoff_leaks(spark):
    chart = spark.createDataFrame([(1, 220045, 60.0, at(5)), (1, 220045, 999.0, at(25))], FACT)
    lab = spark.createDataFrame([(1, 50931, 5.0, at(5)), (1, 50931, 999.0, at(25))], FACT)
    stay = one_stay(spark)
    vital = ms.vital_summary(chart, stay, windows=(24,)).first()
    assert vital["max"] == 60.0 and ms.lab_latest(lab, stay, windows=(24,)).first()["last"] == 5.0


def test_a_stay_with_a_third_of_all_readings_gives_the_same_statistics(spark):
    from wardline.operators.skew import hot_keys

    stays = spark.range(30).select(
        F.col("id").alias("hadm_id"), F.lit(T0).alias("admittime"), F.lit(at(48)).alias("dischtime")
    )
    chart = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id") % 30).alias("hadm_id"),
        F.when(F.col("id") % 2 == 0, 220045).otherwise(220210).cast("bigint").alias("itemid"),
        (F.col("id") * 37 % 101).cast("double").alias("valuenum"),
        (F.lit(T0) + F.expr("INTERVAL '1' MINUTE * (id * 13 % 2000)")).alias("charttime"),
    )
    hot = hot_keys(chart, "hadm_id", rows_per_salt=100)
    assert hot.filter("hadm_id = 4 AND _salts > 9").count() == 1
    plain = {tuple(r)[:3]: tuple(r)[3:] for r in ms.vital_summary(chart, stays, windows=(None, 24)).collect()}
    spread = {tuple(r)[:3]: tuple(r)[3:] for r in ms.vital_summary(chart, stays, windows=(None, 24), hot=hot).collect()}
    assert plain.keys() == spread.keys()
    for key, row in plain.items():
        assert spread[key] == pytest.approx(row, nan_ok=True)


def test_fahrenheit(spark):
    chart = spark.createDataFrame([(1, 223761, 98.6, at(1)), (1, 223762, 36.0, at(2))], FACT)
    got = ms.vital_summary(chart, one_stay(spark)).first()
    assert got["max"] == pytest.approx(37.0) and got["last"] == 36.0 and got["vital"] == "TEMP_C"


def test_dictionaries():
    assert len(VITAL_ITEMS) == 11 and len(LAB_ITEMS) == 17 and len(ALL_TASKS) == 10
    assert windows_used() == [None, 24]
    assert get_task("dx_diabetes").exclude_prefixes == ("DX/DIABETES", "LAB/HBA1C", "LAB/GLUCOSE")
    with pytest.raises(KeyError):
        get_task("nope")


@pytest.mark.parametrize(
    "code,version,groups",
    [
        ("V4581", "9", []), ("51881", "9", ["RESPIRATORY"]), ("e11.9 ", "10", ["DIABETES"]), ("E119", "x", []),
        ("4599", "9", []), ("460", "9", ["RESPIRATORY"]), ("519.9", "9", ["RESPIRATORY"]), ("520", "9", []),
        ("250.00", "10", []), ("30002", "9", ["DEPRESSION_ANXIETY"]), ("46", "9", []), ("J", "10", ["RESPIRATORY"]),
        ("I10", "10", ["HYPERTENSION"]), ("I1", "10", []), (None, "9", []),
    ],
)
def test_icd_groups(spark, code, version, groups):
    df = spark.createDataFrame([(1, code, version)], "hadm_id bigint, icd_code string, icd_version string")
    assert hi.classified(df).first()["groups"] == groups


def test_death_horizon(spark):
    disch = datetime(2020, 3, 10, 12, 0)
    dods = [date(2020, 3, 9), date(2020, 3, 10), disch.date() + timedelta(days=366), disch.date() + timedelta(days=367), None]
    df = spark.createDataFrame([(d, disch) for d in dods], "dod date, d timestamp_ntz")
    # midnight of day 366 lies 365 whole days and a half after noon discharge
    assert [r[0] for r in df.select(fn.died_within(F.col("dod"), F.col("d"), 365)).collect()] == [1, 1, 1, 0, 0]


def test_readmission_edges(spark):
    stay = one_stay(spark, disch=at(48))
    for shift, want in ((timedelta(0), 0), (timedelta(days=30), 1), (timedelta(days=30, seconds=1), 0), (timedelta(seconds=1), 1)):
        adm = spark.createDataFrame([(1, 1, T0, at(48), 0), (1, 2, at(48) + shift, at(5000), 0)], ADM)
        got = hi.admission_history(stay, adm).first()
        assert (got["readmit"], got["n_prior"]) == (want, 0)


def test_index_stay_feeds_labels_but_not_history(spark):
    stay = one_stay(spark, hadm=2, admit=at(100), disch=at(200))
    adm = spark.createDataFrame([(1, 1, at(0), at(50), 0), (1, 2, at(100), at(200), 0), (1, 3, at(300), at(400), 0)], ADM)
    dx = spark.createDataFrame(
        [(1, "25000", "9"), (2, "4019", "9"), (2, "I10", "10"), (3, "J449", "10")], "hadm_id bigint, icd_code string, icd_version string"
    )
    index = hi.dx_by_index(stay, adm, dx)
    assert rows(index, "grp") == [(2, "DIABETES", True), (2, "HYPERTENSION", False)]
    assert [r["code"] for r in hi.dx_history_events(index).collect()] == ["DX/DIABETES"]
    flags = lb.chronic_flags(stay, index).first().asDict()
    assert (flags["dx_diabetes"], flags["dx_hypertension"], flags["dx_respiratory"]) == (1, 1, 0)
    long = lb.labels_long(stay, hi.admission_history(stay, adm), index)
    assert long.count() == 10
    los = long.filter("task = 'los_days'").first()
    assert los["label_time"] == at(124) and los["value"] == 10.0 and los["sex"] == "female"
