"""Cleaning and profiling on hand-made fixtures (FIXTURES.md section 4)."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskspark.operators.clean import fit_cleaning, iqr_bounds
from riskspark.operators.profile import (column_profile, distinct_counts, duplicate_rows, missing_total, share,
                                         value_counts)
from riskspark.roles import Roles
from riskspark.functions.exprs import clip, peak_hour

ROLES = Roles(id="id", label="sev", date="day", time="time")


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_duplicates_null_equals_null(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (None, None)], "a int, b string")
    assert _rows(duplicate_rows(df)) == [(4, 2, 2)]


def test_column_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, float("nan"), None), (3, None, "c")],
                               "a int, x double, s string")
    prof = {r["column_name"]: (r["non_null"], r["missing"]) for r in column_profile(df).collect()}
    assert prof == {"a": (2, 1), "x": (1, 2), "s": (2, 1)}
    assert missing_total(df).first()[0] == 4


def test_value_counts_and_share(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    assert _rows(value_counts(df, "s")) == [("b", 2), ("a", 1)]
    assert _rows(share(df, "s")) == [("b", 2, 66.7), ("a", 1, 33.3)]


def test_collapsed_clip(spark):
    vals = [0.0] * 8 + [1.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = iqr_bounds(df, ["x"])["x"]
    assert b.iqr == 0.0 and b.collapsed and b.lo == 0.0 and b.hi == 0.0


def test_clip_keeps_null_and_is_idempotent(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (2.0,), (50.0,)], "x double")
    once = df.select(clip(F.col("x"), 0.0, 10.0).alias("x"))
    twice = once.select(clip(F.col("x"), 0.0, 10.0).alias("x"))
    assert [r[0] for r in once.collect()] == [None, 0.0, 2.0, 10.0]
    assert [r[0] for r in twice.collect()] == [None, 0.0, 2.0, 10.0]


def _accident_like(spark):
    rows = [
        (1, "A", "2024-01-05", "08:05:00", 1.0, None, "k", None),
        (2, "B", "2024-02-05", "17:00:00", 2.0, 10, "k", None),
        (3, None, "2024-03-05", "12:00:00", None, 20, "k", None),
        (4, "A", "2024-04-05", "23:59:59", 4.0, 30, "k", None),
        (5, "A", "2024-05-05", "06:59:59", 1000.0, 40, None, None),
    ]
    return spark.createDataFrame(rows, "id long, sev string, day string, time string, x double, n long, "
                                       "const string, empty double")


def test_fit_cleaning_end_to_end(spark):
    df = _accident_like(spark)
    model = fit_cleaning(df, ROLES)
    assert model.all_null == ["empty"]
    assert model.constant == ["const"]
    assert model.other_fill == {"sev": "A"}
    assert model.numeric_fill == {"x": 3.0, "n": 25.0}   # median of [1, 2, 4, 1000]
    out = model.transform(df)
    assert "empty" not in out.columns and "const" not in out.columns
    rows = {r["id"]: r for r in out.collect()}
    assert rows[3]["sev"] == "A" and rows[3]["x"] == 3.0
    assert rows[1]["n"] == 25.0
    # x quartiles after fill: [1, 2, 3, 4, 1000] -> q1 2, q3 4, hi = 10
    assert model.bounds["x"].hi == 10.0 and rows[5]["x"] == 10.0
    assert [rows[i]["is_peak_hour"] for i in (1, 2, 3, 4, 5)] == [1, 1, 0, 0, 0]
    assert [rows[i]["month"] for i in (1, 2, 3)] == [1, 2, 3]
    assert str(out.schema["day"].dataType) == "DateType()"
    assert "id" not in model.bounds          # the id is never clipped


def test_bad_time_raises_or_nulls(spark):
    df = spark.createDataFrame([(1, "A", "2024-01-01", "08:05:00", 1.0), (2, "A", "2024-01-01", "xx", 2.0)],
                               "id long, sev string, day string, time string, x double")
    strict = fit_cleaning(df, ROLES)
    with pytest.raises(PySparkException):
        strict.transform(df).collect()
    lenient = fit_cleaning(df, ROLES, bad_time="null")
    hours = sorted((r["id"], r["hour"]) for r in lenient.transform(df).collect())
    assert hours == [(1, 8), (2, None)]


def test_peak_hour_edges(spark):
    df = spark.createDataFrame([(h,) for h in (6, 7, 9, 10, 16, 17, 19, 20)], "h int")
    assert [r[0] for r in df.select(peak_hour(F.col("h"))).collect()] == [0, 1, 1, 0, 0, 1, 1, 0]


def test_distinct_counts_skip_missing_and_keep_empty_columns(spark):
    rows = [("hot", None, "a")] * 30 + [("x", None, "b"), (None, None, "a"), ("y", None, None)]
    df = spark.createDataFrame(rows, "s string, empty string, t string").repartition(5)
    got = dict(_rows(distinct_counts(df, ["s", "empty", "t"])))
    assert got == {"s": 3, "empty": 0, "t": 2}
    # brute force on the same rows
    for i, c in enumerate(["s", "empty", "t"]):
        assert got[c] == len({r[i] for r in rows if r[i] is not None})


def test_prepare_drops_empty_and_constant_columns(spark):
    from riskspark.plans import analyses
    df = _accident_like(spark)
    prep = analyses.prepare(df, ROLES, handle_invalid="keep")
    try:
        assert "empty" not in prep.feature_names and "const" not in prep.feature_names
        assert {"x", "n", "month", "hour", "is_peak_hour"} <= set(prep.feature_names)
        assert prep.data.count() == df.count()
        assert prep.train.count() + prep.test.count() == df.count()
    finally:
        prep.release()
