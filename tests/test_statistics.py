"""Exact quantiles, mode and the small statistics fixtures."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskspark.operators.statistics import medians_and_quartiles, modes, order_statistics, quantiles


def test_mode_tie_takes_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert modes(df, ["s"])["s"] == ("a", 2)


def test_mode_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert modes(df, ["s"])["s"] == (None, 0)


def test_nan_is_missing_for_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    assert quantiles(df, ["x"], [0.5])["x"] == [1.5]


def test_even_median_and_quartiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "n int")
    assert quantiles(df, ["n"], [0.25, 0.5, 0.75])["n"] == [1.75, 2.5, 3.25]


def test_empty_column_gives_none(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles(df, ["x"], [0.5])["x"] == [None]


def test_hot_value_resolved(spark):
    # one value holds most rows; forced histogram rounds still give the exact answer
    vals = [7.0] * 500 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantiles(df, ["x"], [0.1, 0.5, 0.9], buckets=4, exact_limit=20)["x"]
    want = np.quantile(np.array(vals), [0.1, 0.5, 0.9])
    assert got == pytest.approx(list(want), abs=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-50, 50).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=120),
       st.sampled_from([2, 3, 16]), st.sampled_from([1, 5, 1000]))
def test_order_statistics_match_sort(spark, values, buckets, limit):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    n = len(values)
    ranks = {0, n - 1, n // 2, (n - 1) // 3}
    got = order_statistics(df, {"x": ranks}, buckets=buckets, exact_limit=limit)
    srt = sorted(values)
    for k in ranks:
        assert got[("x", k)] == srt[k]


def test_approx_method_close(spark):
    df = spark.range(0, 10_001).selectExpr("cast(id as double) as x")
    got = quantiles(df, ["x"], [0.5], method="approx")["x"][0]
    assert math.isclose(got, 5000.0, abs_tol=5)


def test_skewed_column_third_of_rows_one_value(spark):
    # one value holds a third of the rows, across many partitions
    import random
    rnd = random.Random(7)
    vals = [42.0] * 3000 + [rnd.uniform(-1e3, 1e3) for _ in range(6000)]
    df = spark.createDataFrame([(v, "hot" if v == 42.0 else f"k{int(v) % 50}") for v in vals], "x double, s string")
    df = df.repartition(9)
    got = quantiles(df, ["x"], [0.25, 0.5, 0.75], buckets=8, exact_limit=100)["x"]
    assert got == pytest.approx(list(np.quantile(np.array(vals), [0.25, 0.5, 0.75])), abs=1e-9)
    assert modes(df, ["s"])["s"] == ("hot", 3000)


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_infinite_values_like_numpy(spark, limit):
    inf = float("inf")
    for values in ([*range(1000), inf], [-inf, -inf, 1.0, 2.0, inf], [inf, inf], [-inf, 3.0], [0.0] * 50 + [inf] * 50):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], buckets=4, exact_limit=limit)["x"]
        assert got == pytest.approx(_linear(values, (0.0, 0.25, 0.5, 0.75, 1.0)), nan_ok=True)


def _linear(values, probs):
    v = sorted(map(float, values))
    out = []
    for p in probs:
        pos = p * (len(v) - 1)
        lo = int(pos)
        hi = min(lo + (pos > lo), len(v) - 1)
        out.append(v[lo] if v[lo] == v[hi] else (1 - (pos - lo)) * v[lo] + (pos - lo) * v[hi])
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=25), st.integers(0, 30))
def test_quartiles_of_filled_columns_from_raw_ranks(spark, values, miss):
    """As if the column had been filled with its median first."""
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * miss, "x double")
    n = len(values)
    stats = {"x": (n, min(values), max(values))}
    medians, quartiles = medians_and_quartiles(df, ["x"], ["x"], {"x": (n, miss)}, stats)
    middle = _linear(values, [0.5])[0]
    assert medians["x"] == pytest.approx(middle)
    assert quartiles["x"] == pytest.approx(_linear(values + [middle] * miss, [0.25, 0.75]))
