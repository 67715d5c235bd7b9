"""Correlation matrix and seasonal anomalies against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators.analytics import seasonal_anomalies
from tabsight.operators.correlations import correlation_matrix


def _frame(n=3000):
    rng = np.random.default_rng(7)
    x = rng.normal(size=n)
    df = pd.DataFrame({"x": x, "far": 1e12 + 3 * x + rng.normal(size=n), "gap": np.where(rng.random(n) < 0.4, np.nan, x * x),
                       "rare": np.where(rng.random(n) < 0.999, np.nan, x), "same": np.full(n, 0.1), "k": np.arange(n) + 2 ** 40})
    df["copy x"] = df["x"]
    return df


@pytest.mark.parametrize("parts", [1, 7])
def test_matrix_equals_pandas_with_missing_values(spark, parts):
    pdf = _frame()
    got = correlation_matrix(spark.createDataFrame(pdf).repartition(parts)).collect()
    # pandas itself loses digits on values far from zero; the shift is exact and changes no correlation
    # (a mean of 1e12 is a double with steps of 1.2e-4: pairs with k, spread 866, and far, spread 3, keep that much)
    close = {"far": 1e-6, "k": 1e-8}
    want, here = pdf.assign(far=pdf["far"] - 1e12, k=pdf["k"] - 2 ** 40).corr(min_periods=2), pdf.notna()
    assert len(got) == 21
    for r in got:
        a, b = r["column_a"], r["column_b"]
        assert r["n"] == int((here[a] & here[b]).sum())
        if "same" in (a, b):
            assert r["correlation"] is None          # constant
        else:
            assert r["correlation"] == pytest.approx(want.loc[a, b], abs=max(close.get(a, 1e-9), close.get(b, 1e-9)))


def test_matrix_of_hard_tables(spark):
    empty = spark.createDataFrame([], "a int, b double, c decimal(9,2), t string")
    assert [(r["column_a"], r["column_b"], r["n"], r["correlation"]) for r in correlation_matrix(empty).collect()] \
        == [("a", "b", 0, None), ("a", "c", 0, None), ("b", "c", 0, None)]
    one = spark.createDataFrame([(1, 2.0), (None, 3.0)], "i int, j double")      # columns named like the helpers
    assert [tuple(r) for r in correlation_matrix(one).collect()] == [("i", "j", 1, None)]
    inf = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("inf"), 2.5), (3.0, 1.0, 3.0)], "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in correlation_matrix(inf).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None and got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 3], [1, 2.5, 3])[0, 1])


def _series(days=400):
    rng = np.random.default_rng(3)
    day = pd.date_range("2024-01-01", periods=days)
    value = 100 + 900 * (day.dayofweek == 5) + rng.normal(scale=4, size=days)
    value[[50, 51, 200]] += [60, -70, 55]
    return pd.DataFrame({"shop": "a", "day": day, "value": value})


def test_seasons_find_planted_points_that_one_mean_cannot(spark):
    pdf = _series()
    flat = pd.DataFrame({"shop": None, "day": pd.date_range("2024-01-01", periods=30), "value": 5.0})
    flat.loc[[3, 4], "value"] = [6.0, np.nan]
    df = spark.createDataFrame(pd.concat([pdf, flat])).withColumn("day", F.col("day").cast("timestamp_ntz"))
    got = seasonal_anomalies(df, "day", "value", by=["shop"]).toPandas()
    first = got[got["shop"] == "a"].sort_values("day").reset_index(drop=True)
    middle = pdf.groupby(pdf["day"].dt.dayofweek)["value"].transform("median")
    mad = (pdf["value"] - middle).abs().groupby(pdf["day"].dt.dayofweek).transform("median")
    want = 0.6745 * (pdf["value"] - middle) / mad
    np.testing.assert_allclose(first["robust_z"].astype(float), want, rtol=1e-9)
    assert {50, 51, 200} <= set(first.index[first["is_anomaly"].astype(bool)])
    assert abs((pdf["value"] - pdf["value"].mean()) / pdf["value"].std())[[50, 51, 200]].max() < 2      # lost in the weekly swing
    second = got[got["shop"].isna()].sort_values("day").reset_index(drop=True)
    assert list(second.index[second["is_anomaly"] == True]) == [3] and second["robust_z"].isna().all()  # noqa: E712
    assert second.loc[4, "is_anomaly"] is None


def test_seasonal_names_must_be_free_and_empty_series(spark):
    df = spark.createDataFrame([], "day timestamp_ntz, value double, robust_z int")
    with pytest.raises(ValueError, match="robust_z"):
        seasonal_anomalies(df, "day", "value")
    assert seasonal_anomalies(df.drop("robust_z"), "day", "value", season="month").count() == 0
