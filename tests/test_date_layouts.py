"""The date layout compiler against pandas: the first value's layout, the free grammar, zones, and random formats."""

import datetime as dt
import random
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions.dates import DIRECTIVES, compile_layout, date_zone, parse_like, parsed_date
from tabsight.operators.insights import date_ranges, insights_frame, strict_date_range


def _want(values):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = pd.to_datetime(pd.Series(values), errors="coerce")
    return [None if pd.isna(v) else v.tz_localize(None).floor("us").to_pydatetime() for v in got]


def _got(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "_row_id long, order_date string")
    return [r["p"] for r in df.select("_row_id", parsed_date(df, "order_date").alias("p")).orderBy("_row_id").collect()]


COLUMNS = [
    ["01/15/2024 02:30 PM", "02/20/2024 11:05 AM", "03/01/2024 12:00 AM", "x", "12/31/2024 12:59 pm"],
    ["Mon, 15 Jan 2024", "Tue, 16 Jan 2024", "16 Jan 2024", "Wed, 31 Dec 2025"], ["Jan-15-2024", "feb-20-2024", "2024-01-15"],
    ["15-Jan-24", "1-feb-99", "30-Jun-70"], ["2024-01-15T10:00:00Z", "2024-01-16T10:00:00Z", "2024-01-15"],
    ["2024-01-15 10:00:00+02:00", "2024-03-15 10:00:00+02:00", "bad"], ["Monday, January 15, 2024", "Friday, March 1, 2024"],
    ["2024-01", "2024-12", "2024-13"], ["Jan 2024", "February 2024"], ["January 15 2024 3:05:07.25 pm", "March 1 2024 12:00:00 am"],
    ["15.01.24", "03.02.24"], ["20240115T101500", "20240116T235959"], ["2024/01/15 10:00", "2024/1/5 9:07"], ["2024", "1999"],
    ["1/5/24 4:05", "13/5/24 23:59"], ["Sat Jan 20 10:11:12 2024", "Sun Jan 21 00:00:00 2024"], ["2024-Jan-15", "2024-FEB-01"], ["01-15-24", "25-12-24"],
    ["12/2024", "1/1999"], ["13-01-2024 10:00:00 AM", "14-01-2024 12:30:00 AM"], ["2024-01-15 10:00:00.123456", "2024-01-15 10:00:00.5"],
    ["1st Jan 2024", "1st Feb 2024"], ["15/1/2024", "16/12/2023", "1/13/2024"], ["1/15/2024", "2/29/2024", "2/30/2024"], ["2024-02-29", "2023-02-29", "2024-1-5"],
    ["5 Jan 2024", "17 Mar 2024 10:00"], [None, "2024-01-01", None], ["15 January 2024 10:30", "1 May 2024 00:00"]]


@pytest.mark.parametrize("values", COLUMNS, ids=lambda v: str(v[0]))
def test_columns_as_pandas_reads_them(spark, values):
    assert _got(spark, values) == _want(values)


def test_a_time_alone_is_of_today(spark):
    day = spark.range(1).select(F.current_date().alias("d")).first()["d"]
    for values, times in ((["10:30", "23:59:01"], [dt.time(10, 30), dt.time(23, 59, 1)]), (["3:30 PM", "12:00 am"], [dt.time(15, 30), dt.time(0)])):
        assert _got(spark, values) == [dt.datetime.combine(day, t) for t in times]


def test_random_formats_and_values(spark):
    """Values written by random formats that pandas can name; some of another layout."""
    rnd = random.Random(4)
    dates = ["%Y-%m-%d", "%Y/%m/%d", "%d %b %Y", "%b %d, %Y", "%d %B %Y", "%B %d, %Y", "%d-%b-%Y", "%m/%d/%Y", "%a, %d %b %Y", "%Y%m%d", "%Y.%m.%d"]
    times = ["", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", "T%H:%M:%S"]
    for _ in range(25):
        fmt = rnd.choice(dates) + rnd.choice(times)
        when = [dt.datetime(rnd.randint(1950, 2060), rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59),
                            rnd.randint(0, 999_999)) for _ in range(6)]
        values = [w.strftime(fmt) for w in when] + ["", "no date", when[0].strftime("%d|%m|%Y")]
        values = [values[0]] + rnd.sample(values[1:], len(values) - 1)
        assert _got(spark, values) == _want(values), (fmt, values)


def test_zones_stay_in_ranges(spark):
    def ranges(values):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "_row_id long, order_date string")
        return df, date_ranges(df).collect()[0]["value"], strict_date_range(df).collect()[0]["value"]

    values = ["2024-01-15T10:00:00Z", "2024-01-16T11:00:00.25Z"]
    for v in (["2024-01-15T10:00:00Z", "2024-01-16T11:00:00Z"], ["2024-01-15 10:00:00+02:00", "2024-01-14 10:00:00+02:00"]):
        p = pd.to_datetime(pd.Series(v))
        df, loose, strict = ranges(v)
        assert loose == strict == f"{p.min()} to {p.max()}"
    assert date_zone(ranges(values[:1])[0], "order_date") == "+00:00"
    # another offset: the same instant in the first value's zone
    assert _got(spark, ["2024-01-15 10:00:00+02:00", "2024-01-15 10:00:00-0330"]) == [dt.datetime(2024, 1, 15, 10), dt.datetime(2024, 1, 15, 15, 30)]
    assert _got(spark, ["2024-01-15 10:00:00.250001"]) == [dt.datetime(2024, 1, 15, 10, 0, 0, 250001)]


def test_usual_layouts_raise_no_missing_alert(spark):
    df = spark.createDataFrame([(k, f"{k % 12 + 1:02}/15/2024 02:30 PM", k * 1.5) for k in range(30)], "_row_id long, order_date string, sales double")
    rows = {(r["Category"], r["Metric"]): r["Value"] for r in insights_frame("f", df).collect()}
    assert rows["Key Insights", "order_date Range"] == "2024-01-15 14:30:00 to 2024-12-15 14:30:00"
    assert not any("Alert" in c for c, _ in rows)


def test_unknown_directives_and_empty_columns(spark):
    assert compile_layout("%Q") is None and set("YmdHMSfpbBaAzIy") == set(DIRECTIVES)
    df = spark.createDataFrame([(1, None)], "_row_id long, order_date string")
    assert df.select(parsed_date(df, "order_date")).first()[0] is None
    assert spark.range(1).select(parse_like(F.lit("x"), "Q1 2024")).first()[0] is None
