"""Column functions against plain Python expectations."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from saleslode import functions as fn


def values(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_numbers_read_only_plain_notation(spark):
    texts = ["10.5", " 7 ", "1e3", "+.5", "5.", "1d", "1,5", "abc", "", None, "-3", "inf", "0x1"]
    got = values(spark, "t string", [(t,) for t in texts], fn.to_number(F.col("t")))
    assert got == [10.5, 7.0, 1000.0, 0.5, 5.0, None, None, None, None, None, -3.0, math.inf, None]


def test_integers_reject_fractions(spark):
    got = values(spark, "t string", [("5",), ("4.0",), ("4.5",), ("x",)], fn.to_integer(F.col("t")))
    assert got == [5, 4, None, None]


def test_timestamps_read_one_layout(spark):
    texts = ["2024-01-01", "2024-01-01 10:30:00", "01/02/2024", "2024-13-01", None, "soon"]
    got = values(spark, "t string", [(t,) for t in texts], fn.to_timestamp_lenient(F.col("t")))
    assert got == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 10, 30), None, None, None, None]


def test_fixed_dates_and_decimal_comma(spark):
    got = values(spark, "t string", [("31/12/2023",), ("2023-12-31",), ("31/02/2023",)],
                 fn.fixed_date(F.col("t"), "dd/MM/yyyy"))
    assert got == [dt.date(2023, 12, 31), None, None]
    got = values(spark, "t string", [("1,25",), ("3",), ("-",)],
                 fn.decimal_comma_number(F.col("t")))
    assert got == [1.25, 3.0, None]


def test_text_normalisation_strips_every_whitespace(spark):
    texts = ["\t São Paulo \n", "RIO ", None, "  a b  "]
    got = values(spark, "t string", [(t,) for t in texts], fn.normalised_text(F.col("t")))
    assert got == ["são paulo", "rio", None, "a b"]


def test_has_text(spark):
    got = values(spark, "t string", [("x",), (" \t\n",), ("",), (None,), (" ",)],
                 fn.has_text(F.col("t")))
    assert got == [True, False, False, False, False]


def test_day_distance_counts_boundaries(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1)),
            (dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 23, 59)),
            (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1))]
    got = values(spark, "a timestamp_ntz, b timestamp_ntz", rows,
                 fn.day_distance(F.col("a"), F.col("b")))
    assert got == [1, 0, -2, None]


def test_weekday_starts_on_monday(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(400)]
    df = spark.createDataFrame(days, "d date").select(*fn.calendar_columns(F.col("d")))
    for row in df.collect():
        day = row["date"]
        assert row["date_key"] == int(day.strftime("%Y%m%d"))
        assert row["day_of_week"] == day.weekday()
        assert row["is_weekend"] == (day.weekday() >= 5)
        assert row["week"] == day.isocalendar()[1]
        assert row["day_name"] == day.strftime("%A") and row["month_name"] == day.strftime("%B")


def test_flags_resolve_null(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (None, 1.0), (1.0, None)]
    assert values(spark, "a double, b double", rows, fn.after(F.col("a"), F.col("b"))) == [
        False, True, False, False]
    assert values(spark, "a double, b double", rows, fn.before(F.col("a"), F.col("b"))) == [
        True, False, False, False]
    got = values(spark, "a double", [(1.0,), (-1.0,), (None,), (0.0,), (float("nan"),)],
                 fn.missing_or_negative(F.col("a")))
    assert got == [False, True, True, False, True]
    got = values(spark, "a string", [("ok",), ("bad",), (None,)],
                 fn.not_accepted(F.col("a"), {"ok"}))
    assert got == [False, True, True]


def test_finite(spark):
    got = values(spark, "a double", [(1.0,), (None,), (math.nan,), (math.inf,), (-math.inf,)],
                 fn.is_finite(F.col("a")))
    assert got == [True, False, False, False, False]


def test_names_areas_and_paths(spark):
    names = ["gold_sales_daily", "model_output_x", "report_kpis", "other__thing"]
    assert values(spark, "n string", [(n,) for n in names], fn.title_words(F.col("n"))) == [
        "Gold Sales Daily", "Model Output X", "Report Kpis", "Other Thing"]
    assert values(spark, "n string", [(n,) for n in names], fn.area_of_check(F.col("n"))) == [
        "Gold", "ML outputs", "Relatórios", "Sistema"]
    assert values(spark, "n string", [("a\\b\\c",)], fn.forward_slashes(F.col("n"))) == ["a/b/c"]
    assert values(spark, "n string", [("vip",), ("new",)],
                  fn.label_or_self(F.col("n"), {"vip": "VIP"})) == ["VIP", "new"]
