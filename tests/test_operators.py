"""Operators against brute force on small, awkward data."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saleslode.operators import keys, outliers, profile, radix, reshape, rules, series
from saleslode.operators.ranking import (
    QUARTILES,
    QUINTILES,
    Fraction,
    exact_quantiles,
)
from saleslode.plans import rfm

QUICK = settings(max_examples=12, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


def days(n):
    return [dt.date(2024, 1, 1) + dt.timedelta(days=2 * i) for i in range(n)]


# -- ranks ---------------------------------------------------------------------------
@settings(QUICK, max_examples=3)
@given(st.lists(st.lists(st.one_of(st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, -1.0, 0.1])),
                         min_size=1, max_size=60), min_size=1, max_size=30))
def test_quantiles_equal_numpy(spark, groups):
    df = spark.createDataFrame([(g, float(v)) for g, vs in enumerate(groups) for v in vs],
                               "g int, v double").repartition(3)
    for row in exact_quantiles(df, "v", QUINTILES, ["g"]).collect():
        numbers = groups[row["g"]]
        assert row["total"] == len(numbers)
        want = np.quantile(np.array(numbers, dtype=float), [0.2, 0.4, 0.6, 0.8])
        np.testing.assert_allclose(row["quantiles"], want, rtol=1e-9, atol=1e-9)


def test_quantiles_with_one_value_owning_most_rows(spark):
    hot = spark.range(30_000).select(F.lit(7.5).alias("v"))
    rest = spark.range(10_000).select((F.col("id") / 100.0).alias("v"))
    both = hot.unionByName(rest)
    want = np.quantile(
        np.concatenate([np.full(30_000, 7.5), np.arange(10_000) / 100.0]), [0.25, 0.75]
    )
    got = exact_quantiles(both, "v", QUARTILES).first()["quantiles"]
    np.testing.assert_allclose(got, want)


def test_quantiles_by_group_ignore_null_and_empty(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("b", None), ("c", -5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["total"], r["q"][0])
           for r in exact_quantiles(df, "v", [Fraction(1, 2)], ["g"], out="q").collect()}
    assert got == {"a": (2, 1.5), "c": (1, -5.0)}


def test_radix_keys_are_the_bits_of_doubles(spark):
    """Every power of two, its neighbours, subnormals, both zeros and random values."""
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    random = np.random.default_rng(1)
    bits = random.integers(0, 2047 << 52, 3000, dtype=np.int64).view(np.float64)
    numbers = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), bits,
                              random.normal(size=500), [0.0, np.finfo(float).max]])
    numbers = np.concatenate([numbers, -numbers])
    df = spark.createDataFrame([(float(v),) for v in numbers], "v double")
    rows = radix.with_radix_key(df, "v", "k").withColumn(
        "back", radix.radix_value(F.col("k"))).collect()
    got = np.array([r["k"] for r in rows])
    np.testing.assert_array_equal(
        got, np.where(numbers < 0, -1, 1) * np.abs(numbers).view(np.int64))
    assert [r["back"] for r in rows] == numbers.tolist()
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (-float("inf"),), (None,)],
                                "v double")
    top = 2047 << 52
    assert [r["k"] for r in radix.with_radix_key(odd, "v", "k").collect()] == [top, top + 1, -top, None]


@pytest.mark.parametrize("n", [5, 7, 23, 64, 111])
def test_frequency_bins_equal_quantile_cut_of_ranks(spark, n):
    random = np.random.default_rng(n)
    rows = [(f"c{i}", int(f)) for i, f in enumerate(random.integers(1, 4, n))]
    df = spark.createDataFrame(rows, "customer_id string, frequency bigint")
    scored = df.withColumn("s", rfm.frequency_score(rfm.frequency_edges(df))).withColumn(
        "tie", F.md5("customer_id")).toPandas().sort_values(["frequency", "tie"])
    want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert scored["s"].tolist() == want.tolist()


@pytest.mark.parametrize("n", [6, 20, 75])
def test_value_bins_equal_quantile_cut(spark, n):
    random = np.random.default_rng(n)
    rows = [(i, float(v)) for i, v in enumerate(random.normal(100, 30, n))]
    df = spark.createDataFrame(rows, "i int, x double")
    edges = rfm.value_edges(df, "x")
    got = [r[1] for r in df.select("i", rfm.value_score("x", edges)).orderBy("i").collect()]
    want = pd.qcut(pd.Series([v for _, v in rows]), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got == want.tolist()


def test_collapsed_edges_still_score(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2]], "x double")
    edges = rfm.value_edges(df, "x")
    got = sorted(r[0] for r in df.select(rfm.value_score("x", edges)).collect())
    assert got == [1] * 6 + [5]


def test_unknown_scores_print_and_fall_to_standard(spark):
    df = spark.createDataFrame(
        [(5, 5, 5), (1, 3, 1), (4, 2, 1), (3, 3, 3), (None, 5, 5)],
        "recency_score bigint, frequency_score bigint, monetary_score bigint",
    )
    got = df.select(
        rfm.score_text("recency_score", "frequency_score", "monetary_score"), rfm.rfm_segment()
    ).collect()
    assert [tuple(r) for r in got] == [
        ("555", "vip"), ("131", "at_risk"), ("421", "recent"), ("333", "standard"),
        ("<NA>55", "standard"),
    ]


# -- series --------------------------------------------------------------------------
def test_lags_count_rows_not_days(spark):
    df = spark.createDataFrame(list(zip(days(8), [float(v) for v in range(10, 18)], strict=True)),
                               "date date, gmv double")
    rows = series.row_lags(df, "date", "gmv", {"l1": 1, "l7": 7}).orderBy("date").collect()
    assert rows[0]["l1"] is None and rows[1]["l1"] == 10 and rows[7]["l7"] == 10


def test_rolling_measures_equal_pandas(spark):
    numbers = [5.0, 7.0, 1.0, 9.0, 4.0, 4.0, 8.0, 2.0, 6.0, 3.0]
    df = spark.createDataFrame(list(zip(days(10), numbers, strict=True)), "date date, v double")
    out = series.rolling_deviations(
        series.rolling_means(df, "date", "v", {"m": 3}), "date", "v", {"s": 3}
    ).orderBy("date").toPandas()
    want = pd.Series(numbers)
    np.testing.assert_allclose(out["m"], want.rolling(3, min_periods=1).mean())
    np.testing.assert_allclose(out["s"].astype(float), want.rolling(3, min_periods=2).std())


def test_growth_fills_gaps_and_survives_zero(spark):
    rows = list(zip(days(6), [10.0, None, 15.0, 0.0, 5.0, 10.0], strict=True))
    df = spark.createDataFrame(rows, "date date, v double")
    got = [r["g"] for r in series.growth(df, "date", {"g": "v"}).orderBy("date").collect()]
    assert got == [None, 0.0, 0.5, -1.0, None, 1.0]


def test_differences_need_both_sides(spark):
    df = spark.createDataFrame(list(zip(days(4), [1.0, 3.0, None, 4.0], strict=True)),
                               "date date, v double")
    out = series.first_differences(df, "date", {"d": "v", "e": "absent"})
    assert "e" not in out.columns
    assert [r["d"] for r in out.orderBy("date").collect()] == [None, 2.0, None, None]


def test_temporal_split_truncates(spark):
    df = spark.createDataFrame([(d,) for d in days(9)], "date date")
    rows = series.temporal_split(df, "date", 0.8).orderBy("date").collect()
    assert [r["is_train"] for r in rows] == [True] * 7 + [False] * 2


# -- keys ----------------------------------------------------------------------------
def test_duplicate_flag_marks_every_member_and_null_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None)]
    df = spark.createDataFrame(rows, "k int, l string")
    got = sorted((str(r["k"]), str(r["l"]), r["is_duplicate_key"])
                 for r in keys.flag_duplicate_keys(df, ["k", "l"]).collect())
    want = pd.DataFrame(rows, columns=["k", "l"])
    want["d"] = want.duplicated(keep=False)
    assert got == sorted((str(k), str(v), d) for (k, v), d in zip(rows, want["d"], strict=True))
    assert not keys.flag_duplicate_keys(df, ["k", "absent"]).where("is_duplicate_key").count()


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "parent_id int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    row = keys.orphan_rows(child, "parent_id", parent, "id").first()
    assert (row["failed_count"], row["total_count"]) == (2, 5)
    assert [tuple(r) for r in keys.orphans(child, "parent_id", parent, "id").collect()] == [(3, 2)]


# -- outliers ------------------------------------------------------------------------
def test_iqr_of_small_column(spark):
    df = spark.createDataFrame([("c", v) for v in [10, 11, 12, 13, 500]], "column string, v bigint")
    row = outliers.iqr_summaries(df, "v", ["column"]).first()
    assert (row["q1"], row["q3"], row["outlier_count"], row["total_count"]) == (11, 13, 1, 5)
    assert row["outlier_ratio"] == 0.2


@pytest.mark.parametrize("seed", range(2))
def test_iqr_equals_numpy(spark, seed):
    """Ties, both signs, heavy tails, groups without values; fences meet values exactly."""
    random = np.random.default_rng(seed)
    frames = {
        "tails": random.standard_cauchy(400), "cents": np.round(random.normal(0, 50, 400), 2),
        "whole": random.integers(-4, 5, 300).astype(float), "one": np.full(20, 3.25),
        "tiny": random.normal(size=300) * 1e-310, "huge": random.normal(size=300) * 1e307,
        "few": random.normal(size=int(random.integers(1, 4))),
        "edges": np.array([0.0, 1, 2, 3, 4, 7, -3, 7.000001, -3.000001]),
    }
    rows = [(g, float(v)) for g, vs in frames.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for few in (True, False):
        got = {r["g"]: r for r in outliers.iqr_summaries(df, "v", ["g"], few).collect()}
        assert (got["none"]["q1"], got["none"]["total_count"]) == (None, 0)
        for g, vs in frames.items():
            q1, q3 = np.quantile(vs, [0.25, 0.75])
            np.testing.assert_allclose([got[g]["q1"], got[g]["q3"]], [q1, q3], rtol=1e-12)
            low, high = got[g]["lower_bound"], got[g]["upper_bound"]
            assert got[g]["outlier_count"] == int(((vs < low) | (vs > high)).sum()), (g, few)
            assert got[g]["total_count"] == len(vs)


def test_iqr_without_finite_values(spark):
    df = spark.createDataFrame([("c", float("nan")), ("c", None)], "column string, v double")
    row = outliers.iqr_summaries(df, "v", ["column"]).first()
    assert (row["q1"], row["outlier_count"], row["total_count"], row["outlier_ratio"]) == (
        None, 0, 0, 0.0)


@pytest.mark.parametrize(("numbers", "threshold", "flagged"), [
    ([1, 1, 1, 1, 100], 1.5, 1), ([5, 5, 5], 3.0, 0), ([7], 0.1, 0),
    ([1.0, float("nan"), float("inf"), 1.0, 1.0, 1.0, 50.0], 1.5, 1),
])
def test_zscore(spark, numbers, threshold, flagged):
    df = spark.createDataFrame([(float(v),) for v in numbers], "v double")
    out = outliers.zscore_flags(df, ["v"], threshold)
    assert out.where("v_zscore_anomaly").count() == flagged
    assert dict(out.dtypes)["v_zscore_anomaly"] == "boolean"


# -- rules ---------------------------------------------------------------------------
def results(df, *checked):
    return {r["rule_name"]: r for r in rules.evaluate(df, list(checked)).collect()}


def test_tables_share_one_evaluation(spark, tmp_path):
    """As rule by rule: NULLs, repeats, other types, absent columns, empty and outside parents."""
    def saved(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    frames = {
        "items": saved("items", [(1, None, "a", 1.0), (1, None, "a", 2.0), (2, 5, "b", -0.0),
                                 (None, 5, None, 0.0), (None, 2, "c", None), (9, 9, "a", 1.0)],
                       "order_id int, line int, code string, price double"),
        "orders": saved("orders", [(1, "x"), (2, None), (2, "y"), (None, "z")],
                        "id int, code string"),
        "empty": saved("empty", [], "id int, code string"),
    }
    wide = frames["orders"].select(F.col("id").cast("long").alias("id"))
    outside = saved("outside", [("a",), (None,)], "code string")
    checked = {
        "items": [rules.not_null("code"), rules.unique_key("order_id", "line"),
                  rules.unique_key("line", "order_id"), rules.unique_key("price"),
                  rules.unique_key("absent"), rules.NotEmptyRule("items"),
                  rules.RelationRule("same", "order_id", frames["orders"], "id"),
                  rules.RelationRule("wide", "order_id", wide, "id", rules.WARNING),
                  rules.RelationRule("code", "code", outside, "code"),
                  rules.RelationRule("lost", "order_id", frames["orders"], "gone")],
        "orders": [rules.unique_key("id"), rules.unique_key("id", "code", name="both"),
                   rules.RelationRule("back", "id", frames["empty"], "id")],
        "empty": [rules.unique_key("id"), rules.NotEmptyRule("empty"),
                  rules.RelationRule("up", "id", frames["orders"], "id")],
    }
    together = rules.evaluate_tables(frames, checked)
    got = {(r["dataset"], *[r[c] for c in RESULT]) for r in together.collect()}
    alone = {(name, *[r[c] for c in RESULT]) for name, own in checked.items()
             for r in rules.evaluate(frames[name], own).collect()}
    assert got == alone and len(got) == 16
    few = rules.evaluate_tables(
        frames, {n: [r for r in own if r.rule_name not in ("wide", "lost", "absent_unique")]
                 for n, own in checked.items()})
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"Relation \[[^]]*\] parquet", plan)) <= 2 * len(frames) + 1


RESULT = ("rule_name", "severity", "passed", "failed_count", "total_count", "message")


def test_rules_on_items(spark):
    df = spark.createDataFrame(
        [("o1", "p1", 10.0, "ok", False), ("o2", None, -1.0, "bad", True),
         ("o2", "p1", None, None, None)],
        "order_id string, product_id string, price double, status string, has_error boolean",
    )
    got = results(
        df, rules.not_null("product_id"), rules.non_negative("price"),
        rules.accepted_values("status", {"ok"}), rules.false_flag("has_error"),
        rules.unique_key("order_id"), rules.not_null("absent"), rules.unique_key("absent"),
        rules.between("price", 0, 10), rules.false_flag("absent"),
    )
    failed = {name: r["failed_count"] for name, r in got.items()}
    assert failed == {
        "product_id_not_null": 1, "price_non_negative": 2, "status_accepted_values": 2,
        "has_error_false": 1, "order_id_unique": 2, "absent_not_null": 3, "absent_unique": 3,
        "price_between_0_10": 2, "absent_false": 3,
    }
    assert all(r["total_count"] == 3 and not r["passed"] for r in got.values())
    assert got["order_id_unique"]["message"] == "2 duplicate key rows found for ['order_id']"


def test_empty_table_passes_and_counts_zero(spark):
    df = spark.createDataFrame([], "id int, v double")
    got = results(df, rules.not_null("id"), rules.non_negative("v"), rules.unique_key("id"),
                  rules.not_null("absent"), rules.NotEmptyRule("t"))
    assert {n for n, r in got.items() if not r["passed"]} == {"t_not_empty"}
    assert {r["total_count"] for r in got.values()} == {0}


def test_unparsable_text_fails_numeric_rules(spark):
    df = spark.createDataFrame([("1",), ("1d",), ("-2",), (None,)], "v string")
    got = results(df, rules.non_negative("v"), rules.between("v", 0, 5))
    assert {n: r["failed_count"] for n, r in got.items()} == {
        "v_non_negative": 3, "v_between_0_5": 3}


def test_relationship_rule_with_missing_column(spark):
    child = spark.createDataFrame([(1,), (2,)], "parent_id int")
    parent = spark.createDataFrame([(1,)], "id int")
    got = results(child, rules.RelationRule("ok", "parent_id", parent, "id"),
                  rules.RelationRule("gone", "parent_id", parent, "nothing"))
    assert (got["ok"]["failed_count"], got["gone"]["failed_count"]) == (1, 2)


# -- profile and reshape -------------------------------------------------------------
def test_profile(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, None)], "id bigint, value double")
    row = profile.profile_record(df).first()
    assert (row["rows"], row["columns"], row["duplicate_rows"]) == (3, 2, 1)
    by = {c["column"]: c for c in row["column_profiles"]}
    assert (by["value"]["null_count"], by["value"]["unique_count"], by["id"]["unique_count"]) == (
        1, 1, 2)
    empty = profile.profile_summary(df.limit(0)).first()
    assert (empty["rows"], empty["duplicate_rows"]) == (0, 0)


def test_pivot_drops_rows_without_any_value(spark):
    rows = [("jan", "a", 1.0), ("jan", "a", 3.0), ("feb", "b", None), (None, "a", 9.0),
            ("mar", "b", 4.0)]
    df = spark.createDataFrame(rows, "m string, n string, v double")
    got = {r["m"]: (r["a"], r["b"])
           for r in reshape.pivot_mean(df, "m", "n", "v", ["a", "b"]).collect()}
    assert got == {"jan": (2.0, None), "mar": (None, 4.0)}


def test_limits_are_checked(spark):
    df = spark.range(5)
    with pytest.raises(ValueError, match="limit"):
        reshape.top_rows(df, F.col("id"), 0)
    with pytest.raises(ValueError, match="limit"):
        reshape.checked_limit(501)
    assert reshape.top_rows(spark.range(900), F.col("id"), 501).count() == 501
    assert [r["id"] for r in reshape.top_rows(df, F.col("id").desc(), 2).collect()] == [4, 3]


def test_sample_is_repeatable_and_bounded(spark):
    df = spark.range(5_000).withColumnRenamed("id", "k")
    first = {r["k"] for r in reshape.hashed_sample(df, "k", 300).collect()}
    again = {r["k"] for r in reshape.hashed_sample(df.repartition(7), "k", 300).collect()}
    assert first == again and len(first) == 300
    assert reshape.hashed_sample(df.where("k < 20"), "k", 300).count() == 20
    for size in (1, 10, 501):
        for seed in range(8):
            assert reshape.hashed_sample(df, "k", size, seed).count() == size


def test_quantiles_of_values_close_together(spark):
    """300,000 distinct values within one coarse cell, and 95 % of rows on one value."""
    from saleslode.operators import ranking

    df = spark.range(300_000).select((F.col("id") + 1e9).cast("double").alias("v"))
    assert ranking.exact_quantiles(df, "v", ranking.QUARTILES).first()["quantiles"] == [
        1e9 + 74_999.75, 1e9 + 224_999.25]
    same = spark.range(1_000).select(F.when(F.col("id") < 950, 7.0).otherwise(F.col("id"))
                                     .cast("double").alias("v"))
    assert ranking.exact_quantiles(same, "v", ranking.QUARTILES).first()["quantiles"] == [7.0, 7.0]


def test_quantiles_of_a_million_doubles_under_one_prefix(spark):
    """All values share their first 32 bits: no level has more cells than a digit has values."""
    df = spark.range(1_000_000).select(
        (F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) * 1e-13).alias("v"))
    keys = radix.with_radix_key(df, "v", "k").select(
        radix.prefix(F.col("k")).alias("p"), radix.digit(F.col("k"), 1).alias("d3"), "k")
    assert keys.select("p").distinct().count() == 1
    assert keys.select("d3").distinct().count() <= 65_536
    assert keys.groupBy("p", "d3").agg(F.countDistinct("k").alias("n")).agg(
        F.max("n")).first()[0] <= 65_536
    values = np.array([r[0] for r in df.collect()])
    got = exact_quantiles(df, "v", QUARTILES).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(values, [0.25, 0.75]), rtol=1e-16)
    row = outliers.iqr_summaries(df.select(F.lit("c").alias("g"), "v"), "v", ["g"]).first()
    assert (row["outlier_count"], row["total_count"]) == (0, 1_000_000)


def test_sums_do_not_depend_on_partitions(spark):
    from saleslode.functions.measures import stable_sum

    df = spark.range(200_000).select((F.rand(3) * 1e9).alias("v"))
    df = spark.createDataFrame(df.toPandas())
    totals = {df.repartition(n).agg(stable_sum(F.col("v"))).first()[0] for n in (3, 17)}
    assert len(totals) == 1
