"""Layer plans on fixtures with awkward rows, against plain joined SQL."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from saleslode.operators import kmeans, trees
from saleslode.plans import analytics, gold, marts, ml, monitoring, rfm, serving, silver, suites
from saleslode.plans import warehouse

NOON = dt.datetime(2024, 1, 1, 12)


def stamp(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


@pytest.fixture(scope="module")
def shop(spark):
    """Repeated orders and customers, missing prices, parties without sales, NULL keys."""
    orders = [
        ("o1", "c1", stamp(0), stamp(5), stamp(9)), ("o2", "c1", stamp(0, 23), stamp(9), stamp(5)),
        ("o3", "c2", stamp(40), None, stamp(45)), ("o3", "c2", stamp(40), None, stamp(45)),
        ("o4", "c2", None, stamp(3), None), ("o5", None, stamp(41), None, None),
        ("o6", "c3", stamp(3), None, None),
    ]
    items = [
        ("o1", 1, "p1", "s1", 10.0, 1.5), ("o1", 2, "p2", "s1", None, 2.5),
        ("o2", 1, "p1", "s2", 20.25, 0.25), ("o2", 2, "p3", "s2", 5.0, None),
        ("o3", 1, "p9", "s1", 7.0, 0.5), ("o4", 1, "p1", "s1", 1.0, 1.0),
        ("o5", 1, None, None, 3.0, 0.75), ("o9", 1, "p2", "s1", 4.0, 0.5),
    ]
    customers = [("c1", "u1", "SP", "sp"), ("c2", "u2", "RJ", "rio"), ("c2", "u2", "RJ", "rio"),
                 ("c2", "u9", "MG", "bh"), ("c3", "u3", "SP", "sp"), ("c4", "u4", None, None)]
    frames = {
        "t_orders": spark.createDataFrame(
            orders, "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz,"
            " order_delivered_customer_date timestamp_ntz,"
            " order_estimated_delivery_date timestamp_ntz"),
        "t_items": spark.createDataFrame(
            items, "order_id string, order_item_id int, product_id string, seller_id string,"
            " price double, freight_value double"),
        "t_customers": spark.createDataFrame(
            customers, "customer_id string, customer_unique_id string, customer_state string,"
            " customer_city string"),
        "t_sellers": spark.createDataFrame(
            [("s1", "SP", "sp"), ("s2", "RJ", "rio"), ("s3", "MG", "bh"), ("s3", "MG", "bh")],
            "seller_id string, seller_state string, seller_city string"),
        "t_products": spark.createDataFrame(
            [("p1", "toys"), ("p2", "books"), ("p3", None)],
            "product_id string, product_category_name string"),
        "t_translation": spark.createDataFrame(
            [("toys", "Toys")],
            "product_category_name string, product_category_name_english string"),
    }
    return frames


@pytest.fixture(scope="module")
def database(shop):
    import duckdb

    connection = duckdb.connect()
    for name, df in shop.items():
        connection.register(f"raw_{name}", df.toPandas())
        connection.execute(f"create table {name} as select * from raw_{name}")
    return connection


JOINED = ("from t_orders o join t_items i using (order_id)"
          " where o.order_purchase_timestamp is not null")
MEASURES = ("count(*) as items_sold, sum(price) as revenue, sum(freight_value) as freight_value,"
            " sum(price + freight_value) as gmv, avg(price + freight_value) as average_ticket")


def test_daily_and_monthly_equal_the_joined_form(shop, database):
    sales = gold.order_sales(shop["t_orders"], shop["t_items"])
    for plan, period, extra in (
        (gold.sales_daily(sales), "cast(order_purchase_timestamp as date) as date",
         ", avg(freight_value) as average_freight"),
        (gold.sales_monthly_totals(sales),
         "cast(date_trunc('month', order_purchase_timestamp) as date) as month", ""),
    ):
        sql = (f"select {period}, count(distinct order_id) as orders,"
               f" count(distinct customer_id) as customers, {MEASURES}{extra} {JOINED} group by 1")
        sql = sql.replace("count(*) as items_sold", "cast(count(*) as bigint) as items_sold")
        assert compare(plan, database, sql) == []


def test_customers_keep_everyone_and_copies_multiply(shop, database):
    plan = gold.customer_metrics(shop["t_customers"], shop["t_orders"], shop["t_items"])
    sql = """
        select c.customer_id, c.customer_unique_id, c.customer_state, c.customer_city,
               count(distinct o.order_id) as orders, sum(i.price + i.freight_value) as gmv,
               avg(i.price + i.freight_value) as average_ticket,
               cast(min(o.order_purchase_timestamp) as date) as first_order_date,
               cast(max(o.order_purchase_timestamp) as date) as last_order_date
        from t_customers c left join t_orders o using (customer_id)
        left join t_items i using (order_id) group by 1, 2, 3, 4"""
    assert compare(plan, database, sql) == []


def test_seller_without_sales_counts_one_item(shop, database):
    plan = gold.seller_metrics(shop["t_sellers"], shop["t_items"])
    sql = """
        select s.seller_id, s.seller_state, s.seller_city, count(distinct i.order_id) as orders,
               count(*) as items_sold, sum(i.price) as revenue,
               sum(i.freight_value) as freight_value, avg(i.price + i.freight_value)
                   as average_ticket
        from t_sellers s left join t_items i using (seller_id) group by 1, 2, 3"""
    assert compare(plan, database, sql) == []
    idle = plan.where("seller_id = 's3'").first()
    assert (idle["orders"], idle["items_sold"], idle["revenue"]) == (0, 2, None)


def test_categories_fall_back_to_own_name_then_unknown(shop, database):
    plan = gold.category_performance(shop["t_items"], shop["t_products"], shop["t_translation"])
    sql = f"""
        select coalesce(t.product_category_name_english, p.product_category_name, 'unknown')
                   as category, count(distinct i.order_id) as orders, {MEASURES}
        from t_items i left join t_products p using (product_id)
        left join t_translation t using (product_category_name) group by 1"""
    assert compare(plan, database, sql) == []
    assert {r["category"] for r in plan.collect()} == {"Toys", "books", "unknown"}


def test_delivery_counts_undelivered_orders(shop, database):
    sql = """
        select cast(order_purchase_timestamp as date) as date, count(*) as orders,
               avg(date_diff('day', order_purchase_timestamp, order_delivered_customer_date))
                   as avg_delivery_days,
               avg(date_diff('day', order_purchase_timestamp, order_estimated_delivery_date))
                   as avg_estimated_days,
               cast(sum(case when order_delivered_customer_date > order_estimated_delivery_date
                        then 1 else 0 end) as bigint) as delayed_orders,
               sum(case when order_delivered_customer_date > order_estimated_delivery_date
                        then 1 else 0 end) / count(*) as delay_rate
        from t_orders where order_purchase_timestamp is not null group by 1"""
    assert compare(gold.delivery_metrics(shop["t_orders"]), database, sql) == []


def test_daily_and_monthly_sales_add_up(shop):
    sales = gold.order_sales(shop["t_orders"], shop["t_items"])
    daily = gold.sales_daily(sales).agg(F.sum("gmv")).first()[0]
    assert daily == gold.sales_monthly(sales).agg(F.sum("gmv")).first()[0]


def test_rfm_of_one_hot_customer(spark):
    """One customer with most orders neither breaks the bins nor hides the others."""
    sales = spark.range(4_000).select(
        F.concat(F.lit("o"), "id").alias("order_id"),
        F.when(F.col("id") < 3_000, F.lit("hot")).otherwise(F.concat(F.lit("c"), "id"))
        .alias("customer_id"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 300).cast("int")).alias("date"),
        (F.col("id") % 97 + 1.0).alias("gmv"),
    )
    scored = rfm.customer_rfm(sales).cache()
    assert scored.count() == 1_001
    hot = scored.where("customer_id = 'hot'").first()
    assert (hot["frequency"], hot["frequency_score"], hot["monetary_score"]) == (3_000, 5, 5)
    sizes = {r["frequency_score"]: r["count"]
             for r in scored.groupBy("frequency_score").count().collect()}
    assert sorted(sizes) == [1, 2, 3, 4, 5] and max(sizes.values()) - min(sizes.values()) <= 1


def test_calendar(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3))], "a date, b date")
    rows = gold.dim_date(bounds, "a", "b").orderBy("date").collect()
    assert len(rows) == 3 and rows[0]["date_key"] == 20240101


# -- Silver --------------------------------------------------------------------------
def test_orders_become_timestamps_and_are_flagged(spark):
    df = spark.createDataFrame(
        [("o1", "c1", "2024-01-05", "2024-01-02", "2024-01-09"),
         ("o1", "c1", "broken", "2024-01-02", "2024-01-01"), (None, "c1", None, None, None)],
        "order_id string, customer_id string, order_purchase_timestamp string,"
        " order_delivered_customer_date string, order_estimated_delivery_date string")
    out = silver.transform_sales(df, "orders")
    assert dict(out.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    rows = out.orderBy(F.col("order_purchase_timestamp").desc_nulls_last(), "order_id").collect()
    assert len(rows) == 3
    assert rows[0]["has_delivery_before_purchase"] and not rows[0]["has_estimate_before_purchase"]
    assert [r["has_invalid_order_purchase_timestamp"] for r in rows] == [False, True, True]
    assert sorted(r["is_duplicate_key"] for r in rows) == [False, True, True]


def test_items_with_absent_columns_still_transform(spark):
    df = spark.createDataFrame([("o1", "1", "-2", "x")],
                               "order_id string, order_item_id string, price string, freight_value string")
    row = silver.transform_sales(df, "order_items").first()
    assert (row["price"], row["has_invalid_price"], row["freight_value"],
            row["has_invalid_freight_value"]) == (-2.0, True, None, True)
    assert "has_invalid_shipping_limit_date" not in row.asDict()


def test_series_without_name_has_no_duplicates(spark):
    df = spark.createDataFrame([("2024-01-01", "10.5", "432")],
                               "date string, value string, series_code string")
    row = silver.transform_series(df).first()
    assert (row["date"], row["value"], row["series_code"], row["is_duplicate_key"]) == (
        dt.datetime(2024, 1, 1), 10.5, 432, False)


def test_statistics_header_is_removed(spark):
    names = ["V", "MN", "D1C", "D1N", "D2C", "D2N", "D3C", "D3N", "indicator_name", "source",
             "batch_id"]
    rows = [("Valor", "u", "c", "n", "c", "n", "Mês", "n", "ipca", "ibge_sidra", "b"),
            ("0.5", "%", "1", "Brasil", "63", "IPCA", "202401", "jan", "ipca", "ibge_sidra", "b"),
            ("...", "%", "1", "Brasil", "63", "IPCA", "2024", "x", "ipca", "ibge_sidra", "b")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    out = {r["period_code"]: r for r in silver.transform_statistics(df).collect()}
    assert set(out) == {"202401", "2024"}
    assert (out["202401"]["value"], out["202401"]["reference_month"]) == (0.5, dt.date(2024, 1, 1))
    assert out["2024"]["has_invalid_value"] and out["2024"]["has_invalid_reference_month"]


# -- suites --------------------------------------------------------------------------
def test_relations_need_all_six_tables(spark):
    frames = {"orders": spark.createDataFrame([("o", "c")], "order_id string, customer_id string")}
    assert suites.relation_rules(frames, "orders") == []


def test_gold_verdict_fails_on_missing_dataset(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 1, 1.0)],
                               "date date, gmv double, orders bigint, average_ticket double")
    frames = {"sales_daily": df}
    verdict = suites.layer_verdict(suites.gold_results(frames), suites.missing_gold(frames)).first()
    assert verdict["critical_failures"] == 0 and not verdict["passed"]
    assert "sales_monthly" in verdict["missing_datasets"] and len(verdict["missing_datasets"]) == 12


def test_model_tests_report_broken_models(spark):
    broken = spark.createDataFrame([(None, 1.0), (1, None), (1, 2.0)], "date_key int, gmv double")
    got = {(r["column_name"], r["test"]): r["failed_count"]
           for r in suites.model_test_results({"stg_sales_daily": broken}).collect()}
    assert got == {("date_key", "unique"): 2, ("date_key", "not_null"): 1, ("gmv", "not_null"): 1}


# -- analytics -----------------------------------------------------------------------
def correlations(spark, rows):
    df = spark.createDataFrame(rows, "gmv double, selic_target double")
    return analytics.economic_correlations(df).first()


def test_perfect_correlation(spark):
    row = correlations(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)])
    assert row["observations"] == 3 and row["correlation"] == pytest.approx(1.0)
    assert row["covariance"] == pytest.approx(2.0)


def test_correlation_needs_three_pairs_and_some_spread(spark):
    few = correlations(spark, [(1.0, 2.0), (None, 4.0)])
    assert (few["observations"], few["correlation"], few["covariance"]) == (1, None, None)
    flat = correlations(spark, [(1.0, 2.0), (1.0, 4.0), (1.0, 6.0)])
    assert (flat["correlation"], flat["covariance"]) == (None, 0.0)


def test_review_ratios_skip_unscored(spark):
    reviews = spark.createDataFrame(
        [("r1", "o1", 5, "great"), ("r2", "o1", 1, " "), ("r3", "o2", None, "text"),
         (None, "o9", 2, None)],
        "review_id string, order_id string, review_score bigint, review_comment_message string")
    orders = spark.createDataFrame(
        [("o1", stamp(5), stamp(3)), ("o2", None, stamp(3))],
        "order_id string, order_delivered_customer_date timestamp_ntz,"
        " order_estimated_delivery_date timestamp_ntz")
    counts = analytics.review_counts(reviews, orders)
    summary = {(r["review_score"], r["was_delayed"]): (r["reviews"], r["text_reviews"])
               for r in analytics.review_summary(counts).collect()}
    assert summary == {(5, True): (1, 1), (1, True): (1, 0), (None, False): (1, 1),
                       (2, False): (0, 0)}
    report = analytics.review_report(counts).first()
    assert (report["rows"], report["text_coverage_ratio"]) == (4, 0.5)
    assert report["average_review_score"] == pytest.approx(8 / 3)
    assert report["negative_review_ratio"] == pytest.approx(2 / 3)
    assert report["nlp_recommendation"] == "text_quality_sufficient_for_future_nlp"


def test_strongest_correlation_puts_unknown_last(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", -0.9), ("c", "x", 0.8)],
                               "metric string, indicator string, correlation double")
    assert serving.strongest_correlation(df).first()["metric"] == "b"


def test_best_model_prefers_the_first_on_a_tie(spark):
    df = spark.createDataFrame([(0, "lin", 2.0), (1, "forest", 2.0), (2, "bad", 9.0)],
                               "position int, model_name string, mae double")
    assert serving.best_model(df).first()["best_model"] == "lin"


def test_overall_status(spark):
    def status(rows):
        return monitoring.overall_status(
            spark.createDataFrame(rows, "status string, severity string")).first()["status"]

    assert status([("passed", "info")]) == "passed"
    assert status([("failed", "warning"), ("passed", "info")]) == "warning"
    assert status([("failed", "warning"), ("failed", "critical")]) == "failed"


# -- warehouse -----------------------------------------------------------------------
def star(spark, day=dt.date(2024, 1, 1)):
    daily = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1, 1, 2, 10.005, 1.0, 11.005, None, 0.5)],
        "date date, orders bigint, customers bigint, items_sold bigint, revenue double,"
        " freight_value double, gmv double, average_ticket double, average_freight double")
    calendar = gold.dim_date(
        spark.createDataFrame([(day, day)], "a date, b date"), "a", "b")
    categories = spark.createDataFrame(
        [("toys", 1, 2, 1.0, 1.0, 2.0, 1.0), ("books", 1, 2, 1.0, 1.0, 9.0, 1.0)],
        "category string, orders bigint, items_sold bigint, revenue double,"
        " freight_value double, gmv double, average_ticket double")
    return warehouse.build_tables({
        "dim_date": calendar, "sales_daily": daily, "category_performance": categories,
        "customer_metrics": spark.createDataFrame(
            [("c", "u", None, None)], "customer_id string, customer_unique_id string,"
            " customer_state string, customer_city string"),
        "seller_metrics": spark.createDataFrame(
            [("s", "SP", "sp")], "seller_id string, seller_state string, seller_city string"),
        "economic_indicators": spark.createDataFrame(
            [(dt.date(2024, 1, 1), 1.0, None, 2.0, 3.0)], "reference_month date,"
            " selic_target double, usd_brl double, ibc_br double, ipca double"),
        "sales_monthly": daily.withColumnRenamed("date", "month").withColumn(
            "gmv_mom_growth", F.lit(None).cast("double")),
    })


def test_star_schema_types_and_numbering(spark):
    tables = star(spark)
    fact = tables["fact_sales_daily"]
    assert "date" not in fact.columns and dict(fact.dtypes)["revenue"] == "decimal(18,2)"
    row = fact.first()
    assert (row["date_key"], str(row["revenue"]), row["average_ticket"]) == (20240101, "10.01", None)
    keys = {r["category"]: r["category_key"] for r in tables["dim_category"].collect()}
    assert keys == {"books": 1, "toys": 2}
    assert tables["dim_economic_indicator"].count() == 4
    warehouse.check_constraints(tables)


def test_broken_foreign_key_stops_the_load(spark):
    with pytest.raises(warehouse.ConstraintViolation, match="date_key_references_dim_date"):
        warehouse.check_constraints(star(spark, dt.date(2023, 5, 5)))


def test_models_follow_the_tables(spark):
    models = marts.build_models(star(spark))
    assert len(models) == 10
    assert models["int_sales_calendar"].first()["month_name"] == "January"
    assert models["mart_economic_analysis"].first()["ipca"] == 3.0


# -- models --------------------------------------------------------------------------
def test_error_metrics_leave_out_zero_targets(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 1.0)], "y double, p double")
    row = ml.error_metrics(df, "y", "p").first()
    assert (row["mae"], row["rmse"], row["mape"]) == (1.5, pytest.approx(2.5 ** 0.5), 0.2)
    none = ml.error_metrics(df.where("y = 0"), "y", "p").first()
    assert none["mape"] is None


def _points(spark, points, partitions=5):
    rows = [(i * 7919 + 1, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "key long, x double, y double, z double").repartition(
        partitions)


def test_silhouette_equals_the_definition(spark):
    import numpy as np

    random = np.random.default_rng(3)
    points = random.normal(size=(330, 3)) + np.repeat([[0.0], [4.0], [9.0]], 110, axis=0)
    points[-1] = 40.0
    centres = np.array([[0.0] * 3, [4.0] * 3, [9.0] * 3, [40.0] * 3, [99.0] * 3])
    labels = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    widths = []
    for i in range(len(points)):
        d = ((points - points[i]) ** 2).sum(axis=1)
        own = (labels == labels[i]).sum()
        if own == 1:
            widths.append(0.0)
            continue
        a = d[labels == labels[i]].sum() / (own - 1)
        b = min(d[labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        widths.append((b - a) / max(a, b))
    df = _points(spark, points)
    models = [kmeans.Model(5, 0, centres), kmeans.Model(1, 0, centres[:1])]
    for model, found in zip(models, kmeans.gather(df, [m.centres for m in models]), strict=True):
        model.counts, model.sums, model.squares, model.cost = found
    kmeans.score_silhouettes(df, models)
    assert models[0].silhouette == pytest.approx(np.mean(widths))
    assert models[1].silhouette is None


def test_all_starts_are_fitted_by_the_same_scans(spark):
    """Costs no higher than the library's best of as many starts; scans as of one model."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    random = np.random.default_rng(8)
    points = random.normal(size=(600, 3)) * [1, 2, 0.5] + random.choice([0, 5, 11], (600, 1))
    df = _points(spark, points).cache()
    starts = [(k, seed) for k in (2, 3, 5) for seed in range(6)]
    fitted = kmeans.fit_many(df, starts)
    assert fitted.scans <= kmeans.ITERATIONS + kmeans.ROUNDS + 3
    vectors = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(df).cache()
    for k in (2, 3, 5):
        model = fitted.best(k)
        near = ((points[:, None] - model.centres) ** 2).sum(axis=2)
        assert model.cost == pytest.approx(near.min(axis=1).sum())
        assert model.counts.tolist() == np.bincount(near.argmin(axis=1), minlength=k).tolist()
        library = min(KMeans(k=k, seed=s, featuresCol="v").fit(vectors).summary.trainingCost
                      for s in range(6))
        assert model.cost <= library * 1.0001
        labels = df.select("key", kmeans.nearest(model, ["x", "y", "z"]).alias("c")).collect()
        assert {r["key"]: r["c"] for r in labels} == {
            i * 7919 + 1: int(c) for i, c in enumerate(near.argmin(axis=1))}
    again = kmeans.fit_many(_points(spark, points, 2), starts[:2])
    for one, two in zip(fitted.models, again.models):
        np.testing.assert_allclose(one.centres, two.centres)


def test_fewer_rows_than_clusters_and_none(spark):
    import numpy as np

    same = _points(spark, np.array([[1.0, 2, 3]] * 9 + [[4.0, 4, 4]] * 3))
    model = kmeans.fit_many(same, [(5, 1)]).models[0]
    assert (len(model.centres), model.cost, sorted(model.counts)) == (2, 0.0, [3, 9])
    empty = kmeans.fit_many(same.where("false"), [(3, 1), (2, 2)])
    assert [len(m.centres) for m in empty.models] == [0, 0] and empty.scans == 1


def test_draws_follow_the_squared_distance(spark):
    """Of two rows drawn in 400 seeds, far rows come in proportion to their distance."""
    import numpy as np

    df = _points(spark, np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [4, 0, 0]]), 2)
    seeds = list(range(400))
    drawn = kmeans.draw(df, [np.zeros((1, 3))] * 400, seeds, [1] * 400, 1)
    found = [float(d[:, 0].max()) for d in drawn]
    share = [found.count(v) / 400 for v in (1.0, 2.0, 4.0)]
    np.testing.assert_allclose(share, [1 / 21, 4 / 21, 16 / 21], atol=0.07)


def test_segmentation_finds_separated_groups(spark):
    rows = [(f"c{i}", 10 + i % 3, 20, 5_000.0 + i) for i in range(40)]
    rows += [(f"d{i}", 300 + i % 3, 1, 10.0 + i) for i in range(60)]
    rows += [("skip", None, 1, 1.0)]
    df = spark.createDataFrame(
        rows, "customer_id string, recency_days bigint, frequency bigint, monetary double")
    segments, scores = ml.segment_customers(df, restarts=2)
    best = max(scores.collect(), key=lambda r: r["silhouette"])
    assert best["k"] == 2 and best["silhouette"] > 0.9
    by = {r["ml_segment"]: r["customers"] for r in ml.segment_counts(segments).collect()}
    assert by == {"recent": 40, "at_risk": 60}
    assert segments.count() == 100


def test_clusters_named_by_their_centroids(spark):
    means = spark.createDataFrame(
        [(0, 10.0, 9.0, 900.0), (1, 100.0, 2.0, 50.0), (2, 200.0, 1.0, 40.0), (3, 60.0, 3.0, 80.0)],
        "cluster int, recency_days double, frequency double, monetary double")
    got = {r["cluster"]: r["ml_segment"] for r in ml.name_clusters(means).collect()}
    assert got == {0: "vip", 1: "standard", 2: "at_risk", 3: "standard"}


def test_isolation_forest_flags_the_far_days(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7, 10 + i % 3,
             5.0 + i % 2, 2.0) for i in range(400)]
    for i in (50, 150, 250):
        rows[i] = (rows[i][0], 5_000.0, 900, 80.0, 60.0)
    days = spark.createDataFrame(
        rows, "date date, gmv double, orders bigint, average_ticket double, freight_value double")
    compared = ml.compare_anomaly_methods(gold.anomaly_metrics(days)).cache()
    far = compared.where("gmv = 5000")
    assert far.where("anomaly_method_overlap").count() == 3
    counts = ml.anomaly_counts(compared).first()
    assert counts["rows"] == 400 and 3 <= counts["isolation_forest_anomaly_days"] <= 12
    again = ml.compare_anomaly_methods(gold.anomaly_metrics(days)).where(
        "isolation_forest_anomaly").count()
    assert again == counts["isolation_forest_anomaly_days"]


def test_forecast_reports_both_models(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 1 + i % 5, 1 + i % 5, 2 + i % 5,
             1.0, 10.0 * (1 + i % 5), 10.0) for i in range(60)]
    daily = spark.createDataFrame(
        rows, "date date, orders bigint, customers bigint, items_sold bigint,"
        " freight_value double, gmv double, average_ticket double")
    got = {r["model_name"]: r for r in ml.train_forecast(
        gold.ml_features(daily), trees=5, depth=5).collect()}
    assert set(got) == {"linear_regression", "random_forest"}
    assert got["linear_regression"]["mae"] < 1e-6
    assert (got["random_forest"]["train_rows"], got["random_forest"]["test_rows"]) == (42, 11)


def _plain_tree(rows, target, weight):
    """Best split by trying every midpoint of every feature, depth first."""
    import numpy as np

    mean = np.average(target, weights=weight)
    best = (0.0, None)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for a, b in zip(values, values[1:], strict=False):
            low = rows[:, f] <= (a + b) / 2
            error = sum((weight[s] * (target[s] - np.average(target[s], weights=weight[s])) ** 2
                         ).sum() for s in (low, ~low))
            gain = (weight * (target - mean) ** 2).sum() - error
            if gain > best[0] * (1 + 1e-9) and gain > 1e-12:
                best = (gain, (f, (a + b) / 2, low))
    if best[1] is None or len(set(target)) == 1:
        return lambda x: mean
    f, cut, low = best[1]
    left = _plain_tree(rows[low], target[low], weight[low])
    right = _plain_tree(rows[~low], target[~low], weight[~low])
    return lambda x: left(x) if x[f] <= cut else right(x)


@pytest.mark.parametrize("seed", range(5))
def test_trees_equal_a_search_of_all_midpoints(seed):
    import numpy as np

    random = np.random.default_rng(seed)
    rows = np.column_stack([random.normal(size=70), random.integers(0, 4, 70),
                            random.normal(size=70).round(1)])
    target = 3 * rows[:, 0] + rows[:, 1] ** 2 + random.normal(size=70)
    weight = trees.bootstrap_weights(70, 42, seed)
    assert weight.sum() == 70
    tree = trees.grow(rows, target, weight)
    held = weight > 0
    plain = _plain_tree(rows[held], target[held], weight[held].astype(float))
    fresh = np.column_stack([random.normal(size=200), random.integers(0, 4, 200),
                             random.normal(size=200)])
    np.testing.assert_allclose(tree.predict(fresh), [plain(x) for x in fresh])
    np.testing.assert_allclose(tree.predict(rows[held]), target[held])
    stump = trees.grow(rows, target, weight, depth=1)
    assert (stump.feature >= 0).sum() == 1 and len(stump.value) == 3
    assert len(trees.grow(rows, np.ones(70)).value) == 1
    assert len(trees.grow(np.ones((5, 2)), np.arange(5.0)).value) == 1


def test_forest_is_the_mean_of_its_trees(spark):
    import numpy as np

    random = np.random.default_rng(2)
    rows = [(i, *map(float, random.normal(size=2)), float(i % 7), i < 80) for i in range(100)]
    df = spark.createDataFrame(rows, "day int, a double, b double, y double, t boolean")
    got = {r["day"]: r["predicted"] for r in trees.forest_predictions(
        df.repartition(4), "day", ["a", "b"], "y", "t", 7, None, 42).collect()}
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    want = np.mean([trees.grow(x[:80], y[:80], trees.bootstrap_weights(80, 42, n)).predict(x[80:])
                    for n in range(7)], axis=0)
    np.testing.assert_allclose([got[i] for i in range(80, 100)], want)
    none = trees.forest_predictions(df.where("not t"), "day", ["a", "b"], "y", "t", 3, None, 1)
    assert none.count() == 0
