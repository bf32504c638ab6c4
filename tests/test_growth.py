"""Steps whose time or memory once grew with the files: what bounds them, and equal results."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from saleslode.catalogue import lake as catalogue_lake
from saleslode.functions import line_total, stable_sum
from saleslode.operators import keys
from saleslode.operators.keys import flag_duplicate_keys
from saleslode.plans import build, gold, serving
from saleslode.session import collect_garbage
from saleslode.sinks import writers
from saleslode.sources import landing


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segment_categories_counts_orders_without_a_set(spark):
    """Repeated orders and customers multiply sums but are one order."""
    segments = spark.createDataFrame(
        [(1, "vip"), (2, "recent"), (2, "recent"), (3, "vip"), (4, None)],
        "customer_id int, ml_segment string")
    orders = spark.createDataFrame(
        [(10, 1), (10, 1), (11, 2), (12, 3), (13, None), (None, 1), (12, 1), (14, 4)],
        "order_id int, customer_id int")
    items = spark.createDataFrame(
        [(10, 1, 1.25, 0.5), (10, 1, 1.25, 0.5), (10, 2, None, 1.0), (11, 9, 3.1, 0.2),
         (12, None, 4.0, 0.1), (None, 1, 9.0, 9.0), (13, 1, 7.0, 7.0), (14, 2, 2.0, None)],
        "order_id int, product_id int, price double, freight_value double")
    categorised = spark.createDataFrame([(1, "a"), (2, None)], "product_id int, category string")
    found = serving.segment_categories(segments, orders, items, categorised)
    known = F.coalesce("category", F.lit("unknown")).alias("category")
    plain = items.join(categorised, "product_id", "left").select(
        "order_id", known, "price", "freight_value"
    ).join(orders.join(segments, "customer_id"), "order_id").groupBy(
        "ml_segment", "category"
    ).agg(stable_sum(line_total()).alias("gmv"), F.countDistinct("order_id").alias("orders"),
          F.count(F.lit(1)).alias("items"))
    rows = lambda df: sorted((tuple(r) for r in df.select(
        "ml_segment", "category", "gmv", "orders", "items").collect()), key=str)
    assert rows(found) == rows(plain) and found.dtypes == plain.dtypes
    assert "distinct" not in plan_of(found) and "REPARTITION_BY_NUM" in plan_of(found)
    assert plan_of(found).count("REPARTITION_BY_NUM") == 3


def test_rows_are_not_shuffled_for_few_repeated_keys(spark):
    rows = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (3, "f")],
        "k int, text string")
    flagged = flag_duplicate_keys(rows, ["k"], stored=True)
    assert "Exchange hashpartitioning" not in plan_of(flagged)
    assert {r["text"]: r["is_duplicate_key"] for r in flagged.collect()} == {
        "a": True, "b": True, "c": False, "d": True, "e": True, "f": False}


def test_gold_frames_read_items_of_orders_once(spark):
    """Customers and sales come from one stored fact; indicators are stored."""
    orders = spark.createDataFrame(
        [("o1", "c1", 1), ("o2", "c1", None), ("o3", "c2", 2), (None, "c2", 3), ("o1", "c1", 1)],
        "order_id string, customer_id string, day int").select(
        "order_id", "customer_id",
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, day)").alias(
            "order_purchase_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_customer_date"),
        F.lit(None).cast("timestamp_ntz").alias("order_estimated_delivery_date"))
    items = spark.createDataFrame(
        [("o1", "p1", "s1", 1.5, 0.5), ("o1", "p1", "s1", None, 0.5), ("o2", "p1", "s1", 2.0, 1.0),
         (None, "p1", "s1", 5.0, 1.0)],
        "order_id string, product_id string, seller_id string, price double, freight_value double")
    customers = spark.createDataFrame(
        [("c1", "u", "SP", "sp"), ("c2", "v", "RJ", "rio")],
        "customer_id string, customer_unique_id string, customer_state string,"
        " customer_city string")
    facts = gold.order_facts(orders, items)
    expected = gold.order_sales(orders, items)
    assert gold.sales_of_facts(facts).columns == expected.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(gold.sales_of_facts(facts)) == rows(expected)
    statistics = spark.createDataFrame(
        [("2024-01-01", "ipca", 1.0)], "d string, indicator_name string, value double").select(
        F.to_date("d").alias("reference_month"), "indicator_name", "value")
    series = statistics.select(F.col("reference_month").alias("date"),
                               F.lit("usd_brl").alias("indicator_name"), "value")
    sources = {
        "orders": orders, "order_items": items, "customers": customers,
        "products": spark.createDataFrame([("p1", "x")],
                                          "product_id string, product_category_name string"),
        "product_category_name_translation": spark.createDataFrame(
            [("x", "y")],
            "product_category_name string, product_category_name_english string"),
        "sellers": spark.createDataFrame(
            [("s1", "SP", "sp")], "seller_id string, seller_state string, seller_city string"),
        "order_reviews": spark.createDataFrame(
            [("r", 5)], "review_id string, review_score bigint").select(
            "*", F.lit(None).cast("timestamp_ntz").alias("review_creation_date")),
    }
    frames = build.gold_frames(sources, series, statistics)
    # Without the stored frames, both would read and group their sources again.
    assert "sum(price#" not in plan_of(frames["customer_metrics"])
    assert "indicator_name" not in plan_of(frames["sales_economic_features"])
    assert rows(frames["customer_metrics"]) == rows(
        gold.customer_metrics(customers, orders, items))


def test_keys_of_one_hash_are_told_apart(spark, monkeypatch):
    """NULL moves between columns without a change of the hash; few and many repeats agree."""
    rows = [("a", None, 1), (None, "a", 2), ("b", "c", 3), ("b", "c", 4), (None, None, 5),
            (None, None, 6), ("d", None, 7)]
    df = spark.createDataFrame(rows, "k string, l string, i int")
    assert df.select(F.xxhash64("k", "l").alias("h")).distinct().count() < 5
    for most in (keys.BROADCAST_KEYS, 1, 0):
        monkeypatch.setattr(keys, "BROADCAST_KEYS", most)
        flagged = flag_duplicate_keys(df, ["k", "l"], stored=True)
        assert flagged.columns == ["k", "l", "i", "is_duplicate_key"]
        assert {r.i: r.is_duplicate_key for r in flagged.collect()} == {
            i: 3 <= i <= 6 for *_, i in rows}
    alone = flag_duplicate_keys(df.where("i in (1, 3, 7)"), ["k", "l"], stored=True)
    assert alone.where("not is_duplicate_key").count() == 3
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_landed_text_is_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(catalogue_lake.LANDED, "maxRecordsPerFile", 40)
    df = spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("a"),
                                          F.lit('two\nlines, "quoted"').alias("b"))
    catalogue_lake._land_csv(df, f"{tmp_path}/x.csv")
    parts = [p.name for p in (tmp_path / "x.csv").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 3 and all(p.endswith(".csv.gz") for p in parts)
    back = landing.scan_csv(spark, f"{tmp_path}/x.csv", True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_a_silver_build_leaves_no_shuffle_files(spark, layout):
    """Shuffles of one dataset go before the next, not when the driver's heap is full."""
    def files():
        manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(i).toString() for i in range(found.size())
                if found.apply(i).getName().startswith("shuffle_")}

    collect_garbage(spark)
    before = files()
    rows = spark.range(2000).select((F.col("id") % 1500).cast("string").alias("order_id"),
                                    F.lit("1").alias("order_item_id"))
    for name in ("order_items", "orders"):
        writers.append_batch(rows, f"{layout.bronze}/olist/{name}", "olist_1")
    built = build.build_silver(spark, layout)
    assert [r.rows_output for r in built.collect()] == [2000, 2000]
    for _ in range(40):
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
