"""Landing to marts on disk."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.operators.numbering import dense_numbers
from saleslode.plans import bronze, build, marts, monitoring, serving, warehouse
from saleslode.settings import SERIES_INDICATORS, Layout
from saleslode.sinks import star, writers
from saleslode.sources import files, lake, landing, reports

CUSTOMERS = ("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,"
             "customer_state\nc1,u1,12345,\" São Paulo \",SP\nc2,u2,00001,NA,RJ\n")
ORDERS = ("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
          "order_delivered_carrier_date,order_delivered_customer_date,"
          "order_estimated_delivery_date\n"
          "o1,c1,delivered,2017-01-05 10:00:00,,,2017-01-09 10:00:00,2017-01-08 00:00:00\n"
          "o2,c1,delivered,2017-02-05 23:59:00,,,2017-02-06 00:01:00,2017-02-28 00:00:00\n"
          "o3,c2,shipped,2017-02-07 08:00:00,,,,2017-02-28 00:00:00\n")
ITEMS = ("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
         "o1,1,p1,s1,2017-01-07 00:00:00,10.0,1.0\no1,2,p2,s1,2017-01-07 00:00:00,5.0,0.5\n"
         "o2,1,p1,s1,2017-02-07 00:00:00,20.0,2.0\no3,1,p1,s1,2017-02-09 00:00:00,30.0,3.0\n")
PAYMENTS = ("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
            "o1,1,credit_card,2,16.5\no2,1,boleto,1,22.0\no3,1,pix,1,33.0\n")
REVIEWS = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
           "review_creation_date,review_answer_timestamp\n"
           "r1,o1,5,,\"two\nlines, \"\"quoted\"\"\",2017-01-10 00:00:00,2017-01-11 00:00:00\n"
           "r2,o2,1,,,2017-02-10 00:00:00,2017-02-11 00:00:00\n")
PRODUCTS = ("product_id,product_category_name,product_name_lenght,product_description_lenght,"
            "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,"
            "product_width_cm\np1, Brinquedos ,10,20,1,100,1,1,1\np2,,5,5,1,100,1,1,1\n")
SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,sp,SP\n"
TRANSLATION = ("product_category_name,product_category_name_english\nbrinquedos,toys\n")
TEXTS = {
    "customers": CUSTOMERS, "orders": ORDERS, "order_items": ITEMS, "order_payments": PAYMENTS,
    "order_reviews": REVIEWS, "products": PRODUCTS, "sellers": SELLERS,
    "product_category_name_translation": TRANSLATION,
}


def land_sales(folder: Path, names=tuple(TEXTS)) -> str:
    for name in names:
        (folder / fixed.EXPECTED_FILES[name]).write_text(TEXTS[name], encoding="utf-8")
    return str(folder)


def land_series(folder: Path) -> dict[str, str]:
    paths = {}
    for i, indicator in enumerate(SERIES_INDICATORS):
        rows = [{"data": f"0{d}/0{m}/2017", "valor": f"{i + m},{d}5"}
                for m in (1, 2) for d in (1, 2)]
        path = folder / f"{indicator.name}.json"
        path.write_text(json.dumps(rows), encoding="utf-8")
        paths[indicator.name] = str(path)
    return paths


def land_statistics(folder: Path) -> dict[str, str]:
    header = {"V": "Valor", "MN": "Unidade", "D1C": "c", "D1N": "n", "D2C": "c", "D2N": "n",
              "D3C": "Mês (Código)", "D3N": "Mês"}
    rows = [header] + [
        {"V": str(m / 10), "MN": "%", "D1C": "1", "D1N": "Brasil", "D2C": "63", "D2N": "IPCA",
         "D3C": f"20170{m}", "D3N": f"mês {m}"} for m in (1, 2)
    ]
    path = folder / "ipca.json"
    path.write_text(json.dumps(rows), encoding="utf-8")
    return {"ipca": str(path)}


def test_one_file_is_loaded_and_the_others_listed(spark, layout, tmp_path):
    manifest = bronze.ingest_sales_csvs(spark, land_sales(tmp_path, ["customers"]), layout)
    assert len(manifest.missing_references) == 8
    df = lake.read_latest(spark, f"{layout.bronze}/olist/customers")
    rows = {r["customer_id"]: r for r in df.collect()}
    assert rows["c1"]["source"] == "olist"
    assert rows["c1"]["source_file"] == "olist_customers_dataset.csv"
    assert rows["c2"]["customer_city"] is None and rows["c2"]["customer_zip_code_prefix"] == "00001"
    assert manifest.batch_id.startswith("olist_20") and len(manifest.batch_id.split("_")[-1]) == 8
    saved = spark.read.json(f"{layout.bronze}/olist/_manifests/{manifest.batch_id}").first()
    assert (saved["files_written"], saved["records_read"]) == (1, 2)


def test_free_text_keeps_its_line_breaks(spark, tmp_path):
    source = land_sales(tmp_path, ["order_reviews"])
    frames, _ = landing.scan_expected_csvs(spark, source)
    rows = frames["order_reviews"].orderBy("review_id").collect()
    assert [r["review_comment_message"] for r in rows] == ['two\nlines, "quoted"', None]


def test_series_range_and_empty_payload(spark, tmp_path):
    path = land_series(tmp_path)["usd_brl"]
    rows = landing.scan_series(spark, path, 1, "02/01/2017", "01/02/2017").orderBy("date").collect()
    assert [str(r["date"]) for r in rows] == ["2017-01-02", "2017-02-01"]
    assert [r["value"] for r in rows] == [2.25, 3.15]
    empty = tmp_path / "empty.json"
    empty.write_text("[]", encoding="utf-8")
    none = landing.scan_series(spark, str(empty), 1)
    assert none.columns == ["date", "value", "series_code"] and none.count() == 0


def test_newest_batch_replaces_the_older(spark, layout):
    target = f"{layout.bronze}/olist/orders"
    with pytest.raises(lake.DatasetNotFound):
        lake.read_latest(spark, target)
    writers.append_batch(spark.range(5), target, "b_1")
    writers.append_batch(spark.range(2), target, "a_2")
    assert lake.latest_batch(spark, target) == "a_2"
    assert lake.read_latest(spark, target).count() == 2
    writers.append_batch(spark.range(3), target, "a_2")
    assert spark.read.parquet(target).count() == 8
    spark.range(1).write.parquet(f"{layout.bronze}/olist/_manifests/batch_id=x")
    assert lake.datasets_below(spark, f"{layout.bronze}/olist") == ["orders"]


def test_bronze_checks(spark, layout):
    good = bronze.with_load_metadata(spark.range(2), "olist", "b", datetime.now(UTC))
    writers.append_batch(good, f"{layout.bronze}/olist/orders", "b")
    writers.append_batch(spark.range(1).withColumn("source", F.lit("x")),
                         f"{layout.bronze}/olist/items", "b")
    broken = Path(f"{layout.bronze}/olist/broken/batch_id=b")
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"not parquet")
    got = {r["path"].split("/")[-2]: r for r in bronze.validate_bronze(spark, layout).collect()}
    assert got["orders"]["passed"] and got["orders"]["rows"] == 2
    assert got["items"]["missing_columns"] == ["ingestion_timestamp"]
    assert not got["broken"]["passed"] and "Could not read" in got["broken"]["message"]
    verdict = bronze.bronze_verdict(bronze.validate_bronze(spark, layout)).first()
    assert (verdict["files_checked"], verdict["files_failed"], verdict["passed"]) == (3, 2, False)


def test_bronze_checks_of_many_batches(spark, layout, tmp_path):
    """500 batches take as many jobs as 200; one broken file fails its batch."""
    good = pa.table({"source": ["x"] * 3, "ingestion_timestamp": [datetime.now(UTC)] * 3})
    part = good.drop_columns(["source"])

    def jobs(name, batches):
        bronze_dir = tmp_path / name / "bronze"
        for i in range(batches):
            folder = bronze_dir / f"olist/orders {i % 5}/batch_id=b{i}"
            folder.mkdir(parents=True)
            pq.write_table(good, folder / "a.parquet")
            pq.write_table(part if i == 2 else good, folder / "b.parquet")
        (bronze_dir / "olist/orders 1/batch_id=b1/b.parquet").write_bytes(b"PAR1 cut")
        (bronze_dir / "olist/orders 1/batch_id=none").mkdir()
        spark.sparkContext.setJobGroup(name, name)
        rows = bronze.validate_bronze(spark, Layout(str(tmp_path / name), "unused")).collect()
        spark.sparkContext.setJobGroup("tests", "tests")
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    (_, few), (rows, many) = jobs("few", 200), jobs("many", 500)
    got = {r["path"].rsplit("=", 1)[1]: r for r in rows}
    assert len(rows) == len(got) == 501
    assert (got["b1"]["passed"], got["b1"]["rows"], got["b1"]["columns"]) == (False, 0, 0)
    assert got["b1"]["message"].startswith("Could not read") and len(got["b1"][4]) == 3
    assert got["none"]["message"].startswith("Could not read") and not got["none"]["passed"]
    assert (got["b2"]["passed"], got["b2"]["missing_columns"]) == (False, ["source"])
    assert got["b2"]["message"] == "Missing required bronze columns: ['source']"
    rest = [r for name, r in got.items() if name not in ("b1", "b2", "none")]
    assert all(r["passed"] and (r["rows"], r["columns"]) == (6, 3) for r in rest)
    assert many == few


def test_bronze_checks_without_the_footer_library(spark, layout, monkeypatch):
    good = bronze.with_load_metadata(spark.range(2), "olist", "b", datetime.now(UTC))
    writers.append_batch(good, f"{layout.bronze}/olist/orders", "b")
    writers.append_batch(spark.range(1), f"{layout.bronze}/olist/items", "b")
    by_footers = {tuple(map(str, r)) for r in bronze.validate_bronze(spark, layout).collect()}
    real = bronze.check_batches
    monkeypatch.setattr(bronze, "check_batches", lambda *args: real(*args).withColumn(
        "reached", F.lit(False)))
    assert {tuple(map(str, r))
            for r in bronze.validate_bronze(spark, layout).collect()} == by_footers


def test_reports_are_chosen_by_name(spark, layout):
    with pytest.raises(lake.DatasetNotFound):
        reports.latest_report(spark, layout, "kpis")
    with pytest.raises(lake.DatasetNotFound):
        reports.latest_report(spark, layout, "unknown")
    for year in (2025, 2023):
        df = spark.createDataFrame([(year,)], "y int")
        writers.write_report(df, layout.gold, "_analytics_reports/kpis_",
                             datetime(year, 1, 1, tzinfo=UTC))
    assert reports.latest_report(spark, layout, "kpis").first()["y"] == 2025


def test_run_log_appends(spark, layout):
    log = writers.RunLog("r1", "gold", datetime(2024, 1, 1, tzinfo=UTC), None, None, 1, 2, 3,
                         "silver", "gold", "running")
    path = f"{layout.data}/monitoring/pipeline_runs"
    writers.append_run(log, spark, path)
    writers.append_run(log, spark, path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 and len(rows.columns) == 12
    assert rows.first()["records_rejected"] == 3


def test_health_of_an_empty_lake(spark, layout):
    status = monitoring.overall_status(monitoring.health_checks(spark, layout)).first()
    assert (status["status"], status["checks_failed"], status["checks_warned"]) == ("failed", 16, 9)


def test_landing_to_marts(spark, layout, tmp_path):
    bronze.ingest_sales_csvs(spark, land_sales(tmp_path), layout)
    bronze.ingest_series(spark, land_series(tmp_path), layout)
    bronze.ingest_statistics(spark, land_statistics(tmp_path), layout)
    bronze_checks = bronze.validate_bronze(spark, layout)
    assert bronze.bronze_verdict(bronze_checks).first()["passed"]

    silver_rows = {r["dataset"]: r for r in build.build_silver(spark, layout, True).collect()}
    assert len(silver_rows) == 12
    assert all(r["rows_input"] == r["rows_output"] for n, r in silver_rows.items()
               if n != "ibge.ipca")
    assert (silver_rows["ibge.ipca"]["rows_input"], silver_rows["ibge.ipca"]["rows_output"]) == (
        3, 2)
    saved = reports.latest_report_path(spark, layout.silver, "_reports/silver_build_")
    profile = spark.read.json(saved).where("dataset = 'olist.orders'").first()
    assert profile["profile_after"]["rows"] == 3

    results = build.validate_silver(spark, layout)
    failed = {(r["dataset"], r["rule_name"]) for r in results.where("not passed").collect()}
    assert failed == {("order_payments", "payment_type_accepted_values")}

    built = {r["dataset"]: r["rows"] for r in build.build_gold(spark, layout).collect()}
    assert built["sales_daily"] == 3 and built["sales_monthly"] == 2 and built["dim_date"] == 34
    assert build.validate_gold(spark, layout).first()["passed"]
    gold = build.read_gold(spark, layout)
    assert len(gold) == 13
    features = gold["sales_economic_features"].orderBy("month").collect()
    assert features[1]["ipca"] == 0.2 and features[1]["ipca_change"] == pytest.approx(0.1)
    assert gold["category_performance"].where("category = 'toys'").first()["gmv"] == 66.0
    assert gold["category_performance"].where("category = 'unknown'").first()["gmv"] == 5.5

    tables = warehouse.build_tables(gold)
    warehouse.check_constraints(tables)
    counts = writers.save_tables(tables, "star_test")
    assert counts["star_test.fact_sales_daily"] == 3 and len(counts) == 9
    models = marts.build_models(marts.source_tables(spark, "star_test"))
    assert len(marts.publish_models(models, "mart_test")) == 10
    assert spark.table("mart_test.mart_sales").count() == 2
    found = serving.catalog(spark, layout)
    assert found.where("kind = 'gold'").count() == 13
    for schema in ("mart_test", "star_test"):
        spark.sql(f"drop schema {schema} cascade")


def test_a_failed_load_leaves_the_star(spark, tmp_path):
    """Readers, views and a second session see the last whole load; old versions go."""
    place, good = str(tmp_path / "star"), {
        "one": spark.createDataFrame([(1, "a")], "k int, v string"),
        "two": spark.createDataFrame([(1,), (2,)], "k int")}

    def no_repeats(tables):
        assert set(tables) == {"one", "two"}
        if tables["one"].count() != tables["one"].distinct().count():
            raise ValueError("repeated")

    with pytest.raises(star.NotLoaded):
        star.current_version(spark, "star_case")
    assert star.load_star(spark, good, "star_case", no_repeats, place) == {"one": 1, "two": 2}
    first = star.current_version(spark, "star_case")
    good["one"].createOrReplaceTempView("passing_view")
    assert set(star.read_star(spark, "star_case")) == {"one", "two"}
    broken = {**good, "two": good["two"].limit(1), "one": good["one"].union(good["one"])}
    with pytest.raises(ValueError):
        star.load_star(spark, broken, "star_case", no_repeats, place)
    failing = {**good, "two": good["two"].select(F.raise_error(F.lit("lost")).alias("k"))}
    with pytest.raises(Exception, match="lost"):
        star.load_star(spark, failing, "star_case", no_repeats, place)
    assert star.current_version(spark, "star_case") == first
    assert star.read_star(spark, "star_case")["two"].count() == 2
    assert spark.newSession().table("star_case.two").count() == 2
    versions = [first]
    for rows in ([(7, "b")], [(8, "c")], [(9, "d")]):
        star.load_star(spark, {**good, "one": spark.createDataFrame(rows, "k int, v string")},
                       "star_case", no_repeats, place)
        versions.append(star.current_version(spark, "star_case"))
        assert [tuple(r) for r in spark.table("star_case.one").collect()] == rows
    held = {d.name for d in spark.catalog.listDatabases()}
    assert [v in held for v in versions] == [False, False, True, True]
    star.drop_star(spark, "star_case")
    assert not spark.catalog.databaseExists("star_case")


def test_models_are_published_after_what_they_read():
    found = marts.definitions("s", "m")
    assert set(found) == {*marts.STAGING, "int_sales_calendar", "int_sales_economic_monthly",
                          *marts.MARTS}
    for _, (reads, sql) in found.items():
        assert all(f"m.{r} " in f"{sql} " for r in reads) and set(reads) <= set(found)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_dense_numbers_follow_the_order(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("g"), "id")
        got = dense_numbers(df, (F.col("g").desc_nulls_last(), F.col("id").asc()), "no")
        rows = sorted(got.collect(), key=lambda r: (r["g"] is None, -(r["g"] or 0), r["id"]))
        assert [r["no"] for r in rows] == list(range(1, 3001))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert dense_numbers(df.limit(0), (F.col("id").asc(),), "no").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_paths_list_only_one_level(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "deep").mkdir()
    (tmp_path / "b.txt").write_text("x", encoding="utf-8")
    assert [(e.name, e.is_dir) for e in files.entries(spark, str(tmp_path))] == [
        ("a", True), ("b.txt", False)]
    assert files.entries(spark, str(tmp_path / "none")) == []
