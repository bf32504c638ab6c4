"""Round trips through a lake in the shared folder: landing, batches, layers, reports."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.silver import (
    raw_items,
    raw_orders,
    raw_reviews,
    raw_statistics,
)
from saleslode.catalogue.sqltext import oracle
from saleslode.plans import bronze, build, monitoring, serving, silver
from saleslode.session import collect_garbage, scratch_path
from saleslode.settings import Layout
from saleslode.sinks import writers
from saleslode.sources import lake, landing, reports
from saleslode.sources.shipped import ShippedTables


def _layout(spark: SparkSession, label: str) -> Layout:
    base = scratch_path(spark, label)
    return Layout(f"{base}/data", f"{base}/models")


# Landed text is compressed. Such a file does not split, so it holds so many rows at most.
LANDED = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}


def _land_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"', **LANDED).csv(path)


def _landed_sales(spark: SparkSession, folder: str, base: str) -> str:
    """All nine files as CSV under their expected names; reviews span several lines."""
    t = ShippedTables(spark, folder)
    tables = {"orders": raw_orders(spark, folder), "order_items": raw_items(spark, folder),
              "order_reviews": raw_reviews(spark, folder), "products": t.products(),
              "customers": t.customers(), "order_payments": t.order_payments(),
              "sellers": t.sellers(), "geolocation": t.geolocation(),
              "product_category_name_translation": t.translation()}
    for name, df in tables.items():
        _land_csv(df, f"{base}/{fixed.EXPECTED_FILES[name]}")
        collect_garbage(spark)
    return base


def _csv_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of landing the nine expected files."""
    layout = _layout(spark, "csv")
    source = _landed_sales(spark, folder, scratch_path(spark, "landing"))
    manifest = bronze.ingest_sales_csvs(spark, source, layout)
    rows = manifest.to_frame(spark)
    return rows.select(
        F.explode("tables").alias("t"), "files_written", "records_read",
        F.size("missing_references").alias("missing_files"),
    ).select("t.name", "t.rows_read", "t.columns_read", "files_written", "records_read",
             "missing_files")


def _bronze_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items through CSV and Bronze, then typed: what Silver reads is what was landed."""
    layout = _layout(spark, "bronze")
    path = f"{scratch_path(spark, 'landing')}/items.csv"
    _land_csv(raw_items(spark, folder), path)
    loaded = bronze.with_load_metadata(
        landing.scan_csv(spark, path), "olist", "olist_first", datetime.now(UTC), "items.csv"
    )
    writers.append_batch(loaded, f"{layout.bronze}/olist/order_items", "olist_first")
    current = lake.read_latest(spark, f"{layout.bronze}/olist/order_items")
    typed = silver.flag_rows(current, "order_items")
    return typed.select("batch_id", "source", "order_id", "order_item_id", "price",
                        "has_invalid_price")


def _land_series(spark: SparkSession, folder: str) -> dict[str, str]:
    """The three series as JSON lines in the landed layout, by indicator."""
    t, base = ShippedTables(spark, folder), scratch_path(spark, "series-json")
    for indicator in fixed.SERIES_INDICATORS:
        t.one_series(indicator.name).select(
            F.date_format("date", "dd/MM/yyyy").alias("data"),
            F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("valor"),
        ).write.options(**LANDED).json(f"{base}/{indicator.name}")
    return {i.name: f"{base}/{i.name}" for i in fixed.SERIES_INDICATORS}


def _series_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All landed series as one batch, then one of them again for a year, through Silver."""
    layout, landed = _layout(spark, "series"), _land_series(spark, folder)
    bronze.ingest_series(spark, landed, layout, lines=True)
    first = fixed.SERIES_INDICATORS[0]
    bronze.ingest_one_series(spark, landed[first.name], first, layout, "01/01/1996", "31/12/1996",
                             lines=True)
    build.build_silver(spark, layout)
    current = lake.read_latest_below(spark, f"{layout.silver}/{fixed.SERIES_SOURCE}")
    rows = reduce(DataFrame.unionByName, [
        df.select("indicator_name", "series_code", "date", "value") for df in current.values()])
    return rows.groupBy("indicator_name", "series_code", F.col("date").cast("date").alias("day")
                        ).agg(F.count(F.lit(1)).alias("rows"),
                              F.round(F.sum("value"), 6).alias("value_sum"))


def _land_statistics(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "statistics-json")
    raw_statistics(spark, folder).drop("indicator_name").write.options(**LANDED).json(path)
    return path


def _statistics_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A landed JSON statistics table with its header record, through Bronze and Silver."""
    layout = _layout(spark, "statistics")
    (indicator,) = fixed.STATISTICS_INDICATORS
    bronze.ingest_one_statistics(spark, _land_statistics(spark, folder), indicator, layout,
                                 lines=True)
    build.build_silver(spark, layout)
    typed = lake.read_latest(spark, f"{layout.silver}/{fixed.STATISTICS_SOURCE}/{indicator.name}")
    return typed.groupBy("reference_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("values_present")
    )


def _whole_silver(spark: SparkSession, folder: str) -> tuple[Layout, DataFrame]:
    """Every source landed and ingested by its entry point, and Silver built over it."""
    layout = _layout(spark, "layers")
    bronze.ingest_sales_csvs(
        spark, _landed_sales(spark, folder, scratch_path(spark, "landing")), layout)
    bronze.ingest_series(spark, _land_series(spark, folder), layout, lines=True)
    bronze.ingest_statistics(
        spark, {i.name: _land_statistics(spark, folder) for i in fixed.STATISTICS_INDICATORS},
        layout, lines=True)
    return layout, build.build_silver(spark, layout)


def _silver_build(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of the Silver build, with the rows that its datasets hold when read back."""
    layout, results = _whole_silver(spark, folder)
    held = [
        df.agg(F.count(F.lit(1)).alias("rows_read")).select(
            F.lit(f"{source}.{name}").alias("dataset"), "rows_read")
        for source in fixed.SOURCES
        for name, df in lake.read_latest_below(spark, f"{layout.silver}/{source}").items()
    ]
    return results.join(reduce(DataFrame.unionByName, held), "dataset").select(
        F.substring_index("dataset", ".", -1).alias("dataset"), "rows_input", "rows_output",
        "rows_read")


def _run_log(spark: SparkSession, folder: str) -> DataFrame:
    """A run of series ingestion and Silver, and a failed one, appended and read back."""
    layout, started = _layout(spark, "runs"), datetime.now(UTC)
    manifest = bronze.ingest_series(spark, _land_series(spark, folder), layout, lines=True)
    built = build.build_silver(spark, layout).agg(F.sum("rows_output")).first()[0]
    path, finished = f"{layout.silver}/_runs", datetime.now(UTC)
    read = sum(t.rows_read for t in manifest.tables)
    done = writers.RunLog("run_1", "series", started, finished,
                          (finished - started).total_seconds(), read, built, read - built,
                          manifest.source, layout.silver, "success")
    writers.append_run(done, spark, path)
    writers.append_run(writers.RunLog("run_2", "series", started, None, None, 0, 0, 0,
                                      manifest.source, layout.silver, "failed", "stopped"),
                       spark, path)
    return spark.read.parquet(path).select(
        "run_id", "pipeline_name", "records_read", "records_written", "records_rejected",
        "status", "error_message",
        F.coalesce(F.col("duration_seconds") > 0, F.lit(False)).alias("has_duration"))


def _latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of one dataset: the second replaces the first as a whole."""
    layout = _layout(spark, "batches")
    target = f"{layout.bronze}/olist/orders"
    orders = ShippedTables(spark, folder).orders()
    writers.append_batch(orders, target, "olist_1")
    writers.append_batch(orders.where(F.col("order_status") == "F"), target, "olist_2")
    return lake.read_latest(spark, target).groupBy("batch_id", "order_status").agg(
        F.count(F.lit(1)).alias("orders")
    )


def _latest_below(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the current batch of every dataset below a source, read through views."""
    layout = _layout(spark, "leaves")
    t = ShippedTables(spark, folder)
    for name, df in {"orders": t.orders(), "customers": t.customers()}.items():
        writers.append_batch(df, f"{layout.silver}/olist/{name}", "olist_1")
    names = lake.register_views(spark, layout.silver)
    parts = [f"select '{n}' as view_name, count(*) as rows from {n}" for n in names]
    return spark.sql(" union all ".join(parts))


def _overwritten(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset written twice holds the second content once, with its typed columns."""
    layout = _layout(spark, "gold")
    customers = ShippedTables(spark, folder).customers()
    writers.overwrite_dataset(customers, layout.gold, "customers", "one row per customer_id")
    typed = customers.select("customer_id", "customer_state")
    path = f"{layout.gold}/customers"
    rows = writers.write_typed(typed, path, {"customer_id": "string", "customer_state": "string"})
    return lake.read_dataset(spark, layout.gold, "customers").groupBy("customer_state").agg(
        F.count("customer_id").alias("customers"), F.max(F.lit(rows)).cast("bigint").alias("written")
    )


def _bronze_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata checks of one complete and one incomplete batch."""
    layout = _layout(spark, "checks")
    t = ShippedTables(spark, folder)
    loaded = bronze.with_load_metadata(t.customers(), "olist", "olist_1", datetime.now(UTC))
    writers.append_batch(loaded, f"{layout.bronze}/olist/customers", "olist_1")
    writers.append_batch(t.sellers(), f"{layout.bronze}/olist/sellers", "olist_1")
    return bronze.validate_bronze(spark, layout).select(
        F.element_at(F.split("path", "/"), -2).alias("dataset"), "passed", "rows", "columns",
        F.concat_ws(",", "missing_columns").alias("missing_columns"),
    )


def _full_build(spark: SparkSession, folder: str) -> DataFrame:
    """Silver batches to all 13 Gold datasets on disk: dataset, rows and grain."""
    layout = _layout(spark, "build")
    t = ShippedTables(spark, folder)
    sales = {
        "orders": t.delivered_orders(), "order_items": t.order_items(),
        "order_reviews": t.order_reviews(), "customers": t.customers(),
        "products": t.products(), "sellers": t.sellers(),
        "product_category_name_translation": t.translation(),
    }
    for name, df in sales.items():
        writers.append_batch(df, f"{layout.silver}/olist/{name}", "olist_1")
    for name in ("selic_target", "usd_brl", "ibc_br"):
        writers.append_batch(t.one_series(name), f"{layout.silver}/bcb/{name}", "bcb_1")
    writers.append_batch(t.statistics(), f"{layout.silver}/ibge/ipca", "ibge_1")
    return build.build_gold(spark, layout).select("dataset", "rows", "grain")


def _report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two KPI reports; the later name is served."""
    layout = _layout(spark, "reports")
    orders = ShippedTables(spark, folder).orders()
    first = orders.agg(F.count(F.lit(1)).alias("orders_total"))
    second = orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders_total"))
    for stamp, df in ((datetime(2024, 1, 1, tzinfo=UTC), first),
                      (datetime(2024, 1, 2, tzinfo=UTC), second)):
        writers.write_report(df, layout.gold, "_analytics_reports/kpis_", stamp)
    return reports.latest_report(spark, layout, "kpis").select("order_status", "orders_total")


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of two stored datasets and one report."""
    layout = _layout(spark, "catalog")
    t = ShippedTables(spark, folder)
    writers.overwrite_dataset(t.customers(), layout.gold, "customer_metrics")
    writers.overwrite_dataset(t.sellers(), f"{layout.models}/outputs", "customer_segments")
    counted = t.orders().agg(F.count(F.lit(1)).alias("orders_total"))
    writers.write_report(counted, layout.gold, "_analytics_reports/kpis_")
    found = serving.catalog(spark, layout)
    return found.select("kind", "name", "rows", F.concat_ws(",", "columns").alias("columns"))


def _health(spark: SparkSession, folder: str) -> DataFrame:
    """Health of a lake holding one Gold dataset and one report."""
    layout = _layout(spark, "health")
    orders = ShippedTables(spark, folder).orders()
    writers.overwrite_dataset(orders, layout.gold, "sales_daily")
    counted = orders.agg(F.count(F.lit(1)).alias("orders_total"))
    writers.write_report(counted, layout.gold, "_analytics_reports/kpis_")
    checks = monitoring.health_checks(spark, layout)
    return checks.select("name", "status", "severity", F.col("details")["rows"].alias("rows"))


QUERIES = {
    "s1_csv_ingest": _csv_ingest,
    "k1_bronze_items": _bronze_items,
    "s5_series_ingest": _series_ingest,
    "s4_statistics_ingest": _statistics_ingest,
    "k3_silver_build": _silver_build,
    "k12_run_log": _run_log,
    "s7_latest_batch": _latest_wins,
    "s8_latest_by_leaf": _latest_below,
    "k4_k5_overwrite": _overwritten,
    "q8_bronze_checks": _bronze_checks,
    "t7_gold_build": _full_build,
    "s12_latest_report": _report_round_trip,
    "q23_catalog": _catalog,
    "q20_q21_health": _health,
}

_GRAIN = {name: grain.replace("'", "''") for name, grain in fixed.GOLD_GRAINS.items()}
_GOLD_SQL = {
    "sales_daily": "g_sales_daily", "sales_monthly": "g_sales_monthly",
    "category_performance": "g_category", "customer_metrics": "g_customers",
    "seller_metrics": "g_sellers", "delivery_metrics": "g_delivery",
    "review_metrics": "g_reviews", "economic_indicators": "g_indicators",
    "sales_economic_features": "g_sales_monthly", "customer_rfm": "g_rfm_base",
    "ml_features": "g_sales_daily", "anomaly_metrics": "g_sales_daily",
    "dim_date": "g_dim_date",
}
_MISSING_CHECKS = [
    *[(f"gold_{n}", "critical") for n in fixed.GOLD_GRAINS if n != "sales_daily"],
    *[(f"model_output_{n}", "critical") for n in fixed.MODEL_OUTPUTS],
    *[(f"report_{k}", "warning") for k in fixed.REPORT_KINDS if k != "kpis"],
]

ORACLES = {
    "s1_csv_ingest": """
        with t as (select 'order_items' as name, count(*) as rows_read,
                          cast(11 as bigint) as columns_read from lineitem
                   union all select 'orders', count(*), cast(10 as bigint) from orders
                   union all select 'products', count(*), cast(13 as bigint) from part
                   union all select 'order_reviews', count(*), cast(9 as bigint) from documents
                   union all select 'customers', count(*), cast(9 as bigint) from customer
                   union all select 'order_payments', count(*), cast(9 as bigint) from orders
                   union all select 'sellers', count(*), cast(7 as bigint) from supplier
                   union all select 'geolocation', count(*), cast(7 as bigint) from nation
                   union all select 'product_category_name_translation',
                                    count(distinct p_type) - 1, cast(6 as bigint) from part)
        select *, cast(9 as bigint) as files_written,
               cast((select sum(rows_read) from t) as bigint) as records_read,
               cast(0 as int) as missing_files from t""",
    "k1_bronze_items": oracle("""
        select 'olist_first' as batch_id, 'olist' as source,
               cast(order_id as varchar) as order_id, cast(order_item_id as bigint)
                   as order_item_id,
               case when order_item_id = 7 then null when order_item_id = 6 then -price
                    else price end as price,
               order_item_id in (6, 7) as has_invalid_price from lg_items"""),
    "s5_series_ingest": """
        select case l_returnflag when 'A' then 'selic_target' when 'N' then 'usd_brl'
                    when 'R' then 'ibc_br' end as indicator_name,
               cast(case l_returnflag when 'A' then 432 when 'N' then 1 when 'R' then 24363 end
                    as bigint) as series_code,
               cast(l_shipdate as date) as day, count(*) as rows,
               round(sum(l_discount), 6) as value_sum
        from lineitem where l_returnflag <> 'A' or year(l_shipdate) = 1996 group by 1, 2, 3""",
    "k3_silver_build": """
        with t as (
          select 'order_items' as dataset, count(*) as n, count(*) as read from lineitem
          union all select 'orders', count(*), count(*) from orders
          union all select 'order_reviews', count(*), count(*) from documents
          union all select 'ipca', count(*) + 1, count(*) from lineitem
          union all select 'order_payments', count(*), count(*) from orders
          union all select 'products', count(*), count(*) from part
          union all select 'customers', count(*), count(*) from customer
          union all select 'sellers', count(*), count(*) from supplier
          union all select 'geolocation', count(*), count(*) from nation
          union all select 'product_category_name_translation', count(distinct p_type) - 1,
                           count(distinct p_type) - 1 from part
          union all select case l_returnflag when 'A' then 'selic_target' when 'N' then 'usd_brl'
                                when 'R' then 'ibc_br' end, count(*), count(*)
                    from lineitem group by l_returnflag)
        select dataset, n as rows_input, read as rows_output, read as rows_read from t""",
    "k12_run_log": """
        select 'run_1' as run_id, 'series' as pipeline_name, count(*) as records_read,
               count(*) as records_written, cast(0 as bigint) as records_rejected,
               'success' as status, cast(null as varchar) as error_message, true as has_duration
        from lineitem
        union all select 'run_2', 'series', 0, 0, 0, 'failed', 'stopped', false""",
    "s4_statistics_ingest": """
        select case when l_linenumber <> 7 then cast(date_trunc('month', l_shipdate) as date) end
                   as reference_month,
               count(*) as rows, count(*) filter (where l_linenumber <> 6) as values_present
        from lineitem group by 1""",
    "s7_latest_batch": """
        select 'olist_2' as batch_id, o_orderstatus as order_status, count(*) as orders
        from orders where o_orderstatus = 'F' group by 2""",
    "s8_latest_by_leaf": """
        select 'olist_orders' as view_name, count(*) as rows from orders
        union all select 'olist_customers', count(*) from customer""",
    "k4_k5_overwrite": oracle("""
        select customer_state, count(*) as customers,
               cast((select count(*) from lg_customers) as bigint) as written
        from lg_customers group by 1"""),
    "q8_bronze_checks": """
        select 'customers' as dataset, true as passed, count(*) as rows,
               cast(8 as bigint) as columns, '' as missing_columns from customer
        union all
        select 'sellers', false, count(*), cast(4 as bigint), 'ingestion_timestamp,source'
        from supplier""",
    "t7_gold_build": oracle(" union all ".join(
        f"select '{n}' as dataset, count(*) as rows, '{_GRAIN[n]}' as grain from {t}"
        for n, t in _GOLD_SQL.items()
    )),
    "s12_latest_report": """
        select o_orderstatus as order_status, count(*) as orders_total from orders group by 1""",
    "q23_catalog": """
        select 'gold' as kind, 'customer_metrics' as name, count(*) as rows,
               'customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,'
               || 'customer_state' as columns from customer
        union all
        select 'model_output', 'customer_segments', count(*),
               'seller_id,seller_city,seller_state' from supplier
        union all select 'latest_report', 'kpis', null, ''""",
    "q20_q21_health": """
        select 'gold_sales_daily' as name, 'passed' as status, 'info' as severity,
               count(*) as rows from orders
        union all select 'report_kpis', 'passed', 'info', null
        """ + "".join(
        f" union all select '{n}', 'failed', '{s}', null" for n, s in _MISSING_CHECKS
    ),
}
