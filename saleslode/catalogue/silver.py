"""Silver transforms over text copies of the tables, with defects in known places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode.catalogue.sqltext import oracle
from saleslode.operators import keys, profile
from saleslode.plans import silver
from saleslode.sources import landing
from saleslode.sources.shipped import ShippedTables


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items as text: unreadable prices on line 7, a stray suffix and wrong date layouts."""
    line = F.col("order_item_id")
    return ShippedTables(spark, folder).order_items().select(
        _text("order_id").alias("order_id"),
        _text("order_item_id").alias("order_item_id"),
        _text("product_id").alias("product_id"),
        _text("seller_id").alias("seller_id"),
        F.when(line == 7, "n/a").when(line == 6, F.concat(F.lit("-"), _text("price")))
        .otherwise(_text("price")).alias("price"),
        F.when(line == 5, "1d").otherwise(_text(F.round("freight_value", 4)))
        .alias("freight_value"),
        F.when(line == 4, F.date_format("shipping_limit_date", "dd/MM/yyyy"))
        .otherwise(F.date_format("shipping_limit_date", "yyyy-MM-dd HH:mm:ss"))
        .alias("shipping_limit_date"),
    )


SILVER_ITEMS_SQL = """
    select cast(order_id as varchar) as order_id, cast(order_item_id as bigint) as order_item_id,
           case when order_item_id = 7 then null when order_item_id = 6 then -price
                else price end as price,
           case when order_item_id <> 5 then round(freight_value, 4) end as freight_value,
           case when order_item_id <> 4 then cast(shipping_limit_date as date) end as limit_day,
           count(*) over (partition by order_id, order_item_id) > 1 as is_duplicate_key
    from lg_items"""


def _items(spark: SparkSession, folder: str) -> DataFrame:
    typed = silver.transform_sales(raw_items(spark, folder), "order_items")
    return typed.select(
        "order_id", "order_item_id", "price", "freight_value",
        typed["shipping_limit_date"].cast("date").alias("limit_day"),
        "has_invalid_price", "has_invalid_freight_value", "has_invalid_shipping_limit_date",
        "is_duplicate_key",
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text; pending ones carry no readable purchase date."""
    orders = ShippedTables(spark, folder).delivered_orders()
    stamp = "yyyy-MM-dd HH:mm:ss"
    return orders.select(
        _text("order_id").alias("order_id"), _text("customer_id").alias("customer_id"),
        "order_status",
        F.when(F.col("order_status") == "P", "not yet")
        .otherwise(F.date_format("order_purchase_timestamp", stamp))
        .alias("order_purchase_timestamp"),
        F.date_format("order_delivered_customer_date", stamp).alias(
            "order_delivered_customer_date"
        ),
        F.date_format("order_estimated_delivery_date", stamp).alias(
            "order_estimated_delivery_date"
        ),
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    typed = silver.transform_sales(raw_orders(spark, folder), "orders")
    return typed.select(
        "order_id",
        typed["order_purchase_timestamp"].cast("date").alias("purchase_day"),
        "has_invalid_order_purchase_timestamp", "has_delivery_before_purchase",
        "has_estimate_before_purchase", "is_duplicate_key",
    )


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    reviews = ShippedTables(spark, folder).order_reviews()
    return reviews.select(
        _text("review_id").alias("review_id"), _text("order_id").alias("order_id"),
        F.coalesce(_text("review_score"), F.lit("none")).alias("review_score"),
        "review_comment_message",
        F.date_format("review_creation_date", "yyyy-MM-dd").alias("review_creation_date"),
    )


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    typed = silver.transform_sales(raw_reviews(spark, folder), "order_reviews")
    return typed.select(
        "review_id", "review_score",
        typed["review_creation_date"].cast("date").alias("created"),
        "has_invalid_review_creation_date", "is_duplicate_key",
    )


def _products(spark: SparkSession, folder: str) -> DataFrame:
    raw = ShippedTables(spark, folder).products().withColumns(
        {
            "product_category_name": F.concat(F.lit("\t"), "product_category_name", F.lit(" ")),
            "product_photos_qty": F.when(F.col("product_photos_qty") > 40, "many").otherwise(
                _text("product_photos_qty")
            ),
        }
    )
    return silver.transform_sales(raw, "products").select(
        "product_id", "product_category_name", "product_photos_qty",
        "has_invalid_product_photos_qty", "has_invalid_product_weight_g", "is_duplicate_key",
    )


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    raw = ShippedTables(spark, folder).customers().withColumn(
        "customer_city", F.concat(F.lit("  "), "customer_city", F.lit("\t"))
    )
    return silver.transform_sales(raw, "customers").select(
        "customer_id", "customer_city", "customer_state", "is_duplicate_key"
    )


def raw_series(spark: SparkSession, folder: str) -> DataFrame:
    """Ship dates and discounts in the landed layout: dd/MM/yyyy and decimal comma."""
    return ShippedTables(spark, folder).raw("lineitem").select(
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("data"),
        F.replace(_text("l_discount"), F.lit("."), F.lit(",")).alias("valor"),
    )


def _series_scan(spark: SparkSession, folder: str) -> DataFrame:
    typed = landing.typed_series(raw_series(spark, folder), 432, "01/01/1997", "31/12/1999")
    return typed.groupBy("date", "series_code").agg(
        F.count(F.lit(1)).alias("observations"), F.max("value").alias("highest")
    )


def _series(spark: SparkSession, folder: str) -> DataFrame:
    rows = ShippedTables(spark, folder).series()
    raw = rows.select(
        "indicator_name", _text("date").alias("date"),
        F.when(F.col("value") == 0, "-").otherwise(_text("value")).alias("value"),
        _text("series_code").alias("series_code"),
    )
    typed = silver.transform_series(raw)
    return typed.groupBy(
        "indicator_name", "series_code", typed["date"].cast("date").alias("day"),
        "has_invalid_value", "has_invalid_date", "is_duplicate_key",
    ).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 6).alias("value_sum"))


def raw_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics rows as text, headed by the record that names the fields."""
    rows = ShippedTables(spark, folder).raw("lineitem").select(
        F.lit("1").alias("D1C"), F.lit("Brasil").alias("D1N"),
        F.col("l_returnflag").alias("D2C"), F.lit("IPCA").alias("D2N"),
        F.when(F.col("l_linenumber") == 7, "none").otherwise(
            F.date_format("l_shipdate", "yyyyMM")
        ).alias("D3C"),
        F.date_format("l_shipdate", "MMMM yyyy").alias("D3N"),
        F.lit("%").alias("MN"),
        F.when(F.col("l_linenumber") == 6, "...").otherwise(_text("l_tax")).alias("V"),
        F.lit("ipca").alias("indicator_name"),
    )
    header = spark.createDataFrame(
        [("Código", "Brasil", "Código", "Variável", "Código", "Mês", "Unidade", "Valor", "ipca")],
        ", ".join(f"{name} string" for name in rows.columns),
    )
    return header.unionByName(rows)


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    return silver.transform_statistics(raw_statistics(spark, folder)).groupBy(
        "variable_code", "unit", "reference_month", "has_invalid_value",
        "has_invalid_reference_month", "is_duplicate_key",
    ).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 6).alias("value_sum"))


def _header_dropped(spark: SparkSession, folder: str) -> DataFrame:
    kept = silver.drop_header_row(raw_statistics(spark, folder))
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.count("V").alias("values_present"))


def _duplicates(spark: SparkSession, folder: str) -> DataFrame:
    items = ShippedTables(spark, folder).order_items()
    flagged = keys.flag_duplicate_keys(items, ["order_id", "order_item_id"])
    return flagged.select("order_id", "order_item_id", "is_duplicate_key")


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_columns(ShippedTables(spark, folder).order_reviews())


def _profile_sizes(spark: SparkSession, folder: str) -> DataFrame:
    items = ShippedTables(spark, folder).order_items()
    return profile.profile_summary(items).withColumn("columns", F.col("columns").cast("bigint"))


def _row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows before and after Silver per dataset; only the header record may go."""
    raws = {
        "order_items": (raw_items(spark, folder), "olist"),
        "orders": (raw_orders(spark, folder), "olist"),
        "order_reviews": (raw_reviews(spark, folder), "olist"),
        "ipca": (raw_statistics(spark, folder), "ibge"),
    }
    t = ShippedTables(spark, folder)
    raws |= {n: (t.one_series(n), "bcb") for n in ("selic_target", "usd_brl", "ibc_br")}
    raws |= {
        "order_payments": (t.order_payments(), "olist"), "products": (t.products(), "olist"),
        "customers": (t.customers(), "olist"), "sellers": (t.sellers(), "olist"),
        "product_category_name_translation": (t.translation(), "olist"),
    }
    counts = None
    for dataset, (raw, source) in raws.items():
        typed, _ = silver.transform(source, dataset, raw)
        row = raw.agg(F.count(F.lit(1)).alias("rows_input")).select(
            F.lit(dataset).alias("dataset"), "rows_input",
            typed.agg(F.count(F.lit(1))).scalar().alias("rows_output"),
        )
        counts = row if counts is None else counts.unionByName(row)
    return counts


QUERIES = {
    "s3_series_scan": _series_scan,
    "p4_header_row": _header_dropped,
    "t1_order_items": _items,
    "t2_orders": _orders,
    "t3_order_reviews": _reviews,
    "t1_products": _products,
    "t1_customers": _customers,
    "t4_series": _series,
    "t5_statistics": _statistics,
    "t6_row_counts": _row_counts,
    "w9_duplicate_keys": _duplicates,
    "q9_profile_columns": _profile,
    "q9_profile_summary": _profile_sizes,
}

_REVIEW_COLUMNS = {"review_id": "bigint", "order_id": "bigint", "review_score": "bigint",
                   "review_comment_message": "string", "review_creation_date": "timestamp_ntz"}

ORACLES = {
    "s3_series_scan": """
        select cast(l_shipdate as date) as date, cast(432 as bigint) as series_code,
               count(*) as observations, max(l_discount) as highest
        from lineitem where l_shipdate between '1997-01-01' and '1999-12-31' group by 1""",
    "p4_header_row": "select count(*) as rows, count(*) as values_present from lineitem",
    "t1_order_items": oracle("""
        select *, price is null or price < 0 as has_invalid_price,
               freight_value is null or freight_value < 0 as has_invalid_freight_value,
               limit_day is null as has_invalid_shipping_limit_date from s_items""",
                             s_items=SILVER_ITEMS_SQL),
    "t2_orders": oracle("""
        select cast(order_id as varchar) as order_id, purchase_day,
               purchase_day is null as has_invalid_order_purchase_timestamp,
               coalesce(order_delivered_customer_date < purchase_day, false)
                   as has_delivery_before_purchase,
               coalesce(order_estimated_delivery_date < purchase_day, false)
                   as has_estimate_before_purchase,
               count(*) over (partition by order_id) > 1 as is_duplicate_key
        from (select *, case when order_status <> 'P'
                             then cast(order_purchase_timestamp as date) end as purchase_day
              from lg_delivered) x"""),
    "t3_order_reviews": oracle("""
        select cast(review_id as varchar) as review_id, review_score,
               cast(review_creation_date as date) as created,
               review_creation_date is null as has_invalid_review_creation_date,
               count(*) over (partition by review_id) > 1 as is_duplicate_key
        from lg_reviews"""),
    "t1_products": oracle("""
        select product_id, lower(product_category_name) as product_category_name,
               cast(case when product_photos_qty <= 40 then product_photos_qty end as double)
                   as product_photos_qty,
               product_photos_qty > 40 as has_invalid_product_photos_qty,
               product_weight_g is null or product_weight_g < 0 as has_invalid_product_weight_g,
               count(*) over (partition by product_id) > 1 as is_duplicate_key
        from lg_products"""),
    "t1_customers": oracle("""
        select customer_id, lower(customer_city) as customer_city,
               lower(customer_state) as customer_state,
               count(*) over (partition by customer_id) > 1 as is_duplicate_key
        from lg_customers"""),
    "t4_series": oracle("""
        select indicator_name, series_code, date as day, value = 0 as has_invalid_value,
               false as has_invalid_date, is_duplicate_key, count(*) as rows,
               round(sum(case when value <> 0 then value end), 6) as value_sum
        from (select *, count(*) over (partition by indicator_name, series_code, date) > 1
                            as is_duplicate_key from lg_series) x
        group by 1, 2, 3, 4, 5, 6"""),
    "t5_statistics": """
        select variable_code, '%' as unit, reference_month, value is null as has_invalid_value,
               reference_month is null as has_invalid_reference_month, is_duplicate_key,
               count(*) as rows, round(sum(value), 6) as value_sum
        from (select l_returnflag as variable_code,
                     case when l_linenumber <> 6 then l_tax end as value,
                     case when l_linenumber <> 7
                          then cast(date_trunc('month', l_shipdate) as date) end
                         as reference_month,
                     count(*) over (partition by l_returnflag,
                         case when l_linenumber <> 7 then date_trunc('month', l_shipdate) end) > 1
                         as is_duplicate_key
              from lineitem) x
        group by 1, 2, 3, 4, 5, 6""",
    "t6_row_counts": oracle("""
        select 'order_items' as dataset, count(*) as rows_input, count(*) as rows_output
        from lineitem
        union all select 'orders', count(*), count(*) from orders
        union all select 'order_reviews', count(*), count(*) from documents
        union all select 'ipca', count(*) + 1, count(*) from lineitem
        union all select 'order_payments', count(*), count(*) from orders
        union all select 'products', count(*), count(*) from part
        union all select 'customers', count(*), count(*) from customer
        union all select 'sellers', count(*), count(*) from supplier
        union all select 'product_category_name_translation', count(*), count(*)
        from lg_translation
        union all select indicator_name, count(*), count(*) from lg_series
        group by indicator_name"""),
    "w9_duplicate_keys": oracle("""
        select order_id, order_item_id,
               count(*) over (partition by order_id, order_item_id) > 1 as is_duplicate_key
        from lg_items"""),
    "q9_profile_columns": oracle(
        " union all ".join(
            f"select '{c}' as \"column\", '{kind}' as dtype, count(*) - count({c}) as null_count,"
            f" (count(*) - count({c})) / cast(count(*) as double) as null_ratio,"
            f" count(distinct {c}) as unique_count from lg_reviews"
            for c, kind in _REVIEW_COLUMNS.items()
        )
    ),
    "q9_profile_summary": oracle("""
        select cast(sum(n) as bigint) as rows, cast(7 as bigint) as columns,
               cast(sum(n - 1) as bigint) as duplicate_rows
        from (select *, count(*) as n from lg_items group by all) x"""),
}
