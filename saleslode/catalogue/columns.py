"""Scalar functions, projections, filters and reshaping on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import functions as fn
from saleslode.catalogue.gold import _category, _daily, _features, _indicators, _monthly
from saleslode.catalogue.sqltext import oracle
from saleslode.operators import keys, reshape, series
from saleslode.plans.warehouse import TABLES
from saleslode.settings import GOLD_GRAINS
from saleslode.sources import lake
from saleslode.sources.shipped import ShippedTables

LINE = ("l_orderkey", "l_linenumber")


def _lines(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return ShippedTables(spark, folder).raw("lineitem").select(
        *LINE, *[c.alias(n) for n, c in columns.items()]
    )


def _messy_number() -> Column:
    """Quantity as text, in a different spelling per line number."""
    digits = F.col("l_quantity").cast("bigint").cast("string")
    line = F.col("l_linenumber")
    return (
        F.when(line == 1, digits)
        .when(line == 2, F.concat(F.lit(" "), digits, F.lit(".5 ")))
        .when(line == 3, F.concat(digits, F.lit("e2")))
        .when(line == 4, F.concat(digits, F.lit("d")))
        .when(line == 5, F.concat(digits, F.lit(",5")))
        .when(line == 6, F.lit("abc"))
        .otherwise(F.concat(F.lit("-"), digits))
    )


MESSY_NUMBER_SQL = """
    select *, case l_linenumber when 1 then q when 2 then ' ' || q || '.5 '
                  when 3 then q || 'e2' when 4 then q || 'd' when 5 then q || ',5'
                  when 6 then 'abc' else '-' || q end as t
    from (select *, cast(cast(l_quantity as bigint) as varchar) as q from lineitem) x"""


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, number=fn.to_number(_messy_number()),
                  whole=fn.to_integer(_messy_number()))


def _timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Ship date as text in three layouts, of which only the ISO ones are read."""
    shipped = F.col("l_shipdate")
    text = (
        F.when(F.col("l_linenumber") % 3 == 0, F.date_format(shipped, "dd/MM/yyyy"))
        .when(F.col("l_linenumber") % 3 == 1, F.date_format(shipped, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(shipped, "yyyy-MM-dd"))
    )
    return _lines(spark, folder, day=fn.to_timestamp_lenient(text).cast("date"))


def _fixed_dates(spark: SparkSession, folder: str) -> DataFrame:
    shipped = F.col("l_shipdate")
    return _lines(
        spark, folder,
        slashed=fn.fixed_date(F.date_format(shipped, "dd/MM/yyyy"), "dd/MM/yyyy"),
        month_start=fn.fixed_date(
            F.concat(F.date_format(shipped, "yyyyMM"), F.lit("01")), "yyyyMMdd"
        ),
        unreadable=fn.fixed_date(F.date_format(shipped, "yyyy-MM-dd"), "dd/MM/yyyy"),
    )


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \n"))
    return ShippedTables(spark, folder).raw("part").select(
        "p_partkey", fn.normalised_text(padded).alias("name")
    )


def _decimal_comma(spark: SparkSession, folder: str) -> DataFrame:
    text = F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))
    return _lines(spark, folder, discount=fn.decimal_comma_number(text))


def _day_parts(spark: SparkSession, folder: str) -> DataFrame:
    orders = ShippedTables(spark, folder).raw("orders")
    day = fn.to_day(F.col("o_orderdate"))
    return orders.select("o_orderkey", *fn.calendar_columns(day))


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    """Days crossed between an event and the same instant two minutes later, and more."""
    events = ShippedTables(spark, folder).raw("events")
    ts = F.col("ts")
    return events.select(
        "event_id",
        fn.day_distance(ts, ts + F.expr("interval 2 minutes")).alias("crossed"),
        fn.day_distance(ts, F.lit("2024-02-01").cast("timestamp_ntz")).alias("to_february"),
    )


def _maths(spark: SparkSession, folder: str) -> DataFrame:
    customers = ShippedTables(spark, folder).raw("customer")
    balance = F.col("c_acctbal")
    return customers.select(
        "c_custkey",
        F.abs(balance).alias("size"),
        F.round(F.sqrt(F.abs(balance)), 4).alias("root"),
        F.round(F.log1p(F.abs(balance)), 6).alias("log_size"),
    )


def _null_handling(spark: SparkSession, folder: str) -> DataFrame:
    """Ratio over a zero-able tax, defaulting a missing result to -1."""
    ratio = F.try_divide(F.col("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)))
    return _lines(spark, folder, ratio=ratio, filled=F.coalesce(ratio, F.lit(-1.0)))


def _has_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents beside a copy blanked out for every language but English."""
    documents = ShippedTables(spark, folder).raw("documents")
    blank = F.when(F.col("lang") == "en", F.col("text")).when(
        F.col("lang") == "fr", F.lit(" \t\n")
    )
    return documents.select("doc_id", fn.has_text(F.col("text")).alias("has_text"),
                            fn.has_text(blank).alias("has_english_text"))


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    reviews = ShippedTables(spark, folder).order_reviews()
    score = F.col("review_score")
    return reviews.select(
        "review_id",
        fn.after(score, F.lit(2)).alias("above_two"),
        fn.before(score, F.lit(3)).alias("below_three"),
        fn.missing_or_negative(score).alias("missing_or_negative"),
        fn.not_accepted(score, ["1", "5"]).alias("not_accepted"),
    )


def _finite(spark: SparkSession, folder: str) -> DataFrame:
    odd = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 2, F.lit(float("inf")))
        .when(F.col("l_linenumber") == 3, F.lit(float("-inf")))
        .when(F.col("l_linenumber") >= 5, F.col("l_tax"))
    )
    return _lines(spark, folder, finite=fn.is_finite(odd))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names shaped like monitoring checks, built from the event types."""
    events = ShippedTables(spark, folder).raw("events")
    name = F.concat(
        F.when(F.col("event_type") == "click", "gold_")
        .when(F.col("event_type") == "view", "model_output_")
        .when(F.col("event_type") == "error", "report_").otherwise(""),
        "event_type", F.lit("_total"),
    )
    return events.groupBy(
        fn.area_of_check(name).alias("area"), fn.title_words(name).alias("label"),
        fn.forward_slashes(F.concat(F.lit("data\\"), name)).alias("path"),
    ).agg(F.count(F.lit(1)).alias("events"))


LABELS_SQL = """
    select case event_type when 'click' then 'Gold' when 'view' then 'ML outputs'
                when 'error' then 'Relatórios' else 'Sistema' end as area,
           case event_type when 'click' then 'Gold Click Total'
                when 'view' then 'Model Output View Total'
                when 'error' then 'Report Error Total' when 'signup' then 'Signup Total'
                when 'purchase' then 'Purchase Total' end as label,
           'data/' || case event_type when 'click' then 'gold_' when 'view' then 'model_output_'
                when 'error' then 'report_' else '' end || event_type || '_total' as path,
           count(*) as events
    from events group by event_type"""


def _detail_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Number and missing path of a JSON detail record, with a default."""
    events = ShippedTables(spark, folder).raw("events")
    details = F.from_json("props", "k bigint, path string, pattern string")
    return events.withColumn("details", details).select(
        "event_id", F.col("details")["k"].alias("rows"),
        F.coalesce(F.col("details")["path"], F.col("details")["pattern"], F.lit("")).alias("path"),
    )


def _segment_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities through a label table that knows only two of them."""
    orders = ShippedTables(spark, folder).raw("orders")
    labels = {"1-URGENT": "Urgente", "5-LOW": "Baixa"}
    label = fn.label_or_self(F.col("o_orderpriority"), labels)
    return orders.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("orders"))


def _complete(spark: SparkSession, folder: str) -> DataFrame:
    return series.drop_incomplete(
        ShippedTables(spark, folder).order_reviews(), ["review_score", "review_creation_date"]
    ).select("review_id", "review_score")


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    reviews = ShippedTables(spark, folder).order_reviews()
    return reviews.fillna({"review_score": 0}).select(
        "review_id", "review_score",
        fn.truthy(F.col("review_score") > 3).alias("is_positive"),
    )


def _present_columns(spark: SparkSession, folder: str) -> DataFrame:
    customers = ShippedTables(spark, folder).customers()
    kept = reshape.keep_present(
        customers, ["customer_id", "not_a_column", "customer_state", "customer_city"]
    )
    return reshape.rename_present(kept, {"customer_city": "city", "absent": "ignored"})


def _distinct_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _category(spark, folder).select("category").dropDuplicates(["category"])


def _missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Warehouse columns each Gold dataset does not offer under that name."""
    found = {"fact_sales_daily": _daily(spark, folder),
             "fact_economic_indicators": _indicators(spark, folder)}
    daily = found["fact_sales_daily"]
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table_name"), "rows",
            F.lit(",".join(keys.missing_names(TABLES[table].columns, df.columns))).alias(
                "missing_columns"
            ),
        )
        for table, df in found.items()
    ]
    expected = daily.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("gold").alias("table_name"), "rows",
        F.lit(",".join(keys.missing_names(GOLD_GRAINS, ["sales_daily", "dim_date"]))).alias(
            "missing_columns"
        ),
    )
    return parts[0].unionByName(parts[1]).unionByName(expected)


def _melted(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.melt(
        _monthly(spark, folder).select("month", "revenue", "freight_value"),
        ["month"], ["revenue", "freight_value"], "metric", "value",
    )


def _split(spark: SparkSession, folder: str) -> DataFrame:
    daily = _daily(spark, folder).select("date", "gmv")
    return series.temporal_split(daily, "date", 0.8)


def _orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Item rows of orders that no labelled document shares its number with."""
    t = ShippedTables(spark, folder)
    return keys.orphans(t.order_items(), "order_id", t.raw("labels"), "doc_id")


def _feature_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Strictly complete months, under display names."""
    rows = series.drop_incomplete(
        _features(spark, folder), ["selic_target", "usd_brl", "ibc_br", "ipca"]
    )
    return rows.select("month", "gmv", "orders").withColumnsRenamed(
        {"gmv": "GMV", "orders": "Pedidos"}
    )


QUERIES = {
    "s2_parquet_columns": lambda s, d: lake.read_columns(
        s, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment"]
    ),
    "f1_numbers": _numbers,
    "f2_timestamps": _timestamps,
    "f3_fixed_dates": _fixed_dates,
    "f4_normalised_text": _normalised,
    "f5_decimal_comma": _decimal_comma,
    "f6_months": lambda s, d: _lines(
        s, d, month=fn.month_of(F.col("l_shipdate")), day=fn.to_day(F.col("l_shipdate"))
    ),
    "f7_day_distance": _distances,
    "f8_calendar_parts": _day_parts,
    "f9_f12_maths": _maths,
    "f10_null_handling": _null_handling,
    "f13_has_text": _has_text,
    "f14_f15_f17_flags": _flags,
    "f16_finite": _finite,
    "f18_detail_fields": _detail_fields,
    "f19_names_and_paths": _labels,
    "p2_p3_present_columns": _present_columns,
    "p9_complete_rows": _complete,
    "p10_filled_rows": _filled,
    "p14_labels": _segment_labels,
    "p18_display_names": _feature_subset,
    "u4_melt": _melted,
    "u5_distinct_categories": _distinct_categories,
    "u6_missing_names": _missing_columns,
    "w11_temporal_split": _split,
    "j9_orphan_keys": _orphan_keys,
}

_AT = "l_orderkey, l_linenumber"
_GOLD_REST = ",".join(sorted(set(GOLD_GRAINS) - {"sales_daily", "dim_date"}))

ORACLES = {
    "s2_parquet_columns": "select c_custkey, c_mktsegment from customer",
    "f1_numbers": f"""
        select {_AT}, try_cast(trim(t) as double) as number,
               case when try_cast(trim(t) as double) = floor(try_cast(trim(t) as double))
                    then try_cast(try_cast(trim(t) as double) as bigint) end as whole
        from ({MESSY_NUMBER_SQL}) m""",
    "f2_timestamps": f"""
        select {_AT}, case when l_linenumber % 3 <> 0 then cast(l_shipdate as date) end as day
        from lineitem""",
    "f3_fixed_dates": f"""
        select {_AT}, cast(l_shipdate as date) as slashed,
               cast(date_trunc('month', l_shipdate) as date) as month_start,
               cast(null as date) as unreadable from lineitem""",
    "f4_normalised_text": "select p_partkey, lower(p_name) as name from part",
    "f5_decimal_comma": f"select {_AT}, l_discount as discount from lineitem",
    "f6_months": f"""
        select {_AT}, cast(date_trunc('month', l_shipdate) as date) as month,
               cast(l_shipdate as date) as day from lineitem""",
    "f7_day_distance": """
        select event_id, cast(date_diff('day', ts, ts + interval 2 minute) as int) as crossed,
               cast(date_diff('day', ts, timestamp '2024-02-01') as int) as to_february
        from events""",
    "f8_calendar_parts": """
        select o_orderkey, cast(strftime(d, '%Y%m%d') as int) as date_key, d as date,
               cast(day(d) as int) as day, cast(isodow(d) - 1 as int) as day_of_week,
               dayname(d) as day_name, cast(week(d) as int) as week,
               cast(month(d) as int) as month, monthname(d) as month_name,
               cast(quarter(d) as int) as quarter, cast(year(d) as int) as year,
               isodow(d) >= 6 as is_weekend
        from (select o_orderkey, cast(o_orderdate as date) as d from orders) x""",
    "f9_f12_maths": """
        select c_custkey, abs(c_acctbal) as size, round(sqrt(abs(c_acctbal)), 4) as root,
               round(ln(1 + abs(c_acctbal)), 6) as log_size from customer""",
    "f10_null_handling": f"""
        select {_AT}, l_discount / nullif(l_tax, 0) as ratio,
               coalesce(l_discount / nullif(l_tax, 0), -1.0) as filled from lineitem""",
    "f13_has_text": """
        select doc_id, regexp_matches(coalesce(text, ''), '\\S') as has_text,
               lang = 'en' and regexp_matches(coalesce(text, ''), '\\S') as has_english_text
        from documents""",
    "f14_f15_f17_flags": oracle("""
        select review_id, coalesce(review_score > 2, false) as above_two,
               coalesce(review_score < 3, false) as below_three,
               review_score is null or review_score < 0 as missing_or_negative,
               not coalesce(review_score in (1, 5), false) as not_accepted from lg_reviews"""),
    "f16_finite": f"select {_AT}, l_linenumber >= 5 as finite from lineitem",
    "f18_detail_fields": """
        select event_id, cast(json_extract(props, '$.k') as bigint) as rows, '' as path
        from events""",
    "f19_names_and_paths": LABELS_SQL,
    "p2_p3_present_columns": oracle(
        "select customer_id, customer_state, customer_city as city from lg_customers"
    ),
    "p9_complete_rows": oracle(
        "select review_id, review_score from lg_reviews"
        " where review_score is not null and review_creation_date is not null"
    ),
    "p10_filled_rows": oracle(
        "select review_id, coalesce(review_score, 0) as review_score,"
        " coalesce(review_score > 3, false) as is_positive from lg_reviews"
    ),
    "p14_labels": """
        select case o_orderpriority when '1-URGENT' then 'Urgente' when '5-LOW' then 'Baixa'
                    else o_orderpriority end as label, count(*) as orders
        from orders group by 1""",
    "p18_display_names": oracle(
        'select month, gmv as "GMV", orders as "Pedidos" from g_features'
        " where selic_target is not null and usd_brl is not null and ibc_br is not null"
        " and ipca is not null"
    ),
    "u4_melt": oracle(
        "select month, 'revenue' as metric, revenue as value from g_monthly_totals union all"
        " select month, 'freight_value', freight_value from g_monthly_totals"
    ),
    "u5_distinct_categories": oracle("select distinct category from g_category"),
    "u6_missing_names": oracle(f"""
        select 'fact_sales_daily' as table_name, count(*) as rows,
               'date_key' as missing_columns from g_sales_daily
        union all select 'fact_economic_indicators', count(*), '' from g_indicators
        union all select 'gold', count(*), '{_GOLD_REST}' from g_sales_daily"""),
    "w11_temporal_split": oracle("""
        select date, gmv, cast(row_number() over (order by date) - 1 as int) as row_index,
               row_number() over (order by date) - 1 < floor(count(*) over () * 0.8) as is_train
        from g_sales_daily"""),
    "j9_orphan_keys": oracle("""
        select order_id as key, count(*) as row_count from lg_items
        where order_id not in (select doc_id from labels) group by 1"""),
}
