"""Serving reads, health roll-ups and display selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode.catalogue.gold import _category, _daily, _monthly, _sales
from saleslode.catalogue.sqltext import oracle
from saleslode.operators import reshape
from saleslode.plans import gold, ml, monitoring, rfm, serving
from saleslode.session import cut_lineage
from saleslode.sources.shipped import ShippedTables


def compared_days(spark: SparkSession, folder: str) -> DataFrame:
    """Anomaly days beside a simple second method: a day above twice the mean gmv."""
    days = gold.anomaly_metrics(_daily(spark, folder))
    mean = days.agg(F.try_divide(F.round(F.sum("gmv"), 4), F.count("gmv"))).scalar()
    return days.withColumn("isolation_forest_anomaly", F.col("gmv") > mean * 2).withColumn(
        "any_zscore_anomaly", serving.any_flag(days)
    ).withColumn(
        "anomaly_method_overlap",
        F.col("any_zscore_anomaly") & F.col("isolation_forest_anomaly"),
    )


def rfm_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their RFM segment in the place of the cluster name."""
    return rfm.customer_rfm(_sales(spark, folder)).withColumnRenamed("segment", "ml_segment")


def _segment_categories(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    categorised = gold.categorised_products(t.products(), t.translation())
    return serving.segment_categories(
        rfm_segments(spark, folder), t.orders(), t.order_items(), categorised
    )


def _health_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One health row per supplier, shaped as the monitoring step writes them."""
    supplier = ShippedTables(spark, folder).raw("supplier")
    kind = F.pmod(F.col("s_suppkey"), F.lit(3))
    name = F.concat(
        F.when(kind == 0, "gold_").when(kind == 1, "model_output_").otherwise("report_"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))),
    )
    failed = F.col("s_acctbal") < 0
    return supplier.select(
        name.alias("name"),
        F.when(failed, "failed").otherwise("passed").alias("status"),
        F.when(~failed, "info").when(kind == 2, "warning").otherwise("critical")
        .alias("severity"),
        F.when(failed, "Required dataset is empty.")
        .otherwise("Dataset is readable and non-empty.").alias("message"),
        F.struct(
            F.when(~failed, F.concat(F.lit("lake\\"), "s_name")).alias("path"),
            F.when(failed, F.lit("lake\\*")).alias("pattern"),
            F.when(~failed, F.col("s_suppkey")).alias("rows"),
            F.when(~failed, F.col("s_nationkey").cast("double")).alias("age_hours"),
        ).alias("details"),
    )


def _described(spark: SparkSession, folder: str) -> DataFrame:
    return monitoring.described_checks(_health_rows(spark, folder))


def _error_rows(spark: SparkSession, folder: str) -> DataFrame:
    return serving.error_rows(_naive_errors(spark, folder))


def _naive_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of two naive forecasts: yesterday's sales, and the weekly mean before today."""
    features = cut_lineage(gold.ml_features(_daily(spark, folder)))
    before = F.col("sales_lag_1")
    long = features.where(before.isNotNull()).select(
        "gmv",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("position"), F.lit("last_day").alias("model_name"),
                         before.alias("predicted")),
                F.struct(F.lit(1).alias("position"), F.lit("weekly_mean").alias("model_name"),
                         F.col("rolling_mean_7").alias("predicted")),
            )
        ).alias("m"),
    ).select("gmv", "m.*")
    return ml.error_metrics(long, "gmv", "predicted", ("position", "model_name"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    def one(name: str) -> Column:
        return F.round(name, digits)

    return df.withColumns({name: one(name) for name in names})


QUERIES = {
    "o1_daily_in_order": lambda s, d: gold.in_output_order(
        "sales_daily", _daily(s, d)
    ).select("date", "gmv"),
    "o2_latest_days": lambda s, d: serving.latest_sales(_daily(s, d), "date", 30),
    "o2_latest_months": lambda s, d: serving.latest_sales(_monthly(s, d), "month", 24),
    "o3_top_categories": lambda s, d: serving.top_categories(_category(s, d), 3),
    "p18_category_table": lambda s, d: serving.category_table(_category(s, d)),
    "p11_anomaly_days": lambda s, d: serving.anomaly_days(compared_days(s, d), 500),
    "o6_latest_overlap_days": lambda s, d: serving.anomaly_days(compared_days(s, d), 20, True),
    "p12_any_zscore": lambda s, d: compared_days(s, d).select("date", "any_zscore_anomaly"),
    "a18_anomaly_counts": lambda s, d: ml.anomaly_counts(compared_days(s, d)),
    "a16_segment_summary": lambda s, d: _rounded(
        serving.segment_summary(rfm_segments(s, d)), 8,
        "average_recency_days", "average_frequency", "average_monetary",
    ),
    "a17_segment_counts": lambda s, d: ml.segment_counts(rfm_segments(s, d)),
    "o7_labelled_segments": lambda s, d: serving.labelled_segments(
        serving.segment_summary(rfm_segments(s, d))
    ).select("ml_segment", "segmento", "customers"),
    "j13_segment_categories": _segment_categories,
    "p13_one_segment": lambda s, d: serving.one_segment(
        _segment_categories(s, d), "Em risco"
    ),
    "a19_area_rollup": lambda s, d: _rounded(
        monitoring.area_rollup(_described(s, d)), 8, "avg_age_hours"
    ),
    "p13_failed_checks": lambda s, d: monitoring.attention(_described(s, d)),
    "o10_check_audit": lambda s, d: monitoring.audit(_described(s, d)),
    "q22_overall_status": lambda s, d: monitoring.overall_status(_health_rows(s, d)),
    "f20_age_facts": lambda s, d: monitoring.dataset_age(ShippedTables(s, d).raw("orders"), _now())
    .agg(F.count("*").alias("rows"), F.bool_and(F.col("age_hours") >= 0).alias("past")),
    "f20_file_age": lambda s, d: monitoring.dataset_age(
        ShippedTables(s, d).raw("orders"), _now()
    ),
    "u4_error_rows": lambda s, d: _rounded(_error_rows(s, d), 3, "value"),
    "m2_error_metrics": lambda s, d: _rounded(
        _rounded(_naive_errors(s, d), 3, "mae", "rmse"), 8, "mape"
    ),
    "o9_best_model": lambda s, d: serving.best_model(_naive_errors(s, d)),
    "o11_hashed_sample": lambda s, d: reshape.hashed_sample(
        ShippedTables(s, d).customers(), "customer_id", 1000
    ).agg(F.count(F.lit(1)).alias("sampled"), F.countDistinct("customer_id").alias("distinct")),
}


def _now():
    from datetime import UTC, datetime

    return datetime.now(UTC)


_COMPARED = """
    select *, any_zscore_anomaly and isolation_forest_anomaly as anomaly_method_overlap
    from (select *, gmv > 2 * (select round(sum(gmv), 4) / count(gmv) from g_sales_daily)
                        as isolation_forest_anomaly,
                 gmv_zscore_anomaly or orders_zscore_anomaly or average_ticket_zscore_anomaly
                     or freight_value_zscore_anomaly as any_zscore_anomaly
          from g_anomalies) a"""
_POINT = "orders, customers, items_sold, revenue, freight_value, gmv, average_ticket"
_DAY = ("date, gmv, orders, average_ticket, freight_value, isolation_forest_anomaly,"
        " any_zscore_anomaly, anomaly_method_overlap")
_SEGMENTS = "select *, segment as ml_segment from g_rfm"
_LABEL = ("case ml_segment when 'standard' then 'Padrao' when 'recent' then 'Recentes'"
          " when 'at_risk' then 'Em risco' when 'vip' then 'VIP' else ml_segment end")
_SEGMENT_SALES = """
    select s.ml_segment, coalesce(t.product_category_name_english, p.product_category_name,
               'unknown') as category,
           round(sum(i.price + i.freight_value), 4) as gmv,
           count(distinct i.order_id) as orders, count(*) as items
    from s join lg_orders o on o.customer_id = s.customer_id
    join lg_items i on i.order_id = o.order_id
    left join lg_products p on p.product_id = i.product_id
    left join lg_translation t on t.product_category_name = p.product_category_name
    group by 1, 2"""
_HEALTH = """
    select case s_suppkey % 3 when 0 then 'gold_' when 1 then 'model_output_' else 'report_' end
               || lower(replace(s_name, '#', '_')) as name,
           case s_suppkey % 3 when 0 then 'Gold' when 1 then 'ML outputs' else 'Relatórios' end
               as area,
           case s_suppkey % 3 when 0 then 'Gold ' when 1 then 'Model Output ' else 'Report ' end
               || 'Supplier ' || split_part(s_name, '#', 2) as "check",
           case when s_acctbal < 0 then 'failed' else 'passed' end as status,
           case when s_acctbal < 0 then 'Falha' else 'Aprovado' end as status_label,
           case when s_acctbal >= 0 then 'info' when s_suppkey % 3 = 2 then 'warning'
                else 'critical' end as severity,
           case when s_acctbal < 0 then 'lake/*' else 'lake/' || s_name end as path,
           case when s_acctbal >= 0 then s_suppkey end as rows,
           case when s_acctbal >= 0 then cast(s_nationkey as double) end as age_hours
    from supplier"""
_NAIVE = """
    select model_name, position, avg(abs(gmv - predicted)) as mae,
           sqrt(avg((gmv - predicted) * (gmv - predicted))) as rmse,
           avg(case when gmv <> 0 then abs((gmv - predicted) / gmv) end) as mape
    from (select gmv, sales_lag_1 as predicted, 'last_day' as model_name, 0 as position
          from g_ml_features where sales_lag_1 is not null
          union all
          select gmv, rolling_mean_7, 'weekly_mean', 1
          from g_ml_features where sales_lag_1 is not null) x
    group by 1, 2"""

ORACLES = {
    "o1_daily_in_order": oracle("select date, gmv from g_sales_daily order by date"),
    "o2_latest_days": oracle(
        f"select date as period, {_POINT} from g_sales_daily order by date desc limit 30"
    ),
    "o2_latest_months": oracle(
        f"select month as period, {_POINT} from g_sales_monthly order by month desc limit 24"
    ),
    "o3_top_categories": oracle("select * from g_category order by gmv desc, category limit 3"),
    "p18_category_table": oracle(
        'select upper(category[1:1]) || lower(category[2:]) as "Categoria", gmv as "GMV",'
        ' orders as "Pedidos", items_sold as "Itens", average_ticket as "Ticket médio"'
        " from g_category order by gmv desc limit 15"
    ),
    "p11_anomaly_days": oracle(
        f"select {_DAY} from c where any_zscore_anomaly or isolation_forest_anomaly"
        " order by date desc limit 500", c=_COMPARED
    ),
    "o6_latest_overlap_days": oracle(
        f"select {_DAY} from c where anomaly_method_overlap order by date desc limit 20",
        c=_COMPARED
    ),
    "p12_any_zscore": oracle("select date, any_zscore_anomaly from c", c=_COMPARED),
    "a18_anomaly_counts": oracle("""
        select count(*) as rows, count(*) filter (where any_zscore_anomaly) as zscore_anomaly_days,
               count(*) filter (where isolation_forest_anomaly) as isolation_forest_anomaly_days,
               count(*) filter (where anomaly_method_overlap) as overlap_days
        from c""", c=_COMPARED),
    "a16_segment_summary": oracle("""
        select ml_segment, count(customer_id) as customers,
               round(avg(recency_days), 8) as average_recency_days,
               round(avg(frequency), 8) as average_frequency,
               round(round(sum(monetary), 4) / count(monetary), 8) as average_monetary
        from s group by 1""", s=_SEGMENTS),
    "a17_segment_counts": oracle("select ml_segment, count(*) as customers from s group by 1",
                                 s=_SEGMENTS),
    "o7_labelled_segments": oracle(
        f"select ml_segment, {_LABEL} as segmento, count(customer_id) as customers"
        " from s group by 1", s=_SEGMENTS
    ),
    "j13_segment_categories": oracle("select * from sc", s=_SEGMENTS, sc=_SEGMENT_SALES),
    "p13_one_segment": oracle(
        f"select * from (select *, {_LABEL} as segmento from sc) x where segmento = 'Em risco'",
        s=_SEGMENTS, sc=_SEGMENT_SALES
    ),
    "a19_area_rollup": oracle("""
        select area, count(name) as checks, count(*) filter (where status = 'failed') as failures,
               round(avg(age_hours), 8) as avg_age_hours from h group by 1""", h=_HEALTH),
    "p13_failed_checks": oracle(
        'select area as "Área", "check" as "Check", status_label as "Status",'
        ' severity as "Severidade", \'Required dataset is empty.\' as "Mensagem",'
        " path as \"Caminho\" from h where status = 'failed'", h=_HEALTH
    ),
    "o10_check_audit": oracle(
        'select area as "Área", "check" as "Check", status_label as "Status",'
        ' severity as "Severidade", rows as "Linhas", age_hours as "Idade",'
        ' path as "Caminho" from h', h=_HEALTH
    ),
    "q22_overall_status": oracle("""
        select case when count(*) filter (where severity = 'critical') > 0 then 'failed'
                    when count(*) filter (where severity = 'warning') > 0 then 'warning'
                    else 'passed' end as status,
               count(*) as checks_total,
               count(*) filter (where status = 'failed' and severity = 'critical')
                   as checks_failed,
               count(*) filter (where status = 'failed' and severity = 'warning')
                   as checks_warned from h""", h=_HEALTH),
    "u4_error_rows": oracle("""
        select model_name, 'MAE' as metric, round(mae, 3) as value from n
        union all select model_name, 'RMSE', round(rmse, 3) from n""", n=_NAIVE),
    "m2_error_metrics": oracle(
        "select model_name, position, round(mae, 3) as mae, round(rmse, 3) as rmse,"
        " round(mape, 8) as mape from n", n=_NAIVE
    ),
    "o9_best_model": oracle(
        "select model_name as best_model from n order by mae, position limit 1", n=_NAIVE
    ),
    "f20_age_facts": "select cast(1 as bigint) as rows, count(*) > 0 as past from orders",
    "o11_hashed_sample": "select least(count(*), 1000) as sampled,"
                         " least(count(*), 1000) as \"distinct\" from customer",
}
