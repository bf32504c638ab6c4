"""Staging, intermediate and mart models over the warehouse tables."""

from __future__ import annotations

from collections.abc import Mapping
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from saleslode.plans.warehouse import TABLES

STAGING = {
    "stg_dim_date": "dim_date",
    "stg_sales_daily": "fact_sales_daily",
    "stg_sales_monthly": "fact_sales_monthly",
    "stg_category_performance": "fact_category_performance",
    "stg_economic_indicators": "fact_economic_indicators",
}
CALENDAR_COLUMNS = ("date", "year", "month", "month_name", "quarter", "is_weekend")
DAILY_MEASURES = ("orders", "customers", "items_sold", "revenue", "freight_value", "gmv",
                  "average_ticket", "average_freight")
MONTHLY_COLUMNS = tuple(TABLES["fact_sales_monthly"].columns)
INDICATOR_COLUMNS = ("selic_target", "usd_brl", "ibc_br", "ipca")
MARTS = ("mart_sales", "mart_category", "mart_economic_analysis")


def source_tables(spark: SparkSession, schema: str = "analytics") -> dict[str, DataFrame]:
    """The loaded warehouse tables."""
    return {name: spark.table(f"{schema}.{name}") for name in TABLES}


def staging(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """One-to-one projections of the warehouse tables."""
    return {
        model: tables[table].select(*TABLES[table].columns) for model, table in STAGING.items()
    }


def sales_calendar(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily sales with calendar attributes.

    Both sides have one row per day; the planner broadcasts the smaller when it fits.
    """
    return daily.join(calendar, "date_key").select(*CALENDAR_COLUMNS, *DAILY_MEASURES)


def sales_economic_monthly(monthly: DataFrame, indicators: DataFrame) -> DataFrame:
    """Monthly sales with the month's indicators where known."""
    return monthly.join(
        indicators, monthly["month"] == indicators["reference_month"], "left"
    ).select(*MONTHLY_COLUMNS, *INDICATOR_COLUMNS)


def build_models(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All ten models by name."""
    staged = staging(tables)
    economic = sales_economic_monthly(
        staged["stg_sales_monthly"], staged["stg_economic_indicators"]
    )
    return {
        **staged,
        "int_sales_calendar": sales_calendar(staged["stg_sales_daily"], staged["stg_dim_date"]),
        "int_sales_economic_monthly": economic,
        "mart_sales": staged["stg_sales_monthly"].select(*MONTHLY_COLUMNS),
        "mart_category": staged["stg_category_performance"].select(
            *TABLES["fact_category_performance"].columns
        ),
        "mart_economic_analysis": economic.select(*MONTHLY_COLUMNS, *INDICATOR_COLUMNS),
    }


def publish_models(models: Mapping[str, DataFrame], schema: str = "analytics_marts") -> list[str]:
    """Staging and intermediate models as views, marts as tables."""
    published = []
    next(iter(models.values())).sparkSession.sql(f"create schema if not exists {schema}")
    for name, df in models.items():
        if name in MARTS:
            df.write.mode("overwrite").saveAsTable(f"{schema}.{name}")
        else:
            df.createOrReplaceTempView(name)
        published.append(name)
    return published


def definitions(source: str = "analytics", schema: str = "analytics_marts"
                ) -> dict[str, tuple[tuple[str, ...], str]]:
    """Each model's own models it reads, and its SQL over stored tables and views."""
    def listed(columns, owner: str = "") -> str:
        return ", ".join(f"{owner}{c}" for c in columns)

    found = {model: ((), f"select {listed(TABLES[table].columns)} from {source}.{table}")
             for model, table in STAGING.items()}
    found["int_sales_calendar"] = (
        ("stg_sales_daily", "stg_dim_date"),
        f"select {listed(CALENDAR_COLUMNS, 'c.')}, {listed(DAILY_MEASURES, 's.')}"
        f" from {schema}.stg_sales_daily s join {schema}.stg_dim_date c"
        " on s.date_key = c.date_key")
    found["int_sales_economic_monthly"] = (
        ("stg_sales_monthly", "stg_economic_indicators"),
        f"select {listed(MONTHLY_COLUMNS, 'm.')}, {listed(INDICATOR_COLUMNS, 'i.')}"
        f" from {schema}.stg_sales_monthly m left join {schema}.stg_economic_indicators i"
        " on m.month = i.reference_month")
    for mart, model, columns in (
            ("mart_sales", "stg_sales_monthly", MONTHLY_COLUMNS),
            ("mart_category", "stg_category_performance",
             TABLES["fact_category_performance"].columns),
            ("mart_economic_analysis", "int_sales_economic_monthly",
             (*MONTHLY_COLUMNS, *INDICATOR_COLUMNS))):
        found[mart] = ((model,), f"select {listed(columns)} from {schema}.{model}")
    return found


def publish(spark: SparkSession, source: str = "analytics", schema: str = "analytics_marts",
            location: str | None = None) -> list[str]:
    """Publish all models so that every session sees them; returns their names in order.

    Staging and intermediate models are catalogue views over the stored tables, marts are
    tables. A model comes after those it reads.
    """
    place = f" location '{location}'" if location else ""
    spark.sql(f"create schema if not exists {schema}{place}")
    models = definitions(source, schema)
    order = list(TopologicalSorter({m: set(d) for m, (d, _) in models.items()}).static_order())
    for name in order:
        if name in MARTS:
            spark.sql(models[name][1]).write.mode("overwrite").saveAsTable(f"{schema}.{name}")
        else:
            spark.sql(f"create or replace view {schema}.{name} as {models[name][1]}")
    return order
