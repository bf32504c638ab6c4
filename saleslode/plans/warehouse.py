"""Star schema: five dimensions and four facts, with their constraints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.functions import date_key
from saleslode.operators.numbering import dense_numbers
from saleslode.operators.rules import RelationRule, evaluate_tables, not_null, unique_key

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class TableSpec:
    """Columns with their types, key columns, mandatory columns and foreign keys."""

    columns: Mapping[str, str]
    unique: tuple[tuple[str, ...], ...]
    required: tuple[str, ...]
    foreign: tuple[tuple[str, str], ...] = ()


# --- fixed values: the warehouse tables ------------------------------------------
TABLES: dict[str, TableSpec] = {
    "dim_date": TableSpec(
        {
            "date_key": "int", "date": "date", "day": "int", "day_of_week": "int",
            "day_name": "string", "week": "int", "month": "int", "month_name": "string",
            "quarter": "int", "year": "int", "is_weekend": "boolean",
        },
        (("date_key",), ("date",)),
        ("date_key", "date", "day", "day_of_week", "day_name", "week", "month", "month_name",
         "quarter", "year", "is_weekend"),
    ),
    "dim_customer": TableSpec(
        {
            "customer_id": "string", "customer_unique_id": "string", "customer_state": "string",
            "customer_city": "string",
        },
        (("customer_id",),), ("customer_id", "customer_unique_id"),
    ),
    "dim_seller": TableSpec(
        {"seller_id": "string", "seller_state": "string", "seller_city": "string"},
        (("seller_id",),), ("seller_id",),
    ),
    "dim_category": TableSpec(
        {"category_key": "bigint", "category": "string"},
        (("category_key",), ("category",)), ("category_key", "category"),
    ),
    "dim_economic_indicator": TableSpec(
        {"indicator_name": "string", "source": "string"},
        (("indicator_name",),), ("indicator_name",),
    ),
    "fact_sales_daily": TableSpec(
        {
            "date_key": "int", "orders": "bigint", "customers": "bigint", "items_sold": "bigint",
            "revenue": MONEY, "freight_value": MONEY, "gmv": MONEY, "average_ticket": MONEY,
            "average_freight": MONEY,
        },
        (("date_key",),), ("date_key", "orders", "customers", "items_sold"),
        (("date_key", "dim_date"),),
    ),
    "fact_sales_monthly": TableSpec(
        {
            "month": "date", "orders": "bigint", "customers": "bigint", "items_sold": "bigint",
            "revenue": MONEY, "freight_value": MONEY, "gmv": MONEY, "average_ticket": MONEY,
            "gmv_mom_growth": "double",
        },
        (("month",),), ("month", "orders", "customers", "items_sold"),
    ),
    "fact_category_performance": TableSpec(
        {
            "category": "string", "orders": "bigint", "items_sold": "bigint", "revenue": MONEY,
            "freight_value": MONEY, "gmv": MONEY, "average_ticket": MONEY,
        },
        (("category",),), ("category", "orders", "items_sold"),
        (("category", "dim_category"),),
    ),
    "fact_economic_indicators": TableSpec(
        {
            "reference_month": "date", "selic_target": "double", "usd_brl": "double",
            "ibc_br": "double", "ipca": "double",
        },
        (("reference_month",),), ("reference_month",),
    ),
}

# Gold dataset behind each table.
TABLE_SOURCES = {
    "dim_date": "dim_date",
    "dim_customer": "customer_metrics",
    "dim_seller": "seller_metrics",
    "dim_category": "category_performance",
    "fact_sales_daily": "sales_daily",
    "fact_sales_monthly": "sales_monthly",
    "fact_category_performance": "category_performance",
    "fact_economic_indicators": "economic_indicators",
}
WAREHOUSE_INPUTS = tuple(dict.fromkeys(TABLE_SOURCES.values()))


def conform(table: str, df: DataFrame) -> DataFrame:
    """The table's columns in order, cast to its types; money is rounded half up."""
    return df.select(
        *[
            (F.round(F.col(name), 2) if kind == MONEY else F.col(name)).cast(kind).alias(name)
            for name, kind in TABLES[table].columns.items()
        ]
    )


def fact_sales_daily(daily: DataFrame) -> DataFrame:
    """Daily sales keyed by the integer date key instead of the date."""
    return conform(
        "fact_sales_daily", daily.withColumn("date_key", date_key(F.col("date"))).drop("date")
    )


def dim_category(categories: DataFrame) -> DataFrame:
    """Distinct categories numbered from 1 by falling gmv, then by name."""
    distinct = categories.groupBy("category").agg(F.max("gmv").alias("gmv"))
    order = (F.col("gmv").desc_nulls_last(), F.col("category").asc())
    return conform("dim_category", dense_numbers(distinct, order, "category_key"))


def dim_economic_indicator(spark: SparkSession) -> DataFrame:
    """The constant indicator dimension."""
    rows = list(fixed.INDICATOR_SOURCES.items())
    return spark.createDataFrame(rows, "indicator_name string, source string")


def build_tables(gold: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All nine tables from the Gold datasets, dimensions first."""
    spark = gold["sales_daily"].sparkSession
    return {
        "dim_date": conform("dim_date", gold["dim_date"]),
        "dim_customer": conform("dim_customer", gold["customer_metrics"]),
        "dim_seller": conform("dim_seller", gold["seller_metrics"]),
        "dim_category": dim_category(gold["category_performance"]),
        "dim_economic_indicator": dim_economic_indicator(spark),
        "fact_sales_daily": fact_sales_daily(gold["sales_daily"]),
        "fact_sales_monthly": conform("fact_sales_monthly", gold["sales_monthly"]),
        "fact_category_performance": conform(
            "fact_category_performance", gold["category_performance"]
        ),
        "fact_economic_indicators": conform(
            "fact_economic_indicators", gold["economic_indicators"]
        ),
    }


def constraint_results(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Key, mandatory-column and foreign-key checks, one result row each."""
    checked = {}
    for name in tables:
        spec = TABLES[name]
        checked[name] = [
            *[not_null(column) for column in spec.required],
            *[unique_key(*key) for key in spec.unique],
            *[RelationRule(f"{column}_references_{parent}", column, tables[parent], column)
              for column, parent in spec.foreign if parent in tables],
        ]
    return evaluate_tables(tables, checked, "table_name")


class ConstraintViolation(ValueError):
    """A warehouse table breaks a key, mandatory column or foreign key."""


def check_constraints(tables: Mapping[str, DataFrame]) -> None:
    """Raise before anything is written when a constraint does not hold."""
    broken = constraint_results(tables).where(~F.col("passed")).collect()
    if broken:
        named = ", ".join(f"{r['table_name']}.{r['rule_name']}" for r in broken)
        raise ConstraintViolation(f"Load aborted, constraints violated: {named}")
