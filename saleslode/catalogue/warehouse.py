"""Star schema tables, constraints and models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode.catalogue.gold import (
    _category,
    _customers,
    _daily,
    _dim_date,
    _indicators,
    _monthly,
    _sellers,
    shared_gold,
)
from saleslode.catalogue.sqltext import oracle
from saleslode.operators.rules import union_results
from saleslode.plans import marts, suites, warehouse
from saleslode.plans.gold import dim_date_of_sales
from saleslode.session import scratch_path
from saleslode.sinks import star


def _lazy_gold(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Inputs for a single table: nothing is stored, unused inputs cost nothing."""
    daily = _daily(spark, folder)
    return {
        "dim_date": dim_date_of_sales(daily),
        "customer_metrics": _customers(spark, folder),
        "seller_metrics": _sellers(spark, folder),
        "category_performance": _category(spark, folder),
        "economic_indicators": _indicators(spark, folder),
        "sales_daily": daily,
        "sales_monthly": _monthly(spark, folder),
    }


def _tables(spark: SparkSession, folder: str, stored: bool = True) -> dict[str, DataFrame]:
    """Star schema tables; a load of several of them stores what it reads repeatedly."""
    inputs = shared_gold if stored else _lazy_gold
    return warehouse.build_tables(inputs(spark, folder))


def _money(df: DataFrame) -> DataFrame:
    """Decimals as doubles for comparison; growth rounded."""
    casts = {n: F.col(n).cast("double") for n, kind in df.dtypes if kind.startswith("decimal")}
    if "gmv_mom_growth" in df.columns:
        casts["gmv_mom_growth"] = F.round("gmv_mom_growth", 8)
    return df.withColumns(casts)


def _table_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in _tables(spark, folder).items()
    ]
    return union_results(parts)


def _loaded(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame], str]:
    """A finished load under a name of its own: schema, its tables' plans, its folder."""
    tables = _tables(spark, folder)
    location = scratch_path(spark, "star")
    schema = f"star_{uuid.uuid4().hex[:12]}"
    star.load_star(spark, tables, schema, warehouse.check_constraints, location)
    return schema, tables, location


def _second_load_fails(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per table after a good load and one whose customers repeat a key."""
    schema, tables, location = _loaded(spark, folder)
    twice = tables["dim_customer"].unionByName(tables["dim_customer"])
    try:
        star.load_star(spark, {**tables, "dim_customer": twice}, schema,
                       warehouse.check_constraints, location)
    except warehouse.ConstraintViolation:
        pass
    return union_results([
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in star.read_star(spark, schema).items()
    ])


def _in_second_session(model: str) -> Callable[[SparkSession, str], DataFrame]:
    """A model published over a stored load, as another session reads it."""
    def read(spark: SparkSession, folder: str) -> DataFrame:
        schema, _, location = _loaded(spark, folder)
        marts.publish(spark, schema, f"{schema}_marts", f"{location}/marts")
        return _money(spark.newSession().table(f"{schema}_marts.{model}"))

    return read


def _constraints(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.constraint_results(_tables(spark, folder)).drop("message", "severity")


def _foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ("dim_date", "dim_category", "fact_sales_daily", "fact_category_performance")
    tables = {n: df for n, df in _tables(spark, folder).items() if n in wanted}
    results = warehouse.constraint_results(tables)
    return results.where(F.col("rule_name").contains("_references_")).select(
        "table_name", "rule_name", "passed", "failed_count", "total_count"
    )


def _fact(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sources = {
        "fact_sales_daily": lambda s, d: warehouse.fact_sales_daily(_daily(s, d)),
        "fact_sales_monthly": lambda s, d: warehouse.conform(name, _monthly(s, d)),
        "fact_category_performance": lambda s, d: warehouse.conform(name, _category(s, d)),
        "fact_economic_indicators": lambda s, d: warehouse.conform(name, _indicators(s, d)),
        "dim_date": lambda s, d: warehouse.conform(name, _dim_date(s, d)),
    }
    return lambda s, d: _money(sources[name](s, d))


def _models(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return marts.build_models(_tables(spark, folder, stored=False))


def _model(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _money(_models(s, d)[name])


def _staged_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Models read by name through views, as they are published."""
    models = _models(spark, folder)
    models["stg_sales_monthly"].createOrReplaceTempView("stg_sales_monthly")
    models["stg_economic_indicators"].createOrReplaceTempView("stg_economic_indicators")
    return spark.sql(
        """
        select count(*) as months, count(e.reference_month) as months_with_indicators
        from stg_sales_monthly s
        left join stg_economic_indicators e on s.month = e.reference_month
        """
    )


QUERIES = {
    "k6_table_counts": _table_counts,
    "k6_reload_keeps_first": _second_load_fails,
    "s13_second_session_mart": _in_second_session("mart_economic_analysis"),
    "p17_second_session_calendar": _in_second_session("int_sales_calendar"),
    "k7_fact_sales_daily": _fact("fact_sales_daily"),
    "k6_fact_sales_monthly": _fact("fact_sales_monthly"),
    "k6_fact_category": _fact("fact_category_performance"),
    "k6_fact_indicators": _fact("fact_economic_indicators"),
    "k8_dim_customer": lambda s, d: warehouse.conform("dim_customer", _customers(s, d)),
    "k8_dim_seller": lambda s, d: warehouse.conform("dim_seller", _sellers(s, d)),
    "k9_dim_category": lambda s, d: warehouse.dim_category(_category(s, d)),
    "j12_foreign_keys": _foreign_keys,
    "q19_constraints": _constraints,
    "s13_model_sources": _staged_sources,
    "p16_stg_dim_date": _model("stg_dim_date"),
    "p16_stg_sales_daily": _model("stg_sales_daily"),
    "p16_stg_sales_monthly": _model("stg_sales_monthly"),
    "p16_stg_category_performance": _model("stg_category_performance"),
    "p16_stg_economic_indicators": _model("stg_economic_indicators"),
    "j10_sales_calendar": _model("int_sales_calendar"),
    "j11_sales_economic_monthly": _model("int_sales_economic_monthly"),
    "p17_mart_sales": _model("mart_sales"),
    "p17_mart_category": _model("mart_category"),
    "p17_mart_economic_analysis": _model("mart_economic_analysis"),
    "q18_model_tests": lambda s, d: suites.model_test_results(_models(s, d)),
}


def _cents(*names: str) -> str:
    """Half-up rounding of the printed number, which is what a decimal column stores."""
    return ", ".join(
        f"cast(cast(cast(cast({n} as varchar) as decimal(38, 14)) as decimal(18, 2))"
        f" as double) as {n}"
        for n in names
    )


_DAILY = ("select cast(strftime(date, '%Y%m%d') as int) as date_key, orders, customers,"
          " items_sold, "
          + _cents("revenue", "freight_value", "gmv", "average_ticket", "average_freight")
          + " from g_sales_daily")
_MONTHLY = ("select month, orders, customers, items_sold, "
            + _cents("revenue", "freight_value", "gmv", "average_ticket")
            + ", round(gmv_mom_growth, 8) as gmv_mom_growth from g_sales_monthly")
_CATEGORY = ("select category, orders, items_sold, "
             + _cents("revenue", "freight_value", "gmv", "average_ticket") + " from g_category")
_ECONOMIC = ("select m.*, e.selic_target, e.usd_brl, e.ibc_br, e.ipca from m"
             " left join g_indicators e on e.reference_month = m.month")
_TABLE_SQL = {
    "dim_date": "g_dim_date", "dim_customer": "g_customers", "dim_seller": "g_sellers",
    "dim_category": "g_category", "fact_sales_daily": "g_sales_daily",
    "fact_sales_monthly": "g_sales_monthly", "fact_category_performance": "g_category",
    "fact_economic_indicators": "g_indicators",
}


def _constraint_rows() -> str:
    """Every constraint holds on these tables, so only names and sizes need stating."""
    rows = []
    for name, spec in warehouse.TABLES.items():
        size = (f"(select count(*) from {_TABLE_SQL[name]})" if name in _TABLE_SQL
                else "cast(4 as bigint)")
        rules = [f"{c}_not_null" for c in spec.required]
        rules += ["_".join(k) + "_unique" for k in spec.unique]
        rules += [f"{c}_references_{p}" for c, p in spec.foreign]
        rows += [
            f"select '{name}' as table_name, '{r}' as rule_name, true as passed,"
            f" cast(0 as bigint) as failed_count, {size} as total_count" for r in rules
        ]
    return " union all ".join(rows)


ORACLES = {
    "k6_table_counts": oracle(
        " union all ".join(f"select '{n}' as table_name, count(*) as rows from {t}"
                           for n, t in _TABLE_SQL.items())
        + " union all select 'dim_economic_indicator', cast(4 as bigint)"
    ),
    "k7_fact_sales_daily": oracle(_DAILY),
    "k6_fact_sales_monthly": oracle(_MONTHLY),
    "k6_fact_category": oracle(_CATEGORY),
    "k6_fact_indicators": oracle("select * from g_indicators"),
    "k8_dim_customer": oracle(
        "select cast(customer_id as varchar) as customer_id, customer_unique_id, customer_state,"
        " customer_city from g_customers"
    ),
    "k8_dim_seller": oracle(
        "select cast(seller_id as varchar) as seller_id, seller_state, seller_city from g_sellers"
    ),
    "k9_dim_category": oracle(
        "select row_number() over (order by gmv desc, category) as category_key, category"
        " from g_category"
    ),
    "j12_foreign_keys": oracle("""
        select 'fact_sales_daily' as table_name, 'date_key_references_dim_date' as rule_name,
               true as passed, cast(0 as bigint) as failed_count, count(*) as total_count
        from g_sales_daily
        union all
        select 'fact_category_performance', 'category_references_dim_category', true,
               cast(0 as bigint), count(*) from g_category"""),
    "q19_constraints": oracle(_constraint_rows()),
    "s13_model_sources": oracle(
        "select count(*) as months, count(e.reference_month) as months_with_indicators"
        " from g_sales_monthly s left join g_indicators e on s.month = e.reference_month"
    ),
    "p16_stg_dim_date": oracle("select * from g_dim_date"),
    "p16_stg_sales_daily": oracle(_DAILY),
    "p16_stg_sales_monthly": oracle(_MONTHLY),
    "p16_stg_category_performance": oracle(_CATEGORY),
    "p16_stg_economic_indicators": oracle("select * from g_indicators"),
    "j10_sales_calendar": oracle(
        "select d.date, d.year, d.month, d.month_name, d.quarter, d.is_weekend, s.orders,"
        " s.customers, s.items_sold, s.revenue, s.freight_value, s.gmv, s.average_ticket,"
        " s.average_freight from s join g_dim_date d on d.date_key = s.date_key", s=_DAILY
    ),
    "j11_sales_economic_monthly": oracle(_ECONOMIC, m=_MONTHLY),
    "p17_mart_sales": oracle(_MONTHLY),
    "p17_mart_category": oracle(_CATEGORY),
    "p17_mart_economic_analysis": oracle(_ECONOMIC, m=_MONTHLY),
    "q18_model_tests": " union all ".join(
        f"select '{model}' as model, '{column}' as column_name, '{test}' as test,"
        " true as passed, cast(0 as bigint) as failed_count"
        for model, columns in suites.MODEL_TESTS.items()
        for column, tests in columns
        for test in tests
    ),
}

ORACLES["k6_reload_keeps_first"] = ORACLES["k6_table_counts"]
ORACLES["s13_second_session_mart"] = ORACLES["p17_mart_economic_analysis"]
ORACLES["p17_second_session_calendar"] = ORACLES["j10_sales_calendar"]
