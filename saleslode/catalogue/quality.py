"""Quality rules, layer suites, outlier reports and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.gold import whole_gold
from saleslode.catalogue.silver import raw_statistics
from saleslode.catalogue.sqltext import oracle
from saleslode.operators import outliers, rules
from saleslode.plans import build, silver, suites
from saleslode.sources.shipped import ShippedTables


def silver_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Silver form of every sales table and the four indicators.

    The suites count repeated keys themselves, so the join behind ``is_duplicate_key``
    is left out here.
    """
    t = ShippedTables(spark, folder)
    sales = {
        "orders": t.delivered_orders(), "order_items": t.order_items(),
        "order_payments": t.order_payments(), "order_reviews": t.order_reviews(),
        "customers": t.customers(), "products": t.products(), "sellers": t.sellers(),
    }
    frames = {name: silver.flag_rows(df, name) for name, df in sales.items()}
    for name in ("selic_target", "usd_brl", "ibc_br"):
        frames[name] = silver.flag_series(t.one_series(name))
    frames["ipca"] = silver.transform_statistics(raw_statistics(spark, folder))
    return frames


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return ShippedTables(spark, folder).order_items()


def _evaluate(df: DataFrame, *checked: rules.Rule) -> DataFrame:
    return rules.evaluate(df, list(checked))


def _not_null(spark: SparkSession, folder: str) -> DataFrame:
    reviews = ShippedTables(spark, folder).order_reviews()
    return _evaluate(reviews, rules.not_null("review_score"), rules.not_null("review_id"),
                     rules.not_null("absent", rules.WARNING))


def _non_negative(spark: SparkSession, folder: str) -> DataFrame:
    customers = ShippedTables(spark, folder).raw("customer")
    return _evaluate(customers, rules.non_negative("c_acctbal"),
                     rules.non_negative("c_mktsegment"))


def _between(spark: SparkSession, folder: str) -> DataFrame:
    items = ShippedTables(spark, folder).raw("lineitem")
    return _evaluate(items, rules.between("l_quantity", 1, 25),
                     rules.between("l_discount", 0.02, 0.08))


def _unique(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluate(_items(spark, folder), rules.unique_key("order_id", "order_item_id"),
                     rules.unique_key("order_id", "nothing"))


def _relationship(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    labelled = t.raw("labels")
    return _evaluate(
        t.order_items(),
        rules.RelationRule("items_orders", "order_id", t.orders(), "order_id"),
        rules.RelationRule("items_labels", "order_id", labelled, "doc_id", rules.WARNING),
    )


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return _evaluate(
        t.order_payments(),
        rules.accepted_values("payment_type", ["1-URGENT", "2-HIGH"], rules.WARNING),
    )


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    orders = silver.transform_sales(ShippedTables(spark, folder).delivered_orders(), "orders")
    return _evaluate(orders, rules.false_flag("has_delivery_before_purchase"),
                     rules.false_flag("is_duplicate_key"), rules.false_flag("no_such_flag"))


def _suite(spark: SparkSession, folder: str, *datasets: str) -> DataFrame:
    frames = silver_frames(spark, folder)
    parts = []
    for name in datasets:
        results = rules.evaluate(frames[name], suites.silver_rules(name, frames[name]))
        parts.append(results.select(F.lit(name).alias("dataset"), *results.columns))
    return rules.union_results(parts).drop("message")


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    frames = silver_frames(spark, folder)
    children = ("orders", "order_items", "order_payments")
    return rules.union_results(
        [rules.evaluate(frames[c], suites.relation_rules(frames, c)) for c in children]
    )


def _silver_results(spark: SparkSession, folder: str) -> DataFrame:
    return suites.silver_results(silver_frames(spark, folder)).drop("message")


def _silver_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return rules.severity_rollup(_silver_results(spark, folder))


def _gold_results(spark: SparkSession, folder: str) -> DataFrame:
    return suites.gold_results(whole_gold(spark, folder))


def _gold_verdict(spark: SparkSession, folder: str) -> DataFrame:
    frames = whole_gold(spark, folder)
    verdict = suites.layer_verdict(suites.gold_results(frames), suites.missing_gold(frames))
    return verdict.withColumn("missing_datasets", F.concat_ws(",", "missing_datasets"))


def _rounded(df: DataFrame) -> DataFrame:
    names = ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_ratio")
    return df.withColumns({n: F.round(n, 8) for n in names})


def _iqr(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of item prices per seller."""
    return _rounded(outliers.iqr_summaries(
        _items(spark, folder).select("seller_id", "price"), "price", ("seller_id",)
    ))


def _iqr_report(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    frames = {
        "order_items": t.order_items(), "order_payments": t.order_payments(),
        "products": t.products(), "selic_target": t.one_series("selic_target"),
        "usd_brl": t.one_series("usd_brl"), "ibc_br": t.one_series("ibc_br"),
        "ipca": t.statistics(),
    }
    return _rounded(build.outlier_report(frames))


QUERIES = {
    "q1_not_null": _not_null,
    "q2_non_negative": _non_negative,
    "q3_between": _between,
    "q4_unique_key": _unique,
    "q5_relationship": _relationship,
    "q6_accepted_values": _accepted,
    "q7_false_flag": _flagged,
    "q10_iqr_summary": _iqr,
    "q11_outlier_report": _iqr_report,
    "q12_items_and_reviews": lambda s, d: _suite(s, d, "order_items", "order_reviews"),
    "q13_other_suites": lambda s, d: _suite(
        s, d, "order_payments", "orders", "customers", "products", "sellers", *fixed.INDICATORS
    ),
    "q14_relationships": _relations,
    "q15_silver_results": _silver_results,
    "a20_severity_rollup": _silver_verdict,
    "q16_gold_results": _gold_results,
    "q17_gold_verdict": _gold_verdict,
}


# -- SQL twins: one SELECT per rule, with the failing condition written out -----------
def _rule(name: str, severity: str, failed: str, table: str, message: str | None = None,
          dataset: str | None = None) -> str:
    """Rule row from an aggregate expression counting the failures of a table."""
    first = f"'{dataset}' as dataset, " if dataset else ""
    last = f", {message} as message" if message else ""
    return (
        f"select {first}'{name}' as rule_name, '{severity}' as severity, f = 0 as passed,"
        f" f as failed_count, t as total_count{last}"
        f" from (select cast({failed} as bigint) as f, count(*) as t from {table}) x"
    )


def _when(condition: str) -> str:
    return f"coalesce(sum(case when {condition} then 1 else 0 end), 0)"


def _key(name: str, severity: str, keys: str, table: str, dataset: str | None = None,
         message: str | None = None) -> str:
    first = f"'{dataset}' as dataset, " if dataset else ""
    last = f", {message} as message" if message else ""
    return (
        f"select {first}'{name}' as rule_name, '{severity}' as severity, f = 0 as passed,"
        f" f as failed_count, t as total_count{last}"
        f" from (select cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as f,"
        f" cast(coalesce(sum(n), 0) as bigint) as t"
        f" from (select count(*) as n from {table} group by {keys}) k) x"
    )


def _orphans(name: str, severity: str, child: str, key: str, parent: str, parent_key: str,
             message: str | None = None, dataset: str | None = None) -> str:
    condition = (f"{key} is not null and {key} not in"
                 f" (select {parent_key} from {parent} where {parent_key} is not null)")
    return _rule(name, severity, _when(condition), child, message, dataset)


_CRITICAL, _WARNING = "critical", "warning"
_ITEMS = [
    *[_rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", "lg_items",
            dataset="order_items") for c in ("order_id", "product_id", "seller_id")],
    *[_rule(f"{c}_non_negative", _CRITICAL, _when(f"{c} is null or {c} < 0"), "lg_items",
            dataset="order_items") for c in ("price", "freight_value")],
    _key("order_id_order_item_id_unique", _CRITICAL, "order_id, order_item_id", "lg_items",
         "order_items"),
    *[_rule(f"has_invalid_{c}_false", _CRITICAL, _when(f"{c} is null or {c} < 0"), "lg_items",
            dataset="order_items") for c in ("price", "freight_value")],
    _rule("has_invalid_shipping_limit_date_false", _CRITICAL,
          "count(*) - count(shipping_limit_date)", "lg_items", dataset="order_items"),
]
_REVIEWS = [
    *[_rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", "lg_reviews",
            dataset="order_reviews") for c in ("review_id", "order_id")],
    _rule("review_score_between_1_5", _CRITICAL,
          _when("not coalesce(review_score between 1 and 5, false)"), "lg_reviews",
          dataset="order_reviews"),
    _key("review_id_unique", _WARNING, "review_id", "lg_reviews", "order_reviews"),
]
_PAYMENT_SET = ", ".join(f"'{v}'" for v in fixed.PAYMENT_TYPES)
_STATUS_SET = ", ".join(f"'{v}'" for v in fixed.ORDER_STATUSES)
_OTHERS = [
    _rule("order_id_not_null", _CRITICAL, "count(*) - count(order_id)", "lg_payments",
          dataset="order_payments"),
    _key("order_id_payment_sequential_unique", _CRITICAL, "order_id, payment_sequential",
         "lg_payments", "order_payments"),
    _rule("payment_type_accepted_values", _WARNING,
          _when(f"not coalesce(payment_type in ({_PAYMENT_SET}), false)"), "lg_payments",
          dataset="order_payments"),
    *[_rule(f"has_invalid_{c}_false", _CRITICAL, _when(f"{c} is null or {c} < 0"),
            "lg_payments", dataset="order_payments")
      for c in ("payment_value", "payment_installments")],
    *[_rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", "lg_delivered",
            dataset="orders") for c in ("order_id", "customer_id")],
    _key("order_id_unique", _CRITICAL, "order_id", "lg_delivered", "orders"),
    _rule("order_status_accepted_values", _CRITICAL,
          _when(f"not coalesce(order_status in ({_STATUS_SET}), false)"), "lg_delivered",
          dataset="orders"),
    _rule("has_invalid_order_purchase_timestamp_false", _CRITICAL,
          "count(*) - count(order_purchase_timestamp)", "lg_delivered", dataset="orders"),
    _rule("has_delivery_before_purchase_false", _CRITICAL,
          _when("order_delivered_customer_date < order_purchase_timestamp"), "lg_delivered",
          dataset="orders"),
    _rule("has_estimate_before_purchase_false", _CRITICAL,
          _when("order_estimated_delivery_date < order_purchase_timestamp"), "lg_delivered",
          dataset="orders"),
    *[_rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", "lg_customers",
            dataset="customers") for c in ("customer_id", "customer_unique_id")],
    _key("customer_id_unique", _CRITICAL, "customer_id", "lg_customers", "customers"),
    _rule("product_id_not_null", _CRITICAL, "count(*) - count(product_id)", "lg_products",
          dataset="products"),
    _key("product_id_unique", _CRITICAL, "product_id", "lg_products", "products"),
    _rule("seller_id_not_null", _CRITICAL, "count(*) - count(seller_id)", "lg_sellers",
          dataset="sellers"),
    _key("seller_id_unique", _CRITICAL, "seller_id", "lg_sellers", "sellers"),
]
for _name in ("selic_target", "usd_brl", "ibc_br"):
    _one = f"(select * from lg_series where indicator_name = '{_name}') i"
    _OTHERS += [
        *[_rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", _one, dataset=_name)
          for c in ("indicator_name", "value")],
        _rule("has_invalid_value_false", _CRITICAL, "count(*) - count(value)", _one,
              dataset=_name),
        _rule("has_invalid_date_false", _CRITICAL, "count(*) - count(date)", _one, dataset=_name),
    ]
_IPCA = ("(select 'ipca' as indicator_name, case when l_linenumber <> 6 then l_tax end as value,"
         " case when l_linenumber <> 7 then l_shipdate end as reference_month from lineitem) i")
_OTHERS += [
    _rule(f"{c}_not_null", _CRITICAL, f"count(*) - count({c})", _IPCA, dataset="ipca")
    for c in ("indicator_name", "value")
]
_OTHERS += [
    _rule(f"has_invalid_{c}_false", _CRITICAL, f"count(*) - count({c})", _IPCA, dataset="ipca")
    for c in ("value", "reference_month")
]


def _relation_rows(with_dataset: bool, message: bool) -> list[str]:
    tables = {"orders": "lg_orders", "order_items": "lg_items", "order_payments": "lg_payments",
              "customers": "lg_customers", "products": "lg_products", "sellers": "lg_sellers"}
    return [
        _orphans(
            f"{child}_{key}_relationship", severity, tables[child], key, tables[parent],
            parent_key,
            f"f || ' orphan rows found for {key} -> {parent_key}'" if message else None,
            child if with_dataset else None,
        )
        for child, key, parent, parent_key, severity in suites.RELATIONS
    ]


_SILVER = [*_ITEMS, *_REVIEWS, *_OTHERS, *_relation_rows(True, False)]


def _gold_rows() -> list[str]:
    tables = {
        "sales_daily": ("g_sales_daily", ["date"], ["gmv", "orders", "average_ticket"]),
        "sales_monthly": ("g_sales_monthly", ["month"], ["gmv"]),
        "category_performance": ("g_category", ["category"], ["gmv"]),
        "customer_metrics": ("g_customers", ["customer_id"], []),
        "seller_metrics": ("g_sellers", ["seller_id"], []),
        "economic_indicators": ("g_indicators", ["reference_month"], []),
        "customer_rfm": ("g_rfm", ["customer_id"], []),
        "delivery_metrics": ("g_delivery", [], []),
        "review_metrics": ("g_reviews", [], []),
        "sales_economic_features": ("g_features", [], []),
        "ml_features": ("g_ml_features", [], []),
        "anomaly_metrics": ("g_anomalies", [], []),
        "dim_date": ("g_dim_date", ["date_key"], []),
    }
    out = []
    for name, (table, key, measures) in tables.items():
        out.append(_rule(f"{name}_not_empty", _CRITICAL,
                         "case when count(*) > 0 then 0 else 1 end", table,
                         f"'{name} has ' || t || ' rows'", name))
        out += [_rule(f"{k}_not_null", _CRITICAL, f"count(*) - count({k})", table,
                      f"f || ' null values found in {k}'", name) for k in key]
        out += [_key(f"{k}_unique", _CRITICAL, k, table, name,
                     f"f || ' duplicate key rows found for [''{k}'']'") for k in key]
        out += [_rule(f"{m}_non_negative", _CRITICAL, _when(f"{m} is null or {m} < 0"), table,
                      f"f || ' negative or invalid values found in {m}'", name)
                for m in measures]
    return out


def _all(rows: list[str]) -> str:
    return " union all ".join(rows)


def _verdict(rows: list[str], missing: str | None = None) -> str:
    critical = "coalesce(sum(case when not passed and severity = 'critical' then 1 end), 0)"
    warning = "coalesce(sum(case when not passed and severity = 'warning' then 1 end), 0)"
    absent = f", '{missing}' as missing_datasets" if missing is not None else ""
    passed = "false" if missing else f"{critical} = 0"
    return (
        f"select count(*) as rules_checked, cast({critical} as bigint) as critical_failures,"
        f" cast({warning} as bigint) as warning_failures, {passed} as passed{absent}"
        f" from ({_all(rows)}) r"
    )


def _iqr_sql(source: str, by: str) -> str:
    return (
        f"select {by}, round(q1, 8) as q1, round(q3, 8) as q3, round(q3 - q1, 8) as iqr,"
        " round(q1 - 1.5 * (q3 - q1), 8) as lower_bound,"
        " round(q3 + 1.5 * (q3 - q1), 8) as upper_bound,"
        " cast(sum(case when v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) then 1"
        " else 0 end) as bigint) as outlier_count, count(v) as total_count,"
        " round(sum(case when v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) then 1"
        " else 0 end) / cast(count(v) as double), 8) as outlier_ratio"
        f" from (select *, quantile_cont(v, 0.25) over (partition by {by}) as q1,"
        f" quantile_cont(v, 0.75) over (partition by {by}) as q3 from ({source}) s) y"
        f" group by {by}, q1, q3"
    )


_OUTLIER_SOURCE = " union all ".join(
    f"select '{dataset}' as dataset, '{column}' as \"column\", cast({column} as double) as v"
    f" from {table}"
    for dataset, column, table in [
        ("order_items", "price", "lg_items"), ("order_items", "freight_value", "lg_items"),
        ("order_payments", "payment_value", "lg_payments"),
        ("products", "product_weight_g", "lg_products"),
        ("products", "product_length_cm", "lg_products"),
        ("products", "product_height_cm", "lg_products"),
        ("products", "product_width_cm", "lg_products"),
        ("ipca", "value", "lg_statistics"),
        *[(n, "value", f"(select * from lg_series where indicator_name = '{n}') i{n}")
          for n in ("selic_target", "usd_brl", "ibc_br")],
    ]
)

ORACLES = {
    "q1_not_null": oracle(_all([
        _rule("review_score_not_null", _CRITICAL, "count(*) - count(review_score)", "lg_reviews",
              "f || ' null values found in review_score'"),
        _rule("review_id_not_null", _CRITICAL, "count(*) - count(review_id)", "lg_reviews",
              "f || ' null values found in review_id'"),
        _rule("absent_not_null", _WARNING, "count(*)", "lg_reviews",
              "f || ' null values found in absent'"),
    ])),
    "q2_non_negative": _all([
        _rule("c_acctbal_non_negative", _CRITICAL, _when("c_acctbal is null or c_acctbal < 0"),
              "customer", "f || ' negative or invalid values found in c_acctbal'"),
        _rule("c_mktsegment_non_negative", _CRITICAL, "count(*)", "customer",
              "f || ' negative or invalid values found in c_mktsegment'"),
    ]),
    "q3_between": _all([
        _rule("l_quantity_between_1_25", _CRITICAL, _when("l_quantity not between 1 and 25"),
              "lineitem", "f || ' values outside [1, 25] found in l_quantity'"),
        _rule("l_discount_between_0.02_0.08", _CRITICAL,
              _when("l_discount not between cast(0.02 as double) and cast(0.08 as double)"),
              "lineitem", "f || ' values outside [0.02, 0.08] found in l_discount'"),
    ]),
    "q4_unique_key": oracle(_all([
        _key("order_id_order_item_id_unique", _CRITICAL, "order_id, order_item_id", "lg_items",
             message="f || ' duplicate key rows found for [''order_id'', ''order_item_id'']'"),
        _rule("order_id_nothing_unique", _CRITICAL, "count(*)", "lg_items",
              "'Missing key columns: [''nothing'']'"),
    ])),
    "q5_relationship": oracle(_all([
        _orphans("items_orders", _CRITICAL, "lg_items", "order_id", "lg_orders", "order_id",
                 "f || ' orphan rows found for order_id -> order_id'"),
        _orphans("items_labels", _WARNING, "lg_items", "order_id", "labels", "doc_id",
                 "f || ' orphan rows found for order_id -> doc_id'"),
    ])),
    "q6_accepted_values": oracle(
        _rule("payment_type_accepted_values", _WARNING,
              _when("not coalesce(payment_type in ('1-URGENT', '2-HIGH'), false)"),
              "lg_payments", "f || ' values outside accepted set found in payment_type'")
    ),
    "q7_false_flag": oracle(_all([
        _rule("has_delivery_before_purchase_false", _CRITICAL,
              _when("order_delivered_customer_date < order_purchase_timestamp"), "lg_delivered",
              "f || ' rows flagged by has_delivery_before_purchase'"),
        _rule("is_duplicate_key_false", _CRITICAL, "count(*) - count(distinct order_id)",
              "lg_delivered", "f || ' rows flagged by is_duplicate_key'"),
        _rule("no_such_flag_false", _CRITICAL, "count(*)", "lg_delivered",
              "'Missing quality flag column: no_such_flag'"),
    ])),
    "q10_iqr_summary": oracle(_iqr_sql("select seller_id, price as v from lg_items", "seller_id")),
    "q11_outlier_report": oracle(_iqr_sql(_OUTLIER_SOURCE, 'dataset, "column"')),
    "q12_items_and_reviews": oracle(_all([*_ITEMS, *_REVIEWS])),
    "q13_other_suites": oracle(_all(_OTHERS)),
    "q14_relationships": oracle(_all(_relation_rows(False, True))),
    "q15_silver_results": oracle(_all(_SILVER)),
    "a20_severity_rollup": oracle(_verdict(_SILVER)),
    "q16_gold_results": oracle(_all(_gold_rows())),
    "q17_gold_verdict": oracle(_verdict(_gold_rows(), "")),
}
