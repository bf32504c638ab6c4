"""Rule suites of the Silver and Gold layers, model tests and layer verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.operators.keys import missing_names
from saleslode.operators.rules import (
    WARNING,
    NotEmptyRule,
    RelationRule,
    Rule,
    accepted_values,
    between,
    evaluate,
    evaluate_tables,
    false_flag,
    non_negative,
    not_null,
    severity_rollup,
    union_results,
    unique_key,
)

ITEM_RULES: tuple[Rule, ...] = (
    not_null("order_id"),
    not_null("product_id"),
    not_null("seller_id"),
    non_negative("price"),
    non_negative("freight_value"),
)
REVIEW_RULES: tuple[Rule, ...] = (
    not_null("review_id"),
    not_null("order_id"),
    between("review_score", 1, 5),
)

SILVER_RULES: dict[str, tuple[Rule, ...]] = {
    "order_items": (
        *ITEM_RULES,
        unique_key("order_id", "order_item_id"),
        false_flag("has_invalid_price"),
        false_flag("has_invalid_freight_value"),
        false_flag("has_invalid_shipping_limit_date"),
    ),
    "order_payments": (
        not_null("order_id"),
        unique_key("order_id", "payment_sequential"),
        accepted_values("payment_type", fixed.PAYMENT_TYPES, WARNING),
        false_flag("has_invalid_payment_value"),
        false_flag("has_invalid_payment_installments"),
    ),
    "order_reviews": (*REVIEW_RULES, unique_key("review_id", severity=WARNING)),
    "orders": (
        not_null("order_id"),
        not_null("customer_id"),
        unique_key("order_id"),
        accepted_values("order_status", fixed.ORDER_STATUSES),
        false_flag("has_invalid_order_purchase_timestamp"),
        false_flag("has_delivery_before_purchase"),
        false_flag("has_estimate_before_purchase"),
    ),
    "customers": (
        not_null("customer_id"), not_null("customer_unique_id"), unique_key("customer_id"),
    ),
    "products": (not_null("product_id"), unique_key("product_id")),
    "sellers": (not_null("seller_id"), unique_key("seller_id")),
}
INDICATOR_FLAGS = ("has_invalid_value", "has_invalid_date", "has_invalid_reference_month")

GOLD_RULES: dict[str, tuple[Rule, ...]] = {
    "sales_daily": (
        not_null("date"), unique_key("date"), non_negative("gmv"), non_negative("orders"),
        non_negative("average_ticket"),
    ),
    "sales_monthly": (not_null("month"), unique_key("month"), non_negative("gmv")),
    "category_performance": (not_null("category"), unique_key("category"), non_negative("gmv")),
    "customer_metrics": (not_null("customer_id"), unique_key("customer_id")),
    "seller_metrics": (not_null("seller_id"), unique_key("seller_id")),
    "economic_indicators": (not_null("reference_month"), unique_key("reference_month")),
    "customer_rfm": (not_null("customer_id"), unique_key("customer_id")),
    "dim_date": (not_null("date_key"), unique_key("date_key")),
}

# (child, child column, parent, parent column, severity)
RELATIONS = (
    ("orders", "customer_id", "customers", "customer_id", "critical"),
    ("order_items", "order_id", "orders", "order_id", "critical"),
    ("order_items", "product_id", "products", "product_id", "warning"),
    ("order_items", "seller_id", "sellers", "seller_id", "critical"),
    ("order_payments", "order_id", "orders", "order_id", "critical"),
)

# model -> ((column, tests), ...)
MODEL_TESTS = {
    "stg_sales_daily": (("date_key", ("unique", "not_null")), ("gmv", ("not_null",))),
    "stg_sales_monthly": (("month", ("unique", "not_null")), ("gmv", ("not_null",))),
    "stg_category_performance": (("category", ("unique", "not_null")),),
    "stg_economic_indicators": (("reference_month", ("unique", "not_null")),),
    "stg_dim_date": (("date_key", ("unique", "not_null")),),
    "mart_sales": (("month", ("unique", "not_null")),),
    "mart_category": (("category", ("unique", "not_null")),),
}


def silver_rules(dataset: str, df: DataFrame) -> tuple[Rule, ...]:
    """Rules of a Silver dataset; indicators add one per flag column they carry."""
    if dataset in fixed.INDICATORS:
        flags = [false_flag(name) for name in INDICATOR_FLAGS if name in df.columns]
        return (not_null("indicator_name"), not_null("value"), *flags)
    return SILVER_RULES.get(dataset, ())


def relation_rules(frames: Mapping[str, DataFrame], child: str) -> list[RelationRule]:
    """Referential checks of one child table, or none unless all six tables are there."""
    needed = {name for relation in RELATIONS for name in (relation[0], relation[2])}
    if not needed.issubset(frames):
        return []
    return [
        RelationRule(f"{child}_{column}_relationship", column, frames[parent], parent_column,
                     severity)
        for owner, column, parent, parent_column, severity in RELATIONS
        if owner == child
    ]


def silver_results(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Result rows of every rule of every dataset given, with its dataset name."""
    return evaluate_tables(frames, {
        name: [*silver_rules(name, df), *relation_rules(frames, name)]
        for name, df in frames.items()})


def gold_rules(dataset: str) -> tuple[Rule, ...]:
    return (NotEmptyRule(dataset), *GOLD_RULES.get(dataset, ()))


def gold_results(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Result rows of the Gold suites of the datasets given."""
    return evaluate_tables(dict(sorted(frames.items())), {n: gold_rules(n) for n in frames})


def layer_verdict(results: DataFrame, missing: Sequence[str] = ()) -> DataFrame:
    """Roll-up by severity; a layer also fails while a required dataset is missing."""
    listed = F.array(*[F.lit(name) for name in missing]).cast("array<string>")
    rolled = severity_rollup(results).withColumn("missing_datasets", listed)
    return rolled.withColumn("passed", F.col("passed") & (F.size("missing_datasets") == 0))


def missing_gold(frames: Mapping[str, DataFrame]) -> list[str]:
    return missing_names(fixed.GOLD_GRAINS, frames)


def model_test_results(models: Mapping[str, DataFrame]) -> DataFrame:
    """unique / not_null tests per model; ``unique`` leaves NULLs to ``not_null``."""
    parts = []
    for model, columns in MODEL_TESTS.items():
        if model not in models:
            continue
        for column, tests in columns:
            for test in tests:
                rule = not_null(column) if test == "not_null" else unique_key(column)
                rows = models[model]
                if test == "unique":
                    rows = rows.where(F.col(column).isNotNull())
                parts.append(
                    evaluate(rows, [rule]).select(
                        F.lit(model).alias("model"), F.lit(column).alias("column_name"),
                        F.lit(test).alias("test"), "passed", "failed_count",
                    )
                )
    return union_results(parts)
