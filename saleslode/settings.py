"""Fixed values of the data model: names, keys, accepted sets and thresholds.

These must equal what existing consumers of the datasets rely on; nothing here is
computed.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: sources and files ---------------------------------------------
SALES_SOURCE = "olist"
SERIES_SOURCE = "bcb"
STATISTICS_SOURCE = "ibge"
SOURCES = (SALES_SOURCE, SERIES_SOURCE, STATISTICS_SOURCE)
SERIES_SOURCE_LABEL = "bcb_sgs"
STATISTICS_SOURCE_LABEL = "ibge_sidra"

EXPECTED_FILES = {
    "customers": "olist_customers_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "product_category_name_translation": "product_category_name_translation.csv",
}

# Files whose quoted cells hold free text with line breaks.
MULTILINE_DATASETS = ("order_reviews",)

# CSV cells read as missing.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INDICATORS = ("selic_target", "usd_brl", "ibc_br", "ipca")
INDICATOR_SOURCES = {
    "selic_target": "bcb_sgs",
    "usd_brl": "bcb_sgs",
    "ibc_br": "bcb_sgs",
    "ipca": "ibge_sidra",
}

# --- fixed values: Bronze --------------------------------------------------------
BRONZE_REQUIRED = ("batch_id", "ingestion_timestamp", "source")

# --- fixed values: Silver --------------------------------------------------------
DATE_COLUMNS = {
    "orders": (
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ),
    "order_items": ("shipping_limit_date",),
    "order_reviews": ("review_creation_date", "review_answer_timestamp"),
}
TEXT_COLUMNS = {
    "customers": ("customer_city", "customer_state"),
    "sellers": ("seller_city", "seller_state"),
    "geolocation": ("geolocation_city", "geolocation_state"),
    "products": ("product_category_name",),
    "product_category_name_translation": (
        "product_category_name", "product_category_name_english",
    ),
}
PRODUCT_MEASURES = (
    "product_name_lenght", "product_description_lenght", "product_photos_qty",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
)
NUMBER_COLUMNS = {
    "order_items": ("price", "freight_value"),
    "order_payments": ("payment_value",),
    "products": PRODUCT_MEASURES,
    "geolocation": ("geolocation_lat", "geolocation_lng"),
}
INTEGER_COLUMNS = {
    "customers": ("customer_zip_code_prefix",),
    "sellers": ("seller_zip_code_prefix",),
    "geolocation": ("geolocation_zip_code_prefix",),
    "order_items": ("order_item_id",),
    "order_payments": ("payment_sequential", "payment_installments"),
    "order_reviews": ("review_score",),
}
NON_NEGATIVE_COLUMNS = {
    "order_items": ("price", "freight_value"),
    "order_payments": ("payment_value", "payment_installments"),
    "products": PRODUCT_MEASURES,
}
KEY_COLUMNS = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "product_category_name_translation": ("product_category_name",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id",),
}
SERIES_KEY = ("indicator_name", "series_code", "date")
STATISTICS_KEY = ("indicator_name", "territory_code", "variable_code", "period_code")
STATISTICS_NAMES = {
    "V": "value",
    "D1C": "territory_code",
    "D1N": "territory_name",
    "D2C": "variable_code",
    "D2N": "variable_name",
    "D3C": "period_code",
    "D3N": "period_name",
    "MN": "unit",
}
STATISTICS_COLUMNS = (
    "indicator_name", "source", "ingestion_timestamp", "batch_id", "value", "unit",
    "territory_code", "territory_name", "variable_code", "variable_name", "period_code",
    "period_name", "reference_month", "has_invalid_value", "has_invalid_reference_month",
    "is_duplicate_key",
)
STATISTICS_HEADER = "valor"

ORDER_STATUSES = (
    "delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created",
    "approved",
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")

OUTLIER_COLUMNS = {
    "order_items": ("price", "freight_value"),
    "order_payments": ("payment_value",),
    "products": (
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    ),
    "selic_target": ("value",),
    "usd_brl": ("value",),
    "ibc_br": ("value",),
    "ipca": ("value",),
}

# --- fixed values: Gold ----------------------------------------------------------
GOLD_GRAINS = {
    "sales_daily": "one row per purchase date",
    "sales_monthly": "one row per purchase month",
    "category_performance": "one row per category",
    "customer_metrics": "one row per customer_id",
    "seller_metrics": "one row per seller_id",
    "delivery_metrics": "one row per purchase date",
    "review_metrics": "one row per review creation date",
    "economic_indicators": "one row per month",
    "sales_economic_features": "one row per sales month",
    "customer_rfm": "one row per customer_id with orders",
    "ml_features": "one row per purchase date",
    "anomaly_metrics": "one row per purchase date",
    "dim_date": "one row per calendar date",
}
UNKNOWN_CATEGORY = "unknown"
ANOMALY_METRICS = ("gmv", "orders", "average_ticket", "freight_value")
ZSCORE_THRESHOLD = 3.0
RFM_BINS = 5

# --- fixed values: analytics and models ------------------------------------------
CORRELATION_METRICS = ("gmv", "orders", "average_ticket")
MIN_OBSERVATIONS = 3
NEGATIVE_SCORE, POSITIVE_SCORE = 2, 4
TEXT_COVERAGE_FLOOR = 0.2
TEXT_SUFFICIENT = "text_quality_sufficient_for_future_nlp"
TEXT_INSUFFICIENT = "prioritize_score_delivery_analysis_before_nlp"
ECONOMIC_NOTES = (
    "Correlations are descriptive and do not imply causality.",
    "Economic coverage depends on the available configured BCB and SIDRA series.",
)
FORECAST_FEATURES = (
    "orders", "customers", "items_sold", "freight_value", "average_ticket", "sales_lag_1",
    "sales_lag_7", "rolling_mean_7", "rolling_mean_30", "day_of_week", "month",
)
TRAIN_SHARE = 0.8
CONTAMINATION = 0.03
SEGMENT_FEATURES = ("recency_days", "frequency", "monetary")
CLUSTER_RANGE = (2, 3, 4, 5, 6)
CLUSTER_DEFAULT = 3
SEED = 42

# --- fixed values: monitoring and serving ----------------------------------------
MODEL_OUTPUTS = (
    "customer_segments", "anomaly_method_comparison", "review_intelligence_summary",
)
REPORT_KINDS = {
    "bronze_quality": ("bronze", "_quality_reports/bronze_validation_"),
    "silver_quality": ("silver", "_quality_reports/silver_quality_"),
    "gold_quality": ("gold", "_quality_reports/gold_quality_"),
    "kpis": ("gold", "_analytics_reports/kpis_"),
    "economic": ("gold", "_analytics_reports/economic_"),
    "forecast": ("models", "reports/sales_forecast_"),
    "segmentation": ("models", "reports/customer_segmentation_"),
    "anomaly": ("models", "reports/anomaly_detection_"),
    "reviews": ("models", "reports/review_intelligence_"),
}
SERVED_REPORTS = ("kpis", "economic", "forecast", "segmentation", "anomaly", "reviews")
SEGMENT_LABELS = {
    "standard": "Padrao",
    "recent": "Recentes",
    "at_risk": "Em risco",
    "vip": "VIP",
}
STATUS_LABELS = {"passed": "Aprovado", "warning": "Atenção", "failed": "Falha"}
METRIC_LABELS = {
    "gmv": "GMV",
    "orders": "Pedidos",
    "average_ticket": "Ticket médio",
    "mae": "MAE",
    "rmse": "RMSE",
    "mape": "MAPE",
}


@dataclass(frozen=True)
class Layout:
    """Folders of one data lake; any file system Spark can reach."""

    data: str
    models: str

    @property
    def bronze(self) -> str:
        return f"{self.data}/bronze"

    @property
    def silver(self) -> str:
        return f"{self.data}/silver"

    @property
    def gold(self) -> str:
        return f"{self.data}/gold"

    def folder(self, layer: str) -> str:
        folders = {"bronze": self.bronze, "silver": self.silver, "gold": self.gold,
                   "models": self.models}
        return folders[layer]


@dataclass(frozen=True)
class SeriesIndicator:
    """A daily or monthly indicator series: dataset name and series code."""

    name: str
    series_code: int


@dataclass(frozen=True)
class StatisticsIndicator:
    """A statistics-table query: dataset name, table number and query path."""

    name: str
    table: str
    path: str


SERIES_INDICATORS = (
    SeriesIndicator("selic_target", 432),
    SeriesIndicator("usd_brl", 1),
    SeriesIndicator("ibc_br", 24363),
)
STATISTICS_INDICATORS = (
    StatisticsIndicator("ipca", "1737", "n1/all/v/63/p/201609-201809"),
)
