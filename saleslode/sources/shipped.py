"""Logical sales tables derived from a TPC-H-like star schema.

Lets every plan run on tables of the shape ``orders / lineitem / customer / supplier /
part / nation / region / documents / labels``. Each method is a plain projection or an
equi-join, so scans stay column-pruned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslode.functions import month_of, to_day

DELIVERY_ALLOWANCE_DAYS = 45
REVIEW_DELAY_DAYS = 60
INDICATOR_OF_FLAG = {"A": "selic_target", "N": "usd_brl", "R": "ibc_br"}
SERIES_CODE_OF_FLAG = {"A": 432, "N": 1, "R": 24363}


@dataclass(frozen=True)
class ShippedTables:
    spark: SparkSession
    folder: str
    schemas: dict[str, T.StructType] = field(default_factory=dict, compare=False)

    def raw(self, name: str) -> DataFrame:
        """A new scan of one table; its schema is looked up in the files only once."""
        reader = self.spark.read
        if name in self.schemas:
            return reader.schema(self.schemas[name]).parquet(f"{self.folder}/{name}.parquet")
        df = reader.parquet(f"{self.folder}/{name}.parquet")
        self.schemas[name] = df.schema
        return df

    # -- sales ---------------------------------------------------------------------
    def orders(self) -> DataFrame:
        """Orders without delivery dates."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + F.expr(f"interval {DELIVERY_ALLOWANCE_DAYS} days")).alias(
                "order_estimated_delivery_date"
            ),
        )

    def delivered_orders(self) -> DataFrame:
        """Orders with first shipment as carrier date and last shipment as delivery."""
        shipments = (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(
                F.min("l_shipdate").alias("order_delivered_carrier_date"),
                F.max("l_shipdate").alias("order_delivered_customer_date"),
            )
        )
        return self.orders().join(shipments, "order_id", "left")

    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
            F.col("l_shipdate").alias("shipping_limit_date"),
        )

    def order_payments(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            F.col("o_totalprice").alias("payment_value"),
            F.lit(1).alias("payment_installments"),
        )

    def order_reviews(self) -> DataFrame:
        """Documents as review texts of the order with the same number."""
        purchases = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            (F.col("o_orderdate") + F.expr(f"interval {REVIEW_DELAY_DAYS} days")).alias(
                "review_creation_date"
            ),
        )
        good, toxic = F.col("quality") == 1, F.col("toxic") == 1
        score = (
            F.when(good & ~toxic, 5).when(good & toxic, 3).when(~good & ~toxic, 2)
            .when(~good & toxic, 1)
        )
        return (
            self.raw("documents")
            .select("doc_id", "text")
            .join(self.raw("labels"), "doc_id", "left")
            .select(
                F.col("doc_id").alias("review_id"),
                F.col("doc_id").alias("order_id"),
                score.cast("bigint").alias("review_score"),
                F.col("text").alias("review_comment_message"),
            )
            .join(purchases, "order_id", "left")
            .select("review_id", "order_id", "review_score", "review_comment_message",
                    "review_creation_date")
        )

    # -- parties and products ------------------------------------------------------
    def _places(self) -> DataFrame:
        nations, regions = self.raw("nation"), self.raw("region")
        return nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
            "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")
        )

    def customers(self) -> DataFrame:
        customer, places = self.raw("customer"), self._places()
        return customer.join(places, customer["c_nationkey"] == places["n_nationkey"]).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_nationkey").cast("bigint").alias("customer_zip_code_prefix"),
            F.col("city").alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    def sellers(self) -> DataFrame:
        supplier, places = self.raw("supplier"), self._places()
        return supplier.join(places, supplier["s_nationkey"] == places["n_nationkey"]).select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("city").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_brand").alias("product_description_lenght"),
            F.col("p_size").alias("product_photos_qty"),
            F.col("p_retailprice").alias("product_weight_g"),
            (F.col("p_size") * 2).alias("product_length_cm"),
            (F.col("p_size") + 5).alias("product_height_cm"),
            F.col("p_size").alias("product_width_cm"),
        )

    def translation(self) -> DataFrame:
        """English names of every category but the alphabetically first."""
        names = self.raw("part").select("p_type").distinct()
        first = self.raw("part").agg(F.min("p_type")).scalar()
        return names.where(F.col("p_type") != first).select(
            F.col("p_type").alias("product_category_name"),
            F.lower("p_type").alias("product_category_name_english"),
        )

    def geolocation(self) -> DataFrame:
        return self._places().select(
            F.col("n_nationkey").cast("bigint").alias("geolocation_zip_code_prefix"),
            F.col("city").alias("geolocation_city"),
            F.col("state").alias("geolocation_state"),
        )

    # -- economic indicators -------------------------------------------------------
    def series(self) -> DataFrame:
        """Three day-grain indicator series in long form."""
        flag = F.col("l_returnflag")
        names = F.create_map(*[F.lit(v) for kv in INDICATOR_OF_FLAG.items() for v in kv])
        codes = F.create_map(*[F.lit(v) for kv in SERIES_CODE_OF_FLAG.items() for v in kv])
        return self.raw("lineitem").select(
            to_day(F.col("l_shipdate")).alias("date"),
            F.col("l_discount").alias("value"),
            codes[flag].cast("bigint").alias("series_code"),
            names[flag].alias("indicator_name"),
        )

    def one_series(self, indicator: str) -> DataFrame:
        """One of the three series; the choice reaches the scan as a pushed filter."""
        flag = next(f for f, name in INDICATOR_OF_FLAG.items() if name == indicator)
        return self.raw("lineitem").where(F.col("l_returnflag") == flag).select(
            to_day(F.col("l_shipdate")).alias("date"),
            F.col("l_discount").alias("value"),
            F.lit(SERIES_CODE_OF_FLAG[flag]).cast("bigint").alias("series_code"),
            F.lit(indicator).alias("indicator_name"),
        )

    def statistics(self) -> DataFrame:
        """The month-grain indicator ``ipca``."""
        return self.raw("lineitem").select(
            month_of(F.col("l_shipdate")).alias("reference_month"),
            F.lit("ipca").alias("indicator_name"),
            F.col("l_tax").alias("value"),
        )
