"""MLlib jobs on the whole derived series and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.gold import _daily, _sales
from saleslode.catalogue.sqltext import oracle
from saleslode.plans import gold, ml, rfm
from saleslode.session import cut_lineage


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return gold.ml_features(_daily(spark, folder))


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    """Stored RFM features: the clustering below reads them many times."""
    return cut_lineage(rfm.with_recency(rfm.rfm_base(_sales(spark, folder))))


def _standardised(spark: SparkSession, folder: str) -> DataFrame:
    scaled = ml.standardised(_rfm(spark, folder))
    return scaled.select(
        "customer_id", *[F.round(f"z_{n}", 6).alias(f"z_{n}") for n in fixed.SEGMENT_FEATURES]
    )


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return ml.choose_clusters(cut_lineage(ml.standardised(_rfm(spark, folder))))[1]


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return ml.segment_customers(_rfm(spark, folder))[0]


def _quantity_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """RFM rows grouped by their frequency modulo six in the place of a cluster."""
    return _rfm(spark, folder).withColumn("cluster", F.pmod("frequency", F.lit(6)).cast("int"))


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return ml.compare_anomaly_methods(gold.anomaly_metrics(_daily(spark, folder)))


def _split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ml.forecast_rows(_features(spark, folder)).select(
        "date", "day_of_week", "month", "sales_lag_7", "row_index", "is_train"
    )


def _model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of both trained forecasts, whatever their errors are."""
    return ml.train_forecast(_features(spark, folder)).agg(
        F.array_join(F.sort_array(F.collect_list("model_name")), ",").alias("models"),
        F.min("train_rows").alias("train_rows"), F.max("test_rows").alias("test_rows"),
        F.bool_and((F.col("mae") > 0) & (F.col("mae") <= F.col("rmse"))
                   & (F.col("rmse") < float("inf")) & (F.col("mape") >= 0)).alias("sound"),
    )


def _linear_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the linear regression on the test days."""
    linear = ml.forecast_predictions(_features(spark, folder)).where(
        "model_name = 'linear_regression'")
    return ml.error_metrics(linear, "gmv", "predicted").select(
        F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"),
        F.round("mape", 5).alias("mape"))


def _score_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates, their inertia (falling) and silhouettes (between -1 and 1)."""
    rows = F.sort_array(F.collect_list(F.struct("k", "inertia")))
    return _scores(spark, folder).agg(
        F.array_join(F.sort_array(F.collect_list("k")), ",").alias("candidates"),
        F.forall(F.sequence(F.lit(0), F.size(rows) - 2),
                 lambda i: rows[i]["inertia"] > rows[i + 1]["inertia"]).alias("falling"),
        F.bool_and(F.col("silhouette").between(-1.0, 1.0)).alias("in_range"),
    )


def _segment_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer once, two to six clusters, one name per cluster, all features kept."""
    found = _segments(spark, folder)
    return found.agg(
        F.count("*").alias("customers"), F.countDistinct("customer_id").alias("distinct"),
        F.countDistinct("cluster").between(2, 6).alias("clusters_in_range"),
        (F.countDistinct("cluster", "ml_segment") == F.countDistinct("cluster"))
        .alias("one_name"),
        F.round(F.sum(F.col("monetary").cast("decimal(28,8)")).cast("double"), 2)
        .alias("monetary"),
    )


def _method_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Z-score days exactly, the forest's share of days, and overlap as conjunction."""
    share = F.count_if("isolation_forest_anomaly")
    wanted = F.count("*") * fixed.CONTAMINATION
    both = F.col("isolation_forest_anomaly") & F.col("any_zscore_anomaly")
    return _anomalies(spark, folder).agg(
        F.count("*").alias("days"), F.count_if("any_zscore_anomaly").alias("zscore_days"),
        share.between(F.floor(wanted), F.ceil(wanted)).alias("forest_share"),
        F.bool_and(both == F.col("anomaly_method_overlap")).alias("overlap_is_both"),
    )


QUERIES = {
    "m1_linear_errors": _linear_errors,
    "m1_model_facts": _model_facts,
    "m4_score_facts": _score_facts,
    "m5_segment_facts": _segment_facts,
    "m7_method_facts": _method_facts,
    "m1_forecast_rows": _split_rows,
    "m1_forecast_models": lambda s, d: ml.train_forecast(_features(s, d)),
    "m3_standardised": _standardised,
    "m4_cluster_scores": _scores,
    "m5_customer_segments": _segments,
    "m6_cluster_names": lambda s, d: ml.name_clusters(
        ml.centroids(_quantity_clusters(s, d))
    ),
    "a21_centroids": lambda s, d: ml.centroids(_quantity_clusters(s, d)),
    "w10_centroid_ranks": lambda s, d: ml.ranked_centroids(
        ml.centroids(_quantity_clusters(s, d))
    ).select("cluster", "monetary_rank", "recency_rank"),
    "m7_anomaly_methods": _anomalies,
}

_WIDTH = len(fixed.FORECAST_FEATURES) + 1


def _standard(name: str) -> str:
    return (f"({name} - avg({name}) filter (where is_train) over ())"
            f" / stddev_pop({name}) filter (where is_train) over ()")


# Least squares by its normal equations: sums of products of the standardised training rows,
# solved by Gauss-Jordan steps, one column each.
_LINEAR_ERRORS = f"""
    select * from (with recursive f as (
      select *, isodow(date) - 1 as day_of_week, month(date) as month,
             row_number() over (order by date) - 1 < floor(count(*) over () * 0.8) as is_train
      from g_ml_features where sales_lag_7 is not null and sales_lag_1 is not null),
    z as (
      select is_train, cast(gmv as double) as y,
             [1.0, {", ".join(_standard(n) for n in fixed.FORECAST_FEATURES)},
              cast(gmv as double)]::double[] as v from f),
    sums as (
      select i, j, sum(v[i] * v[j]) as s from z, range(1, {_WIDTH + 1}) a(i),
             range(1, {_WIDTH + 2}) b(j) where is_train group by i, j),
    g(k, m) as (
      select 0, list(line order by i)
      from (select i, list(s order by j) as line from sums group by i)
      union all
      select k + 1,
             [case when i = k + 1 then p
                   else [m[i][j] - m[i][k + 1] * p[j] for j in range(1, {_WIDTH + 2})] end
              for i in range(1, {_WIDTH + 1})]
      from (select k, m, [x / m[k + 1][k + 1] for x in m[k + 1]] as p from g where k < {_WIDTH})),
    e as (
      select y, y - list_sum([v[i] * m[i][{_WIDTH + 1}] for i in range(1, {_WIDTH + 1})]) as e
      from z, g where k = {_WIDTH} and not is_train)
    select round(avg(abs(e)), 3) as mae, round(sqrt(avg(e * e)), 3) as rmse,
           round(avg(case when y <> 0 then abs(e / y) end), 5) as mape from e) r"""

_CENTROIDS = """
    select cast(frequency % 6 as int) as cluster,
           round(sum(recency_days), 4) / count(recency_days) as recency_days,
           round(sum(frequency), 4) / count(frequency) as frequency,
           round(sum(monetary), 4) / count(monetary) as monetary
    from g_rfm_base group by 1"""

ORACLES = {
    "m1_linear_errors": oracle(_LINEAR_ERRORS),
    "m1_model_facts": oracle("""
        select 'linear_regression,random_forest' as models,
               cast(floor(count(*) * 0.8) as bigint) as train_rows,
               cast(count(*) - floor(count(*) * 0.8) as bigint) as test_rows, true as sound
        from g_ml_features where sales_lag_7 is not null and sales_lag_1 is not null"""),
    "m4_score_facts": oracle("""
        select '2,3,4,5,6' as candidates, count(*) > 6 as falling, count(*) > 6 as in_range
        from g_rfm_base"""),
    "m5_segment_facts": oracle("""
        select count(*) as customers, count(distinct customer_id) as distinct,
               true as clusters_in_range, true as one_name, round(sum(monetary), 2) as monetary
        from g_rfm_base"""),
    "m7_method_facts": oracle("""
        select count(*) as days,
               count(*) filter (where gmv_zscore_anomaly or orders_zscore_anomaly
                                or average_ticket_zscore_anomaly
                                or freight_value_zscore_anomaly) as zscore_days,
               true as forest_share, true as overlap_is_both from g_anomalies"""),
    "m1_forecast_rows": oracle("""
        select date, cast(isodow(date) - 1 as int) as day_of_week, cast(month(date) as int) as month,
               sales_lag_7, cast(row_number() over (order by date) - 1 as int) as row_index,
               row_number() over (order by date) - 1 < floor(count(*) over () * 0.8) as is_train
        from g_ml_features where sales_lag_7 is not null and sales_lag_1 is not null"""),
    "m3_standardised": oracle("""
        select customer_id,
               round((recency_days - avg(recency_days) over ())
                     / stddev_pop(recency_days) over (), 6) as z_recency_days,
               round((frequency - avg(frequency) over ()) / stddev_pop(frequency) over (), 6)
                   as z_frequency,
               round((monetary - avg(monetary) over ()) / stddev_pop(monetary) over (), 6)
                   as z_monetary
        from g_rfm_base"""),
    "m6_cluster_names": oracle("""
        select cluster, recency_days, frequency, monetary,
               case when monetary_rank = clusters and recency_rank >= 4 then 'vip'
                    when recency_days > high then 'at_risk'
                    when recency_days < low then 'recent' else 'standard' end as ml_segment
        from (select *, row_number() over (order by monetary, cluster) as monetary_rank,
                     row_number() over (order by recency_days desc, cluster) as recency_rank,
                     count(*) over () as clusters from c) r
        cross join (select quantile_cont(recency_days, 0.75) as high,
                           quantile_cont(recency_days, 0.25) as low from c) q""",
                               c=_CENTROIDS),
    "a21_centroids": oracle("select * from c", c=_CENTROIDS),
    "w10_centroid_ranks": oracle("""
        select cluster, cast(row_number() over (order by monetary, cluster) as int)
                   as monetary_rank,
               cast(row_number() over (order by recency_days desc, cluster) as int)
                   as recency_rank from c""", c=_CENTROIDS),
}
