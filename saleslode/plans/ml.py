"""Forecast baselines, customer clusters and anomaly comparison on MLlib."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.operators import kmeans, series
from saleslode.operators import trees as trees_of
from saleslode.operators.reshape import hashed_sample
from saleslode.plans.serving import any_flag
from saleslode.session import cut_lineage

# -- forecast -----------------------------------------------------------------------
TREES = 100


def forecast_rows(features: DataFrame) -> DataFrame:
    """Complete rows of ``ml_features`` with weekday and month, split by position in time.

    Orders, items and freight of the same day are features, as in the baseline this
    reproduces; the errors are therefore optimistic.
    """
    dated = features.withColumns(
        {"day_of_week": F.weekday("date"), "month": F.month("date")}
    )
    complete = series.drop_incomplete(dated, [*fixed.FORECAST_FEATURES, "gmv"])
    return series.temporal_split(complete, "date", fixed.TRAIN_SHARE)


def error_metrics(predictions: DataFrame, target: str, predicted: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE (a fraction; zero targets are left out, none left is NULL)."""
    error = F.col(target) - F.col(predicted)
    nonzero = F.when(F.col(target) != 0, F.abs(error / F.col(target)))
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(nonzero).alias("mape"),
    )


def forecast_predictions(features: DataFrame, trees: int = TREES,
                         depth: int | None = None) -> DataFrame:
    """(position, model_name, date, gmv, predicted) of the test days, one row per model.

    Forest splits are exact: every midpoint between neighbouring values is tried.
    """
    rows = cut_lineage(forecast_rows(features).select(
        "date", F.col("gmv").cast("double").alias("gmv"), "is_train",
        *[F.col(n).cast("double").alias(n) for n in fixed.FORECAST_FEATURES]))
    assembled = VectorAssembler(
        inputCols=list(fixed.FORECAST_FEATURES), outputCol="features").transform(rows)
    linear = LinearRegression(
        labelCol="gmv", solver="normal", regParam=0.0, predictionCol="predicted"
    ).fit(assembled.where("is_train")).transform(assembled.where("not is_train"))
    forest = trees_of.forest_predictions(rows, "date", fixed.FORECAST_FEATURES, "gmv", "is_train",
                                         trees, depth, fixed.SEED)
    forest = rows.where("not is_train").select("date", "gmv").join(forest, "date")
    parts = [
        part.select(F.lit(position).alias("position"), F.lit(name).alias("model_name"), "date",
                    "gmv", "predicted")
        for position, (name, part) in enumerate(
            {"linear_regression": linear, "random_forest": forest}.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def train_forecast(features: DataFrame, trees: int = TREES,
                   depth: int | None = None) -> DataFrame:
    """Linear regression against a random forest: one metric row per model."""
    measured = error_metrics(forecast_predictions(features, trees, depth), "gmv", "predicted",
                             ("position", "model_name"))
    sizes = forecast_rows(features).agg(
        F.struct(F.count_if("is_train").alias("train"),
                 F.count_if(~F.col("is_train")).alias("test"))).scalar()
    return measured.withColumns({"train_rows": sizes["train"], "test_rows": sizes["test"]})


# -- segmentation -------------------------------------------------------------------
RESTARTS = 10


def standardised(rfm: DataFrame) -> DataFrame:
    """Customers with complete features, plus ``scaled`` (mean 0, population deviation 1)."""
    names = fixed.SEGMENT_FEATURES
    complete = rfm.dropna(subset=list(names)).withColumns(
        {name: F.col(name).cast("double") for name in names}
    )
    moments = complete.agg(
        F.struct(
            *[
                F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("spread")).alias(n)
                for n in names
            ]
        )
    ).scalar()
    held = complete.withColumn("_m", moments)

    def scaled(name: str) -> Column:
        stats = F.col("_m")[name]
        spread = F.when(stats["spread"] == 0, F.lit(1.0)).otherwise(stats["spread"])
        return ((F.col(name) - stats["mean"]) / spread).alias(f"z_{name}")

    return held.select(*complete.columns, *[scaled(n) for n in names])


def _scaled_names() -> list[str]:
    return [f"z_{n}" for n in fixed.SEGMENT_FEATURES]


def fit_kmeans(scaled: DataFrame, ks: Sequence[int], restarts: int = RESTARTS,
               scores: bool = False) -> dict[int, kmeans.Model]:
    """Lowest-cost model of several seeded starts for each k, all fitted by the same scans.

    The scaled features are persisted meanwhile. ``scores`` adds the silhouettes.
    """
    points = scaled.select(F.xxhash64("customer_id").alias("key"), *_scaled_names()).persist(
        StorageLevel.MEMORY_AND_DISK)
    starts = [(k, fixed.SEED + start) for k in ks for start in range(restarts)]
    fitted = kmeans.fit_many(points, starts)
    best = {k: fitted.best(k) for k in ks}
    if scores:
        kmeans.score_silhouettes(points, list(best.values()))
    points.unpersist()
    return best


def choose_clusters(scaled: DataFrame, candidates: Sequence[int] = fixed.CLUSTER_RANGE,
                    restarts: int = RESTARTS, sample: int | None = None
                    ) -> tuple[int, DataFrame, dict[int, kmeans.Model]]:
    """Number of clusters with the best silhouette, every candidate's score, and the models.

    All customers are scored; ``sample`` limits them to so many if it is given. Starts from
    the default and changes only on a strictly better score.
    """
    if sample is not None:
        scaled = hashed_sample(scaled, "customer_id", sample)
    models = fit_kmeans(scaled, candidates, restarts, scores=True)
    best, best_score = fixed.CLUSTER_DEFAULT, -1.0
    for k in candidates:
        score = models[k].silhouette
        if score is not None and score > best_score:
            best, best_score = k, score
    frame = scaled.sparkSession.createDataFrame(
        [(k, models[k].cost, models[k].silhouette) for k in candidates],
        "k int, inertia double, silhouette double"
    )
    return best, frame, models


def centroids(clustered: DataFrame) -> DataFrame:
    """Mean behaviour per cluster, in original units."""
    return clustered.groupBy("cluster").agg(
        *[
            F.try_divide(F.round(F.sum(n), 4), F.count(n)).alias(n)
            for n in fixed.SEGMENT_FEATURES
        ]
    )


def ranked_centroids(means: DataFrame) -> DataFrame:
    """Centroids with rising monetary and falling recency rank; at most six rows."""
    return means.withColumns(
        {
            "monetary_rank": F.row_number().over(Window.orderBy("monetary", "cluster")),
            "recency_rank": F.row_number().over(
                Window.orderBy(F.col("recency_days").desc(), "cluster")
            ),
        }
    )


def name_clusters(means: DataFrame) -> DataFrame:
    """Business name per cluster from its place among the centroids."""
    limits = means.agg(
        F.struct(
            F.percentile("recency_days", F.lit(0.75)).alias("high"),
            F.percentile("recency_days", F.lit(0.25)).alias("low"),
            F.count(F.lit(1)).alias("clusters"),
        )
    ).scalar()
    ranked = ranked_centroids(means).withColumn("_limits", limits)
    top = F.col("monetary_rank") == F.col("_limits.clusters")
    return ranked.select(
        *means.columns,
        F.when(top & (F.col("recency_rank") >= 4), "vip")
        .when(F.col("recency_days") > F.col("_limits.high"), "at_risk")
        .when(F.col("recency_days") < F.col("_limits.low"), "recent")
        .otherwise("standard")
        .alias("ml_segment"),
    )


def segment_customers(rfm: DataFrame, restarts: int = RESTARTS,
                      sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Customers with ``cluster`` and ``ml_segment``, and the candidate scores.

    Six centroids at most are broadcast to name the clusters.
    """
    scaled = cut_lineage(standardised(rfm))
    chosen, scores, models = choose_clusters(scaled, restarts=restarts, sample=sample)
    if sample is not None or chosen not in models:
        models = fit_kmeans(scaled, [chosen], restarts)
    clustered = scaled.withColumn("cluster", kmeans.nearest(models[chosen], _scaled_names()))
    kept = clustered.select(*rfm.columns, "cluster")
    names = name_clusters(centroids(kept)).select("cluster", "ml_segment")
    return kept.join(F.broadcast(names), "cluster"), scores


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("ml_segment").agg(F.count(F.lit(1)).alias("customers"))


# -- anomalies ----------------------------------------------------------------------
FOREST_TREES, SUBSAMPLE = 100, 256
NODE_SCHEMA = (
    "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
    "path array<double>"
)
EULER_GAMMA = 0.5772156649015329


def _expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _tree_samples(df: DataFrame, key: str, trees: int, size: int, seed: int) -> DataFrame:
    """Up to ``size`` rows per tree, drawn without replacement by hashed key.

    A hash threshold keeps the draw near its size inside the scan; the few rows too
    many are cut per tree afterwards.
    """
    slots = 1 << 31
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.coalesce(F.try_divide(F.lit(1.5 * size), total), F.lit(1.0)) * slots
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(
            t.cast("int").alias("tree"),
            F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(slots)).alias("slot"),
        ),
    )
    picked = (
        df.withColumn("_share", share)
        .withColumn("_d", F.explode(F.filter(drawn, lambda d: d["slot"] < F.col("_share"))))
    )
    order = Window.partitionBy("tree").orderBy("slot", key)
    return (
        picked.select(*df.columns, "_d.tree", "_d.slot")
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= size)
        .drop("_place", "slot")
    )


def grow_trees(df: DataFrame, key: str, features: Sequence[str], trees: int = FOREST_TREES,
               size: int = SUBSAMPLE, seed: int = fixed.SEED) -> DataFrame:
    """Isolation trees (Liu, Ting and Zhou, 2008), one row of node arrays per tree.

    Each tree sees at most ``size`` rows, so a group is bounded whatever the input.
    """
    names = list(features)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        random = np.random.default_rng([seed, tree])
        rows = group.sort_values(key)[names].to_numpy(dtype=float)
        depth_limit = int(np.ceil(np.log2(max(len(rows), 2))))
        feature, cut, left, right, path = [], [], [], [], []

        def node(points: np.ndarray, depth: int) -> int:
            index = len(feature)
            for column in (feature, left, right):
                column.append(-1)
            cut.append(0.0)
            path.append(depth + _expected_path(len(points)))
            low, high = points.min(axis=0), points.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth < depth_limit and len(usable):
                chosen = int(random.choice(usable))
                feature[index] = chosen
                cut[index] = float(random.uniform(low[chosen], high[chosen]))
                below = points[:, chosen] <= cut[index]
                left[index] = node(points[below], depth + 1)
                right[index] = node(points[~below], depth + 1)
            return index

        node(rows, 0)
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature], "cut": [cut], "left": [left],
             "right": [right], "path": [path]}
        )

    samples = _tree_samples(df.select(key, *names), key, trees, size, seed)
    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def isolation_scores(df: DataFrame, key: str, features: Sequence[str],
                     trees: int = FOREST_TREES, size: int = SUBSAMPLE) -> DataFrame:
    """(key, score): close to 1 for rows that are isolated early.

    The forest is at most trees * 2 * size nodes, a fixed bound, and travels to the
    tasks with the scoring function; rows stay where they are.
    """
    names = list(features)
    forest = [
        tuple(np.asarray(part) for part in (r["feature"], r["cut"], r["left"], r["right"],
                                            r["path"]))
        for r in grow_trees(df, key, names, trees, size).orderBy("tree").collect()
    ]
    sampled = min(size, df.count())
    scale = max(_expected_path(sampled), 1e-12)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[names].to_numpy(dtype=float)
            depth = np.zeros(len(rows))
            at = np.arange(len(rows))
            for feature, cut, left, right, path in forest:
                place = np.zeros(len(rows), dtype=int)
                inner = feature[place] >= 0
                while inner.any():
                    chosen = np.maximum(feature[place], 0)
                    goes_left = rows[at, chosen] <= cut[place]
                    step = np.where(goes_left, left[place], right[place])
                    place = np.where(inner, step, place)
                    inner = feature[place] >= 0
                depth += path[place]
            yield pd.DataFrame(
                {key: batch[key], "score": 2.0 ** (-(depth / max(len(forest), 1)) / scale)}
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *names).mapInPandas(score, f"{key} {kind}, score double")


def compare_anomaly_methods(metrics: DataFrame, trees: int = FOREST_TREES,
                            size: int = SUBSAMPLE) -> DataFrame:
    """Daily metrics with isolation-forest flag, any z-score flag and their overlap.

    ``size`` rows per tree are the algorithm's own definition; all days are scored.

    The share ``CONTAMINATION`` of days with the highest scores is flagged. The series
    holds one row per day, so its threshold percentile is bounded by the calendar.
    """
    names = list(fixed.ANOMALY_METRICS)
    known = cut_lineage(metrics)
    filled = known.select(
        "date", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    )
    scores = cut_lineage(isolation_scores(filled, "date", names, trees, size))
    threshold = scores.agg(F.percentile("score", F.lit(1.0 - fixed.CONTAMINATION))).scalar()
    flags = scores.select("date", (F.col("score") > threshold).alias("isolation_forest_anomaly"))
    joined = known.join(flags, "date", "left")
    return joined.withColumn("any_zscore_anomaly", any_flag(known)).withColumn(
        "anomaly_method_overlap",
        F.col("any_zscore_anomaly") & F.col("isolation_forest_anomaly"),
    )


def anomaly_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("any_zscore_anomaly").alias("zscore_anomaly_days"),
        F.count_if("isolation_forest_anomaly").alias("isolation_forest_anomaly_days"),
        F.count_if("anomaly_method_overlap").alias("overlap_days"),
    )


__all__ = [
    "anomaly_counts", "centroids", "choose_clusters", "compare_anomaly_methods",
    "error_metrics", "fit_kmeans", "forecast_rows", "grow_trees", "isolation_scores", "name_clusters", "ranked_centroids", "segment_counts", "segment_customers", "standardised",
    "train_forecast",
]
