"""Many k-means models from the same scans.

Models differ in the number of clusters and the seed. Every pass over the points serves all of
them: a task adds up, per model and cluster, rows, coordinates and squared distances, and the
sums of all tasks merge into the next centres. So a fit costs as many scans as its slowest
model takes iterations, however many models there are. Centres are a few numbers per
model; only they and the merged sums are on the driver.

Starts are drawn as in scalable k-means++ (Bahmani et al., 2012): rounds of rows drawn with
chances in proportion to their squared distance from what is drawn already, then a weighted
choice among the drawn. A round takes the rows of the smallest -ln(u) / distance, an exact
weighted draw (Efraimidis and Spirakis, 2006) whose best of each task merge without
knowing the total. The number u hashes the row's key and the seed, so draws depend on neither
partitions nor order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ITERATIONS, TOLERANCE = 20, 1e-4
ROUNDS = 2
_U = np.uint64


@dataclass
class Model:
    """Centres of one start; counts, sums and square sums of the rows nearest to each."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    silhouette: float | None = None


@dataclass
class Fitted:
    models: list[Model]
    scans: int

    def best(self, k: int) -> Model:
        """The model of lowest cost with k clusters; the lowest seed among equals."""
        return min((m for m in self.models if m.k == k), key=lambda m: (m.cost, m.seed))


def uniform(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys, a seed and a turn."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(_U) + _U((seed * 1_000_003 + turn) & (1 << 63) - 1) * _U(
            0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        x = x ^ (x >> _U(31))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 4096):
    """(keys, points) of up to ``rows`` rows; the first column is the key."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for at in range(0, batch.num_rows, rows):
            yield columns[0][at:at + rows], np.column_stack(
                [c[at:at + rows].astype(float) for c in columns[1:]])


def _scan(points: DataFrame, task: Callable[[Iterator], list[tuple]], schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(fields)
        rows = task(_blocks(batches))
        if rows:
            yield pa.record_batch([pa.array([r[i] for r in rows], f.type)
                                   for i, f in enumerate(target)], schema=target)

    return points.mapInArrow(run, fields)


def draw(points: DataFrame, drawn: list[np.ndarray], seeds: Sequence[int], sizes: Sequence[int],
         turn: int) -> list[np.ndarray]:
    """Rows added to each model: ``sizes`` of them, by their distance from the drawn ones."""
    def task(blocks):
        best: list[list[tuple]] = [[] for _ in seeds]
        for keys, rows in blocks:
            for m, seed in enumerate(seeds):
                weight = (squared_distances(rows, drawn[m]).min(axis=1) if len(drawn[m])
                          else np.ones(len(rows)))
                held = np.flatnonzero(weight > 0)
                race = -np.log(uniform(keys[held], seed, turn)) / weight[held]
                for i in np.argsort(race, kind="stable")[:sizes[m]].tolist():
                    best[m].append((float(race[i]), rows[held[i]].tolist()))
                best[m] = sorted(best[m])[:sizes[m]]
        return [(m, race, row) for m, b in enumerate(best) for race, row in b]

    found = _scan(points, task, "model int, race double, row array<double>").groupBy("model").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("race", "row"))), 1, max(sizes)).alias("rows"))
    more = {r["model"]: [x["row"] for x in r["rows"]][:sizes[r["model"]]] for r in found.collect()}
    width = len(points.columns) - 1
    return [np.unique(np.concatenate([d.reshape(-1, width),
                                      np.array(more.get(m, []), float).reshape(-1, width)]), axis=0)
            for m, d in enumerate(drawn)]


def gather(points: DataFrame, centres: list[np.ndarray]) -> list[tuple]:
    """Per model: counts, sums, square sums and cost of the rows nearest to each centre."""
    width = len(points.columns) - 1

    def task(blocks):
        totals = [np.zeros((len(c), width + 3)) for c in centres]
        for _, rows in blocks:
            square = (rows ** 2).sum(axis=1)
            for total, c in zip(totals, centres, strict=True):
                distance = squared_distances(rows, c)
                near = distance.argmin(axis=1)
                parts = [np.ones(len(rows)), *rows.T, square, distance[np.arange(len(rows)), near]]
                for at, part in enumerate(parts):
                    total[:, at] += np.bincount(near, part, len(c))
        return [(m, n, row.tolist()) for m, total in enumerate(totals)
                for n, row in enumerate(total) if row[0]]

    merged = (_scan(points, task, "model int, cluster int, part array<double>")
              .groupBy("model", "cluster")
              .agg(*[F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width + 3)]).collect())
    totals = [np.zeros((len(c), width + 3)) for c in centres]
    for row in merged:
        totals[row["model"]][row["cluster"]] = [row[f"s{i}"] for i in range(width + 3)]
    return [(t[:, 0], t[:, 1:width + 1], t[:, width + 1], float(t[:, width + 2].sum()))
            for t in totals]


def weighted_start(rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among weighted rows; fewer centres where fewer rows differ."""
    random = np.random.default_rng(seed)
    chosen: list[int] = []
    distance = np.ones(len(rows))
    while len(chosen) < k:
        chance = weights * distance
        if not chance.sum() > 0:
            break
        chosen.append(int(random.choice(len(rows), p=chance / chance.sum())))
        distance = squared_distances(rows, rows[chosen]).min(axis=1)
    return rows[chosen]


def fit_many(points: DataFrame, starts: Sequence[tuple[int, int]], iterations: int = ITERATIONS,
             tolerance: float = TOLERANCE) -> Fitted:
    """Models of all (k, seed) ``starts``; ``points`` has a 64-bit key, then coordinates.

    A model rests once no centre moves further than ``tolerance``. An empty table gives
    models without centres.
    """
    width = len(points.columns) - 1
    seeds, sizes = [s for _, s in starts], [2 * k for k, _ in starts]
    drawn = [np.zeros((0, width))] * len(starts)
    drawn = draw(points, drawn, seeds, [1] * len(starts), 0)
    if not len(drawn[0]):
        return Fitted([Model(k, s, np.zeros((0, width)), 0.0) for k, s in starts], 1)
    for turn in range(1, ROUNDS + 1):
        drawn = draw(points, drawn, seeds, sizes, turn)
    models = [Model(k, s, weighted_start(rows, found[0], k, s)) for (k, s), rows, found in
              zip(starts, drawn, gather(points, drawn), strict=True)]
    scans = ROUNDS + 2
    moving = list(models)
    for turn in range(iterations + 1):
        found = gather(points, [m.centres for m in moving])
        scans += 1
        still = []
        for model, (counts, sums, squares, cost) in zip(moving, found, strict=True):
            model.counts, model.sums, model.squares, model.cost = counts, sums, squares, cost
            held = counts > 0
            fresh = model.centres.copy()
            fresh[held] = sums[held] / counts[held][:, None]
            step = np.sqrt(((fresh - model.centres) ** 2).sum(axis=1)).max()
            if step > tolerance and turn < iterations:
                model.centres = fresh
                still.append(model)
        moving = still
        if not moving:
            break
    return Fitted(models, scans)


def score_silhouettes(points: DataFrame, models: Sequence[Model]) -> None:
    """Sets the mean silhouette of all rows, by squared distance, from one scan.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum and
    square sum. A row alone in its cluster has 0; fewer than two clusters have no score.
    """
    scored = [m for m in models if (m.counts > 0).sum() > 1]
    for model in models:
        model.silhouette = None
    if not scored:
        return

    def task(blocks):
        totals = np.zeros((len(scored), 2))
        for _, rows in blocks:
            square = (rows ** 2).sum(axis=1)[:, None]
            at = np.arange(len(rows))
            for m, model in enumerate(scored):
                near = squared_distances(rows, model.centres).argmin(axis=1)
                n = np.maximum(model.counts, 1)
                far = square - 2 * rows @ (model.sums / n[:, None]).T + model.squares / n
                far = np.where(model.counts > 0, far, np.inf)
                size = model.counts[near]
                own = far[at, near] * size / np.maximum(size - 1, 1)
                far[at, near] = np.inf
                other = far.min(axis=1)
                top = np.maximum(own, other)
                value = np.where((size > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1),
                                 0.0)
                totals[m] += value.sum(), len(rows)
        return [(m, *row) for m, row in enumerate(totals.tolist())]

    merged = _scan(points, task, "model int, total double, rows double").groupBy("model").agg(
        F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
    for row in merged:
        scored[row["model"]].silhouette = row["total"] / row["rows"]


def nearest(model: Model, columns: Sequence[str]) -> Column:
    """Number of the centre nearest to a row's columns, the lowest among equals."""
    ranked = [F.struct(sum(((F.col(c) - float(x)) * (F.col(c) - float(x))
                            for c, x in zip(columns, centre, strict=True)), F.lit(0.0)).alias("d"),
                       F.lit(number).alias("cluster"))
              for number, centre in enumerate(model.centres)]
    return F.array_min(F.array(*ranked))["cluster"]
