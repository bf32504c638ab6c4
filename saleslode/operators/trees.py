"""Regression trees with exact split search, and bagged forests of them.

A split is searched among all midpoints between neighbouring distinct values of every feature.
Columns are sorted once a tree; each level keeps that order within its nodes, and running
sums of weights and weighted targets give the gain of every boundary of every node at once.
The best boundary of a node is that of largest gain; among equals the first feature and lowest
value. A node rests when its targets agree, it has one row, or no boundary gains.

A forest deals every tree's rows to a task of its own: the trees' bootstrap samples are
weights drawn from (seed, tree), and the rows to be predicted pass through the tree where
it grows, so no forest is gathered. A group is one copy of the rows: for the series of
days this library forecasts, the calendar bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gains this close, in proportion, are equal: sums of other order round differently.
TIE = 1e-9


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            here = at[inner]
            low = rows[inner, self.feature[here]] <= self.cut[here]
            at[inner] = np.where(low, self.left[here], self.right[here])


def _level_splits(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, node: np.ndarray,
                  orders: list[np.ndarray], count: int) -> tuple[np.ndarray, ...]:
    """Gain, feature and cut of the best boundary of each of ``count`` open nodes."""
    gain = np.zeros(count)
    feature = np.full(count, -1)
    cut = np.zeros(count)
    for number, order in enumerate(orders):
        order = order[node[order] >= 0]
        order = order[np.argsort(node[order], kind="stable")]
        group, value = node[order], rows[order, number]
        w, wy = np.cumsum(weight[order]), np.cumsum(weight[order] * target[order])
        first = np.searchsorted(group, np.arange(count))
        last = np.searchsorted(group, np.arange(count), "right") - 1
        w0 = np.where(first > 0, w[first - 1], 0.0)
        wy0 = np.where(first > 0, wy[first - 1], 0.0)
        at = np.flatnonzero((group[:-1] == group[1:]) & (value[:-1] < value[1:]))
        if not len(at):
            continue
        owner = group[at]
        left_w, left_y = w[at] - w0[owner], wy[at] - wy0[owner]
        all_w, all_y = (w[last] - w0)[owner], (wy[last] - wy0)[owner]
        right_w, right_y = all_w - left_w, all_y - left_y
        better = left_y ** 2 / left_w + right_y ** 2 / right_w - all_y ** 2 / all_w
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        top = np.maximum.reduceat(better, starts)
        # the lowest boundary among those of the largest gain
        reach = np.repeat(top - TIE * np.abs(top), np.diff(starts, append=len(owner)))
        hit = np.flatnonzero(better >= reach)
        hit = hit[np.unique(owner[hit], return_index=True)[1]]
        nodes = owner[hit]
        wins = top > gain[nodes] * (1 + TIE)
        nodes, hit = nodes[wins], hit[wins]
        gain[nodes], feature[nodes] = better[hit], number
        cut[nodes] = (value[at[hit]] + value[at[hit] + 1]) / 2
    return gain, feature, cut


def grow(rows: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None,
         depth: int | None = None) -> Tree:
    """A tree over rows (n, features); rows of weight 0 are not seen."""
    weight = np.ones(len(rows)) if weight is None else weight.astype(float)
    target = target.astype(float)
    shift = float(np.average(target, weights=weight))
    centred = target - shift
    orders = [np.argsort(rows[:, f], kind="stable") for f in range(rows.shape[1])]
    node = np.where(weight > 0, 0, -1)
    place = node.copy()
    parts: dict[str, list] = {n: [] for n in ("feature", "cut", "left", "right", "value")}
    count, made, level = 1, 1, 0
    while count:
        seen = node >= 0
        w = np.bincount(node[seen], weight[seen], count)
        mean = np.bincount(node[seen], (weight * target)[seen], count) / w
        low, high = np.full(count, np.inf), np.full(count, -np.inf)
        np.minimum.at(low, node[seen], target[seen])
        np.maximum.at(high, node[seen], target[seen])
        gain, feature, cut = _level_splits(rows, centred, weight, node, orders, count)
        opened = (low < high) & (feature >= 0)
        if depth is not None and level >= depth:
            opened[:] = False
        feature = np.where(opened, feature, -1)
        child = made + 2 * (np.cumsum(opened) - 1)
        for name, values in (("feature", feature), ("cut", cut), ("value", mean),
                             ("left", np.where(opened, child, -1)),
                             ("right", np.where(opened, child + 1, -1))):
            parts[name].append(values)
        made += 2 * int(opened.sum())
        kept = seen & opened[np.maximum(node, 0)]
        here = node[kept]
        goes_right = rows[kept, feature[here]] > cut[here]
        node = np.full(len(rows), -1)
        node[kept] = 2 * (np.cumsum(opened) - 1)[here] + goes_right
        place[kept] = child[here] + goes_right
        count, level = 2 * int(opened.sum()), level + 1
    return Tree(*[np.concatenate(parts[n]) for n in ("feature", "cut", "left", "right", "value")])


def bootstrap_weights(count: int, seed: int, tree: int) -> np.ndarray:
    """How often each of ``count`` rows is drawn, with replacement, by one tree."""
    random = np.random.default_rng([seed, tree])
    return np.bincount(random.integers(0, count, count), minlength=count)


def forest_predictions(df: DataFrame, key: str, features: Sequence[str], target: str,
                       is_train: str, trees: int, depth: int | None, seed: int) -> DataFrame:
    """(key, predicted): mean of all trees for the rows that are not for training.

    Features and target must be known. Without training rows nothing is predicted.
    """
    names = list(features)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        train = group[group[is_train]]
        test = group[~group[is_train]]
        if train.empty:
            return pd.DataFrame({key: [], "value": []})
        weight = bootstrap_weights(len(train), seed, int(group["tree"].iloc[0]))
        tree = grow(train[names].to_numpy(float), train[target].to_numpy(float), weight, depth)
        return pd.DataFrame({key: test[key], "value": tree.predict(test[names].to_numpy(float))})

    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, target, is_train, *[F.col(n).cast("double").alias(n) for n in names],
                      F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    values = dealt.groupBy("tree").applyInPandas(one, f"{key} {kind}, value double")
    return values.groupBy(key).agg(F.avg("value").alias("predicted"))
