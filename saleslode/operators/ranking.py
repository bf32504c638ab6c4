"""Exact order statistics without gathering the data in one place.

``percentile`` and ``ntile`` keep every distinct value, or every row, in a single
task. Here the wanted ranks are narrowed down level by level instead:

1. count rows per cell of the first level (a bounded number of cells),
2. keep only the cells that hold a wanted rank, and count inside them by the next level,
3. repeat until the last level, which is the exact key.

Quantiles of doubles are narrowed by the four 16-bit digits of an order-preserving key
(``operators.radix``): no level has more than 65,536 cells a group, however the values lie.
The source is read twice: once for counts by the first two digits, once for the values
under the few prefixes that hold a wanted rank; both are stored, and all narrowing reads
those. Equal values collapse into one counted
row, so a value shared by most rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslode.operators import radix
from saleslode.session import cut_lineage


@dataclass(frozen=True)
class Fraction:
    """A quantile as an exact ratio, so that rank positions are integer arithmetic."""

    part: int
    whole: int


QUINTILES = tuple(Fraction(i, 5) for i in range(1, 5))
QUARTILES = (Fraction(1, 4), Fraction(3, 4))


def whole_part(number: Column, divisor: int) -> Column:
    """Integer division, exact for every bigint."""
    return F.call_function("div", number, F.lit(divisor))


def locate_ranks(df: DataFrame, levels: Sequence[str], ranks: Column,
                 by: Sequence[str] = ()) -> DataFrame:
    """Find the rows' key at given 0-based ranks.

    ``levels`` are columns from coarse to exact, ordering the rows lexicographically.
    ``ranks`` is an array<bigint> expression over ``total``, the rows in the group.
    Returns (by..., total, rank, levels...), one row per distinct wanted rank.
    """
    rows = df.withColumn("_n", F.lit(1).cast("bigint"))
    found = _narrowed(rows, levels, list(by), _first_hits(rows, levels[0], ranks, list(by)),
                      not by)
    return _wanted_rows(found, [*by, "total"], levels)


def _wanted_rows(found: DataFrame, kept: Sequence[str], levels: Sequence[str]) -> DataFrame:
    return found.select(*kept, F.explode("_wanted").alias("_w"), *levels).select(
        *kept, F.col("_w.rank").alias("rank"), *levels)


def _first_hits(df: DataFrame, level: str, ranks: Column, by: list[str]) -> DataFrame:
    cells = df.groupBy(*by, level).agg(F.sum("_n").alias("_n"))
    return _hits(cells, by, level, ranks)


def _narrowed(df: DataFrame, levels: Sequence[str], by: list[str], found: DataFrame,
              bounded: bool) -> DataFrame:
    """Hits of the last level, from those of the first; ``df`` has rows counted ``_n``.

    Without groups, or with a fixed list of them (``bounded``), the hit cells are broadcast:
    one per wanted rank and group. Groups that grow with the data take an ordinary
    equi-join, which the runtime may split where a group is large.
    """
    for depth in range(1, len(levels)):
        known = [*by, *levels[:depth]]
        hit = F.broadcast(found) if bounded else found
        inside = df.join(hit, known).groupBy(*known, levels[depth]).agg(
            F.sum("_n").alias("_n"),
            F.first("_wanted").alias("_wanted"),
            F.first("total").alias("total"),
        )
        found = _hits(inside, known, levels[depth], None)
    return found


def _hits(cells: DataFrame, within: list[str], level: str, ranks: Column | None) -> DataFrame:
    """Keep the cells holding a wanted rank, with the rank counted from the cell's start."""
    group = Window.partitionBy(*within)
    earlier = group.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    if ranks is not None:
        cells = cells.withColumn("total", F.sum("_n").over(group)).withColumn(
            "_wanted",
            F.transform(
                F.array_distinct(ranks),
                lambda r: F.struct(r.alias("rank"), r.alias("rest")),
            ),
        )
    counted = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    here = F.filter(
        F.col("_wanted"),
        lambda w: (w["rest"] >= F.col("_before")) & (w["rest"] < F.col("_before") + F.col("_n")),
    )
    moved = F.transform(
        here,
        lambda w: F.struct(
            w["rank"].alias("rank"), (w["rest"] - F.col("_before")).alias("rest")
        ),
    )
    return (
        counted.withColumn("_wanted", moved)
        .where(F.size("_wanted") > 0)
        .select(*within, level, "total", "_wanted")
    )


def prefix_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., _prefix, _n): rows by the first two digits of their value's key.

    Rows without a value are counted under a NULL prefix.
    """
    return with_prefix(df.select(*by, value), value).groupBy(*by, "_prefix").agg(
        F.count(F.lit(1)).alias("_n"))


def with_prefix(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_prefix``, the first two digits of the value's key."""
    return radix.with_radix_key(df, value, "_key").withColumn(
        "_prefix", radix.prefix(F.col("_key"))).drop("_key")


def quantile_prefixes(counts: DataFrame, fractions: Sequence[Fraction], by: Sequence[str],
                      bounded: bool) -> DataFrame:
    """(by..., _prefix, total, _wanted): the prefixes that hold a rank next to a quantile."""
    by = list(by)
    last = F.col("total") - 1
    lows = [whole_part(last * f.part, f.whole) for f in fractions]
    ranks = F.array(*[r for p in lows for r in (p, F.least(p + 1, last))])
    cells = counts.where(F.col("_prefix").isNotNull()).select(
        *by, radix.leading_digit(F.col("_prefix"), 2).alias("_digit1"), "_prefix", "_n")
    found = _narrowed(cells, ["_digit1", "_prefix"], by,
                      _first_hits(cells, "_digit1", ranks, by), bounded)
    return found.select(*by, "_prefix", "total", "_wanted")


def quantiles_inside(inside: DataFrame, hits: DataFrame, fractions: Sequence[Fraction],
                     by: Sequence[str], out: str, bounded: bool) -> DataFrame:
    """Quantiles from counted values (by..., _prefix, _exact, _n) under the hit prefixes."""
    by = list(by)
    cells = radix.with_radix_key(inside, "_exact", "_key").withColumn(
        "_digit3", radix.digit(F.col("_key"), 1)).drop("_key")
    found = _narrowed(cells, ["_prefix", "_digit3", "_exact"], by, hits, bounded)
    looked_up = _wanted_rows(found, [*by, "total"], ["_exact"]).groupBy(*by).agg(
        F.first("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", "_exact"))).alias("_at"),
    )
    last = F.col("total") - 1
    quantiles = []
    for f in fractions:
        position = whole_part(last * f.part, f.whole)
        below = F.col("_at")[position]
        above = F.col("_at")[F.least(position + 1, last)]
        share = F.pmod(last * f.part, F.lit(f.whole)) / F.lit(float(f.whole))
        quantiles.append(below + (above - below) * share)
    return looked_up.select(*by, "total", F.array(*quantiles).alias(out))


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[Fraction],
                    by: Sequence[str] = (), out: str = "quantiles",
                    few_groups: bool = False) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values of a double column.

    Returns (by..., total, out array<double>), one row per group that has values.
    """
    by = list(by)
    bounded = few_groups or not by
    counts = cut_lineage(prefix_counts(df, value, by))
    hits = cut_lineage(quantile_prefixes(counts, fractions, by, bounded))
    wanted = hits.select(*by, "_prefix")
    keyed = with_prefix(df.where(F.col(value).isNotNull())
                        .select(*by, F.col(value).alias("_exact")), "_exact")
    inside = cut_lineage(
        keyed.join(F.broadcast(wanted) if bounded else wanted, [*by, "_prefix"])
        .groupBy(*by, "_prefix", "_exact").agg(F.count(F.lit(1)).alias("_n")))
    return quantiles_inside(inside, hits, fractions, by, out, bounded)


def bin_by_edges(value: Column, edges: Sequence[Column]) -> Column:
    """1-based bin of right-closed intervals; NULL stays NULL."""
    score = F.lit(1)
    for edge in edges:
        score = score + F.when(value > edge, F.lit(1)).otherwise(F.lit(0))
    return F.when(value.isNotNull(), score).cast("bigint")


def rank_bin_edges(df: DataFrame, levels: Sequence[str], bins: int) -> DataFrame:
    """Keys closing each bin when rows are ranked first-come and cut into equal bins.

    One row, one column ``edges``: array of key structs in bin order. Row r of n
    (0-based) falls in bin s when r <= floor(s * (n - 1) / bins).
    """
    last = F.col("total") - 1
    closing = [whole_part(last * s, bins) for s in range(1, bins)]
    located = locate_ranks(df, levels, F.array(*closing))
    at = F.map_from_entries(F.collect_list(F.struct(F.col("rank"), F.struct(*levels))))
    return located.agg(F.first("total").alias("total"), at.alias("_at")).select(
        F.array(*[F.col("_at")[c] for c in closing]).alias("edges")
    )
