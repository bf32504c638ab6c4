"""Series operators on series of any length: ranges of consecutive rows, with halo rows.

Rows get dense numbers in the order of the series, ``ROWS`` numbers make a range, and the last
rows of a range also stand before the next one, so a window that looks back that far never leaves
its range. What looks back without bound (the last value seen) is carried from range to range
in a table of one row a range. No task sees more than a range and its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslode.operators.numbering import dense_numbers

ROWS = 1 << 20
NUMBER = "row_number"


def numbered_series(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``row_number`` from 1 in the given order, which must tell all rows apart."""
    return dense_numbers(df, order, NUMBER)


def _range(rows: int) -> Column:
    return F.floor((F.col(NUMBER) - 1) / F.lit(rows))


def over_ranges(numbered: DataFrame, reach: int,
                windows: Callable[[DataFrame, str, Sequence[str]], DataFrame],
                rows: int = ROWS) -> DataFrame:
    """``windows(frame, order, within)`` for windows that look at most ``reach`` rows back."""
    size = max(rows, reach, 1)
    own = _range(size)
    late = (F.col(NUMBER) - 1) % size >= size - reach
    both = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    copies = numbered.withColumn("_own", own).withColumn("_range", F.explode(both))
    return (windows(copies, NUMBER, ("_range",)).where(F.col("_own") == F.col("_range"))
            .drop("_own", "_range"))


def carried_values(numbered: DataFrame, columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(_range, one column each): the last value before each range, NULL where there is none."""
    last = numbered.groupBy(_range(rows).alias("_range")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(NUMBER))).alias(c)
          for c in columns]
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("_range", *[F.last(F.col(c), ignorenulls=True).over(before).alias(c)
                                   for c in columns])


def range_growth(numbered: DataFrame, columns: Mapping[str, str], rows: int = ROWS) -> DataFrame:
    """``series.growth`` on ranges: change against the previous row, gaps filled forward."""
    carried = carried_values(numbered, sorted(set(columns.values())), rows)
    carried = carried.select("_range", *[F.col(src).alias(f"_carried_{out}")
                                         for out, src in columns.items()])
    held = numbered.withColumn("_range", _range(rows)).join(carried, "_range")
    by_number = Window.partitionBy("_range").orderBy(NUMBER)
    so_far = by_number.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({
        f"_filled_{out}": F.coalesce(F.last(F.col(src), ignorenulls=True).over(so_far),
                                     F.col(f"_carried_{out}"))
        for out, src in columns.items()
    })
    ratios = {
        out: F.try_divide(F.col(f"_filled_{out}"),
                          F.coalesce(F.lag(f"_filled_{out}").over(by_number),
                                     F.col(f"_carried_{out}"))) - 1
        for out in columns
    }
    return held.withColumns(ratios).drop(
        "_range", *[f"_{kind}_{out}" for kind in ("filled", "carried") for out in columns]
    )


def range_split(numbered: DataFrame, train_share: float) -> DataFrame:
    """``series.temporal_split`` from the numbers: no window, one count."""
    cut = F.floor(F.lit(numbered.count()) * F.lit(train_share))
    return numbered.withColumn("row_index", F.col(NUMBER) - 1).withColumn(
        "is_train", F.col("row_index") < cut
    )
