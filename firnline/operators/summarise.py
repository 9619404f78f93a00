"""Statistics per plot: one scan and one shuffle, with a second plan for oversized groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, first_of, skip, strict
from firnline.operators.skew import MEDIAN_ROWS, exact_median, join_keys, split_hot


def summarise_plots(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order_by: Sequence[ColumnOrName],
    first_cols: Sequence[str] = (),
    mean_cols: Sequence[str] = (),
    hot_rows: int | None = MEDIAN_ROWS,
) -> DataFrame:
    """Mean, median, max, min, sd of `value` (NULL if any value is missing), means of `mean_cols`
    over the values present, first row's `first_cols`, and the row count.

    Everything but the median merges from fixed-size partial results. The median of a group up
    to `hot_rows` rows is taken in the same aggregation, a larger one over sorted blocks.
    """
    split = split_hot(df, keys, hot_rows)
    med = f"med_{value}"
    out = [
        *keys,
        *first_cols,
        f"mean_{value}",
        med,
        f"max_{value}",
        f"min_{value}",
        f"sd_{value}",
        *mean_cols,
        "count",
    ]

    def merged(part: DataFrame, *median: Column) -> DataFrame:
        first = [first_of(first_cols, order_by).alias("_first")] if first_cols else []
        stats = part.groupBy(*keys).agg(
            *first,
            strict(F.avg, value).alias(f"mean_{value}"),
            *median,
            strict(F.max, value).alias(f"max_{value}"),
            strict(F.min, value).alias(f"min_{value}"),
            strict(F.stddev_samp, value).alias(f"sd_{value}"),
            *[skip(F.avg, c).alias(c) for c in mean_cols],
            F.count(F.lit(1)).alias("count"),
        )
        return stats.withColumns({c: F.col(f"_first.{c}") for c in first_cols}).drop("_first")

    summary = merged(split.gathered(keys), strict(F.median, value).alias(med)).select(*out)
    if split.hot is None:
        return summary
    medians = exact_median(split, keys, value, med)
    complete = F.col(f"mean_{value}").isNotNull()
    hot = join_keys(merged(split.hot), medians, keys, "left").withColumn(
        med, F.when(complete, F.col(med))
    )
    return summary.unionByName(hot.select(*out))


def average_repeats(
    df: DataFrame,
    keys: Sequence[str],
    mean_cols: Sequence[str],
    order_by: Sequence[ColumnOrName],
    first_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per sampling point: strict means over repeated cores, and how many there were."""
    first = [first_of(first_cols, order_by).alias("_first")] if first_cols else []
    averaged = df.groupBy(*keys).agg(
        *first,
        *[strict(F.avg, c).alias(c) for c in mean_cols],
        F.count(F.lit(1)).alias("count"),
    )
    return averaged.select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in first_cols], *mean_cols, "count"
    )
