"""Cores drawn in several parts: merge the parts, keep the single cores, put both together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, first_of, sum_or_zero
from firnline.functions.snow import PI, TUBE_RADIUS_CM, density_columns
from firnline.operators.skew import HOT_ROWS, join_keys, split_hot

MEASURES = ("depth", "core", "plug", "mass")


def resolve_multipart(
    df: DataFrame,
    keys: Sequence[str],
    meta_cols: Sequence[str],
    convention: str,
    flag: str = "multi_core",
    metadata: str = "distinct",
    order_by: Sequence[ColumnOrName] = (),
    include_unflagged: bool = True,
    radius: float = TUBE_RADIUS_CM,
    pi: float = PI,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Replace the parts of a core (flag `yes`) by the merged core; other flags than yes, no and
    missing are dropped.

    `metadata="distinct"` gives one row per distinct metadata row of the parts, so parts that
    differ in, say, their time repeat the merged core; `"first"` gives one row per core.
    `meta_cols` must include the keys and the flag. `include_unflagged=False` drops rows
    without a flag.
    """
    lone = F.col(flag) == "no"
    if include_unflagged:
        lone = lone | F.col(flag).isNull()
    single = df.where(lone).select(*meta_cols, *MEASURES)
    merged = merge_parts(
        df.where(F.col(flag) == "yes"), keys, meta_cols, metadata, order_by, hot_rows
    )
    both = single.unionByName(merged)
    return both.withColumns(density_columns("depth", "plug", "mass", convention, radius, pi))


def merge_parts(
    parts: DataFrame,
    keys: Sequence[str],
    meta_cols: Sequence[str],
    metadata: str = "distinct",
    order_by: Sequence[ColumnOrName] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Greatest depth and summed core, plug and mass per core, with the metadata put back."""
    total = [
        F.max("depth").alias("depth"),
        *[sum_or_zero(c).alias(c) for c in MEASURES[1:]],
    ]
    extra = [c for c in meta_cols if c not in keys]
    if metadata == "first":
        if not order_by:
            raise ValueError("metadata='first' needs an order")
        merged = parts.groupBy(*keys).agg(first_of(extra, order_by).alias("_first"), *total)
        return merged.withColumns({c: F.col(f"_first.{c}") for c in extra}).select(
            *meta_cols, *MEASURES
        )
    if metadata != "distinct":
        raise ValueError(f"metadata must be 'distinct' or 'first', got {metadata!r}")
    split = split_hot(parts, keys, hot_rows)
    # One shuffle on the core's keys serves the distinct rows and the totals over them.
    whole = Window.partitionBy(*keys)
    cold = (
        split.cold.repartition(*keys)
        .groupBy(*meta_cols)
        .agg(*total)
        .withColumns(
            {
                "depth": F.max("depth").over(whole),
                **{c: F.sum(c).over(whole) for c in MEASURES[1:]},
            }
        )
        .select(*meta_cols, *MEASURES)
    )
    if split.hot is None:
        return cold
    # A hot core's totals are one row, so they travel to the distinct rows, not the reverse.
    totals = split.hot.groupBy(*keys).agg(*total)
    hot = join_keys(split.hot.select(*meta_cols).distinct(), totals, keys, "left")
    return cold.unionByName(hot.select(*meta_cols, *MEASURES))
