"""Totals by day and flight, and completeness counts. All merge from partial sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, order_key, strict
from firnline.functions.parse import day_of


def daily_totals(
    df: DataFrame,
    time: ColumnOrName,
    value: ColumnOrName,
    name: str,
    where: Column | None = None,
    day_key: str | tuple[int, int] = "day",
    divisor: float = 100.0,
) -> DataFrame:
    """Strict sum per day over `divisor` (cm to m). `day_key` is "day" or a slice of the time text."""
    rows = df if where is None else df.where(where)
    total = (strict(F.sum, value) / F.lit(divisor)).alias(name)
    return rows.groupBy(day_of(time, day_key).alias("day")).agg(total)


def period_totals(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    time: str,
    order_by: Sequence[ColumnOrName],
    strict_sums: Mapping[str, str],
    skip_sums: Mapping[str, str],
) -> DataFrame:
    """First time and totals for several grouping sets at once, `level` numbering the set.

    The table is read and shuffled once, by all the columns together; the coarser sets are
    merged from those few rows.
    """
    cols = list(dict.fromkeys(c for s in sets for c in s))
    fine = df.groupBy(*cols).agg(
        F.min(F.struct(order_key(order_by).alias("key"), F.col(time).alias("time"))).alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(n) for n, v in {**strict_sums, **skip_sums}.items()],
        *[F.count(v).alias(f"_n_{n}") for n, v in strict_sums.items()],
    )
    merged = [
        F.min("_first").getField("time").alias("date"),
        *[
            F.when(F.sum(f"_n_{n}") == F.sum("_rows"), F.sum(n)).alias(n) for n in strict_sums
        ],
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in skip_sums],
    ]
    # grouping_id() sets one bit per column left out, the first column highest.
    width = len(cols)
    code = {
        sum(1 << (width - 1 - i) for i, c in enumerate(cols) if c not in s): level
        for level, s in enumerate(sets)
    }
    level = F.lit(None).cast("int")
    for bits, number in code.items():
        level = F.when(F.col("_set") == bits, F.lit(number)).otherwise(level)
    return (
        fine.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
        .agg(F.grouping_id().alias("_set"), *merged)
        .withColumn("level", level)
        .select("level", *cols, "date", *strict_sums, *skip_sums)
    )


def grand_total(df: DataFrame, value: ColumnOrName, name: str, divisor: float = 100_000.0) -> DataFrame:
    """Strict sum of everything over `divisor` (cm to km)."""
    return df.agg((strict(F.sum, value) / F.lit(divisor)).alias(name))


def key_count(df: DataFrame, key: str, name: str = "keys") -> DataFrame:
    """Number of distinct keys, a missing key counted as one more."""
    missing = F.max(F.when(F.col(key).isNull(), 1).otherwise(0))
    distinct = df.select(key).distinct()
    return distinct.agg((F.count(key) + F.coalesce(missing, F.lit(0))).alias(name))


def rows_per_key(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def check_counts(
    df: DataFrame,
    key: str,
    expected_keys: int | None = None,
    expected_rows: int | None = None,
) -> DataFrame:
    """One row: distinct keys, keys with another row count than expected, and whether all is well."""
    per_key = rows_per_key(df, [key], "_rows")
    odd = F.lit(False) if expected_rows is None else F.col("_rows") != expected_rows
    counted = per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(odd).alias("odd_keys")
    )
    right = F.lit(True) if expected_keys is None else F.col("keys") == expected_keys
    return counted.withColumn("ok", right & (F.col("odd_keys") == 0))

