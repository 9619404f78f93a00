"""Groups too big for one task.

A window or an exact median needs a whole group in one task. That is fine for a plot with a
few dozen observations and fatal for a key that holds a third of the table. Operators that
need it call `split_hot`: groups up to a row limit take the direct plan, larger ones take a
plan over `block_sort`, which spreads one group over many sorted blocks and combines the
blocks through a table with about one row per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName
from firnline.staging import stage

# Rows of one group that one task may sort; a window spills.
HOT_ROWS = 1_000_000
# The same for a median, which keeps the values of up to 128 groups in memory at a time.
MEDIAN_ROWS = 50_000
# Mean rows per group below which partial aggregation before the shuffle does not pay.
SMALL_GROUP = 256

BLOCK, POS = "_block", "_pos"
_ROW_BITS = 33  # monotonically_increasing_id: partition in the high bits, row in the low 33


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """All pairs equal, NULL equal to NULL."""
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & a.eqNullSafe(b)
    return condition


def join_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str
) -> DataFrame:
    """Null-safe equi-join on shared names; the keys of `left` are kept."""
    hidden = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(hidden)
    condition = null_safe([F.col(_tick(k)) for k in keys], [F.col(h) for h in hidden.values()])
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*hidden.values())


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Blocks:
    """A sorted copy in blocks; `pieces` bounds the number of (block, group) pairs."""

    df: DataFrame
    pieces: int


def block_sort(
    df: DataFrame, order: Sequence[ColumnOrName], rows: int = 0, groups: int = 1, per_block: int = 0
) -> Blocks:
    """Globally sorted copy with `_block` and `_pos`, the place of a row inside its block.

    Range partitioning samples the order columns, so a big group is cut wherever `order`
    differs; `order` should be total. The copy is written once: every later use must see the
    same blocks, also after an executor is lost. Without `rows` they are counted, and blocks hold
    at most about `HOT_ROWS` each.
    """
    if rows:
        count = max(1, math.ceil(rows / per_block))
        ranged = df.repartitionByRange(count, *order)
    else:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        count = max(least, math.ceil(df.count() / HOT_ROWS))
        ranged = df.repartitionByRange(count, *order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = ranged.sortWithinPartitions(*order).withColumns(
        {BLOCK: F.spark_partition_id(), POS: row}
    )
    return Blocks(stage(numbered), count + groups)


def block_totals(blocks: Blocks, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Per (block, group): weight before it in the group (`_before`), in the group (`_total`), its first `_pos`.

    Has at most `blocks.pieces` rows, and at most one per block in each window group below.
    """
    weight = F.lit(1) if weight is None else weight
    parts = blocks.df.groupBy(BLOCK, *keys).agg(
        F.sum(weight).alias("_weight"), F.min(POS).alias("_from")
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns(
        {
            "_before": F.coalesce(F.sum("_weight").over(earlier), F.lit(0)),
            "_total": F.sum("_weight").over(whole),
        }
    )


def join_pieces(
    blocks: Blocks, pieces: DataFrame, keys: Sequence[str], how: str, rows: DataFrame | None = None
) -> DataFrame:
    """Join a (block, group) table back to the rows of the blocks."""
    rows = blocks.df if rows is None else rows
    return join_keys(rows, pieces, [BLOCK, *keys], how)


@dataclass
class Split:
    """`cold` has only groups within the limit; `hot` is None when there are no others."""

    cold: DataFrame
    hot: DataFrame | None = None
    hot_groups: int = 0
    hot_rows: int = 0
    limit: int = HOT_ROWS
    mean_rows: float = math.inf

    def gathered(self, keys: Sequence[str]) -> DataFrame:
        """The cold rows, shuffled by group first where groups are too small for partial results
        to shrink anything: the aggregation that follows then needs no second shuffle."""
        return self.cold.repartition(*keys) if self.mean_rows < SMALL_GROUP else self.cold

    def blocks(self, df: DataFrame, order: Sequence[ColumnOrName]) -> Blocks:
        """Sorted blocks of (something no longer than) the hot rows, `limit` rows each."""
        return block_sort(df, order, self.hot_rows, self.hot_groups, self.limit)


def split_hot(df: DataFrame, keys: Sequence[str], limit: int | None) -> Split:
    """Separate the groups with more than `limit` rows. One count over the key columns only.

    There are at most rows/limit such groups, so their key list is small; its size is counted
    before it is broadcast. `limit=None` skips the count and declares every group small.
    """
    if limit is None:
        return Split(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    big = F.col("_rows") > limit
    all_groups, all_rows, groups, rows = sizes.agg(
        F.count(F.lit(1)), F.sum("_rows"), F.count_if(big), F.sum(F.when(big, F.col("_rows")))
    ).first()
    mean = (all_rows or 0) / max(1, all_groups)
    if groups == 0:
        return Split(df, mean_rows=mean)
    hot_keys = stage(sizes.where(F.col("_rows") > limit).select(*keys))
    return Split(
        cold=join_keys(df, hot_keys, keys, "left_anti"),
        hot=join_keys(df, hot_keys, keys, "left_semi"),
        hot_groups=groups,
        hot_rows=rows,
        limit=limit,
        mean_rows=mean,
    )


def exact_median(split: Split, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median of the hot groups without holding a group in one task.

    Equal values are counted first, so a value that fills a group is one row. The counted
    values are sorted into blocks, the block totals say which block holds the middle ranks,
    and only those blocks are searched.
    """
    counted = (
        split.hot.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    blocks = split.blocks(counted, [*keys, value])
    middle = (
        block_totals(blocks, keys, F.col("_n"))
        .withColumns(
            {
                "_low": F.floor((F.col("_total") - 1) / 2),
                "_high": F.floor(F.col("_total") / 2),
            }
        )
        .where(
            (F.col("_before") <= F.col("_high"))
            & (F.col("_before") + F.col("_weight") > F.col("_low"))
        )
        .drop("_weight", "_from", "_total")
    )
    place = Window.partitionBy(BLOCK, *keys).orderBy(POS)
    ranked = join_pieces(blocks, middle, keys, "inner").withColumn(
        "_through", F.col("_before") + F.sum("_n").over(place)
    )

    def at(rank: str) -> Column:
        inside = (F.col("_through") > F.col(rank)) & (
            F.col("_through") - F.col("_n") <= F.col(rank)
        )
        return F.max(F.when(inside, F.col(value)))

    return (
        ranked.groupBy(*keys)
        .agg(at("_low").alias("_a"), at("_high").alias("_b"))
        .select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))
    )
