"""Projection, filter, order-dependent and append operators on any table."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from firnline.functions.missing import ColumnOrName, as_col, quoted
from firnline.operators.skew import (
    BLOCK,
    HOT_ROWS,
    POS,
    Blocks,
    block_sort,
    block_totals,
    join_pieces,
    split_hot,
)

# Rows that a top-k may hold in one task.
TOP_ROWS = 10_000
# Rows sampled in a pass of `row_at`.
SAMPLE = 2_000

# ---- projection ---------------------------------------------------------------------------


def rename_select(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename in one step: `{new: old}`; old names may contain dots."""
    return df.select(*[quoted(old).alias(new) for new, old in mapping.items()])


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def range_names(df: DataFrame, *specs: str, drop: Sequence[str] = ()) -> list[str]:
    """Column names of ranges such as "a:c" (or "c:a", in that order) and single names."""
    names = df.columns
    picked: list[str] = []
    for spec in specs:
        first, _, last = spec.partition(":")
        i, j = names.index(first), names.index(last or first)
        span = names[i : j + 1] if i <= j else names[j : i + 1][::-1]
        picked += [n for n in span if n not in picked]
    return [n for n in picked if n not in drop]


def col_range(df: DataFrame, *specs: str, drop: Sequence[str] = ()) -> DataFrame:
    """Select column ranges by name."""
    return df.select(*[quoted(n) for n in range_names(df, *specs, drop=drop)])


def starts_with(df: DataFrame, *keep: str, prefix: str) -> DataFrame:
    """The columns named in `keep`, then every column with the prefix."""
    rest = [c for c in df.columns if c.startswith(prefix) and c not in keep]
    return df.select(*[quoted(c) for c in [*keep, *rest]])


def cast_range(df: DataFrame, spec: str, to: str) -> DataFrame:
    """Lenient cast of a column range; what does not fit becomes NULL."""
    return df.withColumns({c: quoted(c).try_cast(to) for c in range_names(df, spec)})


def align(df: DataFrame, schema: StructType, **literals: Any) -> DataFrame:
    """Exactly the columns of `schema`: literals set, absent ones as typed NULLs."""

    def column(name: str) -> Column:
        if name in literals:
            return F.lit(literals[name])
        return F.col(name) if name in df.columns else F.lit(None)

    return df.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in schema])


# ---- filter -------------------------------------------------------------------------------


def keep(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    not_null: Sequence[str] = (),
    not_in: Mapping[str, Sequence[Any]] | None = None,
    not_equal: Mapping[str, Any] | None = None,
    after: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Rows that meet every condition.

    A NULL passes `not_in` (it is not in the list) and fails `equals`, `not_equal` and
    `after`. NaN counts as NULL in `not_null`. `not_equal` compares a number with a text by value
    if the text is a number, else as text, so 4.0 equals "4".
    """
    tests: list[Column] = [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [_present(df, c) for c in not_null]
    tests += [
        F.coalesce(~F.col(c).isin(list(vs)), F.lit(True)) for c, vs in (not_in or {}).items()
    ]
    for c, v in (not_equal or {}).items():
        same_kind = isinstance(v, str) == _is_text(df, c)
        number = isinstance(df.schema[c].dataType, NumericType) and _number(v)
        if same_kind:
            tests.append(F.col(c) != v)
        elif number is not None and number is not False:
            tests.append(F.col(c).cast("double") != number)
        else:
            tests.append(F.col(c).cast("string") != str(v))
    tests += [F.col(c) > F.lit(v).cast(df.schema[c].dataType) for c, v in (after or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def _present(df: DataFrame, name: str) -> Column:
    """Neither NULL nor NaN."""
    found = F.col(name).isNotNull()
    return found & ~F.isnan(name) if df.schema[name].dataType.simpleString() in ("double", "float") else found


def _number(text: Any) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "string"


# ---- order --------------------------------------------------------------------------------


def with_ordinal(
    df: DataFrame,
    order_by: Sequence[ColumnOrName],
    partition_by: Sequence[str] = (),
    name: str = "ordinal",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Dense number from 1 in the given total order, per group or over the whole table.

    The whole table is never one task: sorted blocks are numbered apart and shifted by a
    table with one row per block.
    """
    keys = list(partition_by)
    if not keys:
        return _number_blocks(block_sort(df, order_by), [], name)
    split = split_hot(df, keys, hot_rows)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("long")
    numbered = split.cold.withColumn(name, rank)
    if split.hot is None:
        return numbered
    blocks = split.blocks(split.hot, [*keys, *order_by])
    return numbered.unionByName(_number_blocks(blocks, keys, name))


def _number_blocks(blocks: Blocks, keys: Sequence[str], name: str) -> DataFrame:
    shifts = block_totals(blocks, keys).select(BLOCK, *keys, "_before", "_from")
    shifted = join_pieces(blocks, shifts, keys, "left")
    place = F.col(POS) - F.col("_from") + F.col("_before") + 1
    return shifted.withColumn(name, place).drop(BLOCK, POS, "_before", "_from")


def slice_rows(
    df: DataFrame, lo: int, hi: int | None = None, order_by: Sequence[ColumnOrName] = ()
) -> DataFrame:
    """Rows `lo` to `hi` (from 1, both included; to the end if `hi` is None) of a total order:
    ascending columns, missing values first.

    Rows near the start are a top-k. Farther on, the rows at the two edges are selected by counting
    (`row_at`), and the slice is a filter on the table: nothing is sorted, shuffled or staged. Rows
    that tie with an edge belong to the slice.
    """
    if not order_by:
        raise ValueError("slice_rows needs an order: file order is not kept by a cluster")
    if hi is not None and hi <= TOP_ROWS:
        return df.orderBy(*order_by).offset(lo - 1).limit(max(0, hi - lo + 1))
    keys = [as_col(c) for c in order_by]
    first = row_at(df, order_by, lo)
    if first is None or (hi is not None and hi < lo):
        return df.limit(0)
    rows = df.where(not_before(keys, first))
    last = None if hi is None else row_at(df, order_by, hi)
    return rows if last is None else rows.where(not_after(keys, last))


def row_at(df: DataFrame, order_by: Sequence[ColumnOrName], rank: int) -> list[Column] | None:
    """The order columns' values on the row of this rank (from 1), or None past the end.

    Each pass samples the range that holds the rank, cuts it at two sampled rows around the rank and
    counts the rows before each, until the range is small. Only order columns are read; the
    driver gets SAMPLE rows a pass. The sample decides how fast, never which row is found.
    """
    names = [f"_o{i}" for i in range(len(order_by))]
    keys = df.select(*[as_col(c).alias(n) for c, n in zip(order_by, names, strict=True)])
    cols, types = [F.col(n) for n in names], [f.dataType for f in keys.schema]

    def values(row: Row) -> list[Column]:
        return [F.lit(v).cast(t) for v, t in zip(row, types, strict=True)]

    def small(rows: DataFrame, place: int) -> list[Column] | None:
        found = rows.orderBy(*names).offset(place - 1).limit(1).collect()
        return values(found[0]) if found else None

    if rank <= TOP_ROWS:
        return small(keys, rank)
    inside, before, size = keys, 0, keys.count()
    if rank > size:
        return None
    while size > TOP_ROWS:
        sample = inside.sample(min(1.0, SAMPLE / size), seed=before).orderBy(*names).collect()
        if not sample:
            continue
        at = (rank - before) * len(sample) // size
        margin = max(1, math.isqrt(len(sample)))
        low, high = (values(sample[max(0, min(len(sample) - 1, i))]) for i in (at - margin, at + margin))
        first, second, through = inside.agg(
            F.count_if(~not_before(cols, low)), F.count_if(~not_before(cols, high)), F.count_if(not_after(cols, high))
        ).first()
        place = rank - before
        if place <= first:
            inside, size = inside.where(~not_before(cols, low)), first
        elif place <= second:
            inside, before, size = inside.where(not_before(cols, low) & ~not_before(cols, high)), before + first, second - first
        elif place <= through:
            return high
        else:
            inside, before, size = inside.where(~not_after(cols, high)), before + through, size - through
    return small(inside, rank - before)


def not_before(cols: Sequence[Column], edge: Sequence[Column]) -> Column:
    """Rows at or after `edge` in ascending order, missing values first; never NULL."""
    return _beyond(cols, edge, lambda c, v: F.coalesce(c > v, c.isNotNull() & v.isNull()))


def not_after(cols: Sequence[Column], edge: Sequence[Column]) -> Column:
    """Rows at or before `edge`."""
    return _beyond(cols, edge, lambda c, v: F.coalesce(c < v, c.isNull() & v.isNotNull()))


def _beyond(cols: Sequence[Column], edge: Sequence[Column], past: Callable[[Column, Column], Column]) -> Column:
    found = F.lit(True)
    for c, v in zip(reversed(cols), reversed(edge), strict=True):
        found = past(c, v) | (c.eqNullSafe(v) & found)
    return found


def bind_cols(
    a: DataFrame,
    b: DataFrame,
    order_a: Sequence[ColumnOrName],
    order_b: Sequence[ColumnOrName],
) -> DataFrame:
    """Put two tables side by side by row position; fails when it runs if their lengths differ."""
    left = with_ordinal(a, order_a, name="_row")
    right = with_ordinal(b, order_b, name="_row_b")
    joined = left.join(right, F.col("_row") == F.col("_row_b"), "full")
    paired = F.coalesce(F.col("_row") == F.col("_row_b"), F.lit(False))
    both = F.when(paired, F.lit(True)).otherwise(F.raise_error(F.lit("tables differ in length")).cast("boolean"))
    return joined.where(both).drop("_row", "_row_b")


def fill_down(
    df: DataFrame,
    cols: Sequence[str],
    partition_by: Sequence[str],
    order_by: Sequence[ColumnOrName],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Replace a NULL by the last value seen before it in its group."""
    keys, names = list(partition_by), df.columns
    split = split_hot(df, keys, hot_rows)
    filled = _fill(split.cold, cols, keys, order_by)
    if split.hot is None:
        return filled
    blocks = split.blocks(split.hot, [*keys, *order_by])
    last = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_last_{i}")
        for i, c in enumerate(cols)
    ]
    # One row per block and group: at most one row per block in each window group.
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.df.groupBy(BLOCK, *keys)
        .agg(*last)
        .withColumns(
            {
                f"_carry_{i}": F.last(f"_last_{i}", ignorenulls=True).over(earlier)
                for i in range(len(cols))
            }
        )
        .drop(*[f"_last_{i}" for i in range(len(cols))])
    )
    local = _fill(blocks.df, cols, [BLOCK, *keys], [POS])
    hot = join_pieces(blocks, carried, keys, "left", rows=local).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_carry_{i}")) for i, c in enumerate(cols)}
    )
    return filled.unionByName(hot.select(*names))


def _fill(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], order_by: Sequence[ColumnOrName]
) -> DataFrame:
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in cols})


def sort_rows(
    df: DataFrame, by: Sequence[ColumnOrName], then: Sequence[ColumnOrName]
) -> DataFrame:
    """Sort by `by`, ties in the order of `then`; missing values last.

    `then` makes the result repeatable, and lets the range partitioning cut a key that holds
    much of the table.
    """
    last = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in (*by, *then)]
    return df.orderBy(*last)


# ---- append -------------------------------------------------------------------------------


def union_all(*dfs: DataFrame) -> DataFrame:
    """Append by column name, duplicates kept; a column absent on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def literal_table(
    spark: SparkSession, schema: StructType, rows: Sequence[Sequence[Any]]
) -> DataFrame:
    """A few hand-written rows. Spark knows that the table is small and broadcasts it unasked."""
    cells = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema, row, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def append_row(df: DataFrame, row: Mapping[str, Any]) -> DataFrame:
    """Append one literal row; names not given are NULL."""
    one = literal_table(df.sparkSession, df.schema, [[row.get(c) for c in df.columns]])
    return df.unionByName(one)


def copy_rows(df: DataFrame, key: str, old: Any, new: Any) -> DataFrame:
    """Append the rows of one key a second time under another key."""
    return df.unionByName(df.where(F.col(key) == old).withColumn(key, F.lit(new)))


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
