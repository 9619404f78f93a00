"""Two families of aggregates: `strict` lets one missing value spoil the group, `skip` ignores it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strict(agg: Callable[[Column], Column], c: ColumnOrName) -> Column:
    """`agg(c)`, or NULL as soon as one value of the group is NULL."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), agg(c))


def skip(agg: Callable[[Column], Column], c: ColumnOrName) -> Column:
    """`agg(c)` over the values present; NULL if there is none."""
    return agg(as_col(c))


def sum_or_zero(c: ColumnOrName) -> Column:
    """Sum of the values present; 0 if there is none."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def order_key(order_by: Sequence[ColumnOrName]) -> Column:
    """One comparable value for a list of ascending order columns (NULLs first)."""
    return F.struct(*[as_col(c) for c in order_by])


def first_by(c: ColumnOrName, order_by: Sequence[ColumnOrName]) -> Column:
    """The value on the first row of the group, NULL included. `order_by` must be total."""
    return F.min_by(as_col(c), order_key(order_by))


def first_of(cols: Sequence[str], order_by: Sequence[ColumnOrName]) -> Column:
    """Several columns of the first row as one struct: one buffer instead of one per column."""
    return F.min_by(F.struct(*[F.col(c) for c in cols]), order_key(order_by))
