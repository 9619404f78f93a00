"""Wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators.rows import range_names


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str] | str,
    name: str,
    value: str,
    drop_null: bool = True,
) -> DataFrame:
    """One row per (row, column); `cols` is a list or a range such as "Centre:W2.5"."""
    names = range_names(df, cols) if isinstance(cols, str) else list(cols)
    ticked = [F.col("`" + c + "`") for c in names]
    long = df.unpivot([F.col("`" + c + "`") for c in ids], ticked, name, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long
