"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName
from firnline.operators.rows import with_ordinal


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    row_number: bool = False,
    order_by: Sequence[ColumnOrName] = (),
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    null_token: str = "NA",
    replace_parts: bool = False,
) -> None:
    """Write CSV (header, NULL as `null_token`) or Parquet.

    `row_number` puts the place in `order_by` first, in a column named `row`. `partition_by`
    writes a folder per value; rows are rebalanced by it first, so a small value is one file
    and a value with much of the table is many. `replace_parts` replaces the folders of the values
    that `df` has and leaves those of other values alone.
    """
    if replace_parts:
        if not partition_by:
            raise ValueError("replace_parts needs partition_by")
        mode = "overwrite"
    if row_number:
        names = df.columns
        numbered = with_ordinal(df, order_by, name="row")
        df = numbered.select(F.col("row").cast("string"), *names)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_parts:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", null_token).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        ).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', got {fmt!r}")
