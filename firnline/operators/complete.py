"""Complete every plot to the full set of sampling positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from firnline.functions.missing import ColumnOrName, order_key
from firnline.operators.rows import fill_down, literal_table
from firnline.operators.skew import HOT_ROWS, join_keys

# Eight directions at four distances in metres, and the centre.
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
DISTANCES = (2.5, 5.0, 7.5, 10.0)
CENTRE = ("Centre", None)


def plot_template() -> list[tuple[str, float | None]]:
    """The 33 positions of a full plot."""
    return [(d, m) for d in DIRECTIONS for m in DISTANCES] + [CENTRE]


def complete_template(
    df: DataFrame,
    plot_key: str,
    position_cols: Sequence[str],
    template: Sequence[Sequence[Any]],
    fill_cols: Sequence[str],
    defaults: Mapping[str, Any],
    order_by: Sequence[ColumnOrName],
    literals: Mapping[str, Any] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Every plot gets a row for each template position; observations elsewhere are dropped.

    Missing positions take the plot's last known `fill_cols`, gaps in observed rows the last
    value before them; then `defaults` replace NULLs and `literals` overwrite. The gaps come from
    one aggregation: the positions seen in a plot are a set of at most `len(template)` numbers,
    which merges from partial sets, and the others are exploded from it.
    """
    wanted = _template_table(df, position_cols, template)
    placed = join_keys(df, wanted, position_cols, "left")
    inside = F.col("_slot").isNotNull()
    last = [
        F.max_by(F.col(c), F.when(inside & F.col(c).isNotNull(), order_key(order_by))).alias(c)
        for c in fill_cols
    ]
    every = F.array(*[F.lit(i) for i in range(len(template))])
    gaps = (
        placed.groupBy(plot_key)
        .agg(F.collect_set("_slot").alias("_seen"), *last)
        .withColumn("_slot", F.explode(F.array_except(every, F.col("_seen"))))
        .drop("_seen")
    )
    missing = gaps.join(wanted, "_slot").drop("_slot")
    seen = placed.where(inside)
    filled = fill_down(seen.drop("_slot"), fill_cols, [plot_key], order_by, hot_rows)
    completed = filled.unionByName(missing, allowMissingColumns=True).select(*df.columns)
    fixed = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    fixed.update({c: F.lit(v) for c, v in (literals or {}).items()})
    return completed.withColumns(fixed) if fixed else completed


def _template_table(
    df: DataFrame, position_cols: Sequence[str], template: Sequence[Sequence[Any]]
) -> DataFrame:
    fields = [StructField("_slot", IntegerType()), *[df.schema[c] for c in position_cols]]
    rows = [[i, *position] for i, position in enumerate(template)]
    return literal_table(df.sparkSession, StructType(fields), rows)
