"""Plot coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, first_of, skip, strict
from firnline.operators.joins import natural_left_join
from firnline.operators.rows import rename_select
from firnline.schema import COORD


def centroids(
    df: DataFrame,
    key: str,
    coord_cols: Sequence[str],
    first_cols: Sequence[str] = (),
    order_by: Sequence[ColumnOrName] = (),
    skip_missing: bool = True,
) -> DataFrame:
    """Mean position over the stakes of a plot, other attributes from its first stake."""
    family = skip if skip_missing else strict
    first = [first_of(first_cols, order_by).alias("_first")] if first_cols else []
    means = [family(F.avg, c).alias(c) for c in coord_cols]
    grouped = df.groupBy(key).agg(*first, *means)
    return grouped.select(
        key, *coord_cols, *[F.col(f"_first.{c}").alias(c) for c in first_cols]
    )


def coord_table(
    utm: DataFrame,
    geo: DataFrame,
    key: str = "station",
    easting: str = "utm_e",
    northing: str = "utm_n",
    height: str = "height",
) -> DataFrame:
    """Projected and geographic coordinates of the same plots in one table."""
    projected = rename_select(
        utm,
        {"plot_id": key, "easting": easting, "northing": northing, "elev_ellipsoidal": height},
    )
    geographic = rename_select(geo, {"plot_id": key, "lon": "lon", "lat": "lat"})
    return natural_left_join(projected, geographic).select(*COORD.names)


def coord_export(
    df: DataFrame, zone: str, key: str, northing: str, easting: str, height: str
) -> DataFrame:
    """Layout a coordinate solver takes; plots without a position are left out."""
    layout = {"sta": key, "utm_n": northing, "utm_e": easting, "height": height}
    out = rename_select(df, layout).withColumn("utm_z", F.lit(zone))
    return out.where(F.col("utm_n").isNotNull())
