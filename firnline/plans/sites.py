"""Plot coordinates from surveyed stakes and points, and coordinates for published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName
from firnline.functions.snow import density, swe
from firnline.operators.coords import centroids
from firnline.operators.joins import left_join
from firnline.operators.rows import bind_cols, keep, union_all

POSITION = ("northing", "easting", "elev")
ATTRIBUTES = ("solution", "aspect", "cover", "station_type")


def site_coordinates(
    stakes: DataFrame,
    points: DataFrame,
    attributes: DataFrame,
    not_plots: Sequence[str],
    stake_order: Sequence[ColumnOrName],
    point_order: Sequence[ColumnOrName],
    attribute_order: Sequence[ColumnOrName],
    promoted: tuple[str, str] | None = None,
) -> DataFrame:
    """One position per plot, from three sources.

    Stakes of a plot are averaged (`plot_id` "na" marks a stake of none). `points` are plots of
    their own, less the reference points `not_plots`, with `attributes` bound to them by row.
    `promoted` makes the stake with one `id` a plot with another.
    """
    columns = ["plot_id", *POSITION, *ATTRIBUTES]
    averaged = centroids(
        keep(stakes, not_equal={"plot_id": "na"}), "plot_id", POSITION, ATTRIBUTES, stake_order,
        skip_missing=False,
    )
    bound = bind_cols(
        keep(points, not_in={"plot_id": not_plots}), attributes, point_order, attribute_order
    )
    tables = [averaged.select(*columns), bound.select(*columns)]
    if promoted:
        stake, plot = promoted
        single = keep(stakes, equals={"id": stake}).withColumn("plot_id", F.lit(plot))
        tables.append(single.select(*columns))
    return union_all(*tables)


def append_coords(observations: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates, SWE and density (depth as read) for a published observation table."""
    located = left_join(observations, coords, ["plot_id"], na_matches=False)
    wet = located.withColumn("swe", swe("mass"))
    return wet.withColumn("density", density("swe", "depth", "plug", "B"))


def append_coords_to_summary(summary: DataFrame, coords: DataFrame) -> DataFrame:
    """A published summary with new coordinates in place of its own; the two counts are added."""
    joined = left_join(summary, coords, ["plot_id"], suffixes=("_old", ""), na_matches=False)
    counted = joined.withColumn("count", F.col("count_depth") + F.col("count_density"))
    gone = [c for c in counted.columns if c.endswith("_old")]
    return counted.drop("count_depth", "count_density", *gone)
