"""Totals over all study areas, from their plot summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName
from firnline.functions.parse import day_of
from firnline.functions.snow import scale_units
from firnline.operators.rows import keep
from firnline.operators.totals import grand_total, period_totals


@dataclass
class AreaTotals:
    daily: DataFrame
    flights: DataFrame
    total_km: DataFrame


def area_totals(
    summaries: DataFrame,
    swe_divisors: Mapping[str, float],
    no_daily: str,
    order_by: Sequence[ColumnOrName],
) -> AreaTotals:
    """Daily totals (without the area `no_daily`, which has no daily resolution), totals per
    flight, and the depth of everything in km.

    `summaries` has flight, study_area, survey_time, depth and swe; `swe_divisors` bring the
    SWE of an area to cm.
    """
    common = summaries.withColumns(
        {
            "day": day_of("survey_time"),
            "swe": scale_units("swe", "study_area", swe_divisors),
        }
    )

    def totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        sums = period_totals(
            df, [keys], "survey_time", order_by, {"total_depth": "depth"}, {"total_swe": "swe"}
        )
        return sums.drop("level")

    return AreaTotals(
        daily=totals(keep(common, not_equal={"study_area": no_daily}), ["flight", "study_area", "day"]),
        flights=totals(common, ["flight", "study_area"]),
        total_km=grand_total(common, F.col("depth"), "total_depth_km"),
    )
