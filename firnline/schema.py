"""Canonical tables. Depth, core, plug in cm; mass in g; SWE in cm; density in g/cm3."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "int": IntegerType(),
    "long": LongType(),
    "str": StringType(),
    "dbl": DoubleType(),
    "time": TimestampNTZType(),
}


def table(spec: str) -> StructType:
    """`"plot_id:str depth:dbl"` to a StructType of nullable fields."""
    pairs = (item.split(":") for item in spec.split())
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in pairs])


COORD = table("plot_id:str easting:dbl northing:dbl elev_ellipsoidal:dbl lon:dbl lat:dbl")

OBSERVATION = table(
    "flight:int survey_time:time study_area:str plot_id:str "
    "easting:dbl northing:dbl elev_ellipsoidal:dbl lon:dbl lat:dbl "
    "plot_type:str sample_type:str cardinal_direction:str dist_from_centre:dbl "
    "multi_core:str depth:dbl core:dbl plug:dbl mass:dbl swe:dbl density:dbl"
)

PLOT_SUMMARY = table(
    "plot_datetime:time study_area:str plot_id:str "
    "easting:dbl northing:dbl elev_ellipsoidal:dbl lon:dbl lat:dbl plot_type:str "
    "mean_depth:dbl med_depth:dbl max_depth:dbl min_depth:dbl sd_depth:dbl "
    "swe:dbl density:dbl count:long"
)
