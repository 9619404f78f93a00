"""Station visits: snow courses, the scale core and the depth sensor as observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, first_by, skip, strict, sum_or_zero
from firnline.functions.parse import paste
from firnline.functions.snow import PI, TUBE_RADIUS_CM, density_columns, density_or_zero
from firnline.operators.rows import align, union_all
from firnline.schema import OBSERVATION


def normalise_prefix(df: DataFrame, prefixes: Sequence[str], to: str = "") -> DataFrame:
    """Strip the column prefix, which changed between form versions: first that fits wins."""
    names = {}
    for c in df.columns:
        hit = next((p for p in prefixes if c.startswith(p)), None)
        names[c] = to + c[len(hit) :] if hit else c
    return df.withColumnsRenamed(names)


def merge_station_cores(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order_by: Sequence[ColumnOrName],
    plug_agg: str = "max",
    skip_missing: bool = True,
    zero_density: bool = False,
    rating: str | None = "rating",
    convention: str = "A",
    radius: float = TUBE_RADIUS_CM,
    pi: float = PI,
) -> DataFrame:
    """One row per core of a course; a core without a depth is dropped.

    `plug_agg` is "max" or "sum". `skip_missing=False` lets a missing part spoil core, plug,
    mass and rating. `zero_density` gives bare ground density 0 instead of none.
    """
    total = sum_or_zero if skip_missing else (lambda c: strict(F.sum, c))
    family = skip if skip_missing else strict
    plug = {"max": family(F.max, "plug"), "sum": total("plug")}[plug_agg]
    merged = df.groupBy(*keys).agg(
        first_by(time, order_by).alias(time),
        F.max("depth").alias("depth"),
        total("core").alias("core"),
        plug.alias("plug"),
        total("mass").alias("mass"),
        *([family(F.avg, rating).alias(rating)] if rating else []),
    )
    cores = merged.withColumns(density_columns("depth", "plug", "mass", convention, radius, pi))
    if zero_density:
        cores = cores.withColumn("density", density_or_zero("swe", "depth"))
    return cores.where(F.col("depth").isNotNull())


def sensor_depth(
    df: DataFrame, key: str, value: str, time: str, order_by: Sequence[ColumnOrName], prefix: str
) -> DataFrame:
    """Mean depth per station sensor, none if a reading is missing; the id gets a prefix."""
    readings = df.groupBy(key).agg(
        first_by(time, order_by).alias(time), strict(F.avg, value).alias("depth")
    )
    return readings.where(F.col("depth").isNotNull()).select(
        time, paste(prefix, key).alias("plot_id"), "depth"
    )


def station_observations(
    courses: DataFrame,
    sensors: DataFrame,
    common: Mapping[str, Any],
    course: Mapping[str, Any] | None = None,
    sensor: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Both kinds of station record in the observation schema."""
    return union_all(
        align(courses, OBSERVATION, **{**common, **(course or {})}),
        align(sensors, OBSERVATION, **{**common, **(sensor or {})}),
    )
