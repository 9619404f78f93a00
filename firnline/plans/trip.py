"""A whole trip: forms, station visits and coordinates to the three published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName
from firnline.functions.parse import format_time
from firnline.operators.complete import complete_template
from firnline.operators.joins import left_join
from firnline.operators.multipart import resolve_multipart
from firnline.operators.rows import align, union_all
from firnline.operators.rules import apply_aliases, apply_corrections
from firnline.operators.skew import MEDIAN_ROWS
from firnline.operators.skew import stage as write_stage
from firnline.operators.station import (
    merge_station_cores,
    sensor_depth,
    station_observations,
)
from firnline.operators.summarise import average_repeats, summarise_plots
from firnline.operators.totals import daily_totals
from firnline.schema import COORD, OBSERVATION, PLOT_SUMMARY

CORE_KEY = ("plot_id", "cardinal_direction")
META = ("survey_time", "study_area", "plot_id", "plot_type", "sample_type",
        "cardinal_direction", "dist_from_centre", "multi_core")
# Total order over observations: rows that tie here are equal in every column summarised.
ROW_ORDER = ("survey_time", "plot_id", "plot_type", "sample_type", "cardinal_direction",
             "dist_from_centre", "multi_core", "depth", "core", "plug", "mass")


@dataclass
class Trip:
    observations: DataFrame
    plots: DataFrame
    daily_depth: DataFrame
    daily_density: DataFrame


def run_trip(
    forms: Sequence[DataFrame],
    coords: DataFrame,
    station: DataFrame | None = None,
    rules: DataFrame | None = None,
    aliases: DataFrame | None = None,
    convention: str = "A",
    metadata: str = "distinct",
    include_unflagged: bool = True,
    repeats: bool = False,
    template: Sequence[Sequence[Any]] | None = None,
    flight: int | None = None,
    density_type: str = "Density",
    order_by: Sequence[ColumnOrName] = ROW_ORDER,
    hot_rows: int | None = MEDIAN_ROWS,
    stage: bool = True,
    plug_default: float | None = 0.0,
) -> Trip:
    """Clean, correct, merge, locate and summarise.

    `forms` are canonical point forms, `station` records already in the observation schema.
    `repeats` averages repeated single cores first; `template` completes plots, for the plot
    table only. The cleaned rows feed the single and the merged cores and the count of parts per
    core, and the observations feed every other table, so both are written once to the checkpoint
    folder: each form is scanned, and each rule joined, once. `plug_default=None` leaves a missing
    plug missing; `stage=False` is for a caller that wants one of the tables only.
    """
    # As a written table its size is known, so Spark can decide to broadcast it.
    coords = write_stage(coords.select(*COORD.names))
    raw = union_all(*forms)
    if plug_default is not None:
        raw = raw.withColumn("plug", F.coalesce("plug", F.lit(plug_default)))
    if rules is not None:
        raw = apply_corrections(raw, rules, ["plot_id", "sample_type"], "depth")
    if aliases is not None:
        raw = apply_aliases(raw, aliases, "plot_id")
    if stage:
        raw = write_stage(raw)
    if repeats:
        lone = F.coalesce(F.col("multi_core"), F.lit("no")) == "no"
        points = [m for m in META if m not in ("sample_type", "multi_core")]
        averaged = average_repeats(
            raw.where(lone),
            points,
            ["depth", "core", "plug", "mass"],
            order_by,
            ["sample_type", "multi_core"],
        )
        raw = union_all(raw.where(~lone), averaged.drop("count"))
    resolved = resolve_multipart(
        raw,
        CORE_KEY,
        META,
        convention,
        metadata=metadata,
        order_by=order_by,
        include_unflagged=include_unflagged,
        hot_rows=hot_rows,
    )
    located = _locate(resolved, coords)
    observations = align(located, OBSERVATION, **({} if flight is None else {"flight": flight}))
    if station is not None:
        at_station = align(_locate(station.drop(*COORD.names[1:]), coords), OBSERVATION)
        observations = observations.unionByName(at_station)
    if stage:
        observations = write_stage(observations)
    surveyed = observations
    if template is not None:
        surveyed = complete_template(
            observations,
            "plot_id",
            ["cardinal_direction", "dist_from_centre"],
            template,
            ["survey_time", "study_area", "plot_type"],
            {"depth": 0.0},
            order_by,
            hot_rows=hot_rows,
        )
    return Trip(
        observations=observations,
        plots=plot_table(surveyed, coords, order_by, hot_rows),
        daily_depth=daily_totals(observations, "survey_time", "depth", "total_depth_metre"),
        daily_density=daily_totals(
            observations,
            "survey_time",
            "depth",
            "total_density_metre",
            where=F.col("sample_type") == density_type,
        ),
    )


def plot_table(
    observations: DataFrame,
    coords: DataFrame,
    order_by: Sequence[ColumnOrName] = ROW_ORDER,
    hot_rows: int | None = MEDIAN_ROWS,
) -> DataFrame:
    """The published plot summary with coordinates."""
    stats = summarise_plots(
        observations,
        ["plot_id"],
        "depth",
        order_by,
        ["survey_time", "study_area", "plot_type"],
        ["swe", "density"],
        hot_rows,
    )
    named = stats.withColumnRenamed("survey_time", "plot_datetime")
    return align(_locate(named, coords), PLOT_SUMMARY)


def plots_by_flight(
    observations: DataFrame,
    coords: DataFrame,
    order_by: Sequence[ColumnOrName] = ROW_ORDER,
    hot_rows: int | None = MEDIAN_ROWS,
) -> DataFrame:
    """Plot summary per flight for every plot with coordinates, observed or not.

    The observations are summarised before the join, so the join sees one row per plot and
    flight. A plot without observations is one row that counts itself.
    """
    stats = summarise_plots(
        observations.drop(*COORD.names[1:]),
        ["plot_id", "flight"],
        "depth",
        order_by,
        ["survey_time", "study_area", "plot_type"],
        ["swe", "density"],
        hot_rows,
    )
    timed = stats.withColumn("survey_time", format_time("survey_time")).withColumnRenamed(
        "survey_time", "plot_datetime"
    )
    located = left_join(coords.select(*COORD.names), timed, ["plot_id"])
    return located.withColumn("count", F.coalesce("count", F.lit(1).cast("long")))


def station_records(
    visits: DataFrame,
    station: str,
    core: str,
    sensor: str,
    order_by: Sequence[ColumnOrName],
    common: Mapping[str, Any],
    keep_cores: Column | None = None,
    plug_agg: str = "max",
    convention: str = "A",
    prefix: str = "SR50_",
) -> DataFrame:
    """Snow courses and sensor depths of station visits in the observation schema."""
    cores = visits if keep_cores is None else visits.where(keep_cores)
    courses = merge_station_cores(
        cores, [station, core], "survey_time", order_by, plug_agg, rating=None, convention=convention
    ).withColumnRenamed(station, "plot_id")
    sensors = sensor_depth(visits, station, sensor, "survey_time", order_by, prefix)
    return station_observations(
        courses, sensors, common, {"multi_core": "yes", "sample_type": "Density"}, {"sample_type": "Depth"}
    )


def _locate(df: DataFrame, coords: DataFrame) -> DataFrame:
    return left_join(df.drop(*COORD.names[1:]), coords.select(*COORD.names), ["plot_id"], na_matches=False)
