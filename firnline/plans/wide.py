"""Areas that report one wide row per plot, with a column for each sampling position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from firnline.functions.missing import quoted
from firnline.functions.parse import decode_position
from firnline.operators.joins import left_join
from firnline.operators.reshape import to_long
from firnline.operators.rows import align
from firnline.schema import COORD, OBSERVATION


def wide_observations(
    wide: DataFrame, ids: Sequence[str], positions: Sequence[str] | str, coords: DataFrame, study_area: str
) -> DataFrame:
    """One observation per filled position. `ids` are canonical columns of the wide table; the
    position gives direction and distance, the plot its coordinates."""
    long = to_long(wide, ids, positions, "_position", "depth")
    direction, distance = decode_position("_position")
    placed = long.withColumns({"cardinal_direction": direction, "dist_from_centre": distance})
    located = left_join(
        placed.drop(*COORD.names[1:]), coords.select(*COORD.names), ["plot_id"], na_matches=False
    )
    return align(located, OBSERVATION, study_area=study_area)


def located_summaries(given: DataFrame, coords: DataFrame, own_coords: Sequence[str]) -> DataFrame:
    """Given plot summaries with their own coordinates replaced by the surveyed ones, which
    follow the plot id."""
    kept = given.drop(*own_coords)
    place = kept.columns.index("plot_id") + 1
    order = [*kept.columns[:place], *COORD.names[1:], *kept.columns[place:]]
    joined = left_join(kept, coords.select(*COORD.names), ["plot_id"], na_matches=False)
    return joined.select(*[quoted(c) for c in order])

