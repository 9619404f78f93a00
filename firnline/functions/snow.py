"""Snow arithmetic as plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, as_col

# Results must agree to the last digit printed.
PI = 3.14159265359
TUBE_RADIUS_CM = 2.1


def swe(mass: ColumnOrName, radius: float = TUBE_RADIUS_CM, pi: float = PI) -> Column:
    """Snow water equivalent in cm from core mass in g and tube radius in cm."""
    return as_col(mass) / F.lit(pi * (radius * radius))


def density(
    swe: ColumnOrName, depth: ColumnOrName, plug: ColumnOrName, convention: str
) -> Column:
    """Density from SWE. "A": `depth` already has the plug taken off; "B": it has not."""
    if convention == "A":
        return F.try_divide(as_col(swe), as_col(depth))
    if convention == "B":
        return F.try_divide(as_col(swe), as_col(depth) - as_col(plug))
    raise ValueError(f"density convention must be 'A' or 'B', got {convention!r}")


def density_columns(
    depth: ColumnOrName,
    plug: ColumnOrName,
    mass: ColumnOrName,
    convention: str,
    radius: float = TUBE_RADIUS_CM,
    pi: float = PI,
) -> dict[str, Column]:
    """The stored depth, swe and density of a core. "A" stores depth less plug, "B" depth as read."""
    water = swe(mass, radius, pi)
    stored = as_col(depth) - as_col(plug) if convention == "A" else as_col(depth)
    return {"depth": stored, "swe": water, "density": density(water, stored, plug, convention)}


def density_or_zero(swe: ColumnOrName, depth: ColumnOrName) -> Column:
    """SWE over depth, 0 where that has no value (bare ground)."""
    return F.coalesce(F.try_divide(as_col(swe), as_col(depth)), F.lit(0.0))


def net_mass(gross: ColumnOrName, tare: ColumnOrName) -> Column:
    """Gross mass less tare; a missing tare counts as none."""
    return as_col(gross) - F.coalesce(as_col(tare), F.lit(0.0))


def typed_depth(sample_type: ColumnOrName, choice: Mapping[str, ColumnOrName]) -> Column:
    """Pick the depth column by sample type; NULL for a type not listed."""
    return case_when([(as_col(sample_type) == k, as_col(v)) for k, v in choice.items()])


def scale_units(
    value: ColumnOrName, group: ColumnOrName, divisors: Mapping[str, float]
) -> Column:
    """Divide the value where its group reports in another unit."""
    value, group = as_col(value), as_col(group)
    return case_when([(group == k, value / F.lit(d)) for k, d in divisors.items()], value)


def case_when(arms: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """First arm whose condition holds; NULL (or `otherwise`) if none does."""
    chain = None
    for condition, value in arms:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        raise ValueError("case_when needs at least one arm")
    return chain if otherwise is None else chain.otherwise(otherwise)
