"""UTM to and from latitude and longitude: the Krueger series to fourth order, as columns."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, as_col

# GRS80 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0


@dataclass(frozen=True)
class Ellipsoid:
    """Series coefficients of an ellipsoid, by rising multiple of the angle."""

    a: float = SEMI_MAJOR
    inverse_f: float = INVERSE_FLATTENING

    @property
    def n(self) -> float:
        f = 1 / self.inverse_f
        return f / (2 - f)

    @property
    def radius(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def alpha(self) -> tuple[float, ...]:
        n = self.n
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    @property
    def beta(self) -> tuple[float, ...]:
        n = self.n
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )

    @property
    def delta(self) -> tuple[float, ...]:
        n = self.n
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )


GRS80 = Ellipsoid()


def central_meridian(zone: ColumnOrName | int) -> Column:
    zone = F.lit(zone) if isinstance(zone, int) else as_col(zone)
    return zone * 6 - 183


def zone_number(tag: ColumnOrName) -> Column:
    """The number in a zone tag such as "utm10"."""
    return F.regexp_replace(as_col(tag), "[^0-9]", "").try_cast("int")


def utm_forward(
    df: DataFrame,
    lat: ColumnOrName,
    lon: ColumnOrName,
    zone: ColumnOrName | int,
    easting: str = "easting",
    northing: str = "northing",
    south: bool = False,
    ellipsoid: Ellipsoid = GRS80,
) -> DataFrame:
    """Add easting and northing of geographic coordinates in degrees."""
    e = 2 * sqrt(ellipsoid.n) / (1 + ellipsoid.n)
    sine = F.sin(F.radians(as_col(lat)))
    turn = F.radians(as_col(lon) - central_meridian(zone))
    start = df.withColumns(
        {"_t": F.sinh(F.atanh(sine) - e * F.atanh(e * sine)), "_turn": turn}
    ).withColumns(
        {
            "_xi": F.atan2(F.col("_t"), F.cos("_turn")),
            "_eta": F.atanh(F.sin("_turn") / F.sqrt(1 + F.col("_t") * F.col("_t"))),
        }
    )
    xi, eta = F.col("_xi"), F.col("_eta")
    north, east = xi, eta
    for j, a in enumerate(ellipsoid.alpha, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    k = SCALE * ellipsoid.radius
    shift = FALSE_NORTHING_SOUTH if south else 0.0
    return start.withColumns(
        {easting: FALSE_EASTING + k * east, northing: shift + k * north}
    ).drop("_t", "_turn", "_xi", "_eta")


def utm_inverse(
    df: DataFrame,
    easting: ColumnOrName,
    northing: ColumnOrName,
    zone: ColumnOrName | int,
    lat: str = "lat",
    lon: str = "lon",
    south: bool = False,
    ellipsoid: Ellipsoid = GRS80,
) -> DataFrame:
    """Add latitude and longitude in degrees of grid coordinates."""
    k = SCALE * ellipsoid.radius
    shift = FALSE_NORTHING_SOUTH if south else 0.0
    start = df.withColumns(
        {
            "_xi": (as_col(northing) - shift) / F.lit(k),
            "_eta": (as_col(easting) - FALSE_EASTING) / F.lit(k),
            "_mid": central_meridian(zone),
        }
    )
    xi, eta = F.col("_xi"), F.col("_eta")
    xi0, eta0 = xi, eta
    for j, b in enumerate(ellipsoid.beta, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    turned = start.withColumns({"_xi0": xi0, "_eta0": eta0}).withColumn(
        "_chi", F.asin(F.sin("_xi0") / F.cosh("_eta0"))
    )
    chi = F.col("_chi")
    phi = chi
    for j, d in enumerate(ellipsoid.delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    around = F.atan2(F.sinh("_eta0"), F.cos("_xi0"))
    return turned.withColumns(
        {lat: F.degrees(phi), lon: F.col("_mid") + F.degrees(around)}
    ).drop("_xi", "_eta", "_mid", "_xi0", "_eta0", "_chi")
