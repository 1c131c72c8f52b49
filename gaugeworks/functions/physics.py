"""Atmospheric and geodetic formulas as column expressions. A null input gives a null result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard atmosphere and Magnus coefficients.
P0, T0, LAPSE = 1013.25, 288.15, 0.0065
G, M_AIR, R_GAS, R_DRY = 9.80665, 0.0289644, 8.3144598, 287.05
EXPONENT = G * M_AIR / (R_GAS * LAPSE)
EARTH_KM = 6371.0


def at_least(x: Column, low: float) -> Column:
    """max(x, low) that keeps null, unlike greatest()."""
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def at_most(x: Column, high: float) -> Column:
    return F.when(x > high, F.lit(float(high))).otherwise(x)


def isa_pressure(altitude: Column) -> Column:
    return F.lit(P0) * F.pow(1.0 - F.lit(LAPSE) * at_least(altitude, 0.0) / T0, F.lit(EXPONENT))


def saturation_vapour(t: Column) -> Column:
    return 6.112 * F.exp(17.67 * t / (t + 243.5))


def actual_vapour(t: Column, rh: Column) -> Column:
    return saturation_vapour(t) * rh / 100.0


def dew_point(t: Column, rh: Column) -> Column:
    gamma = F.ln(actual_vapour(t, at_least(rh, 0.1)) / 6.112)
    return 243.5 * gamma / (17.67 - gamma)


def dew_point_clipped(t: Column, rh: Column) -> Column:
    """The exploratory variant: humidity clipped to [0.001, 100]."""
    gamma = F.ln(at_most(at_least(rh, 1e-3), 100.0) / 100.0) + 17.67 * t / (243.5 + t)
    return 243.5 * gamma / (17.67 - gamma)


def vapour_deficit(t: Column, rh: Column) -> Column:
    return at_least(saturation_vapour(t) * (1.0 - rh / 100.0), 0.0)


def dew_depression(t: Column, rh: Column) -> Column:
    return at_least(t - dew_point(t, rh), 0.0)


def thermal_tide(solar_hour: Column, latitude: Column) -> Column:
    return 1.65 * F.cos(F.radians(latitude)) * F.cos(2 * F.pi() * (solar_hour - 10.0) / 12.0)


def sea_level_pressure(p: Column, t: Column, rh: Column, altitude: Column) -> Column:
    e = actual_vapour(t, rh)
    q = at_most(at_least(0.622 * e / at_least(at_least(p, 300.0) - 0.378 * e, 100.0), 0.0), 0.1)
    reduced = p * F.exp(G * altitude / (R_DRY * (t + 273.15) * (1.0 + 0.61 * q)))
    return F.when(altitude <= 0, p).otherwise(reduced)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def physically_consistent(t: Column, rh: Column, p: Column, tolerance: float = 0.05) -> Column:
    ok = rh.between(0.0, 100.05) & t.between(-25.0, 60.0) & p.between(550.0, 1060.0) & (dew_point(t, rh) <= t + tolerance)
    return F.when(t.isNull() | rh.isNull() | p.isNull(), True).otherwise(ok)


def dew_violation(t: Column, rh: Column, tolerance: float = 0.5) -> Column:
    return F.coalesce(t - dew_point(t, rh) < -tolerance, F.lit(False))


def quadratic_form(d: list[Column], inv: list[Column]) -> Column:
    """d' S d for a 3-vector and a row-major symmetric 3 x 3 matrix, at least 0."""
    total = sum((d[i] * inv[3 * i + j] * d[j] for i in range(3) for j in range(3) if (i, j) != (0, 0)), d[0] * inv[0] * d[0])
    return at_least(total, 0.0)


def inverse3(c: dict[str, Column]) -> list[Column]:
    """Row-major inverse of a symmetric matrix given by xx, xy, xz, yy, yz, zz, by cofactors."""
    a, b, d, e, f, i = c["xx"], c["xy"], c["xz"], c["yy"], c["yz"], c["zz"]
    m = [e * i - f * f, d * f - b * i, b * f - d * e, a * i - d * d, b * d - a * f, a * e - b * b]
    det = a * m[0] + b * m[1] + d * m[2]
    return [m[0] / det, m[1] / det, m[2] / det, m[1] / det, m[3] / det, m[4] / det, m[2] / det, m[4] / det, m[5] / det]
