"""Meteorological column functions. Where no value is defined the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 1976 standard atmosphere: base height (m), gradient (K/m), base temperature (K), base pressure (hPa).
LAYERS = (
    (0.0, -0.0065, 288.15, 1013.25),
    (11000.0, 0.0, 216.65, 226.32064),
    (20000.0, 0.001, 216.65, 54.748887),
    (32000.0, 0.0028, 228.65, 8.6801870),
    (47000.0, 0.0, 270.65, 1.1090631),
    (51000.0, -0.0028, 270.65, 0.66938874),
    (71000.0, -0.002, 214.65, 0.039564205),
)
TOP = 0.003733836
GAS, GRAVITY = 8314.32 / 28.9644, 9.80665


def vapor_pressure(celsius: Column) -> Column:
    """hPa over water, by the Magnus formula."""
    return 6.11 * F.pow(F.lit(10.0), 7.5 * celsius / (237.7 + celsius))


def relative_humidity(temperature: Column, dew_point: Column) -> Column:
    return F.when(dew_point <= temperature, vapor_pressure(dew_point) / vapor_pressure(temperature) * 100)


def dew_point(dry_f: Column, wet_f: Column, inches: Column, rounds: int = 12) -> Column:
    """Dew point (F) from dry and wet bulb (F) and station pressure (inHg), by iterating the mixing ratio.

    The iteration contracts about a thousandfold a round, so a few rounds stand for a test of convergence.
    """
    celsius = lambda f: (f - 32) * 5 / 9
    dry, wet, hpa = celsius(dry_f), celsius(wet_f), inches * 33.8637526
    saturated = 6.112 * F.exp(17.67 * wet / (243.5 + wet))
    ratio = 0.62197 * saturated / (hpa - saturated)
    step = lambda last, _: ratio + (1006.3 + (last + ratio) / 2 * 1850) / 2462880 * (wet - dry)
    mixing = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(1.0), step)
    x = F.ln(mixing * hpa / (0.62197 + mixing) / 6.112)
    return 243.5 * x / (17.67 - x) * 9 / 5 + 32


def standard_height(hpa: Column) -> Column:
    """Metres at a pressure in the standard atmosphere, up to the top of the seventh layer."""
    out = F.lit(None).cast("double")
    for i, (base, gradient, kelvin, pressure) in reversed(list(enumerate(LAYERS))):
        if gradient:
            height = base + kelvin / -gradient * (1 - F.pow(hpa / pressure, F.lit(-gradient * GAS / GRAVITY)))
        else:
            height = base + GAS * kelvin / GRAVITY * F.ln(pressure / hpa)
        above = LAYERS[i + 1][3] if i + 1 < len(LAYERS) else TOP
        out = F.when((hpa <= pressure) & (hpa >= above if i + 1 == len(LAYERS) else hpa > above), height).otherwise(out)
    return out


def hypsometric_height(hpa: Column, celsius: Column) -> Column:
    return F.ln(hpa / 1013.15) * 8.31432 * (celsius + 273.15) / -0.28404373326


def wind_speed(u: Column, v: Column) -> Column:
    return F.when((u > -999) & (v > -999), F.sqrt(u * u + v * v))


def wind_direction(u: Column, v: Column) -> Column:
    """Whole degrees that the wind comes from; 0 for calm."""
    speed = wind_speed(u, v)
    angle = F.floor(F.degrees(F.acos(F.least(F.abs(v) / F.nullif(speed, F.lit(0.0)), F.lit(1.0)))) + 0.5).cast("int")
    turned = F.when((u >= 0) & (v >= 0), angle + 180).when(u >= 0, 360 - angle).when(v >= 0, 180 - angle).otherwise(angle)
    return F.when(speed < 1e-9, 0).otherwise(turned)
