"""Sun and calendar: strict dates, zones, solar position, daylight."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, let_all

RAD = math.pi / 180


def parse_date_time(date: Column, time: Column) -> Column:
    """A1: DD-MM-YYYY and HH:MM, years 1583 to 9999, real dates alone; else NULL."""
    ok = date.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}\z") & time.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]\z") & (F.substring(date, 7, 4) >= "1583")
    text = F.concat(F.substring(date, 7, 4), F.lit("-"), F.substring(date, 4, 2), F.lit("-"), F.substring(date, 1, 2), F.lit(" "), time)
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))


def local_to_utc(ts: Column, zone: Column) -> Column:
    """A2: NULL for local times that daylight saving skips."""
    utc = F.to_utc_timestamp(ts, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == ts, utc)


def local_clock(date: Column, utc_minutes: Column, zone: Column) -> Column:
    """Minutes from a date's midnight UTC (any day) as local HH:mm."""
    at = F.timestamp_add("SECOND", F.round(utc_minutes).cast("bigint") * 60, date.cast("timestamp"))
    return F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")


def julian_day(year: Column, month: Column, day: Column, minutes: Column) -> Column:
    late = month > 2
    y = F.when(late, year).otherwise(year - 1)
    m = F.when(late, month).otherwise(month + 12)
    century = F.floor(y / 100)
    return F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day + minutes / 1440.0 + 2 - century + F.floor(century / 4) - 1524.5


def degrees_in_turn(d: Column) -> Column:
    return d - 360 * F.floor(d / 360)


def ephemeris(centuries: Column) -> Column:
    """struct(declination in radians, equation of time in minutes) at Julian centuries since 2000."""

    def angles(t: Column) -> Column:
        seconds = 21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))
        return let_all({
            "longitude": degrees_in_turn(280.46646 + t * (36000.76983 + 0.0003032 * t)), "anomaly": (357.52911 + t * (35999.05029 - 0.0001537 * t)) * RAD,
            "ecc": 0.016708634 - t * (0.000042037 + 0.0000001267 * t), "omega": (125.04 - 1934.136 * t) * RAD, "mean_tilt": (23 + (26 + seconds / 60) / 60) * RAD,
            "c1": 1.914602 - t * (0.004817 + 0.000014 * t), "c2": 0.019993 - 0.000101 * t}, sun)

    def sun(s: Column) -> Column:
        m = s["anomaly"]
        centre = F.sin(m) * s["c1"] + F.sin(2 * m) * s["c2"] + F.sin(3 * m) * 0.000289
        tilt = s["mean_tilt"] + 0.00256 * RAD * F.cos(s["omega"])
        apparent = (s["longitude"] + centre - 0.00569 - 0.00478 * F.sin(s["omega"])) * RAD
        half = F.tan(tilt / 2)
        return let_all({"declination": F.asin(F.sin(tilt) * F.sin(apparent)), "y": half * half, "lon": s["longitude"] * RAD, "m": m, "e": s["ecc"]}, result)

    def result(s: Column) -> Column:
        y, lon, m, e = s["y"], s["lon"], s["m"], s["e"]
        equation = 4 / RAD * (y * F.sin(2 * lon) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * lon) - 0.5 * y * y * F.sin(4 * lon) - 1.25 * e * e * F.sin(2 * m))
        return F.struct(s["declination"].alias("declination"), equation.alias("equation"))

    return let(centuries, angles)


def _parts(ts: Column) -> tuple[Column, Column, Column, Column]:
    return F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts) * 60 + F.minute(ts)


def solar_place(lat: Column, lon: Column, utc: Column) -> Column:
    """A3: struct(azimuth clockwise from north, elevation) in radians, to the minute, no refraction."""
    year, month, day, minutes = _parts(utc)

    def place(sun: Column) -> Column:
        solar = minutes + sun["equation"] + 4 * lon
        return let_all({"h": ((solar - 1440 * F.floor(solar / 1440)) / 4 - 180) * RAD, "la": lat * RAD, "d": sun["declination"]}, angles)

    def angles(s: Column) -> Column:
        h, la, d = s["h"], s["la"], s["d"]
        sine = F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.cos(h)
        turn = F.atan2(F.sin(h), F.cos(h) * F.sin(la) - F.tan(d) * F.cos(la)) / RAD + 180
        return F.struct((degrees_in_turn(turn) * RAD).alias("azimuth"), F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))).alias("elevation"))

    return let(ephemeris((julian_day(year, month, day, minutes) - 2451545.0) / 36525.0), place)


def daylight_times(lat: Column, lon: Column, date: Column) -> Column:
    """A4: struct(state, sunrise, sunset), unwrapped UTC minutes from the sun at noon UTC."""

    def times(sun: Column) -> Column:
        return let_all({"c": -F.tan(lat * RAD) * F.tan(sun["declination"]), "noon": 720 - 4 * lon - sun["equation"]}, state)

    def state(s: Column) -> Column:
        c = s["c"]
        half = 4 * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))) / RAD
        normal = (c > -1) & (c < 1)
        name = F.when(c <= -1, "PolarDay").when(c >= 1, "PolarNight").otherwise("Normal")
        return F.struct(name.alias("state"), F.when(normal, s["noon"] - half).otherwise(0.0).alias("sunrise"), F.when(normal, s["noon"] + half).otherwise(0.0).alias("sunset"))

    return let(ephemeris((julian_day(F.year(date), F.month(date), F.dayofmonth(date), F.lit(720)) - 2451545.0) / 36525.0), times)
