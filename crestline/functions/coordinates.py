"""Coordinate text: is it one, which system, which place? Columns over a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, let_all
from .geodesy import from_crs

SPACE = r"[ \t\n\x0b\x0c\r]"
PREFIX = r"^(LATLON|WGS 84|WGS84|LV95|OSGB|BNG|OS|DATASET|PROJECTED)(:|" + SPACE + r"|\z)"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
GAP = r"[ \t\n\x0b\x0c\r,;]"
LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def strip_prefix(text: Column) -> tuple[Column, Column]:
    """(system named by a leading word, the rest); no system: NULL and the text."""
    up = F.upper(trimmed(text))
    word = F.nullif(F.regexp_extract(up, PREFIX, 1), F.lit(""))
    name = F.when(word.isin("LATLON", "WGS84", "WGS 84"), "WGS84").when(word.isin("OSGB", "BNG", "OS"), "OSGB").when(word.isin("DATASET", "PROJECTED"), "DATASET").otherwise(word)
    return name, F.when(word.isNotNull(), trimmed(F.regexp_replace(up, PREFIX, ""))).otherwise(trimmed(text))


def parse_pair(text: Column) -> Column:
    """struct(a, b) of a text that is two finite numbers and separators; else NULL."""
    whole = "^" + GAP + "*(" + NUMBER + ")" + GAP + "*(" + NUMBER + ")" + GAP + r"*\z"
    # two numbers that touch are told apart by the second one's sign alone
    a, b = (F.regexp_extract(text, whole, k).try_cast("double") for k in (1, 2))
    ok = text.rlike(whole) & (text.rlike("^" + GAP + "*" + NUMBER + GAP + "+" + NUMBER + GAP + r"*\z") | text.rlike("^" + GAP + "*" + NUMBER + "[+-]"))
    return F.when(ok & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), F.struct(a.alias("a"), b.alias("b")))


def _squares(compact: Column) -> tuple[Column, Column]:
    """Column and row of the 100 km square that two letters name; NULL where they are no grid letters."""
    one, two = ((F.instr(F.lit(LETTERS), F.substring(compact, k, 1)) - 1) for k in (1, 2))
    ok = (F.length(compact) >= 2) & (one >= 0) & (two >= 0)
    e = F.pmod(one - 2 + 10, F.lit(5)) * 5 + F.pmod(two, F.lit(5))
    n = 19 - F.floor(one / 5) * 5 - F.floor(two / 5)
    inside = ok & (e <= 6) & (n >= 0) & (n <= 12)
    return F.when(inside, e), F.when(inside, n)


def compact(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[ \t\n\x0b\x0c\r,]", ""))


def parse_os_grid(text: Column) -> Column:
    """I4: struct(x, y) in EPSG 27700 of an OS grid reference: two letters, an even number of digits up to ten; else NULL."""
    c = compact(text)
    digits = F.substr(c, F.lit(3))
    half = F.floor(F.length(digits) / 2).cast("int")
    ok = c.rlike(r"^[A-HJ-Z]{2}([0-9]{2}){1,5}\z")
    e, n = _squares(c)
    x, y = (F.rpad(part, 5, "0").try_cast("int") for part in (F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, half)))
    return F.when(ok & e.isNotNull(), F.struct((e * 100000 + x).cast("double").alias("x"), (n * 100000 + y).cast("double").alias("y")))


def is_coordinate(text: Column) -> Column:
    """Does a text start with a system's name, consist of numbers alone, or look like an OS reference?"""
    up = F.upper(trimmed(text))
    c = compact(text)
    numeric = up.rlike(r"^[0-9 \t\n\x0b\x0c\r+\-.,;E]+\z") & up.rlike(r"[0-9+\-.,;]")
    grid = c.rlike(r"^[A-HJ-Z]{2}[0-9]+\z") & _squares(c)[0].isNotNull()
    return F.coalesce(up.rlike(PREFIX) | numeric | grid, F.lit(False))


def candidates(text: Column, terrain_epsg: int) -> Column:
    """Array of struct(system, lat, lon): WGS84, LV95, OS grid, then the terrain's own system, as the numbers allow.

    The terrain's system is asked if it is a projected one whose range holds the numbers, or
    if no other takes them. A later candidate within a centimetre of an earlier one is left
    out; the first is the answer. A named system is the only one asked, and an OS
    reference is nothing else.
    """
    name, rest = strip_prefix(text)

    def one(system: str, ok: Column, place: Column) -> Column:
        made = let(place, lambda p: F.struct(F.lit(system).alias("system"), p["lat"].alias("lat"), p["lon"].alias("lon")))
        return F.when(F.coalesce(ok, F.lit(False)), made)

    def rows(s: Column) -> Column:
        name, grid, a, b = s["name"], s["grid"], s["pair"]["a"], s["pair"]["b"]
        free = name.isNull()
        known = [
            one("WGS84", (free | (name == "WGS84")) & (F.abs(a) <= 90) & (F.abs(b) <= 180), F.struct(a.alias("lat"), b.alias("lon"))),
            one("LV95", (free | (name == "LV95")) & a.between(2e6, 3e6) & b.between(1e6, 1.5e6), from_crs(a, b, 2056)),
            one("OSGB", (free | (name == "OSGB")) & grid.isNotNull(), from_crs(grid["x"], grid["y"], 27700)),
            one("OSGB", (free | (name == "OSGB")) & a.between(0, 700000) & b.between(0, 1300000), from_crs(a, b, 27700))]
        own = F.lit(terrain_epsg != 4326) | F.coalesce(*known).isNull()
        return F.array(*known, one("DATASET", ((free & own) | (name == "DATASET")) & _in_system(a, b, terrain_epsg), from_crs(a, b, terrain_epsg)))

    def apart(k: Column, r: Column) -> Column:
        """Metres, near enough for a centimetre."""
        return F.hypot((k["lat"] - r["lat"]) * 111320, (k["lon"] - r["lon"]) * 111320 * F.cos(F.radians(r["lat"])))

    found = F.filter(let_all({"name": name, "pair": parse_pair(rest), "grid": parse_os_grid(rest)}, rows),
                     lambda r: r.isNotNull() & (F.abs(r["lat"]) <= 90) & (F.abs(r["lon"]) <= 180))
    empty = F.lit([]).cast("array<struct<system:string,lat:double,lon:double>>")
    return F.aggregate(found, empty, lambda kept, r: F.when(
        F.exists(kept, lambda k: apart(k, r) < 0.01), kept).otherwise(F.concat(kept, F.array(r))))


def _in_system(a: Column, b: Column, epsg: int) -> Column:
    if epsg == 4326:
        return (F.abs(b) <= 90) & (F.abs(a) <= 180)
    low_a, high_a, low_b, high_b = {2056: (2e6, 3e6, 1e6, 1.5e6), 27700: (0, 7e5, 0, 1.3e6), 2154: (-3.8e5, 1.33e6, 6e6, 7.25e6)}[epsg]
    return a.between(low_a, high_a) & b.between(low_b, high_b)
