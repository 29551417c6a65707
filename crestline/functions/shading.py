"""Shading as columns: value scales, palettes, normals, light."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Five stops (red, green, blue) of each palette.
PALETTES = {
    "viridis": ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)),
    "plasma": ((13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 149, 64), (240, 249, 33)),
    "inferno": ((0, 0, 4), (87, 15, 109), (187, 55, 84), (249, 142, 9), (252, 255, 164)),
    "magma": ((0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)),
    "cividis": ((0, 32, 77), (65, 77, 108), (124, 124, 120), (190, 175, 110), (255, 233, 69)),
    "turbo": ((48, 18, 59), (40, 188, 235), (164, 252, 60), (251, 126, 33), (122, 4, 3)),
}
#: The 96 colours of the viewfinder palette, from near to far.
VIEWFINDER = """
007800 008100 008a00 009300 009c00 00a500 00af00 00b900 00c300 00d100 00df00 00ed00
00f600 00ff00 14ff00 28ff00 3cff00 50ff00 60ff00 71ff00 82ff00 92ff00 9bff00 a4ff00
adff00 b6ff00 bfff00 c8ff00 d1ff00 daff00 e3ff00 ecff00 f5ff00 ffff00 fff900 fff600
fff300 ffec00 ffe800 ffe600 ffe400 ffe300 ffe000 ffdb00 ffd500 ffcf00 ffc900 ffc000
ffba00 ffb400 ffae00 ffa800 ffa200 ff9b00 ff9100 ff8a00 ff8500 ff7d00 ff7600 ff6e00
ff6400 ff5a00 ff5000 ff4600 ff3c00 ff3200 ff0000 ff0048 ff0060 ff0084 ff0090 ff009d
ff00ab ff00b9 ff00c7 ff00d5 ff00e1 ff00ea ff00ff ff3cff ff5aff ff78ff ff8cff ffa0ff
ffb4ff ffb9ff ffc0ff ffc7ff ffceff ffd5ff ffdcff ffe3ff ffeaff fff1ff fff8ff ffffff
""".split()
SKY = (205, 253, 254)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalise(v: Column, low: float, high: float, scale: str = "linear") -> Column:
    """H1: a value as 0..1 of a range, on a linear, log, sqrt or square scale."""
    x = clamp((v - low) / (high - low))
    return {"linear": x, "log": F.log2(1 + 255 * x) / 8, "sqrt": F.sqrt(x), "square": x * x}[scale]


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def colourmap(x: Column, name: str = "viridis") -> list[Column]:
    """H2: red, green, blue bytes of 0..1 on a palette of evenly spaced stops."""
    stops = PALETTES[name]
    v = clamp(x)
    lower = F.least(F.ceil(v * (len(stops) - 1)) - 1, F.lit(len(stops) - 2))
    lower = F.greatest(lower, F.lit(0)).cast("int")
    t = v * (len(stops) - 1) - lower
    found = []
    for k in range(3):
        row = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(row, lower), F.get(row, lower + 1)
        found.append(half_up(clamp(a + t * (b - a), 0, 255)).cast("int"))
    return found


def nearest_colour(x: Column, palette: list[tuple[int, int, int]]) -> list[Column]:
    """H2, indexed palettes: the entry nearest to 0..1. The palette is the caller's table."""
    at = half_up(clamp(x) * (len(palette) - 1)).cast("int")
    return [F.get(F.array(*[F.lit(p[k]) for p in palette]), at) for k in range(3)]


def viewfinder(x: Column) -> list[Column]:
    """H2: the viewfinder palette."""
    return nearest_colour(x, [tuple(bytes.fromhex(c)) for c in VIEWFINDER])


def scalar_image(v: Column, low: float, high: float) -> list[Column]:
    """H3: a scalar in viridis; black where it is no finite number. Sky (NULL) has the value 0."""
    value = F.coalesce(v, F.lit(0.0))
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return [F.when(bad, 0).otherwise(c) for c in colourmap((value - low) / (high - low))]


def normal(ge: Column, gn: Column) -> list[Column]:
    """The unit normal of a gradient: east, north, up."""
    inv = 1 / F.sqrt(ge * ge + gn * gn + 1)
    return [-ge * inv, -gn * inv, inv]


def normal_image(distance: Column, ge: Column, gn: Column) -> list[Column]:
    """H4: the normal as bytes; sky is black."""
    return [F.when(distance > 0, half_up(clamp(0.5 * c + 0.5) * 255)).otherwise(0).cast("int") for c in normal(ge, gn)]


def sun_vector(azimuth: float, elevation: float) -> tuple[float, float, float]:
    return math.cos(elevation) * math.sin(azimuth), math.cos(elevation) * math.cos(azimuth), math.sin(elevation)


def sky_exposure(n: list[Column], sun: tuple[float, float, float], detail: float) -> Column:
    """H5: light from a zenith lobe and four diagonal ones, those towards the sun stronger."""
    flat = math.hypot(sun[0], sun[1])
    sx, sy = (sun[0] / flat, sun[1] / flat) if flat * flat > 1e-8 else (0.0, 1.0)
    diagonal = math.sqrt(0.5)
    total, level = 1.5 * F.greatest(n[2], F.lit(0.0)), 1.5
    for ex, ey in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        weight = 1 + 0.75 * max((ex * sx + ey * sy) * diagonal, 0.0)
        total = total + weight * F.greatest(0.5 * ex * n[0] + 0.5 * ey * n[1] + diagonal * n[2], F.lit(0.0))
        level += weight * diagonal
    return 1 + (0.35 + 0.65 * clamp(total / level) - 1) * detail


def to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def to_linear(c: Column) -> Column:
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def light(n: list[Column], sun: tuple[float, float, float], lit: Column, ambient: float = 0.28, detail: float = 0.65, diffusivity: float = 1.0) -> Column:
    """Sky light and, where lit, sunlight, in linear terms."""
    visible = lit.cast("double") if sun[2] > 0 else F.lit(0.0)
    direct = visible * F.greatest(n[0] * sun[0] + n[1] * sun[1] + n[2] * sun[2], F.lit(0.0))
    return ambient * sky_exposure(n, sun, detail) + diffusivity * (1 - ambient) * direct


def pack_rgb(c: Column) -> Column:
    """H9: 0..1 to a byte."""
    return half_up(clamp(c) * 255).cast("int")


def shade_white(distance: Column, ge: Column, gn: Column, sun: tuple[float, float, float], lit: Column, outline: Column | None = None, **options: float) -> Column:
    """H6: the grey byte of white ground; sky and outlines are black."""
    value = pack_rgb(to_srgb(light(normal(ge, gn), sun, lit, **options)))
    dark = ~F.coalesce(distance > 0, F.lit(False))
    return F.when(dark if outline is None else dark | outline, 0).otherwise(value)


def shade_coloured(distance: Column, ge: Column, gn: Column, sun: tuple[float, float, float], lit: Column, x: Column, name: str = "viridis", outline: Column | None = None, **options: float) -> list[Column]:
    """H7: palette colours under that light; the sky has its own colour."""
    bright = light(normal(ge, gn), sun, lit, **options)
    dark = F.lit(False) if outline is None else outline
    return [F.when(~F.coalesce(distance > 0, F.lit(False)), sky).when(dark, 0).otherwise(pack_rgb(to_srgb(to_linear(c / 255.0) * bright)))
            for c, sky in zip(colourmap(x, name), SKY, strict=True)]
