"""Geodesy as columns: WGS84 geodesics, azimuthal equidistant frames, four fixed systems, map coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .columns import let, let_all

RAD = math.pi / 180
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
#: The ellipsoid's smallest and largest radius of curvature: spheres of them bound its distances.
LEAST_RADIUS, MOST_RADIUS = 6335439.0, 6399594.0
E2 = FLAT * (2 - FLAT)
STEPS = 20


def valid_lat_lon(lat: Column, lon: Column) -> Column:
    """Finite and in range."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def unwrap_lon(lon: Column, centre: Column) -> Column:
    """The longitude's turn that is nearest to a centre (halves to the even turn)."""
    return centre + (lon - centre) - 360 * F.rint((lon - centre) / 360)


def map_xy(lat: Column, lon: Column, centre_lon: Column | None = None) -> tuple[Column, Column]:
    """Spherical Mercator on a world 2^28 wide, x to the right, y down; x wrapped to the centre."""
    size = float(1 << 28)
    at = lon if centre_lon is None else unwrap_lon(lon, centre_lon)
    s = F.sin(lat * RAD)
    return (at + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def _series(u2: Column) -> tuple[Column, Column]:
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _delta_sigma(b: Column, sin_s: Column, cos_s: Column, cos_2m: Column) -> Column:
    return b * sin_s * (cos_2m + b / 4 * (cos_s * (-1 + 2 * cos_2m * cos_2m) - b / 6 * cos_2m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * cos_2m * cos_2m)))


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """G3, polar: struct(distance, azimuth at the first point) by Vincenty's inverse formula, a fixed number of steps.

    Nearly antipodal points, where the steps do not settle, get the great circle's
    distance on the mean sphere.
    """
    start = {
        "u1": F.atan((1 - FLAT) * F.tan(lat1 * RAD)), "u2": F.atan((1 - FLAT) * F.tan(lat2 * RAD)),
        "l": unwrap_lon(lon2 - lon1, F.lit(0.0)) * RAD}

    def parts(s: Column) -> Column:
        return let_all({"su1": F.sin(s["u1"]), "cu1": F.cos(s["u1"]), "su2": F.sin(s["u2"]), "cu2": F.cos(s["u2"]), "l": s["l"]}, solve)

    def sphere(p: Column, lam: Column) -> dict[str, Column]:
        x, y = p["cu2"] * F.sin(lam), p["cu1"] * p["su2"] - p["su1"] * p["cu2"] * F.cos(lam)
        sin_s = F.sqrt(x * x + y * y)
        cos_s = p["su1"] * p["su2"] + p["cu1"] * p["cu2"] * F.cos(lam)
        sin_a = F.when(sin_s > 0, p["cu1"] * p["cu2"] * F.sin(lam) / sin_s).otherwise(0.0)
        cos2a = 1 - sin_a * sin_a
        cos_2m = F.when(cos2a > 1e-15, cos_s - 2 * p["su1"] * p["su2"] / cos2a).otherwise(0.0)
        return {"sin_s": sin_s, "cos_s": cos_s, "sigma": F.atan2(sin_s, cos_s), "sin_a": sin_a, "cos2a": cos2a, "cos_2m": cos_2m}

    def solve(p: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            def next_lam(q: Column) -> Column:
                c = FLAT / 16 * q["cos2a"] * (4 + FLAT * (4 - 3 * q["cos2a"]))
                lam = p["l"] + (1 - c) * FLAT * q["sin_a"] * (q["sigma"] + c * q["sin_s"] * (q["cos_2m"] + c * q["cos_s"] * (-1 + 2 * q["cos_2m"] * q["cos_2m"])))
                return F.struct(lam.alias("lam"), state["lam"].alias("was"))

            # settled after a few steps, the rest of them cost nothing
            return F.when(F.abs(state["lam"] - state["was"]) < 1e-15, state).otherwise(let_all(sphere(p, state["lam"]), next_lam))

        final = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(p["l"].alias("lam"), F.lit(0.0).alias("was")), step)
        return let(final, lambda s: let_all(sphere(p, s["lam"]) | {"lam": s["lam"], "was": s["was"]}, lambda q: result(p, q)))

    def result(p: Column, q: Column) -> Column:
        a, b = _series(q["cos2a"] * (A * A - B * B) / (B * B))
        distance = B * a * (q["sigma"] - _delta_sigma(b, q["sin_s"], q["cos_s"], q["cos_2m"]))
        settled = F.abs(q["lam"] - q["was"]) < 1e-10
        azimuth = F.atan2(p["cu2"] * F.sin(q["lam"]), p["cu1"] * p["su2"] - p["su1"] * p["cu2"] * F.cos(q["lam"]))
        return F.struct(F.when(settled, distance).otherwise((2 * A + B) / 3 * q["sigma"]).alias("distance"), azimuth.alias("azimuth"))

    return let_all(start, parts)


def distances(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """geodesic()'s distance alone, by numpy over batches of rows: for joins that measure many pairs, as lambdas are interpreted."""

    # all that the workers need goes with the function: they may not have this package
    flat, a_axis, b_axis, steps = FLAT, A, B, STEPS

    def measured(lat1, lon1, lat2, lon2):
        import numpy as np
        import pandas as pd

        u1, u2 = (np.arctan((1 - flat) * np.tan(np.radians(v.to_numpy()))) for v in (lat1, lat2))
        su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        l = np.radians((lon2.to_numpy() - lon1.to_numpy() + 180) % 360 - 180)
        lam, was = l, np.zeros_like(l)
        with np.errstate(divide="ignore", invalid="ignore"):
            for step in range(steps + 1):
                sin_l, cos_l = np.sin(lam), np.cos(lam)
                sin_s = np.hypot(cu2 * sin_l, cu1 * su2 - su1 * cu2 * cos_l)
                cos_s = su1 * su2 + cu1 * cu2 * cos_l
                sigma = np.arctan2(sin_s, cos_s)
                sin_a = np.where(sin_s > 0, cu1 * cu2 * sin_l / sin_s, 0.0)
                cos2a = 1 - sin_a * sin_a
                cos_2m = np.where(cos2a > 1e-15, cos_s - 2 * su1 * su2 / cos2a, 0.0)
                # a settled row keeps its angle, as geodesic() does
                open_rows = ~(np.abs(lam - was) < 1e-15)
                if step == steps or not open_rows.any():
                    break
                c = flat / 16 * cos2a * (4 + flat * (4 - 3 * cos2a))
                following = l + (1 - c) * flat * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (-1 + 2 * cos_2m * cos_2m)))
                lam, was = np.where(open_rows, following, lam), np.where(open_rows, lam, was)
            w = cos2a * (a_axis**2 - b_axis**2) / b_axis**2
            a = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
            b = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
            excess = b * sin_s * (cos_2m + b / 4 * (cos_s * (-1 + 2 * cos_2m * cos_2m) - b / 6 * cos_2m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * cos_2m * cos_2m)))
            distance = b_axis * a * (sigma - excess)
        return pd.Series(np.where(np.abs(lam - was) < 1e-10, distance, (2 * a_axis + b_axis) / 3 * sigma))

    return F.pandas_udf(measured, DoubleType(), F.PandasUDFType.SCALAR)(lat1, lon1, lat2, lon2)


def geodesic_offset(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(east, north) metres by distance and initial bearing; azimuthal equidistant coordinates at the first point."""
    return let(geodesic(lat1, lon1, lat2, lon2), lambda g: F.struct((g["distance"] * F.sin(g["azimuth"])).alias("east"), (g["distance"] * F.cos(g["azimuth"])).alias("north")))


def geodesic_move(lat: Column, lon: Column, east: Column, north: Column) -> Column:
    """G4, G2 inverse: struct(lat, lon) after going the distance and direction of (east, north); crosses the date line."""
    start = {"u1": F.atan((1 - FLAT) * F.tan(lat * RAD)), "az": F.atan2(east, north), "s": F.hypot(east, north)}

    def parts(p: Column) -> Column:
        su, cu = F.sin(p["u1"]), F.cos(p["u1"])
        sin_a = cu * F.sin(p["az"])
        a, b = _series((1 - sin_a * sin_a) * (A * A - B * B) / (B * B))
        return let_all({"su": su, "cu": cu, "saz": F.sin(p["az"]), "caz": F.cos(p["az"]), "s1": F.atan2(F.tan(p["u1"]), F.cos(p["az"])), "sin_a": sin_a, "bs": p["s"] / (B * a), "b": b}, solve)

    def solve(p: Column) -> Column:
        def step(sigma: Column, _: Column) -> Column:
            return let(F.cos(2 * p["s1"] + sigma), lambda c: p["bs"] + _delta_sigma(p["b"], F.sin(sigma), F.cos(sigma), c))

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), p["bs"], step), lambda s: place(p, s))

    def place(p: Column, s: Column) -> Column:
        ss, cs = F.sin(s), F.cos(s)
        x = p["su"] * ss - p["cu"] * cs * p["caz"]
        to_lat = F.atan2(p["su"] * cs + p["cu"] * ss * p["caz"], (1 - FLAT) * F.sqrt(p["sin_a"] * p["sin_a"] + x * x))
        lam = F.atan2(ss * p["saz"], p["cu"] * cs - p["su"] * ss * p["caz"])
        cos2a = 1 - p["sin_a"] * p["sin_a"]
        c = FLAT / 16 * cos2a * (4 + FLAT * (4 - 3 * cos2a))
        cos_2m = F.cos(2 * p["s1"] + s)
        turn = lam - (1 - c) * FLAT * p["sin_a"] * (s + c * ss * (cos_2m + c * cs * (-1 + 2 * cos_2m * cos_2m)))
        return F.struct((to_lat / RAD).alias("lat"), unwrap_lon(lon + turn / RAD, F.lit(0.0)).alias("lon"))

    return let_all(start, parts)


# fixed systems ---------------------------------------------------------------

#: Ellipsoids (half axis, squared eccentricity) and shifts to WGS84.
BESSEL = (6377397.155, 0.006674372230614)
GRS80 = (6378137.0, 0.00669438002290)
AIRY = (6377563.396, 0.00667054000123428)
WGS84 = (A, E2)
SHIFT_2056 = (674.374, 15.056, 405.346)
SHIFT_27700 = (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)


def _to_xyz(lat: Column, lon: Column, ell: tuple[float, float], then) -> Column:
    n = ell[0] / F.sqrt(1 - ell[1] * F.pow(F.sin(lat * RAD), F.lit(2.0)))
    return let(n, lambda v: let_all({"x": v * F.cos(lat * RAD) * F.cos(lon * RAD), "y": v * F.cos(lat * RAD) * F.sin(lon * RAD), "z": v * (1 - ell[1]) * F.sin(lat * RAD)}, then))


def _from_xyz(p: Column, ell: tuple[float, float], then) -> Column:
    """Geodetic latitude by fixed-point steps from geocentric places; heights are dropped."""
    flat = F.hypot(p["x"], p["y"])

    def step(lat: Column, _: Column) -> Column:
        n = ell[0] / F.sqrt(1 - ell[1] * F.sin(lat) * F.sin(lat))
        return F.atan2(p["z"] + ell[1] * n * F.sin(lat), flat)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.atan2(p["z"], flat * (1 - ell[1])), step)
    return let_all({"lat": lat, "lon": F.atan2(p["y"], p["x"])}, then)


def _shifted(p: Column, s: tuple[float, ...], back: bool) -> dict[str, Column]:
    sign = -1 if back else 1
    x, y, z = p["x"], p["y"], p["z"]
    if len(s) == 3:
        return {"x": x + sign * s[0], "y": y + sign * s[1], "z": z + sign * s[2]}
    r = math.pi / 180 / 3600
    rx, ry, rz, k = sign * s[3] * r, sign * s[4] * r, sign * s[5] * r, 1 + sign * s[6] * 1e-6
    return {"x": sign * s[0] + k * (x - rz * y + ry * z), "y": sign * s[1] + k * (rz * x + y - rx * z), "z": sign * s[2] + k * (-ry * x + rx * y + z)}


def _swiss() -> dict[str, float]:
    a, e2 = BESSEL
    phi0, lam0 = (46 + 57 / 60 + 8.66 / 3600) * RAD, (7 + 26 / 60 + 22.5 / 3600) * RAD
    e = math.sqrt(e2)
    alpha = math.sqrt(1 + e2 / (1 - e2) * math.cos(phi0) ** 4)
    b0 = math.asin(math.sin(phi0) / alpha)
    r = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(phi0) ** 2)
    k = math.log(math.tan(math.pi / 4 + b0 / 2)) - alpha * math.log(math.tan(math.pi / 4 + phi0 / 2)) + alpha * e / 2 * math.log((1 + e * math.sin(phi0)) / (1 - e * math.sin(phi0)))
    return {"lam0": lam0, "e": e, "alpha": alpha, "b0": b0, "r": r, "k": k}


def lv95_to_wgs84(x: Column, y: Column) -> Column:
    """G1: struct(lat, lon) of EPSG 2056: oblique cylinder on a sphere, then a shift of three parameters."""
    c = _swiss()
    bb, ll = 2 * (F.atan(F.exp((y - 1200000.0) / c["r"])) - math.pi / 4), (x - 2600000.0) / c["r"]

    def ball(s: Column) -> Column:
        b = F.asin(math.cos(c["b0"]) * F.sin(s["bb"]) + math.sin(c["b0"]) * F.cos(s["bb"]) * F.cos(s["ll"]))
        lam = F.atan2(F.sin(s["ll"]), math.cos(c["b0"]) * F.cos(s["ll"]) - math.sin(c["b0"]) * F.tan(s["bb"]))
        return let_all({"b": b, "lon": c["lam0"] + lam / c["alpha"]}, ellipsoid)

    def ellipsoid(s: Column) -> Column:
        def step(phi: Column, _: Column) -> Column:
            sn = c["e"] * F.sin(phi)
            q = (F.log(F.tan(math.pi / 4 + s["b"] / 2)) - c["k"]) / c["alpha"] + c["e"] / 2 * F.log((1 + sn) / (1 - sn))
            return 2 * F.atan(F.exp(q)) - math.pi / 2

        lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), s["b"], step)
        return let(lat, lambda v: _to_xyz(v / RAD, s["lon"] / RAD, BESSEL, lambda p: let_all(_shifted(p, SHIFT_2056, False), lambda q: _from_xyz(q, WGS84, _degrees))))

    return let_all({"bb": bb, "ll": ll}, ball)


def _degrees(s: Column) -> Column:
    return F.struct((s["lat"] / RAD).alias("lat"), (s["lon"] / RAD).alias("lon"))


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def wgs84_to_lv95(lat: Column, lon: Column) -> Column:
    """G1: struct(x, y) of EPSG 2056."""
    c = _swiss()

    def project(s: Column) -> Column:
        sn = c["e"] * F.sin(s["lat"])
        q = c["alpha"] * F.log(F.tan(math.pi / 4 + s["lat"] / 2)) - c["alpha"] * c["e"] / 2 * F.log((1 + sn) / (1 - sn)) + c["k"]
        return let_all({"b": 2 * (F.atan(F.exp(q)) - math.pi / 4), "l": c["alpha"] * (s["lon"] - c["lam0"])}, turn)

    def turn(s: Column) -> Column:
        ll = F.atan2(F.sin(s["l"]), math.sin(c["b0"]) * F.tan(s["b"]) + math.cos(c["b0"]) * F.cos(s["l"]))
        sine = math.cos(c["b0"]) * F.sin(s["b"]) - math.sin(c["b0"]) * F.cos(s["b"]) * F.cos(s["l"])
        return _xy(2600000.0 + c["r"] * ll, 1200000.0 + c["r"] / 2 * F.log((1 + sine) / (1 - sine)))

    return _to_xyz(lat, lon, WGS84, lambda p: let_all(_shifted(p, SHIFT_2056, True), lambda q: _from_xyz(q, BESSEL, project)))


def _lambert() -> dict[str, float]:
    a, e2 = GRS80
    e = math.sqrt(e2)
    p0, p1, p2 = 46.5 * RAD, 44 * RAD, 49 * RAD
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return {"e": e, "n": n, "af": a * f, "r0": a * f * t(p0) ** n}


def wgs84_to_lambert93(lat: Column, lon: Column) -> Column:
    """G1: struct(x, y) of EPSG 2154, a conformal cone; its datum is taken as WGS84."""
    c = _lambert()

    def project(s: Column) -> Column:
        sn = c["e"] * F.sin(s["lat"])
        t = F.tan(math.pi / 4 - s["lat"] / 2) / F.pow((1 - sn) / (1 + sn), F.lit(c["e"] / 2))
        rho, th = c["af"] * F.pow(t, F.lit(c["n"])), c["n"] * (s["lon"] - 3 * RAD)
        return _xy(700000.0 + rho * F.sin(th), 6600000.0 + c["r0"] - rho * F.cos(th))

    return let_all({"lat": lat * RAD, "lon": lon * RAD}, project)


def lambert93_to_wgs84(x: Column, y: Column) -> Column:
    """G1: struct(lat, lon) of EPSG 2154."""
    c = _lambert()

    def back(s: Column) -> Column:
        def step(phi: Column, _: Column) -> Column:
            sn = c["e"] * F.sin(phi)
            return math.pi / 2 - 2 * F.atan(s["t"] * F.pow((1 - sn) / (1 + sn), F.lit(c["e"] / 2)))

        lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), math.pi / 2 - 2 * F.atan(s["t"]), step)
        return F.struct((lat / RAD).alias("lat"), (3 + s["th"] / c["n"] / RAD).alias("lon"))

    east, north = x - 700000.0, c["r0"] - (y - 6600000.0)
    return let_all({"t": F.pow(F.hypot(east, north) / c["af"], F.lit(1 / c["n"])), "th": F.atan2(east, north)}, back)


BNG = {"f0": 0.9996012717, "lat0": 49 * RAD, "lon0": -2 * RAD, "e0": 400000.0, "n0": -100000.0}


def _meridian(lat: Column) -> Column:
    a, e2 = AIRY
    b = a * math.sqrt(1 - e2)
    n = (a - b) / (a + b)
    d, s = lat - BNG["lat0"], lat + BNG["lat0"]
    return b * BNG["f0"] * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
                            + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s))


def bng_to_wgs84(x: Column, y: Column) -> Column:
    """G1: struct(lat, lon) of EPSG 27700: transverse Mercator and seven parameters; metre level, for lack of the shift grid."""
    a, e2 = AIRY

    def step(phi: Column, _: Column) -> Column:
        return phi + (y - BNG["n0"] - _meridian(phi)) / (a * BNG["f0"])

    lat0 = F.aggregate(F.sequence(F.lit(1), F.lit(8)), BNG["lat0"] + (y - BNG["n0"]) / (a * BNG["f0"]), step)

    def series(phi: Column) -> Column:
        w = 1 - e2 * F.sin(phi) * F.sin(phi)
        nu, t = a * BNG["f0"] / F.sqrt(w), F.tan(phi)
        return let_all({"phi": phi, "nu": nu, "rho": nu * (1 - e2) / w, "t": t, "sec": 1 / F.cos(phi), "de": x - BNG["e0"]}, back)

    def back(s: Column) -> Column:
        t, nu, rho, d = s["t"], s["nu"], s["rho"], s["de"]
        eta = nu / rho - 1
        t2 = t * t
        vii, viii = t / (2 * rho * nu), t / (24 * rho * nu**3) * (5 + 3 * t2 + eta - 9 * t2 * eta)
        ix = t / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2 * t2)
        x1, xi = s["sec"] / nu, s["sec"] / (6 * nu**3) * (nu / rho + 2 * t2)
        xii, xiia = s["sec"] / (120 * nu**5) * (5 + 28 * t2 + 24 * t2 * t2), s["sec"] / (5040 * nu**7) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2)
        return let_all({"lat": (s["phi"] - vii * d**2 + viii * d**4 - ix * d**6) / RAD, "lon": (BNG["lon0"] + x1 * d - xi * d**3 + xii * d**5 - xiia * d**7) / RAD},
                       lambda q: _to_xyz(q["lat"], q["lon"], AIRY, lambda p: let_all(_shifted(p, SHIFT_27700, False), lambda r: _from_xyz(r, WGS84, _degrees))))

    return let(lat0, series)


def wgs84_to_bng(lat: Column, lon: Column) -> Column:
    """G1: struct(x, y) of EPSG 27700, to a metre or few."""
    a, e2 = AIRY

    def series(s: Column) -> Column:
        w = 1 - e2 * F.sin(s["lat"]) * F.sin(s["lat"])
        nu = a * BNG["f0"] / F.sqrt(w)
        return let_all({"lat": s["lat"], "nu": nu, "rho": nu * (1 - e2) / w, "sn": F.sin(s["lat"]), "c": F.cos(s["lat"]), "d": s["lon"] - BNG["lon0"]}, project)

    def project(s: Column) -> Column:
        nu, c, sn, d = s["nu"], s["c"], s["sn"], s["d"]
        eta, t2 = nu / s["rho"] - 1, sn * sn / (c * c)
        north = (_meridian(s["lat"]) + BNG["n0"] + nu / 2 * sn * c * d**2 + nu / 24 * sn * c**3 * (5 - t2 + 9 * eta) * d**4 + nu / 720 * sn * c**5 * (61 - 58 * t2 + t2 * t2) * d**6)
        east = BNG["e0"] + nu * c * d + nu / 6 * c**3 * (nu / s["rho"] - t2) * d**3 + nu / 120 * c**5 * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) * d**5
        return _xy(east, north)

    return _to_xyz(lat, lon, WGS84, lambda p: let_all(_shifted(p, SHIFT_27700, True), lambda q: _from_xyz(q, AIRY, series)))


FROM_CRS = {2056: lv95_to_wgs84, 2154: lambert93_to_wgs84, 27700: bng_to_wgs84}
TO_CRS = {2056: wgs84_to_lv95, 2154: wgs84_to_lambert93, 27700: wgs84_to_bng}


def to_crs(lon: Column, lat: Column, epsg: int) -> Column:
    """G1: struct(x, y), x always to the east; 4326 is (lon, lat) itself."""
    return _xy(lon, lat) if epsg == 4326 else TO_CRS[epsg](lat, lon)


def from_crs(x: Column, y: Column, epsg: int) -> Column:
    """G1: struct(lat, lon)."""
    return F.struct(y.alias("lat"), x.alias("lon")) if epsg == 4326 else FROM_CRS[epsg](x, y)


def true_north_basis(x: Column, y: Column, lat: Column, lon: Column, epsg: int) -> Column:
    """struct(ee, en, ne, nn): unit east and north axes in a frame, from a point 10 m to the north."""

    def axes(q: Column) -> Column:
        dx, dy = q["x"] - x, q["y"] - y
        return let(F.hypot(dx, dy), lambda r: F.struct((dy / r).alias("ee"), (-dx / r).alias("en"), (dx / r).alias("ne"), (dy / r).alias("nn")))

    return let(geodesic_move(lat, lon, F.lit(0.0), F.lit(10.0)), lambda p: let(to_crs(p["lon"], p["lat"], epsg), axes))


def frame_offset(basis: Column, east: Column, north: Column) -> Column:
    """struct(x, y) displacement in the frame of a displacement along true east and north."""
    return _xy(basis["ee"] * east + basis["ne"] * north, basis["en"] * east + basis["nn"] * north)


def render_azimuth(basis: Column, azimuth: Column) -> Column:
    """An azimuth from true north, counted from the frame's north."""
    return azimuth + F.atan2(basis["ne"], basis["nn"])
