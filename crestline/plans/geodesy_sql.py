"""Geodesics and the Swiss system as SQL, for the queries' comparison: each takes a relation and adds columns by nested selections."""

from __future__ import annotations

from ..functions.geodesy import BESSEL, SHIFT_2056, WGS84, _swiss

# WGS84: semi-axes and flattening, fixed values
AXIS_A, FLAT = 6378137.0, 1 / 298.257223563
AXIS_B = AXIS_A * (1 - FLAT)
SERIES_SQL = """1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS aa, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS bb"""


def excess_sql(cm: str) -> str:
    """Vincenty's correction of the arc with sine ss and cosine cs about the middle cm."""
    return f"bb * ss * ({cm} + bb / 4 * (cs * (2 * {cm} * {cm} - 1) - bb / 6 * {cm} * (4 * ss * ss - 3) * (4 * {cm} * {cm} - 3)))"


def vincenty_sql(src: str, steps: int = 8) -> str:
    """src (lat0, lon0, lat1, lon1 in degrees) with distance: metres along the ellipsoid, by that many steps of Vincenty's iteration."""
    found = f"""SELECT *, lam0 AS lam FROM (SELECT *, radians(lon1 - lon0) AS lam0, atan((1 - {FLAT!r}) * tan(radians(lat0))) AS ua, atan((1 - {FLAT!r}) * tan(radians(lat1))) AS ub FROM {src})"""
    for k in range(steps + 1):
        angles = f"""SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(ua) * cos(ub) * sin(lam) / ss END AS sa
          FROM (SELECT *, sqrt(power(cos(ub) * sin(lam), 2) + power(cos(ua) * sin(ub) - sin(ua) * cos(ub) * cos(lam), 2)) AS ss, sin(ua) * sin(ub) + cos(ua) * cos(ub) * cos(lam) AS cs FROM ({found}))"""
        angles = f"SELECT *, cs - 2 * sin(ua) * sin(ub) / (1 - sa * sa) AS cm, {FLAT!r} / 16 * (1 - sa * sa) * (4 + {FLAT!r} * (4 - 3 * (1 - sa * sa))) AS cc FROM ({angles})"
        if k < steps:
            found = f"SELECT * EXCLUDE (lam, ss, cs, sg, sa, cm, cc), lam0 + (1 - cc) * {FLAT!r} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM ({angles})"
    return f"""SELECT *, {AXIS_B!r} * aa * (sg - {excess_sql('cm')}) AS distance
      FROM (SELECT *, {SERIES_SQL} FROM (SELECT *, (1 - sa * sa) * {(AXIS_A**2 - AXIS_B**2) / AXIS_B**2!r} AS w FROM ({angles})))"""


def offset_sql(src: str) -> str:
    """src (lat0, lon0, lat1, lon1) with east and north: distance and first bearing of the geodesic."""
    return f"""SELECT *, distance * sin(bearing) AS east, distance * cos(bearing) AS north
      FROM (SELECT *, atan2(cos(ub) * sin(lam), cos(ua) * sin(ub) - sin(ua) * cos(ub) * cos(lam)) AS bearing FROM ({vincenty_sql(src)}))"""


def move_sql(src: str, steps: int = 8) -> str:
    """src (lat0, lon0, e, n) with lat1, lon1: where the geodesic of that length and bearing ends."""
    start = f"""SELECT *, atan2(tan(ua), cos(az)) AS s1, cos(ua) * sin(az) AS sa FROM (SELECT *, atan((1 - {FLAT!r}) * tan(radians(lat0))) AS ua, atan2(e, n) AS az, sqrt(e * e + n * n) AS way FROM {src})"""
    start = f"SELECT *, {SERIES_SQL} FROM (SELECT *, (1 - sa * sa) * {(AXIS_A**2 - AXIS_B**2) / AXIS_B**2!r} AS w FROM ({start}))"
    found = f"SELECT *, way / ({AXIS_B!r} * aa) AS sg FROM ({start})"
    for _ in range(steps):
        angles = f"SELECT *, sin(sg) AS ss, cos(sg) AS cs, cos(2 * s1 + sg) AS cm FROM ({found})"
        found = f"SELECT * EXCLUDE (sg, ss, cs, cm), way / ({AXIS_B!r} * aa) + {excess_sql('cm')} AS sg FROM ({angles})"
    ended = f"SELECT *, sin(sg) AS ss, cos(sg) AS cs, cos(2 * s1 + sg) AS cm, {FLAT!r} / 16 * (1 - sa * sa) * (4 + {FLAT!r} * (4 - 3 * (1 - sa * sa))) AS cc FROM ({found})"
    placed = f"""SELECT *, degrees(atan2(sin(ua) * cs + cos(ua) * ss * cos(az), {1 - FLAT!r} * sqrt(sa * sa + power(sin(ua) * ss - cos(ua) * cs * cos(az), 2)))) AS lat1,
      lon0 + degrees(atan2(ss * sin(az), cos(ua) * cs - sin(ua) * ss * cos(az)) - (1 - cc) * {FLAT!r} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))) AS far FROM ({ended})"""
    return f"SELECT * EXCLUDE (far, w, aa, bb, sg, ss, cs, cm, cc, ua, sa, s1, az, way), far - 360 * round_even(far / 360, 0) AS lon1 FROM ({placed})"


def geodetic_sql(src: str, ell: tuple[float, float], steps: int = 8) -> str:
    """src with geocentric gx, gy, gz, and phi, lam on that ellipsoid, in radians."""
    found = f"SELECT *, atan2(gy, gx) AS lam, atan2(gz, sqrt(gx * gx + gy * gy) * {1 - ell[1]!r}) AS phi FROM ({src})"
    for _ in range(steps):
        found = f"SELECT * EXCLUDE (phi), atan2(gz + {ell[1]!r} * {ell[0]!r} / sqrt(1 - {ell[1]!r} * sin(phi) * sin(phi)) * sin(phi), sqrt(gx * gx + gy * gy)) AS phi FROM ({found})"
    return found


def geocentric_sql(src: str, ell: tuple[float, float], shift: tuple[float, ...], sign: int) -> str:
    """src (phi, lam on that ellipsoid) with gx, gy, gz, shifted; phi and lam go."""
    return f"""SELECT * EXCLUDE (phi, lam, nu), nu * cos(phi) * cos(lam) + {sign * shift[0]!r} AS gx, nu * cos(phi) * sin(lam) + {sign * shift[1]!r} AS gy, nu * {1 - ell[1]!r} * sin(phi) + {sign * shift[2]!r} AS gz
      FROM (SELECT *, {ell[0]!r} / sqrt(1 - {ell[1]!r} * sin(phi) * sin(phi)) AS nu FROM ({src}))"""


def from_lv95_sql(src: str, steps: int = 8) -> str:
    """src (x, y of EPSG 2056) with lat, lon in degrees."""
    c = _swiss()
    e = c["e"]
    found = f"SELECT *, 2 * atan(exp((y - 1200000.0) / {c['r']!r})) - pi() / 2 AS b1, (x - 2600000.0) / {c['r']!r} AS l1 FROM {src}"
    found = f"""SELECT *, asin(cos({c['b0']!r}) * sin(b1) + sin({c['b0']!r}) * cos(b1) * cos(l1)) AS b,
      {c['lam0']!r} + atan2(sin(l1), cos({c['b0']!r}) * cos(l1) - sin({c['b0']!r}) * tan(b1)) / {c['alpha']!r} AS lam FROM ({found})"""
    found = f"SELECT * EXCLUDE (b1, l1), b AS phi FROM ({found})"
    for _ in range(steps):
        found = f"SELECT * EXCLUDE (phi), 2 * atan(exp((ln(tan(pi() / 4 + b / 2)) - {c['k']!r}) / {c['alpha']!r} + {e / 2!r} * ln((1 + {e!r} * sin(phi)) / (1 - {e!r} * sin(phi))))) - pi() / 2 AS phi FROM ({found})"
    placed = geodetic_sql(geocentric_sql(found, BESSEL, SHIFT_2056, 1), WGS84)
    return f"SELECT * EXCLUDE (b, phi, lam, gx, gy, gz), degrees(phi) AS lat, degrees(lam) AS lon FROM ({placed})"


def to_lv95_sql(src: str, lat: str, lon: str) -> str:
    """src with x1, y1 of EPSG 2056 for the columns lat and lon in degrees."""
    c = _swiss()
    e = c["e"]
    found = geodetic_sql(geocentric_sql(f"SELECT *, radians({lat}) AS phi, radians({lon}) AS lam FROM {src}", WGS84, SHIFT_2056, -1), BESSEL)
    found = f"""SELECT *, {c['alpha']!r} * (lam - {c['lam0']!r}) AS l,
      2 * atan(exp({c['alpha']!r} * ln(tan(pi() / 4 + phi / 2)) - {c['alpha'] * e / 2!r} * ln((1 + {e!r} * sin(phi)) / (1 - {e!r} * sin(phi))) + {c['k']!r})) - pi() / 2 AS b FROM ({found})"""
    found = f"SELECT *, cos({c['b0']!r}) * sin(b) - sin({c['b0']!r}) * cos(b) * cos(l) AS sine FROM ({found})"
    return f"""SELECT * EXCLUDE (phi, lam, gx, gy, gz, l, b, sine), 2600000.0 + {c['r']!r} * atan2(sin(l), sin({c['b0']!r}) * tan(b) + cos({c['b0']!r}) * cos(l)) AS x1,
      1200000.0 + {c['r'] / 2!r} * ln((1 + sine) / (1 - sine)) AS y1 FROM ({found})"""
