"""Geometry as Column expressions; degrees in, metres out. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymill import model as m


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * m.EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial azimuth in radians."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def bearing_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.pmod(F.degrees(bearing(lon1, lat1, lon2, lat2)) + 360, F.lit(360.0))


def cross_track(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance of a point from the whole great circle through two others."""
    away = haversine(lon1, lat1, lon, lat) / m.EARTH_M
    turn = bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2)
    return F.abs(F.asin(F.sin(away) * F.sin(turn))) * m.EARTH_M


def speed_kmh(metres: Column, seconds: Column) -> Column:
    """Times that don't advance count as one second."""
    return metres / F.when(seconds <= 0, F.lit(1.0)).otherwise(seconds) * 3.6


def ban_cell(lon: Column, lat: Column) -> Column:
    """The 50 m cell of a point: rows by latitude, half-even rounding."""
    y = F.rint(lat * m.CELL_DEGREE_M / m.CELL_M)
    x = F.rint(lon * m.CELL_DEGREE_M * F.cos(F.radians(lat)) / m.CELL_M)
    return F.struct(y.cast("long").alias("y"), x.cast("long").alias("x"))


def ban_key(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.struct(ban_cell(lon1, lat1).alias("a"), ban_cell(lon2, lat2).alias("b"))


def reachable(metres: Column, seconds: Column, need: Column | None = None) -> Column:
    """Whether a step can be driven; ``need`` is the ban's least time, or null."""
    ok = (seconds >= 0) & (metres <= F.lit(m.CHAIN_KMH / 3.6) * seconds + m.CHAIN_SLACK_M)
    return ok if need is None else ok & ~F.coalesce(seconds < need, F.lit(False))


def near(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine(lon1, lat1, lon2, lat2) <= m.DUAL_NEAR_M


def same_spot(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return (F.abs(lon1 - lon2) < m.SAME_SPOT_DEG) & (F.abs(lat1 - lat2) < m.SAME_SPOT_DEG)


def span(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Diagonal of a bounding box."""
    return haversine(min_lon, min_lat, max_lon, max_lat)


def lateral_g(d1: Column, d2: Column, d3: Column, t1: Column, t2: Column) -> Column:
    """Sideways acceleration in g over two legs (d3: straight from end to end);
    null where it isn't judged, 0 on a straight line."""
    v = (d1 + d2) / (t1 + t2)
    s = (d1 + d2 + d3) / 2
    square = s * (s - d1) * (s - d2) * (s - d3)
    area = F.sqrt(F.greatest(square, F.lit(0.0)))
    judged = (F.least(d1, d2) >= m.LATERAL_LEG_M) & (t1 > 0) & (t2 > 0) & (v * 3.6 >= m.LATERAL_KMH)
    radius = d1 * d2 * d3 / (4 * area)
    bent = F.when((square <= 0) | (area < 1e-6), F.lit(0.0)).when(radius > 1e-6, v * v / radius / m.GRAVITY)
    return F.when(judged, bent)


def coordinate_key(lon: Column, lat: Column) -> Column:
    """``lon,lat`` with five decimals, the key of router look-ups. The double itself is
    rounded, as ``%.5f`` does in C, Go and Python: ``format_string`` rounds the shortest
    decimal that names it, which can lie on the other side of a half."""
    five = lambda c: F.coalesce(F.call_function("format_number", c.cast("double"), F.lit("0.00000")), F.lit("null"))
    return F.concat_ws(",", five(lon), five(lat))


def snap_weight(snap: Column, sigma: Column) -> Column:
    """From 1 on the road to -1 far off it; 0 where the router was silent."""
    sigma = F.when(sigma <= 0, F.lit(m.SIGMA_M)).otherwise(sigma)
    return F.coalesce(2 * F.exp(-(snap * snap) / (2 * sigma * sigma)) - 1, F.lit(0.0))


def sigma_of(median_snap: Column) -> Column:
    return F.coalesce(F.least(F.greatest(median_snap * m.SIGMA_FACTOR, F.lit(m.SIGMA_MIN_M)), F.lit(m.SIGMA_MAX_M)), F.lit(m.SIGMA_M))


def fill_verdict(route_m: Column, line_m: Column, seconds: Column) -> Column:
    """What becomes of a gap: accepted, detour, physics or no route."""
    ratio = route_m / F.nullif(line_m, F.lit(0.0))
    return (
        F.when(route_m.isNull(), "no route")
        .when(ratio <= m.FREE_DETOUR, "accepted")
        .when(ratio > m.MOST_DETOUR, "detour")
        .when(route_m > seconds * m.FILL_KMH / 3.6 + m.FILL_SLACK_M, "physics")
        .otherwise("accepted")
    )


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a ring of (lon, lat) corners."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        crosses = ((lat < y1) != (lat < y2)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
        inside = inside != crosses
    return inside
