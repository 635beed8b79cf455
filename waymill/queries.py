"""Registered queries over the track view and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo
from waymill.functions import kernels as k
from waymill.operators import sequence as s
from waymill.plans import engine, track
from waymill.plans.roads import AnalyticRoads, Route
from waymill.plans.shared import shared_path
from waymill.sources import codec
from waymill.sources.events import VIEW_SQL, track_view
from waymill.streaming import tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(track_view(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _hav(a: str, b: str) -> str:
    """Distance of two aliased points in SQL."""
    return _hav4(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


def _hav4(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2))"
    return f"({2 * m.EARTH_M} * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0))))"


def _bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d = f"radians({lon2} - {lon1})"
    return f"atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))"


#: v, and st: each point with the one before it (p...) and after it (n...).
_STEPS = f"""{VIEW_SQL}, l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t_us) OVER w AS pt, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(t_us) OVER w AS nt FROM v WINDOW w AS (PARTITION BY track_id ORDER BY t_us, seq)),
st AS (SELECT *, {_hav4("plon", "plat", "lon", "lat")} AS step_m, (t_us - pt) / 1e6 AS dt_s, {_hav4("lon", "lat", "nlon", "nlat")} AS next_m, (nt - t_us) / 1e6 AS next_s FROM l)"""


def _r(c: str, n: int = 3):
    return F.round(c, n).alias(c)


@query("track_length", f"WITH {_STEPS} SELECT track_id, count(*) AS points, round(coalesce(sum(step_m), 0), 3) AS length_m FROM st GROUP BY 1")
def _(v):
    return s.lengths(v).select("track_id", "points", _r("length_m"))


@query("track_bbox_span", f"WITH {VIEW_SQL} SELECT track_id, round({_hav4('min(lon)', 'min(lat)', 'max(lon)', 'max(lat)')}, 3) AS span_m FROM v GROUP BY 1")
def _(v):
    return s.spans(v).select("track_id", _r("span_m"))


@query("sort_by_time", f"WITH {VIEW_SQL} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t_us // 600000000, 100000 - seq) - 1 AS INTEGER) AS seq, 100000 - seq AS input_seq FROM v")
def _(v):
    """Ten-minute times and reversed input, so that ties must keep the input's order."""
    v = v.withColumns({"t_us": F.floor(F.col("t_us") / 600_000_000).cast("long"), "seq": F.lit(100_000) - F.col("seq")})
    return s.sorted_points(v).select("track_id", "seq", "input_seq")


@query("bearing_steps", f"WITH {_STEPS} SELECT track_id, seq, round((degrees({_bearing('lon', 'lat', 'nlon', 'nlat')}) + 360) % 360, 6) AS bearing_deg FROM st WHERE nlon IS NOT NULL")
def _(v):
    return s.bearings(v).where("bearing_deg is not null").select("track_id", "seq", _r("bearing_deg", 6))


@query(
    "cross_track",
    f"WITH {_STEPS} SELECT track_id, seq, round(abs(asin(sin(step_m / {m.EARTH_M}) * sin({_bearing('plon', 'plat', 'lon', 'lat')} - ({_bearing('plon', 'plat', 'nlon', 'nlat')})))) * {m.EARTH_M}, 3) AS off_m FROM st WHERE plon IS NOT NULL AND nlon IS NOT NULL",
)
def _(v):
    return s.cross_tracks(v).where("off_m is not null").select("track_id", "seq", _r("off_m"))


@query("ban_cells", f"WITH {VIEW_SQL} SELECT track_id, seq, CAST(round_even(lat * {m.CELL_DEGREE_M} / {m.CELL_M}, 0) AS BIGINT) AS y, CAST(round_even(lon * {m.CELL_DEGREE_M} * cos(radians(lat)) / {m.CELL_M}, 0) AS BIGINT) AS x FROM v")
def _(v):
    return v.select("track_id", "seq", geo.ban_cell(F.col("lon"), F.col("lat")).alias("c")).select("track_id", "seq", "c.y", "c.x")


_REACH = f"next_s >= 0 AND next_m <= {m.CHAIN_KMH} / 3.6 * next_s + {m.CHAIN_SLACK_M}"


@query("reachable_steps", f"WITH {_STEPS} SELECT track_id, seq, ({_REACH}) AS reachable FROM st WHERE nlon IS NOT NULL")
def _(v):
    p = s.steps(v).where("step_m is not null")
    return p.select("track_id", (F.col("seq") - 1).alias("seq"), geo.reachable(F.col("step_m"), F.col("dt_s")).alias("reachable"))


@query("speed_steps", f"WITH {_STEPS} SELECT track_id, seq, round(step_m / CASE WHEN dt_s <= 0 THEN 1 ELSE dt_s END * 3.6, 3) AS kmh FROM st WHERE plon IS NOT NULL")
def _(v):
    return s.steps(v).where("step_m is not null").select("track_id", "seq", F.round(geo.speed_kmh(F.col("step_m"), F.col("dt_s")), 3).alias("kmh"))


_AREA = "(d1 + d2 + d3) / 2 * ((d1 + d2 + d3) / 2 - d1) * ((d1 + d2 + d3) / 2 - d2) * ((d1 + d2 + d3) / 2 - d3)"


@query(
    "lateral_g",
    f"""WITH {_STEPS}, a AS (SELECT track_id, seq, step_m AS d1, next_m AS d2, {_hav4("plon", "plat", "nlon", "nlat")} AS d3, dt_s AS t1, next_s AS t2 FROM st WHERE plon IS NOT NULL AND nlon IS NOT NULL),
b AS (SELECT *, (d1 + d2) / (t1 + t2) AS v, {_AREA} AS sq FROM a WHERE t1 > 0 AND t2 > 0)
SELECT track_id, seq, round(CASE WHEN sq <= 0 OR sqrt(greatest(sq, 0)) < 1e-6 THEN 0 ELSE v * v / (d1 * d2 * d3 / (4 * sqrt(greatest(sq, 0)))) / {m.GRAVITY} END, 6) AS g FROM b
WHERE least(d1, d2) >= {m.LATERAL_LEG_M} AND v * 3.6 >= {m.LATERAL_KMH} AND (sq <= 0 OR sqrt(greatest(sq, 0)) < 1e-6 OR d1 * d2 * d3 / (4 * sqrt(greatest(sq, 0))) > 1e-6)""",
)
def _(v):
    # on nearly straight legs the area is rounding noise: six decimals of g hide it
    return s.lateral(v).where("g is not null").select("track_id", "seq", _r("g", 6))


@query("jumps", f"WITH {_STEPS} SELECT track_id, seq FROM st WHERE next_m >= {m.DUAL_JUMP_M} AND next_s >= 0 AND next_m / greatest(next_s, 1) * 3.6 > {m.DUAL_KMH}")
def _(v):
    return s.jumps(v).select("track_id", "seq")


def _parts(cut: str) -> str:
    return f"""{_STEPS}, c AS (SELECT *, sum(CASE WHEN {cut} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_us, seq) AS part FROM st),
i AS (SELECT *, CASE WHEN part = lag(part) OVER (PARTITION BY track_id ORDER BY t_us, seq) THEN step_m ELSE 0 END AS inner_m FROM c),
g AS (SELECT track_id, part, count(*) AS n, min(seq) AS first, max(seq) AS last, min(t_us) AS t0, max(t_us) AS t1, sum(inner_m) AS path_m, arg_min(lon, seq) AS lon0, arg_min(lat, seq) AS lat0, arg_max(lon, seq) AS lon1, arg_max(lat, seq) AS lat1 FROM i GROUP BY 1, 2),
f AS (SELECT *, sum(n) OVER (PARTITION BY track_id) AS total, lag(t1) OVER w AS bt, lag(lon1) OVER w AS blon, lag(lat1) OVER w AS blat, lead(t0) OVER w AS nt0, lead(lon0) OVER w AS alon, lead(lat0) OVER w AS alat FROM g WINDOW w AS (PARTITION BY track_id ORDER BY part))"""


_ISLAND = f"total >= 3 AND n < {m.ISLAND_POINTS} AND t1 - t0 < {m.ISLAND_STAY_S * 1_000_000} AND path_m < {m.ISLAND_PATH_M}"
_ISLANDS = _parts(f"step_m > {m.ISLAND_GAP_M}")


@query("islands", f"WITH {_ISLANDS} SELECT track_id, first, last, n FROM f WHERE {_ISLAND}")
def _(v):
    return s.islands(v).select("track_id", "first", "last", "n")


@query(
    "stubs",
    f"""WITH {_parts(f"step_m >= {m.STUB_GAP_M}")}, x AS (SELECT *, (t1 - t0) / 1e6 AS inside, (coalesce(t0 - bt, 0) + coalesce(nt0 - t1, 0)) / 1e6 AS travel FROM f)
SELECT track_id, first, last, n FROM x WHERE total >= 3 AND travel > 0 AND inside / (inside + travel) <= {m.STUB_TIME} AND path_m < {m.STUB_PATH_M}""",
)
def _(v):
    return s.stubs(v).select("track_id", "first", "last", "n")


@query(
    "lonely",
    f"""WITH {_parts(f"dt_s >= {m.LONELY_S}")}, x AS (SELECT *, least({_hav4("blon", "blat", "lon0", "lat0")}, {_hav4("lon1", "lat1", "alon", "alat")}) AS near, {_hav4("blon", "blat", "alon", "alat")} AS around FROM f WHERE bt IS NOT NULL AND nt0 IS NOT NULL AND n <= {m.LONELY_GROUP})
SELECT track_id, first, last, n FROM x WHERE near >= {m.LONELY_M} AND around < near""",
)
def _(v):
    return s.lonely(v).select("track_id", "first", "last", "n")


@query(
    "hot_spots",
    f"""WITH {_STEPS}, k AS (SELECT *, coalesce((step_m >= {m.JUMP_M} AND dt_s <= {m.JUMP_GAP_S}) OR (next_m >= {m.JUMP_M} AND next_s <= {m.JUMP_GAP_S}), false) AS mark FROM st),
h AS (SELECT track_id, seq, max(mark::INT) OVER (PARTITION BY track_id ORDER BY t_us RANGE BETWEEN {m.JUMP_NEAR_S * 1_000_000} PRECEDING AND {m.JUMP_NEAR_S * 1_000_000} FOLLOWING) = 1 AS hot FROM k) SELECT * FROM h""",
)
def _(v):
    return s.hot(v).select("track_id", "seq", "hot")


_RUSH = f"""r AS (SELECT *, sum(coalesce(step_m, 0)) OVER (PARTITION BY track_id ORDER BY t_us, seq) AS run_m FROM st),
q AS (SELECT *, max(run_m) OVER w - run_m AS path_m, max(t_us) OVER w AS end_us, max(seq) OVER w AS end_seq FROM r WINDOW w AS (PARTITION BY track_id ORDER BY t_us RANGE BETWEEN 0 PRECEDING AND {m.RUSH_S * 1_000_000} FOLLOWING))"""


@query("speed_window", f"WITH {_STEPS}, {_RUSH} SELECT track_id, seq, end_seq, round(path_m, 3) AS path_m FROM q WHERE end_us > t_us AND path_m > (end_us - t_us) / 1e6 * {m.CHAIN_KMH} / 3.6 + {m.CHAIN_SLACK_M}")
def _(v):
    return s.rush(v).select("track_id", "seq", "end_seq", _r("path_m"))


@query(
    "spread_penalty",
    f"""WITH {_ISLANDS}, b AS (SELECT c.track_id, c.seq, c.t_us, coalesce({_ISLAND}, false) AS bad FROM c JOIN f ON f.track_id = c.track_id AND f.part = c.part)
SELECT track_id, seq, max(bad::INT) OVER (PARTITION BY track_id ORDER BY t_us RANGE BETWEEN {m.SPREAD_S * 1_000_000} PRECEDING AND {m.SPREAD_S * 1_000_000} FOLLOWING) = 1 AS spread FROM b""",
)
def _(v):
    bad = s.islands(v).select("track_id", "part", F.lit(True).alias("bad"))
    cut = s.parts(v, F.col("step_m") > m.ISLAND_GAP_M).join(bad, ["track_id", "part"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    return s.spread(cut, "bad").select("track_id", "seq", "spread")


@query("same_second_share", f"WITH {VIEW_SQL} SELECT track_id, seq, count(*) OVER (PARTITION BY track_id, t_us // 60000000) AS sharers FROM v")
def _(v):
    """Times in minutes taken for seconds, so that points share them."""
    return s.same_second(v.withColumn("t_us", F.floor(F.col("t_us") / 60))).select("track_id", "seq", "sharers")


_SIGMA = f"sg AS (SELECT track_id, coalesce(least(greatest(median(snap_m) * {m.SIGMA_FACTOR}, {m.SIGMA_MIN_M}), {m.SIGMA_MAX_M}), {m.SIGMA_M}) AS sigma FROM v GROUP BY 1), wt AS (SELECT v.*, sigma, coalesce(2 * exp(-(snap_m * snap_m) / (2 * sigma * sigma)) - 1, 0) AS raw FROM v JOIN sg USING (track_id))"


@query("sigma_weight", f"WITH {VIEW_SQL}, {_SIGMA} SELECT track_id, any_value(sigma) AS sigma, round(avg(raw), 6) AS mean_weight, count(snap_m) AS answered FROM wt GROUP BY 1")
def _(v):
    return s.weights(v).groupBy("track_id").agg(F.first("sigma").alias("sigma"), F.round(F.avg("raw"), 6).alias("mean_weight"), F.count("snap_m").alias("answered"))


@query(
    "smooth_weight",
    f"""WITH {VIEW_SQL}, {_SIGMA}, j AS (SELECT a.track_id, a.seq, any_value(a.raw) AS raw, median(b.raw) AS smooth FROM wt a JOIN wt b ON a.track_id = b.track_id AND b.seq BETWEEN a.seq - {m.SMOOTH_MOST} AND a.seq + {m.SMOOTH_MOST - 1}
AND (abs(a.seq - b.seq) <= {m.SMOOTH_LEAST} OR abs(a.t_us - b.t_us) <= {m.SMOOTH_S * 1_000_000}) GROUP BY 1, 2) SELECT track_id, seq, round(least(raw, smooth), 6) AS weight FROM j""",
)
def _(v):
    return s.weights(v).select("track_id", "seq", _r("weight", 6))


_GAP = f"next_s >= {m.GAP_S} AND next_m >= {m.GAP_M}"


@query("gaps", f"WITH {_STEPS} SELECT track_id, seq, round(next_s, 3) AS sec, round(next_m, 3) AS line_m FROM st WHERE {_GAP}")
def _(v):
    return s.gaps(v).select("track_id", "seq", _r("sec"), _r("line_m"))


def _verdict(route: str) -> str:
    return f"CASE WHEN {route} IS NULL THEN 'no route' WHEN {route} / next_m <= {m.FREE_DETOUR} THEN 'accepted' WHEN {route} / next_m > {m.MOST_DETOUR} THEN 'detour' WHEN {route} > next_s * {m.FILL_KMH} / 3.6 + {m.FILL_SLACK_M} THEN 'physics' ELSE 'accepted' END"


@query("fill_verdict", f"WITH {_STEPS}, x AS (SELECT *, CASE WHEN seq % 11 = 3 THEN NULL ELSE next_m * (1.1 + seq % 5 * 0.6) END AS route_m FROM st WHERE {_GAP}) SELECT track_id, {_verdict('route_m')} AS verdict, count(*) AS n FROM x GROUP BY 1, 2")
def _(v):
    route = F.when(F.col("seq") % 11 != 3, F.col("line_m") * (F.lit(1.1) + F.col("seq") % 5 * 0.6))
    return s.gaps(v).groupBy("track_id", geo.fill_verdict(route, F.col("line_m"), F.col("sec")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "fill_points",
    f"""WITH {_STEPS}, x AS (SELECT *, (lon + nlon) / 2 AS mlon, (lat + nlat) / 2 + 0.01 AS mlat FROM st WHERE {_GAP}),
y AS (SELECT *, {_hav4("lon", "lat", "mlon", "mlat")} AS a, {_hav4("mlon", "mlat", "nlon", "nlat")} AS b FROM x)
SELECT track_id, seq, CAST(trunc(t_us / 1000 + (nt - t_us) * (a / greatest(a + b, 1)) / 1000) AS BIGINT) AS t_ms, round(mlon, 6) AS lon, round(mlat, 6) AS lat FROM y""",
)
def _(v):
    """The drawn midpoint of every gap, placed in time by its share of the way."""
    g = s.gaps(v).withColumns({"mlon": (F.col("lon") + F.col("b_lon")) / 2, "mlat": (F.col("lat") + F.col("b_lat")) / 2 + 0.01})
    a, b = geo.haversine(F.col("lon"), F.col("lat"), F.col("mlon"), F.col("mlat")), geo.haversine(F.col("mlon"), F.col("mlat"), F.col("b_lon"), F.col("b_lat"))
    t = F.col("t_us") / 1000 + F.col("sec") * 1e6 * (a / F.greatest(a + b, F.lit(1.0))) / 1000
    return g.select("track_id", "seq", t.cast("long").alias("t_ms"), F.round("mlon", 6).alias("lon"), F.round("mlat", 6).alias("lat"))


# ------------------------------------------------------------ order-dependent operators

def _fold(keep: str) -> str:
    """SQL that walks each track once; ``keep`` judges point v against the last
    kept one (f.klon, f.klat, f.kt)."""
    pick = lambda c: f"CASE WHEN {keep} THEN v.{c} ELSE f.k{'t' if c == 't_us' else c} END"
    return f"""WITH RECURSIVE {VIEW_SQL}, f AS (SELECT track_id, seq, lon AS klon, lat AS klat, t_us AS kt, true AS kept FROM v WHERE seq = 0
UNION ALL SELECT v.track_id, v.seq, {pick("lon")}, {pick("lat")}, {pick("t_us")}, {keep} FROM f JOIN v ON v.track_id = f.track_id AND v.seq = f.seq + 1) SELECT track_id, seq FROM f WHERE kept"""


_D = _hav4("f.klon", "f.klat", "v.lon", "v.lat")


@query("dedup", _fold(f"NOT ({_D} < 2000 AND v.t_us - f.kt < 3600000000)"))
def _(v):
    """With 2 km and an hour, since the view has no points within metres."""
    return engine.kept(v, lambda p: k.deduplicate(p, 2000.0, 3600.0)).select("track_id", "seq")


def _walk(more: str, following: str, first: str = "0") -> str:
    """SQL that follows a table x (track_id, seq, nxt) from each track's beginning."""
    return f"WITH RECURSIVE {VIEW_SQL}, {more}, f AS (SELECT track_id, seq, nxt FROM x WHERE seq = {first} UNION ALL SELECT x.track_id, x.seq, x.nxt FROM f JOIN x ON x.track_id = f.track_id AND x.seq = f.nxt) {following}"


_NEAR = "n AS (SELECT track_id, max(seq) AS final FROM v GROUP BY 1), far AS (SELECT a.track_id, a.seq, min(b.seq) AS b FROM v a JOIN v b ON a.track_id = b.track_id AND b.seq > a.seq AND {d} GROUP BY 1, 2)"


@query(
    "collapse_stops",
    _walk(_NEAR.format(d=f"{_hav('a', 'b')} >= 500") + ", x AS (SELECT v.track_id, v.seq, CASE WHEN coalesce(b - 1, final) - v.seq >= 5 THEN coalesce(b - 1, final) ELSE v.seq + 1 END AS nxt FROM v JOIN n USING (track_id) LEFT JOIN far USING (track_id, seq))", "SELECT track_id, seq FROM f"),
)
def _(v):
    """With 500 m, since the view's jitter is larger than 50 m."""
    return engine.kept(v, lambda p: k.collapse_stops(p, 500.0, 5)).select("track_id", "seq")


_STOPS = f"""cs AS (SELECT *, sum(lon) OVER w AS slon, sum(lat) OVER w AS slat FROM v WINDOW w AS (PARTITION BY track_id ORDER BY seq)), n AS (SELECT track_id, max(seq) AS final FROM v GROUP BY 1),
far AS (SELECT a.track_id, a.seq, min(b.seq) AS b FROM cs a JOIN cs c ON a.track_id = c.track_id AND c.seq >= a.seq JOIN v b ON b.track_id = c.track_id AND b.seq = c.seq + 1
WHERE {_hav4("((c.slon - a.slon + a.lon) / (c.seq - a.seq + 1))", "((c.slat - a.slat + a.lat) / (c.seq - a.seq + 1))", "b.lon", "b.lat")} > {m.STOP_RADIUS_M} GROUP BY 1, 2),
y AS (SELECT v.track_id, v.seq, v.t_us, coalesce(b - 1, final) AS last FROM v JOIN n USING (track_id) LEFT JOIN far USING (track_id, seq)),
x AS (SELECT y.track_id, y.seq, y.last, z.t_us - y.t_us >= {m.STOP_STAY_S * 1_000_000} AND y.last > y.seq AS stays, CASE WHEN stays THEN y.last + 1 ELSE y.seq + 1 END AS nxt FROM y JOIN v z ON z.track_id = y.track_id AND z.seq = y.last)"""
_STOP_ROWS = "SELECT f.track_id, f.seq AS first, x.last FROM f JOIN x ON x.track_id = f.track_id AND x.seq = f.seq WHERE x.stays"


@query("find_stops", _walk(_STOPS, f"SELECT *, CAST(last - first + 1 AS BIGINT) AS n FROM ({_STOP_ROWS})"))
def _(v):
    return engine.grouped(v, lambda p, _: [{"first": a, "last": b, "n": b - a + 1} for a, b in k.find_stops(p)], "first int, last int, n long")


@query(
    "stop_facts",
    _walk(
        f"{_STOPS}, pv AS (SELECT *, lag(t_us) OVER (PARTITION BY track_id ORDER BY seq) AS pt FROM v)",
        f"""SELECT track_id, first, last, n, round(stay, 3) AS stay_s, round(gap, 3) AS gap_s, round(span, 3) AS span_m, stay >= {m.TRUST_STAY_S} AND span < {m.FROZEN_SPAN_M} AS frozen FROM
(SELECT s.track_id, first, last, count(*) AS n, (max(t_us) - min(t_us)) / 1e6 AS stay, max(CASE WHEN pv.seq > first THEN t_us - pt END) / 1e6 AS gap, {_hav4("min(lon)", "min(lat)", "max(lon)", "max(lat)")} AS span
FROM ({_STOP_ROWS}) s JOIN pv ON pv.track_id = s.track_id AND pv.seq BETWEEN first AND last GROUP BY 1, 2, 3)""",
    ),
)
def _(v):
    stops = engine.grouped(v, lambda p, _: [{"first": a, "last": b} for a, b in k.find_stops(p)], "first int, last int")
    return s.stop_facts(v, stops).select("track_id", "first", "last", "n", _r("stay_s"), _r("gap_s"), _r("span_m"), "frozen")


_TRUSTED = f"""SELECT s.track_id, first, last, any_value(s.snap) AS snap, (max(t_us) - min(t_us)) / 1e6 AS stay, max(CASE WHEN pv.seq > first THEN t_us - pt END) / 1e6 AS gap, {_hav4("min(lon)", "min(lat)", "max(lon)", "max(lat)")} AS span
FROM (SELECT st.*, v.snap_m AS snap FROM ({_STOP_ROWS}) st JOIN v ON v.track_id = st.track_id AND v.seq = st.first) s JOIN pv ON pv.track_id = s.track_id AND pv.seq BETWEEN first AND last GROUP BY 1, 2, 3"""
_EXITS = f"""SELECT track_id, first, min(kmh) AS kmh FROM (SELECT s.track_id, s.first, {_hav("a", "b")} / greatest((b.t_us - a.t_us) / 1e6, 1) * 3.6 AS kmh, row_number() OVER (PARTITION BY s.track_id, s.first ORDER BY b.seq) AS rank
FROM ({_STOP_ROWS}) s JOIN v a ON a.track_id = s.track_id AND a.seq = s.last JOIN v b ON b.track_id = s.track_id AND b.seq > s.last AND b.t_us - a.t_us <= {m.EXIT_S * 1_000_000} AND {_hav("a", "b")} >= {m.EXIT_M}) WHERE rank <= {m.EXIT_LOOK} GROUP BY 1, 2"""


@query(
    "trusted_stops",
    _walk(
        f"{_STOPS}, pv AS (SELECT *, lag(t_us) OVER (PARTITION BY track_id ORDER BY seq) AS pt FROM v)",
        f"SELECT track_id, first, last, stay >= {m.TRUST_STAY_S} AND coalesce(snap <= {m.TRUST_SNAP_M}, true) AND gap / stay <= {m.TRUST_GAP} AND span >= {m.TRUST_SPAN_M} AND coalesce(kmh <= {m.EXIT_KMH}, true) AS trusted FROM ({_TRUSTED}) LEFT JOIN ({_EXITS}) USING (track_id, first)",
    ),
)
def _(v):
    def judged(p, table):
        snap = table.column("snap_m").to_pylist()
        return [{"first": a, "last": b, "trusted": bool(k.trusted_stop(p, a, b, snap[a]))} for a, b in k.find_stops(p)]

    return engine.grouped(v, judged, "first int, last int, trusted boolean")


@query(
    "traps",
    _walk(
        f"""n AS (SELECT track_id, max(seq) AS final FROM v GROUP BY 1), pr AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t_us) OVER w AS pt FROM v WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
sp AS (SELECT *, CASE WHEN t_us > pt THEN {_hav4("plon", "plat", "lon", "lat")} / ((t_us - pt) / 1e6) * 3.6 END AS kmh FROM pr),
win AS (SELECT a.track_id, a.seq, max(b.seq) AS last, max(b.t_us) - any_value(a.t_us) AS dur, median(CASE WHEN b.seq > a.seq THEN b.kmh END) AS kmh, min(b.lon) AS lon0, min(b.lat) AS lat0, max(b.lon) AS lon1, max(b.lat) AS lat1 FROM sp a JOIN sp b ON a.track_id = b.track_id AND b.seq >= a.seq AND b.t_us - a.t_us <= {m.TRAP_S * 1_000_000} GROUP BY 1, 2),
x AS (SELECT win.*, greatest(last, seq + 1) AS nxt, last - seq >= {m.TRAP_POINTS} AND kmh > {m.TRAP_KMH} AND {_hav4("lon0", "lat0", "lon1", "lat1")} < {m.TRAP_SPAN} * kmh / 3.6 * dur / 1e6 AS trap FROM win JOIN n USING (track_id) WHERE seq < final - 2)""",
        "SELECT DISTINCT v.track_id, v.seq FROM f JOIN x ON x.track_id = f.track_id AND x.seq = f.seq JOIN v ON v.track_id = x.track_id AND v.seq BETWEEN x.seq AND x.last WHERE x.trap",
    ),
)
def _(v):
    return engine.flagged(v, k.find_traps, "trap").where("trap").select("track_id", "seq")


@query(
    "loop_windows",
    _walk(f"x AS (SELECT a.track_id, a.seq, min(b.seq) AS nxt FROM v a LEFT JOIN v b ON a.track_id = b.track_id AND b.t_us > a.t_us + {m.LOOP_S * 1_000_000} GROUP BY 1, 2), n AS (SELECT track_id, max(seq) AS final FROM v GROUP BY 1)", "SELECT f.track_id, f.seq AS first, CAST(coalesce(nxt - 1, final) AS INTEGER) AS last FROM f JOIN n USING (track_id)"),
)
def _(v):
    return engine.grouped(v, lambda p, _: [{"first": int(w[0]), "last": int(w[-1])} for w in k.loop_windows(p, k.np.arange(len(p)))], "first int, last int")


@query(
    "retired_backtrack",
    f"""WITH RECURSIVE {VIEW_SQL}, e1 AS (SELECT track_id, min(seq) AS a, max(seq) AS b FROM v GROUP BY 1),
u AS (SELECT v.track_id, v.seq, b, {_hav("p", "v")} AS ds, {_hav("v", "q")} AS dg FROM v JOIN e1 USING (track_id) JOIN v p ON p.track_id = v.track_id AND p.seq = a JOIN v q ON q.track_id = v.track_id AND q.seq = b),
f AS (SELECT track_id, seq, ds AS ks, dg AS kg, true AS kept FROM u WHERE seq = 0 UNION ALL SELECT u.track_id, u.seq, CASE WHEN f.ks - u.ds > 1000 AND u.dg - f.kg > 1000 THEN f.ks ELSE u.ds END, CASE WHEN f.ks - u.ds > 1000 AND u.dg - f.kg > 1000 THEN f.kg ELSE u.dg END, u.seq = u.b OR NOT (f.ks - u.ds > 1000 AND u.dg - f.kg > 1000) FROM f JOIN u ON u.track_id = f.track_id AND u.seq = f.seq + 1)
SELECT track_id, seq FROM f WHERE kept""",
)
def _(v):
    return engine.kept(v, lambda p: k.remove_backtrack(p, 1000.0)).select("track_id", "seq")


@query(
    "retired_teleports",
    _walk(
        f"""back AS (SELECT a.track_id, a.seq, min(c.seq) AS b FROM v a JOIN v c ON a.track_id = c.track_id AND c.seq >= a.seq + 2 AND {_hav("a", "c")} < 5000 GROUP BY 1, 2),
sp AS (SELECT back.track_id, back.seq, back.b, {_hav4("min(v.lon)", "min(v.lat)", "max(v.lon)", "max(v.lat)")} AS span FROM back JOIN v ON v.track_id = back.track_id AND v.seq > back.seq AND v.seq < back.b GROUP BY 1, 2, 3),
x AS (SELECT a.track_id, a.seq, CASE WHEN {_hav("a", "c")} > 20000 AND sp.span < 10000 THEN sp.b ELSE a.seq + 1 END AS nxt FROM v a LEFT JOIN v c ON c.track_id = a.track_id AND c.seq = a.seq + 1 LEFT JOIN sp ON sp.track_id = a.track_id AND sp.seq = a.seq)""",
        "SELECT track_id, seq FROM f",
    ),
)
def _(v):
    return engine.kept(v, lambda p: k.remove_teleports(p, 20_000.0, 5000.0, 10_000.0)).select("track_id", "seq")


_DT = "(CASE WHEN v.t_us > f.kt THEN (v.t_us - f.kt) / 1e6 ELSE 1 END)"


@query("retired_speed", _fold(f"{_D} / {_DT} * 3.6 <= 90"))
def _(v):
    return engine.kept(v, lambda p: k.filter_speed(p, 90.0)).select("track_id", "seq")


@query(
    "retired_acceleration",
    f"""WITH RECURSIVE {VIEW_SQL}, f AS (SELECT b.track_id, b.seq, b.lon AS klon, b.lat AS klat, b.t_us AS kt, {_hav("a", "b")} / CASE WHEN b.t_us > a.t_us THEN (b.t_us - a.t_us) / 1e6 ELSE 1 END * 3.6 AS spd, true AS kept FROM v a JOIN v b ON a.track_id = b.track_id AND a.seq = 0 AND b.seq = 1
UNION ALL SELECT track_id, seq, CASE WHEN ok THEN lon ELSE klon END, CASE WHEN ok THEN lat ELSE klat END, CASE WHEN ok THEN t_us ELSE kt END, CASE WHEN ok THEN new ELSE spd END, ok FROM (SELECT *, abs(new - spd) / dt <= 0.5 AS ok FROM (SELECT v.track_id, v.seq, v.lon, v.lat, v.t_us, f.klon, f.klat, f.kt, f.spd, {_DT} AS dt, {_D} / {_DT} * 3.6 AS new FROM f JOIN v ON v.track_id = f.track_id AND v.seq = f.seq + 1)))
SELECT track_id, seq FROM f WHERE kept UNION ALL SELECT track_id, seq FROM v WHERE seq = 0""",
)
def _(v):
    return engine.kept(v, lambda p: k.filter_acceleration(p, 0.5)).select("track_id", "seq")


@query("reorder_batches")
def _(v):
    """Ten-minute times make batches; input_seq says which point took each slot."""
    v = v.withColumn("t_us", F.floor(F.col("t_us") / 600_000_000).cast("long") * 600_000_000)
    return engine.grouped(v, lambda p, _: [{"seq": i, "input_seq": int(x)} for i, x in enumerate(k.reorder(p))], "seq int, input_seq int")


_OFF = f"abs(asin(sin({_hav4('a.lon', 'a.lat', 'p.lon', 'p.lat')} / {m.EARTH_M}) * sin({_bearing('a.lon', 'a.lat', 'p.lon', 'p.lat')} - ({_bearing('a.lon', 'a.lat', 'b.lon', 'b.lat')})))) * {m.EARTH_M}"


def _segments(metres: int) -> str:
    return f"""WITH RECURSIVE {VIEW_SQL}, seg AS (SELECT track_id, min(seq) AS lo, max(seq) AS hi FROM v GROUP BY 1
UNION ALL SELECT track_id, unnest([lo, mid]) AS lo, unnest([mid, hi]) AS hi FROM (SELECT s.track_id, lo, hi, -(max({{'o': {_OFF}, 's': -p.seq}}).s) AS mid, max({_OFF}) AS off
FROM seg s JOIN v a ON a.track_id = s.track_id AND a.seq = lo JOIN v b ON b.track_id = s.track_id AND b.seq = hi JOIN v p ON p.track_id = s.track_id AND p.seq > lo AND p.seq < hi GROUP BY s.track_id, lo, hi) WHERE off > {metres}),
kept AS (SELECT DISTINCT track_id, CAST(unnest([lo, hi]) AS INTEGER) AS seq FROM seg)"""


@query("simplify", f"{_segments(5)} SELECT track_id, seq FROM kept")
def _(v):
    return engine.kept(v, lambda p: k.simplify(p, 5.0)).select("track_id", "seq")


@query(
    "reachability_guard",
    f"""{_segments(500)}, steps AS (SELECT track_id, seq, lead(seq) OVER (PARTITION BY track_id ORDER BY seq) AS nxt FROM kept),
broken AS (SELECT s.track_id, s.seq, s.nxt FROM steps s JOIN v a ON a.track_id = s.track_id AND a.seq = s.seq JOIN v b ON b.track_id = s.track_id AND b.seq = s.nxt WHERE NOT (b.t_us >= a.t_us AND {_hav("a", "b")} <= {m.CHAIN_KMH} / 3.6 * (b.t_us - a.t_us) / 1e6 + {m.CHAIN_SLACK_M}))
SELECT track_id, seq FROM kept UNION SELECT v.track_id, v.seq FROM broken JOIN v ON v.track_id = broken.track_id AND v.seq > broken.seq AND v.seq < broken.nxt""",
)
def _(v):
    return engine.kept(v, lambda p: k.guard(p, k.simplify(p, 500.0))).select("track_id", "seq")


@query(
    "build_chain",
    f"""WITH RECURSIVE {VIEW_SQL}, q AS (SELECT track_id, list(lon ORDER BY seq) AS lons, list(lat ORDER BY seq) AS lats, list(t_us ORDER BY seq) AS ts FROM v GROUP BY 1),
d AS (SELECT track_id, 0 AS seq, [-3.0::DOUBLE] AS best, [-1] AS came FROM q
UNION ALL SELECT track_id, seq, list_append(best, w + CASE WHEN i > 0 THEN best[i] ELSE 0 END), list_append(came, i - 1) FROM
(SELECT *, CASE WHEN top > 0 THEN CAST(len(cand) - list_position(list_reverse(cand), top) + 1 AS INTEGER) ELSE 0 END AS i FROM
(SELECT *, list_max(cand) AS top FROM (SELECT track_id, seq + 1 AS seq, best, came, CAST((seq + 1) % 7 - 3 AS DOUBLE) AS w, list_transform(list_zip(best, lons[:seq + 1], lats[:seq + 1], ts[:seq + 1]),
lambda x: CASE WHEN ts[seq + 2] >= x[4] AND {_hav4("x[2]", "x[3]", "lons[seq + 2]", "lats[seq + 2]")} <= {m.CHAIN_KMH} / 3.6 * (ts[seq + 2] - x[4]) / 1e6 + {m.CHAIN_SLACK_M} THEN x[1] ELSE -1e18 END) AS cand FROM d JOIN q USING (track_id) WHERE seq + 1 < len(ts))))),
fin AS (SELECT track_id, arg_max(best, seq) AS best, arg_max(came, seq) AS came FROM d GROUP BY 1),
c AS (SELECT track_id, came, CAST(list_position(best, list_max(best)) - 1 AS INTEGER) AS seq, 0 AS back FROM fin UNION ALL SELECT track_id, came, CAST(came[seq + 1] AS INTEGER), back + 1 FROM c WHERE came[seq + 1] >= 0)
SELECT track_id, CAST(max(back) OVER (PARTITION BY track_id) - back AS INTEGER) AS at, seq FROM c""",
)
def _(v):
    """Weights from -3 to 3 by turns, whole numbers, so that equal sums are equal."""

    def chain(p, table):
        return [{"at": i, "seq": int(x)} for i, x in enumerate(k.ChainBuilder(p).build(table.column("seq").to_numpy() % 7 - 3.0))]

    return engine.grouped(v, chain, "at int, seq int")


def _dual(view: str, select: str) -> str:
    """SQL of two sources in one track; ``bad`` holds the points that it condemns."""
    near = lambda p: f"{_hav(p, 'v')} <= {m.DUAL_NEAR_M}"
    close = f"{_hav4('lons[rest[1] + 1]', 'lats[rest[1] + 1]', 'lons[r + 1]', 'lats[r + 1]')} <= {m.DUAL_NEAR_M}"
    split = f"greatest(share_a, share_b) / greatest(least(share_a, share_b), 1e-6) >= {m.DUAL_RATIO}"
    return f"""WITH RECURSIVE {_STEPS.replace(VIEW_SQL, view)},
jp AS (SELECT track_id, seq, t_us, count(*) OVER (PARTITION BY track_id) AS jumps, lag(t_us) OVER (PARTITION BY track_id ORDER BY seq) AS before FROM st WHERE next_m >= {m.DUAL_JUMP_M} AND next_s >= 0 AND next_m / greatest(next_s, 1) * 3.6 > {m.DUAL_KMH}),
ep AS (SELECT *, sum(CASE WHEN t_us - before > {m.DUAL_GAP_S * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS ep FROM jp WHERE jumps >= {m.DUAL_SWITCHES}),
eps AS (SELECT track_id, ep, min(seq) AS a, max(seq) + 1 AS z FROM ep GROUP BY 1, 2 HAVING count(*) >= {m.DUAL_SWITCHES}),
q AS (SELECT track_id, max(seq) AS final, list(lon ORDER BY seq) AS lons, list(lat ORDER BY seq) AS lats, list(t_us ORDER BY seq) AS ts FROM v GROUP BY 1 HAVING count(*) >= {m.DUAL_POINTS}),
pl AS (SELECT e.track_id, ep, a, z, final, v.seq, v.t_us, {near("pa")} AS at_a, {near("pb")} AS at_b FROM eps e JOIN q ON q.track_id = e.track_id JOIN v pa ON pa.track_id = e.track_id AND pa.seq = a JOIN v pb ON pb.track_id = e.track_id AND pb.seq = a + 1 JOIN v ON v.track_id = e.track_id),
lim AS (SELECT track_id, ep, coalesce(max(seq) FILTER (seq < a AND NOT at_a AND NOT at_b), -1) + 1 AS lo, coalesce(min(seq) FILTER (seq > z AND NOT at_a AND NOT at_b), any_value(final) + 1) - 1 AS hi FROM pl GROUP BY 1, 2),
win AS (SELECT pl.*, lag(at_a) OVER w AS was_a, lag(at_b) OVER w AS was_b, t_us - lag(t_us) OVER w AS dt FROM pl JOIN lim USING (track_id, ep) WHERE seq BETWEEN lo AND hi WINDOW w AS (PARTITION BY track_id, ep ORDER BY seq)),
sm AS (SELECT track_id, ep, greatest((max(t_us) - min(t_us)) / 1e6, 1) AS total, coalesce(sum(dt) FILTER (was_a AND at_a), 0) / 1e6 AS held_a, coalesce(sum(dt) FILTER (was_b AND at_b), 0) / 1e6 AS held_b, list(seq ORDER BY seq) AS rest FROM win GROUP BY 1, 2),
sh AS (SELECT *, held_a / total AS share_a, held_b / total AS share_b FROM sm),
cr AS (SELECT track_id, ep, total, 0 AS k, []::INTEGER[] AS own, rest FROM sh WHERE NOT ({split})
UNION ALL SELECT track_id, ep, total, k + 1, list_filter(rest, lambda r: {close}), list_filter(rest, lambda r: NOT ({close})) FROM cr JOIN q USING (track_id) WHERE len(rest) > 0),
st2 AS (SELECT track_id, ep, k, coalesce(list_sum(list_transform(range(2, len(own) + 1), lambda i: CASE WHEN ts[own[i] + 1] - ts[own[i - 1] + 1] <= {m.DUAL_HELD_S * 1_000_000} THEN ts[own[i] + 1] - ts[own[i - 1] + 1] ELSE 0 END)), 0) / 1e6 / total AS share FROM cr JOIN q USING (track_id) WHERE k > 0),
guilty AS (SELECT track_id, ep FROM st2 GROUP BY 1, 2 HAVING count(*) >= {m.DUAL_PLACES} AND max(share) < {m.DUAL_SHARE}),
bad AS (SELECT win.track_id, win.seq FROM win JOIN sh USING (track_id, ep) WHERE {split} AND CASE WHEN share_b >= share_a THEN at_a ELSE at_b END UNION SELECT track_id, seq FROM win SEMI JOIN guilty USING (track_id, ep))
{select}"""


@query("dual_sources", _dual(VIEW_SQL, "SELECT v.track_id, count(bad.seq) AS points FROM v LEFT JOIN bad ON bad.track_id = v.track_id AND bad.seq = v.seq GROUP BY 1"))
def _(v):
    return engine.flagged(v, k.find_dual, "dual").groupBy("track_id").agg(F.sum(F.col("dual").cast("long")).alias("points"))


#: A point a minute, at four to seven places in turn by the day of the month: places are held or not.
_PLACES_SQL = VIEW_SQL.replace("v AS (", "v0 AS (") + ", v AS (SELECT * REPLACE (seq * 60000000::BIGINT AS t_us, 37.6 + seq % (4 + CAST(substr(track_id, 9, 2) AS INTEGER) % 4) * 0.5::DOUBLE AS lon) FROM v0)"


@query("dual_places", _dual(_PLACES_SQL, "SELECT track_id, seq FROM bad"))
def _(v):
    turn = F.col("seq") % (F.lit(4) + F.substring("track_id", 9, 2).cast("int") % 4)
    v = v.withColumns({"t_us": F.col("seq").cast("long") * 60_000_000, "lon": F.lit(37.6) + turn * 0.5})
    return engine.flagged(v, k.find_dual, "dual").where("dual").select("track_id", "seq")


#: A point a minute, at two places by turns; days differ in which is held for longer.
_TURNS_SQL = VIEW_SQL.replace("v AS (", "v0 AS (") + ", v AS (SELECT * REPLACE (seq * 60000000::BIGINT AS t_us, 37.6 + CASE WHEN seq % 5 < 1 + CAST(substr(track_id, 9, 2) AS INTEGER) % 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS lon) FROM v0)"


@query("dual_turns", _dual(_TURNS_SQL, "SELECT track_id, seq FROM bad"))
def _(v):
    away = F.col("seq") % 5 < F.lit(1) + F.substring("track_id", 9, 2).cast("int") % 4
    v = v.withColumns({"t_us": F.col("seq").cast("long") * 60_000_000, "lon": F.lit(37.6) + F.when(away, 0.5).otherwise(0.0)})
    return engine.flagged(v, k.find_dual, "dual").where("dual").select("track_id", "seq")


@query("split_sources")
def _(v):
    return engine.flagged(v, k.find_split, "split").groupBy("track_id").agg(F.sum(F.col("split").cast("long")).alias("points"))


_TIE = f"dt_s <= {m.AMNESTY_GAP_S} AND step_m <= dt_s * {m.AMNESTY_KMH} / 3.6 + {m.CHAIN_SLACK_M}"


@query(
    "amnesty",
    f"""WITH RECURSIVE {_ISLANDS}, b AS (SELECT c.track_id, c.seq, c.t_us, c.step_m, c.dt_s, coalesce(c.snap_m <= {m.AMNESTY_SNAP_M}, false) AS road, coalesce({_ISLAND}, false) AS bad FROM c JOIN f ON f.track_id = c.track_id AND f.part = c.part),
z0 AS (SELECT *, max(bad::INT) OVER (PARTITION BY track_id ORDER BY t_us RANGE BETWEEN {m.SPREAD_S * 1_000_000} PRECEDING AND {m.SPREAD_S * 1_000_000} FOLLOWING) = 1 AS sus, coalesce({_TIE}, false) AS tie FROM b),
z AS (SELECT *, NOT sus AS free, sus AND NOT bad AND road AS fits, coalesce(lead(tie) OVER (PARTITION BY track_id ORDER BY seq), false) AS tie_next, max(seq) OVER (PARTITION BY track_id) AS final FROM z0),
fw AS (SELECT track_id, seq, free AS trust, false AS won FROM z WHERE seq = 0 UNION ALL SELECT z.track_id, z.seq, z.free OR (fw.trust AND z.fits AND z.tie), NOT z.free AND fw.trust AND z.fits AND z.tie FROM fw JOIN z ON z.track_id = fw.track_id AND z.seq = fw.seq + 1),
bw AS (SELECT track_id, seq, free AS trust, false AS won FROM z WHERE seq = final UNION ALL SELECT z.track_id, z.seq, z.free OR (bw.trust AND z.fits AND z.tie_next), NOT z.free AND bw.trust AND z.fits AND z.tie_next FROM bw JOIN z ON z.track_id = bw.track_id AND z.seq = bw.seq - 1),
rn AS (SELECT *, sum(CASE WHEN fits AND before AND tie THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM (SELECT *, coalesce(lag(fits) OVER (PARTITION BY track_id ORDER BY seq), false) AS before FROM z)),
lg AS (SELECT track_id, run FROM rn WHERE fits GROUP BY 1, 2 HAVING count(*) >= {m.AMNESTY_RUN})
SELECT track_id, seq FROM fw WHERE won UNION SELECT track_id, seq FROM bw WHERE won UNION SELECT rn.track_id, rn.seq FROM rn JOIN lg ON lg.track_id = rn.track_id AND lg.run = rn.run WHERE fits""",
)
def _(v):
    def pardoned(p, table):
        import numpy as np

        bad, snap = k.find_islands(p), table.column("snap_m").to_numpy()
        suspect = np.zeros(len(p), dtype=bool)
        for a in np.flatnonzero(bad):
            suspect |= np.abs(p.t - p.t[a]) <= m.SPREAD_S * k.US
        return [{"seq": int(i)} for i in np.flatnonzero(k.find_amnesty(p, snap, suspect, bad, np.zeros(len(p))))]

    return engine.grouped(v, pardoned, "seq int")


def _rounded(x, n: int):
    """Python's own rounding, number after number."""
    return k.np.fromiter((round(y, n) for y in map(float, x)), k.np.float64, len(x))


def _pair_columns(builder: k.ChainBuilder, chain) -> dict:
    i, j, line = k.asked_pairs(builder, chain, k.RoadMemory(len(builder.p)))
    return {"a": i, "b": j, "line_m": _rounded(line, 3)}


@query("road_pairs")
def _(v):
    """The first questions to the router about each track's chain."""

    def asked(p, table):
        b = k.ChainBuilder(p)
        chain = b.build(k.point_weights(p, table.column("snap_m").to_numpy())[1])
        return _pair_columns(b, chain)

    return engine.grouped(v, asked, "a int, b int, line_m double")


_REPORT = ("track_id", "status", "error", "degraded", "points_before", "points_after", "reordered", "collapsed", "stops_total", "stops_trusted", "stops_frozen", "split", "spread", "amnesty", "loops", "road_banned", "road_asked", "road_passes", "dropped", "guarded", "gaps", "filled", "added_points")


@query("core_resolve")
def _(v):
    """Whole pipeline, one report row per track."""
    r = engine.resolve(v, AnalyticRoads())
    return r.select(*_REPORT, *(F.round(c, 3).alias(c) for c in ("length_before_m", "length_after_m", "km_before", "km_after", "added_m", "snap_fraction")))


@query("resolved_points")
def _(v):
    p = engine.points_of(engine.resolve(v, AnalyticRoads()))
    return p.select("track_id", "seq", "input_seq", "t_us", _r("lon", 6), _r("lat", 6), "synthetic", "is_stop")


@query("stage_stats")
def _(v):
    return engine.stage_stats(engine.resolve(v, AnalyticRoads())).select("track_id", "at", "stage", "points_before", "points_after")


@query("resolve_without_roads")
def _(v):
    return engine.resolve(v, None).select("track_id", "status", "degraded", "points_before", "points_after", F.array_join("warnings", "; ").alias("warnings"), _r("length_after_m"))


#: Tracks of any length: the caps of submitted tasks are a service's, not part of the wire form or of the rules.
WHOLE = m.EngineConfig(max_bytes=2**31 - 1, max_points=engine.MOST_POINTS)


@query("codec_roundtrip", f"WITH {VIEW_SQL} SELECT track_id, seq, t_us // 1000000 * 1000000 AS t_us, CAST(10800 AS INTEGER) AS tz_off_s, lon, lat FROM v")
def _round_trip(v):
    sent = codec.encode_tracks(v.withColumn("tz_off_s", F.lit(10_800)))
    return codec.exploded(codec.decode_routes(sent, key="track_id", config=WHOLE))


@query("core_resolve_airfields")
def _(v):
    """The pipeline with a no-go area, whose points are penalised."""
    marked = s.mark_airfields(v, [[(38.0, 55.0), (38.4, 55.0), (38.4, 56.0), (38.0, 56.0)]])
    return engine.resolve(marked, AnalyticRoads()).select("track_id", "status", "spread", "amnesty", "points_after", _r("length_after_m"))


@query("resolve_tables")
def _(v):
    """Snaps, road distances and routes from tables: every point's snap, and
    the roads between neighbours that stood next to each other in time."""
    spark = v.sparkSession

    def keep(df):
        path = shared_path(spark, "answers")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    snaps = v.groupBy("lon", "lat").agg(F.min("snap_m").alias("snap_m"))
    p = s.steps(v).withColumns({"a_lon": F.lag("lon").over(s.order()), "a_lat": F.lag("lat").over(s.order())}).where("step_m >= 500")
    ends = [F.col("a_lon"), F.col("a_lat"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat")]
    pairs = p.select(*ends, (F.col("step_m") * 1.2).alias("dist_m"))
    corner = lambda lon, lat: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    routes = p.select(*ends, F.lit(None).cast("int").alias("bearing"), (F.col("step_m") * 1.2).alias("distance"), F.array(corner("a_lon", "a_lat"), corner("a_lon", "lat"), corner("lon", "lat")).alias("coords"))
    found = engine.resolve_with_tables(v.drop("snap_m"), keep, snaps, pairs, routes)
    return found.select("track_id", "status", "error", "road_asked", "road_banned", "gaps", "filled", "points_after", _r("length_after_m"))


@query("stream_tasks")
def _(v):
    """All tracks as tasks through the queue, the stream and the result cards."""
    spark = v.sparkSession
    queue, results, check = (shared_path(spark, x) for x in ("queue", "results", "stream"))
    sent = codec.encode_tracks(v).withColumnRenamed("track_id", "task_key")
    tasks.submit(sent, queue)
    tasks.start(spark, queue, results, check, None, WHOLE, once=True).awaitTermination()
    return tasks.cards(spark, results).select("task_key", "status", "points_before", "points_after", "degraded", _r("length_before_m"), _r("length_m"))


# ------------------------------------------------------------ the engine's own kernels, by the SQL of the same rules


def _points(v: DataFrame, fn, schema: str = "seq int") -> DataFrame:
    """Rows of a kernel that works on a track and its table."""
    return engine.grouped(v, fn, schema)


def _seqs(flags) -> list[dict]:
    return [{"seq": int(i)} for i in k.indices(flags)]


@query("engine_islands", f"WITH {_ISLANDS} SELECT c.track_id, c.seq FROM c JOIN f ON f.track_id = c.track_id AND f.part = c.part WHERE {_ISLAND}")
def _(v):
    return _points(v, lambda p, _: _seqs(k.find_islands(p)))


@query("engine_jumps", ORACLES["jumps"])
def _(v):
    return _points(v, lambda p, _: [{"seq": int(i)} for i in k.find_jumps(p)])


def _penalised(rule):
    """Points that a rule over the whole track as a chain penalises, and by how much."""

    def run(p, _):
        penalty = k.np.zeros(len(p))
        rule(p, k.np.arange(len(p)), penalty)
        return [{"seq": int(i), "penalty": float(penalty[i])} for i in k.indices(penalty > 0)]

    return run


@query(
    "engine_stubs",
    f"""WITH {_parts(f"step_m >= {m.STUB_GAP_M}")}, x AS (SELECT *, (t1 - t0) / 1e6 AS inside, (coalesce(t0 - bt, 0) + coalesce(nt0 - t1, 0)) / 1e6 AS travel FROM f)
SELECT c.track_id, c.seq, {m.STUB_W}::DOUBLE AS penalty FROM c JOIN x ON x.track_id = c.track_id AND x.part = c.part WHERE total >= 3 AND travel > 0 AND inside / (inside + travel) <= {m.STUB_TIME} AND path_m < {m.STUB_PATH_M}""",
)
def _(v):
    return _points(v, _penalised(lambda p, chain, penalty: k.check_stubs(p, chain, penalty, k.np.zeros(len(p), bool))), "seq int, penalty double")


@query("engine_lateral", ORACLES["lateral_g"])
def _(v):
    def bent(p, _):
        g = k.lateral_g(p) if len(p) > 2 else k.np.zeros(0)
        return [{"seq": int(i) + 1, "g": round(float(g[i]), 6)} for i in k.indices(~k.np.isnan(g))]

    return _points(v, bent, "seq int, g double")


@query(
    "engine_rush",
    f"""WITH {_STEPS}, {_RUSH}, h AS (SELECT track_id, seq AS a, end_seq AS b FROM q WHERE end_us > t_us AND path_m > (end_us - t_us) / 1e6 * {m.CHAIN_KMH} / 3.6 + {m.CHAIN_SLACK_M})
SELECT v.track_id, v.seq, count(*) * {m.RUSH_W}::DOUBLE AS penalty FROM v JOIN h ON h.track_id = v.track_id AND v.seq BETWEEN h.a AND h.b GROUP BY 1, 2""",
)
def _(v):
    return _points(v, _penalised(k.check_rush), "seq int, penalty double")


#: Two points an hour, every other hour off to the side: groups that silence surrounds and that the way passes by.
_SPARSE_SQL = VIEW_SQL.replace("v AS (", "v0 AS (") + """, v1 AS (SELECT *, t_us % 86400000000 // 3600000000 AS hour, row_number() OVER (PARTITION BY track_id, t_us // 3600000000 ORDER BY t_us, seq) AS nth FROM v0),
v AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t_us, seq) - 1 AS INTEGER) AS seq, t_us, 37.6 + (hour % 2) * 0.05::DOUBLE AS lon, lat, snap_m FROM v1 WHERE nth <= 2)"""


def sparse(v: DataFrame) -> DataFrame:
    hour = F.floor(F.col("t_us") / 3_600_000_000)
    nth = F.row_number().over(Window.partitionBy("track_id", hour).orderBy("t_us", "seq"))
    v = v.withColumn("nth", nth).where("nth <= 2").withColumn("lon", F.lit(37.6) + (F.floor(F.col("t_us") % 86_400_000_000 / 3_600_000_000) % 2) * 0.05)
    return v.withColumn("seq", (F.row_number().over(Window.partitionBy("track_id").orderBy("t_us", "seq")) - 1).cast("int")).drop("nth")


_SPARSE_STEPS = _STEPS.replace(VIEW_SQL, _SPARSE_SQL)
_LONELY = ORACLES["lonely"].replace(VIEW_SQL, _SPARSE_SQL)


@query("lonely_sparse", _LONELY)
def _(v):
    return s.lonely(sparse(v)).select("track_id", "first", "last", "n")


@query("engine_lonely", f"SELECT track_id, CAST(unnest(range(first, last + 1)) AS INTEGER) AS seq, {m.LONELY_W}::DOUBLE AS penalty FROM ({_LONELY})")
def _(v):
    return _points(sparse(v), _penalised(k.check_lonely), "seq int, penalty double")


@query("engine_hot", f"SELECT track_id, seq FROM ({ORACLES['hot_spots']}) WHERE hot")
def _(v):
    return _points(v, lambda p, _: [{"seq": int(i)} for i in k.hot_spots(p, k.np.arange(len(p)), k.np.zeros(len(p)))])


@query(
    "engine_pairs",
    f"""WITH {_STEPS}, h AS (SELECT * FROM ({ORACLES["hot_spots"]}) WHERE hot), n AS (SELECT track_id, max(seq) AS final FROM v GROUP BY 1),
asked AS (SELECT track_id, 0 AS kind, seq AS place, 0 AS nth, seq AS a, seq + 1 AS b FROM st WHERE nlon IS NOT NULL
UNION ALL SELECT track_id, 1, seq, i, greatest(seq - d, 0), least(seq + d, final) FROM h JOIN n USING (track_id), (SELECT unnest({list(m.HOT_STEPS)}) AS d, unnest(range({len(m.HOT_STEPS)})) AS i)),
far AS (SELECT asked.*, p.t_us AS ta, v.t_us AS tb, {_hav("p", "v")} AS line FROM asked JOIN v p ON p.track_id = asked.track_id AND p.seq = a JOIN v ON v.track_id = asked.track_id AND v.seq = b WHERE a < b),
ok AS (SELECT *, row_number() OVER (PARTITION BY track_id, ta, tb ORDER BY kind, place, nth) AS nr FROM far WHERE line >= {m.ROAD_LEAST_M} AND NOT (line < {m.ROAD_SHORT_M} AND tb > ta AND line / ((tb - ta) / 1e6) * 3.6 <= {m.ROAD_SHORT_KMH}))
SELECT track_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(line, 3) AS line_m FROM ok WHERE nr = 1""",
)
def _(v):
    """The questions to the router about a chain of all points."""

    return _points(v, lambda p, _: _pair_columns(k.ChainBuilder(p), k.np.arange(len(p))), "a int, b int, line_m double")


@query(
    "engine_road",
    f"""WITH p AS ({ORACLES["engine_pairs"]}), {VIEW_SQL}, hit AS (SELECT p.track_id, p.a, p.b FROM p JOIN v x ON x.track_id = p.track_id AND x.seq = a JOIN v y ON y.track_id = p.track_id AND y.seq = b WHERE a % 5 <> 2 AND (y.t_us <= x.t_us OR {_hav("x", "y")} * 1.3 / ((y.t_us - x.t_us) / 1e6) * 3.6 > {m.ROAD_KMH}))
SELECT track_id, CAST(seq AS INTEGER) AS seq, round(count(*) * {m.ROAD_W}, 6)::DOUBLE AS penalty FROM (SELECT track_id, a AS seq FROM hit UNION ALL SELECT track_id, b FROM hit) GROUP BY 1, 2""",
)
def _(v):
    """What a road 1.3 times the line costs a chain of all points; some questions have no answer."""

    def banned(p, _):
        memory = k.RoadMemory(len(p))
        k.check_road(k.ChainBuilder(p), k.np.arange(len(p)), memory, lambda pairs: [None if i % 5 == 2 else float(p.to(i, j)) * 1.3 for i, j in pairs])
        return [{"seq": int(i), "penalty": round(float(memory.penalty[i]), 6)} for i in k.indices(memory.penalty > 0)]

    return _points(v, banned, "seq int, penalty double")


@query(
    "engine_loops",
    f"""WITH RECURSIVE lw AS ({ORACLES["loop_windows"]}), {_STEPS},
win AS (SELECT lw.track_id, first, last, coalesce(sum(step_m) FILTER (st.seq > first), 0) AS path FROM lw JOIN st ON st.track_id = lw.track_id AND st.seq BETWEEN first AND last GROUP BY 1, 2, 3 HAVING count(*) >= {m.LOOP_POINTS}),
rt AS (SELECT win.*, path / greatest({_hav("x", "y")} * 1.2, {m.LOOP_FLOOR_M}) AS ratio, row_number() OVER (PARTITION BY win.track_id ORDER BY first) AS nth FROM win JOIN v x ON x.track_id = win.track_id AND x.seq = first JOIN v y ON y.track_id = win.track_id AND y.seq = last WHERE path >= {m.LOOP_PATH_M} AND first % 7 <> 3),
hy AS (SELECT track_id, nth, first, last, ratio > {m.LOOP_ENTER} AS hot FROM rt WHERE nth = 1 UNION ALL SELECT rt.track_id, rt.nth, rt.first, rt.last, rt.ratio > CASE WHEN hy.hot THEN {m.LOOP_STAY} ELSE {m.LOOP_ENTER} END FROM hy JOIN rt ON rt.track_id = hy.track_id AND rt.nth = hy.nth + 1)
SELECT track_id, CAST(unnest(range(first, last + 1)) AS INTEGER) AS seq, {m.LOOP_W}::DOUBLE AS penalty FROM hy WHERE hot""",
)
def _(v):
    """Half hours that wind, for roads of 1.2 times the line; some have no answer."""

    def winding(p, _):
        memory = k.RoadMemory(len(p))
        k.check_loops(k.ChainBuilder(p), k.np.arange(len(p)), memory, lambda pairs: [None if i % 7 == 3 else float(p.to(i, j)) * 1.2 for i, j in pairs])
        return [{"seq": int(i), "penalty": round(float(memory.penalty[i]), 6)} for i in k.indices(memory.penalty > 0)]

    return _points(v, winding, "seq int, penalty double")


@query("airfield_points", f"WITH {VIEW_SQL} SELECT track_id, seq FROM v WHERE (lon > 38.0 AND lon < 38.4 AND lat > 55 AND lat < 56) OR (lat > 55.7497 AND lon > 40 AND lon - 40 + (lat - 55.7497) * 5000 < 3)")
def _(v):
    """Points inside a rectangle or a triangle."""
    rings = [[(38.0, 55.0), (38.4, 55.0), (38.4, 56.0), (38.0, 56.0)], [(40.0, 55.7497), (43.0, 55.7497), (40.0, 55.7503)]]
    return s.mark_airfields(v, rings).where("airfield = 1").select("track_id", "seq")


_FLAGS = "(seq % 6 = 0) AS trusted, (seq % 4) * 5 AS observed, seq % 11 = 5 AS frozen, seq % 13 = 7 AS split, CASE WHEN seq % 37 = 4 THEN 0.5::DOUBLE ELSE 0 END AS decoy"


def _built(view: str) -> str:
    """SQL of all steps that make a point's weight, in their order."""
    at = "PARTITION BY track_id ORDER BY seq"
    near = f"PARTITION BY track_id ORDER BY t_us RANGE BETWEEN {m.SPREAD_S * 1_000_000} PRECEDING AND {m.SPREAD_S * 1_000_000} FOLLOWING"
    same = f"abs(v.lon - sp.slon) < {m.SAME_SPOT_DEG} AND abs(v.lat - sp.slat) < {m.SAME_SPOT_DEG}"
    evil = " UNION ".join(f"SELECT track_id, seq FROM ({sql.replace(VIEW_SQL, view)})" for sql in (ORACLES["traps"], ORACLES["engine_islands"], _dual(VIEW_SQL, "SELECT track_id, seq FROM bad")))
    smooth = f"SELECT a.track_id, a.seq, any_value(a.raw) AS raw, median(b.raw) AS smooth FROM wt a JOIN wt b ON a.track_id = b.track_id AND b.seq BETWEEN a.seq - {m.SMOOTH_MOST} AND a.seq + {m.SMOOTH_MOST - 1} AND (abs(a.seq - b.seq) <= {m.SMOOTH_LEAST} OR abs(a.t_us - b.t_us) <= {m.SMOOTH_S * 1_000_000}) GROUP BY 1, 2"
    return f"""WITH RECURSIVE {_STEPS.replace(VIEW_SQL, view)}, {_SIGMA}, j AS ({smooth}), evil AS ({evil}),
sp AS (SELECT track_id, seq, lon AS slon, lat AS slat, seq AS head FROM v WHERE seq = 0 UNION ALL SELECT v.track_id, v.seq, CASE WHEN {same} THEN slon ELSE v.lon END, CASE WHEN {same} THEN slat ELSE v.lat END, CASE WHEN {same} THEN head ELSE v.seq END FROM sp JOIN v ON v.track_id = sp.track_id AND v.seq = sp.seq + 1),
fl AS (SELECT st.track_id, st.seq, t_us, coalesce(snap_m <= {m.AMNESTY_SNAP_M}, false) AS road, coalesce(dt_s <= {m.AMNESTY_GAP_S} AND step_m <= dt_s * {m.AMNESTY_KMH} / 3.6 + {m.CHAIN_SLACK_M}, false) AS tie, {_FLAGS.replace("seq", "st.seq")}, evil.seq IS NOT NULL AS bad FROM st LEFT JOIN evil ON evil.track_id = st.track_id AND evil.seq = st.seq),
f1 AS (SELECT *, trusted AND decoy <= 0 AS honest, max(bad::INT) OVER ({near}) = 1 AS spread FROM fl), f2 AS (SELECT *, spread OR decoy > 0 AS sus FROM f1),
z AS (SELECT *, NOT sus AS free, sus AND NOT bad AND road AS fits, coalesce(lead(tie) OVER ({at}), false) AS tie_next, max(seq) OVER (PARTITION BY track_id) AS final FROM f2),
fw AS (SELECT track_id, seq, free AS trust, false AS won FROM z WHERE seq = 0 UNION ALL SELECT z.track_id, z.seq, z.free OR (fw.trust AND z.fits AND z.tie), NOT z.free AND fw.trust AND z.fits AND z.tie FROM fw JOIN z ON z.track_id = fw.track_id AND z.seq = fw.seq + 1),
bw AS (SELECT track_id, seq, free AS trust, false AS won FROM z WHERE seq = final UNION ALL SELECT z.track_id, z.seq, z.free OR (bw.trust AND z.fits AND z.tie_next), NOT z.free AND bw.trust AND z.fits AND z.tie_next FROM bw JOIN z ON z.track_id = bw.track_id AND z.seq = bw.seq - 1),
rn AS (SELECT *, sum(CASE WHEN fits AND before AND tie THEN 0 ELSE 1 END) OVER ({at}) AS run FROM (SELECT *, coalesce(lag(fits) OVER ({at}), false) AS before FROM z)),
lg AS (SELECT track_id, run FROM rn WHERE fits GROUP BY 1, 2 HAVING count(*) >= {m.AMNESTY_RUN} AND max(decoy) <= 0),
free2 AS (SELECT track_id, seq FROM fw WHERE won UNION SELECT track_id, seq FROM bw WHERE won UNION SELECT rn.track_id, rn.seq FROM rn JOIN lg ON lg.track_id = rn.track_id AND lg.run = rn.run WHERE fits UNION SELECT track_id, seq FROM f1 WHERE honest AND NOT bad),
w1 AS (SELECT z.*, free2.seq IS NOT NULL AS pardoned, head, CASE WHEN honest THEN greatest(raw, {m.TRUST_W}) ELSE least(raw, smooth) END AS w FROM z JOIN j USING (track_id, seq) JOIN sp USING (track_id, seq) LEFT JOIN free2 USING (track_id, seq)),
w2 AS (SELECT * REPLACE (CASE WHEN observed > 0 AND w > 0 AND NOT split THEN w * (1 + log10(greatest(observed, 1))) ELSE w END AS w) FROM w1),
w3 AS (SELECT * REPLACE (CASE WHEN w > 0 THEN w / count(*) OVER (PARTITION BY track_id, t_us // 1000000) / count(*) OVER (PARTITION BY track_id, head) ELSE w END AS w) FROM w2),
w4 AS (SELECT * REPLACE (CASE WHEN frozen THEN least(w, 0) - {m.FROZEN_W} ELSE w END AS w) FROM w3)
SELECT track_id, seq, spread, pardoned, round(w - CASE WHEN spread AND NOT pardoned THEN {m.BAD_W} ELSE 0 END - CASE WHEN decoy > 0 AND NOT pardoned THEN {m.DECOY_W} * decoy ELSE 0 END - CASE WHEN split THEN {m.SPLIT_W} ELSE 0 END, 6)::DOUBLE AS weight FROM w4"""


def _weighed(v: DataFrame) -> DataFrame:
    def built(p, table):
        np, seq = k.np, k.np.arange(len(p))
        decoy = np.where(seq % 37 == 4, 0.5, 0.0)
        w, spread, pardoned = k.build_weights(p, table.column("snap_m").to_numpy(), seq % 6 == 0, seq % 4 * 5.0, seq % 11 == 5, seq % 13 == 7, decoy, np.zeros(len(p), dtype=bool))
        return {"seq": seq, "weight": _rounded(w, 6), "spread_n": np.full(len(w), spread), "pardoned_n": np.full(len(w), pardoned)}

    return _points(v, built, "seq int, weight double, spread_n long, pardoned_n long")


_counted = lambda sql: f"SELECT track_id, seq, weight, count(*) FILTER (spread) OVER (PARTITION BY track_id) AS spread_n, count(*) FILTER (pardoned) OVER (PARTITION BY track_id) AS pardoned_n FROM ({sql})"


@query("engine_built", _counted(_built(VIEW_SQL)))
def _(v):
    """Weights of all points, with made-up facts about stops, observations and decoys."""
    return _weighed(v)


def _places(view: str) -> str:
    """SQL of the places of a track's points: cs are their centres so far, home is the point's."""
    return f"""WITH RECURSIVE {view}, q AS (SELECT track_id, list(lon ORDER BY seq) AS lons, list(lat ORDER BY seq) AS lats FROM v GROUP BY 1),
f AS (SELECT track_id, 0 AS seq, [0] AS cs, 0 AS home FROM q UNION ALL SELECT track_id, seq, CASE WHEN low <= {m.SPLIT_NEAR_M} THEN cs ELSE list_append(cs, seq) END, CAST(CASE WHEN low <= {m.SPLIT_NEAR_M} THEN list_position(off, low) - 1 ELSE len(cs) END AS INTEGER)
FROM (SELECT *, list_min(off) AS low FROM (SELECT track_id, seq + 1 AS seq, cs, list_transform(cs, lambda c: {_hav4("lons[c + 1]", "lats[c + 1]", "lons[seq + 2]", "lats[seq + 2]")}) AS off FROM f JOIN q USING (track_id) WHERE seq + 1 < len(lons))))"""


def _settled(p) -> list:
    return k.places(p, k.np.arange(len(p)))


@query("engine_places", f"{_places(VIEW_SQL)} SELECT track_id, seq, CAST(min(seq) OVER (PARTITION BY track_id, home) AS INTEGER) AS centre FROM f")
def _(v):
    return _points(v, lambda p, _: [{"seq": int(i), "centre": c.centre} for c in _settled(p) for i in c.members], "seq int, centre int")


@query(
    "engine_returns",
    f"""{_places(VIEW_SQL)}, en AS (SELECT f.track_id, f.seq, home, v.lon, v.lat FROM (SELECT *, lag(home) OVER (PARTITION BY track_id ORDER BY seq) AS was FROM f) f JOIN (SELECT track_id, home, min(seq) AS centre FROM f GROUP BY 1, 2) USING (track_id, home) JOIN v ON v.track_id = f.track_id AND v.seq = centre WHERE was IS NULL OR was <> home),
mv AS (SELECT track_id, home, lag(home) OVER w AS other, seq > min(seq) OVER (PARTITION BY track_id, home) AS known, {_hav4("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} AS way FROM en WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
bk AS (SELECT * FROM mv WHERE known AND way >= {m.SPLIT_APART_M})
SELECT track_id, count(*) AS returns, len(list_distinct(list_concat(list(home), list(other)))) AS places FROM bk GROUP BY 1""",
)
def _(v):
    def back(p, _):
        count, guilty = k.returns(p, k.np.arange(len(p)), _settled(p))
        return [{"returns": count, "places": len(guilty)}] if count else []

    return _points(v, back, "returns long, places long")


#: Quarter hours of each track in which a place occurs, as a share.
@query(
    "engine_slots",
    f"""{_places(VIEW_SQL)}, ends AS (SELECT track_id, min(t_us) AS t0, (max(t_us) - min(t_us)) // {m.SPLIT_SLOT_S * 1_000_000} + 1 AS slots FROM v GROUP BY 1)
SELECT f.track_id, CAST(min(f.seq) AS INTEGER) AS centre, round(count(DISTINCT (t_us - t0) // {m.SPLIT_SLOT_S * 1_000_000}) / any_value(slots), 9) AS share FROM f JOIN v ON v.track_id = f.track_id AND v.seq = f.seq JOIN ends ON ends.track_id = f.track_id GROUP BY f.track_id, home""",
)
def _(v):
    return _points(v, lambda p, _: [{"centre": c.centre, "share": round(float(k.slot_share(p, c.members, 0, len(p) - 1)), 9)} for c in _settled(p)], "centre int, share double")


@query("engine_weights", ORACLES["smooth_weight"])
def _(v):
    def weighed(p, table):
        return {"seq": k.np.arange(len(p)), "weight": _rounded(k.point_weights(p, table.column("snap_m").to_numpy())[1], 6)}

    return _points(v, weighed, "seq int, weight double")


@query("engine_verdicts", ORACLES["fill_verdict"])
def _(v):
    """The gaps that the engine fills, judged with the same made-up routes."""

    def judged(p, _):
        line, dt = p.steps(), p.gaps()
        gaps = k.indices((dt >= m.GAP_S) & (line >= m.GAP_M)).tolist()
        route = lambda i: None if i % 11 == 3 else Route(line[i] * (1.1 + i % 5 * 0.6), [])
        return [{"verdict": track.verdict(route(i), line[i], dt[i])} for i in gaps]

    return _points(v, judged, "verdict string").groupBy("track_id", "verdict").agg(F.count("*").alias("n"))


#: The view without jitter, so that whoever stands is frozen.
_STILL_SQL = VIEW_SQL.replace("v AS (", "v0 AS (") + ", v AS (SELECT * REPLACE (55.75::DOUBLE AS lat) FROM v0)"


@query("stop_facts_still", ORACLES["stop_facts"].replace(VIEW_SQL, _STILL_SQL))
def _(v):
    v = v.withColumn("lat", F.lit(55.75))
    stops = engine.grouped(v, lambda p, _: [{"first": a, "last": b} for a, b in k.find_stops(p)], "first int, last int")
    return s.stop_facts(v, stops).select("track_id", "first", "last", "n", _r("stay_s"), _r("gap_s"), _r("span_m"), "frozen")


@query("engine_frozen", f"SELECT track_id, first, last, span_m < {m.FROZEN_SPAN_M} AS frozen FROM ({ORACLES['stop_facts'].replace(VIEW_SQL, _STILL_SQL)})")
def _(v):
    return _points(v.withColumn("lat", F.lit(55.75)), lambda p, _: [{"first": a, "last": b, "frozen": bool(k.is_frozen(p, a, b))} for a, b in k.find_stops(p)], "first int, last int, frozen boolean")


@query("stop_owner", _walk(_STOPS, f"SELECT track_id, CAST(unnest(range(first, last + 1)) AS INTEGER) AS seq, CAST(row_number() OVER (PARTITION BY track_id ORDER BY first) - 1 AS INTEGER) AS owner FROM ({_STOP_ROWS})"))
def _(v):
    return _points(v, lambda p, _: [{"seq": i, "owner": int(x)} for i, x in enumerate(k.stop_owner(len(p), k.find_stops(p))) if x >= 0], "seq int, owner int")


_CELL = lambda lon, lat: f"CAST(round_even({lat} * {m.CELL_DEGREE_M} / {m.CELL_M}, 0) AS BIGINT), CAST(round_even({lon} * {m.CELL_DEGREE_M} * cos(radians({lat})) / {m.CELL_M}, 0) AS BIGINT)"


@query(
    "step_keys",
    f"""WITH {_STEPS} SELECT track_id, seq, concat_ws(',', {_CELL("plon", "plat")}, {_CELL("lon", "lat")}) AS ban_key, step_m <= {m.DUAL_NEAR_M} AS near, abs(plon - lon) < {m.SAME_SPOT_DEG} AND abs(plat - lat) < {m.SAME_SPOT_DEG} AS same_spot, printf('%.5f,%.5f', lon, lat) AS key FROM st WHERE plon IS NOT NULL""",
)
def _(v):
    """Both ends' cells, nearness, sameness and the router's key of every step."""
    w = s.order()
    p = v.withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w)}).where("plon is not null")
    ends = [F.col(c) for c in ("plon", "plat", "lon", "lat")]
    cells = geo.ban_key(*ends)
    key = F.concat_ws(",", *(cells[e][c].cast("string") for e in ("a", "b") for c in ("y", "x")))
    return p.select("track_id", "seq", key.alias("ban_key"), geo.near(*ends).alias("near"), geo.same_spot(*ends).alias("same_spot"), geo.coordinate_key(F.col("lon"), F.col("lat")).alias("key"))


@query("reachable_banned", f"WITH {_STEPS} SELECT track_id, seq, ({_REACH}) AND NOT coalesce(next_s < CASE WHEN seq % 3 = 0 THEN next_m / 15 END, false) AS reachable FROM st WHERE nlon IS NOT NULL")
def _(v):
    """Every third step is banned below the time that 54 km/h takes."""
    p = s.steps(v).where("step_m is not null").withColumn("seq", F.col("seq") - 1)
    return p.select("track_id", "seq", geo.reachable(F.col("step_m"), F.col("dt_s"), F.when(F.col("seq") % 3 == 0, F.col("step_m") / 15)).alias("reachable"))


@query("too_long_tracks", f"WITH {VIEW_SQL}, n AS (SELECT track_id, count(*) AS c FROM v GROUP BY 1) SELECT track_id, 'failed' AS status, 'too many points' AS error, CAST(c AS INTEGER) AS points_before FROM n WHERE c > (SELECT median(c) FROM n)")
def _(v):
    """Tracks beyond the cap, here the median of their lengths, are failed rows."""
    cap = int(v.groupBy("track_id").count().agg(F.median("count")).first()[0])
    return engine.resolve(v, None, m.EngineConfig(max_points=cap)).where("status = 'failed'").select("track_id", "status", "error", "points_before")


_BACK = 10
_DRIVES = lambda lon, lat, t, cell: f"(ts[seq + 2] >= {t} AND {_hav4(lon, lat, 'lons[seq + 2]', 'lats[seq + 2]')} <= {m.CHAIN_KMH} / 3.6 * (ts[seq + 2] - {t}) / 1e6 + {m.CHAIN_SLACK_M} AND NOT list_contains(banned, {cell} || ';' || cells[seq + 2]))"


@query(
    "chain_banned",
    f"""WITH RECURSIVE {VIEW_SQL}, ce AS (SELECT *, concat_ws(',', {_CELL("lon", "lat")}) AS cell FROM v), nx AS (SELECT *, lead(cell) OVER (PARTITION BY track_id ORDER BY seq) AS ncell FROM ce),
q AS (SELECT track_id, list(lon ORDER BY seq) AS lons, list(lat ORDER BY seq) AS lats, list(t_us ORDER BY seq) AS ts, list(cell ORDER BY seq) AS cells, coalesce(list(DISTINCT cell || ';' || ncell) FILTER (seq % 4 = 0 AND ncell IS NOT NULL), []) AS banned FROM nx GROUP BY 1),
d AS (SELECT track_id, 0 AS seq, [-3.0::DOUBLE] AS best, [-1] AS came FROM q
UNION ALL SELECT track_id, seq, list_append(best, w + CASE WHEN pick > 0 THEN best[pick] ELSE 0 END), list_append(came, pick - 1) FROM
(SELECT *, CAST(CASE WHEN far > 0 AND best[far] > CASE WHEN i > 0 THEN best[i] ELSE 0 END AND {_DRIVES("lons[far]", "lats[far]", "ts[far]", "cells[far]").replace("seq + 2", "seq + 1")} THEN far ELSE i END AS INTEGER) AS pick FROM
(SELECT *, CASE WHEN top > 0 THEN CAST(len(cand) - list_position(list_reverse(cand), top) + 1 AS INTEGER) ELSE 0 END AS i, CASE WHEN seq > {_BACK} THEN seq - {_BACK} - list_position(list_reverse(best[1:seq - {_BACK}]), list_max(best[1:seq - {_BACK}])) + 1 ELSE 0 END AS far FROM
(SELECT *, list_max(cand) AS top FROM (SELECT track_id, seq + 1 AS seq, best, came, lons, lats, ts, cells, banned, CAST((seq + 1) % 7 - 3 AS DOUBLE) AS w, list_transform(list_zip(best, lons[:seq + 1], lats[:seq + 1], ts[:seq + 1], cells[:seq + 1], range(1, seq + 2)),
lambda x: CASE WHEN x[6] > seq + 1 - {_BACK} AND {_DRIVES("x[2]", "x[3]", "x[4]", "x[5]")} THEN x[1] ELSE -1e18 END) AS cand FROM d JOIN q USING (track_id) WHERE seq + 1 < len(ts)))))),
fin AS (SELECT track_id, arg_max(best, seq) AS best, arg_max(came, seq) AS came FROM d GROUP BY 1),
c AS (SELECT track_id, came, CAST(list_position(best, list_max(best)) - 1 AS INTEGER) AS seq, 0 AS back FROM fin UNION ALL SELECT track_id, came, CAST(came[seq + 1] AS INTEGER), back + 1 FROM c WHERE came[seq + 1] >= 0)
SELECT track_id, CAST(max(back) OVER (PARTITION BY track_id) - back AS INTEGER) AS at, seq FROM c""",
)
def _(v):
    """The chain with a short look back, so that the heaviest end before it counts, and bans on every fourth step's cells."""

    def chain(p, table):
        builder = k.ChainBuilder(p, _BACK)
        bans = {builder.key(i, i + 1): 1e12 for i in range(0, len(p) - 1, 4)}
        return [{"at": i, "seq": int(x)} for i, x in enumerate(builder.build(table.column("seq").to_numpy() % 7 - 3.0, bans))]

    return engine.grouped(v, chain, "at int, seq int")


def _asked() -> str:
    """SQL of the first questions about each track's chain of smoothed weights."""
    smooth = f"SELECT a.track_id, a.seq, least(any_value(a.raw), median(b.raw)) AS weight FROM wt a JOIN wt b ON a.track_id = b.track_id AND b.seq BETWEEN a.seq - {m.SMOOTH_MOST} AND a.seq + {m.SMOOTH_MOST - 1} AND (abs(a.seq - b.seq) <= {m.SMOOTH_LEAST} OR abs(a.t_us - b.t_us) <= {m.SMOOTH_S * 1_000_000}) GROUP BY 1, 2"
    chain = ORACLES["build_chain"].replace(VIEW_SQL, f"{VIEW_SQL}, {_SIGMA}, vw AS (SELECT v.*, weight FROM v JOIN ({smooth}) USING (track_id, seq))", 1)
    chain = chain.replace("AS ts FROM v", "AS ts, list(weight ORDER BY seq) AS ws FROM vw", 1).replace("[-3.0::DOUBLE] AS best", "[ws[1]] AS best").replace("CAST((seq + 1) % 7 - 3 AS DOUBLE) AS w", "ws[seq + 2] AS w")
    return f"""WITH {VIEW_SQL}, ch AS MATERIALIZED (SELECT track_id, "at" AS pos, seq FROM ({chain})), h AS (SELECT ch.track_id, ch.pos FROM ch JOIN ({ORACLES["hot_spots"]}) o ON o.track_id = ch.track_id AND o.seq = ch.seq WHERE hot), n AS (SELECT track_id, max(pos) AS final FROM ch GROUP BY 1),
asked AS (SELECT track_id, 0 AS kind, pos AS place, 0 AS nth, pos AS i, pos + 1 AS j FROM ch UNION ALL SELECT track_id, 1, pos, i, greatest(pos - d, 0), least(pos + d, final) FROM h JOIN n USING (track_id), (SELECT unnest({list(m.HOT_STEPS)}) AS d, unnest(range({len(m.HOT_STEPS)})) AS i)),
far AS (SELECT asked.*, x.seq AS a, y.seq AS b, p.t_us AS ta, v.t_us AS tb, {_hav("p", "v")} AS line FROM asked JOIN ch x ON x.track_id = asked.track_id AND x.pos = i JOIN ch y ON y.track_id = asked.track_id AND y.pos = j JOIN v p ON p.track_id = asked.track_id AND p.seq = x.seq JOIN v ON v.track_id = asked.track_id AND v.seq = y.seq WHERE i < j),
ok AS (SELECT *, row_number() OVER (PARTITION BY track_id, ta, tb ORDER BY kind, place, nth) AS nr FROM far WHERE line >= {m.ROAD_LEAST_M} AND NOT (line < {m.ROAD_SHORT_M} AND tb > ta AND line / ((tb - ta) / 1e6) * 3.6 <= {m.ROAD_SHORT_KMH}))
SELECT track_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(line, 3) AS line_m FROM ok WHERE nr = 1"""


def _packed(view: str) -> str:
    """SQL of the stages that run without roads: points of the track (p0), after
    deduplication (p1), collapsing of stops (p2) and simplification (p3), each numbered anew."""
    numbered = lambda name, source: f"{name} AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS INTEGER) AS seq, t_us, lon, lat FROM {source})"
    config = m.EngineConfig()
    keep = f"NOT ({_D} < {config.dedup_m} AND v.t_us - f.kt < {int(config.dedup_s * 1_000_000)})"
    pick = lambda c, own: f"CASE WHEN {keep} THEN v.{own} ELSE f.{c} END"
    near = f"{_hav('a', 'b')} >= {config.stop_m}"
    off = _OFF
    return f"""WITH RECURSIVE {view}, p0 AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t_us, seq) - 1 AS INTEGER) AS seq, t_us, lon, lat FROM v),
f AS (SELECT track_id, seq, lon AS klon, lat AS klat, t_us AS kt, true AS kept FROM p0 WHERE seq = 0
UNION ALL SELECT v.track_id, v.seq, {pick("klon", "lon")}, {pick("klat", "lat")}, {pick("kt", "t_us")}, {keep} FROM f JOIN p0 v ON v.track_id = f.track_id AND v.seq = f.seq + 1),
{numbered("p1", "p0 SEMI JOIN (SELECT track_id, seq FROM f WHERE kept) USING (track_id, seq)")},
far AS (SELECT a.track_id, a.seq, min(b.seq) AS b FROM p1 a JOIN p1 b ON a.track_id = b.track_id AND b.seq > a.seq AND {near} GROUP BY 1, 2),
x AS (SELECT p1.track_id, p1.seq, CASE WHEN coalesce(b - 1, final) - p1.seq >= {config.stop_points} THEN coalesce(b - 1, final) ELSE p1.seq + 1 END AS nxt FROM p1 JOIN (SELECT track_id, max(seq) AS final FROM p1 GROUP BY 1) n USING (track_id) LEFT JOIN far USING (track_id, seq)),
g AS (SELECT track_id, seq, nxt FROM x WHERE seq = 0 UNION ALL SELECT x.track_id, x.seq, x.nxt FROM g JOIN x ON x.track_id = g.track_id AND x.seq = g.nxt),
{numbered("p2", "p1 SEMI JOIN g USING (track_id, seq)")},
seg AS (SELECT track_id, min(seq) AS lo, max(seq) AS hi FROM p2 GROUP BY 1
UNION ALL SELECT track_id, unnest([lo, mid]) AS lo, unnest([mid, hi]) AS hi FROM (SELECT s.track_id, lo, hi, -(max({{'o': {off}, 's': -p.seq}}).s) AS mid, max({off}) AS off
FROM seg s JOIN p2 a ON a.track_id = s.track_id AND a.seq = lo JOIN p2 b ON b.track_id = s.track_id AND b.seq = hi JOIN p2 p ON p.track_id = s.track_id AND p.seq > lo AND p.seq < hi GROUP BY s.track_id, lo, hi) WHERE off > {config.simplify_m}),
{numbered("p3", "p2 SEMI JOIN (SELECT DISTINCT track_id, unnest([lo, hi]) AS seq FROM seg) USING (track_id, seq)")},
len AS (SELECT *, {_hav4("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} AS step FROM (SELECT 0 AS p, * FROM p0 UNION ALL SELECT 3, * FROM p3) WINDOW w AS (PARTITION BY p, track_id ORDER BY seq)),
total AS (SELECT track_id, CAST(count(*) FILTER (p = 0) AS INTEGER) AS points_before, CAST(count(*) FILTER (p = 3) AS INTEGER) AS points_after, round(coalesce(sum(step) FILTER (p = 0), 0), 3) AS length_before_m, round(coalesce(sum(step) FILTER (p = 3), 0), 3) AS length_m FROM len GROUP BY 1)"""


def _oracle(name: str, sql: str) -> None:
    if name not in QUERIES:
        raise KeyError(name)
    ORACLES[name] = sql


_oracle("resolve_without_roads", f"{_packed(VIEW_SQL)} SELECT track_id, 'done' AS status, true AS degraded, points_before, points_after, '{track.NO_ENGINE}; {track.NO_ROUTES}' AS warnings, length_m AS length_after_m FROM total")
#: The wire keeps whole seconds.
_WIRE_SQL = VIEW_SQL.replace("v AS (", "v0 AS (") + ", v AS (SELECT * REPLACE (t_us // 1000000 * 1000000 AS t_us) FROM v0)"
_oracle("stream_tasks", f"{_packed(_WIRE_SQL)} SELECT track_id AS task_key, 'done' AS status, points_before, points_after, true AS degraded, length_before_m, length_m FROM total")


@query(
    "stages_without_roads",
    f"""{_packed(VIEW_SQL)}, c AS (SELECT p.track_id, count(DISTINCT p0.seq) AS n0, any_value(n1) AS n1, any_value(n2) AS n2, any_value(n3) AS n3 FROM total p JOIN p0 USING (track_id) JOIN (SELECT track_id, count(*) AS n1 FROM p1 GROUP BY 1) USING (track_id) JOIN (SELECT track_id, count(*) AS n2 FROM p2 GROUP BY 1) USING (track_id) JOIN (SELECT track_id, count(*) AS n3 FROM p3 GROUP BY 1) USING (track_id) GROUP BY 1)
SELECT track_id, CAST(i AS INTEGER) AS at, {list(m.STAGES)}[i + 1] AS stage, CAST([n0, n0, n0, n1, n2, n3, n3][i + 1] AS INTEGER) AS points_before, CAST([n0, n0, n1, n2, n3, n3, n3][i + 1] AS INTEGER) AS points_after FROM c, range(7) r(i)""",
)
def _(v):
    return engine.stage_stats(engine.resolve(v, None)).select("track_id", "at", "stage", "points_before", "points_after")


_BATCHES = f"""WITH RECURSIVE {VIEW_SQL.replace("v AS (", "v0 AS (")}, v AS (SELECT * REPLACE (t_us // 600000000 * 600000000 AS t_us) FROM v0),
q AS (SELECT track_id, list(lon ORDER BY seq) AS lons, list(lat ORDER BY seq) AS lats FROM v GROUP BY 1),
b AS (SELECT track_id, t_us, list(seq ORDER BY seq) AS own, min(seq) - 1 AS pre, max(seq) + 1 AS post FROM v GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND {m.REORDER_MOST}),
w AS (SELECT b.track_id, t_us, dir, own AS rest, CASE WHEN dir = 1 THEN pre WHEN post < len(lons) THEN post ELSE -1 END AS here, []::INTEGER[] AS out FROM b JOIN q USING (track_id), (VALUES (1), (2)) d(dir)
UNION ALL SELECT track_id, t_us, dir, list_filter(rest, lambda r: r <> nxt), nxt, list_append(out, nxt) FROM (SELECT w.*, CASE WHEN here < 0 THEN rest[1] ELSE list_sort(list_transform(rest, lambda r: {{'d': {_hav4("lons[here + 1]", "lats[here + 1]", "lons[r + 1]", "lats[r + 1]")}, 'r': r}}))[1].r END AS nxt FROM w JOIN q USING (track_id) WHERE len(rest) > 0)),
o AS (SELECT track_id, t_us, 0 AS kind, own AS seqs FROM b UNION ALL SELECT track_id, t_us, dir, CASE WHEN dir = 1 THEN out ELSE list_reverse(out) END FROM w WHERE len(rest) = 0),
path AS (SELECT o.*, list_concat(CASE WHEN pre >= 0 THEN [pre] ELSE []::INTEGER[] END, seqs, CASE WHEN post < len(lons) THEN [post] ELSE []::INTEGER[] END) AS way, lons, lats FROM o JOIN b USING (track_id, t_us) JOIN q USING (track_id)),
cost AS (SELECT track_id, t_us, kind, seqs, list_sum(list_transform(range(1, len(way)), lambda i: {_hav4("lons[way[i] + 1]", "lats[way[i] + 1]", "lons[way[i + 1] + 1]", "lats[way[i + 1] + 1]")})) AS total FROM path),
best AS (SELECT a.track_id, a.t_us, CASE WHEN c.total < least(a.total, CASE WHEN b.total < a.total - {m.REORDER_GAIN_M} THEN b.total ELSE a.total END) - {m.REORDER_GAIN_M} THEN c.seqs WHEN b.total < a.total - {m.REORDER_GAIN_M} THEN b.seqs ELSE a.seqs END AS seqs
FROM cost a JOIN cost b ON b.track_id = a.track_id AND b.t_us = a.t_us AND b.kind = 1 JOIN cost c ON c.track_id = a.track_id AND c.t_us = a.t_us AND c.kind = 2 WHERE a.kind = 0),
moved AS (SELECT best.track_id, b.own[i] AS seq, seqs[i] AS input_seq FROM best JOIN b USING (track_id, t_us), range(1, {m.REORDER_MOST + 1}) r(i) WHERE i <= len(seqs))
SELECT v.track_id, v.seq, CAST(coalesce(moved.input_seq, v.seq) AS INTEGER) AS input_seq FROM v LEFT JOIN moved USING (track_id, seq)"""
_oracle("road_pairs", _asked())
_oracle("reorder_batches", _BATCHES)


def queries() -> dict[str, Query]:
    from waymill import stage_queries, stream_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
