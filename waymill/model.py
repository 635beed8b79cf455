"""Schemas, settings and fixed values of the track engine."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields

log = logging.getLogger("waymill")

POINTS = "track_id string, seq int, t_us long, tz_off_s int, lon double, lat double"
OUTPUT = "track_id string, seq int, t_us long, tz_off_s int, lon double, lat double, synthetic boolean, is_stop boolean"
REPORT = (
    "track_id string, status string, error string, degraded boolean, warnings array<string>, points_before int, points_after int, "
    "length_before_m double, length_after_m double, reordered int, collapsed int, stops_total int, stops_trusted int, stops_frozen int, split int, spread int, "
    "amnesty int, loops int, road_banned int, road_asked int, road_passes int, dropped int, snap_median double, snap_fraction double, km_before double, km_after double, "
    "guarded int, gaps int, filled int, added_points int, added_m double, reasons map<string,int>, stages string"
)

# Thresholds of the rules (metres, seconds, km/h unless named otherwise).
EARTH_M = 6_371_008.8
CELL_M, CELL_DEGREE_M = 50.0, 111_320.0
CHAIN_KMH, CHAIN_SLACK_M, LOOKBACK = 110.0, 300.0, 2000
#: How many of the heaviest predecessors are judged together before all are.
CHAIN_FIRST = 128
STOP_RADIUS_M, STOP_STAY_S = 150.0, 300
TRUST_STAY_S, TRUST_SPAN_M, FROZEN_SPAN_M, TRUST_SNAP_M, TRUST_GAP = 900, 20.0, 5.0, 700.0, 0.8
EXIT_KMH, EXIT_M, EXIT_S, EXIT_LOOK = 150.0, 200.0, 900, 5
SIGMA_M, SIGMA_MIN_M, SIGMA_MAX_M, SIGMA_FACTOR = 25.0, 25.0, 60.0, 2.0
SMOOTH_S, SMOOTH_LEAST, SMOOTH_MOST = 60, 2, 30
TRUST_W, FROZEN_W, BAD_W, SPREAD_S, DECOY_W, SPLIT_W = 1.0, 1.5, 5.0, 600, 3.0, 3.0
SAME_SPOT_DEG = 1e-6
SNAP_LEAST = 0.9
PASSES = 12
TRAP_S, TRAP_KMH, TRAP_SPAN, TRAP_POINTS = 600, 50.0, 0.25, 4
ISLAND_GAP_M, ISLAND_POINTS, ISLAND_STAY_S, ISLAND_PATH_M = 5000.0, 6, 180, 800.0
DUAL_KMH, DUAL_JUMP_M, DUAL_SWITCHES, DUAL_GAP_S, DUAL_NEAR_M = 200.0, 3000.0, 6, 3600, 3000.0
DUAL_RATIO, DUAL_HELD_S, DUAL_PLACES, DUAL_SHARE, DUAL_POINTS = 2.0, 300, 4, 0.35, 20
SPLIT_WINDOW_S, SPLIT_STEP_S, SPLIT_NEAR_M, SPLIT_APART_M = 3600, 1800, 3000.0, 3000.0
SPLIT_RETURNS, SPLIT_MEMBERS, SPLIT_RATIO, SPLIT_SLOT_S, SPLIT_SLOTS = 4, 3, 2.0, 900, 8
SPLIT_GROWTH, SPLIT_SKIP, SPLIT_SPAN_M, SPLIT_POINTS = 4, 3, 150_000.0, 20
AMNESTY_SNAP_M, AMNESTY_GAP_S, AMNESTY_KMH, AMNESTY_RUN = 30.0, 180, 110.0, 15
REORDER_MOST, REORDER_GAIN_M = 12, 1e-6
ROAD_LEAST_M, ROAD_SHORT_M, ROAD_SHORT_KMH, ROAD_KMH, ROAD_W = 500.0, 2000.0, 110.0, 100.0, 0.6
JUMP_M, JUMP_GAP_S, JUMP_NEAR_S, HOT_STEPS = 20_000.0, 300, 3600, (2, 5, 12, 30)
LOOP_S, LOOP_ENTER, LOOP_STAY, LOOP_PATH_M, LOOP_POINTS, LOOP_FLOOR_M, LOOP_W = 1800, 3.0, 1.8, 8000.0, 4, 500.0, 0.8
STUB_GAP_M, STUB_TIME, STUB_PATH_M, STUB_W = 2000.0, 0.10, 3500.0, 2.0
LATERAL_G, LATERAL_LEG_M, LATERAL_KMH, LATERAL_W, GRAVITY = 0.35, 40.0, 30.0, 2.0, 9.81
RUSH_S, RUSH_W = 60, 2.0
LONELY_S, LONELY_M, LONELY_GROUP, LONELY_W = 1800, 300.0, 3, 3.0
GAP_M, GAP_S, FILL_KMH, FILL_SLACK_M, FREE_DETOUR, MOST_DETOUR, DRAWN_M = 500.0, 10, 90.0, 300.0, 1.3, 3.0, 5.0

STAGES = ("sort_by_time", "core", "deduplicate", "collapse_stops", "simplify", "reachability_guard", "fill_gaps")


@dataclass(frozen=True)
class EngineConfig:
    """Packing parameters, input caps, the router and the callback. ``load`` reads
    WAYMILL_* variables; an invalid value leaves the default and logs a warning.
    An empty router_url means no roads, an empty callback_url no callback."""

    dedup_m: float = 2.0
    dedup_s: float = 60.0
    stop_m: float = 50.0
    stop_points: int = 5
    simplify_m: float = 5.0
    max_bytes: int = 20_000_000
    max_points: int = 50_000
    max_attempts: int = 5
    ttl_s: int = 3600
    router_url: str = ""
    router_timeout_s: float = 30.0
    router_requests: int = 16
    router_retries: int = 2
    callback_url: str = ""
    callback_tries: int = 3
    callback_timeout_s: float = 5.0

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(f"WAYMILL_{f.name.upper()}")
            if text is None:
                continue
            try:
                value = type(f.default)(text)
                if not isinstance(value, str) and not value >= 0:
                    raise ValueError
            except ValueError:
                log.warning("WAYMILL_%s=%r is not valid; using %r", f.name.upper(), text, f.default)
            else:
                found[f.name] = value
        return cls(**found)
