"""The wire form of tracks: base64 of zlib of a JSON array of
``{"t": RFC 3339, "pos": {"x": lon, "y": lat}}``, and its DataFrame readers and
writers."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.model import EngineConfig

_TIME = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
POINT = "struct<seq:int,t_us:long,tz_off_s:int,lon:double,lat:double>"
_ARROW_POINT = pa.struct([("seq", pa.int32()), ("t_us", pa.int64()), ("tz_off_s", pa.int32()), ("lon", pa.float64()), ("lat", pa.float64())])


#: Decoded points that a task holds before it passes them on, beside the last track's.
_HELD = 50_000


class CodecError(ValueError):
    """A track that can't be read. ``kind``: invalid, too_large or too_many."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def clamp_error(text: str, most: int = 1024) -> str:
    """At most ``most`` bytes of UTF-8, never half a character."""
    return text.encode("utf-8", "replace")[:most].decode("utf-8", "ignore")


def parse_time(text: str) -> tuple[int, int]:
    """Microseconds since the epoch and the zone's offset in seconds."""
    if isinstance(text, str) and len(text) <= 40:
        return _parsed(text)
    return _parsed.__wrapped__(text)


@lru_cache(4096)  # many points of a track share a second
def _parsed(text: str) -> tuple[int, int]:
    found = _TIME.fullmatch(text) if isinstance(text, str) else None
    if not found:
        raise ValueError(text)
    clock = datetime.fromisoformat(found[1] + ("+00:00" if found[3] == "Z" else found[3]))
    micros = int(((found[2] or ".0")[1:7]).ljust(6, "0"))
    return (clock - _EPOCH) // timedelta(microseconds=1) + micros, int(clock.utcoffset().total_seconds())


def format_time(t_us: int, tz_off_s: int) -> str:
    """RFC 3339 with second precision in the given offset."""
    return _clock(t_us // 1_000_000, tz_off_s)


@lru_cache(4096)
def _clock(second: int, tz_off_s: int) -> str:
    clock = _EPOCH + timedelta(seconds=second + tz_off_s)
    minutes = abs(tz_off_s) // 60
    zone = f"{'-' if tz_off_s < 0 else '+'}{minutes // 60:02d}:{minutes % 60:02d}" if minutes else "Z"
    return clock.strftime("%Y-%m-%dT%H:%M:%S") + zone


def inflate(data: bytes, most: int) -> bytes:
    """zlib with a cap on what comes out, told apart from broken data."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise CodecError("invalid", f"codec: zlib: {e}") from e
    if len(out) > most:
        raise CodecError("too_large", f"codec: decompressed data exceeds {most} bytes")
    if not d.eof:
        raise CodecError("invalid", "codec: zlib: unexpected end of data")
    return out


def _elements(text: str, most: int) -> Iterator[dict]:
    """The array's elements one by one; the cap is checked before each."""
    read, at, n = json.JSONDecoder(parse_constant=float).raw_decode, 0, 0
    blank = re.compile(r"[ \t\r\n]*")
    skip = lambda i: blank.match(text, i).end()
    at = skip(0)
    if text[at : at + 1] != "[":
        raise CodecError("invalid", "codec: expected an array of points")
    at = skip(at + 1)
    while text[at : at + 1] != "]":
        if n:
            if text[at : at + 1] != ",":
                raise CodecError("invalid", "codec: array is not closed")
            at = skip(at + 1)
        if n >= most:
            raise CodecError("too_many", f"too many points: more than {most}")
        try:
            item, at = read(text, at)
        except (ValueError, RecursionError) as e:
            raise CodecError("invalid", f"codec: json: {e}") from e
        yield item
        n, at = n + 1, skip(at)
    if skip(at + 1) != len(text):
        raise CodecError("invalid", "codec: unexpected data after the array of points")


def decode(route: str, max_bytes: int = 20_000_000, max_points: int = 50_000) -> list[tuple[int, int, float, float]]:
    """(t_us, tz_off_s, lon, lat) of every point."""
    return list(zip(*decode_columns(route, max_bytes, max_points)))


def decode_columns(route: str, max_bytes: int = 20_000_000, max_points: int = 50_000) -> tuple[array, array, array, array]:
    """``decode`` as arrays of t_us, tz_off_s, lon and lat."""
    if max_points <= 0:
        raise ValueError("max_points must be positive")
    try:
        packed = base64.b64decode(re.sub(r"[\r\n]", "", route), validate=True)
    except (binascii.Error, ValueError) as e:
        raise CodecError("invalid", f"codec: base64 decode: {e}") from e
    raw = inflate(packed, max_bytes).decode("utf-8", "replace")
    points = array("q"), array("i"), array("d"), array("d")
    for i, item in enumerate(_elements(raw, max_points)):
        pos = item.get("pos") if isinstance(item, dict) else None
        if not isinstance(item, dict) or not isinstance(pos or {}, dict):
            raise CodecError("invalid", f"codec: point {i} is not an object")
        try:
            t_us, off = parse_time(item.get("t"))
        except ValueError as e:
            raise CodecError("invalid", f"codec: parse time at index {i}: {e}") from e
        xy = [(pos or {}).get(c, 0.0) or 0.0 for c in "xy"]
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in xy):
            raise CodecError("invalid", f"codec: invalid coordinates at index {i}")
        lon, lat = map(float, xy)
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise CodecError("invalid", f"codec: coordinates out of range at index {i}: lon={lon} lat={lat}")
        for column, value in zip(points, (t_us, off, lon, lat)):
            column.append(value)
    return points


def _elements_of(t_us: list, tz_off_s: list, lon: list, lat: list) -> str:
    """The array's elements, without its brackets."""
    return json.dumps([{"t": format_time(t, off or 0), "pos": {"x": x, "y": y}} for t, off, x, y in zip(t_us, tz_off_s, lon, lat)], separators=(",", ":"))[1:-1]


def encode(points: list[tuple[int, int, float, float]]) -> str:
    wire = [{"t": format_time(t, off), "pos": {"x": lon, "y": lat}} for t, off, lon, lat in points]
    return base64.b64encode(zlib.compress(json.dumps(wire, separators=(",", ":")).encode(), 9)).decode()


def encode_columns(t_us: np.ndarray, tz_off_s: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> str:
    """``encode`` of arrays, compressed piece by piece."""
    packer, parts = zlib.compressobj(9), []
    for a in range(0, len(t_us), 10_000):
        part = _elements_of(*(c[a : a + 10_000].tolist() for c in (t_us, tz_off_s, lon, lat)))
        parts.append(packer.compress((("," if a else "[") + part).encode()))
    parts.append(packer.compress(b"]" if len(t_us) else b"[]") + packer.flush())
    return base64.b64encode(b"".join(parts)).decode()


def decode_routes(tasks: DataFrame, key: str = "task_key", column: str = "route_compressed", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(task_key, error_kind, error, points): points in wire order, or why not."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        sizes = [0 if c is None else len(c[0]) for *_, c in rows]
        ends = np.cumsum([0, *sizes], dtype=np.int32)
        lengths = [np.arange(n, dtype=np.int32) for n in sizes]
        columns = [np.concatenate([np.frombuffer(c[x], t) for *_, c in rows if c is not None and len(c[x])] or [np.zeros(0, t)]) for x, t in enumerate((np.int64, np.int32, np.float64, np.float64))]
        parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip([np.concatenate(lengths), *columns], _ARROW_POINT)], fields=list(_ARROW_POINT))
        points = pa.ListArray.from_arrays(pa.array(ends), parts, mask=pa.array([c is None for *_, c in rows]))
        keys, kinds, errors = (pa.array([r[x] for r in rows], pa.string()) for x in range(3))
        return pa.RecordBatch.from_arrays([keys, kinds, errors, points.cast(pa.list_(_ARROW_POINT))], names=["task_key", "error_kind", "error", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for task, route in zip(b.column("task_key"), b.column("route")):
                try:
                    found = decode_columns(route.as_py() or "", config.max_bytes, config.max_points)
                    rows.append((task.as_py(), None, None, found))
                    held += len(found[0])
                except CodecError as e:
                    rows.append((task.as_py(), e.kind, clamp_error(str(e)), None))
                if held > _HELD or len(rows) >= 1000:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    slim = tasks.select(F.col(key).cast("string").alias("task_key"), F.col(column).cast("string").alias("route"))
    return slim.mapInArrow(run, f"task_key string, error_kind string, error string, points array<{POINT}>")


def decode_points(tasks: DataFrame, key: str = "task_key", column: str = "route_compressed", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(track_id, error_kind, error, seq, t_us, tz_off_s, lon, lat): a row for each point;
    a route that can't be read or is empty has one row without a seq."""

    def rows(task: str, kind: str | None, error: str | None, *columns) -> pa.RecordBatch:
        n = len(columns[0])
        same = lambda x: pa.repeat(pa.scalar(x, pa.string()), n)
        return pa.RecordBatch.from_arrays([same(task), same(kind), same(error), *(pa.array(c, f.type) for c, f in zip(columns, _ARROW_POINT))], names=["track_id", "error_kind", "error", *(f.name for f in _ARROW_POINT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [[None]] * len(list(_ARROW_POINT))
        for b in batches:
            for task, route in zip(b.column("track_id"), b.column("route")):
                try:
                    found = decode_columns(route.as_py() or "", config.max_bytes, config.max_points)
                except CodecError as e:
                    yield rows(task.as_py(), e.kind, clamp_error(str(e)), *none)
                    continue
                columns = [np.frombuffer(c, t) for c, t in zip(found, (np.int64, np.int32, np.float64, np.float64)) if len(c)]
                if not columns:
                    yield rows(task.as_py(), None, None, *none)
                for a in range(0, len(found[0]), _HELD):
                    part = [c[a : a + _HELD] for c in columns]
                    yield rows(task.as_py(), None, None, np.arange(a, a + len(part[0]), dtype=np.int32), *part)

    slim = tasks.select(F.col(key).cast("string").alias("track_id"), F.col(column).cast("string").alias("route"))
    n = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * tasks.sparkSession.sparkContext.defaultParallelism)
    # a number is given, since few bytes of routes are much work
    return slim.repartition(n, "track_id").mapInArrow(run, "track_id string, error_kind string, error string, seq int, t_us long, tz_off_s int, lon double, lat double")


def exploded(decoded: DataFrame) -> DataFrame:
    """Points of readable tracks as (track_id, seq, t_us, tz_off_s, lon, lat)."""
    return decoded.where("points is not null").select(F.col("task_key").alias("track_id"), F.explode("points").alias("p")).select("track_id", "p.*")


def encode_tracks(points: DataFrame) -> DataFrame:
    """(track_id, route_compressed) from point rows, in the order of seq. Sorted rows
    are compressed as they come; no track is held but for its compressed form."""
    spark, order = points.sparkSession, ["track_id", "seq", "t_us", "tz_off_s", "lon", "lat"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, packer, parts = None, None, []

        def sent() -> pa.RecordBatch:
            parts.append(packer.compress(b"]") + packer.flush())
            route = base64.b64encode(b"".join(parts)).decode()
            return pa.RecordBatch.from_arrays([pa.array([track], pa.string()), pa.array([route], pa.string())], names=["track_id", "route_compressed"])

        for b in batches:
            rows = b.to_pydict()
            for key, own in groupby(range(b.num_rows), rows["track_id"].__getitem__):
                if packer is None or key != track:
                    if packer is not None:
                        yield sent()
                    track, packer, parts, comma = key, zlib.compressobj(9), [], "["
                own = list(own)
                part = _elements_of(*(rows[c][own[0] : own[-1] + 1] for c in ("t_us", "tz_off_s", "lon", "lat")))
                parts.append(packer.compress((comma + part).encode()))
                comma = ","
            parts = [x for x in parts if x]
        if packer is not None:
            yield sent()

    dealt = points.select(F.col("track_id").cast("string").alias("track_id"), *order[1:]).repartition(n, "track_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "track_id string, route_compressed string")
