"""Tracks derived from the ``events`` table: one per day, driving and standing
by turns, with far-off readings and silent router answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def track_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, seq, t_us, tz_off_s, lon, lat, snap_m)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    e = e.select(
        F.date_format(ts, "yyyy-MM-dd").alias("track_id"), F.timestamp_diff("MICROSECOND", epoch, ts).alias("t_us"), "event_id", "user_id", "event_type",
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("k"),
    )
    day = (F.col("t_us") % 86_400_000_000) / 1e6
    turn = F.floor(day / 7200)
    at = turn * 4800 + F.least(day - turn * 7200, F.lit(4800.0))
    off = F.when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), 0.35).otherwise(0.0)
    seq = (F.row_number().over(Window.partitionBy("track_id").orderBy("t_us", "event_id")) - 1).cast("int")
    return e.select(
        "track_id", seq.alias("seq"), "t_us", F.lit(0).alias("tz_off_s"), (F.lit(37.6) + at * 0.0003 + off).alias("lon"),
        (F.lit(55.75) + (F.col("event_id") % 7 - 3) * 0.0002).alias("lat"), F.when(F.col("k") % 29 != 13, F.col("k").cast("double")).alias("snap_m"),
    )


#: The same view for SQL engines, as the beginning of a WITH list.
VIEW_SQL = """e AS (SELECT strftime(ts, '%Y-%m-%d') AS track_id, epoch_us(ts) AS t_us, event_id, user_id, event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k, (epoch_us(ts) % 86400000000) / 1e6 AS day FROM events),
v AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t_us, event_id) - 1 AS INTEGER) AS seq, t_us,
  37.6 + (floor(day / 7200) * 4800 + least(day - floor(day / 7200) * 7200, 4800.0)) * 0.0003::DOUBLE + CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS lon,
  55.75::DOUBLE + (event_id % 7 - 3) * 0.0002::DOUBLE AS lat, CASE WHEN k % 29 <> 13 THEN k::DOUBLE END AS snap_m FROM e)"""
