"""The five dashboard panels, each from raw readings and from a stored rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum, percent
from ..functions.timebucket import local, local_bucket, snapped, within

KEYS = {1: ["time", "metric"], 2: ["time"], 3: ["period"], 4: ["time"], 5: ["region"]}


def _sums(df: DataFrame, *keys: Column) -> DataFrame:
    n = F.sum("reading_count") if "reading_count" in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(exact_sum("energy_kwh").alias("energy_kwh"), n.alias("reading_count"))


def _range(df: DataFrame, start: str, end: str) -> tuple[DataFrame, Column]:
    """Rows of the range, snapped to whole local days, and their time."""
    t = F.col("bucket" if "bucket" in df.columns else "event_time")
    return df.where(within(t, *snapped(start, end))), t


def hourly_regional(df: DataFrame, start: str, end: str, meters: DataFrame | None = None) -> DataFrame:
    df, t = _range(df, start, end)
    if meters is not None:
        df = df.join(meters.select("meter_id", "region"), "meter_id")
    return _sums(df, local_bucket(t, "1 hour").alias("time"), F.col("region").alias("metric"))


def daily_network(df: DataFrame, start: str, end: str) -> DataFrame:
    df, t = _range(df, start, end)
    return _sums(df, local_bucket(t, "1 day").alias("time"))


def seven_day_network(df: DataFrame, start: str, end: str, origin: str) -> DataFrame:
    """Periods of seven local days counted from ``origin``, a local midnight."""
    df, t = _range(df, start, end)
    first = local_bucket(t, "7 days", origin=origin)
    out = _sums(df, first.alias("_first"))
    return out.select(F.date_format(local(F.col("_first")), "dd MMM").alias("period"), "energy_kwh", "reading_count")


def meter_daily(df: DataFrame, start: str, end: str, meter: int) -> DataFrame:
    df, t = _range(df.where(F.col("meter_id") == meter), start, end)
    return _sums(df, local_bucket(t, "1 day").alias("time"))


def completeness(df: DataFrame, start: str, end: str, meters: DataFrame, slots_a_day: int = 96) -> DataFrame:
    """Share of planned readings by region; regions without readings stay, with 0."""
    low, high = snapped(start, end)
    df, _ = _range(df, start, end)
    if "region" not in df.columns:
        df = df.join(meters.select("meter_id", "region"), "meter_id")
    observed = _sums(df, F.col("region")).select("region", "reading_count")
    registered = meters.groupBy("region").agg(F.count(F.lit(1)).alias("meters"))
    days = F.timestamp_diff("DAY", low, high)
    n = F.coalesce("reading_count", F.lit(0))
    planned = F.col("meters") * slots_a_day * days
    return registered.join(observed, "region", "left").select("region", n.alias("reading_count"), planned.alias("planned_readings"), percent(n, planned).alias("completeness_pct"))


def meter_list(meters: DataFrame) -> DataFrame:
    """The dashboard's meter variable, as text."""
    return meters.select(F.col("meter_id").cast("string").alias("meter"))
