"""Stored rollups: tumbling buckets, refresh of whole buckets, a watermark, and real-time reads.

A stored rollup has only what a refresh put there; a bucket that is absent has not been computed, which isn't zero.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.timebucket import WIDTHS, ZONE, bucket, local_bucket, local_day, ntz, within
from ..sources.scratch import listed, remove, text_created, there
from ..sources.versions import Table
from . import layout


@dataclass(frozen=True)
class Rollup:
    """What a rollup groups by besides its bucket."""

    width: str
    keys: tuple[str, ...] = ()
    zone: str = ZONE
    time: str = "event_time"

    def bucket(self) -> Column:
        return local_bucket(F.col(self.time), self.width, self.zone)

    def compute(self, readings: DataFrame, meters: DataFrame | None = None) -> DataFrame:
        """Bucket sums and counts; averages are made from them at read time."""
        df = readings.join(meters.select("meter_id", "region"), "meter_id") if "region" in self.keys else readings
        return df.groupBy(self.bucket().alias("bucket"), *self.keys).agg(
            exact_sum("energy_kwh").alias("energy_kwh"), exact_sum("power_kw").alias("power_kw_sum"), F.count(F.lit(1)).alias("reading_count")
        )


QUARTER_REGION = Rollup("15 minutes", ("region",))
HOURLY_REGION = Rollup("1 hour", ("region",))
DAILY_METER = Rollup("1 day", ("meter_id",))


def whole_buckets(start: datetime, end: datetime, seconds: int) -> tuple[datetime, datetime]:
    """The buckets that lie wholly inside a window."""
    zero = datetime(2000, 1, 1)
    low = -(-(start - zero) // timedelta(seconds=seconds))
    high = (end - zero) // timedelta(seconds=seconds)
    return zero + timedelta(seconds=seconds) * low, zero + timedelta(seconds=seconds) * max(high, low)


@dataclass(frozen=True)
class Policy:
    """How far back and how close to now a scheduled refresh reaches."""

    start_offset: timedelta = timedelta(days=3)
    end_offset: timedelta = timedelta(hours=1)

    def window(self, now: datetime, width: str) -> tuple[datetime, datetime]:
        return whole_buckets(now - self.start_offset, now - self.end_offset, WIDTHS[width])


class Touched:
    """The quarter hours that landed readings fell in, landing by landing; a store remembers how many landings it has taken up."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Table(spark, path)

    def add(self, readings: DataFrame, time: str = "event_time") -> None:
        self.table.put(readings.groupBy(bucket(F.col(time), "15 minutes").alias("quarter")).agg(F.count(F.lit(1)).alias("readings")), append=True)

    def since(self, landings: int) -> tuple[DataFrame | None, int]:
        """(quarter, readings) of the landings after the first ``landings``, None if there is none, and how many there are by now."""
        told = self.table.pointer()[1]
        versions = told["parts"].get("", [])
        return (self.table.read(told=told | {"parts": {"": versions[landings:]}}) if versions[landings:] else None), len(versions)


def land(readings: DataFrame, path: str, touched: Touched, width: str = "1 day", cluster: str = "meter") -> None:
    """Add readings to a chunked table, then tell which quarter hours they fell in.

    In this order, so that a refresh between the two can't take the news for done.  A landing that broke off between them has to tell it
    once more (``Touched.add``); telling it twice only costs a refresh.
    """
    touched.add(layout.write(readings, path, width, cluster, append=True))


def merged(ranges: list[tuple[datetime, datetime]], most: int = 64) -> list[tuple[datetime, datetime]]:
    """Half-open ranges without overlap, in order.  Of more than ``most`` those with the smallest gaps become one, which refreshes more but nothing wrong."""
    out: list[tuple[datetime, datetime]] = []
    for low, high in sorted(x for x in ranges if x[0] < x[1]):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    gaps = sorted(range(1, len(out)), key=lambda k: out[k - 1][1] - out[k][0])  # widest first
    cuts = [0, *sorted(gaps[: most - 1]), len(out)]
    return [(out[a][0], out[b - 1][1]) for a, b in zip(cuts, cuts[1:])] if out else []


@dataclass
class Store:
    """A rollup's table, one partition for each local day of buckets.  Each refresh shows in one step, with the watermark it leaves."""

    spark: SparkSession
    path: str
    rollup: Rollup
    log: list = field(default_factory=list)

    def __post_init__(self):
        self.table = Table(self.spark, f"{self.path}/table")

    @property
    def paused(self) -> bool:
        return there(self.spark, f"{self.path}/paused")

    def pause(self) -> None:
        """No refresh begins from now on; one that runs goes on to its end."""
        text_created(self.spark, f"{self.path}/paused", "")

    def resume(self) -> None:
        remove(self.spark, f"{self.path}/paused")

    def wait_until_idle(self, seconds: float = 60, gone_after: float = 3600) -> bool:
        """Wait for the refreshes that run; False if one still does after ``seconds``.  One that began ``gone_after`` seconds ago counts as broken off."""
        end = time.monotonic() + seconds
        while any(time.time() - float(x.rsplit("/", 1)[-1].split("-")[0]) < gone_after for x in listed(self.spark, f"{self.path}/running")):
            if time.monotonic() > end:
                return False
            time.sleep(0.1)
        return True

    @contextmanager
    def _running(self):
        mark = f"{self.path}/running/{time.time()}-{uuid.uuid4().hex}"
        text_created(self.spark, mark, "")
        try:
            yield
        finally:
            remove(self.spark, mark)

    def refresh(self, readings: DataFrame, start: datetime, end: datetime, meters: DataFrame | None = None) -> None:
        """Recompute all whole buckets of a window; other buckets stay as they are."""
        low, high = whole_buckets(start, end, WIDTHS[self.rollup.width])
        if self.paused or low >= high:
            return
        with self._running():
            new = self.rollup.compute(readings.where(within(F.col(self.rollup.time), str(low), str(high))), meters)
            self._replace(new, [(low, high)], self.table.pointer())
        self.log.append((low, high))

    def take_up(self, read: Callable[[list[tuple[datetime, datetime]]], DataFrame], touched: Touched, until: datetime, meters: DataFrame | None = None) -> list[tuple[datetime, datetime]]:
        """Refresh the buckets that landings touched since the last time, and all from the watermark to ``until``; the ranges that were recomputed.

        ``read`` gives the readings of some half-open ranges, so only chunks that meet them are read.  Only whole buckets that end by ``until``
        are stored; what is touched above stays to be computed when it is read.
        """
        if self.paused:
            return []
        with self._running():
            now = self.table.pointer()
            news, landings = touched.since(now[1]["facts"].get("touched", 0))
            start = lambda t: local_bucket(t, self.rollup.width, self.rollup.zone)
            half = F.expr(f"interval {WIDTHS[self.rollup.width] * 3 // 2} seconds")  # into the next bucket, whatever the clocks do
            end = self.spark.range(1).select(start(F.lit(str(until)).cast("timestamp_ntz"))).first()[0]
            mark, ranges = self.watermark(), []
            if news is not None:
                low = start(F.col("quarter")).alias("low")
                by_day = news.select(low).where(F.col("low") < F.lit(str(end)).cast("timestamp_ntz")).groupBy(local_day(F.col("low"), self.rollup.zone))
                ranges = [tuple(x)[1:] for x in by_day.agg(F.min("low"), start(F.max("low") + half)).collect()]  # a row a day
            if mark is not None:
                ranges.append((mark, end))
            ranges = merged(ranges)
            if ranges:
                self._replace(self.rollup.compute(read(ranges), meters), ranges, now, touched=landings)
        self.log += ranges
        return ranges

    def _replace(self, new: DataFrame, ranges: list[tuple[datetime, datetime]], now: tuple[int, dict], **facts) -> None:
        """``new`` in place of the buckets of some ranges: their days are written anew, and what the ranges don't cover is carried over."""
        day = timedelta(days=1)
        parts = [x for x in now[1]["parts"] if any(f"day={(low - day).date()}" <= x <= f"day={(high + day).date()}" for low, high in ranges)]
        rows = new.withColumn("day", local_day(F.col("bucket"), self.rollup.zone))
        if parts:
            inside = reduce(Column.__or__, [within(F.col("bucket"), str(low), str(high)) for low, high in ranges])
            rows = rows.unionByName(self.table.read(parts, now[1]).where(~inside))
        staged = self.table.stage(rows, "day")
        after = {k: v for k, v in now[1]["parts"].items() if k not in parts} | {k: [staged["version"]] for k in staged["parts"]}
        mark = None
        if after:
            newest = self.table.read([max(after)], {"parts": after, "facts": {"schema": staged["schema"]}}).agg(F.max("bucket")).first()[0]
            mark = str(newest + timedelta(seconds=WIDTHS[self.rollup.width]))
        self.table.point(staged, parts, now, watermark=mark, **facts)

    def tick(self, readings: DataFrame, now: datetime, policy: Policy, meters: DataFrame | None = None) -> tuple[datetime, datetime] | None:
        """One run of the policy: refresh its window as of ``now``; None if the store is paused or the window is empty."""
        low, high = policy.window(now, self.rollup.width)
        if self.paused or low >= high:
            return None
        self.refresh(readings, low, high, meters)
        return low, high

    def read(self, start=None, end=None, number: int | None = None) -> DataFrame | None:
        """Only what is stored, now or as the ``number``-th refresh left it; a range of buckets (columns or UTC text) also prunes the days."""
        at, told = self.table.pointer(number)
        if at < 0:
            return None
        df = self.table.read(told=told)
        if start is not None:
            low, high = (ntz(x) if isinstance(x, str) else x for x in (start, end))
            df = df.where(within(F.col("bucket"), low, high) & F.col("day").between(local_day(low, self.rollup.zone), local_day(high, self.rollup.zone)))
        return df.drop("day")

    def watermark(self, number: int | None = None) -> datetime | None:
        """The end of the newest stored bucket, as it is kept beside the table; no row is read for it."""
        mark = self.table.pointer(number)[1]["facts"].get("watermark")
        return datetime.fromisoformat(mark) if mark else None

    def real_time(self, readings: DataFrame, meters: DataFrame | None = None, number: int | None = None) -> DataFrame:
        """Stored below the watermark, computed from readings above it; late rows below it wait for a refresh."""
        mark = self.watermark(number)
        if mark is None:
            return self.rollup.compute(readings, meters)
        fresh = self.rollup.compute(readings.where(F.col(self.rollup.time) >= ntz(str(mark))), meters)
        return self.read(number=number).where(F.col("bucket") < ntz(str(mark))).unionByName(fresh)


def freshness(windows: DataFrame, rows: DataFrame, width: str = "1 day") -> DataFrame:
    """Per window (name, start_time, end_time): energy and rows inside; empty windows count zero rows.

    Windows are listed under the buckets that they meet, so rows find theirs by an equi-join before the exact condition, and the
    scan gets the bounds of all windows.
    """
    low, high = windows.agg(F.min("start_time"), F.max("end_time")).first()
    inside = within(F.col("event_time"), str(low), str(high)) if low and high else F.lit(False)
    seconds = F.expr(f"interval {WIDTHS[width]} seconds")
    last = F.col("end_time") - F.expr("interval 1 microsecond")
    listed_ = windows.where("start_time < end_time").select("name", "start_time", "end_time", F.explode(F.sequence(bucket(F.col("start_time"), width), bucket(last, width), seconds)).alias("_bucket"))
    keyed = rows.where(inside).select("event_time", "energy_kwh", bucket(F.col("event_time"), width).alias("_bucket"))
    met = listed_.join(keyed, "_bucket").where("event_time >= start_time AND event_time < end_time")
    sums = met.groupBy("name").agg(exact_sum("energy_kwh").alias("energy_kwh"), F.count(F.lit(1)).alias("row_count"))
    return windows.select("name").distinct().join(sums, "name", "left").select("name", "energy_kwh", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"))
