"""Storage layouts: time partitions of a chosen width, clustering, compaction by age, and checks across layouts."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebucket import WIDTHS, bucket, ntz, within
from ..sources.versions import Table

PARTITION = "chunk"
CLUSTERING = {"time": ("event_time",), "meter": ("meter_id", "event_time")}


def _staged(df: DataFrame, path: str, width: str, cluster: str, tasks: int | None, rows_per_task: int) -> tuple[Table, dict]:
    """Write ``df`` aside, in chunks.

    Rows are dealt by (chunk, salt), and a chunk gets as many salts as ``rows_per_task`` asks for by its own count, which
    a first pass takes: so a chunk of any size is written by enough tasks, and a small one by one.
    """
    rows = df.withColumn(PARTITION, bucket(F.col("event_time"), width))
    sizes = rows.groupBy(PARTITION).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_salts"))  # a row a chunk
    salted = rows.join(sizes, PARTITION).withColumn("_salt", F.pmod(F.xxhash64("meter_id"), F.col("_salts")))
    by = ([tasks] if tasks else []) + [PARTITION, "_salt"]
    dealt = salted.repartition(*by).drop("_salts", "_salt").sortWithinPartitions(PARTITION, *CLUSTERING[cluster])
    table = Table(df.sparkSession, path)
    return table, table.stage(dealt, PARTITION, **{"compression": "zstd", "parquet.bloom.filter.enabled#meter_id": "true"})


def write(df: DataFrame, path: str, width: str = "1 day", cluster: str = "meter", tasks: int | None = None, rows_per_task: int = 5_000_000, append: bool = False) -> DataFrame:
    """Make ``df`` the table, or add it: one directory for each time chunk, rows clustered inside, with bloom filters on the meter.  Returns what was written."""
    table, staged = _staged(df, path, width, cluster, tasks, rows_per_task)
    table.point(staged, append=append)
    return table.read(told={"parts": {x: [staged["version"]] for x in staged["parts"]}, "facts": {"schema": staged["schema"]}}).drop(PARTITION)


def _start(part: str) -> datetime:
    return datetime.fromisoformat(unquote(part.split("=", 1)[1]))


def _chunks(table: Table, ranges: list[tuple[datetime, datetime]], width: str) -> list[str]:
    """The chunks that meet one of some half-open ranges, by the pointer alone."""
    wide = timedelta(seconds=WIDTHS[width])
    return [x for x in table.pointer()[1]["parts"] if any(low < _start(x) + wide and _start(x) < high for low, high in ranges)]


def read_ranges(spark: SparkSession, path: str, ranges: list[tuple[datetime, datetime]], width: str = "1 day") -> DataFrame:
    """The rows of some half-open time ranges; other chunks are neither listed nor read, and the scan gets the ranges."""
    table = Table(spark, path)
    parts = _chunks(table, ranges, width)
    inside: list[Column] = [within(F.col("event_time"), str(low), str(high)) for low, high in ranges]
    rows = table.read(parts).where(F.col(PARTITION).isin([_start(x) for x in parts]))
    return rows.where(reduce(Column.__or__, inside, F.lit(False))).drop(PARTITION)


def read(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, width: str = "1 day") -> DataFrame:
    """The table, or a half-open time range of it; the range also prunes chunks."""
    table = Table(spark, path)
    if start is None:
        return table.read().drop(PARTITION)
    low, high = datetime.fromisoformat(start), datetime.fromisoformat(end)
    first = bucket(ntz(start), width)
    df = table.read(_chunks(table, [(low, high)], width))
    return df.where((F.col(PARTITION) >= first) & (F.col(PARTITION) < ntz(end)) & within(F.col("event_time"), start, end)).drop(PARTITION)


def copy_chunks(df: DataFrame, path: str, starts: list[str], width: str = "1 day", cluster: str = "meter") -> dict[str, int]:
    """Copy one chunk at a time; returns the rows of each.  Doing a chunk again replaces it, in one step."""
    loaded = {}
    for start in starts:
        end = F.timestamp_add("SECOND", F.lit(WIDTHS[width]), ntz(start))
        table, staged = _staged(df.where((F.col("event_time") >= ntz(start)) & (F.col("event_time") < end)), path, width, cluster, None, 5_000_000)
        own = [x for x in table.pointer()[1]["parts"] if _start(x) == datetime.fromisoformat(start)]
        table.point(staged, own)
        loaded[start] = table.read(x for x in table.pointer()[1]["parts"] if _start(x) == datetime.fromisoformat(start)).count()
    return loaded


def compact(spark: SparkSession, path: str, cutoff: str, width: str = "1 day", cluster: str = "meter", paused: bool = False) -> int:
    """Rewrite the chunks that ended before ``cutoff`` clustered and compressed, in one step; returns how many."""
    table = Table(spark, path)
    now = table.pointer()
    ended = [x for x in now[1]["parts"] if _start(x) + timedelta(seconds=WIDTHS[width]) <= datetime.fromisoformat(cutoff)]
    if paused or not ended:
        return 0
    _, staged = _staged(table.read(ended, now[1]).drop(PARTITION), path, width, cluster, None, 5_000_000)
    table.point(staged, ended, now)
    return len(ended)


def storage_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(layout) Two listings of ``storage`` side by side: bytes, ratio, percent saved, and the share of chunks that got smaller."""
    a = before.select("partition", F.col("bytes").alias("b"))
    both = a.join(after.select("partition", F.col("bytes").alias("c")), "partition", "left")
    facts = both.agg(F.count(F.lit(1)).alias("chunks"), F.sum("b").alias("bytes_before"), F.sum(F.coalesce("c", "b")).alias("bytes_after"), F.count_if(F.col("c") < F.col("b")).alias("smaller"))
    b, c = F.col("bytes_before"), F.col("bytes_after")
    return facts.select("chunks", "bytes_before", "bytes_after", F.try_divide(b, c).alias("ratio"), (100 * F.try_divide(b - c, b)).alias("saved_pct"), (100 * F.try_divide("smaller", "chunks")).alias("compressed_pct"))


def checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Per layout: rows, meters, time range and exact sums, and whether they equal the first layout's."""
    facts = None
    for name, df in tables.items():
        one = df.agg(
            F.lit(name).alias("layout"), F.count(F.lit(1)).alias("readings"), F.countDistinct("meter_id").alias("meters"), F.min("event_time").alias("first_event"),
            F.max("event_time").alias("last_event"), F.sum(F.col("power_kw").cast("decimal(20,8)")).alias("power"), F.sum(F.col("energy_kwh").cast("decimal(20,8)")).alias("energy"),
        )
        facts = one if facts is None else facts.unionByName(one)
    base = facts.where(F.col("layout") == next(iter(tables))).select(F.col("readings").alias("r0"), F.col("power").alias("p0"), F.col("energy").alias("e0"))
    same = (F.col("readings") == F.col("r0")) & (F.abs(F.col("power") - F.col("p0")) <= 0.001) & (F.abs(F.col("energy") - F.col("e0")) <= 0.001)
    return facts.crossJoin(F.broadcast(base)).select(
        "layout", "readings", "meters", "first_event", "last_event", F.col("power").cast("double").alias("sum_power_kw"), F.col("energy").cast("double").alias("sum_energy_kwh"), same.alias("matches")
    )
