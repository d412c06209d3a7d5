"""The named queries over the event tables, each with its SQL twin for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.timebucket import bucket, iso_with_offset, local, local_day, snapped, trailing_number, utc_of_iso
from .operators import analysis, compare, layout, quality, rollups
from .plans import evidence, forecast, panels
from .sources import readings as src
from .sources import stored
from .sources.scratch import new_path
from .sources.versions import Table
from .streaming import live, transport

DAY = ("2024-01-10 22:00:00", "2024-01-11 22:00:00")
WEEK = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")
GRID = ("2024-01-01 00:00:00", "2024-01-29 00:00:00")
MARK = "2024-01-20 22:00:00"
RANGE = ("2024-01-07 22:00:00", "2024-01-14 22:00:00")
METER = 7
SLOT = "6 hours"
#: The events have a reading a meter and hour at most here and there, so slots of the day are an hour; the meters' own are 15 minutes.
SLOT_MINUTES = 60

R, RAW = src.readings, src.raw_readings


def M(s: SparkSession, d: str) -> DataFrame:  # noqa: N802
    """The meter dimension, written once and read by every query."""
    return stored.table(s, d, "meters", lambda: src.meters(s, d))


def L(s: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return src.labelled_events(M(s, d))


#: Common table expressions of the SQL twins, by name.
CTES = {
    "r": "SELECT user_id AS meter_id, ts AS event_time, ts + to_minutes(CASE WHEN event_id % 50 = 0 THEN 30 + event_id % 151 ELSE 15 END) AS received_time, value AS power_kw, 226.0::DOUBLE + event_id % 8 AS voltage_v, value * 0.25::DOUBLE AS energy_kwh, value::DECIMAL(20,8) AS p, (value * 0.25::DOUBLE)::DECIMAL(20,8) AS e, ts + INTERVAL 2 HOUR AS t, event_id FROM events",
    "raw": "SELECT * FROM r UNION ALL SELECT * FROM r WHERE event_id % 200 = 0 UNION ALL SELECT * REPLACE (power_kw + 1 AS power_kw, p + 1 AS p) FROM r WHERE event_id % 500 = 1",
    "m": "SELECT DISTINCT user_id AS meter_id, 'Region ' || (user_id % 10 + 1) AS region, CASE WHEN user_id % 20 < 13 THEN 'residential' WHEN user_id % 20 < 18 THEN 'commercial' ELSE 'industrial' END AS customer_type FROM events",
    "obs": f"SELECT meter_id, time_bucket(INTERVAL 6 HOUR, event_time, TIMESTAMP '2000-01-01') AS event_time, count(*) AS copies, min(received_time) AS received_time FROM r WHERE event_time >= '{GRID[0]}' AND event_time < '{GRID[1]}' GROUP BY 1, 2",
    "grid": f"SELECT meter_id, unnest(generate_series(TIMESTAMP '{GRID[0]}', TIMESTAMP '{GRID[1]}' - INTERVAL 6 HOUR, INTERVAL 6 HOUR)) AS event_time FROM m",
    "miss": "SELECT g.* FROM grid g LEFT JOIN obs o USING (meter_id, event_time) WHERE o.meter_id IS NULL",
    "pairs": "SELECT meter_id, event_time, count(*) AS copies, min(received_time) AS received_time FROM raw GROUP BY 1, 2",
    "dup": "SELECT meter_id, event_time, count(*) AS copies, count(DISTINCT (received_time, power_kw, voltage_v, energy_kwh)) AS distinct_versions, sum(e)::DOUBLE - min(energy_kwh) AS extra_energy_kwh FROM raw GROUP BY 1, 2 HAVING count(*) > 1",
    "clean": "SELECT DISTINCT * EXCLUDE (event_id) FROM raw",
    "net": "SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS event_time, sum(p)::DOUBLE AS kw FROM r GROUP BY 1",
    "day": "SELECT t::DATE AS day, sum(e)::DOUBLE AS energy_kwh, count(*) AS readings FROM r GROUP BY 1",
    "w": f"SELECT *, isodow(t) >= 6 AS weekend, ((hour(t) * 60 + minute(t)) // {SLOT_MINUTES} * {SLOT_MINUTES})::INT AS slot FROM r",
    "base": "SELECT meter_id, slot, weekend, quantile_cont(power_kw, 0.5) AS median_kw, count(*) AS n_days FROM w GROUP BY meter_id, slot, weekend",
    "ratio": "SELECT w.*, b.median_kw, w.power_kw / b.median_kw AS ratio FROM w JOIN base b USING (meter_id, slot, weekend)",
    "flag": "SELECT meter_id, event_time, power_kw, median_kw, ratio, CASE WHEN power_kw >= 2.0::DOUBLE * median_kw THEN 'high' ELSE 'low' END AS flag_type FROM ratio WHERE power_kw >= 2.0::DOUBLE * median_kw OR power_kw <= 0.3::DOUBLE * median_kw",
    "lab": "SELECT meter_id, TIMESTAMP '2024-01-01' + to_days((meter_id % 28)::INT) AS start_time, TIMESTAMP '2024-01-02' + to_days((meter_id % 28)::INT) AS end_time, CASE WHEN meter_id % 8 = 0 THEN 'demand_spike' ELSE 'unusual_drop' END AS event_type FROM m WHERE meter_id % 4 = 0",
    "hour": "SELECT region, date_trunc('hour', t) AS hour_start, sum(e)::DOUBLE AS energy_kwh, count(*) AS readings FROM r JOIN m USING (meter_id) GROUP BY 1, 2",
    "hgrid": "SELECT g.region, g.hour_start, h.energy_kwh, h.readings FROM (SELECT region, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-28 23:00:00', INTERVAL 1 HOUR)) AS hour_start FROM (SELECT DISTINCT region FROM m)) g LEFT JOIN hour h USING (region, hour_start)",
    "pday": "SELECT region, date_trunc('day', hour_start) + INTERVAL 1 DAY AS origin, CASE WHEN count(energy_kwh) >= 24 THEN sum(energy_kwh::DECIMAL(20,8))::DOUBLE / count(energy_kwh) END AS prev_day_mean FROM hgrid GROUP BY 1, 2",
    "feat": "SELECT g.region, g.hour_start, g.energy_kwh, g.readings, date_trunc('day', g.hour_start) AS origin, hour(g.hour_start)::INT AS hour, (isodow(g.hour_start) - 1)::INT AS dow, a1.energy_kwh AS lag_24h, a2.energy_kwh AS lag_48h, a7.energy_kwh AS lag_168h, (a1.energy_kwh + a2.energy_kwh + a3.energy_kwh + a4.energy_kwh + a5.energy_kwh + a6.energy_kwh + a7.energy_kwh) / 7 AS prev_week_same_hour_mean, p.prev_day_mean FROM hgrid g "
    + " ".join(f"LEFT JOIN hgrid a{d} ON a{d}.region = g.region AND a{d}.hour_start = g.hour_start - INTERVAL {24 * d} HOUR" for d in range(1, 8))
    + " LEFT JOIN pday p ON p.region = g.region AND p.origin = date_trunc('day', g.hour_start)",
    "sp": "SELECT *, CASE WHEN hour_start < '2024-01-15' THEN 'train' WHEN hour_start < '2024-01-22' THEN 'validation' ELSE 'test' END AS split, energy_kwh IS NOT NULL AND lag_24h IS NOT NULL AND lag_48h IS NOT NULL AND lag_168h IS NOT NULL AND prev_day_mean IS NOT NULL AND prev_week_same_hour_mean IS NOT NULL AS complete FROM feat",
    "pred": "SELECT region, hour_start, hour, dow, energy_kwh, lag_24h AS prediction FROM feat WHERE energy_kwh IS NOT NULL AND lag_24h IS NOT NULL",
    "err": "SELECT *, (prediction - energy_kwh) AS d FROM pred",
}
NEEDS = {
    "raw": "r", "obs": "r", "grid": "m", "miss": "grid obs", "pairs": "raw", "dup": "raw", "clean": "raw", "net": "r", "day": "r", "w": "r", "base": "w", "ratio": "w base", "flag": "ratio", "lab": "m",
    "hour": "r m", "hgrid": "hour m", "pday": "hgrid", "feat": "hgrid pday", "sp": "feat", "pred": "feat", "err": "pred",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(uses: str, text: str) -> str:
    """``text`` with the expressions it uses, and those they use, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for x in uses.split():
        add(x)
    return ("WITH " + ", ".join(f"{x} AS MATERIALIZED ({CTES[x]})" for x in order) + " " if order else "") + text


def query(name: str, uses: str = "", text: str = ""):
    """Register a query and, if given, its SQL twin."""

    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLES[name] = sql(uses, text)
        return f

    return keep


AVG_P, SUM_E = "sum(p)::DOUBLE / count(*)", "sum(e)::DOUBLE"
IN = lambda c, x: f"{c} >= '{x[0]}' AND {c} < '{x[1]}'"
MET = "count(*) AS n, sum(abs(d)::DECIMAL(20,8))::DOUBLE / count(*) AS mae, sqrt(sum((d * d)::DECIMAL(20,8))::DOUBLE / count(*)) AS rmse, sum(d::DECIMAL(20,8))::DOUBLE / count(*) AS bias"

# Benchmark queries.
query("q1", "r", f"SELECT date_trunc('hour', t) AS hour, {AVG_P} AS avg_power_kw, count(*) AS readings FROM r WHERE {IN('event_time', DAY)} GROUP BY 1")(lambda s, d: analysis.hourly_profile(R(s, d), *DAY))
query("q2", "r", f"SELECT time_bucket(INTERVAL 15 MINUTE, event_time) AS event_time, sum(p)::DOUBLE AS total_kw, count(*) AS meters_reporting FROM r WHERE {IN('event_time', WEEK)} GROUP BY 1 ORDER BY total_kw DESC, 1 LIMIT 10")(lambda s, d: analysis.top_intervals(R(s, d), 10, *WEEK))
query("q3", "r", f"SELECT meter_id, {SUM_E} AS energy_kwh FROM r GROUP BY 1")(lambda s, d: analysis.energy_by_meter(R(s, d)))
query("q4", "r", f"SELECT {SUM_E} AS energy_kwh, {AVG_P} AS avg_power_kw, max(power_kw) AS max_power_kw FROM r WHERE meter_id = {METER} AND {IN('event_time', WEEK)}")(lambda s, d: analysis.meter_range(R(s, d), METER, *WEEK))
query("q5", "r", f"SELECT count(*) AS readings, {SUM_E} AS energy_kwh, {AVG_P} AS avg_power_kw, min(power_kw) AS min_power_kw, max(power_kw) AS max_power_kw FROM r")(lambda s, d: analysis.full_summary(R(s, d)))
query("load_checks", "r", "SELECT count(*) AS readings, count(DISTINCT meter_id) AS meters, min(event_time) AS first_event, max(event_time) AS last_event FROM r")(lambda s, d: analysis.load_checks(R(s, d)))


# Quality audit.
def _observed(s, d):
    r = R(s, d).where(f"event_time >= timestamp_ntz'{GRID[0]}' AND event_time < timestamp_ntz'{GRID[1]}'")
    return quality.pairs(quality.observed_slots(r, SLOT))


def _grid(s, d):
    return quality.grid(M(s, d), *GRID, SLOT)


def _missing(s, d):
    return quality.missing(_grid(s, d), _observed(s, d))


PCT = "round(100.0::DOUBLE * {} / {}, 3)"
SUMMARY = f"""SELECT planned, emitted, unique_readings, extra_copies, delayed, planned - unique_readings AS missing,
    {PCT.format('(planned - unique_readings)', 'planned')} AS missing_pct, {PCT.format('unique_readings', 'planned')} AS completeness_pct,
    {PCT.format('extra_copies', 'unique_readings')} AS duplicate_pct, {PCT.format('delayed', 'unique_readings')} AS delayed_pct,
    unique_readings + extra_copies = emitted AS emitted_adds_up
    FROM (SELECT sum(copies)::BIGINT AS emitted, count(*) AS unique_readings, sum(copies - 1)::BIGINT AS extra_copies, count(*) FILTER (WHERE received_time > event_time + INTERVAL 15 MINUTE) AS delayed FROM obs) a,
         (SELECT count(*) AS planned FROM grid) b"""
query("dq_pairs", "pairs", "SELECT * FROM pairs")(lambda s, d: quality.pairs(RAW(s, d)))
query("dq_grid", "grid", "SELECT * FROM grid")(_grid)
query("dq_missing", "miss", "SELECT * FROM miss")(_missing)
query("dq_summary", "obs grid", SUMMARY)(lambda s, d: quality.summary(_observed(s, d), _grid(s, d)))
query("dq_reference", "obs grid", f"WITH x AS ({SUMMARY}) SELECT metric, measured, expected, measured = expected AS matches FROM x, LATERAL (VALUES ('planned', x.planned::BIGINT, 1680), ('emitted', x.emitted::BIGINT, 1000), ('delayed', x.delayed::BIGINT, 900)) v(metric, measured, expected)".replace("WITH x", ", x", 1))(
    lambda s, d: quality.against_reference(quality.summary(_observed(s, d), _grid(s, d)), {"planned": 1680, "emitted": 1000, "delayed": 900})
)
query("dq_delay", "pairs", "SELECT CASE WHEN received_time - event_time = INTERVAL 15 MINUTE THEN 'on_time' WHEN received_time - event_time BETWEEN INTERVAL 30 MINUTE AND INTERVAL 180 MINUTE THEN 'delayed' ELSE 'other' END AS delay_class, count(*) AS readings, min(epoch(received_time - event_time))::BIGINT AS min_seconds, max(epoch(received_time - event_time))::BIGINT AS max_seconds FROM pairs GROUP BY 1")(lambda s, d: quality.delays(quality.pairs(RAW(s, d))))
query("dq_worst", "miss", "SELECT meter_id, missing, rnk FROM (SELECT meter_id, count(*) AS missing, rank() OVER (ORDER BY count(*) DESC) AS rnk FROM miss GROUP BY 1) WHERE rnk <= 5")(lambda s, d: quality.worst(_missing(s, d)))

# Cleaning.
query("dup_groups", "dup", "SELECT * FROM dup")(lambda s, d: quality.duplicate_groups(RAW(s, d)))
query("dup_summary", "dup", "SELECT count(*) AS groups, sum(copies - 1)::BIGINT AS extra_copies, max(copies) AS max_copies, count(*) FILTER (WHERE distinct_versions = 1) AS identical_groups, count(*) FILTER (WHERE distinct_versions <> 1) AS conflicting_groups, (sum(extra_energy_kwh::DECIMAL(20,8)) FILTER (WHERE distinct_versions = 1))::DOUBLE AS removable_energy_kwh FROM dup")(lambda s, d: quality.duplicate_summary(quality.duplicate_groups(RAW(s, d))))
query("dup_examples", "dup raw", "SELECT meter_id, event_time, received_time, power_kw, energy_kwh FROM raw JOIN (SELECT meter_id, event_time FROM dup ORDER BY 1, 2 LIMIT 2) USING (meter_id, event_time)")(lambda s, d: quality.duplicate_examples(RAW(s, d), quality.duplicate_groups(RAW(s, d))).drop("voltage_v", "current_a", "frequency_hz"))
query("dup_conflicts", "dup", "SELECT * FROM dup WHERE distinct_versions > 1")(lambda s, d: quality.conflicts(quality.duplicate_groups(RAW(s, d))))
query("clean_compare", "raw clean", "SELECT *, rows_before - rows_after AS rows_removed, round(energy_before - energy_after, 6) AS energy_removed FROM (SELECT count(*) AS rows_before, sum(e)::DOUBLE AS energy_before FROM raw), (SELECT count(*) AS rows_after, sum(e)::DOUBLE AS energy_after FROM clean)")(lambda s, d: quality.clean_compare(RAW(s, d), quality.clean(RAW(s, d))))
query("remaining", "clean", "SELECT count(*) AS remaining FROM (SELECT 1 FROM clean GROUP BY meter_id, event_time, received_time, power_kw, voltage_v, energy_kwh HAVING count(*) > 1)")(lambda s, d: quality.duplicate_groups(quality.clean(RAW(s, d))).where("distinct_versions = 1").agg(F.count(F.lit(1)).alias("remaining")))
query("lineitem_conflicts", "", "SELECT count(*) AS groups, sum(n - 1)::BIGINT AS extra, max(n) AS max_copies FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.max("n").alias("max_copies"))
)


@query("layout_checks", "r", "SELECT layout, count(*) AS readings, count(DISTINCT meter_id) AS meters, min(event_time) AS first_event, max(event_time) AS last_event, sum(p)::DOUBLE AS sum_power_kw, sum(e)::DOUBLE AS sum_energy_kwh, count(*) = first(count(*)) OVER w AND sum(p) = first(sum(p)) OVER w AND sum(e) = first(sum(e)) OVER w AS matches FROM r, (VALUES ('3 hours'), ('1 day'), ('7 days')) v(layout) GROUP BY 1 WINDOW w AS (ORDER BY layout)")
def layout_checks(s, d):
    """One copy of the readings in each chunk width, and their facts side by side."""
    top, tables = new_path(s), {}
    for width in ("3 hours", "1 day", "7 days"):
        path = f"{top}/{width.replace(' ', '_')}"
        layout.write(R(s, d).drop("event_id"), path, width, "meter")
        tables[width] = layout.read(s, path)
    return layout.checks(tables)


@query("layout_pruned", "r", f"SELECT count(*) AS readings, {SUM_E} AS energy_kwh FROM r WHERE {IN('event_time', WEEK)}")
def layout_pruned(s, d):
    """A week out of a chunked table; the range prunes chunks."""
    path = f"{new_path(s)}/chunks"
    layout.write(R(s, d).drop("event_id"), path)
    layout.compact(s, path, "2024-01-20 00:00:00")
    return layout.read(s, path, *WEEK).agg(F.count(F.lit(1)).alias("readings"), analysis.exact_sum("energy_kwh").alias("energy_kwh"))


@query("layout_time_ordered", "r", f"SELECT count(*) AS readings, {SUM_E} AS energy_kwh FROM r WHERE {IN('event_time', DAY)}")
def layout_time_ordered(s, d):
    """A day out of a table that is ordered by time inside its chunks; row groups are skipped by their time range."""
    path = stored.once(s, d, "by_time", lambda p: layout.write(R(s, d).drop("event_id"), p, "7 days", "time"))
    return layout.read(s, path, *DAY, width="7 days").agg(F.count(F.lit(1)).alias("readings"), analysis.exact_sum("energy_kwh").alias("energy_kwh"))


CHUNKS = ["2024-01-08 00:00:00", "2024-01-09 00:00:00", "2024-01-10 00:00:00"]


@query("chunk_copy", "r", "SELECT date_trunc('day', event_time)::TIMESTAMP AS chunk, count(*) AS rows_loaded FROM r WHERE event_time >= '2024-01-08' AND event_time < '2024-01-11' GROUP BY 1")
def chunk_copy(s, d):
    """Three chunks copied one at a time, with the rows of each."""
    loaded = layout.copy_chunks(R(s, d).drop("event_id"), new_path(s), CHUNKS)
    return s.createDataFrame(list(loaded.items()), "chunk string, rows_loaded long").where("rows_loaded > 0").withColumn("chunk", F.col("chunk").cast("timestamp_ntz"))


@query("storage_report")
def storage_report(s, d):
    """Bytes by chunk before and after compaction of all chunks that have ended: ratio, percent saved, share that got smaller."""
    path = new_path(s)
    loose = Table(s, path)
    loose.point(loose.stage(R(s, d).drop("event_id").withColumn("chunk", bucket(F.col("event_time"), "1 day")), "chunk", compression="none"))
    before = s.createDataFrame(src.storage(s, path).collect(), "partition string, files long, bytes long")  # a row a chunk
    layout.compact(s, path, "2024-02-20 00:00:00")
    return layout.storage_report(before, src.storage(s, path))


@query("deleted_copies", "raw clean", "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS deleted, 0::BIGINT AS deleted_again, (SELECT count(*) FROM clean) AS remaining")
def deleted_copies(s, d):
    """Extra copies deleted from a stored table, twice: the second time there is nothing to delete."""
    path = new_path(s)
    Table(s, path).put(RAW(s, d).drop("event_id"))
    first, again = (src.delete_copies(s, path, quality.clean) for _ in range(2))
    return Table(s, path).read().agg(F.lit(first).cast("long").alias("deleted"), F.lit(again).cast("long").alias("deleted_again"), F.count(F.lit(1)).alias("remaining"))


@query("load_reconciled", "r", "SELECT n AS file_rows, n AS read_rows, n AS table_rows, c AS contract_rows, n = c AS agrees FROM (SELECT count(*) AS n FROM r), (SELECT count(*) AS c FROM events)")
def load_reconciled(s, d):
    """Readings out to CSV files and loaded from them; four counts side by side."""
    top = new_path(s)
    src.write_csv(R(s, d).drop("event_id"), f"{top}/csv")
    src.load_csv(s, f"{top}/csv", f"{top}/table")
    return src.reconciled(s, f"{top}/csv", f"{top}/table", s.read.parquet(f"{d}/events.parquet").count())


@query("csv_roundtrip", "r", "SELECT meter_id, event_time, received_time, power_kw, energy_kwh FROM r")
def csv_roundtrip(s, d):
    """Readings after the way through CSV files with a header."""
    top = new_path(s)
    src.write_csv(R(s, d).drop("event_id"), f"{top}/csv")
    src.load_csv(s, f"{top}/csv", f"{top}/table")
    return s.read.parquet(f"{top}/table").select("meter_id", "event_time", "received_time", "power_kw", "energy_kwh")


query("plan_evidence")(
    lambda s, d: evidence.report({"q1": QUERIES["q1"](s, d), "q4": QUERIES["q4"](s, d), "q5": QUERIES["q5"](s, d), "layout_time_ordered": QUERIES["layout_time_ordered"](s, d), "panel_1_aggregate": QUERIES["panel_1_aggregate"](s, d)})
)

# Demand.
query("daily", "day", "SELECT * FROM day")(lambda s, d: analysis.daily(R(s, d)))
query("weekly", "day", "SELECT (DATE '2024-01-01' + 7 * (date_diff('day', DATE '2024-01-01', day) // 7)::INT)::DATE AS period_start, min(day) AS first_day, max(day) AS last_day, count(*) AS days, sum(energy_kwh::DECIMAL(20,8))::DOUBLE AS energy_kwh FROM day GROUP BY 1")(lambda s, d: analysis.weekly(R(s, d), "2024-01-01"))
query("peaks", "net r", "SELECT n.event_time, n.kw AS total_kw, count(*) AS meters_reporting FROM net n JOIN r ON time_bucket(INTERVAL 1 HOUR, r.event_time) = n.event_time GROUP BY 1, 2 ORDER BY total_kw DESC, 1 LIMIT 3")(lambda s, d: analysis.top_intervals(R(s, d), 3, width="1 hour"))
query("context", "net", "SELECT *, round(max_kw / avg_kw, 9) AS peak_to_average FROM (SELECT sum(kw::DECIMAL(20,8))::DOUBLE / count(*) AS avg_kw, min(kw) AS min_kw, max(kw) AS max_kw FROM net)")(lambda s, d: analysis.context(R(s, d)))
query("profile", "net", "SELECT strftime(event_time + INTERVAL 2 HOUR, '%H:%M') AS time_of_day, CASE WHEN isodow(event_time + INTERVAL 2 HOUR) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, sum(kw::DECIMAL(20,8))::DOUBLE / count(*) AS avg_network_kw FROM net GROUP BY 1, 2")(lambda s, d: analysis.profile(R(s, d)))
query("profile_pivot", "net", "SELECT strftime(event_time + INTERVAL 2 HOUR, '%H:%M') AS time_of_day, (sum(kw::DECIMAL(20,8)) FILTER (WHERE isodow(event_time + INTERVAL 2 HOUR) < 6))::DOUBLE / count(*) FILTER (WHERE isodow(event_time + INTERVAL 2 HOUR) < 6) AS weekday, (sum(kw::DECIMAL(20,8)) FILTER (WHERE isodow(event_time + INTERVAL 2 HOUR) >= 6))::DOUBLE / count(*) FILTER (WHERE isodow(event_time + INTERVAL 2 HOUR) >= 6) AS weekend FROM net GROUP BY 1")(lambda s, d: analysis.profile_pivot(R(s, d)))
query("weekday_change", "day", "SELECT weekday_kwh, weekend_kwh, first_kwh, last_kwh, round(100.0::DOUBLE * (weekend_kwh - weekday_kwh) / weekday_kwh, 6) AS weekend_change_pct, round(100.0::DOUBLE * (last_kwh - first_kwh) / first_kwh, 6) AS first_last_change_pct FROM (SELECT (sum(energy_kwh::DECIMAL(20,8)) FILTER (WHERE isodow(day) < 6))::DOUBLE / count(*) FILTER (WHERE isodow(day) < 6) AS weekday_kwh, (sum(energy_kwh::DECIMAL(20,8)) FILTER (WHERE isodow(day) >= 6))::DOUBLE / count(*) FILTER (WHERE isodow(day) >= 6) AS weekend_kwh, min_by(energy_kwh, day) AS first_kwh, max_by(energy_kwh, day) AS last_kwh FROM day)")(lambda s, d: analysis.weekday_change(R(s, d)))

# Regions and customer types.
MIX = "SELECT {k}, registered_meters, readings, energy_kwh, energy_kwh / registered_meters AS kwh_per_meter, 100.0::DOUBLE * energy_kwh / (sum(energy_kwh::DECIMAL(20,8)) OVER ())::DOUBLE AS pct_of_energy, 100.0::DOUBLE * registered_meters / sum(registered_meters) OVER () AS pct_of_meters FROM (SELECT {k}, count(*) AS registered_meters FROM m GROUP BY {k}) JOIN (SELECT {k}, sum(e)::DOUBLE AS energy_kwh, count(*) AS readings FROM r JOIN m USING (meter_id) GROUP BY {k}) USING ({k})"
query("by_region", "r m", MIX.format(k="region"))(lambda s, d: analysis.mix(R(s, d), M(s, d), ["region"]).orderBy(trailing_number(F.col("region"))))
query("by_type", "r m", MIX.format(k="customer_type"))(lambda s, d: analysis.mix(R(s, d), M(s, d), ["customer_type"]).orderBy(F.desc("kwh_per_meter")))
query("mix", "r m", MIX.format(k="region, customer_type"))(lambda s, d: analysis.mix(R(s, d), M(s, d), ["region", "customer_type"]))
query("mix_pivot", "r m", "SELECT region, " + ", ".join(f"max(k) FILTER (WHERE customer_type = '{t}') AS {t}" for t in ("residential", "commercial", "industrial")) + f" FROM (SELECT region, customer_type, kwh_per_meter AS k FROM ({MIX.format(k='region, customer_type')})) GROUP BY 1")(lambda s, d: analysis.mix_pivot(R(s, d), M(s, d), ["residential", "commercial", "industrial"]))
query("region_correlation", "r m", f"SELECT CASE WHEN var_pop(share) > 0 AND var_pop(kwh_per_meter) > 0 THEN round(corr(share, kwh_per_meter), 6) END AS r, round(max(kwh_per_meter) / min(kwh_per_meter), 6) AS spread FROM ({MIX.format(k='region')}) JOIN (SELECT region, avg(CASE WHEN customer_type = 'industrial' THEN 1.0 ELSE 0.0 END) AS share FROM m GROUP BY 1) USING (region)")(lambda s, d: analysis.industrial_correlation(R(s, d), M(s, d)))


@query("orders_mix", "", "SELECT r_name AS region, c_mktsegment AS segment, count(*) AS orders, sum(o_totalprice::DECIMAL(20,8))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def orders_mix(s, d):
    """A fact joined to a chain of dimensions."""
    t = lambda x: s.read.parquet(f"{d}/{x}.parquet")
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    j = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), analysis.exact_sum("o_totalprice").alias("total"))


# Completeness and lateness.
COMPLETE = "SELECT *, planned_pairs - observed_pairs AS missing_pairs, 100.0::DOUBLE * observed_pairs / planned_pairs AS completeness_pct FROM {}"
query("completeness", "r m", "SELECT * FROM (SELECT region, registered_meters, planned_pairs, observed_pairs, planned_pairs - observed_pairs AS missing_pairs, 100.0::DOUBLE * observed_pairs / planned_pairs AS completeness_pct FROM (SELECT coalesce(region, 'NETWORK') AS region, sum(n)::BIGINT AS registered_meters, sum(n * 120)::BIGINT AS planned_pairs, sum(o)::BIGINT AS observed_pairs FROM (SELECT region, count(*) AS n FROM m GROUP BY 1) JOIN (SELECT region, count(*) AS o FROM r JOIN m USING (meter_id) GROUP BY 1) USING (region) GROUP BY ROLLUP (region)))")(
    lambda s, d: analysis.in_region_order(analysis.completeness(R(s, d), M(s, d), 120))
)
query("completeness_spread", "r m", "SELECT max(p) AS best_pct, min(p) AS worst_pct, round(max(p) - min(p), 9) AS spread_points FROM (SELECT 100.0::DOUBLE * o / (n * 120) AS p FROM (SELECT region, count(*) AS n FROM m GROUP BY 1) JOIN (SELECT region, count(*) AS o FROM r JOIN m USING (meter_id) GROUP BY 1) USING (region))")(
    lambda s, d: analysis.completeness_spread(analysis.completeness(R(s, d), M(s, d), 120))
)
query("day_provisional", "r", f"SELECT count(*) FILTER (WHERE received_time <= '{DAY[1]}') AS readings_by_cutoff, count(*) AS readings_final, (sum(e) FILTER (WHERE received_time <= '{DAY[1]}'))::DOUBLE AS energy_by_cutoff_kwh, {SUM_E} AS energy_final_kwh, min(event_time) FILTER (WHERE received_time > '{DAY[1]}') AS first_late_event, max(received_time) AS last_arrival FROM r WHERE {IN('event_time', DAY)}")(lambda s, d: analysis.provisional(R(s, d), *DAY))
query("late_detail", "r", f"SELECT date_trunc('hour', received_time + INTERVAL 2 HOUR) AS arrival_hour, count(*) AS readings, {SUM_E} AS energy_kwh FROM r WHERE {IN('event_time', DAY)} AND received_time > '{DAY[1]}' GROUP BY 1")(lambda s, d: analysis.late_detail(R(s, d), *DAY))


# Anomalies.
def _keyed(s, d):
    return analysis.slot_keys(R(s, d), SLOT_MINUTES)


def _ratio(s, d):
    known = stored.table(s, d, "baseline", lambda: analysis.baseline(_keyed(s, d)))
    return analysis.ratios(_keyed(s, d), known)


def _flags(s, d):
    return analysis.flags(_ratio(s, d))


LEVELS = analysis.LEVELS
query("anomaly_baseline", "base", "SELECT * FROM base")(lambda s, d: analysis.baseline(_keyed(s, d)))
query("ratio_dist", "ratio", "SELECT min(ratio) AS min_ratio, " + ", ".join(f"round(quantile_cont(ratio, {q}), 9) AS q{k}" for k, q in enumerate(LEVELS)) + ", max(ratio) AS max_ratio FROM ratio")(lambda s, d: analysis.ratio_distribution(_ratio(s, d)))
query("flags", "flag", "SELECT * FROM flag")(_flags)
query("interval_count", "r", f"SELECT count(*) AS n FROM r WHERE meter_id = {METER} AND {IN('event_time', WEEK)}")(
    lambda s, d: s.sql("SELECT count(*) AS n FROM {r} WHERE meter_id = :meter AND event_time >= CAST(:low AS TIMESTAMP_NTZ) AND event_time < CAST(:high AS TIMESTAMP_NTZ)", args={"meter": METER, "low": WEEK[0], "high": WEEK[1]}, r=R(s, d))
)
query("day_series", "ratio", f"SELECT event_time, power_kw, median_kw FROM ratio WHERE meter_id = {METER} AND {IN('event_time', WEEK)}")(lambda s, d: _ratio(s, d).where(F.col("meter_id") == METER).where(analysis.within(F.col("event_time"), *WEEK)).select("event_time", "power_kw", "median_kw").orderBy("event_time"))
INSIDE = "f.meter_id = l.meter_id AND f.event_time >= l.start_time AND f.event_time < l.end_time"
query("event_eval", "flag lab", f"SELECT l.*, count(f.meter_id) AS n_flags, count(f.meter_id) > 0 AS detected FROM lab l LEFT JOIN flag f ON {INSIDE} GROUP BY ALL")(lambda s, d: analysis.event_detection(_flags(s, d), L(s, d)))
query("detection_rates", "flag lab r", f"SELECT *, 100.0::DOUBLE * false_flags / readings_outside AS false_flag_pct FROM (SELECT count(*) AS false_flags, count(DISTINCT meter_id) AS meters_with_false_flags FROM flag f WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE {INSIDE})), (SELECT count(*) AS readings_outside FROM r f WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE {INSIDE})), (SELECT count(*) AS events, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM flag f WHERE {INSIDE})) AS events_detected FROM lab l)")(
    lambda s, d: analysis.detection_rates(R(s, d), _flags(s, d), L(s, d))
)

# Rollups.
CAGG = "SELECT {b} AS bucket, {k}, sum(e)::DOUBLE AS energy_kwh, sum(p)::DOUBLE AS power_kw_sum, count(*) AS reading_count FROM r {j} WHERE {w} GROUP BY 1, 2"
B15, B60, BDAY = "time_bucket(INTERVAL 15 MINUTE, event_time)", "date_trunc('hour', event_time)", "date_trunc('day', t) - INTERVAL 2 HOUR"
JM = "JOIN m USING (meter_id)"
query("cagg_15min", "r m", CAGG.format(b=B15, k="region", j=JM, w="true"))(lambda s, d: rollups.QUARTER_REGION.compute(R(s, d), M(s, d)))
query("cagg_hourly", "r m", CAGG.format(b=B60, k="region", j=JM, w="true"))(lambda s, d: rollups.HOURLY_REGION.compute(R(s, d), M(s, d)))
query("cagg_daily", "r", CAGG.format(b=BDAY, k="meter_id", j="", w="true"))(lambda s, d: rollups.DAILY_METER.compute(R(s, d)))


@query("rollup_refresh", "r", CAGG.format(b=BDAY, k="meter_id", j="", w=IN("event_time", ("2024-01-04 22:00:00", "2024-01-12 22:00:00"))))
def rollup_refresh(s, d):
    """Two overlapping refreshes; only whole buckets inside the windows are stored."""
    store = rollups.Store(s, f"{new_path(s)}/rollup", rollups.Rollup("1 day", ("meter_id",), "UTC", "shifted"))
    shifted = R(s, d).withColumn("shifted", local(F.col("event_time")))
    store.refresh(shifted, datetime(2024, 1, 4, 12), datetime(2024, 1, 10))
    store.refresh(shifted, datetime(2024, 1, 8), datetime(2024, 1, 13, 5))
    return store.read().withColumn("bucket", F.col("bucket") - F.expr("interval 2 hours")).where(F.col("bucket") >= F.lit("2024-01-04 22:00:00").cast("timestamp_ntz"))


TICKS = (datetime(2024, 1, 10, 10, 20), datetime(2024, 1, 12, 10, 35), datetime(2024, 1, 14, 3, 5))


@query("rollup_policy", "r", CAGG.format(b=B60, k="meter_id", j="", w=IN("event_time", ("2024-01-07 11:00:00", "2024-01-10 09:00:00")) + " OR " + IN("event_time", ("2024-01-11 04:00:00", "2024-01-14 02:00:00"))))
def rollup_policy(s, d):
    """Three runs of the refresh policy, the second of which finds the store paused."""
    store = rollups.Store(s, new_path(s), rollups.Rollup("1 hour", ("meter_id",), "UTC"))
    for k, now in enumerate(TICKS):
        (store.pause if k == 1 else store.resume)()
        store.tick(R(s, d), now, rollups.Policy())
    return store.read()


def _fresh(s, d):
    """A store beside a chunked table: readings on time land, a refresh up to ``MARK`` takes them up, then late readings land, and a second refresh takes up those."""

    def build(path):
        touched, on_time = rollups.Touched(s, f"{path}/touched"), F.expr("received_time <= event_time + interval 15 minutes")
        for part in (on_time, ~on_time):
            rollups.land(R(s, d).where(part).drop("event_id"), f"{path}/readings", touched)
            store(path).take_up(lambda ranges: layout.read_ranges(s, f"{path}/readings", ranges), touched, datetime.fromisoformat(MARK), M(s, d))

    store = lambda path: rollups.Store(s, f"{path}/hourly", rollups.HOURLY_REGION)
    path = stored.once(s, d, "freshness", build)
    return store(path), f"{path}/readings"


def _real_time(s, d, number):
    """Real-time rows as the ``number``-th refresh left the store; of the readings only chunks from the watermark on are read."""
    store, path = _fresh(s, d)
    return store.real_time(layout.read(s, path, str(store.watermark(number)), "2100-01-01 00:00:00"), M(s, d), number)


#: What the first refresh stored: hours up to MARK, from readings that came on time; and where that ended.
ON_TIME = "received_time <= event_time + INTERVAL 15 MINUTE"
FIRST_MARK = f"(SELECT max({B60}) + INTERVAL 1 HOUR FROM r WHERE event_time < '{MARK}' AND {ON_TIME})"


@query("realtime_rollup", "r m", f"SELECT {B60} AS bucket, region, sum(e)::DOUBLE AS energy_kwh, sum(p)::DOUBLE AS power_kw_sum, count(*) AS reading_count FROM r {JM} WHERE event_time >= {FIRST_MARK} OR {ON_TIME} GROUP BY 1, 2")
def realtime_rollup(s, d):
    """From the store as its first refresh left it: without the late rows below the watermark, computed above it."""
    return _real_time(s, d, 0)


STAGE = "SELECT '{n}' AS stage, sum(e)::DOUBLE AS energy_kwh, count(*)::BIGINT AS row_count FROM r WHERE {w}"


@query("fresh_stages", "r", " UNION ALL ".join(STAGE.format(n=n, w=w) for n, w in (("stored", f"{ON_TIME} AND event_time < '{MARK}'"), ("real_time", f"event_time >= {FIRST_MARK} OR {ON_TIME}"), ("refreshed", f"event_time < '{MARK}'"), ("refreshed_real_time", "true"))))
def fresh_stages(s, d):
    """Energy and readings that a reader sees, stored and in real time, before and after the refresh that takes up late readings."""
    store, _ = _fresh(s, d)
    stages = {"stored": store.read(number=0), "real_time": _real_time(s, d, 0), "refreshed": store.read(number=1), "refreshed_real_time": _real_time(s, d, 1)}
    one = lambda n, df: df.agg(F.lit(n).alias("stage"), analysis.exact_sum("energy_kwh").alias("energy_kwh"), F.sum("reading_count").alias("row_count"))
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in stages.items()])


WINDOWS = [("older", "2024-01-05 00:00:00", "2024-01-05 01:00:00"), ("newer", "2024-01-05 01:00:00", "2024-01-05 02:00:00"), ("empty", "2023-01-01 00:00:00", "2023-01-01 01:00:00")]
VALUES = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in WINDOWS)
query("fresh_raw", "r", f"SELECT name, sum(e)::DOUBLE AS energy_kwh, count(r.event_time) AS row_count FROM (VALUES {VALUES}) w(name, a, b) LEFT JOIN r ON r.event_time >= a AND r.event_time < b GROUP BY 1")(
    lambda s, d: rollups.freshness(s.sql(f"SELECT name, CAST(a AS TIMESTAMP_NTZ) AS start_time, CAST(b AS TIMESTAMP_NTZ) AS end_time FROM VALUES {', '.join(str(w) for w in WINDOWS)} AS t(name, a, b)"), R(s, d))
)
@query("fresh_agg", "r", f"SELECT {B60} AS bucket, sum(e)::DOUBLE AS energy_kwh, count(*) AS row_count FROM r WHERE {B60} IN (SELECT a FROM (VALUES {VALUES}) w(name, a, b)) GROUP BY 1")
def fresh_agg(s, d):
    """The windows' hours as stored after both refreshes; absent hours haven't been computed."""
    hours = [(datetime.fromisoformat(a),) for _, a, _ in WINDOWS]
    low, high = WINDOWS[0][1], WINDOWS[1][2]
    found = _fresh(s, d)[0].read(low, high).join(s.createDataFrame(hours, "bucket timestamp_ntz"), "bucket", "left_semi")
    return found.groupBy("bucket").agg(analysis.exact_sum("energy_kwh").alias("energy_kwh"), F.sum("reading_count").alias("row_count"))


# Dashboards: raw and rollup form of each panel have one SQL twin.
def _rollup(s, d, which):
    """The range of a stored rollup, which is refreshed once over all readings."""
    name = f"rollup_{which.width.replace(' ', '_')}"

    def build(path):
        rollups.Store(s, path, which).refresh(R(s, d), datetime(1990, 1, 1), datetime(2100, 1, 1), M(s, d))

    return rollups.Store(s, stored.once(s, d, name, build), which).read(*snapped(*INSIDE_RANGE))


SNAP = IN("event_time", RANGE)
ORIGIN = "2024-01-01 00:00:00"
PANEL_SQL = {
    1: ("r m", f"SELECT {B60} AS time, region AS metric, {SUM_E} AS energy_kwh, count(*) AS reading_count FROM r {JM} WHERE {SNAP} GROUP BY 1, 2"),
    2: ("r", f"SELECT {BDAY} AS time, {SUM_E} AS energy_kwh, count(*) AS reading_count FROM r WHERE {SNAP} GROUP BY 1"),
    3: ("r", f"SELECT strftime(time_bucket(INTERVAL 7 DAY, t, TIMESTAMP '{ORIGIN}'), '%d %b') AS period, {SUM_E} AS energy_kwh, count(*) AS reading_count FROM r WHERE {SNAP} GROUP BY time_bucket(INTERVAL 7 DAY, t, TIMESTAMP '{ORIGIN}')"),
    4: ("r", f"SELECT {BDAY} AS time, {SUM_E} AS energy_kwh, count(*) AS reading_count FROM r WHERE meter_id = {METER} AND {SNAP} GROUP BY 1"),
    5: ("r m", f"SELECT region, coalesce(n, 0)::BIGINT AS reading_count, k * 96 * 7 AS planned_readings, 100.0::DOUBLE * coalesce(n, 0) / (k * 96 * 7) AS completeness_pct FROM (SELECT region, count(*) AS k FROM m GROUP BY 1) LEFT JOIN (SELECT region, count(*) AS n FROM r {JM} WHERE {SNAP} GROUP BY 1) USING (region)"),
}
INSIDE_RANGE = ("2024-01-08 03:00:00", "2024-01-14 22:00:00")  # snapped to RANGE: the end is a local midnight
PANELS = {
    1: (lambda s, d: panels.hourly_regional(R(s, d), *INSIDE_RANGE, M(s, d)), lambda s, d: panels.hourly_regional(_rollup(s, d, rollups.HOURLY_REGION), *INSIDE_RANGE)),
    2: (lambda s, d: panels.daily_network(R(s, d), *INSIDE_RANGE), lambda s, d: panels.daily_network(_rollup(s, d, rollups.QUARTER_REGION), *INSIDE_RANGE)),
    3: (lambda s, d: panels.seven_day_network(R(s, d), *INSIDE_RANGE, ORIGIN), lambda s, d: panels.seven_day_network(_rollup(s, d, rollups.QUARTER_REGION), *INSIDE_RANGE, ORIGIN)),
    4: (lambda s, d: panels.meter_daily(R(s, d), *INSIDE_RANGE, METER), lambda s, d: panels.meter_daily(_rollup(s, d, rollups.DAILY_METER), *INSIDE_RANGE, METER)),
    5: (lambda s, d: panels.completeness(R(s, d), *INSIDE_RANGE, M(s, d)), lambda s, d: panels.completeness(_rollup(s, d, rollups.QUARTER_REGION), *INSIDE_RANGE, M(s, d))),
}
for _n, (_raw, _agg) in PANELS.items():
    query(f"panel_{_n}_raw", *PANEL_SQL[_n])(_raw)
    query(f"panel_{_n}_aggregate", *PANEL_SQL[_n])(_agg)


#: The panels once more, from rollups that SQL makes itself.
ROLLED = {"c15": f"SELECT {B15} AS bucket, region, sum(e)::DOUBLE AS e, count(*) AS n FROM r {JM} GROUP BY 1, 2", "c60": f"SELECT {B60} AS bucket, region, sum(e)::DOUBLE AS e, count(*) AS n FROM r {JM} GROUP BY 1, 2", "cday": f"SELECT {BDAY} AS bucket, meter_id, sum(e)::DOUBLE AS e, count(*) AS n FROM r GROUP BY 1, 2"}
SUMS, STORED_SNAP = "sum(e::DECIMAL(20,8))::DOUBLE AS energy_kwh, sum(n)::BIGINT AS reading_count", IN("bucket", RANGE)
ROLLED_PANEL_SQL = {
    1: f"SELECT bucket AS time, region AS metric, {SUMS} FROM c60 WHERE {STORED_SNAP} GROUP BY 1, 2",
    2: f"SELECT date_trunc('day', bucket + INTERVAL 2 HOUR) - INTERVAL 2 HOUR AS time, {SUMS} FROM c15 WHERE {STORED_SNAP} GROUP BY 1",
    3: f"SELECT strftime(time_bucket(INTERVAL 7 DAY, bucket + INTERVAL 2 HOUR, TIMESTAMP '{ORIGIN}'), '%d %b') AS period, {SUMS} FROM c15 WHERE {STORED_SNAP} GROUP BY time_bucket(INTERVAL 7 DAY, bucket + INTERVAL 2 HOUR, TIMESTAMP '{ORIGIN}')",
    4: f"SELECT bucket AS time, {SUMS} FROM cday WHERE meter_id = {METER} AND {STORED_SNAP} GROUP BY 1, meter_id",
    5: f"SELECT region, 100.0::DOUBLE * coalesce(n, 0) / (k * 96 * 7) AS completeness_pct FROM (SELECT region, count(*) AS k FROM m GROUP BY 1) LEFT JOIN (SELECT region, sum(n) AS n FROM c15 WHERE {STORED_SNAP} GROUP BY 1) USING (region)",
}
COMPARED = " UNION ALL ".join(
    f"SELECT '{n}' AS panel, '{v}' AS value, count(*) AS cells, count(*) FILTER (WHERE a._l IS NULL OR b._r IS NULL) AS unmatched, round(max(abs(a.{v}::DOUBLE - b.{v}::DOUBLE)), 6) AS max_difference, count(*) FILTER (WHERE a._l IS NULL OR b._r IS NULL) = 0 AND coalesce(max(abs(a.{v}::DOUBLE - b.{v}::DOUBLE)), 0) <= 0.001 AS passes "
    f"FROM (SELECT *, 1 AS _l FROM ({PANEL_SQL[n][1]})) a FULL JOIN (SELECT *, 1 AS _r FROM ({ROLLED_PANEL_SQL[n]})) b USING ({', '.join(panels.KEYS[n])})"
    for n in PANEL_SQL for v in (["completeness_pct"] if n == 5 else ["energy_kwh", "reading_count"])
)
CTES |= ROLLED
NEEDS |= {"c15": "r m", "c60": "r m", "cday": "r"}


@query("panel_compare", "c15 c60 cday", COMPARED)
def panel_compare(s, d):
    """Every cell of every panel, raw against rollup."""
    found = None
    for n, (raw, agg) in PANELS.items():
        values = ["completeness_pct"] if n == 5 else ["energy_kwh", "reading_count"]
        one = compare.by_key(raw(s, d), agg(s, d), panels.KEYS[n], values).select(F.lit(str(n)).alias("panel"), "*").withColumn("max_difference", F.round("max_difference", 6))
        found = one if found is None else found.unionByName(one)
    return found


query("meter_list", "m", "SELECT meter_id::VARCHAR AS meter FROM m")(lambda s, d: panels.meter_list(M(s, d)))


# Forecast.
def _hourly_grid(s, d):
    return forecast.on_grid(forecast.hourly(R(s, d), M(s, d)), *GRID)


def _features(s, d):
    return forecast.split(forecast.features(_hourly_grid(s, d)), "2024-01-15", "2024-01-22")


def _baseline(s, d):
    return forecast.previous_day(_features(s, d))


query("forecast_hourly", "hour", "SELECT * FROM hour")(lambda s, d: forecast.hourly(R(s, d), M(s, d)))
query("forecast_grid", "hgrid", "SELECT * FROM hgrid")(_hourly_grid)
query("forecast_features", "sp", "SELECT * REPLACE (round(prev_week_same_hour_mean, 9) AS prev_week_same_hour_mean) FROM sp")(lambda s, d: _features(s, d).withColumn("prev_week_same_hour_mean", F.round("prev_week_same_hour_mean", 9)))
LAST = {"lag_24h": "hour_start - INTERVAL 23 HOUR", "lag_48h": "hour_start - INTERVAL 47 HOUR", "lag_168h": "hour_start - INTERVAL 167 HOUR", "prev_week_same_hour_mean": "hour_start - INTERVAL 23 HOUR", "prev_day_mean": "origin"}
query("forecast_leakage", "feat", " UNION ALL ".join(f"SELECT '{k}' AS feature, bool_and({end} <= origin) AS leak_free FROM feat" for k, end in LAST.items()))(lambda s, d: forecast.leakage(_features(s, d)))
query("forecast_availability", "sp", " UNION ALL ".join(f"SELECT '{c}' AS feature, min(hour_start) FILTER (WHERE {c} IS NOT NULL) AS first_hour FROM sp" for c in forecast.NUMERIC))(lambda s, d: forecast.availability(_features(s, d)))
query("forecast_splits", "sp", "SELECT split, count(*) AS rows, count(*) FILTER (WHERE complete) AS usable_rows, min(hour_start) AS first_target, max(hour_start) AS last_target, count(*) FILTER (WHERE NOT complete) AS rows_missing FROM sp GROUP BY 1")(lambda s, d: forecast.split_summary(_features(s, d)))
query("forecast_baseline", "pred", "SELECT * FROM pred")(_baseline)
query("metrics_overall", "err", f"SELECT {MET} FROM err")(lambda s, d: forecast.metrics(_baseline(s, d)))
query("metrics_region", "err", f"SELECT region, {MET} FROM err GROUP BY 1")(lambda s, d: forecast.metrics(_baseline(s, d), "region"))
query("metrics_day", "err", f"SELECT hour_start::DATE AS day, {MET} FROM err GROUP BY 1")(lambda s, d: forecast.metrics(_baseline(s, d), F.to_date("hour_start").alias("day")))
query("peak_hours", "pred", "SELECT region, hour_start, energy_kwh, prediction, strftime(hour_start, '%a %H:%M') AS label FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY energy_kwh DESC, hour_start) AS n FROM pred) WHERE n = 1")(lambda s, d: forecast.peak_hours(_baseline(s, d)))


#: Moments of the lags and the target, as SQL; the means need days without gaps, which small tables don't have.
LAGGED = forecast.NUMERIC[:3]
CROSSED = ", ".join(f"sum(({a} * {b})::DECIMAL(28,8))::DOUBLE AS sum_{a}_{b}" for a, b in forecast._products(LAGGED))
WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in (*LAGGED, "energy_kwh"))


@query("forecast_moments", "sp", "SELECT region, hour, dow, count(*) AS n, " + ", ".join(f"sum({c}::DECIMAL(20,8))::DOUBLE AS sum_{c}" for c in (*LAGGED, "energy_kwh")) + f", {CROSSED} FROM sp WHERE split = 'train' AND {WHOLE} GROUP BY region, hour, dow")
def forecast_moments(s, d):
    """The sums that a ridge on the lags is solved from, for every penalty, by cell of region, hour and day of the week."""
    return forecast.moments(_features(s, d).where(f"split = 'train' AND {WHOLE}"), LAGGED)


@query("forecast_ridge")
def forecast_ridge(s, d):
    """Ridge on region totals by day-complete features, alpha chosen on the validation part, scored on the test part.

    Rows without a predictor or the target are left out; where they leave nothing to fit or choose by, n is 0 and the rest null.
    """
    return forecast.ridge_metrics(_features(s, d))


# Set operations, upserts, subqueries, JSON and streams.
query("in_list", "r", "SELECT meter_id, count(*) AS readings FROM r WHERE meter_id IN (1, 3, 7, 12) GROUP BY 1")(lambda s, d: R(s, d).where(F.col("meter_id").isin(1, 3, 7, 12)).groupBy("meter_id").agg(F.count(F.lit(1)).alias("readings")))
query("correlated", "r m", "SELECT meter_id, (SELECT max(power_kw) FROM r WHERE r.meter_id = m.meter_id) AS max_power_kw, (SELECT count(*) FROM r WHERE r.meter_id = m.meter_id) AS readings FROM m")(
    lambda s, d: s.sql("SELECT m.meter_id, (SELECT max(power_kw) FROM {r} r WHERE r.meter_id = m.meter_id) AS max_power_kw, (SELECT count(*) FROM {r} r WHERE r.meter_id = m.meter_id) AS readings FROM {m} m", r=R(s, d), m=M(s, d))
)
query("lateral", "r m", "SELECT region, x.* FROM (SELECT DISTINCT region FROM m) g, LATERAL (SELECT count(*) AS readings, min(event_time) AS first_event FROM r JOIN m USING (meter_id) WHERE m.region = g.region) x")(
    lambda s, d: s.sql("SELECT g.region, x.readings, x.first_event FROM (SELECT DISTINCT region FROM {m}) g, LATERAL (SELECT count(*) AS readings, min(event_time) AS first_event FROM {j} j WHERE j.region = g.region) x", m=M(s, d), j=R(s, d).join(M(s, d), "meter_id").select("region", "event_time"))
)
query("ended_chunks", "r", "SELECT date_trunc('day', event_time)::TIMESTAMP AS chunk, count(*) AS readings FROM r WHERE date_trunc('day', event_time) + INTERVAL 1 DAY <= now()::TIMESTAMP - INTERVAL 48 HOUR GROUP BY 1")(
    lambda s, d: R(s, d).groupBy(bucket(F.col("event_time"), "1 day").alias("chunk")).agg(F.count(F.lit(1)).alias("readings")).where(F.col("chunk") + F.expr("interval 1 day") <= F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()) - F.expr("interval 48 hours"))
)
query("iso_offset", "r", "SELECT event_time, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00' AS told FROM r")(
    lambda s, d: R(s, d).select(iso_with_offset(F.col("event_time")).alias("told")).select(utc_of_iso(F.col("told")).alias("event_time"), "told")
)
TOP = "(SELECT row_number() OVER (ORDER BY total_kw DESC, event_time) AS n, * FROM (SELECT time_bucket(INTERVAL 15 MINUTE, event_time) AS event_time, sum(p)::DOUBLE AS total_kw, count(*) AS meters_reporting FROM {} GROUP BY 1 ORDER BY total_kw DESC, 1 LIMIT 10))"
query("ordered_compare", "r raw", f"SELECT count(a.n) AS rows_left, count(b.n) AS rows_right, count(*) FILTER (WHERE NOT coalesce(a.event_time = b.event_time AND a.meters_reporting = b.meters_reporting AND abs(a.total_kw - b.total_kw) <= 0.001, false)) AS differing, count(*) FILTER (WHERE NOT coalesce(a.event_time = b.event_time AND a.meters_reporting = b.meters_reporting AND abs(a.total_kw - b.total_kw) <= 0.001, false)) = 0 AS passes FROM {TOP.format('r')} a FULL JOIN {TOP.format('raw')} b USING (n)")(
    lambda s, d: compare.ordered(analysis.top_intervals(R(s, d), 10), analysis.top_intervals(RAW(s, d), 10), [F.desc("total_kw"), F.col("event_time")])
)
query("union_counts", "r m", "SELECT 'readings' AS name, count(*) AS n FROM r UNION ALL SELECT 'meters', count(*) FROM m")(lambda s, d: R(s, d).agg(F.lit("readings").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(M(s, d).agg(F.lit("meters").alias("name"), F.count(F.lit(1)).alias("n"))))
query("upsert_meters", "m", "SELECT meter_id, CASE WHEN meter_id % 3 = 0 THEN 'kept' ELSE 'new' END AS origin FROM m")(
    lambda s, d: src.upsert_ignore(M(s, d).where("meter_id % 3 = 0").select("meter_id", F.lit("kept").alias("origin")), M(s, d).select("meter_id", F.lit("new").alias("origin")), ["meter_id"])
)
query("json_roundtrip", "r", f"SELECT meter_id, event_time, {'power_kw'}, energy_kwh FROM r")(lambda s, d: live.parsed(live.to_messages(R(s, d)).select("payload")).where("ok").select("meter_id", "event_time", "power_kw", "energy_kwh"))


#: Messages that are no readings, and one of another topic.
BAD = [("bad-1", "energy/meters/1", "{broken"), ("bad-2", "energy/meters/1", '{"meter_id": 1}'), ("bad-3", "energy/alerts/1", "{}")]
BATCHES = 6


def _log(s, d):
    """A log of all raw readings in the order they were received, two bad messages, one of another topic, and then some messages again, as after a lost acknowledgement."""

    def build(path):
        copy = F.row_number().over(Window.partitionBy("event_id").orderBy("power_kw"))
        raw = RAW(s, d).withColumn("_id", F.concat_ws("-", "event_id", copy))
        told = lambda df: live.to_messages(df.orderBy("received_time", "_id"), id_=F.col("_id"))
        live.publish(told(raw), path)
        bad = s.createDataFrame(BAD, "id string, topic string, payload string").withColumn("sent", F.lit("2024-01-31 00:00:00").cast("timestamp"))
        live.publish(bad.coalesce(1), path)
        for n in (97, 970):
            live.publish(told(raw.where(F.col("event_id") % n == 0)), path)

    return stored.once(s, d, "log", build)


def _messages(s, d, group, ack="commit"):
    """The log's messages as a stream of some micro-batches."""
    log = _log(s, d)
    return live.messages(s, log, group, max_messages=-(-transport.Log(log).refresh() // BATCHES), ack=ack)


def _landed(s, d):
    """The folder of a landing run over the whole log, in several micro-batches."""

    def build(top):
        log = _log(s, d)
        buckets = live.id_buckets(-(-transport.Log(log).refresh() // BATCHES))
        delivered = live.deliveries(_messages(s, d, "landing", "sink"), slot_seconds=7 * 86400, buckets=buckets)  # a month in few micro-batches
        q = live.land(delivered, f"{top}/landed", f"{top}/bad", f"{top}/ledger", f"{top}/checkpoint", log, "landing")
        live.until_idle(q, log, "landing", idle_seconds=120, expected=transport.Log(log).refresh())

    return stored.once(s, d, "landing", build)


@query("live_ledger", "raw", "SELECT n + 2 + x AS received, n + x AS inserted, 2::BIGINT AS parse_errors, x AS redelivered, n + 2 + x AS taken, n + 2 + x AS acked, 0::BIGINT AS backlog FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 97 = 0) + count(*) FILTER (WHERE event_id % 970 = 0) AS x FROM raw)")
def live_ledger(s, d):
    """The ledger of the landing run beside the log's own counts: deliveries of a message after its first are counted across micro-batches, equal readings aren't."""
    return live.totals(s, f"{_landed(s, d)}/ledger", _log(s, d), "landing")


query("live_redelivered", "raw", "SELECT meter_id, event_time, max(1 + (event_id % 97 = 0)::INT + (event_id % 970 = 0)::INT)::BIGINT AS deliveries FROM raw WHERE event_id % 97 = 0 GROUP BY 1, 2")(
    lambda s, d: _stored_landing(s, d).groupBy("meter_id", "event_time").agg(F.max("delivery").alias("deliveries")).where("deliveries > 1")
)


def _stored_landing(s, d):
    return s.read.schema(f"{src.READINGS}, delivery bigint").parquet(f"{_landed(s, d)}/landed/*")


@query("live_landed", "raw", "SELECT meter_id, event_time, received_time, power_kw, energy_kwh FROM raw")
def live_landed(s, d):
    """What the landing run stored of first deliveries, copies of readings included."""
    return _stored_landing(s, d).where("delivery = 1").select("meter_id", "event_time", "received_time", "power_kw", "energy_kwh")


def _run(s, stream: DataFrame, last: Callable[[], None] | None = None) -> DataFrame:
    """What a stream gives out over all that is there now, and what comes by ``last``, by way of files."""
    top = new_path(s)
    live.run_all(stream, f"{top}/out", f"{top}/checkpoint", last)
    return s.read.schema(stream.schema).parquet(f"{top}/out")


def _live(s, d, group):
    """The readings of the log as a stream; messages have their ids, so deliveries after the first can be told."""
    return live.parsed(_messages(s, d, f"{group}-{uuid.uuid4().hex}")).where("ok").select("id", *live.FIELDS)  # a group of its own: each call reads the whole log


query("live_deduplicated", "raw", "SELECT meter_id, event_time, count(*) AS n FROM (SELECT DISTINCT meter_id, event_time FROM raw) GROUP BY 1, 2")(
    lambda s, d: _run(s, live.deduplicated(_live(s, d, "deduplicated").drop("id"))).groupBy("meter_id", "event_time").agg(F.count(F.lit(1)).alias("n"))
)
#: What a watermark of 180 minutes behind the last event has closed.
PASSED = "(SELECT date_trunc('milliseconds', max(event_time)) - INTERVAL 180 MINUTE FROM raw)"
@query("live_sessions", "raw", "SELECT meter_id, min(event_time) AS first_event, max(event_time) + INTERVAL 1 HOUR AS closed, count(*) AS reading_count FROM (SELECT *, sum(new) OVER (PARTITION BY meter_id ORDER BY event_time, rn) AS k FROM (SELECT meter_id, event_time, row_number() OVER w AS rn, CASE WHEN event_time - lag(event_time) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM raw WINDOW w AS (PARTITION BY meter_id ORDER BY event_time))) GROUP BY meter_id, k")
def live_sessions(s, d):
    """All sessions by a stream in append mode: those that the watermark has closed, and at the end, by a closing message, those still open."""
    ends = new_path(s, "ends")
    end = live.parsed(live.messages(s, ends, "sessions")).where("ok").select("id", *live.FIELDS)
    return _run(s, live.sessions(_live(s, d, "sessions").unionByName(end)), lambda: live.close(s, ends))


WINDOWED = f"SELECT bucket, round({SUM_E}, 6) AS energy_kwh, count(*) AS reading_count FROM (SELECT {{b}} AS bucket, e FROM raw) WHERE bucket + INTERVAL {{w}} HOUR <= {PASSED} GROUP BY 1"


@query("stream_rollup", "raw", WINDOWED.format(b="time_bucket(INTERVAL 1 HOUR, event_time)", w=1))
def stream_rollup(s, d):
    """Hourly windows by a stream in append mode: those that the watermark has closed, each given out once."""
    return _run(s, live.windowed(_live(s, d, "rollup"), "1 hour")).withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("stream_sliding", "raw", WINDOWED.format(b="unnest([time_bucket(INTERVAL 1 HOUR, event_time), time_bucket(INTERVAL 1 HOUR, event_time) - INTERVAL 1 HOUR])", w=2))
def stream_sliding(s, d):
    """Windows of two hours that begin every hour, by a stream in append mode."""
    return _run(s, live.windowed(_live(s, d, "sliding"), "2 hours", slide="1 hour")).withColumn("energy_kwh", F.round("energy_kwh", 6))


query("day_bounds", "r", "SELECT t::DATE AS day, min(event_time) AS first_event, max(event_time) AS last_event, count(DISTINCT event_time::DATE) AS utc_days FROM r GROUP BY 1")(lambda s, d: R(s, d).groupBy(local_day(F.col("event_time")).alias("day")).agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.countDistinct(bucket(F.col("event_time"), "1 day")).alias("utc_days")))
