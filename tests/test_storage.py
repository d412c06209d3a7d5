"""Versioned tables, what refreshes read, and what a failure leaves."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridmill import catalogue
from gridmill.operators import layout, quality, rollups
from gridmill.plans.evidence import evidence
from gridmill.sources import readings, stored, versions

T = datetime.fromisoformat
SHORT = "meter_id bigint, event_time timestamp_ntz, received_time timestamp_ntz, power_kw double, voltage_v double, current_a double, frequency_hz double, energy_kwh double"


def rows(spark, *times, meter=1, power=4.0):
    return spark.createDataFrame([(meter, T(t), T(t), power, 230.0, 1.0, 50.0, power / 4) for t in times], SHORT)


def held(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def broken(monkeypatch):
    """The last step of a write, the pointer, fails."""

    def fails(*a):
        raise OSError("lost")

    return lambda: monkeypatch.setattr(versions, "text_created", fails)


def test_pointers(spark, tmp_path):
    table = versions.Table(spark, str(tmp_path / "t"))
    assert not table.exists() and table.pointer() == (-1, {"parts": {}, "facts": {}})
    table.put(spark.range(3), None)
    before, seen = table.pointer(), table.read()
    table.put(spark.range(5), append=True)
    assert table.read().count() == 8 and seen.count() == 3 and table.read(told=table.pointer(0)[1]).count() == 3
    with pytest.raises(versions.Conflict):
        table.point(table.stage(spark.range(1)), after=before)
    (tmp_path / "t" / "pointers" / "000000002").write_text('{"parts"')  # begun and not ended
    assert table.read().count() == 8
    table.put(spark.range(1))
    assert table.read().count() == 1 and table.pointer()[0] == 3
    assert table.vacuum(keep=1) == 3 and table.read().count() == 1


@pytest.mark.parametrize("change", ["delete", "compact", "refresh", "copy"])
def test_a_failure_leaves_the_old_rows(spark, tmp_path, broken, change):
    path, times = str(tmp_path / "t"), ("2026-09-01 10:00", "2026-09-01 10:00", "2026-09-02 11:00")
    df, store = rows(spark, *times), rollups.Store(spark, str(tmp_path / "r"), rollups.Rollup("1 hour"))
    if change == "delete":
        versions.Table(spark, path).put(df)
        now, do = lambda: versions.Table(spark, path).read(), lambda: readings.delete_copies(spark, path, quality.clean)
    elif change == "refresh":
        store.refresh(df, T("2026-09-01"), T("2026-09-03"))
        now, do = store.read, lambda: store.refresh(df.limit(1), T("2026-09-01"), T("2026-09-03"))
    else:
        layout.write(df, path)
        now = lambda: layout.read(spark, path)
        do = (lambda: layout.compact(spark, path, "2026-09-05 00:00:00")) if change == "compact" else (lambda: layout.copy_chunks(df.limit(1), path, ["2026-09-01 00:00:00"]))
    before = held(now())
    broken()
    with pytest.raises(OSError):
        do()
    assert held(now()) == before


def test_refresh_reads_what_was_touched(spark, tmp_path):
    """Late rows below the watermark are taken up, from their own chunks alone, and the store equals a full recompute."""
    path, touched, until = str(tmp_path / "readings"), rollups.Touched(spark, str(tmp_path / "touched")), T("2026-09-06 10:30")
    store, seen = rollups.Store(spark, str(tmp_path / "store"), rollups.Rollup("1 hour")), []

    def read(ranges):
        seen.append((ranges, layout.read_ranges(spark, path, ranges)))
        return seen[-1][1]

    def full(end):
        return held(rollups.Rollup("1 hour").compute(layout.read(spark, path).where(F.col("event_time") < F.lit(end).cast("timestamp_ntz"))))

    rollups.land(rows(spark, *[f"2026-09-0{k} {h}:05" for k in range(1, 7) for h in ("08", "09", "10")]), path, touched)
    store.take_up(read, touched, until)
    assert held(store.read()) == full("2026-09-06 10:00") and store.watermark() == T("2026-09-06 10:00")
    rollups.land(rows(spark, "2026-09-02 09:20", "2026-09-04 23:50", "2026-09-06 12:00"), path, touched)
    late = held(store.real_time(layout.read(spark, path)))
    assert len(late) == 19 and late != full("2027-01-01")  # stale below the watermark, the rows above it are there
    assert store.take_up(read, touched, T("2026-09-06 11:15")) == [(T("2026-09-02 09:00"), T("2026-09-02 10:00")), (T("2026-09-04 23:00"), T("2026-09-05 00:00")), (T("2026-09-06 10:00"), T("2026-09-06 11:00"))]
    assert held(store.read()) == full("2026-09-06 11:00") and held(store.real_time(layout.read(spark, path))) == full("2027-01-01")
    assert {f.split("chunk=")[1][:10] for f in seen[-1][1].inputFiles()} == {"2026-09-02", "2026-09-04", "2026-09-06"}
    plan = evidence(seen[-1][1])
    assert any("chunk" in x for x in plan["partitions"]) and any("event_time" in x for x in plan["pushed"])
    assert store.take_up(read, touched, T("2026-09-06 11:15")) == []
    assert store.watermark(0) == T("2026-09-06 10:00") and store.read(number=0).count() == 17


def test_local_days_are_taken_up_whole(spark, tmp_path):
    """A day of 25 hours in the store's zone is one bucket, and late rows of its last hour reach it."""
    touched, store = rollups.Touched(spark, str(tmp_path / "touched")), rollups.Store(spark, str(tmp_path / "store"), rollups.Rollup("1 day", (), "Europe/Berlin"))
    path = str(tmp_path / "readings")
    for times in (("2026-10-24 22:10", "2026-10-25 22:50", "2026-10-26 05:00"), ("2026-10-25 22:55",)):
        rollups.land(rows(spark, *times), path, touched)
        store.take_up(lambda ranges: layout.read_ranges(spark, path, ranges), touched, T("2026-10-28"))
    assert [(r.bucket, r.reading_count) for r in store.read().orderBy("bucket").collect()] == [(T("2026-10-24 22:00"), 3), (T("2026-10-25 23:00"), 1)]


def test_ranges_merge():
    t = lambda h: datetime(2026, 1, 1 + h // 24, h % 24)
    assert rollups.merged([]) == [] and rollups.merged([(t(3), t(3))]) == []
    assert rollups.merged([(t(5), t(6)), (t(1), t(3)), (t(2), t(4))]) == [(t(1), t(4)), (t(5), t(6))]
    assert rollups.merged([(t(0), t(1)), (t(2), t(3)), (t(10), t(11))], most=2) == [(t(0), t(3)), (t(10), t(11))]


def test_pause_and_wait(spark, tmp_path, monkeypatch):
    store, go = rollups.Store(spark, str(tmp_path / "s"), rollups.Rollup("1 hour")), threading.Event()
    assert store.wait_until_idle(0)
    slow = store._replace
    monkeypatch.setattr(store, "_replace", lambda *a, **b: (go.wait(60), slow(*a, **b)))
    running = threading.Thread(target=store.refresh, args=(rows(spark, "2026-09-01 10:00"), T("2026-09-01"), T("2026-09-02")))
    running.start()
    while not (tmp_path / "s" / "running").exists():
        pass
    store.pause()
    assert store.paused and not store.wait_until_idle(0.3)
    go.set()
    assert store.wait_until_idle(60)
    running.join()
    assert store.read().count() == 1
    store.refresh(rows(spark, "2026-09-01 10:00", "2026-09-01 11:00"), T("2026-09-01"), T("2026-09-02"))
    assert store.read().count() == 1  # paused
    store.resume()
    assert not store.paused


def test_freshness_joins_by_bucket(spark, tmp_path):
    rows(spark, "2026-09-01 10:00", "2026-09-01 23:59", "2026-09-02 00:00", "2026-09-05 00:00", "2026-09-09 00:00").write.parquet(str(tmp_path / "r"))
    windows = [("long", T("2026-09-01 10:00"), T("2026-09-05 00:00")), ("hour", T("2026-09-01 23:00"), T("2026-09-02 00:00")), ("none", T("2026-08-01"), T("2026-08-02")), ("void", T("2026-09-02"), T("2026-09-01"))]
    df = spark.createDataFrame(windows, "name string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = rollups.freshness(df, spark.read.schema(SHORT).parquet(str(tmp_path / "r")))
    assert {r.name: (r.row_count, r.energy_kwh) for r in got.collect()} == {"long": (3, 3.0), "hour": (1, 1.0), "none": (0, None), "void": (0, None)}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and any("event_time" in x for x in evidence(got)["pushed"])
    assert rollups.freshness(df.limit(0), rows(spark, "2026-09-01")).count() == 0


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    """After half of the events are gone, panels, meters and the baseline are made anew."""
    ids = spark.range(0, 200).select(F.col("id").alias("event_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-07 23:00:00").cast("timestamp_ntz")).alias("ts"), (F.col("id") % 10).alias("user_id"), F.lit(2.0).alias("value"))
    where = str(tmp_path)
    counts = lambda: [sum(r.reading_count for r in catalogue.QUERIES[n](spark, where).collect()) for n in ("panel_2_raw", "panel_2_aggregate")] + [catalogue.M(spark, where).count()]
    ids.write.parquet(f"{where}/events.parquet")
    first = counts()
    ids.where("event_id % 2 = 0").write.mode("overwrite").parquet(f"{where}/events.parquet")
    second = counts()
    assert first[0] == first[1] > second[0] == second[1] > 0 and (first[2], second[2]) == (10, 5)
    assert stored.once(spark, where, "meters", lambda p: pytest.fail("nothing has changed"))
