"""Small fixtures with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridmill import catalogue
from gridmill.functions.timebucket import bucket, iso_with_offset, local_bucket, local_day, slot_of_day, snapped, utc_of_iso
from gridmill.operators import analysis, compare, layout, quality, rollups
from gridmill.plans import forecast, panels
from gridmill.sources import readings
from gridmill.sources.versions import Table
from gridmill.streaming import live

T = datetime.fromisoformat


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SHORT = "meter_id bigint, event_time timestamp_ntz, received_time timestamp_ntz, power_kw double, voltage_v double, current_a double, frequency_hz double, energy_kwh double"


def reading(meter, at, power=1.0, wait=15):
    at = T(at)
    return (meter, at, at + timedelta(minutes=wait), power, 230.0, 1.0, 50.0, power * 0.25)


def test_buckets_and_days(spark):
    df = frame(spark, [(T("2026-09-15 21:59"),), (T("2026-09-15 22:00"),)], "t timestamp_ntz")
    days = [r[0].isoformat() for r in df.select(local_day(F.col("t"))).collect()]
    assert days == ["2026-09-15", "2026-09-16"]
    assert {r[0] for r in df.select(bucket(F.col("t"), "1 day")).collect()} == {T("2026-09-15")}
    week = df.select(local_bucket(F.col("t"), "7 days", origin="2026-09-01 00:00:00")).collect()
    assert [r[0] for r in week] == [T("2026-09-14 22:00")] * 2
    before = frame(spark, [(T("1999-12-31 23:50"),)], "t timestamp_ntz").select(bucket(F.col("t"), "15 minutes")).first()[0]
    assert before == T("1999-12-31 23:45")


def test_snapped_range(spark):
    low, high = snapped("2026-09-03 10:00:00", "2026-09-04 22:00:00")
    assert spark.range(1).select(low, high).first()[:] == (T("2026-09-02 22:00"), T("2026-09-04 22:00"))


def test_delays(spark):
    rows = [reading(k, "2026-09-01 00:00", wait=w) for k, w in enumerate((15, 30, 180, 20))]
    p = quality.pairs(frame(spark, rows, SHORT))
    assert {r.delay_class: r.readings for r in quality.delays(p).collect()} == {"on_time": 1, "delayed": 2, "other": 1}


def test_grid_and_summary(spark):
    m = frame(spark, [(1,), (2,)], "meter_id bigint")
    g = quality.grid(m, "2026-09-01 00:00:00", "2026-09-01 02:00:00", "15 minutes")
    rows = [reading(k, str(T("2026-09-01") + timedelta(minutes=15 * i))) for k in (1, 2) for i in range(8) if (k, i) not in {(1, 0), (1, 7), (2, 3)}]
    p = quality.pairs(frame(spark, rows + rows[:1], SHORT))
    s = quality.summary(p, g).first()
    assert (s.planned, s.missing, s.extra_copies, s.emitted_adds_up) == (16, 3, 1, True)
    assert quality.missing(g, p).count() == 3


def test_worst_keeps_ties(spark):
    counts = (47, 45, 45, 44, 43, 43, 1)
    missed = frame(spark, [(k, i) for k, n in enumerate(counts) for i in range(n)], "meter_id bigint, event_time int")
    assert sorted(r.rnk for r in quality.worst(missed).collect()) == [1, 2, 2, 4, 5, 5]


def test_cleaning_keeps_conflicts(spark):
    same, one = reading(1, "2026-09-01"), reading(3, "2026-09-01")
    rows = [same, same, reading(2, "2026-09-01", 1.0), reading(2, "2026-09-01", 2.0), one]
    raw = frame(spark, rows, SHORT)
    cleaned = quality.clean(raw)
    assert cleaned.count() == 4 and quality.clean(cleaned).count() == 4
    g = quality.duplicate_groups(raw)
    assert {(r.meter_id, r.distinct_versions) for r in g.collect()} == {(1, 1), (2, 2)}
    s = quality.duplicate_summary(g).first()
    assert (s.identical_groups, s.conflicting_groups, s.removable_energy_kwh) == (1, 1, 0.25)


def test_provisional_cutoff_is_inclusive(spark):
    rows = [reading(1, "2026-09-20 23:45"), (2, T("2026-09-20 23:45"), T("2026-09-21 00:00:01"), 1.0, 1.0, 1.0, 1.0, 0.25)]
    r = analysis.provisional(frame(spark, rows, SHORT), "2026-09-20 00:00:00", "2026-09-21 00:00:00").first()
    assert (r.readings_by_cutoff, r.readings_final) == (1, 2)


def test_flags_and_events(spark):
    rows = [(1, T("2026-09-01 12:00"), p, 1.0, p) for p in (2.0, 1.99, 0.3, 0.31)]
    f = analysis.flags(frame(spark, rows, "meter_id bigint, event_time timestamp_ntz, power_kw double, median_kw double, ratio double"))
    assert sorted((r.power_kw, r.flag_type) for r in f.collect()) == [(0.3, "low"), (2.0, "high")]
    events = frame(spark, [(1, T("2026-09-01 12:00"), T("2026-09-01 15:00"), "a"), (1, T("2026-09-01 09:00"), T("2026-09-01 12:00"), "b")], "meter_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, event_type string")
    assert {r.event_type: r.detected for r in analysis.event_detection(f, events).collect()} == {"a": True, "b": False}


def test_freshness_stages(spark, tmp_path):
    hour = T("2026-09-10 10:00")
    older = hour - timedelta(hours=1)
    schema = "event_time timestamp_ntz, energy_kwh double, power_kw double"
    rows = lambda *xs: frame(spark, [(t, e, 0.0) for t, e in xs], schema)
    store = rollups.Store(spark, str(tmp_path / "r"), rollups.Rollup("1 hour", (), "UTC"))
    first = rows((older + timedelta(minutes=10), 1.0))
    store.refresh(first, older, hour)
    cells = lambda df: {r.bucket: (r.energy_kwh, r.reading_count) for r in df.collect()}
    assert cells(store.read()) == {older: (1.0, 1)} and store.watermark() == hour
    late = first.union(rows((older + timedelta(minutes=25), 0.5), (hour + timedelta(minutes=10), 2.0)))
    assert cells(store.real_time(late)) == {older: (1.0, 1), hour: (2.0, 1)}  # stale below the watermark
    store.refresh(late, older, hour + timedelta(hours=1))
    assert cells(store.read()) == {older: (1.5, 2), hour: (2.0, 1)}
    store.pause()
    store.refresh(rows(), older, hour)
    assert cells(store.read()) == {older: (1.5, 2), hour: (2.0, 1)}


def test_policy_window():
    low, high = rollups.Policy().window(T("2026-09-10 10:20"), "1 hour")
    assert (low, high) == (T("2026-09-07 11:00"), T("2026-09-10 09:00"))


def test_layout_round_trip(spark, tmp_path):
    rows = [reading(k, str(T("2026-09-01") + timedelta(hours=i)), float(i)) for k in (1, 2) for i in range(60)]
    df = frame(spark, rows, SHORT)
    path = str(tmp_path / "t")
    layout.write(df, path, "1 day", tasks=2)
    week = layout.read(spark, path, "2026-09-01 12:00:00", "2026-09-02 12:00:00")
    assert week.count() == 48 and "PartitionFilters: []" not in week._jdf.queryExecution().toString()
    assert layout.compact(spark, path, "2026-09-02 00:00:00") == 1
    c = layout.checks({"a": df, "b": layout.read(spark, path)}).collect()
    assert all(r.matches for r in c)
    assert readings.storage(spark, path).count() == 3


def test_csv_and_upsert(spark, tmp_path):
    df = frame(spark, [reading(1, "2026-09-01"), reading(2, "2026-09-01")], SHORT)
    readings.write_csv(df, str(tmp_path / "c"))
    assert readings.recount(spark, str(tmp_path / "c")) == 2
    assert readings.load_csv(spark, str(tmp_path / "c"), str(tmp_path / "p")) == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readings.load_csv(spark, str(tmp_path / "c"), str(tmp_path / "p"))
    old, new = frame(spark, [(1, "a")], "k int, v string"), frame(spark, [(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, readings.upsert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_forecast_lags_are_exact(spark):
    hours = [T("2026-09-01") + timedelta(hours=i) for i in range(24 * 9)]
    rows = [("Region 1", h, float(k), 1) for k, h in enumerate(hours) if k != 30]
    grid = forecast.on_grid(frame(spark, rows, "region string, hour_start timestamp_ntz, energy_kwh double, readings bigint"), "2026-09-01 00:00:00", "2026-09-10 00:00:00")
    f = {r.hour_start: r for r in forecast.features(grid).collect()}
    assert f[hours[54]].lag_24h is None and f[hours[55]].lag_24h == 31.0
    assert f[hours[50]].prev_day_mean is None and f[hours[80]].prev_day_mean is not None
    assert f[hours[200]].lag_168h == 32.0 and f[hours[198]].prev_week_same_hour_mean is None


def test_ridge_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("Region %d" % (k % 3), T("2026-09-01") + timedelta(hours=k), float(rng.normal(10)), k % 24, k % 7, *map(float, rng.normal(size=5)), "train", True) for k in range(400)]
    schema = "region string, hour_start timestamp_ntz, energy_kwh double, hour int, dow int, lag_24h double, lag_48h double, lag_168h double, prev_day_mean double, prev_week_same_hour_mean double, split string, complete boolean"
    df = frame(spark, rows, schema)
    got = np.array([r.prediction for r in forecast.predict(forecast.ridge(df, 10.0), df).orderBy("hour_start").collect()])
    x = np.array([r[5:10] for r in rows])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    hot = [np.array([[float(r[c] == v) for v in sorted({q[c] for q in rows})] for r in rows]) for c in (0, 3, 4)]
    x, y = np.hstack([x, *hot]), np.array([r[2] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.abs(got - (xc @ w + y.mean())).max() < 1e-6


def ridge_rows(n, regions=3, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    schema = "region string, hour_start timestamp_ntz, energy_kwh double, hour int, dow int, lag_24h double, lag_48h double, lag_168h double, prev_day_mean double, prev_week_same_hour_mean double, split string, complete boolean"
    part = lambda k: ("train", "train", "validation", "test")[k % 4]
    return [("Region %d" % (k % regions), T("2026-09-01") + timedelta(hours=k), float(rng.normal(10)), k % 24, k % 7, *map(float, rng.normal(5, 2, size=4)), 3.5, part(k), True) for k in range(n)], schema


def test_all_penalties_from_one_pass(spark):
    """Moments of any partitioning give the same weights, one aggregate serves all penalties, and cells bound what is collected."""
    rows, schema = ridge_rows(2000)
    df = frame(spark, rows, schema)
    cells = forecast.moments(df).collect()
    assert len(cells) <= 3 * 24 * 7 and sum(c.n for c in cells) == 2000
    again = forecast.moments(df.orderBy("energy_kwh").repartition(7)).collect()
    assert sorted(map(tuple, cells)) == sorted(map(tuple, again))
    plan = forecast.moments(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Python" not in plan
    for one, alpha in zip(forecast.solved(cells, forecast.ALPHAS), forecast.ALPHAS):
        alone = forecast.ridge(df, alpha)
        assert one.alpha == alpha and one.intercept == pytest.approx(alone.intercept, rel=1e-9)
        assert one.numbers["prev_week_same_hour_mean"] == (3.5, 0.0)  # constant: no spread, no weight


def test_selection_is_the_least_validation_error(spark):
    rows, schema = ridge_rows(1200)
    df = frame(spark, rows, schema)
    model, alpha, tried = forecast.select_ridge(df)
    want = {a: forecast.metrics(forecast.predict(forecast.ridge(df.where("split = 'train'"), a), df.where("split = 'validation'"))).first() for a in forecast.ALPHAS}
    assert [t["alpha"] for t in tried] == list(forecast.ALPHAS)
    for t in tried:
        assert t["mae"] == pytest.approx(want[t["alpha"]].mae, rel=1e-7) and t["n"] == want[t["alpha"]].n
    assert alpha == model.alpha == min(forecast.ALPHAS, key=lambda a: (want[a].mae, a))


def test_ridge_of_unknown_and_null_values(spark):
    """A region that training hasn't seen, and a null one, add nothing; a null number gives no prediction."""
    rows, schema = ridge_rows(400)
    model = forecast.ridge(frame(spark, rows, schema), 1.0)
    base = list(rows[0])
    new = [tuple(["Region 9", *base[1:]]), tuple([None, *base[1:]]), tuple([*base[:5], None, *base[6:]])]
    a, b, c = forecast.predict(model, frame(spark, new, schema)).collect()
    known = forecast.predict(model, frame(spark, rows[:1], schema)).first().prediction
    assert a.prediction == b.prediction == pytest.approx(known - model.categories["region"][base[0]]) and c.prediction is None
    one = forecast.ridge(frame(spark, rows[:1], schema), 1.0)  # a single row: the intercept is all there is
    assert forecast.predict(one, frame(spark, rows[:1], schema)).first().prediction == pytest.approx(rows[0][2])


def test_peak_tie_and_compare(spark):
    rows = [("Region 1", T("2026-09-01 05:00"), 9.0, 1.0), ("Region 1", T("2026-09-01 03:00"), 9.0, 1.0)]
    p = forecast.peak_hours(frame(spark, rows, "region string, hour_start timestamp_ntz, energy_kwh double, prediction double")).first()
    assert p.hour_start == T("2026-09-01 03:00")
    a, b = frame(spark, [(1, 1.0), (2, 2.0)], "k int, v double"), frame(spark, [(1, 1.0), (3, 2.0)], "k int, v double")
    r = compare.by_key(a, b, ["k"], ["v"]).first()
    assert (r.cells, r.unmatched, r.passes) == (3, 2, False)


def test_empty_region_panel(spark):
    m = frame(spark, [(1, "Region 1"), (2, "Region 2")], "meter_id bigint, region string")
    r = frame(spark, [reading(1, "2026-09-01 10:00")], SHORT)
    rows = {x.region: x.completeness_pct for x in panels.completeness(r, "2026-09-01 00:00:00", "2026-09-01 22:00:00", m).collect()}
    assert rows["Region 2"] == 0.0 and rows["Region 1"] > 0
    assert analysis.completeness(r, m, 96).where("region = 'Region 2'").count() == 0


@pytest.mark.parametrize("from_day, scored", [(1, 7 * 24 - 25), (27, 0)])
def test_ridge_leaves_out_incomplete_rows(spark, monkeypatch, from_day, scored):
    """A gap isn't a reading of 0 kWh: it and the rows whose predictors need it are neither fitted nor scored."""
    start, gap = datetime(2024, 1, 1), datetime(2024, 1, 27, 5)
    times = [start + timedelta(hours=h) for h in range(28 * 24)]
    rows = [("a", t, 5.0 + t.hour + t.weekday(), 1) for t in times if t.day >= from_day and t != gap]
    rows = rows or [("a", times[0], 1.0, 1)]
    grid = forecast.on_grid(frame(spark, rows, "region string, hour_start timestamp_ntz, energy_kwh double, readings bigint"), "2024-01-01", "2024-01-29")
    df = forecast.split(forecast.features(grid), "2024-01-15", "2024-01-22")
    monkeypatch.setattr(catalogue, "_features", lambda s, d: df)
    got = catalogue.QUERIES["forecast_ridge"](spark, "").collect()
    assert len(got) == 1 and got[0].n == scored == df.where("split = 'test' AND complete").count()
    assert (got[0].mae is None and got[0].alpha is None) if not scored else got[0].mae >= 0


def test_iso_times_keep_offset_and_microseconds(spark):
    df = frame(spark, [("2026-09-01T00:00:00.123456+02:00",), ("2026-09-01T00:00:00-05:30",), ("2026-09-01T00:00:00Z",), ("2026-09-01 00:00:00",), ("soon",), (None,)], "x string")
    got = [r[0] for r in df.select(utc_of_iso(F.col("x"))).collect()]
    assert got == [T("2026-08-31 22:00:00.123456"), T("2026-09-01 05:30:00"), T("2026-09-01"), T("2026-09-01"), None, None]
    one = frame(spark, [(T("2026-08-31 22:00:00.123456"),)], "t timestamp_ntz")
    assert [one.select(iso_with_offset(F.col("t"), z)).first()[0] for z in ("Africa/Kigali", "America/St_Johns")] == ["2026-09-01T00:00:00.123456+02:00", "2026-08-31T19:30:00.123456-02:30"]
    assert one.select(slot_of_day(F.col("t"), 15)).first()[0] == 22 * 60


def test_topic_filters(spark):
    df = frame(spark, [("energy/meters/1",), ("energy/meters",), ("energy/meters/1/x",), ("energy/other/1",)], "t string")
    hits = lambda p: [r[0] for r in df.select(live.topic_matches(F.col("t"), p)).collect()]
    assert hits("energy/meters/#") == [True, True, True, False] and hits("energy/+/1") == [True, False, False, True] and hits("#") == [True] * 4


def test_refresh_drops_days_whose_readings_are_gone(spark, tmp_path):
    schema = "event_time timestamp_ntz, energy_kwh double, power_kw double"
    days = [T("2026-09-01 10:00"), T("2026-09-02 10:00"), T("2026-09-03 10:00")]
    rows = lambda *ts: frame(spark, [(t, 1.0, 4.0) for t in ts], schema)
    store = rollups.Store(spark, str(tmp_path / "r"), rollups.Rollup("1 hour", (), "UTC"))
    store.refresh(rows(*days), T("2026-09-01"), T("2026-09-04"))
    store.refresh(rows(days[0], days[2]), T("2026-09-02"), T("2026-09-03"))
    assert sorted(r.bucket for r in store.read().collect()) == [days[0], days[2]]
    assert store.read("2026-09-03 00:00:00", "2026-09-04 00:00:00").count() == 1


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (list(map(float, rng.lognormal(size=5000))), [1.0] * 50, [-3.0, -1.0, 0.0, 0.0, 2.0, 1e300, 1e-300], [4.5]):
        df = frame(spark, [(v,) for v in values] + [(None,)], "v double")
        assert analysis.exact_quantiles(df, "v") == pytest.approx(list(np.quantile(values, analysis.LEVELS)), rel=1e-12)
    assert analysis.exact_quantiles(frame(spark, [], "v double"), "v") == [None] * 7


def test_ordered_compare(spark):
    a = frame(spark, [(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = frame(spark, [(1, 1.0004), (2, 2.1), (3, None)], "k int, v double")
    assert compare.ordered(a, b, ["k"]).first()[:] == (3, 3, 1, False) and compare.ordered(a, a, ["k"]).first().passes
    assert compare.ordered(a, a.limit(2), ["k"]).first()[:] == (3, 2, 1, False)


def test_quantile_bins_are_split(spark):
    """All values in one bin of the first pass: the bins that are sorted have a bounded number of rows, and the quantiles stay exact."""
    import numpy as np

    rng = np.random.default_rng(5)
    for values in ([1 + k * 1e-9 for k in range(4000)], list(1 + rng.random(4000) ** 8 / 400), [1.0] * 3000 + [1.0 + 2**-52] * 1000, [-1 - k * 1e-12 for k in range(2000)]):
        df = frame(spark, [(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        n, bins = analysis.rank_bins(df.where("v IS NOT NULL AND NOT isnan(v)"), None, most=20)
        assert n == len(values) and all(c <= 20 or low == high for low, high, _, c in bins)
        assert analysis.exact_quantiles(df, "v", most=20) == pytest.approx(list(np.quantile(values, analysis.LEVELS)), rel=1e-15)


def test_numbers_and_ranks_without_one_task(spark):
    """Row numbers by ranges and ranks with ties; no window is without a partition."""
    single = lambda df: [x for x in df._jdf.queryExecution().toString().split("\n") if "SinglePartition" in x and "Window" in x] + [x for x in df._jdf.queryExecution().toString().split("\n") if "Exchange SinglePartition" in x]
    df = spark.range(0, 5000, 1, 8).select(F.pmod(F.hash("id"), F.lit(700)).alias("k"), "id")
    got = compare.numbered(df, [F.desc("k"), F.col("id")])
    assert not single(got)
    rows = got.orderBy("_n").collect()
    assert [r._n for r in rows] == list(range(1, 5001)) and [(r.k, r.id) for r in rows] == sorted(((r.k, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    missed = frame(spark, [(m,) for m, n in ((1, 4), (2, 3), (3, 3), (4, 2), (5, 2), (6, 2), (7, 1)) for _ in range(n)], "meter_id bigint")
    worst = quality.worst(missed, 4)
    assert not single(worst)
    assert sorted(map(tuple, worst.collect())) == [(1, 4, 1), (2, 3, 2), (3, 3, 2), (4, 2, 4), (5, 2, 4), (6, 2, 4)]
    assert quality.worst(missed.limit(0)).count() == 0


def test_delete_copies_twice(spark, tmp_path):
    same = reading(1, "2026-09-01")
    table = Table(spark, str(tmp_path / "t"))
    table.put(frame(spark, [same, same, reading(2, "2026-09-01")], SHORT))
    assert [readings.delete_copies(spark, str(tmp_path / "t"), quality.clean) for _ in range(2)] == [1, 0]
    assert table.read().count() == 2


def test_plans_prune_and_push(spark, sf):
    """Filters and columns reach the scan, and a panel from a rollup reads only the days of its range."""
    from gridmill.plans.evidence import evidence

    q4, q5, panel = (evidence(catalogue.QUERIES[n](spark, sf)) for n in ("q4", "q5", "panel_1_aggregate"))
    assert any("user_id" in x for x in q4["pushed"]) and any("ts" in x for x in q4["pushed"])
    assert q5["columns"] == ["value"] or set(q5["columns"]) == {"value", "user_id"} - {"user_id"}
    assert any("day" in x for x in panel["partitions"]) and any("bucket" in x for x in panel["pushed"])
    timed = catalogue.QUERIES["layout_time_ordered"](spark, sf)
    assert any("chunk" in x for x in evidence(timed)["partitions"])


def test_big_chunks_get_more_tasks(spark, tmp_path):
    rows = [reading(k, "2026-09-01", float(k)) for k in range(400)] + [reading(1, "2026-09-02")]
    layout.write(frame(spark, rows, SHORT), str(tmp_path / "t"), tasks=64, rows_per_task=50)
    files = {r.partition: r.files for r in readings.storage(spark, str(tmp_path / "t")).collect()}
    assert sorted(files.values())[0] == 1 and sorted(files.values())[-1] >= 6


def test_frozen_model_scores_the_same(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=h), 5.0 + h % 24 + (h * 7) % 5, 1) for h in range(28 * 24)]
    df = forecast.split(forecast.features(forecast.on_grid(frame(spark, rows, "region string, hour_start timestamp_ntz, energy_kwh double, readings bigint"), "2024-01-01", "2024-01-29")), "2024-01-15", "2024-01-22")
    got = forecast.ridge_metrics(df, str(tmp_path / "m")).first()
    model, alpha, _ = forecast.select_ridge(df)
    want = forecast.metrics(forecast.predict(model, df.where("split = 'test' AND complete"))).first()
    assert forecast.Ridge.load(spark, str(tmp_path / "m")) == model and got.alpha == alpha and got.mae == pytest.approx(want.mae, rel=1e-6)


def test_ratios_over_a_median_of_zero(spark):
    """As the SQL does: 0 over 0 is NaN, the greatest value, and counts in quantiles; other readings are infinite."""
    import duckdb

    rows = [(1, 0, False, p) for p in (0.0, 0.0, 0.0, 5.0, -2.0, None)] + [(2, 0, False, float(p)) for p in range(1, 40)]
    ratio = analysis.ratios(frame(spark, rows, "meter_id bigint, slot int, weekend boolean, power_kw double"))
    got = [r.ratio for r in ratio.orderBy("meter_id", "power_kw").collect()]
    assert got[0] is None and got[1] == -float("inf") and all(x != x for x in got[2:5]) and got[5] == float("inf")
    con = duckdb.connect()
    con.execute("create table t (m int, p double)")
    con.executemany("insert into t values (?, ?)", [(m, p) for m, _, _, p in rows])
    levels = (*analysis.LEVELS, 0.2, 0.9, 0.95, 1.0)
    want = con.sql(
        "with ratio as (select p / b as ratio from t join (select m, quantile_cont(p, 0.5) as b from t group by m) using (m)) select min(ratio), "
        + ", ".join(f"round(quantile_cont(ratio, {q}), 9)" for q in levels) + ", max(ratio) from ratio"
    ).fetchall()[0]
    assert repr(tuple(analysis.ratio_distribution(ratio, levels).first())) == repr(want)
