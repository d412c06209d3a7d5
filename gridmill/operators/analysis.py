"""Demand, customer mix, completeness and anomalies."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import DECIMAL, exact_avg, exact_sum, percent
from ..functions.timebucket import ZONE, bucket, is_weekend, local, local_day, slot_of_day, trailing_number, within


def rows() -> Column:
    return F.count(F.lit(1))


def hourly_profile(r: DataFrame, start: str, end: str) -> DataFrame:
    """Average power and readings in each local hour of a range."""
    hour = bucket(local(F.col("event_time")), "1 hour")
    return r.where(within(F.col("event_time"), start, end)).groupBy(hour.alias("hour")).agg(exact_avg("power_kw").alias("avg_power_kw"), rows().alias("readings"))


def top_intervals(r: DataFrame, n: int, start: str | None = None, end: str | None = None, width: str = "15 minutes") -> DataFrame:
    """The ``n`` intervals with most network power, earlier first on ties."""
    if start:
        r = r.where(within(F.col("event_time"), start, end))
    total = r.groupBy(bucket(F.col("event_time"), width).alias("event_time")).agg(exact_sum("power_kw").alias("total_kw"), rows().alias("meters_reporting"))
    return total.orderBy(F.desc("total_kw"), "event_time").limit(n)


def energy_by_meter(r: DataFrame) -> DataFrame:
    return r.groupBy("meter_id").agg(exact_sum("energy_kwh").alias("energy_kwh"))


def meter_range(r: DataFrame, meter: int, start: str, end: str) -> DataFrame:
    return r.where((F.col("meter_id") == meter) & within(F.col("event_time"), start, end)).agg(
        exact_sum("energy_kwh").alias("energy_kwh"), exact_avg("power_kw").alias("avg_power_kw"), F.max("power_kw").alias("max_power_kw")
    )


def full_summary(r: DataFrame) -> DataFrame:
    return r.agg(rows().alias("readings"), exact_sum("energy_kwh").alias("energy_kwh"), exact_avg("power_kw").alias("avg_power_kw"), F.min("power_kw").alias("min_power_kw"), F.max("power_kw").alias("max_power_kw"))


def load_checks(r: DataFrame) -> DataFrame:
    return r.agg(rows().alias("readings"), F.countDistinct("meter_id").alias("meters"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


def daily(r: DataFrame) -> DataFrame:
    return r.groupBy(local_day(F.col("event_time")).alias("day")).agg(exact_sum("energy_kwh").alias("energy_kwh"), rows().alias("readings"))


def weekly(r: DataFrame, first_day: str) -> DataFrame:
    """Seven-day periods counted from ``first_day``, from daily totals."""
    start = F.lit(first_day).cast("date")
    past = F.datediff("day", start)
    period = F.date_add(start, (past - F.pmod(past, F.lit(7))).cast("int"))
    return daily(r).groupBy(period.alias("period_start")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), rows().alias("days"), exact_sum("energy_kwh").alias("energy_kwh"))


def network(r: DataFrame, width: str = "1 hour") -> DataFrame:
    """Network power by interval."""
    return r.groupBy(bucket(F.col("event_time"), width).alias("event_time")).agg(exact_sum("power_kw").alias("kw"))


def context(r: DataFrame) -> DataFrame:
    t = network(r).agg(exact_avg("kw").alias("avg_kw"), F.min("kw").alias("min_kw"), F.max("kw").alias("max_kw"))
    return t.withColumn("peak_to_average", F.round(F.col("max_kw") / F.col("avg_kw"), 9))


def profile(r: DataFrame) -> DataFrame:
    """Average network power by local time of day and day type."""
    t = local(F.col("event_time"))
    kind = F.when(is_weekend(t), "weekend").otherwise("weekday")
    return network(r).groupBy(F.date_format(t, "HH:mm").alias("time_of_day"), kind.alias("day_type")).agg(exact_avg("kw").alias("avg_network_kw"))


def profile_pivot(r: DataFrame) -> DataFrame:
    return profile(r).groupBy("time_of_day").pivot("day_type", ["weekday", "weekend"]).agg(F.first("avg_network_kw"))


def weekday_change(r: DataFrame) -> DataFrame:
    """Weekday and weekend means of daily energy, their difference and the change from first to last day."""
    d = daily(r)
    end = F.weekday("day") >= 5
    m = d.agg(
        exact_avg(F.when(~end, F.col("energy_kwh"))).alias("weekday_kwh"), exact_avg(F.when(end, F.col("energy_kwh"))).alias("weekend_kwh"),
        F.min_by("energy_kwh", "day").alias("first_kwh"), F.max_by("energy_kwh", "day").alias("last_kwh"),
    )
    change = lambda a, b: F.round(100.0 * (F.col(b) - F.col(a)) / F.col(a), 6)
    return m.withColumn("weekend_change_pct", change("weekday_kwh", "weekend_kwh")).withColumn("first_last_change_pct", change("first_kwh", "last_kwh"))


def mix(r: DataFrame, meters: DataFrame, keys: list[str]) -> DataFrame:
    """Energy, per registered meter, and shares by group.  Meters are a dimension; Spark broadcasts it if it is small."""
    energy = r.join(meters, "meter_id").groupBy(*keys).agg(exact_sum("energy_kwh").alias("energy_kwh"), rows().alias("readings"))
    registered = meters.groupBy(*keys).agg(rows().alias("registered_meters"))
    whole = Window.partitionBy()  # a row for each group, few whatever the data
    return registered.join(energy, keys).select(
        *keys, "registered_meters", "readings", "energy_kwh", (F.col("energy_kwh") / F.col("registered_meters")).alias("kwh_per_meter"),
        (F.lit(100.0) * F.col("energy_kwh") / F.sum(F.col("energy_kwh").cast(DECIMAL)).over(whole).cast("double")).alias("pct_of_energy"),
        (F.lit(100.0) * F.col("registered_meters") / F.sum("registered_meters").over(whole)).alias("pct_of_meters"),
    )


def mix_pivot(r: DataFrame, meters: DataFrame, types: list[str]) -> DataFrame:
    return mix(r, meters, ["region", "customer_type"]).groupBy("region").pivot("customer_type", types).agg(F.first("kwh_per_meter"))


def industrial_correlation(r: DataFrame, meters: DataFrame) -> DataFrame:
    """Correlation over regions of the industrial share of meters with energy per meter, and the spread of the latter."""
    share = meters.groupBy("region").agg(F.avg(F.when(F.col("customer_type") == "industrial", 1.0).otherwise(0.0)).alias("share"))
    per = mix(r, meters, ["region"]).select("region", "kwh_per_meter").join(share, "region")
    # Null where a side doesn't vary; the built-in correlation divides by zero there.
    r = F.try_divide(F.covar_pop("share", "kwh_per_meter"), F.stddev_pop("share") * F.stddev_pop("kwh_per_meter"))
    return per.agg(F.round(r, 6).alias("r"), F.round(F.max("kwh_per_meter") / F.min("kwh_per_meter"), 6).alias("spread"))


def completeness(r: DataFrame, meters: DataFrame, slots: int) -> DataFrame:
    """Completeness by region and for the network; ``slots`` readings are planned for each meter."""
    observed = r.join(meters, "meter_id").groupBy("region").agg(rows().alias("observed_pairs"))
    registered = meters.groupBy("region").agg(rows().alias("registered_meters"))
    per = registered.join(observed, "region").withColumn("planned_pairs", F.col("registered_meters") * slots)
    sums = [F.sum(c).cast("long").alias(c) for c in ("registered_meters", "planned_pairs", "observed_pairs")]
    both = per.rollup("region").agg(*sums, F.grouping("region").alias("_g"))
    name = F.when(F.col("_g") == 1, "NETWORK").otherwise(F.col("region"))
    return both.select(
        name.alias("region"), "registered_meters", "planned_pairs", "observed_pairs", (F.col("planned_pairs") - F.col("observed_pairs")).alias("missing_pairs"),
        percent(F.col("observed_pairs"), F.col("planned_pairs")).alias("completeness_pct"),
    )


def completeness_spread(per_region: DataFrame) -> DataFrame:
    """Best, worst and the points between them, over regions; the network's own row is left out."""
    c = F.col("completeness_pct")
    one = per_region.where("region <> 'NETWORK'").agg(F.max(c).alias("best_pct"), F.min(c).alias("worst_pct"))
    return one.withColumn("spread_points", F.round(F.col("best_pct") - F.col("worst_pct"), 9))


def in_region_order(df: DataFrame) -> DataFrame:
    """By the number in the region's name, the network last."""
    return df.orderBy(F.col("region") == "NETWORK", trailing_number(F.col("region")))


def provisional(r: DataFrame, start: str, end: str) -> DataFrame:
    """A day as known at its end, and as known finally."""
    known = F.col("received_time") <= F.lit(end).cast("timestamp_ntz")
    return r.where(within(F.col("event_time"), start, end)).agg(
        F.count_if(known).alias("readings_by_cutoff"), rows().alias("readings_final"), exact_sum(F.when(known, F.col("energy_kwh"))).alias("energy_by_cutoff_kwh"),
        exact_sum("energy_kwh").alias("energy_final_kwh"), F.min(F.when(~known, F.col("event_time"))).alias("first_late_event"), F.max("received_time").alias("last_arrival"),
    )


def late_detail(r: DataFrame, start: str, end: str) -> DataFrame:
    """Readings of a range that arrived after its end, by local hour of arrival."""
    late = r.where(within(F.col("event_time"), start, end) & (F.col("received_time") > F.lit(end).cast("timestamp_ntz")))
    return late.groupBy(bucket(local(F.col("received_time")), "1 hour").alias("arrival_hour")).agg(rows().alias("readings"), exact_sum("energy_kwh").alias("energy_kwh"))


def slot_keys(r: DataFrame, minutes: int = 15, zone: str = ZONE) -> DataFrame:
    """``r`` with the anomaly baseline's keys: the slot of the local day, by its first minute, and weekend."""
    there = local(F.col("event_time"), zone)
    return r.withColumn("weekend", is_weekend(there)).withColumn("slot", slot_of_day(there, minutes))


def baseline(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("meter_id", "slot", "weekend").agg(F.percentile("power_kw", 0.5).alias("median_kw"), rows().alias("n_days"))


def ratios(keyed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each reading over its slot's median; ``stored`` is a baseline that was written before.  A median of 0 gives an infinite ratio, and NaN for a reading of 0."""
    known = stored if stored is not None else baseline(keyed)
    p, zero, value = F.col("power_kw"), F.col("median_kw") == 0, lambda x: F.lit(float(x))
    ratio = F.when(~zero, F.try_divide(p, "median_kw")).when(zero & (F.isnan(p) | (p == 0)), value("nan")).when(zero & (p > 0), value("inf")).when(zero & (p < 0), value("-inf"))
    return keyed.join(known, ["meter_id", "slot", "weekend"]).withColumn("ratio", ratio)


LEVELS = (0.0001, 0.001, 0.01, 0.5, 0.99, 0.999, 0.9999)


#: A bin that holds a wanted rank is split until it has at most so many rows, and a split makes so many bins.
SORTED, SPLIT = 100_000, 256


def rank_bins(values: DataFrame, ranks: list[int] | None, levels: tuple[float, ...] = LEVELS, most: int = SORTED) -> tuple[int, list[tuple[float, float, int, int]]]:
    """(rows, bins): the closed bins (low, high, rows before, rows) of ``values`` (v, no null) that hold the wanted ranks; each has one value or at most ``most`` rows.

    The first pass counts by a bin of the value, 256 an octave, with the infinities and NaN, the greatest value, in bins of their own; each later one splits the bins that are too large evenly between their least and greatest value,
    so a double's digits are used up in a few passes.  A few thousand counts reach the driver in the first, ``SPLIT`` a wanted bin in others.
    """
    v = F.col("v")
    octave = lambda x: F.floor(F.log2(x) * 256)
    far = 1_000_000  # beyond any octave of a double
    ends = F.when(F.isnan(v), 2 * far).when(v == float("inf"), far).when(v == float("-inf"), -4 * far)
    bin_ = ends.when(v > 0, octave(v)).when(v < 0, -2 * far - octave(-v)).otherwise(-far).cast("long")
    facts = F.min(v).alias("low"), F.max(v).alias("high"), F.count(F.lit(1)).alias("n")
    found = [(r.low, r.high, r.n) for r in values.groupBy(bin_.alias("b")).agg(*facts).collect()]
    n = sum(x[2] for x in found)
    ranks = ranks if ranks is not None else wanted_ranks(n, levels)

    def holding(bins: list, before: int) -> list:
        out = []
        for low, high, c in sorted(bins, key=lambda x: (x[0] != x[0], x)):  # NaN last
            if any(before <= k < before + c for k in ranks):
                out.append((low, high, before, c))
            before += c
        return out

    bins = holding(found, 0)
    while large := [x for x in bins if x[0] < x[1] and x[3] > most]:
        inside = [(v >= low) & (v <= high) for low, high, _, _ in large]
        of = F.coalesce(*[F.when(c, k) for k, c in enumerate(inside)])
        part = F.coalesce(*[F.when(c, F.least(F.floor((v - low) / (high - low) * SPLIT), F.lit(SPLIT - 1))) for c, (low, high, _, _) in zip(inside, large)])
        rows_ = values.where(reduce(Column.__or__, inside)).groupBy(of.alias("of"), part.alias("part")).agg(*facts).collect()
        bins = [x for x in bins if x not in large]
        for k, x in enumerate(large):
            bins += holding([(r.low, r.high, r.n) for r in rows_ if r.of == k], x[2])
    return n, sorted(bins, key=lambda x: x[2])


def wanted_ranks(n: int, levels: tuple[float, ...]) -> list[int]:
    """The ranks, from 0, that quantiles of ``n`` rows are interpolated between."""
    return sorted({k for q in levels for k in (floor(q * (n - 1)), ceil(q * (n - 1)))}) if n else []


def exact_quantiles(df: DataFrame, value: str, levels: tuple[float, ...] = LEVELS, most: int = SORTED, nan: bool = False) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, of any number of rows; null is left out, and so is NaN unless ``nan`` counts it as the greatest value.

    Only the rows of the bins that hold a wanted rank are sorted, each bin in a task of its own that has at most ``most`` rows, whatever their values are.
    """
    v = F.col(value).cast("double")
    values = df.where(v.isNotNull() if nan else v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    n, bins = rank_bins(values, None, levels, most)
    if not n:
        return [None] * len(levels)
    ranks, at = wanted_ranks(n, levels), {}
    for low, high, before, c in bins:
        if not low < high:
            at |= {k: low for k in ranks if before <= k < before + c}
    if many := [x for x in bins if x[0] < x[1]]:
        inside = [F.col("v").between(low, high) for low, high, _, _ in many]
        start = F.coalesce(*[F.when(c, F.lit(x[2]).cast("long")) for c, x in zip(inside, many)])
        counts = values.where(reduce(Column.__or__, inside)).groupBy(start.alias("start"), "v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("start").orderBy("v")) + F.col("start")
        placed = counts.select("v", (upto - F.col("c")).alias("low"), upto.alias("high"))
        hit = [(F.col("low") <= k) & (F.col("high") > k) for k in ranks]
        for r in placed.where(reduce(Column.__or__, hit)).collect():  # at most two rows a level
            at |= {k: r.v for k in ranks if r.low <= k < r.high}
    out = []
    for q in levels:
        low, high, part = at[floor(q * (n - 1))], at[ceil(q * (n - 1))], q * (n - 1) - floor(q * (n - 1))
        out.append(low * (1 - part) + high * part if low != high else low)
    return out


def ratio_distribution(ratio: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Least and greatest ratio, and exact quantiles between; NaN is the greatest value."""
    q = exact_quantiles(ratio, "ratio", levels, nan=True)
    fixed = [F.round(F.lit(x).cast("double"), 9).alias(f"q{k}") for k, x in enumerate(q)]
    return ratio.agg(F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio")).select("min_ratio", *fixed, "max_ratio")


def flags(ratio: DataFrame, high: float = 2.0, low: float = 0.3) -> DataFrame:
    """Readings at least ``high`` or at most ``low`` times their median."""
    above = F.col("power_kw") >= high * F.col("median_kw")
    below = F.col("power_kw") <= low * F.col("median_kw")
    return ratio.where(above | below).select("meter_id", "event_time", "power_kw", "median_kw", "ratio", F.when(above, "high").otherwise("low").alias("flag_type"))


def _inside(left: DataFrame, events: DataFrame, how: str) -> DataFrame:
    e = events.withColumnRenamed("meter_id", "_m")
    return left.join(e, (left.meter_id == e._m) & (left.event_time >= e.start_time) & (left.event_time < e.end_time), how)


def event_detection(flagged: DataFrame, events: DataFrame) -> DataFrame:
    """Labelled events with the flags inside them; one flag detects an event."""
    hits = _inside(flagged, events, "inner").groupBy("meter_id", "start_time").agg(rows().alias("n_flags"))
    joined = events.join(hits, ["meter_id", "start_time"], "left")
    n = F.coalesce("n_flags", F.lit(0))
    return joined.select("meter_id", "start_time", "end_time", "event_type", n.cast("long").alias("n_flags"), (n > 0).alias("detected"))


def detection_rates(r: DataFrame, flagged: DataFrame, events: DataFrame) -> DataFrame:
    """Flags outside all events over readings outside all events, and the meters they touch."""
    false = _inside(flagged, events, "left_anti").agg(rows().alias("false_flags"), F.countDistinct("meter_id").alias("meters_with_false_flags"))
    outside = _inside(r, events, "left_anti").agg(rows().alias("readings_outside"))
    found = event_detection(flagged, events).agg(rows().alias("events"), F.count_if("detected").alias("events_detected"))
    df = false.crossJoin(outside).crossJoin(found)
    return df.withColumn("false_flag_pct", percent(F.col("false_flags"), F.col("readings_outside")))
