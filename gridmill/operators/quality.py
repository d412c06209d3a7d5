"""Audit of gaps, delays and duplicates, and cleaning of exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum, percent
from ..functions.timebucket import bucket
from ..sources.readings import VALUES

KEYS = ["meter_id", "event_time"]


def pairs(raw: DataFrame) -> DataFrame:
    """One row for each (meter, time): copies and first arrival."""
    return raw.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"), F.min("received_time").alias("received_time"))


def grid(meters: DataFrame, start: str, end: str, slot: str) -> DataFrame:
    """Every meter at every planned slot."""
    times = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 microsecond"), F.expr(f"interval {slot}"))
    return meters.select("meter_id", F.explode(times).alias("event_time"))


def missing(planned: DataFrame, observed: DataFrame) -> DataFrame:
    return planned.join(observed, KEYS, "left_anti")


def summary(observed: DataFrame, planned: DataFrame) -> DataFrame:
    """Counts and shares; missing and completeness over planned, copies and delays over unique."""
    late = F.col("received_time") > F.col("event_time") + F.expr("interval 15 minutes")
    got = observed.agg(F.sum("copies").alias("emitted"), F.count(F.lit(1)).alias("unique_readings"), F.sum(F.col("copies") - 1).alias("extra_copies"), F.count_if(late).alias("delayed"))
    df = got.crossJoin(planned.agg(F.count(F.lit(1)).alias("planned")))
    df = df.withColumn("missing", F.col("planned") - F.col("unique_readings"))
    return df.select(
        "planned", "emitted", "unique_readings", "extra_copies", "delayed", "missing",
        F.round(percent(F.col("missing"), F.col("planned")), 3).alias("missing_pct"),
        F.round(percent(F.col("unique_readings"), F.col("planned")), 3).alias("completeness_pct"),
        F.round(percent(F.col("extra_copies"), F.col("unique_readings")), 3).alias("duplicate_pct"),
        F.round(percent(F.col("delayed"), F.col("unique_readings")), 3).alias("delayed_pct"),
        (F.col("unique_readings") + F.col("extra_copies") == F.col("emitted")).alias("emitted_adds_up"),
    )


def against_reference(measured: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Unpivot measured counts and hold them against a contract."""
    long = measured.select(*[F.col(k).cast("long").alias(k) for k in expected]).unpivot([], list(expected), "metric", "measured")
    want = measured.sparkSession.createDataFrame(list(expected.items()), "metric string, expected long")
    return long.join(F.broadcast(want), "metric").withColumn("matches", F.col("measured") == F.col("expected"))


def delays(observed: DataFrame) -> DataFrame:
    """Readings by delay class."""
    wait = F.col("received_time") - F.col("event_time")
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    kind = F.when(wait == minutes(15), "on_time").when(wait.between(minutes(30), minutes(180)), "delayed").otherwise("other")
    seconds = F.timestamp_diff("SECOND", F.col("event_time"), F.col("received_time"))
    return observed.groupBy(kind.alias("delay_class")).agg(F.count(F.lit(1)).alias("readings"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"))


def worst(missed: DataFrame, keep: int = 5) -> DataFrame:
    """Meters by rank of missing readings, ties kept."""
    counts = missed.groupBy("meter_id").agg(F.count(F.lit(1)).alias("missing"))
    # A rank follows from how many meters have each larger count, and ranks up to ``keep`` from the ``keep`` largest counts: a top-k, a row for each.
    ranks, before = [], 0
    for r in counts.groupBy("missing").agg(F.count(F.lit(1)).alias("meters")).orderBy(F.desc("missing")).limit(keep).collect():
        if before < keep:
            ranks.append((r.missing, before + 1))
        before += r.meters
    known = missed.sparkSession.createDataFrame(ranks, "missing long, rnk long")
    return counts.join(F.broadcast(known), "missing").select("meter_id", "missing", "rnk")


def duplicate_groups(raw: DataFrame) -> DataFrame:
    """Keys with two or more rows: copies, versions and the energy of the extra ones."""
    agg = raw.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("copies"), F.countDistinct(F.struct(*VALUES)).alias("distinct_versions"), (exact_sum("energy_kwh") - F.min("energy_kwh")).alias("extra_energy_kwh")
    )
    return agg.where("copies > 1")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    same = F.col("distinct_versions") == 1
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("copies") - 1).alias("extra_copies"), F.max("copies").alias("max_copies"), F.count_if(same).alias("identical_groups"),
        F.count_if(~same).alias("conflicting_groups"), exact_sum(F.when(same, F.col("extra_energy_kwh"))).alias("removable_energy_kwh"),
    )


def duplicate_examples(raw: DataFrame, groups: DataFrame, n: int = 2) -> DataFrame:
    """All rows of the first ``n`` duplicate groups."""
    return raw.join(F.broadcast(groups.orderBy(*KEYS).limit(n).select(*KEYS)), KEYS).select(*KEYS, *VALUES)


def conflicts(groups: DataFrame) -> DataFrame:
    return groups.where("distinct_versions > 1")


def clean(raw: DataFrame) -> DataFrame:
    """Without exact copies; conflicting versions stay.  Cleaning twice changes nothing."""
    return raw.dropDuplicates([*KEYS, *VALUES])


def clean_compare(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    facts = lambda df, x: df.agg(F.count(F.lit(1)).alias(f"rows_{x}"), exact_sum("energy_kwh").alias(f"energy_{x}"))
    both = facts(raw, "before").crossJoin(facts(cleaned, "after"))
    return both.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after")).withColumn("energy_removed", F.round(F.col("energy_before") - F.col("energy_after"), 6))


def observed_slots(readings: DataFrame, slot: str) -> DataFrame:
    """Readings counted in the slot they fall in."""
    return readings.select("meter_id", bucket(F.col("event_time"), slot).alias("event_time"), "received_time")
