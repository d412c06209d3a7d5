"""The data model, its stand-in over the event tables, and readers and writers for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Table

READINGS = (
    "meter_id bigint, event_time timestamp_ntz, received_time timestamp_ntz, power_kw double, "
    "voltage_v double, current_a double, frequency_hz double, energy_kwh double"
)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"
VALUES = ["received_time", "power_kw", "voltage_v", "current_a", "frequency_hz", "energy_kwh"]
METERS = "meter_id bigint, region string, customer_type string, base_power_kw double, power_factor double"
#: Fixed values of the data model.
INTERVAL_HOURS = 0.25
POWER_FACTOR = 0.95
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def region_of(meter: Column) -> Column:
    return F.concat(F.lit("Region "), (meter % 10 + 1).cast("string"))


def type_of(meter: Column) -> Column:
    return F.when(meter % 20 < 13, "residential").when(meter % 20 < 18, "commercial").otherwise("industrial")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table; its schema is declared, so no job has to look for it."""
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean readings from ``events``: a user is a meter, a value its power."""
    e = events(spark, sf_dir)
    minutes = F.when(F.col("event_id") % 50 == 0, 30 + F.col("event_id") % 151).otherwise(15).cast("int")
    voltage = 226.0 + (F.col("event_id") % 8)
    return e.select(
        F.col("user_id").alias("meter_id"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("received_time"),
        F.col("value").alias("power_kw"),
        voltage.alias("voltage_v"),
        (F.col("value") * 1000 / (voltage * POWER_FACTOR)).alias("current_a"),
        (49.95 + (F.col("event_id") % 10) / 100).alias("frequency_hz"),
        (F.col("value") * INTERVAL_HOURS).alias("energy_kwh"),
        "event_id",
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they arrive: with exact copies and with conflicting versions."""
    r = readings(spark, sf_dir)
    copies = r.where("event_id % 200 = 0")
    conflicts = r.where("event_id % 500 = 1").withColumn("power_kw", F.col("power_kw") + 1)
    return r.unionByName(copies).unionByName(conflicts)


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ids = e.select(F.col("user_id").alias("meter_id")).distinct()
    m = F.col("meter_id")
    return ids.select(m, region_of(m).alias("region"), type_of(m).alias("customer_type"), (m % 7 + 0.5).alias("base_power_kw"), F.lit(POWER_FACTOR).alias("power_factor"))


def labelled_events(known: DataFrame) -> DataFrame:
    """One labelled day for every fourth of the ``known`` meters."""
    m = known.where("meter_id % 4 = 0").select("meter_id")
    start = F.timestamp_add("DAY", (F.col("meter_id") % 28).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    kind = F.when(F.col("meter_id") % 8 == 0, "demand_spike").otherwise("unusual_drop")
    return m.select("meter_id", start.alias("start_time"), F.timestamp_add("DAY", F.lit(1), start).alias("end_time"), kind.alias("event_type"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("timestampNTZFormat", CSV_TIME.replace("[", "").replace("]", "")).csv(path, header=True)


def load_csv(spark: SparkSession, path: str, into: str, schema: str = READINGS) -> int:
    """Bulk load with a declared schema; refuses a target that exists.  Returns the rows loaded."""
    spark.read.schema(schema).option("timestampNTZFormat", CSV_TIME).csv(path, header=True, mode="FAILFAST").write.mode("errorifexists").parquet(into)
    return spark.read.parquet(into).count()


def recount(spark: SparkSession, path: str) -> int:
    """Data rows of CSV files, counted from their lines without parsing."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"))
    n, files = lines.agg(F.count(F.lit(1)), F.countDistinct("f")).first()
    return n - files


def reconciled(spark: SparkSession, csv: str, table: str, contract: int) -> DataFrame:
    """One row: lines of the files, rows read from them, rows of the loaded table, the contract, and whether all four agree."""
    lines = spark.read.text(csv).select(F.col("_metadata.file_path").alias("f")).agg((F.count(F.lit(1)) - F.countDistinct("f")).alias("file_rows"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    read = one(spark.read.schema(READINGS).option("timestampNTZFormat", CSV_TIME).csv(csv, header=True), "read_rows")
    all_ = lines.crossJoin(read).crossJoin(one(spark.read.parquet(table), "table_rows")).withColumn("contract_rows", F.lit(contract).cast("long"))
    n = F.col("file_rows")
    return all_.withColumn("agrees", (n == F.col("read_rows")) & (n == F.col("table_rows")) & (n == F.col("contract_rows")))


def delete_copies(spark: SparkSession, path: str, clean) -> int:
    """Replace the versioned table by ``clean`` of it, in one step; returns the rows that went.  Doing it again changes nothing."""
    table = Table(spark, path)
    now = table.pointer()
    old = table.read(told=now[1])
    staged = table.stage(clean(old))
    gone = old.count() - spark.read.parquet(f"{path}/data/ver={staged['version']}").count()
    if gone:
        table.point(staged, after=now)
    return gone


def upsert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it lacks, one for each key."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing, keys, "left_anti"))


def storage(spark: SparkSession, path: str) -> DataFrame:
    """(partition, files, bytes) of a stored table, from the file listing; of a versioned table, what its pointer names."""
    live = Table(spark, path).folders() or [path]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(live).select("path", "length")
    part = F.regexp_extract("path", r"/([^/=]+=[^/]+)/[^/]+$", 1)
    return files.groupBy(part.alias("partition")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
