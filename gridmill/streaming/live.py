"""Live readings as JSON messages: a paced source, a landing table with a ledger, windows and rollups."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebucket import ZONE, iso_with_offset, utc_of_iso
from ..sources.readings import READINGS
from ..sources.scratch import remove
from .transport import FORMAT, GIVEN, Log, register

FIELDS = [x.split()[0] for x in READINGS.split(", ")]
TOPIC = "energy/meters"


def to_messages(readings: DataFrame, zone: str = ZONE, id_: Column | None = None) -> DataFrame:
    """(id, sent, topic, payload) of each reading; times are ISO-8601 in the zone, with its offset and microseconds.

    A message is sent when its reading was received.  Without ``id_``, ids are digests of topic, payload and the row's place, which is enough where the
    rows are published once.
    """
    fields = [iso_with_offset(F.col(c), zone).alias(c) if c.endswith("_time") else F.col(c) for c in FIELDS]
    topic, payload = F.concat(F.lit(f"{TOPIC}/"), F.col("meter_id").cast("string")), F.to_json(F.struct(*fields))
    own = id_ if id_ is not None else F.md5(F.concat(topic, payload, F.monotonically_increasing_id().cast("string")).cast("binary"))
    return readings.select(own.cast("string").alias("id"), F.col("received_time").cast("timestamp").alias("sent"), topic.alias("topic"), payload.alias("payload"))


def publish(messages: DataFrame, path: str) -> None:
    """Append messages (id, sent, topic, payload) to the log at ``path``; they become visible together."""
    register(messages.sparkSession)
    messages.select(*GIVEN).write.format(FORMAT).option("path", path).mode("append").save()


def sent(spark: SparkSession, path: str, pattern: str = f"{TOPIC}/#") -> DataFrame:
    """The messages of the log whose topic matches ``pattern``."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load().where(topic_matches(F.col("topic"), pattern))


def topic_matches(topic: Column, pattern: str) -> Column:
    """Does a topic match a filter?  ``+`` stands for one level, ``#`` at the end for all that follow."""
    levels = ["[^/]+" if x == "+" else "" if x == "#" else re.escape(x) for x in pattern.split("/")]
    body = "/".join(levels[:-1]) + "(/.*)?" if pattern.endswith("/#") else ".*" if pattern == "#" else "/".join(levels)
    return topic.rlike(f"^{body}$")


def messages(spark: SparkSession, path: str, group: str, pattern: str = f"{TOPIC}/#", max_messages: int = 0, rate: float = 0, ack: str = "commit") -> DataFrame:
    """A stream of the messages whose topic matches ``pattern``, at most so many a micro-batch and so many a second; for ``land``, ``ack`` is "sink"."""
    register(spark)
    stream = spark.readStream.format(FORMAT).options(path=path, group=group, max_messages=str(max_messages), rate=str(rate), ack=ack).load()
    return stream.where(topic_matches(F.col("topic"), pattern))


def truncate(spark: SparkSession, *paths: str) -> None:
    """Empty landing tables, ledgers and checkpoints before a run."""
    for path in paths:
        remove(spark, path)


def parsed(raw: DataFrame) -> DataFrame:
    """Payloads to readings; ``ok`` is false for malformed JSON and for a missing key.  Other columns stay.

    The fields come out of an array of one: a filter on them isn't pushed below, where every field that it names would parse the payload again.
    """
    one = lambda c, name: F.explode(F.array(c)).alias(name)
    r = F.from_json("payload", READINGS.replace("timestamp_ntz", "string"), {"mode": "PERMISSIVE"})
    df = raw.select(*raw.columns, one(r, "_r"))
    times = [utc_of_iso(F.col(f"_r.{c}")).alias(c) if c.endswith("_time") else F.col(f"_r.{c}").alias(c) for c in FIELDS]
    read = df.select(*raw.columns, one(F.struct(F.col("_r").isNotNull().alias("_read"), *times), "_f")).select(*raw.columns, "_f.*")
    ok = F.col("_read")
    for c in FIELDS:
        ok = ok & F.col(c).isNotNull()
    return read.select(*raw.columns, *FIELDS, ok.alias("ok"))


#: How messages are kept apart: by the time they were sent, in slots, and by a hash of the id.  A micro-batch should meet some hundred keys or more of many
#: messages each: many keys of few messages cost a call of Python each, few keys of many messages a large state that is written again.
SLOT_SECONDS, ID_BUCKETS = 3600, 64
#: The most messages that a key should meet in a micro-batch: a Python worker holds a key's messages and state at once.
KEY_MESSAGES = 2000


def id_buckets(messages: int, least: int = 16) -> int:
    """Buckets of ids for micro-batches of so many messages, so that what a key holds doesn't grow with them; those of a checkpoint stay as they are."""
    return max(least, -(-messages // KEY_MESSAGES))


def deliveries(stream: DataFrame, ttl_seconds: int = 3 * 3600, slot_seconds: int = SLOT_SECONDS, buckets: int = ID_BUCKETS) -> DataFrame:
    """``stream`` with ``delivery``: 1 for a message's first delivery, 2 and more for those after it, whatever micro-batches they come in.

    The state of a key, a slot of the sending time and a bucket of ids, is the ids it has seen and how often.  A message that is delivered again has the same
    id and sending time, so only slots that messages still come for are touched, and a key that none has come for in ``ttl_seconds`` is dropped; a delivery after
    that counts as first.  No message is dropped, however late.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = stream.columns

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("offset", kind="stable")
        seen = rows["id"].map(lambda x: held.get(x, 0)) + rows.groupby("id").cumcount() + 1
        held.update(zip(rows["id"], seen.astype(int)))  # of an id's deliveries the last stays
        state.update((list(held), [int(x) for x in held.values()]))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield rows[names].assign(delivery=seen.astype("int64"))

    keyed = stream.withColumns({"_slot": F.floor(F.unix_seconds("sent") / slot_seconds), "_bucket": F.pmod(F.xxhash64("id"), F.lit(buckets))})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return keyed.groupBy("_slot", "_bucket").applyInPandasWithState(run, f"{fields}, delivery long", "ids array<string>, counts array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout)


COUNTS = ("received", "inserted", "parse_errors", "redelivered")
LEDGER = ", ".join(f"{c} long" for c in COUNTS)


def land(delivered: DataFrame, into: str, bad: str, ledger: str, checkpoint: str, log: str, group: str, trigger: dict | None = None):
    """Append good rows of ``deliveries`` to ``into`` and bad payloads to ``bad``, with one ledger row a micro-batch; then acknowledge.

    Further deliveries are kept, with their number.  Each micro-batch writes folders of its own number, so one that is done again replaces what it wrote, and the state
    it counts deliveries by is that of its checkpoint: a restart changes no count.  A message is acknowledged when its ledger row is there.
    """

    def batch(df: DataFrame, number: int) -> None:
        p = parsed(df).persist()
        n = lambda when: F.count_if(when)
        facts = p.agg(F.count(F.lit(1)), n(F.col("ok")), n(~F.col("ok")), n(F.col("delivery") > 1), F.max("offset")).first()
        if facts[0]:
            p.where("ok").select(*FIELDS, "delivery").write.mode("overwrite").parquet(f"{into}/batch={number}")
            p.where("NOT ok").select("payload").write.mode("overwrite").parquet(f"{bad}/batch={number}")
            df.sparkSession.createDataFrame([tuple(facts[:4])], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
            Log(log).move(group, acked=facts[4] + 1)
        p.unpersist()

    return delivered.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def until_idle(query, log: str, group: str, idle_seconds: float = 15, expected: int | None = None) -> int:
    """Wait until the group has acknowledged ``expected`` messages, or none for ``idle_seconds``; then stop the query.  Returns the messages acknowledged."""
    told, since, place = Log(log), time.monotonic(), -1
    while query.isActive:
        now = told.group(group)["acked"]
        if now != place:
            place, since = now, time.monotonic()
        if (expected is not None and now >= expected) or time.monotonic() - since > idle_seconds:
            query.stop()
        time.sleep(0.1)
    if query.exception() is not None:
        raise query.exception()
    return told.group(group)["acked"]


def totals(spark: SparkSession, ledger: str, log: str, group: str, pattern: str = f"{TOPIC}/#") -> DataFrame:
    """Sums of the ledger beside what the log tells: ``taken`` from the publishers, ``acked`` by the group, and the ``backlog`` that isn't.

    The two are counted apart: a message that was acknowledged and not landed shows as acked over received.
    """
    found = spark.read.schema(LEDGER).parquet(f"{ledger}/*").agg(*[F.sum(c).alias(c) for c in COUNTS])
    done = F.col("offset") < Log(log).group(group)["acked"]
    counts = sent(spark, log, pattern).agg(F.count(F.lit(1)).alias("taken"), F.count_if(done).alias("acked"), F.count_if(~done).alias("backlog"))
    return found.crossJoin(counts)


def _timed(readings: DataFrame, late: str) -> DataFrame:
    """``readings`` with a watermark on ``_t``, the event time; zone-less times are taken as the session's, as watermarks need a TIMESTAMP.

    Messages that carry an id count once, however often they were delivered.
    """
    t = readings.withColumn("_t", F.col("event_time").cast("timestamp")).withWatermark("_t", late)
    if "id" not in readings.columns:
        return t
    return t.dropDuplicatesWithinWatermark(["id"]) if t.isStreaming else t.dropDuplicates(["id"])


LATE = "180 minutes"


def windowed(readings: DataFrame, width: str = "15 minutes", late: str = LATE, slide: str | None = None) -> DataFrame:
    """Energy by event-time window, tumbling or sliding; the watermark accepts every delay that the data model allows.

    In append mode a window is given out once, when the watermark has passed its end, and its state goes.
    """
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    g = _timed(readings, late).groupBy(w).agg(F.sum("energy_kwh").alias("energy_kwh"), F.count(F.lit(1)).alias("reading_count"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "energy_kwh", "reading_count")


def deduplicated(readings: DataFrame, late: str = LATE) -> DataFrame:
    """One row for each (meter, time) within the watermark."""
    t = readings.withColumn("_t", F.col("event_time").cast("timestamp")).withWatermark("_t", late)
    return t.dropDuplicatesWithinWatermark(["meter_id", "_t"]).drop("_t")


def sessions(readings: DataFrame, gap: str = "1 hour", late: str = LATE) -> DataFrame:
    """Runs of a meter's readings without a longer gap; in append mode each once, when the watermark has passed its end."""
    g = _timed(readings, late).groupBy("meter_id", F.session_window("_t", gap).alias("s")).agg(F.count(F.lit(1)).alias("reading_count"))
    return g.select("meter_id", F.col("s.start").cast("timestamp_ntz").alias("first_event"), F.col("s.end").cast("timestamp_ntz").alias("closed"), "reading_count")


#: The event time of a closing message; no reading is as late.
END = "9999-01-01 00:00:00"


def close(spark: SparkSession, path: str) -> None:
    """Publish the end of all readings to the log at ``path``: one message that moves a watermark past every window and session but its own, which stays open.

    A stream must read it in a later micro-batch than the readings, so it has a log of its own and is published when they have been read.
    """
    end = F.lit(END).cast("timestamp_ntz")
    one = spark.range(1).select(*[(end if c.endswith("_time") else F.lit(0).cast(kind)).alias(c) for c, kind in (x.split() for x in READINGS.split(", "))])
    publish(to_messages(one, id_=F.lit("end")), path)


def run_all(stream: DataFrame, out: str, checkpoint: str, last: Callable[[], None] | None = None):
    """Append what ``stream`` gives to the folder ``out`` until all that is there now has been read, and then what comes by ``last``; returns the stopped query."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    if last is not None:
        last()
        q.processAllAvailable()
    q.stop()
    return q
