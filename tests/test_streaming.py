"""The message log, the landing with its ledger, and windows that end."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridmill.streaming import live, transport
from test_meters import SHORT, T, frame, reading

MESSAGE = "id string, sent timestamp, topic string, payload string"


def numbered(spark, low, high, topic="energy/meters/1"):
    return spark.range(low, high).select(
        F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.timestamp_seconds(F.col("id") * 60).alias("sent"), F.lit(topic).alias("topic"), F.col("id").cast("string").alias("payload")
    )


def test_log_keeps_order_and_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transport, "ROW_GROUP", 16)
    path = str(tmp_path / "log")
    live.publish(numbered(spark, 0, 100).repartitionByRange(3, "id").sortWithinPartitions("id"), path)
    live.publish(numbered(spark, 100, 130).coalesce(1), path)
    live.publish(numbered(spark, 0, 0), path)
    rows = sorted(live.sent(spark, path, "#").collect(), key=lambda r: r.offset)
    assert [r.offset for r in rows] == list(range(130)) and [int(r.payload) for r in rows] == list(range(130))
    log = transport.Log(path)
    assert log.refresh() == 130 and len(log.entries) == 2
    parts = log.slices(30, 120, 7)
    assert sum(p.high - p.low for p in parts) == 90 and all(p.high - p.low <= 7 for p in parts)
    read = [(r["offset"], int(r["payload"])) for p in parts for batch in transport.Log(path).read(p) for r in batch.to_pylist()]
    assert sorted(read) == [(k, k) for k in range(30, 120)]


def test_publications_are_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "log")
    live.publish(numbered(spark, 0, 5), path)
    parts = [transport._segments(path, numbered(spark, 5, 9).toArrow().to_batches()) for _ in range(2)]
    assert transport.Log(path).refresh() == 5  # nothing names them yet
    writer = transport.StreamWriter(path, "p")
    writer.commit([parts[0], None], 3)
    writer.commit([parts[1]], 3)  # the micro-batch is done again
    assert transport.Log(path).refresh() == 9
    writer.abort([parts[1]], 4)
    transport.StreamWriter(path, "q").commit([parts[0]], 3)  # another publisher's
    assert transport.Log(path).refresh() == 13
    first, second = transport.Log(path), transport.Log(path)
    first.refresh(), second.refresh()
    assert first.publish("a", -1, [("x", 1)]) and second.publish("b", -1, [("y", 2)])  # both had seen the same end
    assert [x["publisher"] for x in third.entries[-2:]] == ["a", "b"] if (third := transport.Log(path)).refresh() else False
    with pytest.raises(Exception, match="appended"):
        numbered(spark, 0, 1).write.format(transport.FORMAT).option("path", path).mode("overwrite").save()


def test_stream_sink_through_a_restart(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "log")
    transport.register(spark)

    def run():
        s = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(src)
        s.writeStream.format(transport.FORMAT).option("path", path).option("publisher", "p").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    numbered(spark, 0, 40).repartition(2).write.parquet(src)
    run()
    numbered(spark, 40, 60).coalesce(1).write.mode("append").parquet(src)
    run()
    # The last micro-batch once more, as after a crash before its commit was noted.
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    run()
    assert sorted(int(r.payload) for r in live.sent(spark, path, "#").collect()) == list(range(60))


def test_stream_source_pace_and_redelivery(spark, tmp_path):
    path = str(tmp_path / "log")
    live.publish(numbered(spark, 0, 100).coalesce(1), path)

    def take(name, checkpoint, **options):
        s = live.messages(spark, path, "g", "#", **options)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        batches = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        return sorted(int(r.payload) for r in spark.read.schema(s.schema).parquet(str(tmp_path / name)).collect()), batches

    rows, batches = take("a", "c1", max_messages=30, ack="sink")
    assert rows == list(range(100)) and batches == [30, 30, 30, 10]
    live.publish(numbered(spark, 100, 120).coalesce(1), path)
    assert take("a", "c1", max_messages=30, ack="sink") == (list(range(120)), [20])  # goes on from its checkpoint
    log = transport.Log(path)
    assert log.group("g") == {"acked": 0, "handed": 120}
    log.move("g", acked=50)
    log.move("g", acked=20)  # never back
    assert take("b", "c2", max_messages=40)[0] == list(range(50, 120))  # a new stream of the group
    live.publish(numbered(spark, 120, 200).coalesce(1), path)
    assert take("b", "c2", max_messages=40) == (list(range(50, 200)), [40, 40])
    assert log.group("g")["acked"] >= 160  # what Spark has committed
    s = live.messages(spark, path, "slow", "#", rate=40)
    start = datetime.now()
    q = s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c3")).trigger(processingTime="0 seconds").start()
    while log.group("slow")["handed"] < 200 and q.isActive:
        q.awaitTermination(0.1)
    q.stop()
    assert (datetime.now() - start).total_seconds() >= 200 / 40


def topics(spark, tmp_path):
    """Readings with a legal copy, bad payloads, another topic, and messages that come again, one of them twice."""
    good = [reading(k % 7, str(T("2026-09-01") + timedelta(minutes=15 * k))) for k in range(60)]
    rows = frame(spark, [(f"r{k}", *x) for k, x in enumerate([*good, good[0]])], "key string, " + SHORT)
    m = live.to_messages(rows, id_=F.col("key"))
    bad = frame(spark, [("b1", T("2026-09-01"), "energy/meters/1", "{bad"), ("b2", T("2026-09-01"), "energy/meters/1", '{"meter_id": 5}'), ("b3", T("2026-09-01"), "energy/other", "{}")], MESSAGE)
    log = str(tmp_path / "log")
    live.publish(m.repartitionByRange(3, "sent").sortWithinPartitions("sent"), log)
    live.publish(bad.coalesce(1), log)
    live.publish(m.where("id IN ('r3', 'r4', 'r59')").coalesce(1), log)
    live.publish(m.where("id = 'r4'").coalesce(1), log)
    return log


#: received, inserted, parse_errors, redelivered, taken, acked, backlog
WANT = (67, 65, 2, 4, 67, 67, 0)


def landed(spark, log, tmp_path, group, stop_at=None, max_messages=0):
    place = lambda x: str(tmp_path / group / x)
    stream = live.deliveries(live.messages(spark, log, group, max_messages=max_messages, ack="sink"), buckets=4)
    q = live.land(stream, place("landed"), place("bad"), place("ledger"), place("ck"), log, group)
    got = live.until_idle(q, log, group, idle_seconds=60, expected=stop_at or transport.Log(log).refresh())
    return got, live.totals(spark, place("ledger"), log, group).first()


@pytest.mark.parametrize("max_messages", [0, 25, 7])
def test_ledger_is_the_same_for_any_pacing(spark, tmp_path, max_messages):
    log = topics(spark, tmp_path)
    _, told = landed(spark, log, tmp_path, "g", max_messages=max_messages)
    assert tuple(told) == WANT
    rows = spark.read.parquet(str(tmp_path / "g" / "landed"))
    assert rows.count() == 65 and {r.delivery: r["count"] for r in rows.groupBy("delivery").count().collect()} == {1: 61, 2: 3, 3: 1}
    assert spark.read.parquet(str(tmp_path / "g" / "bad")).count() == 2


def test_ledger_through_restarts(spark, tmp_path, monkeypatch):
    """The run is stopped in the middle, then fails between landing and acknowledgement; totals are those of a run in one go."""
    log = topics(spark, tmp_path)
    got, told = landed(spark, log, tmp_path, "g", stop_at=18, max_messages=9)
    assert 18 <= got < 68 and told.taken == 67 and told.backlog == 67 - told.acked > 0
    move = transport.Log.move

    def broken(self, name, **to):
        if to.get("acked", 0) > 60:
            raise RuntimeError("lost before the acknowledgement")
        move(self, name, **to)

    monkeypatch.setattr(transport.Log, "move", broken)
    with pytest.raises(Exception, match="lost before"):
        landed(spark, log, tmp_path, "g", max_messages=9)
    assert transport.Log(log).group("g")["acked"] <= 60
    monkeypatch.undo()
    assert tuple(landed(spark, log, tmp_path, "g", max_messages=9)[1]) == WANT
    assert spark.read.parquet(str(tmp_path / "g" / "landed")).count() == 65


def test_a_lost_landing_shows(spark, tmp_path):
    log = topics(spark, tmp_path)
    transport.Log(log).move("g", acked=10)  # acknowledged by someone who landed nothing
    told = landed(spark, log, tmp_path, "g")[1]
    assert told.acked == told.taken == 67 and told.received == 57


def test_state_of_ids_is_dropped_after_its_time(spark, tmp_path):
    path = str(tmp_path / "log")
    live.publish(numbered(spark, 0, 20).coalesce(1), path)
    s = live.deliveries(live.messages(spark, path, "g", "#"), ttl_seconds=2, buckets=2)
    q = s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    kept = lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else 0
    most, until = 0, datetime.now() + timedelta(seconds=60)
    while datetime.now() < until and not (most and not kept()):
        most = max(most, kept())
        q.awaitTermination(0.2)
    q.stop()
    assert most > 0 and kept() == 0


def hours(spark, tmp_path, n=40):
    rows = [reading(k % 2, str(T("2026-09-01") + timedelta(minutes=30 * k)), float(k % 5)) for k in range(2 * n)]
    log = str(tmp_path / "log")
    live.publish(live.to_messages(frame(spark, rows, SHORT).coalesce(1)), log)
    return log


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_windows_end(spark, tmp_path, kind):
    """Each window once, when the watermark passes its end, and its state goes; equal to the batch result for what has ended."""
    log = hours(spark, tmp_path)
    stream = live.parsed(live.messages(spark, log, "g", max_messages=10)).where("ok").select("id", *live.FIELDS)
    build = {"tumbling": lambda x: live.windowed(x, "1 hour"), "sliding": lambda x: live.windowed(x, "2 hours", slide="1 hour"), "session": lambda x: live.sessions(x, "40 minutes")}[kind]
    q = live.run_all(build(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = live.parsed(live.sent(spark, log)).where("ok").select("id", *live.FIELDS)
    mark = T("2026-09-01") + timedelta(minutes=30 * 79 - 180)
    end = {"tumbling": lambda r: r.bucket + timedelta(hours=1), "sliding": lambda r: r.bucket + timedelta(hours=2), "session": lambda r: r.closed}[kind]
    want = sorted(tuple(r) for r in build(batch).collect() if end(r) <= mark)
    assert got == want and len(want) > 20
    state = [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(state) <= 60  # of 80 ids and as many windows or sessions
    assert sum(x["numRowsRemoved"] for p in q.recentProgress for x in p["stateOperators"]) > 0


def test_a_closing_message_ends_all_sessions(spark, tmp_path):
    """With it a stream in append mode gives out every session, those that the watermark had not passed too."""
    log, ends = hours(spark, tmp_path), str(tmp_path / "ends")
    read = lambda path: live.parsed(live.messages(spark, path, "g", max_messages=10)).where("ok").select("id", *live.FIELDS)
    stream = live.sessions(read(log).unionByName(read(ends)), "40 minutes")
    live.run_all(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda: live.close(spark, ends))
    batch = live.parsed(live.sent(spark, log)).where("ok").select("id", *live.FIELDS)
    want = sorted(map(tuple, live.sessions(batch, "40 minutes").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and len(want) == 80


def test_keys_do_not_grow_with_the_log(spark, tmp_path, monkeypatch):
    """The messages that a key meets in a micro-batch, and with them what a Python worker holds, are bounded."""
    monkeypatch.setattr(live, "KEY_MESSAGES", 50)
    assert live.id_buckets(100) == 16 and live.id_buckets(10_000) == 200
    for n in (2000, 20_000):
        m = numbered(spark, 0, n).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(live.id_buckets(n))))
        assert m.groupBy("_b").count().agg(F.max("count")).first()[0] <= 2 * max(50, n / 16)


def test_a_payload_is_parsed_once(spark):
    """A filter on the parsed fields doesn't parse the payload again for each of them."""
    raw = spark.createDataFrame([("a", "{}")], "id string, payload string")
    plan = live.parsed(raw).where("ok").select("id", "event_time", "energy_kwh")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
