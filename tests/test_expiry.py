"""Entries with a time to live: stream, batch and a plain version agree."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import expiry

START = datetime(2024, 5, 1)
EVENTS = "key string, at timestamp, id long, kind string"


def plain(events, ttl, until):
    out, open_ = [], {}

    def end(key, at, reason):
        entry, put, reads = open_.pop(key)
        if at < until:
            out.append((key, entry, put, at, reason, reads))

    for key, at, number, kind in sorted(events, key=lambda e: (e[1], e[2])):
        if key in open_ and at >= open_[key][1] + ttl:
            end(key, open_[key][1] + ttl, "EXPIRED")
        if key in open_ and kind != "GET":
            end(key, at, "REPLACED" if kind == "PUT" else "EVICTED")
        if kind == "PUT":
            open_[key] = [number, at, 0]
        elif key in open_:
            open_[key][2] += 1
    for key in list(open_):
        end(key, open_[key][1] + ttl, "EXPIRED")
    return sorted(out)


def made(n=400):
    rng = random.Random(1)
    return [(f"k{rng.randrange(8) if rng.random() < 0.6 else 0}", START + timedelta(seconds=rng.randrange(4000)), i, rng.choice(["PUT", "PUT", "GET", "GET", "EVICT"])) for i in range(n)]


def test_stream_and_batch_agree_at_the_watermark(spark, tmp_path):
    events = made()
    late = sorted(events, key=lambda e: (e[1] + timedelta(seconds=random.Random(e[2]).randrange(250)), e[2]))  # at most 250 seconds late
    source = f"file://{tmp_path}/in"
    for at in range(0, len(late), 80):
        spark.createDataFrame(late[at : at + 80], EVENTS).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    ended = expiry.lifetimes(rows, 120, "300 seconds")
    for _ in range(2):  # a restart finds nothing new
        ended.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    until = max(e[1] for e in events) - timedelta(seconds=300)
    wanted = plain(events, timedelta(seconds=120), until)
    assert len(wanted) > 100 and {r[4] for r in wanted} == {"EXPIRED", "REPLACED", "EVICTED"}
    assert sorted(map(tuple, spark.read.schema(expiry.ENDED).parquet(f"file://{tmp_path}/out").collect())) == wanted
    batch = expiry.lifetimes_until(spark.createDataFrame(events, EVENTS), 120, F.lit(until))
    assert sorted(map(tuple, batch.collect())) == wanted


def test_batch_edges(spark):
    t = lambda s: START + timedelta(seconds=s)
    events = [("a", t(0), 1, "PUT"), ("a", t(10), 2, "GET"), ("a", t(10), 3, "PUT"), ("a", t(20), 4, "GET"), ("b", t(0), 5, "EVICT"), ("b", t(1), 6, "GET"), (None, t(0), 7, "PUT"), ("c", None, 8, "PUT"), ("d", t(3), 9, "PUT"), ("d", t(3), 10, "EVICT")]
    found = expiry.lifetimes_until(spark.createDataFrame(events, EVENTS), 10, F.lit(t(100)))
    assert sorted(map(tuple, found.collect())) == plain([e for e in events if e[0] and e[1]], timedelta(seconds=10), t(100))
    assert expiry.lifetimes_until(spark.createDataFrame([], EVENTS), 10, F.lit(t(100))).count() == 0
