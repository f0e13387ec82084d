"""Entries that live for a time: cached answers, pending questions, leases. As a stream with timers, and as one batch.

Events of a key are PUT (a new entry, in place of an old one), GET (a read) and EVICT. An entry ends when it is replaced or
evicted, or once ``ttl`` has passed; an event at that very moment finds it expired. Each ended entry gives one row. Events
may come late within the watermark's delay: they wait in the key's state and are played in order of time (then of id) when
the watermark has passed them, so the stream gives what the batch gives up to the watermark, however it was cut into
micro-batches. A key's state is its open entry and what waits; it goes when both are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ENDED = "key string, entry_id long, put_at timestamp, ended_at timestamp, reason string, reads long"
STATE = "entry_id long, entry_at long, reads long, ats array<long>, ids array<long>, kinds array<string>"


def lifetimes(events: DataFrame, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of ended entries (key, entry_id, put_at, ended_at, reason, reads) from a stream of events (key, at, id, kind)."""
    ttl = ttl_seconds * 1_000_000

    def play(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entry, waiting = None, []
        if state.exists:
            entry_id, entry_at, reads, ats, ids, kinds = state.get
            entry = None if entry_id is None else [entry_id, entry_at, reads]
            waiting = list(zip(ats, ids, kinds, strict=True))
        for frame in frames:
            waiting += zip((frame["at"].astype("datetime64[us]").astype("int64")).tolist(), frame["id"].tolist(), frame["kind"].tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs() * 1000, []

        def ended(at: int, reason: str) -> None:
            nonlocal entry
            out.append((key[0], entry[0], entry[1], at, reason, entry[2]))
            entry = None

        waiting.sort()
        ready = [e for e in waiting if e[0] < passed]
        waiting = waiting[len(ready) :]
        for at, number, kind in ready:
            if entry and at >= entry[1] + ttl:
                ended(entry[1] + ttl, "EXPIRED")
            if entry and kind != "GET":
                ended(at, "REPLACED" if kind == "PUT" else "EVICTED")
            if kind == "PUT":
                entry = [number, at, 0]
            elif entry:
                entry[2] += 1
        if entry and entry[1] + ttl < passed:
            ended(entry[1] + ttl, "EXPIRED")
        times = [e[0] for e in waiting[:1]] + ([entry[1] + ttl] if entry else [])
        if times:
            e = entry or [None, None, None]
            state.update((*e, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            state.setTimeoutTimestamp(max(min(times) // 1000, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            rows = pd.DataFrame(out, columns=["key", "entry_id", "put_at", "ended_at", "reason", "reads"])
            for c in ("put_at", "ended_at"):
                rows[c] = pd.to_datetime(rows[c], unit="us")
            yield rows

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), "kind").where("key is not null and at is not null")
    return rows.withWatermark("at", delay).groupBy("key").applyInPandasWithState(play, ENDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def lifetimes_until(events: DataFrame, ttl_seconds: int, until) -> DataFrame:
    """The same rows from a table of events: the entries that ended before ``until`` (a column)."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), "kind").where("key is not null and at is not null")
    w = Window.partitionBy("key").orderBy("at", "id")
    changes = F.when(F.col("kind") != "GET", F.struct("at", "kind"))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("next", F.first(changes, ignorenulls=True).over(after)).withColumn("entry", F.sum((F.col("kind") != "GET").cast("long")).over(w))
    puts = rows.where("kind = 'PUT'").withColumn("expiry", F.col("at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    cut_short = F.col("next").isNotNull() & (F.col("next.at") < F.col("expiry"))
    puts = puts.select("key", "entry", F.col("id").alias("entry_id"), F.col("at").alias("put_at"), "expiry", F.when(cut_short, F.col("next.at")).otherwise(F.col("expiry")).alias("ended_at"), F.when(~cut_short, "EXPIRED").when(F.col("next.kind") == "PUT", "REPLACED").otherwise("EVICTED").alias("reason"))
    gets = rows.where("kind = 'GET'").select("key", "entry", F.col("at").alias("read_at"))
    reads = puts.join(gets, ["key", "entry"]).where(F.col("read_at") < F.col("expiry")).groupBy("key", "entry").agg(F.count("*").alias("reads"))
    out = puts.join(reads, ["key", "entry"], "left").where(F.col("ended_at") < until)
    return out.select("key", "entry_id", "put_at", "ended_at", "reason", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))
