"""Streaming forms: windowed event statistics with watermarks, verdicts joined to requests, phases of a log in order, and a breaker per domain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.resilience import Breaker

PHASES = "slice timestamp, position long, ts timestamp, phase string"
BREAKER_STATE = "state string, failed int, succeeded int, last_failure double"


def windowed_stats(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counters and bytes per event-time window; events later than ``late`` are left out."""
    is_ = lambda k: F.col("event_type") == k
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size))
        .agg(F.count_if(is_("download_started")).alias("started"), F.count_if(is_("download_completed")).alias("completed"), F.count_if(is_("download_failed")).alias("failed"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
        .select(F.col("window.start").alias("start"), "started", "completed", "failed", "bytes")
    )


def verdict_stream(requests: DataFrame, verdicts: DataFrame, ttl_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(request_id, hostname, ts, cached_verdict): the streaming form of ``resilience.dns_as_of``.

    Streams of requests (request_id, hostname, ts timestamp) and verdicts
    (hostname, checked_at timestamp, verdict_id, allowed).  Both are kept in
    one state by host and window of two TTLs: a request in the window whose
    second half it is in, a verdict in both of its windows.  A window ends when
    the watermark (of the slower stream) passes; then each of its requests
    seeks its verdict in the sorted ones, so no pairs are made.  A request is
    given once, when no verdict of its time can arrive any more; equal requests
    are one, of verdicts of one time the largest number counts, and a request
    without a time is never given.  One host's window is one row of state, so
    the TTL bounds what a row holds.
    """
    asks = requests.withWatermark("ts", late).filter("ts IS NOT NULL").select("hostname", "ts", F.struct("ts", "request_id").alias("request"))
    # A host without a name has requests, but no verdicts.
    known = verdicts.withWatermark("checked_at", late).filter("checked_at IS NOT NULL AND hostname IS NOT NULL").select("hostname", F.col("checked_at").alias("ts"), F.struct("checked_at", "verdict_id", "allowed").alias("verdict"))
    rows = asks.unionByName(known, allowMissingColumns=True).withColumn("window", F.window("ts", f"{2 * ttl_seconds} seconds", f"{ttl_seconds} seconds"))
    ttl = F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    kept = rows.filter(F.col("verdict").isNotNull() | (F.col("ts") >= F.col("window.start") + ttl))
    closed = kept.groupBy("window", "hostname").agg(F.collect_list("request").alias("requests"), F.collect_list("verdict").alias("verdicts")).filter(F.size("requests") > 0)
    ordered = closed.select("hostname", F.array_sort("requests").alias("requests"), F.array_sort("verdicts").alias("verdicts"))
    halves = F.sequence(F.floor(F.log2(F.size("verdicts"))).cast("int"), F.lit(0), F.lit(-1))

    def earlier(t):
        """How many verdicts are not later than ``t``, by halving."""
        return F.aggregate(halves, F.lit(0), lambda n, k: n + F.when(F.get("verdicts", n + F.pow(F.lit(2), k).cast("int") - 1)["checked_at"] <= t, F.pow(F.lit(2), k).cast("int")).otherwise(0))

    once = F.filter("requests", lambda r, i: ~r.eqNullSafe(F.get("requests", i - 1)))
    found = ordered.select("hostname", F.explode(F.transform(once, lambda r: F.struct(r.alias("request"), F.get("verdicts", earlier(r["ts"]) - 1).alias("last")))).alias("found"))
    ts, last = F.col("found.request.ts"), F.col("found.last")
    return found.select("found.request.request_id", "hostname", ts.alias("ts"), F.when(last["checked_at"] > ts - ttl, last["allowed"]).alias("cached_verdict"))


class PhaseSlice(StatefulProcessor):
    """Keeps the phases of one slice of time with counts and gives them in order when the slice's timer fires."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "ts timestamp, phase string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + self.seconds * 1000)
        for frame in rows:
            # Equal rows of a batch are one entry.
            counted = frame.groupby(["ts", "phase"], dropna=False, sort=False).size()
            self.seen.appendList([(t.to_pydatetime(), None if pd.isna(p) else p, int(n)) for (t, p), n in counted.items()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = pd.DataFrame(list(self.seen.get()), columns=["ts", "phase", "n"])
        self.seen.clear()
        rows = seen.sort_values(["ts", "phase"], na_position="first", kind="stable")
        rows = rows.loc[rows.index.repeat(rows["n"])]
        yield pd.DataFrame({"slice": pd.Series([key[0]] * len(rows), dtype="datetime64[us]"), "position": range(len(rows)), "ts": rows["ts"].to_numpy(), "phase": rows["phase"].to_numpy()})

    def close(self) -> None:
        pass


def phase_stream(events: DataFrame, slice_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(slice, position, ts, phase): the streaming form of ``accounting.completed_phases``.

    Completed phases of a stream (event_type, ts timestamp, phase), in order of
    time and name within each slice of time and counted from 0 there (a null
    name first).  A slice is given once, when the watermark passes its end; it
    is one key, so ``slice_seconds`` bounds what one task keeps.  Rows without
    a time are left out.  Needs the RocksDB state store.
    """
    size = f"{slice_seconds} seconds"
    rows = events.withWatermark("ts", late).filter("event_type = 'phase_completed' AND ts IS NOT NULL").select(F.window("ts", size)["start"].alias("slice"), "ts", "phase")
    return rows.groupBy("slice").transformWithStateInPandas(PhaseSlice(slice_seconds), PHASES, "Append", "EventTime")


def breaker_stream(log: DataFrame, failures: int = 5, timeout: float = 60.0, successes: int = 2) -> DataFrame:
    """(request_id, domain, ts, ok, executed, state) of a stream (request_id long, domain string, ts timestamp, ok boolean).

    A domain's breaker is four numbers of keyed state; within a batch its requests are folded in time order.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(failures, timeout, successes)
        if state.exists:
            breaker.state, breaker.failed, breaker.succeeded, breaker.last_failure = state.get
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        executed, states = [], []
        for t, ok in zip(rows["ts"], rows["ok"]):
            executed.append(breaker.offer(t.timestamp(), bool(ok)))
            states.append(breaker.state)
        state.update((breaker.state, breaker.failed, breaker.succeeded, breaker.last_failure))
        yield rows.assign(executed=executed, state=states)[["request_id", "domain", "ts", "ok", "executed", "state"]]

    return log.select("request_id", "domain", "ts", "ok").groupBy("domain").applyInPandasWithState(
        step, "request_id long, domain string, ts timestamp, ok boolean, executed boolean, state string", BREAKER_STATE, "append", GroupStateTimeout.NoTimeout
    )


def log_sink(stream: DataFrame, path: str, checkpoint: str):
    """A started query that appends the stream as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
