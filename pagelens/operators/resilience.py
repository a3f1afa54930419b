"""Replays of request logs: circuit breaker, rate limits, alternates.

The breaker and the exact limiter are state machines: each key's requests are
folded in time order.  A key's state is a few numbers, so a task streams its
rows through ``mapInPandas`` after a sort by key and time; no group is held
in memory whatever its size.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass
class Breaker:
    """Closed until ``failures`` in a row; open for ``timeout`` seconds after the last; then half open until ``successes``."""

    failures: int = 5
    timeout: float = 60.0
    successes: int = 2
    state: str = CLOSED
    failed: int = 0
    succeeded: int = 0
    last_failure: float | None = None

    def offer(self, now: float, ok: bool) -> bool:
        """Whether the request is executed; its outcome counts only then."""
        if self.state == OPEN:
            if self.last_failure is None or now - self.last_failure < self.timeout:
                return False
            self.state = HALF_OPEN
        if ok:
            if self.state == HALF_OPEN:
                self.succeeded += 1
                if self.succeeded >= self.successes:
                    self.state, self.failed, self.succeeded = CLOSED, 0, 0
            else:
                self.failed = 0
            return True
        self.failed += 1
        self.last_failure = now
        if self.state == HALF_OPEN:
            self.state, self.succeeded = OPEN, 0
        elif self.failed >= self.failures:
            self.state = OPEN
        return True


def _by_key(log: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    return log.repartition(F.col(key)).sortWithinPartitions(key, *order)


def breaker_replay(log: DataFrame, key: str = "domain", failures: int = 5, timeout: float = 60.0, successes: int = 2) -> DataFrame:
    """(request_id, key, ts, ok, executed, state): the breaker's state after each request of its key."""

    def run(frames):
        current, breaker = None, None
        for f in frames:
            states, executed = [], []
            for k, t, ok in zip(f[key], f["t"], f["ok"]):
                if breaker is None or k != current:
                    current, breaker = k, Breaker(failures, timeout, successes)
                executed.append(breaker.offer(t, bool(ok)))
                states.append(breaker.state)
            yield f.assign(executed=executed, state=states)[["request_id", key, "ts", "ok", "executed", "state"]]

    kind = dict(log.dtypes)
    rows = _by_key(log.select("request_id", key, "ts", "ok", F.col("ts").cast("timestamp").cast("double").alias("t")), key, ("ts", "request_id"))
    return rows.mapInPandas(run, f"request_id {kind['request_id']}, {key} {kind[key]}, ts {kind['ts']}, ok boolean, executed boolean, state string")


def breaker_status(replay: DataFrame, key: str = "domain") -> DataFrame:
    """The last state of each key, and how many of its requests were rejected."""
    return replay.groupBy(key).agg(F.max_by("state", F.struct("ts", "request_id")).alias("state"), F.count_if(~F.col("executed")).alias("rejected"))


def trailing_rate(log: DataFrame, key: str = "domain", limit: int = 10, slice_seconds: int = 60) -> DataFrame:
    """Adds the requests of the key in the second up to each one, and whether they exceed ``limit``.

    A key's requests are divided into slices of time, so a frequent key is
    many groups; the last second of a slice is also read with the next one.
    """
    columns, length = log.columns, slice_seconds * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(t / F.lit(length)).cast("long")
    rows = log.select(F.struct(*columns).alias("row"), F.col(key).alias("k"), t.alias("t"), own.alias("own"))
    with_next = F.when(F.col("t") - F.col("own") * length > length - 1_000_000, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    rows = rows.withColumn("slice", F.explode(F.coalesce(with_next, F.array(F.lit(None).cast("long")))))
    w = W.partitionBy("k", "slice").orderBy("t").rangeBetween(-999_999, 0)
    counted = rows.withColumn("in_last_second", F.count("*").over(w)).filter(F.col("slice").eqNullSafe(F.col("own")))
    return counted.select("row.*", "in_last_second").withColumn("over_limit", F.col("in_last_second") > limit)


def limiter_schedule(log: DataFrame, key: str = "domain", per_second: int = 10, burst: int = 5) -> DataFrame:
    """(request_id, key, ts, wait): the seconds that a limiter with bursts would hold each request back.

    The burst allowance starts anew each second; beyond it, at most
    ``per_second`` requests start within any second.  Starts never go back, so
    those of the last second are the end of a queue, where equal ones are one
    entry with a count: a request costs the same whatever the backlog.
    """

    def run(frames):
        # Starts of the last second with their counts, oldest first, and how many they are.
        current, recent, n, used, reset, clock = None, deque(), 0, 0, None, 0.0
        for f in frames:
            waits = []
            for k, t in zip(f[key], f["t"]):
                if k != current or reset is None:
                    current, recent, n, used, reset, clock = k, deque(), 0, 0, t, t
                now = max(t, clock)
                if now - reset >= 1.0:
                    used, reset = 0, now
                while recent and not now - recent[0][0] < 1.0:
                    n -= recent.popleft()[1]
                start = now
                if used < burst:
                    used += 1
                elif n >= per_second:
                    start = max(now, recent[0][0] + 1.0)
                if recent and recent[-1][0] == start:
                    recent[-1][1] += 1
                else:
                    recent.append([start, 1])
                n += 1
                clock = start
                waits.append(start - t)
            yield f.assign(wait=waits)[["request_id", key, "ts", "wait"]]

    kind = dict(log.dtypes)
    rows = _by_key(log.select("request_id", key, "ts", F.col("ts").cast("timestamp").cast("double").alias("t")), key, ("ts", "request_id"))
    return rows.mapInPandas(run, f"request_id {kind['request_id']}, {key} {kind[key]}, ts {kind['ts']}, wait double")


def alternates(failed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(url, fetched_url): for each URL the first of itself, without its query, with index.html, that the snapshot has."""
    u = F.col("url")
    bare = F.regexp_replace(u, r"\?.*$", "")
    candidates = F.array_distinct(F.array(u, bare, F.when(bare.endswith("/"), F.concat(bare, F.lit("index.html"))).otherwise(bare)))
    rows = failed.select("url", F.posexplode(candidates).alias("k", "fetched_url"))
    hits = rows.join(snapshot.select(F.col("url").alias("fetched_url")).distinct(), "fetched_url")
    return hits.groupBy("url").agg(F.min_by("fetched_url", "k").alias("fetched_url"))


def dns_as_of(requests: DataFrame, verdicts: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Each request (request_id, hostname, ts) with the last verdict (hostname, checked_at, allowed) that is not older than the TTL.

    Requests and verdicts are merged in time order per host and slice of one
    TTL; the last verdict is carried forward.  A verdict is read in its own
    slice and in the next: beyond that it is too old.
    """
    slice_of = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / ttl_seconds).cast("long")
    asks = requests.select("hostname", "ts", slice_of("ts").alias("slice"), F.lit(1).alias("kind"), "request_id", F.lit(None).cast("boolean").alias("allowed"))
    own = slice_of("checked_at")
    known = verdicts.select("hostname", F.col("checked_at").alias("ts"), F.explode(F.array(own, own + 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast(dict(requests.dtypes)["request_id"]).alias("request_id"), "allowed")
    w = W.partitionBy("hostname", "slice").orderBy("ts", "kind").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("ts", "allowed")), ignorenulls=True).over(w)
    rows = asks.unionByName(known).withColumn("last", last).filter("kind = 1")
    fresh = F.col("ts").cast("timestamp").cast("double") - F.col("last.ts").cast("timestamp").cast("double") < ttl_seconds
    return rows.select("request_id", "hostname", "ts", F.when(fresh, F.col("last.allowed")).alias("cached_verdict"))
