"""Usage events: anonymized log, hourly quality, request limits and retention, for streams and tables alike."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from catalogspark.functions.text import hmac_sha256

# Part of a user agent -> client family, first match counts.
CLIENTS = {"claude-code": "claude-code", "claude": "claude", "openai": "openai", "chatgpt": "openai", "python-httpx": "sdk", "node": "sdk"}
LOG = "ts timestamp, path string, status int, ms bigint, address string, agent string, q string, zero boolean, opt_out boolean"
ANONYMOUS = "ts timestamp, path string, status int, ms bigint, anon string, client string, q string, zero boolean, day date"


def read_log(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The anonymized log that append_log writes: JSON lines in a folder a day."""
    reader = (spark.readStream if stream else spark.read).schema(ANONYMOUS)
    return reader.json(folder)


def client_family(agent: Column) -> Column:
    a = F.lower(agent)
    return F.coalesce(F.when(F.coalesce(agent, F.lit("")) == "", "unknown"), *[F.when(F.contains(a, F.lit(k)), v) for k, v in CLIENTS.items()], F.lit("other"))


def anonymized(events: DataFrame, key: bytes, prefix: str = "/api/") -> DataFrame:
    """Requests on the prefix without opt-out: keyed address hash (12 hex), client family, query cut to 200."""
    kept = events.where(F.startswith("path", F.lit(prefix)) & ~F.coalesce("opt_out", F.lit(False)))
    anon = F.substring(hmac_sha256(key, F.coalesce("address", F.lit(""))), 1, 12)
    return kept.select("ts", F.to_date("ts").alias("day"), "path", "status", "ms", anon.alias("anon"), client_family(F.col("agent")).alias("client"), F.substring("q", 1, 200).alias("q"), "zero")


def hourly_quality(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Per hour and path: requests, zero results, errors, median and 95th percentile of latency."""
    w = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "path")
    out = w.agg(F.count("*").alias("n"), F.count_if("zero").alias("zero"), F.count_if(F.col("status") >= 400).alias("errors"), F.percentile_approx("ms", [0.5, 0.95], 1000).alias("p"))
    return out.select(F.col("w.start").alias("hour"), "path", "n", "zero", "errors", F.col("p")[0].alias("ms_p50"), F.col("p")[1].alias("ms_p95"))


def window_counts(log: DataFrame, key: str, length: str = "60 seconds", slide: str = "10 seconds", lateness: str = "60 seconds") -> DataFrame:
    """Requests of each key in sliding windows."""
    out = log.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class _SlidingLimit(StatefulProcessor):
    """Requests of a key wait until the watermark has passed them and are then judged in order of time, so that neither chunks nor triggers matter."""

    def __init__(self, limit: int, span_us: int):
        self.limit, self.span = limit, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, n bigint")
        self.accepted = handle.getListState("accepted", "us bigint")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, us: int) -> None:
        """One timer a key, for its earliest waiting request."""
        ms = -(-us // 1000)
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or ms < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            n = pdf["us"].value_counts()
            self.waiting.appendList([(int(us), int(c)) for us, c in n.items()])
            self._wake(int(n.index.min()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = Counter(), []
        for us, n in self.waiting.get():
            if us <= upto:
                due[us] += n
            else:
                later.append((us, n))
        accepted = deque(x[0] for x in self.accepted.get())
        out = []
        for us in sorted(due):
            while accepted and accepted[0] < us - self.span:
                accepted.popleft()
            free = min(due[us], self.limit - len(accepted))
            accepted.extend([us] * free)
            out += [(us, True)] * free + [(us, False)] * (due[us] - free)
        self.timer.clear()
        self.waiting.clear()
        self.accepted.clear()
        if later:
            self.waiting.put(later)
            self._wake(min(later)[0])
        last = max(due, default=None)
        kept = [a for a in accepted if last is not None and a >= last - self.span]
        if kept:
            self.accepted.put([(a,) for a in kept])
        if kept and not later:  # nothing waits: the accepted times go when they count no more
            self._wake(kept[-1] + self.span)
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            yield pd.DataFrame({"anon": [key[0]] * len(part), "us": [x[0] for x in part], "allowed": [x[1] for x in part]})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limited(log: DataFrame, limit: int = 120, seconds: float = 60.0, lateness: str = "60 seconds") -> DataFrame:
    """Stream of anon, ts, allowed: a request is refused if ``limit`` accepted ones lie in the seconds before it.

    Requests are judged in order of event time once the watermark has passed them, so the same log gives the same answers however it is dealt
    to files, chunks and triggers, as long as no row is later than ``lateness``; rows beyond that are dropped, as by any watermark. The state of
    a key is its waiting requests and at most ``limit`` times. Requests of one time are alike; those without a time are left out. The session
    must use the RocksDB state store (STATE_STORE), which transformWithState needs.
    """
    if log.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    timed = log.select("anon", "ts").where("ts is not null").withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy("anon").transformWithStateInPandas(_SlidingLimit(limit, int(seconds * 1_000_000)), "anon string, us bigint, allowed boolean", "Append", "EventTime")
    return out.select("anon", F.timestamp_micros("us").alias("ts"), "allowed")


def append_log(events: DataFrame, key: bytes, path: str, checkpoint: str, **trigger):
    """Start the anonymized log: JSON lines in a folder a day."""
    return anonymized(events, key).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def retained(log: DataFrame, today: Column, days: int = 365) -> DataFrame:
    """Rows of the last ``days`` days."""
    return log.where(F.col("day") >= F.date_sub(today, days))
