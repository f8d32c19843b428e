"""The stream forms of the usage and ingest jobs. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import usage
from ..operators.accounts import latest_checks
from ..operators.usage import SESSION_SECONDS, valid_calls
from ..sources import keyed

SESSION_OUTPUT = "event_id long, ts timestamp, tool string, caller string, client_name string, client_version string"


def ingest_files(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Appends the files of `source` that no earlier run has taken to the Parquet table `target`, then stops."""
    rows = spark.readStream.format("csv").schema(schema).options(**options).load(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()


def call_metrics(events: DataFrame, tools: list[str], every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """The stream form of operators.usage.call_metrics: event-time windows with a watermark."""
    calls = valid_calls(events, tools).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = calls.groupBy(F.window("ts", every), "tool", "status", "bound").agg(F.count("*").alias("calls"))
    return out.select(F.col("window.start").alias("start"), "tool", "status", "bound", "calls")


def busy_gauge(samples: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """The stream form of operators.usage.busy_gauge."""
    return usage.busy_gauge(samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), every)


def rejections(events: DataFrame, every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """The stream form of operators.usage.rejections."""
    return usage.rejections(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), every)


def append_events(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Adds the new event rows of a stream to the day-partitioned event table `target`, each exactly once, then stops. The stream form of sources.dump.append_events."""
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("day").trigger(availableNow=True).start()


def once_in_flight(due: DataFrame, within: str = "15 minutes") -> DataFrame:
    """A stream of due groups (numbers, asked_at) without those that were handed out less than `within` before."""
    return due.withWatermark("asked_at", within).dropDuplicatesWithinWatermark(["numbers"])


class Sessions(StatefulProcessor):
    """Keeps each caller's handshakes as long as a call that may still come can belong to one.

    A handshake is of no more use once the watermark is `seconds` past it: a timer at that event time drops it, so a
    caller who never comes back leaves no state. A call takes the latest handshake known that isn't later than itself,
    also when it comes after younger events; a handshake that comes after a call it precedes doesn't change that call.
    Rows older than the watermark are dropped by Spark before they get here.
    """

    def __init__(self, seconds: int = SESSION_SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shakes = handle.getListState("shakes", "ts timestamp, event_id long, client_name string, client_version string")

    def _keep(self, shakes: list[tuple], watermark_ms: int) -> None:
        """Stores the handshakes that are still of use, and sets a timer for the first that won't be."""
        keep = [s for s in shakes if self._end(s) > watermark_ms]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if keep:
            self.shakes.put(keep)
            self.handle.registerTimer(self._end(keep[0]))
        elif self.shakes.exists():
            self.shakes.clear()

    def _end(self, shake: tuple) -> int:
        return int(pd.Timestamp(shake[0]).value // 1_000_000) + self.seconds * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        known = [tuple(s) for s in self.shakes.get()] if self.shakes.exists() else []
        new = batch[batch.event == "initialize"]
        known += [(r.ts.to_pydatetime(), r.event_id, r.client_name, r.client_version) for r in new.itertuples()]
        known.sort(key=lambda s: (pd.Timestamp(s[0]), s[1]))
        times = [pd.Timestamp(s[0]) for s in known]
        out = []
        for r in batch[batch.event == "tool_call"].sort_values(["ts", "event_id"]).itertuples():
            i = bisect_right(times, r.ts) - 1
            live = i >= 0 and (r.ts - times[i]).total_seconds() < self.seconds
            out.append((r.event_id, r.ts, r.tool, key[0], known[i][2] if live else None, known[i][3] if live else None))
        self._keep(known, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["event_id", "ts", "tool", "caller", "client_name", "client_version"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep([tuple(s) for s in self.shakes.get()] if self.shakes.exists() else [], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([], columns=["event_id", "ts", "tool", "caller", "client_name", "client_version"])

    def close(self) -> None:
        pass


def attribute_sessions(events: DataFrame, seconds: int = SESSION_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The stream form of operators.usage.attribute_sessions; needs the RocksDB state store.

    Rows may be up to `late` behind the newest one seen; later ones are dropped, and so are rows without a time.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event", "tool", "caller", "client_name", "client_version").where("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("caller").transformWithStateInPandas(Sessions(seconds), outputStructType=SESSION_OUTPUT, outputMode="Append", timeMode="EventTime")


def upsert_checks(checks: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merges a stream of account checks into the keyed table `target`; the newest check of each number stays.

    Only the buckets that a batch's numbers fall into are written anew, and a batch that is given again changes nothing.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        keyed.upsert(batch, target, "number", lambda new, old: latest_checks(new, old), epoch, buckets)

    return checks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, target: str) -> str | None:
    """A path pattern of the rows of the newest complete version of a table that upsert_checks keeps; null before the first."""
    return keyed.live_path(spark, target)
