"""Streaming forms of ingestion and event analytics: extensions, as the batch forms are the reference's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from lexweave.operators.event_stats import BASELINE_EVENTS, LEAST_EVENTS
from lexweave.sources import sinks
from lexweave.sources.readers import cleaned
from lexweave.sources.sinks import KEPT_DAYS, MOST_BYTES


def documents(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def csv_documents(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """A stream of the rows of CSV files that appear in a folder, cleaned as read_csv does; ``columns`` are their headers, in order."""
    schema = StructType.fromDDL(", ".join(f"`{c}` string" for c in columns))
    return cleaned(spark.readStream.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path))


def first_seen(stream: DataFrame, keys: list[str], time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """The stream without repeated keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """By hour and component: events and mean duration."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), "component").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"))


def request_windows(events: DataFrame, key: str = "user_id", length: str = "60 seconds", step: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", length, step), key).agg(F.count("*").alias("n"))


BASELINE_SCHEMA = "component string, operation string, seen long, mean double, last double, anomaly boolean"
#: A row for each event: how many durations were seen of its component and operation, up to BASELINE_EVENTS, their mean, and whether it is an anomaly.
JUDGED_SCHEMA = "component string, operation string, timestamp timestamp, duration_ms double, seen bigint, mean double, anomaly boolean"


def rolling(last: np.ndarray, values: np.ndarray, most: int = BASELINE_EVENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of values, which follow those of last: size, mean and sample deviation of the up to ``most`` values that end with it."""
    every = np.concatenate([last, values])
    middle = every.mean() if len(every) else 0.0  # near zero, sums of squares lose no digits
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (every - middle, (every - middle) ** 2))
    end = np.arange(len(last), len(every)) + 1
    begin = np.maximum(0, end - most)
    n = end - begin
    mean = (sums[end] - sums[begin]) / n
    spread = np.maximum(0, squares[end] - squares[begin] - n * mean**2) / np.maximum(n - 1, 1)
    return n, mean + middle, np.sqrt(spread)


def _odd(n: np.ndarray, mean: np.ndarray, deviation: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (n >= LEAST_EVENTS) & (mean != 0) & (values > mean + 2 * deviation)


def _baseline(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a key's last durations and tells how it stands."""
    last = np.array(state.get[0] if state.exists else [], float)
    events = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
    values = events["duration_ms"].dropna().to_numpy(float)
    if len(values):
        n, mean, deviation = rolling(last, values)
        last = np.concatenate([last, values])[-BASELINE_EVENTS:]
        state.update((last.tolist(),))
        yield pd.DataFrame([(*key, int(n[-1]), float(mean[-1]), float(values[-1]), bool(_odd(n, mean, deviation, values)[-1]))], columns=["component", "operation", "seen", "mean", "last", "anomaly"])


def rolling_baselines(events: DataFrame) -> DataFrame:
    """By component and operation: size and mean of the last BASELINE_EVENTS durations, and whether the last one is an anomaly."""
    return events.select("component", "operation", "timestamp", "duration_ms").groupBy("component", "operation").applyInPandasWithState(_baseline, BASELINE_SCHEMA, "last array<double>", "update", GroupStateTimeout.NoTimeout)


class Baselines(StatefulProcessor):
    """Keeps a key's last durations as a list, for as long as events of it come: a timer forgets keys that were idle in event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "value double")
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        events = events[events["duration_ms"].notna()]
        if not len(events):
            return
        last = np.array([x[0] for x in self.last.get()], float)
        values = events["duration_ms"].to_numpy(float)
        n, mean, deviation = rolling(last, values)
        self.last.put([(float(x),) for x in np.concatenate([last, values])[-BASELINE_EVENTS:]])
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        until = int(events["timestamp"].max().timestamp() * 1000) + self.idle_ms
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"component": key[0], "operation": key[1], "timestamp": events["timestamp"].to_numpy(), "duration_ms": values, "seen": n, "mean": mean, "anomaly": _odd(n, mean, deviation, values)})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


#: The state store that list states and timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def judged_events(events: DataFrame, late: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """Each event that has a duration, with the baseline of the last BASELINE_EVENTS of its component and operation, itself included.

    Events of one key within a micro-batch go by time; those of an earlier micro-batch come before them.
    Events that are later than ``late`` are left out, and a key without events for so many hours is
    forgotten. The session's state store must be STATE_STORE.
    """
    rows = events.select("component", "operation", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("duration_ms").cast("double").alias("duration_ms")).withWatermark("timestamp", late)
    return rows.groupBy("component", "operation").transformWithStateInPandas(Baselines(int(idle_hours * 3_600_000)), JUDGED_SCHEMA, "Append", "EventTime")


def rotating_sink(events: DataFrame, path: str, checkpoint: str, most_bytes: int = MOST_BYTES, days: int = KEPT_DAYS) -> DataStreamWriter:
    """A writer of events as gzip JSON lines by day, component and category, in files of about ``most_bytes`` of text at most; days that are too old go.

    Each micro-batch has a folder of its own, which a repeated one replaces, so a restart loses and doubles nothing.
    """
    return events.writeStream.foreachBatch(lambda rows, batch: sinks.write_batch(rows, path, batch, most_bytes, days)).option("checkpointLocation", checkpoint)


def import_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is there and stop; the checkpoint resumes after the files already read."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
