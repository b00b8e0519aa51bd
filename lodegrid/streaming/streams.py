"""Streams: counts in event-time windows, first sightings of labels, saturation curves, appends to a register by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodegrid.operators import windows as W
from lodegrid.operators.state import REGISTER, REGISTER_SCHEMA


def events_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and kind; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def first_sightings(labels: DataFrame, ts: str, label: str, horizon: str = "30 days") -> DataFrame:
    """Each label once, when it is first seen within the horizon: the increments of a saturation curve. State goes with the watermark."""
    return labels.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([label])


#: Stateful processors keep their state there; set it before the stream is started.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Labels of an entity that are held in one value, which is read and written once a batch. Those beyond are looked up one by one,
#: so a batch never reads more than so many that it doesn't ask for.
LISTED = 2000


class FirstLabels(StatefulProcessor):
    """State of one entity: when it was first seen, and its labels. Hands on (entity, first, label) for each label that is new to
    it, and (entity, first, null) when it is first seen, or seen to have begun earlier. With ``idle`` (milliseconds of event time) a timer
    clears the state of an entity that hasn't been seen for so long; if it comes back, what is handed on again is merged by the sink."""

    time = "timestamp"

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", f"at {self.time}, listed array<string>")
        self.labels = handle.getMapState("labels", "label string", "seen boolean")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest, times, labels = None, [], {}
        for pdf in rows:
            times.append(pdf["ts"].min().to_pydatetime())
            latest = max(x for x in (latest, pdf["ts"].max()) if x is not None)
            labels |= dict.fromkeys(pdf["label"].dropna())
        until = None if latest is None else int(latest.timestamp() * 1000)
        yield pd.DataFrame(self.seen(key[0], min(times, default=None), until, labels), columns=["entity", "first", "label"])

    def seen(self, entity: Any, earliest: Any, until: int | None, labels: dict[str, None]) -> list[tuple]:
        """What is handed on when a batch has these labels of an entity. ``until``: the latest time, in milliseconds."""
        out: list[tuple] = []
        known, listed = self.first.get() if self.first.exists() else (None, [])
        lowest = min((x for x in (known, earliest) if x is not None), default=None)
        held = set(listed)
        found = [label for label in labels if label not in held]
        if len(listed) >= LISTED:
            found = [label for label in found if not self.labels.containsKey((label,))]
        room = LISTED - len(listed)
        for label in found[room:]:
            self.labels.updateValue((label,), (True,))
        if known is None or lowest < known or room and found:
            self.first.update((lowest, [*listed, *found[:room]]))
        if known is None or lowest < known:
            out.append((entity, lowest, None))
        out += [(entity, lowest, label) for label in found]
        if self.idle is not None and until is not None:
            at = until + self.idle
            was = self.timer.get()[0] if self.timer.exists() else None
            if was is None or at > was:
                if was is not None:
                    self.handle.deleteTimer(was)
                self.handle.registerTimer(at)
                self.timer.update((at,))
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.first, self.labels, self.timer):
            state.clear()
        return iter(())

    def close(self) -> None:
        return None


class FirstLabelsOfRows(FirstLabels):
    """The same from rows, with times in microseconds: an entity has a few rows a batch, for which a table of its own costs more than all the rest."""

    time = "long"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        earliest = latest = None
        labels: dict[str, None] = {}
        for row in rows:
            at = row["at"]
            earliest = at if earliest is None or at < earliest else earliest
            latest = at if latest is None or at > latest else latest
            if row["label"] is not None:
                labels[row["label"]] = None
        for entity, first, label in self.seen(key[0], earliest, None if latest is None else latest // 1000, labels):
            yield Row(entity=entity, first=first, label=label)


def first_labels(events: DataFrame, entity: str, ts: str, label: str, late: str | None = None, idle: int | None = None) -> DataFrame:
    """A stream of (entity, first, label), see ``FirstLabels``. Rows with a null entity or time don't count. ``idle`` needs ``late``, the watermark."""
    kind = events.schema[entity].dataType.simpleString()
    rows = events.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(label).cast("string").alias("label")).filter("entity is not null and ts is not null")
    if late:
        rows = rows.withWatermark("ts", late)
    found = rows.withColumn("at", F.unix_micros("ts")).groupBy("entity").transformWithState(FirstLabelsOfRows(idle), f"entity {kind}, first long, label string", "append", "none" if idle is None else "EventTime")
    return found.select("entity", F.timestamp_micros("first").alias("first"), "label")


def curve_of(spark: SparkSession, path: str, schema: str, window: float = 0.1) -> DataFrame:
    """The saturation curve of what a stream of first labels has written up to now: entities in the order in which they were first seen."""
    rows = spark.read.schema(schema).parquet(path)
    order = W.ranked(rows.groupBy("entity").agg(F.min("first").alias("first")), [F.col("first"), F.col("entity")]).select("entity", "rank")
    return W.saturation(rows.filter("label is not null").select("entity", "label").distinct(), order, "entity", "label", window)


def append_new(register: str, key: list[str]):
    """A foreachBatch sink that appends only events whose key isn't in the register yet.

    Each batch has a folder of its own (batch=<number>), which is written as a whole: a batch that is repeated, also one that
    stopped halfway, replaces its own rows and is only compared with those of other batches. One stream writes to a register;
    a second one needs a register of its own. Each batch reads the register's keys.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(register)
        rows = batch.dropDuplicates(key).select(*REGISTER)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(f"{REGISTER_SCHEMA}, batch long").parquet(register).filter(F.col("batch") != number)
            rows = rows.join(known.select(*key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{register}/batch={number}")

    return sink
