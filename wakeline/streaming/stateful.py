"""Stateful streams: emissions, recall alerts, commitments and observed values, equal to their table jobs.

Rows of a micro-batch come in any order.  Each key holds back its rows until the watermark has passed them, and then takes them in the order of event
time, through the same steps as the table job; timers at the first row held back, at the next beat and at the end of what is remembered wake a key up,
so a silent key acts too, and its state ends.  A row that arrives behind the watermark is dropped by Spark, as in every stream with a watermark.

State is kept in RocksDB; a stream that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import COOL_DOWN, EMISSION, EMISSION_ORDER, HEARTBEAT, QUIET, Screen, may_tell
from ..operators.commitments import FORGET_DAYS, new_promise, new_value, observations, plain_key, storable
from .feeds import LATE

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands a key's rows on once the watermark has passed them, by event time (_us) and then by columns of an order."""

    def __init__(self, schema: str, columns: list[str], order: list[str]):
        self.schema, self.columns = schema, columns
        self.place = [columns.index(c) for c in ["_us", *order]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (Spark's names)
        us, first = self.place[0], None
        for row in rows:
            row = tuple(row[c] for c in self.columns)
            self.pending.appendValue(row)
            first = row[us] if first is None else min(first, row[us])
        self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        due, later, us = [], [], self.place[0]
        for row in self.pending.get():
            row = tuple(row)
            (due if row[us] <= now * 1000 else later).append(row)
        if due and later:
            self.pending.put(later)
        elif due:
            self.pending.clear()
        if later:
            self.wake(min(row[us] for row in later))
        due.sort(key=lambda row: tuple(row[i] for i in self.place))
        out = [Row(**dict(zip(self.out, row, strict=True))) for row in self.fold(key, due, now // 1000)]
        return iter(out)

    def wake(self, us: int | None) -> None:
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))

    def keep(self, state, rows: list[tuple]) -> None:
        """Replaces a list state; an empty one ends."""
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


class _Remembered(InOrder):
    """Rows that pass a step over what a key did in the last so many seconds."""

    def __init__(self, schema, columns, order, name: str, step, horizon: int):
        super().__init__(schema, columns, order)
        self.out, self.named, self.step, self.horizon = columns, columns.index(name), step, horizon

    def open(self, handle) -> None:
        self.known = handle.getListState("known", "name string, sec long")

    def fold(self, key, due, now) -> Iterator[tuple]:
        state = [(x[0], x[1]) for x in self.known.get()]
        kept = [row for row in due if self.step(state, (row[self.named], row[self.place[0]] // 1_000_000))]
        state = [(name, sec) for name, sec in state if now - sec <= self.horizon]
        self.keep(self.known, state)
        if state:
            self.wake((max(sec for _, sec in state) + self.horizon + 1) * 1_000_000)
        return kept


class _Values(InOrder):
    """Observed values that fit the unit of their series and are new for a day."""

    def open(self, handle) -> None:
        self.out = self.columns
        self.at = [self.columns.index(c) for c in ("value", "unit")]
        self.units = handle.getMapState("units", "unit string", "n long")
        self.recent = handle.getMapState("recent", "value double", "sec long")

    def fold(self, key, due, now) -> Iterator[tuple]:
        units = {k[0]: v[0] for k, v in self.units.iterator()}
        recent = {k[0]: v[0] for k, v in self.recent.iterator()}
        known, counted = dict(recent), dict(units)
        state = (units, recent)
        kept = [row for row in due if new_value(state, (row[self.at[0]], row[self.at[1]], row[self.place[0]] // 1_000_000))]
        for value in [v for v, sec in recent.items() if now - sec > 86400]:
            del recent[value]
        for unit, n in units.items():
            if counted.get(unit) != n:
                self.units.updateValue((unit,), (n,))
        for value in known.keys() - recent.keys():
            self.recent.removeKey((value,))
        for value, sec in recent.items():
            if known.get(value) != sec:
                self.recent.updateValue((value,), (sec,))
        if recent:
            self.wake((min(recent.values()) + 86401) * 1_000_000)
        return kept


class _Screens(InOrder):
    """Emissions of observed screens, and beats where nothing is observed."""

    out = ("user_id", "capture_id", "_sec", "app", "url", "reason")

    def __init__(self, schema, columns, beat: int, quiet: int):
        super().__init__(schema, columns, ["capture_id"])
        self.rule = beat, quiet
        self.at = [columns.index(c) for c in EMISSION_ORDER]

    def open(self, handle) -> None:
        self.screen = handle.getValueState("screen", Screen.SCHEMA)

    def fold(self, key, due, now) -> Iterator[tuple]:
        screen, out = Screen(*self.rule, self.screen.get() if self.screen.exists() else None), []
        for row in due:
            out += screen.observe(*(row[i] for i in self.at), row[self.place[0]] // 1_000_000)
        out += screen.silence(now)
        self.screen.update(screen.state())
        if (beat := screen.next_beat()) is not None:
            self.wake(beat * 1_000_000)
        return [(key[0], *row) for row in out]


def _prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _stream(feed: DataFrame, late: str, keys: list[str], processor, order: list[str], *args) -> DataFrame:
    """feed (ts, ...) through a processor of its columns but ts, which comes back."""
    _prepared(feed.sparkSession)
    rows = feed.withWatermark("ts", late).withColumn("_us", F.unix_micros("ts"))
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != "ts"]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds)
    out = rows.groupBy(*keys).transformWithState(processor(schema, [n for n, _ in kinds], order, *args), schema, "append", "eventTime")
    return out.select(*(F.timestamp_micros("_us").alias("ts") if c == "ts" else F.col(c) for c in feed.columns))


def limited_stream(alerts: DataFrame, late: str = LATE) -> DataFrame:
    """STR-3 as a stream: alerts (user_id, capture_id, ts, topic, ...) that may be told, as :func:`operators.alerts.limited`."""
    return _stream(alerts, late, ["user_id"], _Remembered, ["capture_id"], "topic", may_tell, COOL_DOWN)


def new_commitments_stream(found: DataFrame, late: str = LATE) -> DataFrame:
    """STR-4 as a stream: commitments (user_id, capture_id, ts, at, what, ...) without repeats of a fortnight, as :func:`operators.commitments.new_commitments`."""
    keyed = found.withColumn("_key", plain_key("what"))
    return _stream(keyed, late, ["user_id"], _Remembered, ["capture_id", "at"], "_key", new_promise, FORGET_DAYS * 86400).drop("_key")


def stored_numbers_stream(found: DataFrame, late: str = LATE) -> DataFrame:
    """STR-5 as a stream: a capture's observations (user_id, page_key, label, value, unit, ts, capture_id, at), as :func:`operators.commitments.stored_numbers`.

    found holds the first numbers of each capture (operators.commitments.observations, which a stream applies in foreachBatch).
    """
    return _stream(found, late, ["user_id", "page_key", "label"], _Values, ["capture_id", "at"])


def emissions_stream(feed: DataFrame, late: str = LATE, beat: int = HEARTBEAT["active"], quiet: int = QUIET) -> DataFrame:
    """STR-2 and WIN-9 as a stream: observations (user_id, capture_id, ts, app, url, frame) to EMISSION, as :func:`operators.alerts.emissions`."""
    _prepared(feed.sparkSession)
    rows = feed.withWatermark("ts", late).select("user_id", *EMISSION_ORDER, F.unix_micros("ts").alias("_us"), "ts")
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != "ts"]
    processor = _Screens(", ".join(f"`{n}` {t}" for n, t in kinds), [n for n, _ in kinds], beat, quiet)
    out = rows.groupBy("user_id").transformWithState(processor, "user_id long, capture_id long, _sec long, app string, url string, reason string", "append", "eventTime")
    return out.select("user_id", "capture_id", F.timestamp_seconds("_sec").alias("ts"), "app", "url", "reason")
