"""Dead reckoning in tunnels: where a vehicle is likely to be while its signal is gone.

A fix is a position of good accuracy, matched to the vehicle's route as metres from its start. When no new one has come for some seconds, ticks
follow in fixed steps of time. In a tunnel each tick moves the vehicle along the tunnel at the edges' speeds; at its end, and at
once outside tunnels, the signal counts as lost until the next fix. Ticks follow from event time alone: over a table they fill the gaps between fixes,
over a stream timers give them as the watermark passes, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import share_package

ROWS = "vehicle long, ts timestamp, kind string, along double"
_EDGES = "array<struct<to:double,speed:double>>"


def tunnel_runs(edges: DataFrame) -> DataFrame:
    """(vehicle, low, high, edges): stretches of a route that run in tunnels without a gap, with their edges (to, speed in metres a second) in order. edges: (vehicle, start, to, speed, tunnel), in metres from the route's start."""
    by = Window.partitionBy("vehicle").orderBy("start")
    inside = F.coalesce(F.col("tunnel"), F.lit(False))
    begins = inside & ~F.coalesce(F.lag(inside).over(by) & (F.lag("to").over(by) == F.col("start")), F.lit(False))
    numbered = edges.withColumn("run", F.sum(begins.cast("int")).over(by)).where(inside)
    runs = numbered.groupBy("vehicle", "run").agg(F.min("start").alias("low"), F.max("to").alias("high"), F.array_sort(F.collect_list(F.struct("to", "speed"))).cast(_EDGES).alias("edges"))
    return runs.select("vehicle", "low", "high", "edges")


def with_tunnels(positions: DataFrame, edges: DataFrame, low_accuracy: float = 100.0) -> DataFrame:
    """Messages (vehicle, ts, along, edges) of positions (vehicle, ts, along, accuracy), streaming or not: edges are those of the tunnel around a fix, from the one it is on; along is null for what is no fix."""
    runs = tunnel_runs(edges)
    fixes = positions.select("vehicle", "ts", F.when(F.col("accuracy") < low_accuracy, F.col("along")).alias("along"))
    met = fixes.join(runs.withColumnRenamed("vehicle", "v"), (F.col("vehicle") == F.col("v")) & (F.col("along") >= F.col("low")) & (F.col("along") < F.col("high")), "left")
    return met.select("vehicle", "ts", "along", F.filter("edges", lambda e: e["to"] > F.col("along")).alias("edges"))


@dataclass
class Reckoner:
    """One vehicle's state: the last fix (microseconds, metres, edges ahead in its tunnel) and the number of ticks given since."""

    outdated: int = 2_000_000
    period: int = 1_000_000
    fix: int | None = None
    along: float = 0.0
    edges: tuple[tuple[float, float], ...] = ()
    ticks: int = 0
    lost: bool = False

    def moved(self, seconds: float) -> float | None:
        """Metres from the start after so many seconds along the tunnel; None beyond its end."""
        at = self.along
        for to, speed in self.edges:
            if speed > 0 and (to - at) / speed <= seconds:
                seconds -= (to - at) / speed
                at = to
            else:
                return at + speed * seconds if speed > 0 else at
        return None

    def next_tick(self) -> int | None:
        return None if self.fix is None or self.lost else self.fix + self.outdated + self.ticks * self.period

    def until(self, end: int, included: bool) -> list[tuple[int, str, float]]:
        """Ticks before end, or up to it."""
        out = []
        while (t := self.next_tick()) is not None and (t < end or included and t == end):
            at = self.moved((t - self.fix) / 1e6)
            self.ticks += 1
            self.lost = at is None
            out.append((t, "no_signal", self.edges[-1][0] if self.edges else self.along) if at is None else (t, "estimate_in_tunnel", at))
        return out

    def take(self, at: int, along: float, edges) -> list[tuple[int, str, float]]:
        """A message's rows: the ticks before it and, of a fix, the fix itself."""
        out = self.until(at, False)
        if along is not None and along == along:
            self.fix, self.along, self.ticks, self.lost = at, float(along), 0, False
            self.edges = tuple((e["to"], e["speed"]) for e in edges) if edges is not None else ()
            out.append((at, "fix", self.along))
        return out


def _frame(vehicle: int, rows: list[tuple[int, str, float]]) -> pd.DataFrame:
    return pd.DataFrame({"vehicle": pd.Series([vehicle] * len(rows), dtype="Int64"), "ts": pd.to_datetime([t for t, _, _ in rows], unit="us"), "kind": pd.Series([k for _, k, _ in rows], dtype=object), "along": [a for _, _, a in rows]})


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def reckoned_table(messages: DataFrame, outdated: float = 2.0, period: float = 1.0) -> DataFrame:
    """Rows (vehicle, ts, kind, along) of messages (vehicle, ts, along, edges) of with_tunnels: fixes, estimates in tunnels and losses of the signal.

    Vehicles stream through their tasks, which hold one's state and a batch of messages. Ticks after the last message go on to the end of its tunnel. Messages without a vehicle or a time
    are left out; of messages of one time all count, the largest along last.
    """
    share_package(messages.sparkSession)
    steps = int(outdated * 1e6), int(period * 1e6)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vehicle, now = None, None
        for batch in batches:
            for key, t in batch.groupby("vehicle", sort=False):
                if key != vehicle:
                    if now is not None:
                        yield _frame(vehicle, now.until(1 << 62, True))
                    vehicle, now = key, Reckoner(*steps)
                rows = []
                for at, along, edges in zip(_micros(t["ts"]), t["along"], t["edges"], strict=True):
                    rows += now.take(int(at), along, edges)
                yield _frame(key, rows)
        if now is not None:
            yield _frame(vehicle, now.until(1 << 62, True))

    known = messages.where("vehicle is not null and ts is not null").select("vehicle", "ts", "along", "edges")
    return known.repartition("vehicle").sortWithinPartitions("vehicle", "ts", "along").mapInPandas(fold, ROWS)


class _Processor(StatefulProcessor):
    """Messages wait until the watermark passes them, so that they are taken in order of time; timers stand at waiting messages and at the next tick."""

    def __init__(self, outdated: int, period: int):
        self.steps = outdated, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, along double, edges {_EDGES}")
        self.now = handle.getValueState("now", f"fix long, along double, edges {_EDGES}, ticks long, lost boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for t in rows:
            found = [(int(at), None if along != along else along, None if edges is None else [(e["to"], e["speed"]) for e in edges]) for at, along, edges in zip(_micros(t["ts"]), t["along"], t["edges"], strict=True)]
            self.waiting.appendList(found)
            for at in {at for at, _, _ in found}:
                self.handle.registerTimer(-(-at // 1000))
        return iter([_frame(key[0], [])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000  # nothing older can come
        state = self.now.get()
        now = Reckoner(*self.steps) if state is None else Reckoner(*self.steps, state[0], state[1], tuple((e[0], e[1]) for e in state[2] or []), state[3], state[4])
        all_waiting = [tuple(w) for w in self.waiting.get()]
        rows = []
        for at, along, edges in sorted((w for w in all_waiting if w[0] <= end), key=lambda w: (w[0], w[1] is not None, w[1] or 0.0)):
            rows += now.take(at, along, None if edges is None else [{"to": e[0], "speed": e[1]} for e in edges])
        rows += now.until(end, True)
        left = [w for w in all_waiting if w[0] > end]
        if len(left) < len(all_waiting):
            self.waiting.clear()
            if left:
                self.waiting.put([(a, b, None if c is None else [tuple(e) for e in c]) for a, b, c in left])
        if now.fix is not None:
            self.now.update((now.fix, now.along, list(now.edges), now.ticks, now.lost))
        if (t := now.next_tick()) is not None:
            self.handle.registerTimer(-(-t // 1000))
        yield _frame(key[0], rows)

    def close(self) -> None:
        pass


def reckoned_stream(messages: DataFrame, outdated: float = 2.0, period: float = 1.0, delay: str = "5 seconds") -> DataFrame:
    """The rows of reckoned_table over a streaming DataFrame of messages, as far as the watermark (the latest time seen less delay) has come; write it in append mode. Messages that come later than that are dropped. The state store must be RocksDB."""
    share_package(messages.sparkSession)
    known = messages.where("vehicle is not null and ts is not null").select("vehicle", "ts", "along", "edges").withWatermark("ts", delay)
    return known.groupBy("vehicle").transformWithStateInPandas(_Processor(int(outdated * 1e6), int(period * 1e6)), ROWS, "append", "EventTime")
