"""Navigation over a live stream of positions: each agent keeps a small state for each vehicle.

An agent is a fold: it takes one message at a time, in order of time, and gives rows. over_stream runs it with
applyInPandasWithState, over_table over a finished table; both give the same rows for the same messages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import share_package

RADIUS = 6371010.0


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


@dataclass(frozen=True)
class Agent:
    """name; state: DDL of its state, one row a vehicle; start: the first state; step(state, message) -> (state, rows of (ts, kind, value))."""

    name: str
    state: str
    start: tuple
    step: object


def _bearing_step(state: tuple, m) -> tuple[tuple, list]:
    """Bearing after each move of more than 2 m; a turn of more than 135 degrees within 15 m is noise. After 10 s without a position the next one only sets the place."""
    lat, lon, last, at = state
    now, here = m.seconds, (m.lat, m.lon)
    if m.lat is None or math.isnan(m.lat):
        return ((math.nan, math.nan, last, at) if at >= 0 and now - at > 10 else state), []
    if math.isnan(lat):
        return (m.lat, m.lon, last, now), []
    moved = metres((lat, lon), here)
    if moved <= 2:
        return state, []
    turned = bearing((lat, lon), here)
    off = abs(turned - last) % 360
    if min(off, 360 - off) > 135 and moved < 15:
        return state, []
    return (m.lat, m.lon, turned, now), [(now, "bearing", turned)]


BEARING = Agent("bearing", "lat double, lon double, last double, at double", (math.nan, math.nan, 0.0, -1.0), _bearing_step)


def _speed_step(state: tuple, m) -> tuple[tuple, list]:
    """km/h: of the device if it tells, else over the last 3 s of positions; above 200 it is -1 (unknown). Positions of 100 m accuracy or worse tell nothing; a gap of more than 10 s forgets the past."""
    lat, lon, at, steps_m, steps_s = state
    if m.lat is None or math.isnan(m.lat) or not m.accuracy < 100:
        return state, []
    out, steps = [], list(zip(steps_m, steps_s, strict=True))
    told = m.speed if m.speed is not None and not math.isnan(m.speed) else -1.0
    if told >= 0:
        v = told * 3.6
        out.append((m.seconds, "speed", v if v <= 200 else -1.0))
        if told < 0.5:
            steps = []
    elif at >= 0 and m.seconds - at >= 1:
        gap = m.seconds - at
        if gap > 10:
            steps = []
        steps.append((metres((lat, lon), (m.lat, m.lon)), gap))
        total = sum(s for _, s in steps)
        v = sum(d for d, _ in steps) / total * 3.6
        out.append((m.seconds, "speed", v if v <= 200 else -1.0))
        while steps and total > 3:
            total -= steps.pop(0)[1]
    return (m.lat, m.lon, m.seconds, [d for d, _ in steps], [s for _, s in steps]), out


SPEED = Agent("speed", "lat double, lon double, at double, steps_m array<double>, steps_s array<double>", (math.nan, math.nan, -1.0, [], []), _speed_step)


def route_state(target: tuple[float, float], off_seconds: float = 5.0, near: float = 30.0) -> Agent:
    """reroute where a vehicle has been off its route for more than off_seconds, target (value: metres) where it is on it and nearer than near. Messages have on_route."""

    def step(state: tuple, m) -> tuple[tuple, list]:
        was, since = state
        if m.lat is None or math.isnan(m.lat) or m.on_route is None:
            return state, []
        now = 1 if m.on_route else 2
        out = []
        if now != was:
            state = (now, m.seconds)
        elif now == 2 and m.seconds - since > off_seconds:
            out.append((m.seconds, "reroute", m.seconds - since))
        left = metres((m.lat, m.lon), target)
        if now == 1 and left < near:
            out.append((m.seconds, "target", left))
        return state, out

    return Agent("route_state", "was int, since double", (0, -1.0), step)


def _change_step(state: tuple, m) -> tuple[tuple, list]:
    """The street's name hash where it differs from the one before; the first message always tells."""
    known, last = state
    street = m.street if isinstance(m.street, str) else ""
    if known and street == last:
        return state, []
    return (1, street), [(m.seconds, "street " + street, 1.0)]


STREET = Agent("street", "known int, last string", (0, ""), _change_step)


def position_state(outdated: float = 2.0, low_accuracy: float = 100.0, throttle: float = 0.1) -> Agent:
    """Where the signal stands: on_route, off_route, low_accuracy or no_signal; messages without a position are ticks of the clock. States repeat no sooner than throttle seconds; tunnels (in_tunnel) estimate while there is no signal."""

    def step(state: tuple, m) -> tuple[tuple, list]:
        at, told_at, told = state
        has = m.lat is not None and not math.isnan(m.lat)
        if has:
            at = m.seconds
        if m.seconds - at > outdated or at < 0:
            kind = "estimate_in_tunnel" if getattr(m, "in_tunnel", False) and at >= 0 else "no_signal"
        elif has and not m.accuracy <= low_accuracy:
            kind = "low_accuracy"
        else:
            kind = "on_route" if m.on_route else "off_route"
        if kind == told and m.seconds - told_at < throttle:
            return (at, told_at, told), []
        return (at, m.seconds, kind), [(m.seconds, kind, 1.0)]

    return Agent("position", "at double, told_at double, told string", (-1.0, -1.0, ""), step)


ROWS = "vehicle long, ts timestamp, kind string, value double"


def _run(agent: Agent, state: tuple, t: pd.DataFrame, vehicle: int) -> tuple[tuple, pd.DataFrame]:
    t = t.assign(seconds=t["ts"].astype("datetime64[us]").astype("int64") / 1e6)
    out = []
    for m in t.itertuples():
        state, rows = agent.step(state, m)
        out += rows
    found = pd.DataFrame({"vehicle": [vehicle] * len(out), "ts": pd.to_datetime([int(round(s * 1e6)) for s, _, _ in out], unit="us"), "kind": pd.Series([k for _, k, _ in out], dtype=object), "value": [float(v) for _, _, v in out]})
    return state, found


def _in_order(t: pd.DataFrame) -> pd.DataFrame:
    """By time, and by event_id where there is one, so that messages of one time always come in one order."""
    return t.sort_values(["ts", *(["event_id"] if "event_id" in t.columns else [])], kind="stable")


def over_stream(positions: DataFrame, agent: Agent) -> DataFrame:
    """Rows (vehicle, ts, kind, value) of a streaming DataFrame of messages (vehicle, ts, lat, lon, accuracy, speed, ...); write it in append mode. Messages of one batch are put in order of time, then of event_id, if they have one."""
    share_package(positions.sparkSession)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else agent.start
        now, found = _run(agent, now, _in_order(pd.concat(list(batches))), key[0])
        state.update(now)
        yield found

    return positions.groupBy("vehicle").applyInPandasWithState(update, ROWS, agent.state, "append", GroupStateTimeout.NoTimeout)


def over_table(positions: DataFrame, agent: Agent) -> DataFrame:
    """The same over a table: each vehicle's messages fold in order. Vehicles stream through their tasks, which hold the state of one and a batch of messages."""
    share_package(positions.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vehicle, state = None, agent.start
        for batch in batches:
            for key, t in batch.groupby("vehicle", sort=False, dropna=False):
                if key != vehicle:
                    vehicle, state = key, agent.start
                state, found = _run(agent, state, t, key)
                yield found

    order = ["vehicle", "ts", *(["event_id"] if "event_id" in positions.columns else [])]
    return positions.repartition("vehicle").sortWithinPartitions(*order).mapInPandas(fold, ROWS)
