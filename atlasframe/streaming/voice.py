"""Spoken instructions: what a navigator says, and when, while a vehicle follows its route.

Instructions of a route become announcements, each with the stretch of the route on which it is the next one, so a position finds its announcement by
one join, streaming or not. A fold over a vehicle's messages then decides when to speak: a new announcement within 900 m is said
at once, the same one again only after enough way and near enough; the signal's loss is said after ten seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agents import Agent

#: Metres ahead in which announcements are looked for, and from which a target is told.
AHEAD, TARGET_NEAR = 2000.0, 40.0
#: Metres below which a next announcement is said, and (metres ahead, metres since it was said last) at which it is repeated.
FAR, REPEATS, BACK = 900.0, ((550.0, 300.0), (150.0, 200.0), (60.0, 100.0)), -50.0
#: The distances that are said, each from just above it on.
SAID = (800, 700, 600, 500, 400, 300, 200, 100, 80)
THEN, SHORT_ROUNDABOUT, SILENT_CAR, LOST_SECONDS = 200.0, 120.0, 80.0, 10.0


def announcements(instructions: DataFrame) -> DataFrame:
    """(vehicle, low, begins, until, kind, then_kind, then_at): what is to be said between low (excluded) and until, in metres of the route.

    instructions: (vehicle, at, kind, exit) with kinds such as turn_left, leave_motorway_right, roundabout_enter, roundabout_leave and target. A roundabout is one
    announcement, roundabout_exit_1 to 6, due where it is entered and over where it is left; one without an entry is silent until it is left.
    """
    by = Window.partitionBy("vehicle").orderBy("at", "kind")
    entered = F.last(F.when(F.col("kind") == "roundabout_enter", F.col("at")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    left = F.last(F.when(F.col("kind") == "roundabout_leave", F.col("at")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    round_ = F.col("kind") == "roundabout_leave"
    ours = F.when(left.isNull() | (entered > left), entered)
    told = instructions.select("vehicle", F.col("at").alias("until"), F.when(round_, ours).otherwise(F.col("at")).alias("begins"), F.col("kind").alias("raw"), F.coalesce("exit", F.lit(6)).alias("exit"), F.struct("at", "kind").alias("o"))
    named = told.withColumn("kind", F.when((F.col("raw") == "roundabout_leave") & F.col("begins").isNull(), "silent").when(F.col("raw") == "roundabout_leave", F.concat(F.lit("roundabout_exit_"), F.least(F.greatest("exit", F.lit(1)), F.lit(6)))).otherwise(F.col("raw")))
    named = named.where("raw <> 'roundabout_enter'").withColumn("begins", F.coalesce("begins", "until"))
    order = Window.partitionBy("vehicle").orderBy("o")
    before = F.lag("until").over(order)
    turns = F.struct("kind", "begins")
    then = F.first(F.when(F.col("kind") != "target", turns), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    reach = F.when(F.col("kind") == "target", TARGET_NEAR).otherwise(AHEAD)
    return named.select("vehicle", F.greatest(F.coalesce(before, F.col("until") - reach - 1), F.col("until") - reach).alias("low"), "begins", "until", "kind", then["kind"].alias("then_kind"), then["begins"].alias("then_at"))


def with_announcements(positions: DataFrame, told: DataFrame) -> DataFrame:
    """positions (vehicle, along, ...) with the announcement that is next (next_kind, next_at, then_kind, then_at), if any. Stretches of announcements don't overlap and meet positions by vehicle and a kilometre mark."""
    mark: Column = F.floor(F.col("along") / AHEAD)
    spread = told.select("*", F.explode(F.sequence(F.floor(F.col("low") / AHEAD), F.floor(F.col("until") / AHEAD))).alias("mark")).withColumnRenamed("vehicle", "of_vehicle")
    met = positions.withColumn("here", mark).join(spread, (F.col("vehicle") == F.col("of_vehicle")) & (F.col("here") == F.col("mark")) & (F.col("along") > F.col("low")) & (F.col("along") <= F.col("until")), "left")
    on_it = F.col("kind").startswith("roundabout_") & (F.col("along") > F.col("begins"))
    return met.select(*[positions[c] for c in positions.columns], F.when(on_it, "silent").otherwise(F.col("kind")).alias("next_kind"), F.when(on_it, F.col("until")).otherwise(F.col("begins")).alias("next_at"), "then_kind", "then_at")


def _text(ahead: float, kind: str, at: float, then_kind, then_at, car: bool) -> str | None:
    if kind == "silent":
        return None
    words = []
    if not (car and ahead < SILENT_CAR):
        words = ["after", str(next((d for d in SAID if ahead > d), 50)), "metres"]
    short = kind.startswith("roundabout_") and ahead < SHORT_ROUNDABOUT
    words.append(kind.removeprefix("roundabout_") if short else kind)
    if isinstance(then_kind, str) and then_kind != "silent" and then_at - at <= THEN:
        words += ["then", then_kind.removeprefix("roundabout_")]
    return " ".join(words)


def voice(vehicle: str = "car") -> Agent:
    """What is said, as kind, with the metres to the instruction as value. Messages (ts, state, along) of with_announcements; state is one of on_route, estimate_in_tunnel, no_signal and others."""

    def step(state: tuple, m) -> tuple[tuple, list]:
        signal, seen, kind, at, said = state
        out = []
        now = m.state != "no_signal"
        if now and not signal:
            signal = True
            out.append((m.seconds, "gps_found", 0.0))
        elif signal and not now and m.seconds - seen > LOST_SECONDS:
            signal = False
            out.append((m.seconds, "gps_lost", 0.0))
        seen = m.seconds if now else seen
        if m.state in ("on_route", "estimate_in_tunnel") and isinstance(m.next_kind, str) and not math.isnan(m.along):
            ahead, moved = m.next_at - m.along, m.along - said
            new = (m.next_kind, m.next_at) != (kind, at)
            if ahead < FAR and (new or moved < BACK or any(ahead < near and moved > way for near, way in REPEATS)):
                kind, at, said = m.next_kind, m.next_at, m.along
                text = _text(ahead, kind, at, m.then_kind, m.then_at, vehicle == "car")
                if text:
                    out.append((m.seconds, text, ahead))
        return (signal, seen, kind, at, said), out

    return Agent("voice", "signal boolean, seen double, kind string, at double, said double", (True, -math.inf, "", -1.0, 0.0), step)
