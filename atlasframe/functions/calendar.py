"""Opening hours and the sun, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_list, split_pair, to_number

#: Days in order; the two holidays stand alone and aren't part of ranges.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su", "PH", "SH")
#: The sun's altitude in degrees at each event.
ALTITUDES = {"sunrise": -0.833, "civil": -6.0, "nautical": -12.0, "astronomical": -18.0}

_INTERVALS = "array<struct<from:string,to:string>>"


def _bound(value: Column, use) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def opening_hours(text: Column, explicit_closed: bool = False) -> Column:
    """Array of struct<day, intervals: array<struct<from, to>>> by day; null if any part can't be read.

    The last rule for a day wins. Ranges of days don't wrap, so Sa-Mo names no day. Days without a rule are left out, or with
    explicit_closed stand without intervals (not holidays). 'off' closes.
    """
    days = F.array(*map(F.lit, DAYS))
    number = lambda d, holidays: F.array_position(days if holidays else F.slice(days, 1, 7), d)

    def named(part: Column) -> Column:
        """Array of day numbers from 1; one 0 marks what can't be read."""
        none = F.array(F.lit(0).cast("long"))

        def span(e: Column) -> Column:
            low, high = e["low"], e["high"]
            return F.when(low.isNull() | high.isNull() | (low == 0) | (high == 0), none).when(low > high, F.array().cast("array<bigint>")).otherwise(F.sequence(low, high))

        place = lambda ends, k: F.when(F.size(ends) == 2, number(F.get(ends, F.lit(k)), False))
        days_between = _bound(_bound(split_list(part, "-"), lambda ends: F.struct(place(ends, 0).alias("low"), place(ends, 1).alias("high"))), span)
        return F.when(F.contains(part, F.lit("-")), days_between).otherwise(F.array(number(part, True)))

    def time_ok(t: Column) -> Column:
        within = lambda p, k, most: _bound(to_number(F.get(p, F.lit(k)), "int"), lambda n: n.between(0, most))
        return F.coalesce(_bound(split_list(t, ":"), lambda p: (F.size(p) == 2) & within(p, 0, 48) & within(p, 1, 59)), F.lit(False))

    def interval(t: Column) -> Column:
        ends = lambda p: F.struct(F.get(p, F.lit(0)).alias("from"), F.get(p, F.lit(1)).alias("to"))
        return _bound(split_list(F.trim(t), "-"), lambda p: F.when((F.size(p) == 2) & time_ok(F.get(p, F.lit(0))) & time_ok(F.get(p, F.lit(1))), ends(p)))

    def rule(pair: Column) -> Column:
        hours = F.when(pair["tail"] == "off", F.array().cast(_INTERVALS)).otherwise(F.transform(split_list(pair["tail"], ","), interval))
        return F.struct(F.flatten(F.transform(split_list(pair["head"], ","), named)).alias("days"), hours.alias("intervals"))

    ok = lambda rules: F.forall(rules, lambda r: F.coalesce(r["days"].isNotNull() & ~F.array_contains(r["days"], 0) & ~F.exists(r["intervals"], lambda i: i.isNull()), F.lit(False)))

    def of_day(rules: Column, d: Column) -> Column:
        own = F.filter(rules, lambda r: F.array_contains(r["days"], d))
        hours = F.try_element_at(own, F.lit(-1))["intervals"]
        closed = F.when(F.lit(explicit_closed) & (d <= 7), F.array().cast(_INTERVALS))
        return F.struct(F.get(days, (d - 1).cast("int")).alias("day"), F.coalesce(hours, closed).alias("intervals"))

    weekly = lambda rules: F.filter(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long")), lambda d: of_day(rules, d)), lambda x: x["intervals"].isNotNull())
    whole = F.array(F.struct(F.lit("00:00").alias("from"), F.lit("24:00").alias("to")))
    always = F.transform(F.slice(days, 1, 7), lambda d: F.struct(d.alias("day"), whole.alias("intervals")))
    rules = lambda t: F.transform(split_list(t, ";"), lambda r: _bound(split_pair(F.trim(r), " "), rule))
    return _bound(text, lambda t: F.when(t == "24/7", always).otherwise(_bound(rules(t), lambda r: F.when(ok(r), weekly(r)))))


def is_open(hours: Column, day: Column, minute: Column) -> Column:
    """Whether a day of opening_hours (Mo, ...) is open at a minute from its midnight; intervals past midnight count on the day they begin."""
    minutes = lambda t: F.substring_index(t, ":", 1).cast("int") * 60 + F.substring_index(t, ":", -1).cast("int")
    own = F.filter(hours, lambda r: r["day"] == day)

    def within(i: Column) -> Column:
        a, b = minutes(i["from"]), minutes(i["to"])
        return (minute >= a) & (minute < F.when(b <= a, b + 1440).otherwise(b))

    return F.exists(F.flatten(F.transform(own, lambda r: r["intervals"])), within)


def sun_times(lat: Column, lon: Column, day: Column, altitude: float = ALTITUDES["sunrise"]) -> Column:
    """struct<rise, set>: when the sun's centre passes an altitude on a day, to the second (UTC); null where it does not.

    The sunrise equation: mean anomaly, equation of the centre, ecliptic longitude, transit, hour angle.
    """
    epoch, shift = 2451545, 0.0009
    julian = F.unix_millis(day.cast("timestamp")) / 86400000.0 + 2440587.5
    west = -lon / 360
    n = F.round(julian - epoch - shift - west)
    noon = shift + west + n
    m = F.radians((357.5291 + 0.98560028 * noon) % 360)
    centre = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    ecliptic = F.radians((F.degrees(m) + 102.9372 + centre + 180) % 360)
    transit = noon + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * ecliptic)
    sin_d = F.sin(ecliptic) * math.sin(math.radians(23.439))
    cosine = (math.sin(math.radians(altitude)) - F.sin(F.radians(lat)) * sin_d) / (F.cos(F.radians(lat)) * F.sqrt(1 - sin_d * sin_d))
    half = F.degrees(F.acos(cosine)) / 360
    at = lambda days: F.timestamp_seconds(F.floor((days + epoch - 2440587.5) * 86400 + 0.5).cast("long"))
    return F.when(F.abs(cosine) <= 1, F.struct(at(transit - half).alias("rise"), at(transit + half).alias("set")))
