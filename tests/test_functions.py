"""Single values with results known from elsewhere."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasframe.functions import calendar, features, geo, geodesic, shapes, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def tags(**given):
    return F.create_map(*[F.lit(x) for k, v in given.items() for x in (k.replace("__", ":"), v)])


def dms(degrees, minutes, seconds):
    return degrees + minutes / 60 + seconds / 3600


def test_distances_and_targets():
    """The line from Flinders Peak to Buninyong of Australia's geodetic manual, which gives 54972.271 m and 306 52 05.37 (the ellipsoids differ by less than a tenth of a millimetre)."""
    lat1, lon1 = -dms(37, 57, 3.7203), dms(144, 25, 29.5244)
    lat2, lon2 = -dms(37, 39, 10.1561), dms(143, 55, 35.3839)
    assert geodesic.distance([lat1], [lon1], [lat2], [lon2])[0] == pytest.approx(54972.271, abs=1e-3)
    lat, lon = geodesic.destination([lat1], [lon1], [dms(306, 52, 5.37)], [54972.271])
    assert lat[0] == pytest.approx(lat2, abs=1e-6) and lon[0] == pytest.approx(lon2, abs=1e-6)
    # A quarter of the equator and of a meridian, whose lengths follow from the ellipsoid's axes.
    assert geodesic.distance([0.0], [10.0], [0.0], [11.0])[0] == pytest.approx(6378137 * np.pi / 180, abs=1e-3)
    assert geodesic.distance([0.0], [0.0], [90.0], [0.0])[0] == pytest.approx(10001965.729, abs=1e-2)
    assert geodesic.distance([-33.0], [18.0], [-33.0], [18.0])[0] == 0


def test_destination_and_distance_agree():
    rng = np.random.default_rng(1)
    lat, lon, b, d = rng.uniform(-80, 80, 99), rng.uniform(-170, 170, 99), rng.uniform(0, 360, 99), rng.uniform(1, 1e5, 99)
    assert np.allclose(geodesic.distance(lat, lon, *geodesic.destination(lat, lon, b, d)), d, atol=1e-4)


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        # Nothing, words, one number, a side without the other, a number with a word's letter, and numbers out of range.
        ("", None), ("   ", None), ("here", None), ("S 33", None), ("S 33 E", None), ("33 18k", None), ("91 18", None), ("33 181", None),
        # Plain numbers, signs, sides before and behind, decimal commas.
        ("33 18", (33, 18)), ("33 -18", (33, -18)), ("+33 -18", (33, -18)), ("S33 E18", (-33, 18)), ("33 S E 18", (-33, 18)), ("33 S 18 W  ", (-33, -18)), ("33.92 18.42", (33.92, 18.42)), ("33,925 -18,424", (33.925, -18.424)),
        # Degrees, minutes and seconds of Sydney, Tokyo and the Cape, with and without marks.
        ("33°52'7.680\"S 151°12'33.480\"E", (-33.8688, 151.2093)), ("N 35°41.370' E 139°41.502'", (35.6895, 139.6917)), ("33.92490° 18.42410°", (33.9249, 18.4241)), ("35° 41.370' 139° 41.502'", (35.6895, 139.6917)), ("N 035° 41.370, E 139° 41.502", (35.6895, 139.6917)), ("S 34 W 18", (-34, -18)),
    ],
)
def test_coordinates_from_text(spark, given, expected):
    found = value(spark, geo.parse_point(F.lit(given)))
    assert (found is None) == (expected is None)
    if expected:
        assert (found.lat, found.lon) == (pytest.approx(expected[0], abs=1e-6), pytest.approx(expected[1], abs=1e-6))


@pytest.mark.parametrize(
    ("given", "usual", "expected"),
    [
        ({"access": "agricultural", "bicycle": "no", "foot": "yes"}, features.FOOT | features.BICYCLE, features.FOOT),
        ({"bicycle": "yes"}, features.FOOT, features.FOOT | features.BICYCLE),
        ({"bicycle": "no"}, features.FOOT | features.BICYCLE, features.FOOT),
        ({"foot": "no", "bicycle": "no", "oneway": "yes"}, features.CAR, features.ONEWAY_FORWARD | features.CAR_FORWARD),
        ({"access": "no", "oneway": "yes", "motor_vehicle": "private"}, 0, features.ONEWAY_FORWARD | features.CAR_FORWARD),
    ],
)
def test_access(spark, given, usual, expected):
    assert value(spark, features.access(tags(**given), usual)) == expected


def test_numeric_features(spark):
    speed = lambda **t: value(spark, features.max_speed(tags(**t)))
    assert [speed(maxspeed=x) for x in ("50", "30 mph", "walk", "none", "300", "x", "50 km/h", "DE:urban")] == [50, 48, 10, None, 255, None, 50, 50]
    assert speed(maxspeed__forward="50", maxspeed__backward="30") == 30
    assert [value(spark, features.width(tags(width=x))) for x in ("3,5 m", "2.4", "-1", "wide", "300")] == [4, 2, None, None, None]
    assert [value(spark, features.milestone(tags(distance=x)))["distance"] for x in ("35", "35.5", "35 km", "10 mi", "x", "-1")] == [35000, 35500, 35000, 16093, 0, 0]
    lanes = value(spark, features.lanes(tags(lanes="3", oneway="yes", turn__lanes="left|through|")))
    assert (lanes.forward, lanes.backward, lanes.turn_forward) == (3, 0, ["left", "through"])


@pytest.mark.parametrize(
    ("given", "n"),
    [("garbage", None), ("24/7", 7), ("Mo-Fr 08:00-12:00,13:00-17:30", 5), ("Mo-Fr 08:00-12:00, 13:00-17:30", 5), ("Mo-Fr 08:00-18:00; Sa 08:00-12:00", 6), ("Mo,We 08:00-12:00", 2), ("Mo-Fr 08:00-18:00; Sa-Su,PH 08:00-12:00", 8), ("Mo-Fr 08:00-18:00; PH off", 6), ("Mo-Th 11:00-24:00, Sa 11:30-24:00, Su 11:30-22:00", None), ("Sa-Mo 10:00-12:00", 0), ("Mo 10:00-49:00", None)],
)
def test_opening_hours(spark, given, n):
    found = value(spark, calendar.opening_hours(F.lit(given)))
    assert (found if found is None else len(found)) == n


def test_sun(spark):
    noon = F.to_timestamp(F.lit("2021-12-21 12:00:00"))
    s = value(spark, calendar.sun_times(F.lit(50.083), F.lit(14.422), noon))
    assert (s.rise, s["set"]) == (dt.datetime(2021, 12, 21, 6, 59, 58), dt.datetime(2021, 12, 21, 15, 3, 24))
    assert value(spark, calendar.sun_times(F.lit(69.6523), F.lit(18.9753), noon)) is None


def test_texts(spark):
    v = lambda c: value(spark, c)
    assert v(text.split_list(F.lit("a;;b;"), ";")) == ["a", "", "b"] and v(text.split_list(F.lit(""), ";")) == []
    assert v(text.glued_tokens(F.array(*map(F.lit, ("Am", "alten", "Markt", "Nord"))))) == ["Am alten", "Markt", "Nord"]
    assert v(text.groupings(F.array(*map(F.lit, "abcd")), 2)) == [["a", "b c d"], ["a b", "c d"], ["a b c", "d"]]
    assert v(text.duration_text(F.lit(59))) == "59 s" and v(text.duration_text(F.lit(3661))) == "01:01:01"
    assert v(text.match_quality(F.lit("Dortmund"), F.lit("dortmund"))) == "match" and v(text.match_quality(F.lit("Dortmund"), F.lit("mund"))) == "candidate"
    assert v(text.colour_hex(text.colour(F.lit("darkaqua")))) == "#008b8b" and v(text.colour(F.lit("#12345"))) is None


def test_rings(spark):
    at = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    square, bow = F.array(at(0, 0), at(0, 2), at(2, 2), at(2, 0)), F.array(at(0, 0), at(2, 2), at(0, 2), at(2, 0))
    v = lambda c: value(spark, c)
    assert [v(shapes.position_in_ring(F.lit(a), F.lit(b), square)) for a, b in ((1.0, 1.0), (0.0, 0.0), (3.0, 1.0))] == [1, 0, -1]
    assert v(shapes.is_simple(square)) and not v(shapes.is_simple(bow)) and v(shapes.is_ccw(square))
    met = v(shapes.meeting_point(at(0, 0), at(2, 2), at(0, 2), at(2, 0)))
    assert (met.lat, met.lon) == (1.0, 1.0) and v(shapes.meeting_point(at(0, 0), at(0, 1), at(1, 0), at(1, 1))) is None
    c = v(shapes.polygon_centre(square, 1e-3))
    assert abs(c.lat - 1) < 0.01 and abs(c.lon - 1) < 0.01
    assert len(v(shapes.simplified(F.array(at(0, 0), at(0.001, 1), at(0, 2), at(1, 3)), 0.01))) == 3
