"""Spoken instructions at roundabouts, targets and losses of the signal; the stream against the table."""

from __future__ import annotations

from datetime import datetime, timedelta

from atlasframe.streaming import agents, voice

START = datetime(2024, 1, 1)
SCHEMA = "vehicle long, ts timestamp, event_id long, along double, state string"


def told(spark, rows):
    return voice.announcements(spark.createDataFrame([(1, *r) for r in rows], "vehicle long, at double, kind string, exit int"))


def said(spark, instructions, messages, vehicle="car"):
    df = spark.createDataFrame([(1, START + timedelta(seconds=s), k, float(a) if a is not None else None, state) for k, (s, a, state) in enumerate(messages)], SCHEMA)
    rows = agents.over_table(voice.with_announcements(df, told(spark, instructions)), voice.voice(vehicle)).collect()
    return [((r.ts - START).total_seconds(), r.kind) for r in sorted(rows, key=lambda r: r.ts)]


def on(*alongs):
    return [(k, a, "on_route") for k, a in enumerate(alongs)]


def test_turns_are_said_repeated_and_joined(spark):
    turns = [(1000.0, "turn_left", None), (1150.0, "turn_right", None), (2000.0, "straight_on", None)]
    assert said(spark, turns, on(50, 150, 400, 460, 860, 880, 990, 1000, 1001)) == [(1, "after 800 metres turn_left then turn_right"), (3, "after 500 metres turn_left then turn_right"), (4, "after 100 metres turn_left then turn_right"), (6, "turn_left then turn_right"), (8, "after 100 metres turn_right")]
    assert said(spark, turns, on(990), "foot") == [(0, "after 50 metres turn_left then turn_right")]
    assert said(spark, turns, on(700, 620)) == [(0, "after 200 metres turn_left then turn_right"), (1, "after 300 metres turn_left then turn_right")]  # driven back by more than 50 m


def test_roundabouts(spark):
    way = [(500.0, "roundabout_enter", None), (560.0, "roundabout_leave", 3), (900.0, "turn_left", None)]
    assert said(spark, way, on(100, 450, 520, 555, 570)) == [(0, "after 300 metres roundabout_exit_3"), (1, "exit_3"), (4, "after 300 metres turn_left")]
    assert said(spark, [(60.0, "roundabout_leave", 2), (300.0, "turn_left", None)], on(10, 61)) == [(1, "after 200 metres turn_left")]  # begun on it: silent until it is left


def test_targets_are_told_when_near(spark):
    assert said(spark, [(1000.0, "target", None)], on(500, 950, 961, 999)) == [(2, "target")]


def test_signal_lost_and_found(spark):
    messages = [(0, 10, "on_route"), (5, 10, "no_signal"), (9, 10, "no_signal"), (11, 10, "no_signal"), (30, 10, "no_signal"), (31, 700, "off_route"), (32, 700, "on_route")]
    assert said(spark, [(1000.0, "turn_left", None)], messages) == [(11, "gps_lost"), (31, "gps_found"), (32, "after 200 metres turn_left")]


def test_stream_equals_table(spark, tmp_path):
    way = [(400.0 * k, "turn_left" if k % 2 else "sharp_right", None) for k in range(1, 9)]
    rows = [(1, START + timedelta(seconds=k), k, 45.0 * k, "no_signal" if 20 < k < 35 else "on_route") for k in range(60)]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = agents.over_stream(voice.with_announcements(spark.readStream.schema(SCHEMA).parquet(source), told(spark, way)), voice.voice())
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    table = agents.over_table(voice.with_announcements(spark.createDataFrame(rows, SCHEMA), told(spark, way)), voice.voice())
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(map(tuple, table.collect())) != []
