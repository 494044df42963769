"""Dead reckoning: the table against a plain version, and the stream against the table, timers included."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from atlasframe.streaming import tunnels

EDGES = [(v, 100.0 * j, 100.0 * (j + 1), 10.0 + 5 * j, j in (3, 4, 5, 6, 8)) for v in (1, 2, 3) for j in range(10)]
START = datetime(2024, 1, 1)


def edges(spark):
    return spark.createDataFrame(EDGES, "vehicle long, start double, to double, speed double, tunnel boolean")


def messages(n=120, seed=4):
    rng = random.Random(seed)
    rows, at = [], {1: 0.0, 2: 0.3, 3: 0.6}
    for k in range(n):
        v = rng.choice([1, 2, 3])
        at[v] += rng.choice([0.4, 1.0, 2.0, 3.0, 7.5, 40.0])
        rows.append((v, START + timedelta(seconds=at[v]), rng.choice([None, 50.0, 250.0, 300.0, 399.5, 431.0, 650.0, 820.0, 999.0]), rng.choice([5.0, 20.0, 99.0, 100.0, 400.0])))
    return rows


def plain(rows):
    """Every tick by itself, from the last fix before it."""
    out = []
    for v in {r[0] for r in rows}:
        own = [(ts, along) for w, ts, along, accuracy in sorted((r for r in rows if r[0] == v), key=lambda r: r[1]) if along is not None and accuracy < 100]
        for (ts, along), after in zip(own, [*(t for t, _ in own[1:]), datetime(2100, 1, 1)], strict=True):
            out.append((v, ts, "fix", along))
            path = []
            for _, a, b, speed, tunnel in (e for e in EDGES if e[0] == v and e[2] > along):
                if not tunnel:
                    break
                path.append((max(a, along), b, speed))
            for k in range(1000):
                t = ts + timedelta(seconds=2 + k)
                if t >= after:
                    break
                left, place = 2.0 + k, None
                for a, b, speed in path:
                    if left < (b - a) / speed:
                        place = a + left * speed
                        break
                    left -= (b - a) / speed
                out.append((v, t, "no_signal" if place is None else "estimate_in_tunnel", (path[-1][1] if path else along) if place is None else place))
                if place is None:
                    break
    return sorted((v, t, kind, round(a, 6)) for v, t, kind, a in out)


def found(df):
    return sorted((r.vehicle, r.ts, r.kind, round(r.along, 6)) for r in df.collect())


SCHEMA = "vehicle long, ts timestamp, along double, accuracy double"


def test_table_equals_a_plain_version(spark):
    rows = messages(400)
    got = found(tunnels.reckoned_table(tunnels.with_tunnels(spark.createDataFrame(rows, SCHEMA).repartition(5), edges(spark))))
    assert got == plain(rows) and {k for _, _, k, _ in got} == {"fix", "estimate_in_tunnel", "no_signal"}


def test_runs_of_tunnels(spark):
    runs = tunnels.tunnel_runs(edges(spark)).where("vehicle = 1").orderBy("low").collect()
    assert [(r.low, r.high, [e.to for e in r.edges]) for r in runs] == [(300.0, 700.0, [400.0, 500.0, 600.0, 700.0]), (800.0, 900.0, [900.0])]


def test_nulls_and_nothing(spark):
    rows = [(None, START, 350.0, 1.0), (1, None, 350.0, 1.0), (2, START, None, 1.0), (3, START, 350.0, None)]
    assert found(tunnels.reckoned_table(tunnels.with_tunnels(spark.createDataFrame(rows, SCHEMA), edges(spark)))) == []
    assert found(tunnels.reckoned_table(tunnels.with_tunnels(spark.createDataFrame([], SCHEMA), edges(spark)))) == []


def test_stream_and_table_agree_with_expired_timers(spark, tmp_path):
    """Files of messages, those of one vehicle out of order within the delay; the last file only moves the watermark on, so that waiting timers expire."""
    rows = sorted(messages(60), key=lambda r: r[1])
    for k in range(0, len(rows) - 1, 7):  # neighbours change places
        if abs((rows[k][1] - rows[k + 1][1]).total_seconds()) < 4:
            rows[k], rows[k + 1] = rows[k + 1], rows[k]
    last = max(r[1] for r in rows)
    parts = [rows[:25], rows[25:], [(9, last + timedelta(seconds=500), 1.0, 1.0)], [(9, last + timedelta(seconds=900), 1.0, 1.0)]]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = tunnels.reckoned_stream(tunnels.with_tunnels(spark.readStream.schema(SCHEMA).parquet(source), edges(spark)))
            q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = found(spark.read.parquet(sink).where(F.col("vehicle") < 9))
    assert got == plain(rows)
