"""Searches guided by landmarks against searches of everything."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from atlasframe.operators import routing


def grid(spark, n=14, seed=2):
    rng = random.Random(seed)
    rows = [(y * 100 + x, (y + dy) * 100 + x + dx, rng.uniform(1, 1.5)) for y in range(n) for x in range(n) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + dy < n and 0 <= x + dx < n and rng.random() < 0.95]
    return spark.createDataFrame(rows + [(5000, 5001, 1.0)], "from_id long, to_id long, cost double")


def test_same_costs_with_far_fewer_settled_rows(spark):
    g = grid(spark).cache()
    known = routing.landmark_costs(spark.createDataFrame([(0,), (13,), (1300,), (1313,)], "node_id long"), g)
    pairs = [(607, 609), (606, 903), (202, 205), (1000, 1208), (505, 505), (607, 5001), (5000, 5001)]
    settled = routing.search_to(spark.createDataFrame(pairs, "source long, target long"), g, known).cache()
    all_costs = routing.costs_from(spark.createDataFrame(sorted({(a, a) for a, _ in pairs}), "source long, node_id long"), g).cache()
    want = {(r.source, r.node_id): round(r.cost, 9) for r in all_costs.collect()}
    got = {(r.source, r.target): round(r.cost, 9) for r in settled.where("node_id = target").collect()}
    assert got == {p: want[p] for p in pairs if p in want} and len(got) == 6
    reached = {(r.source, r.n) for r in all_costs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    whole = sum(dict(reached)[a] for a, _ in pairs)
    assert settled.where("target <> 5001").count() * 3 < whole


def test_without_landmarks_it_still_finds_all(spark):
    g = grid(spark, 6)
    none = routing.landmark_costs(spark.createDataFrame([], "node_id long"), g)
    pairs = spark.createDataFrame([(0, 505)], "source long, target long")
    want = {r.node_id: r.cost for r in routing.costs_from(spark.createDataFrame([(0, 0)], "source long, node_id long"), g).collect()}
    assert [round(r.cost, 9) for r in routing.search_to(pairs, g, none).where("node_id = target").collect()] == [round(want[505], 9)]
